"""N-gram Jaccard join by universe partition and pigeonhole, with exact verification.

Sets are grouped by size into bands. A band's scheme cuts the universe of shingle hashes into m ranges, the segments. Two sets
of Jaccard similarity t differ in at most H shingles, so a record that trusts segments worth H + 1 in all is sure to
agree with its partner on one of them: a segment trusted exactly is worth one, a segment trusted up to one deletion on either
side is worth two. Each record chooses its cheapest segments by how often their contents occur around it, and skips the
others. Records meet partners of their own band in that band's scheme, and of the band below in that one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_bytes, mix, pieces, plan_bytes, release, slight, stash, unstash, utf8, whole

_U = np.uint64
#: Low bits of an entry: the record relies on it; it lacks one shingle of its segment.
_TRUSTED, _DELETED = 1, 2
#: Input for each bucket of signatures. Beyond 2**20 buckets (8 TB of input) buckets grow instead.
BUCKET_BYTES = 8 << 20
#: Shingles in a block of an open group.
CELL = 500_000
#: Groups of up to so many records are paired within their task; larger ones by stars and, where needed, block by block.
SMALL = 12
#: Edges on disk that one task contracts on its own.
FOREST_BYTES = 8 << 20


class _Words(dict):
    """Hash of each word. It is a cryptographic one, cut to 64 bits: no rule that texts follow makes words collide."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out


_words = _Words()


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): the distinct shingles of each text, sorted by hash."""
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found = raw[a:b].tobytes().lower().split()  # bytes: A-Z alone are lower-cased, the six ASCII blanks alone separate
        k = len(found)
        words = np.fromiter(map(_words.__getitem__, found), np.uint64, k)
        if k >= width:
            total = np.zeros(k - width + 1, np.uint64)
            for j in range(width):
                total = total * _U(0x9E3779B97F4A7C15) + words[j : j + len(total)]
            h = np.sort(mix(total))
            sets.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h)
        elif k:
            h = _U(k)
            for w in words:
                h = mix(np.array([h], np.uint64))[0] ^ w
            sets.append(mix(np.array([h], np.uint64)))
        else:
            sets.append(words)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def exact_shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted numbers; numbers are equal where the words are, without any hash."""
    known: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    words = [t.lower().split() for t in texts]
    counts = [len(w) for w in words]
    one = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, sum(counts))
    gram, span = one, 1
    while span < width and len(one) >= width:
        step = span if 2 * span <= width else 1
        n = len(one) - span - step + 1
        gram = np.unique((gram[:n] << 32) | (gram if step == span else one)[span : span + n], return_inverse=True)[1]
        span += step
    out, at = [], 0
    for k, ws in zip(counts, words, strict=True):
        if k >= width:
            out.append(np.unique(gram[at : at + k - width + 1]))
        elif k:
            out.append(np.array([-1 - short.setdefault(tuple(ws), len(short))], np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        at += k
    return out


class Bands:
    """Size bands up to any size: lo, hi, H (largest difference of a pair whose smaller set is in the band), m (segments), one-deletion or not."""

    def __init__(self, percent: int, ratio: float = 1.6, small: int = 84):
        self.percent, self.lo, self.hi, self.H, self.m, self.deletions = percent, [], [], [], [], []
        lo = 1
        while lo < 1 << 40:
            hi = max(lo, int(lo * ratio))
            largest = hi * 100 // percent
            h = (hi + largest) * (100 - percent) // (100 + percent)
            self.lo.append(lo)
            self.hi.append(hi)
            self.H.append(h)
            self.deletions.append(hi <= small)
            self.m.append(max(1, -(-(h + 1) * 8 // 10)) if hi <= small else -(-(h + 1) * 15 // 10))
            lo = hi + 1
        self.lo, self.hi, self.H, self.m = (np.array(x, np.int64) for x in (self.lo, self.hi, self.H, self.m))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hi, sizes)

    def below(self, sizes: np.ndarray) -> list[np.ndarray]:
        """For each step down: whether a set of that size can have a partner so many bands below."""
        band, least, out = self.of(sizes), -(-sizes * self.percent // 100), []
        for step in range(1, len(self.hi)):
            can = (band >= step) & (self.hi[np.maximum(band - step, 0)] >= least)
            if not can.any():
                break
            out.append(can)
        return out


def _segments(tokens: np.ndarray, row: np.ndarray, m: np.ndarray, salt: np.ndarray):
    """(row, contents' hash, size, first token) of each segment that isn't empty. Tokens are sorted within a row, and so are their segments."""
    seg = ((tokens >> _U(32)) * m[row].astype(np.uint64)) >> _U(32)
    begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]))))
    sums = np.add.reduceat(mix(tokens ^ _U(0x5851F42D4C957F2D)), begin)
    mark = mix(salt[row[begin]] * _U(0x9E3779B97F4A7C15) + seg[begin])
    size = np.diff(np.concatenate((begin, [len(tokens)])))
    return row[begin], sums, mark, size, begin


def entries(tokens: np.ndarray, offsets: np.ndarray, bands: Bands, band: np.ndarray, use: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(signature with its two low bits, row) for the rows in `use`, in the scheme `band` of each row.

    every: all segments are put forth, as a record does in its own band, where others look for it; else the trusted ones only.
    """
    sizes = np.diff(offsets)
    rows = np.flatnonzero(use & (sizes > 0))
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_rows = np.repeat(np.arange(len(sizes)), sizes)
    mine = np.zeros(len(sizes), bool)
    mine[rows] = True
    pick = mine[all_rows]
    tok, row = tokens[pick], all_rows[pick]
    salt = band.astype(np.uint64) + _U(1)
    r, sums, mark, size, begin = _segments(tok, row, bands.m[band], salt)
    sig = mix(sums ^ mark)
    _, back, freq = np.unique(sig, return_inverse=True, return_counts=True)
    cost = np.minimum(freq[back], (1 << 20) - 1)
    deletions = np.asarray(bands.deletions)[band[r]] & (size >= 3)
    need = bands.H[band] + 1
    # Trust the cheapest segments first, each exactly; then, if that isn't enough, the cheapest up to one deletion.
    order = np.argsort(r * (1 << 20) + cost, kind="stable")
    start = np.searchsorted(r[order], r[order])
    place = np.empty(len(r), np.int64)
    place[order] = np.arange(len(r)) - start
    have = np.bincount(r, minlength=len(sizes))
    can_delete = deletions
    del_order = order[can_delete[order]]
    del_place = np.full(len(r), 1 << 40)
    del_place[del_order] = np.arange(len(del_order)) - np.searchsorted(r[del_order], r[del_order])
    missing = np.maximum(need - have, 0)
    trusted = place < need[r]
    doubled = can_delete & (del_place < missing[r])
    worth = have + np.minimum(missing, np.bincount(r[can_delete], minlength=len(sizes)))
    short_of = mine & (worth < need)

    keep = trusted | doubled | every | short_of[r]
    out = [(sig[keep] & ~_U(3)) | (trusted | doubled)[keep].astype(np.uint64) * _U(_TRUSTED)]
    where = [r[keep]]
    # Deletion neighbourhoods: of doubled segments, and in a record's own band of all that others may have doubled.
    near = can_delete & (doubled | every)
    if near.any():
        at = np.flatnonzero(near)
        k = size[at]
        seg_of = np.repeat(at, k)
        inner = np.arange(len(seg_of)) - np.repeat(np.cumsum(k) - k, k)
        gone = mix(tok[begin[seg_of] + inner] ^ _U(0x5851F42D4C957F2D))
        out.append((mix((sums[seg_of] - gone) ^ mark[seg_of]) & ~_U(3)) | _U(_DELETED) | doubled[seg_of].astype(np.uint64) * _U(_TRUSTED))
        where.append(r[seg_of])
    # A record whose segments are worth too little puts forth its shingles: it meets others of its kind there, the rest by their trust.
    if short_of.any():
        pick = short_of[row]
        out.append((mix(tok[pick] + mix(salt[row[pick]] + _U(0x1234567))) & ~_U(3)) | _U(_TRUSTED))
        where.append(row[pick])
    return np.concatenate(out), np.concatenate(where)


def sketch(tokens: np.ndarray, size: int) -> bytes:
    """Four bits for each of 2**k equal ranges of the universe, about two for three shingles, two ranges a byte: the sum of its shingles' numbers (1 to 15) mod 16.

    Two sets differ in at least as many shingles as their sketches, folded to the same length, differ in ranges.
    """
    k = max(3, int(size).bit_length() - 1)
    sums = np.bincount((tokens >> _U(64 - k)).astype(np.int64), weights=(mix(tokens) % _U(15) + _U(1)).astype(np.float64), minlength=1 << k).astype(np.int64).astype(np.uint8) & 15
    return (sums[::2] | sums[1::2] << 4).tobytes()


def _ranges(v: np.ndarray, width: int) -> np.ndarray:
    """The numbers of `width` ranges of sketches, which lie along the last axis."""
    v = np.stack((v & 15, v >> 4), -1).reshape(*v.shape[:-1], width, -1)
    return v.sum(-1, dtype=np.uint8) & 15  # 256 is a multiple of 16


def _may_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least `differ` shingles can reach the threshold."""
    return (100 + percent) * differ <= (100 - percent) * (n_a + n_b)


def _blob(sids: np.ndarray, sizes: np.ndarray, sig: np.ndarray, row: np.ndarray) -> bytes:
    """Entries of one bucket by record: a record's id, its size (two bytes if all fit) and the number of its entries (one, if all fit), then four bytes of each signature.

    Half a million entries of a bucket agree by chance on 30 bits in about a hundred pairs, which verification drops.
    """
    order = np.argsort(row, kind="stable")
    used, count = np.unique(row, return_counts=True)
    sig, sizes = sig[order], sizes[used]
    kinds = [np.uint16 if sizes.max() < 1 << 16 else np.int32, np.uint8 if count.max() < 1 << 8 else np.int32]
    head = np.array([len(used), len(sig), *(np.dtype(k).itemsize for k in kinds)], np.int32).tobytes()
    return b"".join((head, sids[used].tobytes(), sizes.astype(kinds[0]).tobytes(), count.astype(kinds[1]).tobytes(), (sig & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()))


def _unblob(data: bytes) -> tuple[np.ndarray, ...]:
    k, n, wide, many = np.frombuffer(data, np.int32, 4).tolist()
    at = 16
    parts = []
    for kind, count in ((np.uint64, k), (np.uint16 if wide == 2 else np.int32, k), (np.uint8 if many == 1 else np.int32, k), (np.uint32, n)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    sids, sizes, times, low = parts
    place = np.repeat(np.arange(k), times)
    return low.astype(np.uint64), sids[place], sizes[place].astype(np.int32)


def group_pairs(sig: np.ndarray, sid: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(a, b, group, member, size): candidate pairs of records, and the members of groups too large to be paired here.

    A large group gives a star around its first trusted record and a chain by size, no more.
    """
    order = np.lexsort((sig & _U(3), size, sid, sig >> _U(2)))
    sig, sid, size = sig[order], sid[order], size[order]
    key = sig >> _U(2)
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]) | (size[1:] != size[:-1])))
    first = np.flatnonzero(fresh)
    bits = np.bitwise_or.reduceat((sig & _U(_TRUSTED)).astype(np.int64), first) if len(sig) else np.zeros(0, np.int64)
    deleted = np.bitwise_and.reduceat((sig & _U(_DELETED)).astype(np.int64), first) if len(sig) else np.zeros(0, np.int64)
    key, sid, size = key[first], sid[first], size[first].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate((begin, [len(key)])))
    group = np.repeat(np.arange(len(begin)), n)
    live = np.repeat((np.bitwise_or.reduceat(bits, begin) > 0) & (np.bitwise_and.reduceat(deleted, begin) == 0) & (n > 1), n) if len(begin) else np.zeros(0, bool)
    small = live & (n[group] <= SMALL)
    a, b = [], []
    fits = lambda i, j: 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    for d in range(1, SMALL):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        i = i[((bits[i] | bits[i + d]) > 0) & ((deleted[i] & deleted[i + d]) == 0)]
        i = i[fits(i, i + d)]
        a.append(i)
        b.append(i + d)
    large = np.flatnonzero(live & ~small)
    if len(large):
        order = large[np.lexsort((sid[large], 1 - bits[large], group[large]))]
        pivot = order[np.concatenate(([True], group[order][1:] != group[order][:-1]))]
        center = np.repeat(pivot, n[group[pivot]])
        members = order
        by_size = large[np.lexsort((sid[large], size[large], group[large]))]
        chain = np.flatnonzero(group[by_size][1:] == group[by_size][:-1])
        for i, j in ((center, members), (by_size[chain], by_size[chain + 1])):
            ok = (i != j) & fits(i, j)
            a.append(i[ok])
            b.append(j[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = a[sid[a] != sid[b]], b[sid[a] != sid[b]]
    x, y = np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])
    if len(x):
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        once = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        x, y = x[once], y[once]
    return x, y, key[large], sid[large], size[large]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes of the edges (a, b) but the least ones themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(i):
        x, y = least[i], least[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[other], nodes[least[other]]


def components(edges: DataFrame, tag: str, from_bytes: int | None = None, forest_bytes: int = FOREST_BYTES) -> DataFrame:
    """(node, root) for each node of edges (a, b): the least node that it is linked to.

    A task contracts its edges to a forest, a bounded number of edges at a time. What fits one task is done by then; else a
    round of alternating large and small stars follows (joins and aggregations with partial sums), and so on until nothing
    changes. Each round ends in a table, and rounds grow with the logarithm of a component's size. No link reaches the driver.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
            if sum(len(x) for x, _ in held) >= 1 << 20:
                held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) >= 1 << 19 and not alone:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["a", "b"])
        if held:
            node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if alone:
                node, root = (np.concatenate((x, np.unique(root))) for x in (node, root))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    now = stash(edges.select("a", "b").filter("a != b"), tag, from_bytes)
    mark = None
    while True:
        size = held_bytes(now)
        alone = size <= forest_bytes
        fewer = stash((now.coalesce(1) if alone else now).mapInArrow(contract, "a long, b long"), tag)
        unstash(now)
        now = fewer
        if alone:
            out = now.withColumnsRenamed({"a": "node", "b": "root"})
            out._florilege_path = now._florilege_path
            return out
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("a"), F.col("m").alias("b")).union(joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = stash(small, tag, size)
        unstash(now)
        now = new
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            out = stash(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), tag, size)
            unstash(now)
            return out
        mark = seen


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, buckets: int | None = None, group_col: str | None = None, first_col: str | None = None, cell: int = CELL, sid_mask: int = -1
) -> DataFrame:
    """One row per row of docs: id, text_hash (xxhash64), n_shingles, component_id, the least id reachable by links (its own if there is none).

    group_col names one more column, which tells components apart whatever their ids, null for a row without words; first_col
    another, true for the rows with the least id of their component and, of these, the least text hash, and for rows without words.

    Words are runs of other than ASCII white space, with A-Z as a-z; a set holds the distinct shingles of `width` words, the whole
    sequence if there are fewer. Two rows link when 100 * |intersection| >= percent * |union|; every link counts.

    Rows whose sets have the same 128-bit digest are one record; records whose 64-bit ids collide are told apart by the rest. (`sid_mask`
    cuts ids for tests.) Signatures travel in blocks, one for each batch and bucket (a hash range, BUCKET_BYTES of input), and
    meet there; candidates lose those whose sketches differ too much, and the rest are verified word by word on their texts. A group of
    more than SMALL records with one signature gives a star and a chain at first; if the verified links leave it in several
    components, its records are cut into blocks of about `cell` shingles, a large component into blocks of its own, and a task
    compares two blocks, across components only. It holds two blocks, and gives their records that have a partner by the sketches; of
    these another one compares the texts, and gives a link for each component that it joins. Blocks of one component don't meet.

    Null text counts as empty; a row without words links with nothing and has its own id. Null ids never are a component_id
    unless all are null. Repeated rows are copies. An empty table gives an empty result. Other columns don't matter.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    unknown = 2 * BUCKET_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = buckets or max(16, min(1 << 20, -(-plan_bytes(docs, unknown) // BUCKET_BYTES)))
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    schema = f"bucket int, blob binary, id {kind}, th long, sid long, sid2 long, n int, sketch binary"
    names = ["bucket", "blob", "id", "th", "sid", "sid2", "n", "sketch"]
    out_names = ["what", "id", "th", "sid", "sid2", "n", "sketch", "a", "b"]
    mask = _U(sid_mask & (2**64 - 1))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for p, q in pieces(offsets, 6 << 20):
                for a in range(p, q, 60_000):
                    b = min(q, a + 60_000)
                    tokens, at = shingle_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                    sizes = np.diff(at)
                    digest = []
                    for salt in (0x2545F4914F6CDD1D, 0x5DA9F4C3B1E07265):
                        sums = np.concatenate(([_U(0)], np.cumsum(mix(tokens ^ _U(salt)), dtype=np.uint64)))
                        digest.append(mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(sizes.astype(np.uint64))))
                    sids = digest[0] & mask
                    part = batch.slice(a, b - a)
                    sketches = [sketch(tokens[i:j], j - i) for i, j in zip(at[:-1], at[1:], strict=True)]
                    home = (sids % _U(n_buckets)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(home), pa.nulls(b - a, pa.binary()), part.column(0), part.column(1), *(pa.array(x.view(np.int64)) for x in (sids, digest[1])), pa.array(sizes.astype(np.int32)), pa.array(sketches, pa.binary())], names=names)
                    # Of rows that repeat within the batch one puts forth its signatures; each of two sets does whose ids collide.
                    _, once = np.unique(np.stack((sids, digest[1])), axis=1, return_index=True)
                    single = np.zeros(b - a, bool)
                    single[once] = True
                    band = bands.of(sizes)
                    found = [entries(tokens, at, bands, band, single, True)]
                    found += [entries(tokens, at, bands, np.maximum(band - step, 0), single & can, False) for step, can in enumerate(bands.below(sizes), 1)]
                    sig, row = (np.concatenate(x) for x in zip(*found, strict=True))
                    bucket = ((sig >> _U(44)) % _U(n_buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    full, start = np.unique(bucket[order], return_index=True)
                    blobs = [_blob(sids, sizes, sig[at_], row[at_]) for at_ in np.split(order, start[1:])] if len(full) else []
                    k = len(full)
                    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(k, batch.schema.field(0).type), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last, types = None, None

        def found(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            sig, sid, size = (np.concatenate(x) for x in zip(*map(_unblob, blobs), strict=True))
            x, y, group, member, n = group_pairs(sig, sid, size, percent)
            group = mix(group * _U(n_buckets) + _U(bucket))
            for what, a, b, sizes in ((1, x, y, np.zeros(len(x), np.int32)), (2, group, member, n.astype(np.int32))):
                k = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, what, np.int32)), pa.nulls(k, types), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.array(sizes), pa.nulls(k, pa.binary()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=out_names)

        for batch in batches:
            types = batch.schema.field(2).type
            rows = batch.filter(pa.array(~batch.column(1).is_valid().to_numpy(zero_copy_only=False)))
            k = len(rows)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), *rows.columns[2:], pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=out_names)
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob is not None:
                    if held and bucket != last:
                        yield from found(last, held)
                        held = []
                    last = bucket
                    held.append(blob)
        if held:
            yield from found(last, held)

    signed = texts.select("id", "th", "text").mapInArrow(sign, schema).repartition(min(n_buckets, 20_000), "bucket").sortWithinPartitions("bucket")
    met = stash(signed.mapInArrow(meet, f"what int, id {kind}, th long, sid long, sid2 long, n int, sketch binary, a long, b long"), "jaccard-met")
    release(spark)
    size = held_bytes(met)
    rows = met.filter("what = 0").select("id", "th", "sid", "sid2", "n", "sketch")
    card = F.min(F.struct("sid2", "id", "th", "n", "sketch")).alias("r")
    records = rows.filter("n > 0").groupBy("sid").agg(card, F.max("sid2").alias("hi"))
    records = stash(records.select("sid", "r.sid2", "hi", "r.id", "r.th", "r.n", "r.sketch"), "jaccard-records", size)
    pairs = met.filter("what = 1").select("a", "b").distinct()
    members = met.filter("what = 2").select(F.col("a").alias("g"), F.col("b").alias("sid"), "n")
    rows = rows.drop("sketch")

    twins = records.filter("sid2 != hi").select("sid", F.col("sid2").alias("lo"))
    if twins.limit(1).count():  # ids that several sets share: all sets but one get other ids, and what their id has met
        apart = rows.filter("n > 0").join(twins, "sid").filter("sid2 != lo").select(F.xxhash64("sid", "sid2").alias("node"), "sid", "sid2")
        alias = stash(apart.distinct().select("node", "sid", F.col("sid2").alias("_sid2")), "jaccard-twins")
        more = met.filter("what = 0 AND n > 0").join(alias, [met["sid"] == alias["sid"], met["sid2"] == alias["_sid2"]]).groupBy("node").agg(card)
        more = more.select(F.col("node").alias("sid"), "r.sid2", F.col("r.sid2").alias("hi"), "r.id", "r.th", "r.n", "r.sketch")
        records = stash(records.unionByName(more), "jaccard-records", size)
        sides = alias.select("sid", "node").union(alias.select("sid", F.col("sid").alias("node"))).distinct()
        spread = lambda df, c: df.join(sides.withColumnsRenamed({"sid": c, "node": "_node"}), c, "left").withColumn(c, F.coalesce("_node", c)).drop("_node")
        own = sides.join(sides.withColumnRenamed("node", "other"), "sid").select(F.col("node").alias("a"), F.col("other").alias("b"))
        pairs = spread(spread(pairs, "a"), "b").select("a", "b").union(own).filter("a < b").distinct()
        members = spread(members, "sid").select("g", "sid", "n").distinct()
        rows = rows.join(alias.withColumnRenamed("sid", "_sid"), (F.col("sid") == F.col("_sid")) & (F.col("sid2") == F.col("_sid2")), "left").withColumn("sid", F.coalesce("node", "sid")).select(rows.columns)

    def ends(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        return both.withColumn("sid", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))

    def brought(table: DataFrame, source: DataFrame, *columns: str) -> DataFrame:
        """(a, b, each column of either side) of the pairs in table, whose sid stands in source."""
        found = source.join(slight(ends(table), table), "sid")
        return found.groupBy("a", "b").agg(*(F.min(F.when(F.col("side") == i, F.col(c))).alias(f"{c}_{x}") for c in columns for i, x in enumerate("ab")))

    def fetch(sids: DataFrame, table: DataFrame) -> DataFrame:
        """(sid, text) of the records that sids, a selection from table, names."""
        wanted = records.join(slight(sids.distinct(), table), "sid", "left_semi").select("sid", F.col("id").alias("_id"), F.col("th").alias("_th"))
        found = texts.join(slight(wanted, table), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
        return found.select("sid", "text").dropDuplicates(["sid"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            (da, oa), (db, ob) = utf8(batch.column(4)), utf8(batch.column(5))
            ka, kb = np.diff(oa), np.diff(ob)
            width = np.minimum(ka, kb)
            ok = np.zeros(len(batch), bool)
            for w in np.unique(width).tolist():
                for pick in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum()) * w // (8 << 20) + 1)):
                    for u, v in {(int(u), int(v)) for u, v in zip(ka[pick], kb[pick], strict=True)}:
                        i = pick[(ka[pick] == u) & (kb[pick] == v)]
                        x = _ranges(da[oa[i][:, None] + np.arange(u)], 2 * w)
                        y = _ranges(db[ob[i][:, None] + np.arange(v)], 2 * w)
                        ok[i] = _may_link(n_a[i], n_b[i], (x != y).sum(1), percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (da, oa), (db, ob) = utf8(batch.column(2)), utf8(batch.column(3))
            for i, j in pieces(oa + ob, 2 << 20):
                sets = exact_shingles([d[o[k] : o[k + 1]].tobytes() for d, o in ((da, oa), (db, ob)) for k in range(i, j)], width)
                ok = [(100 + percent) * _shared(x, y) >= percent * (len(x) + len(y)) for x, y in zip(sets[: j - i], sets[j - i :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i).filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    def glance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records of two blocks that have a partner there, as sizes and sketches tell."""
        for table in _by_group(batches, "p"):
            data, at = utf8(table.column("sketch"))
            sizes = np.diff(at)
            width = int(sizes.min())
            cards = np.zeros((len(sizes), 2 * width), np.uint8)
            for w in np.unique(sizes).tolist():
                i = np.flatnonzero(sizes == w)
                cards[i] = _ranges(data[at[i][:, None] + np.arange(w)], 2 * width)
            first, twice = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("first", "twice"))
            hit = np.zeros(len(sizes), bool)
            for u, others in _partners(table.column("n").to_numpy().astype(np.int64), table.column("root").to_numpy(), first, bool(twice[0]), cards, percent):
                hit[u] = hit[others] = True
            if hit.any():
                yield from table.select(["p", "sid", "root", "first", "twice"]).filter(pa.array(hit)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "p"):
            data, at = utf8(table.column("text"))
            sets = exact_shingles([data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], width)
            sid, root = (table.column(c).to_numpy() for c in ("sid", "root"))
            first, twice = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("first", "twice"))
            yield _spanning(sid, root, first, bool(twice[0]), sets, percent)

    pairs = stash(pairs, "jaccard-pairs", size)
    likely = stash(brought(pairs, records.select("sid", "n", "sketch"), "n", "sketch").mapInArrow(sift, "a long, b long"), "jaccard-likely", held_bytes(records, pairs))
    release(spark)
    both = brought(likely, fetch(ends(likely).select("sid"), likely), "text")
    links = stash(both.mapInArrow(verify, "a long, b long"), "jaccard-links")
    release(spark)
    roots = components(links, "jaccard-roots", held_bytes(links))
    unstash(pairs, likely)

    if members.limit(1).count():
        members = members.join(slight(roots), F.col("sid") == F.col("node"), "left").select("g", "sid", "n", F.coalesce("root", "sid").alias("root"))
        members = stash(members, "jaccard-members", size)
        team = members.groupBy("g", "root").agg(F.sum("n").alias("t")).withColumn("large", F.col("t") > cell // 2)
        blocks = lambda t: F.ceil(t / F.lit(cell)).cast("int")
        plan = team.groupBy("g").agg(
            F.count("*").alias("teams"), F.collect_list(F.when(F.col("large"), F.struct(F.col("root").alias("team"), blocks(F.col("t")).alias("n")))).alias("large"), F.sum(F.when(~F.col("large"), F.col("t"))).alias("rest")
        ).filter("teams > 1")
        plan = stash(plan.select("g", "large", blocks(F.coalesce("rest", F.lit(0))).alias("rest")), "jaccard-open", held_bytes(members))
        # A block: whether it is of one component, which one, and its number there.
        block = "named_struct('own', {own}, 'team', {team}, 'k', {k})"
        every = f"concat(flatten(transform(large, x -> transform(sequence(0, x.n - 1), k -> {block.format(own='true', team='x.team', k='k')}))), transform(IF(rest > 0, sequence(0, rest - 1), cast(array() AS array<int>)), k -> {block.format(own='false', team='0L', k='k')}))"
        placed = members.join(slight(plan), "g").withColumn("_mine", F.expr("get(filter(large, x -> x.team = root), 0)"))
        mine = "CASE WHEN _mine IS NULL THEN " + block.format(own="false", team="0L", k="cast(pmod(xxhash64(sid), greatest(rest, 1)) AS int)") + " ELSE " + block.format(own="true", team="root", k="cast(pmod(xxhash64(sid), _mine.n) AS int)") + " END"
        placed = placed.withColumn("mine", F.expr(mine)).withColumn("other", F.explode(F.expr(f"filter({every}, x -> NOT (x.own AND mine.own AND x.team = mine.team))")))
        placed = placed.select("sid", "root", F.xxhash64("g", F.least("mine", "other"), F.greatest("mine", "other")).alias("p"), F.expr("mine <= other").alias("first"), F.expr("mine = other").alias("twice"))
        placed = stash(placed, "jaccard-blocks", held_bytes(members))
        if placed.limit(1).count():
            seen = placed.join(slight(records.select("sid", "n", "sketch"), records), "sid").select("p", "sid", "root", "first", "twice", "n", "sketch")
            seen = stash(seen.repartition("p").sortWithinPartitions("p").mapInArrow(glance, "p long, sid long, root long, first boolean, twice boolean"), "jaccard-seen")
            release(spark)
            asked = slight(seen).join(fetch(seen.select("sid"), seen), "sid").select("p", "sid", "root", "first", "twice", "text")
            more = stash(asked.repartition("p").sortWithinPartitions("p").mapInArrow(compare, "a long, b long"), "jaccard-more")
            before = roots
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "jaccard-roots", held_bytes(roots, more))
            unstash(before, more, seen)
        unstash(members, plan, placed)
    unstash(records, links)
    release(spark)

    placed = rows.join(slight(roots), F.col("sid") == F.col("node"), "left").select("id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("root"))
    least = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "th")).alias("least"))
    many = placed.filter("root IS NOT NULL").join(least, "root").select("id", "th", "n", F.col("least.id").alias("component"), "root", (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("th") == F.col("least.th"))).alias("first"))
    alone = placed.filter("root IS NULL").select("id", "th", "n", F.col("id").alias("component"), "root", F.lit(True).alias("first"))
    named = [F.col(c).alias(name) for c, name in (("root", group_col), ("first", first_col)) if name]
    return many.union(alone).select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), *named)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of key, by which the batches are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if not len(k):
            continue
        for i, j in zip([0, *cuts(k)], [*cuts(k), len(k)], strict=True):
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != k[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def cuts(k: np.ndarray) -> list[int]:
    return (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    """Links, the smaller id (unsigned) first."""
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    less = x.view(np.uint64) < y.view(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(np.where(less, x, y)), pa.array(np.where(less, y, x))], names=["a", "b"])


def _partners(n: np.ndarray, now: np.ndarray, first: np.ndarray, within: bool, cards: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(u, others): for the records of one block those of the other, or of all `within` one, that sizes and sketches (of one length) let link, across components as `now` has them when asked."""
    order = np.argsort(n, kind="stable")
    theirs = order if within else order[~first[order]]
    lengths = n[theirs]
    for place, u in enumerate(theirs.tolist() if within else np.flatnonzero(first).tolist()):
        lo = place + 1 if within else int(np.searchsorted(lengths, -(-n[u] * percent // 100)))
        v = theirs[lo : int(np.searchsorted(lengths, n[u] * 100 // percent, "right"))]
        v = v[now[v] != now[u]]
        if len(v):
            v = v[_may_link(n[u], n[v], (cards[v] != cards[u]).sum(1), percent)]
            if len(v):
                yield u, v


def _spanning(sid: np.ndarray, root: np.ndarray, first: np.ndarray, within: bool, sets: list[np.ndarray], percent: int) -> pa.RecordBatch:
    """Links that join the components of records of two blocks, or `within` one; pairs that are together by then aren't compared."""
    n = np.array([len(x) for x in sets], np.int64)
    # Sketches of one length for all, from the numbers that stand for shingles here.
    k = max(3, int(n.min()).bit_length() - 1)
    cards = np.zeros((len(sets), 1 << k), np.uint8)
    for i, x in enumerate(sets):
        h = mix(x.view(np.uint64))
        cards[i] = np.bincount((h >> _U(64 - k)).astype(np.int64), weights=((h & _U(255)) | _U(1)).astype(np.float64), minlength=1 << k).astype(np.int64).astype(np.uint8)
    now = root.copy()
    out: tuple[list[int], list[int]] = ([], [])
    for u, others in _partners(n, now, first, within, cards, percent):
        for w in others.tolist():
            x, y = now[u], now[w]
            if x != y and (100 + percent) * _shared(sets[u], sets[w]) >= percent * (n[u] + n[w]):
                now[now == max(x, y)] = min(x, y)
                out[0].append(int(sid[u]))
                out[1].append(int(sid[w]))
    return _pairs(*out)
