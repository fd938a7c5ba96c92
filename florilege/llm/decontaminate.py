"""Benchmark decontamination: a positional inverted index of the corpus, asked for the windows of the benchmark's items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, stash, utf8, whole
from .words import LETTERED, LOWER, bounds, hashes, ranges

#: Text in a segment of the index; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
#: Words of items that are broadcast at a time (8 bytes each, and their order).
PART_WORDS = 1 << 20
#: Words of an item that stay together; longer items are cut with an overlap of a window.
CHUNK_WORDS = 4096
#: Postings intersected at a time.
_MOST = 1 << 20


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of every word of every whole text, a stored table with a row for each segment of documents.

    segment: its key; ids and n_words: its documents, in order; terms: the 64-bit hashes of its different words, ascending;
    positions: where each term stands, ascending, counted in words from the segment's begin; at: where each term's postings begin
    in positions (numpy arrays as bytes). Texts are lower-cased (A-Z); words are runs of letters a-z, digits and characters beyond
    ASCII. A segment is made where its documents are read: no posting is shuffled, so neither a frequent word nor a long list is
    a task's burden, and the table can be asked again for other items.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    fields = [("segment", T.LongType()), ("ids", T.ArrayType(src.schema["_id"].dataType)), ("n_words", T.ArrayType(T.LongType())), ("terms", T.BinaryType()), ("at", T.BinaryType()), ("positions", T.BinaryType())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            ids = batch.column("_id")
            for a, b in pieces(offsets, segment_bytes):
                text, rows = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends = bounds(text, rows, LETTERED)
                words = hashes(text, starts, ends)
                order = np.argsort(words, kind="stable")
                words = words[order]
                first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
                n_words = np.diff(np.searchsorted(starts, rows))
                kinds = [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids[a:b]), pa.array([n_words], pa.list_(pa.int64()))]
                lists = (words[first], np.append(first, len(words)).astype(np.int32), order.astype(np.int32))
                yield pa.RecordBatch.from_arrays(kinds + [pa.array([x.tobytes()], pa.binary()) for x in lists], names=[f for f, _ in fields])
                key += 1

    schema = T.StructType([T.StructField(name, kind) for name, kind in fields])
    return stash(src.mapInArrow(build, schema), "positions", options={"parquet.block.size": str(16 << 20)})


def documents(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(segment, place, id, n_words): the documents of an index; the postings aren't read."""
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("place", "_d"))
    return rows.select("segment", "place", F.col("_d.ids").alias(id_col), F.col("_d.n_words").alias("n_words"))


@dataclass
class Windows:
    """What a part of the items asks for: their words' terms, and the windows as (first word, length)."""

    terms: np.ndarray  # different hashes, ascending
    word: np.ndarray  # of each word its term
    item: np.ndarray  # of each word its item
    first: np.ndarray  # of each word the first word of its item
    last: np.ndarray  # of each word the last word of its item
    start: np.ndarray  # of each window its first word
    length: np.ndarray  # of each window
    names: list[str]  # of each item

    @classmethod
    def of(cls, names: list[str], texts: list[np.ndarray], window: int) -> Windows:
        sizes = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        terms, word = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]), return_inverse=True)
        count = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        return cls(terms, word, np.repeat(np.arange(len(names)), sizes), np.repeat(begin, sizes), np.repeat(begin + sizes - 1, sizes), ranges(begin, count), np.repeat(np.minimum(sizes, window), count), names)


class Segment:
    """The postings of a segment for the terms of `asked`, and the intersection of their lists."""

    def __init__(self, asked: Windows, n_words: np.ndarray, terms: np.ndarray, at: np.ndarray, positions: np.ndarray):
        self.asked, self.n, self.rows = asked, len(positions), np.append(0, np.cumsum(n_words))
        place = np.searchsorted(terms, asked.terms)
        here = terms[np.minimum(place, max(0, len(terms) - 1))] == asked.terms if len(terms) else np.zeros(len(asked.terms), bool)
        place = np.where(here, place, 0)
        self.often = np.where(here, at[place + 1] - at[place], 0).astype(np.int64) if len(terms) else np.zeros(len(asked.terms), np.int64)
        # A term that isn't here has no list, and a window with such a term no occurrence.
        gone = np.append(0, np.cumsum(self.often[asked.word] == 0))
        self.live = np.flatnonzero(gone[asked.start + asked.length] == gone[asked.start])
        used = np.unique(asked.word[ranges(asked.start[self.live], asked.length[self.live])]) if len(self.live) else np.zeros(0, np.int64)
        sizes = self.often[used]
        self.begin = np.zeros(len(asked.terms), np.int64)
        self.begin[used] = np.cumsum(sizes) - sizes
        # Lists one after the other as single numbers: the term, then the position.
        self.keys = np.repeat(used, sizes) * self.n + positions[ranges(at[place[used]].astype(np.int64), sizes)] if len(used) else np.zeros(0, np.int64)

    def near(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands somewhere from low to high."""
        found = np.searchsorted(self.keys, term * self.n + low)
        return (low <= high) & (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] <= term * self.n + high)

    def starts(self, slop: int) -> np.ndarray:
        """(window, start, document), each different one once, as rows of an array: places from which each word of the window stands where it should, or up to `slop` words off.

        Each window is led by the list of its rarest term here, shared with the windows around it that have the same one; a
        place whose neighbours both fail is dropped, and the others meet the lists of the window's terms, rarest first.
        """
        q, out = self.asked, []
        if not len(self.live):
            return np.zeros((3, 0), np.int64)
        width = int(q.length[self.live].max())
        offset = np.arange(width)
        words = np.minimum(q.start[self.live][:, None] + offset, len(q.word) - 1)
        often = np.where(offset < q.length[self.live][:, None], self.often[q.word[words]], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        lead = q.start[self.live] + order[:, 0]
        by = np.argsort(lead, kind="stable")
        leads, first = np.unique(lead[by], return_index=True)
        n_windows = np.diff(np.append(first, len(by)))
        sizes = self.often[q.word[leads]] * (2 * slop + 1)
        for a, b in pieces(np.append(0, np.cumsum(sizes)), _MOST):
            each = self.often[q.word[leads[a:b]]]
            k = np.repeat(np.arange(a, b), each)
            at = self.keys[ranges(self.begin[q.word[leads[a:b]]], each)] - q.word[leads[k]] * self.n
            row = np.searchsorted(self.rows, at, "right") - 1
            if slop:
                k, row = np.repeat(k, 2 * slop + 1), np.repeat(row, 2 * slop + 1)
                at = (at[:, None] + np.arange(-slop, slop + 1)).ravel()
            fits = lambda word, want, row: self.near(q.word[word], np.maximum(want - slop, self.rows[row]), np.minimum(want + slop, self.rows[row + 1] - 1))
            w = leads[k]
            beside = q.first[w] == q.last[w]
            for step, edge in ((1, q.last), (-1, q.first)):
                there = w != edge[w]
                beside[there] |= fits(w[there] + step, at[there] + step, row[there])
            k, at, row = k[beside], at[beside], row[beside]
            many = n_windows[k]
            win = by[ranges(first[k], many)]
            start = np.repeat(at - leads[k], many) + q.start[self.live[win]]
            row = np.repeat(row, many)
            for nth in range(width):
                off = order[win, nth]
                short = nth >= q.length[self.live[win]]
                ok = short | fits(np.minimum(q.start[self.live[win]] + off, len(q.word) - 1), start + off, row)
                win, start, row = win[ok], start[ok], row[ok]
            out.append(np.stack([self.live[win], start, row]))
        return np.unique(np.concatenate(out, axis=1), axis=1)


def _words_of(items: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    """(name, words): the hashed words of items, long ones in chunks that overlap by a window; each different row once."""
    src = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"), whole(F.col(f"`{text_col}`")).alias("_text")).distinct()
    step = max(CHUNK_WORDS, 2 * window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            raw = LOWER[raw]
            starts, ends = bounds(raw, offsets, LETTERED)
            words, at = hashes(raw, starts, ends), np.searchsorted(starts, offsets)
            rows = [(name, words[i : min(b, i + step + window - 1)].tobytes()) for name, a, b in zip(batch.column("name").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True) for i in range(a, max(a + 1, b - window + 1), step) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["name", "words"])

    return stash(src.mapInArrow(cut, "name string, words binary"), "items")


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", window: int = 10, slop: int = 0, part_words: int = PART_WORDS) -> DataFrame:
    """(segment, place, spans, items, near): a row for each document of the index in which something occurs.

    A window is `window` consecutive words of an item; an item of fewer words is one window. spans: the stretches (start, stop; stop
    exclusive, in words) that exact occurrences cover, touching ones as one; items: the ids, as sorted strings, of items with an
    exact occurrence; near: those with a start from which every word of some window stands at most `slop` words from its place, exact
    ones included (empty with slop 0). A null id counts as the empty string, a null text as one without words; items without
    words occur nowhere; rows with one id count as one item. Words are told apart by 64-bit hashes.

    The items are broadcast in parts of about `part_words` words, each asked of all segments in a job's pass of its own.
    """
    words = _words_of(items, item_id, text_col, window)
    total = words.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    parts = max(1, -(-int(total) // part_words))
    words = words.withColumn("_part", F.pmod(F.xxhash64("name", "words"), F.lit(parts)))
    schema = "segment long, place int, spans array<struct<start: long, stop: long>>, items array<string>, near array<string>"
    found = None
    for part in range(parts):
        table = words.filter(F.col("_part") == part).select("name", "words").toArrow()
        asked = Windows.of(table["name"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()], window)
        held = index.sparkSession.sparkContext.broadcast(asked)

        def ask(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked = held.value
            for batch in batches:
                for key, n_words, terms, at, positions in zip(*(batch.column(c).to_pylist() for c in ("segment", "n_words", "terms", "at", "positions")), strict=True):
                    segment = Segment(asked, np.array(n_words, np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(at, np.int32), np.frombuffer(positions, np.int32))
                    rows = _rows(segment, slop)
                    if rows:
                        yield pa.RecordBatch.from_pylist([{"segment": key} | r for r in rows], schema=_ARROW)

        hits = index.select("segment", "n_words", "terms", "at", "positions").mapInArrow(ask, schema)
        found = hits if found is None else found.unionByName(hits)
    found = stash(found, "hits")
    if parts > 1:
        joined = F.expr(
            """aggregate(array_sort(flatten(collect_list(spans))), cast(array() AS array<struct<start: bigint, stop: bigint>>), (done, x) ->
              CASE WHEN size(done) > 0 AND element_at(done, -1).stop >= x.start THEN concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, x.stop))))
                ELSE concat(done, array(x)) END)"""
        )
        names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        found = found.groupBy("segment", "place").agg(joined.alias("spans"), names("items").alias("items"), names("near").alias("near"))
    return found


_ARROW = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def _rows(segment: Segment, slop: int) -> list[dict]:
    """What occurs in each document of a segment."""
    q = segment.asked
    window, start, place = segment.starts(0)
    out: dict[int, dict] = {}
    row = lambda p: out.setdefault(p, {"place": p, "spans": [], "items": set(), "near": set()})
    for p, i in np.unique(np.stack([place, q.item[q.start[window]]]), axis=1).T.tolist() if len(window) else ():
        row(p)["items"].add(q.names[i])
    if slop:
        close, _, by = segment.starts(slop)
        for p, i in np.unique(np.stack([by, q.item[q.start[close]]]), axis=1).T.tolist() if len(close) else ():
            row(p)["near"].add(q.names[i])
    if len(window):
        edge = np.zeros(segment.n + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + q.length[window], -1)
        covered = np.cumsum(edge[:-1]) > 0
        inner = segment.rows[1:-1]
        fresh = np.concatenate([[True], ~covered[:-1]])
        fresh[inner[inner < segment.n]] = True
        begins = np.flatnonzero(covered & fresh)
        ends = np.flatnonzero(np.concatenate([covered[:-1] & (~covered[1:] | fresh[1:]), covered[-1:]])) + 1
        for p, a, b in zip((np.searchsorted(segment.rows, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            base = int(segment.rows[p])
            row(p)["spans"].append({"start": a - base, "stop": b - base})
    return [r | {"items": sorted(r["items"], key=str.encode), "near": sorted(r["near"], key=str.encode)} for r in out.values()]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 0, segment_bytes: int = SEGMENT_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words in an exact occurrence of a window), spans, items and near of search(), contaminated (n_hit > 0).

    Null and empty texts have no words; null ids and repeated rows are rows like others; an empty table of documents gives an
    empty result, an empty one of items no hits. Other columns of either table don't matter, whatever their names.
    """
    index = build_index(docs, id_col, text_col, segment_bytes)
    found = search(index, items, item_id, item_text, window, slop, part_words)
    rows = documents(index, "_id").join(found, ["segment", "place"], "left")
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start: bigint, stop: bigint>>")), F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    none = F.array().cast("array<string>")
    return rows.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start: bigint, stop: bigint>>")).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"), (n_hit > 0).alias("contaminated"))
