"""Byte-level BPE by recursive queries of an embedded DuckDB in each task."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, utf8

#: A byte b is written as the character 256 + b, so that byte strings of any content are text to SQL.
_SHIFT = 256

#: Contract the leftmost pair of least rank of every word, until no word has a pair that the merge table knows. Words that
#: still change go on to the next round; a word's tokens are the rows of its last round. A token's id is its rank.
#: A row holds its position, that of the next token, and the pair of its id and the next token's in one integer, 24 bits for
#: each id (all ones: no next token). A round finds each word's best pair by rank and then by place; its left row takes the
#: merged id and what the right row says of its next token, the row before it takes the merged id as its next, and the
#: right row goes. Positions have 19 bits.
_MERGE = """
WITH RECURSIVE step AS (
  SELECT 0 AS round, word, pos, pos + 1 AS next, (id << 24) + coalesce(lead(id) OVER (PARTITION BY word ORDER BY pos), 16777215) AS pair FROM symbols
  UNION ALL
  SELECT round + 1, s.word, pos, CASE WHEN pos = spot THEN beyond ELSE next END,
    CASE WHEN pos = spot THEN (merged << 24) + beyond_id WHEN next = spot THEN (pair >> 24 << 24) + merged ELSE pair END
  FROM step AS s JOIN (
    SELECT p.word, best >> 38 AS merged, (best >> 19) & 524287 AS spot, r.pos AS gone, r.next AS beyond, r.pair & 16777215 AS beyond_id
    FROM (SELECT word, min((merged << 38) + (pos << 19) + next) AS best FROM step JOIN merges USING (pair) GROUP BY word) AS p
    JOIN step AS r ON r.word = p.word AND r.pos = best & 524287
  ) AS b ON b.word = s.word
  WHERE pos != gone
)
SELECT word, pos, pair >> 24 AS id FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) AS ended USING (word, round) ORDER BY word, pos
"""
#: Rows that a run of the recursion makes at most, all rounds together (a word of n bytes makes up to n (n + 1) / 2).
_ROWS = 1_500_000
#: Tokens that a run of the ordered aggregation takes at most; a longer list is decoded range by range.
_TOKENS = 400_000
_DECODE = "SELECT row, array_to_string(list(token ORDER BY pos), '') AS text FROM ids JOIN vocabulary ON vocabulary.rank = ids.id GROUP BY row"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _text(token: bytes) -> str:
    return "".join(chr(_SHIFT + b) for b in token)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text.

    Texts of Latin-1 characters alone take the standard library's faster engine, where the pattern has no escapes but classes
    of letters, numbers and white space; these are spelt out for the 256 characters, so that both engines find the same.
    """
    import regex

    full = regex.compile(pattern).findall
    members = {e: "".join(f"\\x{i:02x}" for i in range(256) if regex.fullmatch(e, chr(i))) for e in (r"\p{L}", r"\p{N}", r"\s")}
    plain = re.sub(r"\[[^\]]*\]", lambda c: re.sub(r"\\p\{[LN]\}|\\s", lambda e: members[e[0]], c[0]), pattern)
    plain = re.sub(r"\\p\{[LN]\}|\\s", lambda e: f"[{members[e[0]]}]", plain).replace(r"\S", f"[^{members[r'\s']}]")
    if re.search(r"\\(?!x[0-9a-f]{2})|\(\?(?!!)|[*+?}]\+", plain) or not pattern.isascii():
        return full
    latin = re.compile(plain).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return latin(text)

    return split


class Codec:
    """Encoder and decoder of one task's process.

    memory: about 2 x `cache` words keep their ids, the rest are encoded anew; DuckDB gets `memory` and one thread, which is
    enough for runs of _ROWS rows or _TOKENS tokens. A word whose recursion alone makes more than _ROWS rows (one of over
    1,731 bytes) takes the same merges from a heap instead: the recursion's work grows with the square of a word's length.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 280_000, memory: str = "300MB"):
        import duckdb

        if max(ranks.values(), default=0) >= (1 << 24) - 1:
            raise ValueError("ranks have 24 bits")
        self.ranks, self.most = ranks, cache
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.known = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.known[list(ranks.values())] = True
        self.split = splitter(pattern)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:")
        for k, v in (("threads", "1"), ("memory_limit", f"'{memory}'"), ("temp_directory", "''")):
            self.db.execute(f"SET {k} = {v}")
        pairs = [(left, right, merged) for token, merged in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
        a, b, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self._keep("vocabulary", {"token": [_text(t) for t in ranks], "rank": pa.array(list(ranks.values()), pa.int64())})
        self._keep("merges", {"pair": (a << 24) + b, "merged": merged})

    def _keep(self, name: str, columns: dict) -> None:
        self.db.register("loaded", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def _ask(self, query: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words into the cache."""
        known, short = {}, []
        for w in words:
            raw = w.encode("utf-8", "replace")
            if (whole := self.packed.get(raw)) is not None:
                known[w] = whole
            elif len(raw) * (len(raw) + 1) // 2 > _ROWS:
                known[w] = np.array(self._heap(raw), np.int32).tobytes()
            else:
                short.append((w, raw))
        short.sort(key=lambda x: len(x[1]))  # words of like length end in like rounds
        sizes = np.array([len(raw) for _, raw in short], np.int64)
        for at, end in pieces(np.concatenate(([0], np.cumsum(sizes * (sizes + 1) // 2))), _ROWS):
            run, n = short[at:end], sizes[at:end]
            word = np.repeat(np.arange(len(run)), n)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
            first = self.bytes[np.frombuffer(b"".join(raw for _, raw in run), np.uint8)]
            got = self._ask(_MERGE, "symbols", {"word": word, "pos": pos, "id": first})
            ids = got["id"].to_numpy().astype(np.int32)
            ends = np.cumsum(np.bincount(got["word"].to_numpy(), minlength=len(run)))
            at_byte, data = (ends * 4).tolist(), ids.tobytes()
            for (w, _), a, b in zip(run, [0, *at_byte], at_byte, strict=False):
                known[w] = data[a:b]
        self.cache |= known

    def _heap(self, raw: bytes) -> list[int]:
        """Merges of one long word: a heap of pairs over linked positions, stale entries skipped."""
        n = len(raw)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, rank = [True] * n, self.ranks.get
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := rank(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [self.ranks[raw[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """ids of each text."""
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        if len(self.cache) > self.most:  # words seen since the last turn survive, others go
            self.old, self.cache = self.cache, {}
        fresh = words - self.cache.keys()
        if self.old:
            again = fresh & self.old.keys()
            self.cache |= {w: self.old[w] for w in again}
            fresh -= again
        self._learn(list(fresh))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids. An id that the vocabulary lacks raises KeyError."""
        n = np.array([len(x) for x in ids], np.int64)
        if not n.sum():
            return [b""] * len(ids)
        row, flat = np.repeat(np.arange(len(ids)), n), np.concatenate(ids)
        bad = (flat < 0) | (flat >= len(self.known))
        bad[~bad] = ~self.known[flat[~bad]]
        if bad.any():
            raise KeyError(int(flat[bad][0]))
        out: list[list[bytes]] = [[] for _ in ids]
        for at in range(0, len(flat), _TOKENS):
            part = slice(at, at + _TOKENS)
            got = self._ask(_DECODE, "ids", {"row": row[part], "pos": np.arange(len(flat[part])), "id": flat[part]})
            for r, t in zip(got["row"].to_pylist(), got["text"].to_pylist(), strict=True):
                out[r].append(t.encode("utf-16-le")[::2])
        return [b"".join(parts) for parts in out]


_codecs: dict[tuple, Codec] = {}


def _codec(key: tuple, ranks: dict[bytes, int], pattern: str) -> Codec:
    """The codec of this worker process; later tasks in it find its words cached."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>): the tokens of each whole text by the rank file, no special tokens.

    Each match of `pattern` is encoded separately. Words that repeat are encoded once in a worker. A map over
    Arrow batches: no shuffle, so no key can be hot; the rank file is read by the driver and broadcast (its size is fixed).
    Null or empty text has no ids; the text of a special token is ordinary text; null ids, repeated rows and other columns
    pass or don't matter. An empty table gives an empty result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))
    key = (rank_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or _codec(key, ranks.value, pattern)
            _, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets, 2 << 20):
                part = batch.slice(a, b - a)
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in `keep`, decoded (binary): the bytes of each list of ids, by an ordered aggregation over token positions.

    A null or empty list gives empty bytes; an id that the vocabulary lacks is an error, as it is for the encoder's library.
    """
    ranks = tokens.sparkSession.sparkContext.broadcast(load_ranks(rank_file))
    key = (rank_file, r"\S+|\s+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = next(iter(_codecs.values())) if _codecs and next(iter(_codecs))[0] == rank_file else None
        for batch in batches:
            codec = codec or _codec(key, ranks.value, key[1])
            lists = batch.column(batch.schema.get_field_index(ids_col))
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            if lists.null_count:
                sizes[~lists.is_valid().to_numpy(zero_copy_only=False)] = 0
            for a, b in pieces(offsets, _TOKENS):
                decoded = codec.decode([flat[offsets[i] : offsets[i] + sizes[i]] for i in range(a, b)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), pa.array(decoded, pa.binary())], names=[*(part.schema.names[i] for i in others), "decoded"])

    columns = [id_col, *keep]
    base = tokens.select(*columns, *([] if ids_col in columns else [ids_col]))
    others = [base.columns.index(c) for c in columns]
    kinds = dict(base.dtypes)
    return base.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", decoded binary")
