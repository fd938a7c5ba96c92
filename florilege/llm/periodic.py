"""Runs of words that repeat with a period, found on a harmonic grid by common extensions of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, utf8, whole
from .words import SPACED, bounds, hashes

#: Text taken at a time; a longer document stands alone.
PIECE_BYTES = 4 << 20


class Extensions:
    """Longest common extensions within a sequence of numbers: its suffix array, common prefixes of neighbours in it, and their minima over ranges.

    The suffixes are sorted by doubling: a level's ranks order stretches of twice the length of the level before. About 200 bytes are held for each number.
    """

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.n = n
        rank = np.unique(s, return_inverse=True)[1].astype(np.int32)
        levels = [rank]
        while n and rank.max() < n - 1:
            step = 1 << (len(levels) - 1)
            key = rank.astype(np.int64) * (n + 1)
            key[: max(0, n - step)] += rank[step:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
            levels.append(rank)
        self.rank = rank
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        i, j, common = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(max(0, n - 1), np.int32)
        for k in range(len(levels) - 2, -1, -1):  # the last level tells all suffixes apart
            level, step = levels[k], 1 << k
            same = (i < n) & (j < n)
            same[same] = level[i[same]] == level[j[same]]
            i[same] += step
            j[same] += step
            common[same] += step
        del levels
        self.least = [common]
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j on are equal; i and j differ."""
        a, b = np.minimum(self.rank[i], self.rank[j]).astype(np.int64), np.maximum(self.rank[i], self.rank[j]).astype(np.int64)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.least[k][a[at]], self.least[k][b[at] - (1 << k)])
        return out


def grid(codes: np.ndarray, row: np.ndarray, longest: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the grid where a run may lie: multiples of the period from which `exponent` places, a period apart and in one row, are equal.

    A run of at least `exponent` periods has such a place. The places of all periods number n * (1 + 1/2 + 1/3 + ...).
    """
    places, periods = [], []
    for p in range(1, longest // exponent + 1):
        c = codes[::p]
        same = c[1:] == c[:-1]
        hit = same[: len(same) - exponent + 2].copy()
        for k in range(1, exponent - 1):
            hit &= same[k : len(same) - exponent + 2 + k]
        at = np.flatnonzero(hit) * p
        at = at[row[at] == row[at + (exponent - 1) * p]] if len(at) else at
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), p))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(places or none), np.concatenate(periods or none)


def runs_of(rows: list[list[bytes]], place: np.ndarray, period: np.ndarray, length: int, exponent: int) -> np.ndarray:
    """(start, length, period), by start and period, of the runs in the concatenated rows that the grid's places touch.

    Each row ends with a number of its own, so that no extension leaves it. From a place and the next one the words are compared
    forward, and backward in the reversed sequence; a stretch found with several periods has the least of them, which divides the others.
    """
    codes: dict[bytes, int] = {}
    sizes = np.array([len(r) for r in rows])
    s = np.fromiter((codes.setdefault(w, len(codes)) for r in rows for w in r), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    s = np.insert(s, ends, len(codes) + np.arange(len(rows)))
    place = place + np.searchsorted(ends, place, "right")  # the numbers at the rows' ends
    forward = Extensions(s).common(place, place + period)
    back = np.zeros(len(place), np.int64)
    inner = place > 0
    last = len(s) - 1
    back[inner] = Extensions(s[::-1]).common(last - (place[inner] - 1), last - (place[inner] + period[inner] - 1))
    start, size = place - back, back + period + forward
    ok = size >= np.maximum(length, exponent * period)
    start, size, period = start[ok], size[ok], period[ok]
    order = np.lexsort((period, size, start))
    start, size, period = start[order], size[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, period = start[fresh], size[fresh], period[fresh]
    order = np.lexsort((period, start))
    start, size, period = start[order], size[order], period[order]
    return np.stack([start - np.searchsorted(ends + np.arange(len(rows)), start, "right"), size, period])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 6, exponent: int = 4, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what ASCII white space separates, counted from 0. A run is a stretch of consecutive words with smallest period q, of at
    least max(length, exponent * q) words (exponent: 2 or more), that no neighbouring word extends keeping q. collapsed: the words that no run
    contains after its first q ones, joined by one space. Places of the grid are chosen by 64-bit hashes of words, which miss no equal
    ones; the runs themselves are told from the words. Documents are worked on where they are read, several at a time.

    Null and empty texts have no words and no runs; null ids and repeated rows are rows like others. Empty tables give empty results. Other columns don't matter.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("_id", src.schema["_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            for a, b in pieces(offsets, piece_bytes):
                yield _piece(batch.column("_id")[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, exponent)

    return src.mapInArrow(find, schema).withColumnRenamed("_id", id_col)


def _piece(ids: pa.Array, raw: np.ndarray, at: np.ndarray, length: int, exponent: int) -> pa.RecordBatch:
    starts, ends = bounds(raw, at, SPACED)
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    place, period = grid(hashes(raw, starts, ends), row, int(n_words.max(initial=0)), exponent)
    texts = [raw[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    touched = np.unique(row[place])
    words = [texts[r].split() for r in touched.tolist()]
    count, found = np.zeros(len(texts), np.int64), np.zeros((3, 0), np.int64)
    drop = np.zeros(int(n_words[touched].sum()) + 1, np.int64)
    base = np.cumsum(n_words[touched]) - n_words[touched]
    if len(touched):
        # The grid's places, counted in the touched rows alone.
        nth = np.searchsorted(touched, row[place])
        found = runs_of(words, place - first[row[place]] + base[nth], period, length, exponent)
        np.add.at(drop, found[0] + found[2], 1)
        np.add.at(drop, found[0] + found[1], -1)
        of = np.searchsorted(base, found[0], "right") - 1
        count[touched] = np.bincount(of, minlength=len(touched))
        found[0] -= base[of]
    kept = np.cumsum(drop) == 0
    collapsed: list[bytes] = [b""] * len(texts)
    for k, r in enumerate(touched.tolist()):
        if count[r]:
            collapsed[r] = b" ".join([w for w, k_ in zip(words[k], kept[base[k] : base[k] + n_words[r]].tolist(), strict=True) if k_])
    for r, t in enumerate(texts):
        if not count[r]:
            collapsed[r] = b" ".join(t.split())
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), runs)
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["_id", "n_words", "runs", "collapsed"])
