"""Similarity measures: expressions where Spark has what they need, pandas UDFs (Arrow batches) where it hasn't."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import once, words


def sequence_ratio(query: Column, reference: Column, autojunk: bool = True) -> Column:
    """M1: 2 * matches / total length of the longest matching blocks. Not symmetric; query first. With autojunk, characters
    frequent in a reference of 200 or more anchor nothing: pass False for long passages. Null or empty counts 0."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y, autojunk).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])

    return ratio(query, reference)


def places_of(text: str) -> dict[str, int]:
    """The places of each character of a text, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(places: dict[str, int], n: int, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence of b and a text of n characters, given by its places; -1 once it can't reach `least`.

    One of `least` characters leaves n - least of the text out at most, so the first characters of b meet no more than so many places beyond their own.
    """
    full = free = (1 << n) - 1
    for done in range(16, len(b) + 16, 16):
        for held in map(places.get, b[done - 16 : done], repeat(0)):
            if held := held & free:
                free = free + held | free - held  # bits over n are carried along unread
        free &= full
        if done < len(b):
            near = min(n, done + max(0, n - least))
            if near - (free & (1 << near) - 1).bit_count() + len(b) - done < least:
                return -1
    return n - free.bit_count()


_BINS = 64


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, counts of characters in bins) of texts."""
    length = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % _BINS
    row = np.repeat(np.arange(len(texts)), length)
    return length, np.bincount(row * _BINS + codes, minlength=len(texts) * _BINS).reshape(len(texts), _BINS).astype(np.int32)


#: Characters of the grams that long texts are looked up by, bits of their table, pairs aligned together, characters of texts that are aligned so, pairs of all queries and texts at hand.
_GRAM, _TABLE, _PAIRS, _WIDE, _MOST = 8, 20, 4096, 1024, 4_000_000


def _grams(codes: np.ndarray) -> np.ndarray:
    """Places in the table of the grams that begin at each code point."""
    x = codes * np.uint32(0x9E3779B1)
    for step, factor in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F)):
        x = x[:-step] * np.uint32(factor) + (x[step:] ^ x[step:] >> np.uint32(15)) if len(x) > step else x[:0]
    return x >> np.uint32(32 - _TABLE)


class Near:
    """A part of the texts, by length, to be asked which of them have at least a ratio (M1) of `threshold` with queries that they don't contain."""

    def __init__(self, texts: list[str], threshold: float, least_word: int):
        self.order = np.argsort([len(t) for t in texts], kind="stable")
        self.texts, self.threshold, self.least_word = [texts[i] for i in self.order.tolist()], threshold, least_word
        self.length, self.letters = _letters(self.texts)
        self.words = [self._kinds(t) for t in self.texts]
        # The blocks of M1 with a text of 200 or more characters: each but the first holds a character that is rare there (autojunk).
        self.blocks = [1 + sum(k for k in Counter(t).values() if k <= len(t) // 100 + 1) if len(t) >= 200 else 0 for t in self.texts]
        self.held = np.zeros(1 << _TABLE, bool)
        for text in self.texts:
            if len(text) >= 200:
                self.held[_grams(_codes(text))] = True
        n = int(np.searchsorted(self.length, _WIDE, "right"))  # the places of each letter, as bits of 64 characters, a last letter without any
        self.places = np.zeros((-(-int(self.length[n - 1]) // 64) if n else 0, n * (_BINS + 1)), np.uint64)
        codes = _codes("".join(self.texts[:n]))
        row = np.repeat(np.arange(n), self.length[:n])
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.length[:n]) - self.length[:n], self.length[:n])
        np.bitwise_or.at(self.places, (at // 64, row * (_BINS + 1) + codes % _BINS), np.uint64(1) << (at % 64).astype(np.uint64))

    def _kinds(self, text: str) -> frozenset[str]:
        return frozenset(w for w in text.split() if len(w) >= self.least_word)

    def of(self, queries: list[str]) -> list[tuple[int, int, float]]:
        """(query, text, ratio). The ratio counts characters in common order, so that it is bounded by the lengths, by the letters that both have wherever
        they stand, and by the longest common subsequence. It counts them in blocks; where a text allows few, whole grams are in common."""
        t, out = self.threshold, []
        length, letters = _letters(queries)
        by = np.argsort(length, kind="stable")
        n = length[by]
        kind = np.uint16 if max(length.max(initial=0), self.length.max(initial=0)) < 1 << 15 else np.int32
        counts = np.ascontiguousarray(letters[by].T.astype(kind))
        codes = _codes("".join(queries))
        ends = np.cumsum(length)
        grams = np.zeros(len(codes) + 1, np.int64)
        found = self.held[_grams(codes)]
        np.cumsum(found, out=grams[1 : len(found) + 1])
        grams = (grams[np.maximum(ends - length, ends - _GRAM + 1)] - grams[ends - length])[by]
        low, high = np.searchsorted(n, np.ceil(self.length * t / (2 - t) - 1e-9)), np.searchsorted(n, np.floor(self.length * (2 - t) / t + 1e-9) + 1)
        which, rows = [], []
        for k in np.flatnonzero(low < high).tolist():
            at = slice(low[k], high[k])
            if self.blocks[k]:
                need = t * (n[at] + self.length[k]) / 2 - 1e-9 - self.blocks[k] * (_GRAM - 1)
                at = np.flatnonzero(grams[at] >= need) + low[k]
                if not len(at):
                    continue
            some = np.flatnonzero(self.letters[k])
            shared = np.minimum(counts[some, at] if isinstance(at, slice) else counts[some[:, None], at], self.letters[k, some, None].astype(kind)).sum(axis=0, dtype=kind)
            close = by[at][2 * shared.astype(np.int64) >= t * (n[at] + self.length[k]) - 1e-9]
            which.append(np.full(len(close), k))
            rows.append(close)
        if not sum(map(len, which)):
            return out
        which, rows = np.concatenate(which), np.concatenate(rows)
        letter = np.append((codes % _BINS).astype(np.uint8), np.uint8(_BINS))
        aligned = [self._aligned(which[i : i + _PAIRS], rows[i : i + _PAIRS], letter, ends - length, length) for i in range(0, len(which), _PAIRS)]
        places, last, kinds = {}, -1, None
        for i in np.concatenate(aligned).nonzero()[0].tolist():
            k, row = int(which[i]), int(rows[i])
            query, text = queries[row], self.texts[k]
            if row != last:
                last, places, kinds = row, places_of(query), self._kinds(query) if self.least_word else None
            if kinds is not None and kinds.isdisjoint(self.words[k]) or query in text:
                continue
            need = t * (len(query) + len(text)) / 2 - 1e-9
            if common_subsequence(places, len(query), text, int(np.ceil(need))) < need:
                continue
            ratio = SequenceMatcher(None, query, text).ratio()
            if ratio >= t:
                out.append((row, int(self.order[k]), ratio))
        return out

    def _aligned(self, which: np.ndarray, rows: np.ndarray, letter: np.ndarray, begins: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether a common subsequence of the letters of each pair of text and query may have the length asked for: common_subsequence() of all pairs at once.

        A text's characters enter, 64 at a time, when they come in reach of the query's.
        """
        out = np.ones(len(which), bool)
        pair = np.flatnonzero(self.length[which] <= _WIDE)
        if not len(pair):
            return out
        one = np.uint64(1)
        m, n, begin, base = self.length[which[pair]], length[rows[pair]], begins[rows[pair]], which[pair] * (_BINS + 1)
        least = np.ceil(self.threshold * (n + m) / 2 - 1e-9).astype(np.int64)
        free = np.full((-(-int(m.max()) // 64), len(pair)), ~np.uint64(0))
        done = 0
        while len(pair) and done < n.max():
            step = np.arange(done, done + 16)[:, None]
            now = base + np.where(step < n, letter[np.minimum(begin + step, len(letter) - 1)], _BINS)
            done += 16
            near = np.minimum(m, done + np.maximum(0, m - least))
            words = -(-int(near.max()) // 64)
            for x in now:
                carry = None
                for w in range(words):
                    held = self.places[w][x]
                    held &= free[w]
                    total = free[w] + held
                    over = total < held
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    free[w] ^= held
                    free[w] |= total
                    carry = over.astype(np.uint64)
            matched = near.copy()
            for w in range(words):
                bits = np.clip(near - 64 * w, 0, 64)
                mask = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
                matched -= np.bitwise_count(free[w] & mask)
            stays = matched + np.maximum(0, n - done) >= least
            if not stays.all():
                out[pair[~stays]] = False
                free = free[:, stays]
                pair, m, n, begin, base, least = (v[stays] for v in (pair, m, n, begin, base, least))
        return out


def near_texts(queries: DataFrame, query: str, texts: DataFrame, text_id: str, text: str, threshold: float, least_word: int = 0, part_rows: int = 10_000) -> DataFrame:
    """(query, text id, ratio) with a ratio (M1, query first) of at least `threshold`, of pairs where the text doesn't contain the query and, with least_word, that share a word of so many characters.

    The texts, a corpus to be asked about, are broadcast in parts of about `part_rows` by length; each part is asked for all queries, in a pass of its own, and pairs
    are made only where the ratio is reached. Null and empty sides have no pairs.
    """
    t = texts.select(text_id, text).filter(F.length(text) > 0)
    n_rows, n_bytes, least, most = t.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.min(F.length(text)), F.max(F.length(text))).first()
    q = queries.select(query).filter(F.length(query).between(max(1, int((least or 0) * threshold / (2 - threshold) - 1e-9)), int((most or 0) * (2 - threshold) / threshold + 1)))
    parts = max(1, -(-n_rows // part_rows), -(-n_bytes // (4 << 20)))
    schema = T.StructType([q.schema[query], t.schema[text_id], T.StructField("ratio", T.DoubleType())])
    found = None
    for part in range(parts):
        held = t.filter(F.pmod(F.xxhash64(text), F.lit(parts)) == part).toArrow()
        asked = q.sparkSession.sparkContext.broadcast((held[text_id].combine_chunks(), Near(held[text].to_pylist(), threshold, least_word)))

        def ask(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, near = asked.value
            for batch in batches:
                rows, step = batch.column(0).to_pylist(), max(256, _MOST // max(1, len(ids)))
                hits = [(a + i, k, r) for a in range(0, len(rows), step) for i, k, r in near.of(rows[a : a + step])]
                if hits:
                    at, which, ratios = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.take(pa.array(which)), pa.array(ratios, pa.float64())], names=[query, text_id, "ratio"])

        made = q.mapInArrow(ask, schema)
        found = made if found is None else found.unionByName(made)
    return found


def _each(rows: Iterator[tuple[str | None, str | None]], prepare, measure) -> pd.Series:
    """measure(query, prepare(candidate)) of rows, 0 where either is null or empty; a candidate is prepared once for the rows of it that follow one another."""
    out, last, held = [], None, None
    for a, b in rows:
        if b and b != last:
            last, held = b, prepare(b)
        out.append(measure(a, held) if a and b else 0.0)
    return pd.Series(out, dtype="float64")


_SEPARATE = re.compile(r"[\x1c-\x1f]")
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    """Python takes four separators as blanks that Unicode, and words() with it, doesn't."""
    return [w for w in _BLANKS.split(text) if w] if _SEPARATE.search(text) else text.split()


def ngram_jaccard(a: Column, b: Column, weights: tuple[tuple[int, float], ...] = ((2, 0.3), (3, 0.4), (4, 0.3))) -> Column:
    """M3: weighted Jaccard of word n-grams over the n for which the union isn't empty; a shorter text is its own n-gram. The n-grams of b are made once for the rows that follow one another."""

    def grams(text: str) -> list[set[tuple[str, ...]]]:
        w = split_words(text)
        return [set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set() for n, _ in weights]

    def score(query: str, held: list[set[tuple[str, ...]]]) -> float:
        total = 0.0
        for (_, w), x, y in zip(weights, grams(query), held, strict=True):
            shared = len(x & y)
            total += w * (shared / (len(x) + len(y) - shared) if x or y else 0.0)
        return total / sum(w for _, w in weights)

    @F.pandas_udf(T.DoubleType())
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        return _each(zip(x, y, strict=True), grams, score)

    return jaccard(a, b)


class Places:
    """The places of each word of a text."""

    def __init__(self, text: str):
        self.known: dict[str, int] = {}
        ids = np.array([self.known.setdefault(w, len(self.known)) for w in text.split()], np.int64)
        self.n, self.order = len(ids), np.argsort(ids, kind="stable")
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(self.known)))))

    def of(self, word: str) -> np.ndarray:
        k = self.known.get(word)
        return self.order[:0] if k is None else self.order[self.begin[k] : self.begin[k + 1]]


def _runs(query: str, places: Places) -> float:
    """M4 of a query. From the query's last word back: the run from a pair of places is one longer than that from the next pair, or 0 where words differ."""
    x = query.split()
    if not x or not places.n:
        return 0.0
    longest = total = 0
    run, after = np.zeros((2, places.n + 1), np.int64)
    before = places.order[:0]
    for w in reversed(x):
        at = places.of(w)
        run[at] = found = after[at + 1] + 1
        if len(at):
            longest, total = max(longest, int(found.max())), total + int(found.sum())
        after[before] = 0
        run, after, before = after, run, at
    return 0.6 * longest / len(x) + 0.4 * min(total / len(x), 1.0)


@F.pandas_udf(T.DoubleType())
def phrase_score(query: pd.Series, candidate: pd.Series) -> pd.Series:
    """M4: 0.6 * longest run of equal words / words + 0.4 * min(1, all runs / words), runs from every pair of places."""
    return _each(zip(query, candidate, strict=True), Places, _runs)


def characters(text: Column) -> Column:
    """The different characters of a text."""
    return F.array_distinct(F.split(text, ""))


def kinds(text: Column) -> Column:
    """The different words of a text, in the order of their first places."""
    return F.array_distinct(words(text))


def containment(query: Column, candidate: Column, chars: Column | None = None, held: Column | None = None) -> Column:
    """M5: 0.3 * shared characters + 0.4 * shared words + 0.3 * substring, each a share of the query's; substring is 1 where the candidate holds the
    query, 0.8 where the query holds the candidate, else the longest common substring, which alone needs Python. chars, held: the candidate's
    characters() and kinds(), where they have been made for several pairs."""
    share = lambda f, made: F.coalesce(F.try_divide(F.size(F.array_intersect(made, f(query))), F.size(f(query))), F.lit(0.0))
    apart = ~F.contains(candidate, query) & ~F.contains(query, candidate)
    common = longest_common_substring(query, F.when(apart, candidate))  # null: 0 without a comparison
    inside = F.when(F.contains(candidate, query), 1.0).when(F.contains(query, candidate), 0.8).otherwise(common)
    return 0.3 * share(characters, characters(candidate) if chars is None else chars) + 0.4 * share(kinds, kinds(candidate) if held is None else held) + 0.3 * inside


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def longest_common(query: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common substring of two texts of code points.

    Places of the text are numbered by which of the query's substrings of 1, 2, 4, ... characters begins there, 0 for none, each length from the pairs of numbers
    of the one before, until none is left; the lengths between are tried from there. A number stands for a substring itself, not for a hash.
    """

    def joined(q: np.ndarray, t: np.ndarray, q_more: np.ndarray, t_more: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the substrings that those of q and t, `step` characters long, make with those of q_more and t_more behind them."""
        wide = int(q_more.max()) + 1
        q = q[: max(0, len(q_more) - step)] * wide + q_more[step : step + len(q)]
        table = np.zeros((int(q.max()) + 1 if len(q) else 1), np.int64)
        kinds = np.unique(q)
        table[kinds] = np.arange(1, len(kinds) + 1)
        n = min(len(t), max(0, len(t_more) - step))
        t, more = t[:n], t_more[step : step + n]
        out = np.zeros(n, np.int64)
        at = np.flatnonzero((t > 0) & (more > 0))
        key = t[at] * wide + more[at]
        out[at] = np.where(key < len(table), table[np.minimum(key, len(table) - 1)], 0)
        return table[q], out

    kinds, past = np.unique(query), int(query.max()) + 1
    number = np.zeros(past + 1, np.int64)
    number[kinds] = np.arange(1, len(kinds) + 1)
    levels = [(number[query], number[np.minimum(text, past)])]
    if not levels[0][1].any():
        return 0
    while True:
        q, t = levels[-1]
        size = 1 << len(levels) - 1
        if 2 * size > min(len(query), len(text)):
            break
        q, t = joined(q, t, q, t, size)
        if not t.any():
            break
        levels.append((q, t))
    best = 1 << len(levels) - 1
    now = levels.pop()
    while levels:
        q, t = levels.pop()
        if best + (1 << len(levels)) <= min(len(query), len(text)):
            longer = joined(*now, q, t, best)
            if longer[1].any():
                now, best = longer, best + (1 << len(levels))
    return best


@F.pandas_udf(T.DoubleType())
def longest_common_substring(query: pd.Series, candidate: pd.Series) -> pd.Series:
    """M5's third term where neither contains the other: longest common substring of at least 3 characters over the query's length."""

    def one(a: str, b: np.ndarray) -> float:
        k = longest_common(_codes(a), b)
        return k / len(a) if k >= 3 else 0.0

    return _each(zip(query, candidate, strict=True), _codes, one)


def positional(query: Column, candidate: Column, held: Column | None = None) -> Column:
    """M6: 0.7 * share of query words found + 0.3 * share of adjacent found words in ascending first places. held: the candidate's kinds(), whose order is that of first places."""
    x = words(query)
    at = once(F.array_intersect(kinds(candidate) if held is None else held, x), lambda y: F.filter(F.transform(x, lambda w: F.array_position(y, w)), lambda p: p > 0))
    ordered = once(at, lambda a: F.size(F.filter(a, lambda p, i: (i > 0) & (p > F.get(a, i - 1)))))
    return 0.7 * F.coalesce(F.try_divide(F.size(at), F.size(x)), F.lit(0.0)) + 0.3 * F.coalesce(F.try_divide(ordered, F.size(at) - 1), F.lit(0.0))


def fallback_composite(jaccard: Column, phrase: Column, contained: Column) -> tuple[Column, Column]:
    """M7: (composite, whether to keep it)."""
    score = 0.4 * jaccard + 0.35 * phrase + 0.25 * contained
    return score, (score >= 0.3) | (jaccard >= 0.2) | (phrase >= 0.25) | (contained >= 0.4)


def substring_score(query: Column, reference: Column) -> Column:
    """M8: for a query that the reference contains, 0.75 and up for length and for whole words; else 0."""
    joined = F.array_join(words(reference), " ")
    edge = F.contains(F.concat(F.lit(" "), joined, F.lit(" ")), F.concat(F.lit(" "), query, F.lit(" "))) | F.startswith(joined, query) | F.endswith(joined, query)
    score = F.least(F.lit(1.0), 0.75 + F.least(F.lit(0.2), F.length(query) / 200) + F.when(edge, 0.1).otherwise(0.0))
    return F.when((F.length(query) > 0) & F.contains(reference, query), score).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def window_score(query: pd.Series, reference: pd.Series) -> pd.Series:
    """M9: for queries of up to 8 words, most of which the reference has, the best ratio with a window of as many words."""

    def one(a: str | None, b: str | None) -> float:
        x, y = (a or "").split(), (b or "").split()
        if not x or len(x) > 8 or len(y) < len(x) or sum(w in y for w in x) / len(x) < 0.6:
            return 0.0
        places = len(y) - len(x) + 1
        most = min(20, places)
        best = 0.0
        for i in range(0, places, max(1, (len(y) - len(x)) // most))[:most]:
            r = SequenceMatcher(None, " ".join(x), " ".join(y[i : i + len(x)])).ratio()
            best = max(best, r)
            if r >= 0.9:
                best = min(1.0, r + 0.05)
                break
        return min(1.0, best + 0.1) if best >= 0.8 else best if best >= 0.7 else 0.0

    return pd.Series([one(a, b) for a, b in zip(query, reference, strict=True)])


def adaptive_threshold(base: float, n_words: Column, match_type: Column) -> Column:
    """M10."""
    kind = lambda sub, fuzzy, other: F.when(match_type == "substring", sub).when(match_type == "fuzzy_substring", fuzzy).otherwise(other)
    return F.when(n_words <= 3, kind(0.75, 0.80, max(0.65, base - 0.2))).when(n_words <= 8, kind(0.75, 0.85, max(0.75, base - 0.1))).otherwise(max(0.85, base - 0.05))


def coverage(part: Column, whole: Column) -> Column:
    """M11."""
    return F.coalesce(F.try_divide(F.length(part), F.length(whole)), F.lit(0.0))


def blend(similarity: Column, rerank: Column, alpha: float = 0.7) -> Column:
    """M14."""
    return alpha * similarity + (1 - alpha) * rerank
