"""Periodic runs against brute force."""

import random

import numpy as np
import pytest

from florilege.llm import periodic


def brute(words, length, exponent):
    """Every stretch that is maximal with its smallest period, told from all periods of all places."""
    found, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, m, p) for (s, m), p in found.items() if m >= max(length, exponent * p))


def collapsed(words, runs):
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("length,exponent,piece,seed", [(6, 4, 1 << 20, 1), (6, 4, 50, 2), (2, 2, 400, 3), (3, 3, 1 << 20, 4), (6, 2, 1 << 20, 5)])
def test_equals_brute_force(spark, length, exponent, piece, seed):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "a", "a a a a a a", "a a a a a", "é " * 9, " ".join("ab" * 8), "x\x0by\x0cx\ty " * 6, "a\x1cb " * 7]
    for _ in range(120):
        w = []
        while len(w) < rng.randrange(0, 80):
            w += [rng.choice("abc") for _ in range(rng.randrange(1, 6))] * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    rows = [(k, t, "r", 0, 1) for k, t in enumerate(texts)] + [(None, "b b b b b b b", "r", 0, 1), (4, "a a a a a a", "r", 0, 1)]
    out = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long, start long").repartition(3), length=length, exponent=exponent, piece_bytes=piece)
    want = []
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute(w, length, exponent)
        want.append((i, len(w), runs, collapsed(w, runs)))
    got = [(r.doc_id, r.n_words, [(x.start, x["length"], x.period) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_extensions_are_those_of_the_sequence():
    rng = np.random.default_rng(4)
    s = np.concatenate([rng.integers(0, 2, 300), [7], np.tile([0, 1, 1], 60), [8]])
    e = periodic.Extensions(s)
    i, j = rng.integers(0, len(s), 2000), rng.integers(0, len(s), 2000)
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i.tolist(), j.tolist(), e.common(i, j).tolist(), strict=True):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert k == got


def test_long_periods_and_an_empty_table(spark):
    words = [f"w{k}" for k in range(997)]
    text = " ".join(words * 5 + ["end"] + ["z"] * 50_000)
    (r,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(x.start, x["length"], x.period) for x in r.runs] == [(0, 4985, 997), (4986, 50_000, 1)]
    assert r.collapsed == " ".join(words + ["end", "z"])
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def stretches(words, length=6, exponent=4):
    """brute() by whole comparisons of the sequence with itself, moved by each period."""
    codes = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    found = {}
    for p in range(1, len(codes) // exponent + 1):
        same = np.concatenate([[0], (codes[p:] == codes[:-p]).astype(int), [0]])
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a + p >= max(length, exponent * p):
                found.setdefault((a, b - a + p), p)
    return sorted((s, m, p) for (s, m), p in found.items())


def test_query_against_brute_force(spark, tmp_path):
    import hashlib
    import re
    import zlib
    from fractions import Fraction

    from florilege.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a a a a a a a b"), (10**9, None), (-5, ""), (12, "x y " * 30)] + [(k, f"w{k} v u t s r q p " * 3) for k in range(2000, 2040)], "doc_id long, text string")
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    want, sha = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.union(odd).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = stretches(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((r.doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(collapsed(w, runs)), n))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10
