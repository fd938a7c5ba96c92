import random
import re
from itertools import combinations

import numpy as np
import pytest

from florilege.llm import jaccard
from florilege.llm.jaccard import Bands, exact_shingles, jaccard_groups


def brute(rows, percent=80, width=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus(seed, families=12, copies=8, long=300):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    boiler = " ".join(r.choice(vocab) for _ in range(40))
    texts = []
    for f in range(families):
        n = r.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, long])
        base = [r.choice(vocab) for _ in range(n)]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, max(1, n // 25))):
                k = r.randrange(len(t) or 1)
                t[k : k + 1] = r.choice([[], [r.choice(vocab)], [r.choice(vocab), r.choice(vocab)]])
            texts.append(" ".join(t).upper() if r.random() < 0.2 else "\n".join(t) + (f" {boiler}" if f % 3 == 0 else ""))
    texts += [None, "", " \t", "one", "One", "a b c d", "A b  c d", "x " * 50, "x " * 60]
    r.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, sid int, root string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows, buckets=8) == brute(rows)


def test_large_groups(spark, monkeypatch):
    rows = corpus(3, families=4, copies=40)
    assert run(spark, rows, buckets=4) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 4, 5, 7, 12, 30, 50, 80, 90, 150, 400])
def test_no_pair_escapes_the_signatures(size):
    """Random pairs of sets at the threshold share a trusted signature."""
    bands, rng = Bands(80), np.random.default_rng(size)
    for _ in range(60):
        total = rng.integers(size, size * 5 // 4 + 1)
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        common = -(-4 * (size + int(total)) // 9)
        if common > size:
            continue
        b = np.concatenate((rng.choice(a, common, replace=False), rng.integers(0, 1 << 63, int(total) - common, dtype=np.uint64) * np.uint64(2)))
        b = np.unique(b)
        if 9 * len(np.intersect1d(a, b)) < 4 * (len(a) + len(b)):
            continue
        tokens, offsets = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        sizes = np.diff(offsets)
        band = bands.of(sizes)
        use = np.ones(2, bool)
        found = [jaccard.entries(tokens, offsets, bands, band, use, True)]
        found += [jaccard.entries(tokens, offsets, bands, np.maximum(band - s, 0), use & can, False) for s, can in enumerate(bands.below(sizes), 1)]
        sig, row = (np.concatenate(x) for x in zip(*found))
        x, y, _, _, _ = jaccard.group_pairs(sig, row.astype(np.uint64), sizes[row], 80)
        assert (0, 1) in set(zip(x.tolist(), y.tolist()))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in jaccard_groups(docs).collect())
    assert got == [(-1, 0, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7)]


@pytest.mark.parametrize("small", [2, 5])
def test_families_that_fall_apart(spark, monkeypatch, small):
    """Families whose members are about as similar as the threshold, as pairs, crowds and big components."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    r = random.Random(small)
    texts = []
    for _ in range(3):
        base = [f"b{r.randrange(10**6)}" for _ in range(100)]
        for k in range(40):
            t = list(base)
            for _ in range(r.choice([1, 2, 3])):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert 3 < len({c for _, _, c in expected}) < len(rows)
    assert run(spark, rows, buckets=4, cell=500) == expected


@pytest.mark.parametrize("within", [True, False])
def test_spanning_links_join_what_all_pairs_join(within):
    rng = np.random.default_rng(3)
    base = np.arange(60)
    sets = [np.unique(np.concatenate((rng.choice(base, 54, replace=False), rng.integers(100, 1 << 40, k)))) for k in rng.integers(0, 9, 30)]
    sid, first = np.arange(30), np.arange(30) % 3 == 0
    linked = {(i, j) for i, j in combinations(range(30), 2) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j])) and (within or first[i] != first[j])}
    got = jaccard._spanning(sid, sid, first, within, sets, 80)
    pairs = set(zip(*(c.to_pylist() for c in got.columns)))
    assert pairs <= linked and len(pairs) == 30 - len(_classes(30, linked)) > 5


def test_words_that_a_polynomial_hash_confuses_are_two_components(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    assert run(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]) == [(1, 1, 1), (2, 1, 2)]


def test_sets_whose_ids_collide_are_told_apart(spark):
    rows = corpus(5, families=6, copies=6)
    assert run(spark, rows, buckets=4, sid_mask=7) == brute(rows)


def test_exact_shingles_are_equal_where_the_words_are():
    texts = [b"a b c d e f", b"A b  c d e\x0bf", b"a b c d e", b"a b", b"a B", b"b a", b"", b"a b c d e f a b c d e f"]
    sets = exact_shingles(texts, 5)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 1, 0, 6]
    assert sets[0].tolist() == sets[1].tolist() and sets[2][0] in sets[0] and sets[3].tolist() == sets[4].tolist() != sets[5].tolist()
    assert set(sets[0]) < set(sets[7])


@pytest.mark.parametrize("forest_bytes", [0, 1 << 20])
def test_components_in_one_task_and_in_rounds(spark, forest_bytes):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300), (-5, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(5), "t", forest_bytes=forest_bytes).collect()}
    assert got == {**{i: -5 for i in range(61)}, -5: -5, 100: 100, 150: 100, 200: 100}


def _classes(n, linked):
    root = list(range(n))
    for _ in range(n):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return set(root)
