"""Exact containment, the threshold join, verification of verses and global numbering, against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from florilege.functions import similarity
from florilege.operators import correct, retrieve, verify
from florilege.sources import tables

VOWELLED = ["بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ", "الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ", "مَالِكِ يَوْمِ الدِّينِ", "إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ"]


def name(i):
    """A word of letters: the matcher's key has no digits."""
    return "v" + "".join("abcdefghij"[int(d)] for d in f"{i:03}")


def said(rng, n, kinds=("an", "the", "cat", "sat", "on", "mat", "é", "x1", "bee", "a")):
    return " ".join(rng.choice(kinds) for _ in range(n))


def test_common_subsequence_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(r for r in _next(row, x, b))]
        assert similarity.common_subsequence(similarity.places_of(a), len(a), b) == row[-1]
        got = similarity.common_subsequence(similarity.places_of(a), len(a), b, row[-1])
        assert got == row[-1]
        assert similarity.common_subsequence(similarity.places_of(a), len(a), b, row[-1] + 1) <= row[-1]


def _next(row, x, b):
    out, last = [], 0
    for j, y in enumerate(b):
        last = row[j] + 1 if x == y else max(last, row[j + 1])
        out.append(last)
    return out


@pytest.mark.parametrize("part_rows,threshold,least_word", [(10_000, 0.85, 3), (7, 0.6, 0), (7, 0.85, 0)])
def test_near_texts_are_all_pairs_of_the_ratio(spark, part_rows, threshold, least_word):
    rng = random.Random(5)
    texts = [said(rng, rng.randrange(1, 14)) for _ in range(40)] + ["", "x" * 240, "abcdefghij" * 30]
    queries = texts[:25] + [t.replace("cat", "cot", 1) for t in texts[:25]] + [t[:-3] + "zz" for t in texts] + ["", "abcdefghij" * 29 + "abcdefghxj"]
    q = spark.createDataFrame(sorted({(x,) for x in queries}), "q string")
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "p string, t string")
    got = {(r.q, r.p): r.ratio for r in similarity.near_texts(q, "q", t, "p", "t", threshold, least_word, part_rows).collect()}
    kinds = lambda s: {w for w in s.split() if len(w) >= least_word}
    want = {(x, str(i)): SequenceMatcher(None, x, y).ratio() for x in set(queries) for i, y in enumerate(texts) if x and y and x not in y and (not least_word or kinds(x) & kinds(y))}
    assert got == {k: v for k, v in want.items() if v >= threshold} and got


def test_holding_is_containment(spark):
    rng = random.Random(8)
    texts = [said(rng, rng.randrange(0, 30)) for _ in range(60)] + [None, "", "ab", "a  b\nc"]
    needles = [t[rng.randrange(0, max(1, len(t))) :][: rng.randrange(1, 40)] for t in texts if t for _ in range(3)] + ["zzz", "the the the the the the", "  b", None, "", "ab", "a  b\nc"]
    n = spark.createDataFrame(list(enumerate(needles)), "n int, s string")
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)], "p string, x string")
    got = {(r.n, r.p) for r in retrieve.holding(n, "n", "s", t, "p", "x").collect()}
    assert got == {(i, f"t{k}") for i, s in enumerate(needles) for k, x in enumerate(texts) if s and len(s) >= 3 and x is not None and s in x}


def test_verses_against_brute_force(spark):
    rng = random.Random(11)
    passages = [said(rng, rng.randrange(3, 12)) for _ in range(30)] + ["in the beginning was a word", "the end"]
    spans = [p for p in passages[::4]] + [p.replace("cat", "caat", 1) for p in passages] + [" ".join(p.split()[1:-1]) for p in passages] + ["", "the", "zz yy", "THE END (7)", None]
    c = spark.createDataFrame([(f"k{i:02}", p) for i, p in enumerate(passages)], "p string, x string")
    s = spark.createDataFrame(list(enumerate(spans)), "s int, t string")
    got = {r.s: (r.is_match, round(r.similarity, 9), r.p, r.match_type) for r in verify.verify_verses(s, "s", "t", c, "p", "x").collect()}
    key = lambda t: " ".join("".join(" " if x in "،؛:.!?()«»\"0123456789[]/" else x for x in t or "").split()).lower()
    for i, t in enumerate(spans):
        q, want = key(t), (False, 0.0, None, None)
        found = []
        for k, p in enumerate(passages):
            y, r = key(p), SequenceMatcher(None, q, key(p)).ratio()
            share = {w for w in q.split() if len(w) > 2} & {w for w in y.split() if len(w) > 2}
            sub = q in y and len(q.split()) > 2
            if q and share and (q in y or r >= 0.85):
                found.append((-max(r, 0.85) if sub else -r, f"k{k:02}", "substring" if sub else "fuzzy"))
        if q and q in map(key, passages):
            want = (True, 1.0, f"k{[*map(key, passages)].index(q):02}", "exact")
        elif found:
            best = min(found)
            want = (True, round(-best[0], 9), best[1], best[2])
        assert got[i] == want, (t, got[i], want)


def test_strict_verses_take_the_highest_ratio(spark):
    c = spark.createDataFrame([("a", "one two three four five"), ("b", "one two three"), ("c", "zero one two three")], "p string, x string")
    s = spark.createDataFrame([(1, "one two three"), (2, "two three"), (3, "three one"), (4, ""), (5, None)], "s int, t string")
    got = {r.s: (r.is_match, r.p, r.match_type) for r in verify.verify_strictly(s, "s", "t", c, "p", "x").collect()}
    assert got == {1: (True, "b", "exact"), 2: (True, "b", "substring"), 3: (False, None, None), 4: (False, None, None), 5: (False, None, None)}


def test_a_verbatim_fragment_is_its_passage_at_one(spark):
    rng = random.Random(3)
    passages = [said(rng, 26, [name(i) for i in range(200)]) for _ in range(20)]
    c = spark.createDataFrame([(f"k{i:02}", p) for i, p in enumerate(passages)], "p string, x string")
    spans = [" ".join(p.split()[3:8]) for p in passages] + [" ".join(p.split()[5:17]) for p in passages] + [p[7:40] for p in passages]
    s = spark.createDataFrame([(i, t, "Ayah") for i, t in enumerate(spans)], "s int, t string, k string")
    got = {r.s: (r.correction, r.detail.confidence, r.detail.passages) for r in correct.corrections(s, "s", "t", "k", {"Ayah": c}, "p", "x").collect()}
    for i, t in enumerate(spans):
        first = next(k for k, p in enumerate(passages) if t.strip() in p)
        assert got[i] == (passages[first], 1.0, [f"k{first:02}"])


def test_all_strategies_are_united_and_a_score_reorders(spark):
    words = [name(i) for i in range(60)]
    passages = [" ".join(words[i : i + 8]) for i in range(0, 48, 8)]
    c = spark.createDataFrame([(i, 1, i, p) for i, p in enumerate(passages)], "p int, g int, n int, x string")
    near = passages[3].replace(name(27), "wxrd")
    spans = [passages[1] + " " + passages[2], " ".join(words[10:13]), near, "nothing like it", f"{' '.join(words[1:5])} * {' '.join(words[33:37])}", "  ", correct.SENTINEL]
    s = spark.createDataFrame([(i, t, "Ayah") for i, t in enumerate(spans)], "s int, t string, k string")
    run = lambda **more: {r.s: r for r in correct.corrections(s, "s", "t", "k", {"Ayah": c}, "p", "x", runs={"Ayah": ("g", "n")}, **more).collect()}
    got = run()
    assert got[0].correction == f"{passages[1]}(1) {passages[2]}(2)" and got[0].detail.passages == [1, 2] and got[0].detail.is_cross
    assert got[1].correction == passages[1] and got[1].detail.match_type == "exact_normalized"
    assert got[2].correction == passages[3] and 0.85 <= got[2].detail.confidence < 1
    assert got[4].correction == f"{passages[0]}(0) {passages[4]}(4)" and got[4].detail.match_type == "multiple_parts" and got[4].detail.n_parts == 2
    assert all(got[i].correction is None for i in (3, 5, 6))
    # A score over 0.5 settles a span of one part that no similarity does; what is settled at 0.95 isn't scored.
    scored = run(score=lambda span, text: F.when(F.contains(text, F.lit(name(40))) & F.contains(span, F.lit("nothing")), 0.9).otherwise(0.0))
    assert scored[0].detail.rerank_score is None and scored[0].correction == got[0].correction


def test_crop_and_snap_without_marks(spark):
    verse = " ".join(VOWELLED)
    bare = lambda t: "".join(x for x in t if not ("ً" <= x <= "ْ" or x in "ٰـ"))
    part = " ".join(VOWELLED[1:3])
    rows = [(1, bare(part), verse), (2, bare(verse), verse), (3, "zz", verse), (4, bare(VOWELLED[1]), "ۚ " + VOWELLED[0] + " ۖ " + VOWELLED[1] + " " + VOWELLED[2])]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", correct.snap(F.col("a"), F.col("b")).alias("x"))
    got = {r.i: r.x for r in df.collect()}
    assert got == {1: part, 2: verse, 3: verse, 4: VOWELLED[1]}


def test_crop_against_the_librarys_alignment(spark):
    rng = random.Random(6)
    rows = [(i, said(rng, rng.randrange(1, 12)), said(rng, rng.randrange(1, 30))) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", correct.crop(F.col("a"), F.col("b")).alias("x"))
    for r in df.collect():
        a, b = rows[r.i][1].split(), rows[r.i][2].split()
        blocks = [m for m in SequenceMatcher(None, a, b, False).get_matching_blocks() if m.size]
        assert r.x == (" ".join(b[blocks[0].b : blocks[-1].b + blocks[-1].size]) if blocks else rows[r.i][2])


def test_snapped_over_runs_of_verses_and_the_sentinel(spark):
    c = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(VOWELLED)], "g int, n int, t string")
    runs = retrieve.adjacent_passages(c, "g", "n", "t").withColumn("id", F.struct("g", "first", "n"))
    bare = lambda t: "".join(x for x in t if not ("ً" <= x <= "ْ" or x in "ٰـ"))
    p = spark.createDataFrame([(1, bare(VOWELLED[1]) + " (2)"), (2, f"{bare(VOWELLED[1])} {bare(VOWELLED[2])}"), (3, "zq zw"), (4, correct.SENTINEL), (5, "")], "k int, x string")
    got = {r.k: r.correction for r in correct.snapped(p, "k", "x", runs, "id", "joined", plain_col="plain").collect()}
    assert got == {1: VOWELLED[1], 2: f"{VOWELLED[1]} (2) {VOWELLED[2]} (3)", 3: None, 4: None, 5: None}


def test_canonical_against_brute_force_with_text_ids(spark):
    rng = random.Random(4)
    corpus = [said(rng, rng.randrange(3, 15)) for _ in range(25)]
    preds = [t.replace("sat", "sad") for t in corpus] + [said(rng, 4) for _ in range(10)]
    c = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(corpus)], "p string, t string")
    got = {r.k: (r.p, r.similarity) for r in correct.canonical(spark.createDataFrame(list(enumerate(preds)), "k int, x string"), "k", "x", c, "p", "t").collect()}
    for k, x in enumerate(preds):
        best = []
        for i, t in enumerate(corpus):
            a, b, r = set(x.split()), set(t.split()), SequenceMatcher(None, x, t).ratio()
            if len(a & b) >= max(2, len(a) // 4) and len(a & b) / len(a) >= 0.3 and r >= 0.55:
                best.append((-r, f"c{i:02}"))
        assert got[k] == ((min(best)[1], -min(best)[0]) if best else (None, None))


def test_each_place_is_given_once_with_sampled_ranges(spark):
    n = 6_000_000
    rows = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("x"), "id")
    placed = tables.store(retrieve.numbered(rows, "place", "x"), "placed")
    r = placed.agg(F.count("*").alias("n"), F.countDistinct("place").alias("kinds"), F.min("place").alias("low"), F.max("place").alias("high")).first()
    assert tuple(r) == (n, n, 1, n)
    wrong = placed.withColumn("before", F.sum(F.lit(1)).over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy(F.shiftright("place", 14)).orderBy("x")))
    assert wrong.filter(F.col("before") != F.col("place") - F.greatest(F.shiftleft(F.shiftright("place", 14), 14), F.lit(1)) + 1).isEmpty()


def test_shared_tables_are_dropped(spark):
    with tables.Shared() as keep:
        held = keep(spark.range(5))
        assert held.count() == 5 and tables.stored_bytes(held) > 0
    with pytest.raises(Exception):
        held.count()
