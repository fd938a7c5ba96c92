"""Measures of pairs: each text is prepared once for the pairs that follow one another, and a long or monotonous one costs no more than its length."""

import random
import time
from difflib import SequenceMatcher

import pytest
from florilege.functions import similarity
from pyspark.sql import functions as F


def scores(spark, rows, measure):
    """The measure of (a, b), and the seconds of a second run over all rows, when workers have started."""
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1).cache()
    made = df.select(measure(F.col("a"), F.col("b")).alias("x"))
    out = [r.x for r in made.collect()]
    begin = time.time()
    made.agg(F.sum("x")).collect()
    return out, time.time() - begin


def texts(n, most_a, most_b, join=""):
    draw = random.Random(5)
    made = [[join.join(draw.choice(kinds) for _ in range(draw.randint(1, m))) for m in (most_a, most_b)] for kinds in ("ab", "abc é", "abcdefghij𝔸") for _ in range(n)]
    return [(a, b) for a, b in made] + [(a, b[:7] + join + a[3:40] + join + b[7:]) for a, b in made]


def test_longest_common_substring_against_the_library(spark):
    rows = [*texts(60, 60, 120), ("", "a"), (None, "a"), ("a", None)]
    got, _ = scores(spark, rows, similarity.longest_common_substring)
    length = [SequenceMatcher(None, a or "", b or "", False).find_longest_match().size for a, b in rows]
    assert got == [k / len(a) if k >= 3 else 0.0 for (a, _), k in zip(rows, length, strict=True)]


def test_common_substrings_of_monotonous_texts(spark):
    rows = [("ab" * 200 + f"c{i}", "abd" + "ab" * 150 + "d" + "ab" * 60_000) for i in range(8)]
    got, seconds = scores(spark, rows, similarity.longest_common_substring)
    assert got == [400 / 402] * 8
    assert seconds < 8


def test_containment_with_what_was_made_of_the_text(spark):
    rows = [(a.replace("c", " "), b.replace("c", " ")) for a, b in texts(20, 30, 60)]
    plain, _ = scores(spark, rows, similarity.containment)
    assert scores(spark, rows, lambda a, b: similarity.containment(a, b, similarity.characters(b), similarity.kinds(b)))[0] == plain


def test_runs_against_every_pair_of_places(spark):
    def plain(x, y):
        runs = [next(k for k in range(len(x) + 1) if i + k >= len(x) or j + k >= len(y) or x[i + k] != y[j + k]) for i in range(len(x)) for j in range(len(y))]
        return 0.6 * max(runs) / len(x) + 0.4 * min(sum(runs) / len(x), 1.0)

    rows = texts(25, 12, 25, " ")
    got, _ = scores(spark, rows, similarity.phrase_score)
    assert got == [pytest.approx(plain(a.split(), b.split())) for a, b in rows if a.split() and b.split()]


def test_runs_of_one_word(spark):
    got, seconds = scores(spark, [("a " * 400, "a " * 4000)] * 2, similarity.phrase_score)
    assert got == [1.0, 1.0]
    assert seconds < 8


def test_first_places_are_those_of_the_text(spark):
    rows = [("c a b", "b a b c a"), ("a a b", "x a y b a"), ("q", "a b"), ("b c", "c b b c")]
    got, _ = scores(spark, rows, similarity.positional)
    assert scores(spark, rows, lambda a, b: similarity.positional(a, b, similarity.kinds(b)))[0] == got
    assert got == [pytest.approx(x) for x in (0.7 + 0.3 * 0 / 2, 0.7 + 0.3 * 1 / 2, 0.0, 0.7 + 0.3 * 0)]


def test_ngram_jaccard_against_sets_of_joined_words(spark):
    def plain(a, b):
        total = 0.0
        for n, w in ((2, 0.3), (3, 0.4), (4, 0.3)):
            x, y = ({" ".join(t[i : i + n]) for i in range(max(1, len(t) - n + 1))} if t else set() for t in (similarity.split_words(a), similarity.split_words(b)))
            total += w * len(x & y) / len(x | y) if x | y else 0.0
        return total

    rows = [*texts(25, 12, 25, " "), ("a", "a"), ("", ""), ("a b", "a b c"), ("a\x1cb c d", "a b c d"), ("a\x1cb c", "a\x1cb c")]
    got, _ = scores(spark, rows, similarity.ngram_jaccard)
    assert got == [pytest.approx(plain(a, b)) for a, b in rows]
    assert got[-1] == pytest.approx(1) and got[-2] < 1


def test_ngrams_of_a_long_text_are_made_once(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got, seconds = scores(spark, [(f"w{i} w{i + 1} w{i + 2} w{i + 3}", long) for i in range(60)], similarity.ngram_jaccard)
    assert min(got) > 0
    assert seconds < 8


def test_words_are_those_of_spark(spark):
    from florilege.functions.tokens import words

    texts = [f"a{chr(c)}b" for c in [*range(0, 0x500), *range(0x1600, 0x1900), *range(0x2000, 0x2100), 0x3000, 0xFEFF]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [similarity.split_words(t) for t in texts]
