"""Painting against characters painted one by one."""

import random

from pyspark.sql import functions as F

from florilege.operators import score


def painted(spans, n):
    out = [None] * n
    for _, a, b, label, _ in sorted(spans, key=lambda s: s[4]):
        out[a:b] = [label] * max(0, b - a)
    return out


def test_later_spans_over_earlier_ones(spark):
    rng = random.Random(9)
    spans = []
    for d in range(12):
        for k in range(rng.randrange(1, 60)):
            a = rng.randrange(0, 300)
            spans.append((d, a, a + rng.choice([0, 1, 2, 7, 64, 200]), rng.choice(["Ayah", "Hadith"]), k))
    df = spark.createDataFrame(spans, "d int, span_start int, span_end int, label string, span_no int")
    got = {d: [None] * 600 for d in range(12)}
    for r in score.paint(df, "d").collect():
        assert got[r.d][r.start : r.stop] == [None] * (r.stop - r.start)
        got[r.d][r.start : r.stop] = [r.label] * (r.stop - r.start)
    assert got == {d: painted([s for s in spans if s[0] == d], 600) for d in range(12)}


def test_overlaps_are_those_of_the_characters(spark):
    rng = random.Random(10)
    made = lambda: [(d, a, a + rng.randrange(0, 40), rng.choice(["Ayah", "Hadith"]), k) for d in range(8) for k in range(rng.randrange(0, 9)) for a in [rng.randrange(0, 160)]]
    gold, pred = made(), made()
    frame = lambda rows: score.paint(spark.createDataFrame(rows, "d int, span_start int, span_end int, label string, span_no int"), "d")
    got = {(r.d, r.gold, r.pred): r.n for r in score.overlap_counts(frame(gold), frame(pred), spark.createDataFrame([(d, 200) for d in range(8)], "d int, n int"), "d", "n").collect()}
    want = {}
    for d in range(8):
        for g, p in zip(painted([s for s in gold if s[0] == d], 200), painted([s for s in pred if s[0] == d], 200), strict=True):
            k = (d, g or "Neither", p or "Neither")
            want[k] = want.get(k, 0) + 1
    assert got == want


def test_a_hundred_thousand_spans_in_one_document(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("d"), (F.col("id") * 7919 % 50_000).alias("span_start"), F.col("id").alias("span_no"))
    rows = rows.withColumn("span_end", F.col("span_start") + F.col("span_no") % 900 + 1).withColumn("label", F.when(F.col("span_no") % 3 == 0, "Ayah").otherwise("Hadith"))
    got = [None] * 51_000
    for r in score.paint(rows, "d").collect():
        got[r.start : r.stop] = [r.label] * (r.stop - r.start)
    want = [None] * 51_000
    for k in range(n):
        a = k * 7919 % 50_000
        b = a + k % 900 + 1
        want[a:b] = ["Ayah" if k % 3 == 0 else "Hadith"] * (b - a)
    assert got == want
