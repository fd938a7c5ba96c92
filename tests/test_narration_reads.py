"""Candidates of narrations where no search can stop: the corpus is read once, and each word brings no more than the first passages by id."""

import random

import pytest
from florilege.operators.parts import narration_candidates
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [3, 40])
def test_the_corpus_is_read_once(spark, most):
    draw = random.Random(most)
    kinds = [f"word{i}" for i in range(12)] + ["of", "to"]
    text = lambda k: " ".join(draw.choice(kinds) for _ in range(draw.randint(1, k)))
    spans, corpus = [(i, text(30)) for i in range(15)], [(i // 2, text(6)) for i in range(120)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(t):
        seen.add(1)
        return t

    q, c = spark.createDataFrame(spans, "s long, k string"), spark.createDataFrame(corpus, "p long, t string")
    got = {(r.s, r.p) for r in narration_candidates(q, "s", "k", c.select("p", watched("t").alias("t")), "p", "t", enough=120, most=most).collect()}
    want = set()
    for s, k in spans:
        w = k.split()
        taken = {x for x in (w[:15] if len(w) > 20 else w) if len(x) >= 3}
        want |= {(s, p) for p in sorted({p for p, t in corpus if taken & set(t.split())})[:most]}
    assert got == want
    assert seen.value <= len(corpus)
