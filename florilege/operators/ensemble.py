"""Votes of several annotators and tables over their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def char_votes(spans: DataFrame, weights: DataFrame, doc_id: str) -> DataFrame:
    """G1: (doc, start, stop, label) where a label's weight is more than half of all voters'; q before h. A sweep over boundaries: +w where a
    span starts, -w where it ends, running sums; a voter whose spans overlap counts for each of them.

    spans: doc, model, label (q or h), span_start, span_end; weights: doc, model, weight, a row for each model that has the document.
    """
    half = weights.groupBy(doc_id).agg((F.sum("weight") / 2).alias("_half"))
    s = spans.join(weights, [doc_id, "model"])
    side = lambda p, sign: s.select(doc_id, F.col(p).alias("start"), *((F.when(F.col("label") == k, F.col("weight")).otherwise(0.0) * sign).alias(k) for k in "qh"))
    moves = side("span_start", 1).union(side("span_end", -1)).groupBy(doc_id, "start").agg(F.sum("q").alias("q"), F.sum("h").alias("h"))
    w = Window.partitionBy(doc_id).orderBy("start")
    cells = moves.select(doc_id, "start", F.lead("start").over(w).alias("stop"), *(F.round(F.sum(k).over(w), 9).alias(k) for k in "qh")).filter("stop IS NOT NULL")
    label = F.when((F.col("q") > F.col("_half")) & (F.col("q") >= F.col("h")), "q").when((F.col("h") > F.col("_half")) & (F.col("h") > F.col("q")), "h")
    return runs(cells.join(half, doc_id).select(doc_id, "start", "stop", label.alias("label")).filter("label IS NOT NULL"), doc_id)


def runs(cells: DataFrame, doc_id: str) -> DataFrame:
    """Touching cells of equal label become one."""
    w = Window.partitionBy(doc_id).orderBy("start")
    fresh = ~(F.lag("stop").over(w).eqNullSafe(F.col("start")) & F.lag("label").over(w).eqNullSafe(F.col("label")))
    numbered = cells.withColumn("_f", fresh.cast("int")).withColumn("_run", F.sum("_f").over(w))
    return numbered.groupBy(doc_id, "_run", "label").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(doc_id, "start", "stop", "label")


def majority(votes: DataFrame, *key: str) -> DataFrame:
    """Strict majority of boolean votes; a tie is false."""
    return votes.groupBy(*key).agg(F.count_if("vote").alias("n_yes"), F.count("vote").alias("n_votes")).withColumn("verdict", 2 * F.col("n_yes") > F.col("n_votes"))


def consensus(answers: DataFrame, gold: Column, *key: str) -> DataFrame:
    """Keys where some answer differs from gold: the commonest answer (the least of equals), its share, whether all agree, and how many differ. Unanimous first by order columns."""
    a = answers.withColumn("_differs", F.col("answer") != gold)
    per = a.groupBy(*key, "answer").agg(F.count("*").alias("_n"), F.count_if("_differs").alias("_d"))
    out = per.groupBy(*key).agg(F.min_by("answer", F.struct(-F.col("_n"), F.col("answer"))).alias("consensus"), F.max("_n").alias("n_consensus"), F.sum("_n").alias("n_answers"), F.sum("_d").alias("n_differ"), F.count("*").alias("_kinds"))
    return out.filter("n_differ > 0").withColumn("unanimous", F.col("_kinds") == 1).drop("_kinds")


def comparison(tables: list[DataFrame], key: str = "model") -> DataFrame:
    """A full outer merge on the key."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def first_values(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each key the one value that isn't null in each column (the largest, should there be several)."""
    return rows.groupBy(key).agg(*(F.max(c).alias(c) for c in columns))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with no value at all go; one row of counts is collected."""
    n = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if n[c]))
