"""Summaries of results: means, orders, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble_summary(per_question: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """How many rows there are and the mean of each metric, 0 without rows; nulls (not completed) count nowhere."""
    return per_question.groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics))


def summary_table(results: DataFrame, subtask: str, metric: str) -> DataFrame:
    """By subtask, the best first, missing metrics last."""
    return results.orderBy(F.asc(subtask), F.desc_nulls_last(metric))


def flatten_results(results: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """A row for each result document: model, subtask, file and each metric by its JSON path in aggregate_metrics, null where it isn't there."""
    held = F.to_json("aggregate_metrics") if dict(results.dtypes)["aggregate_metrics"] != "string" else F.col("aggregate_metrics")
    return results.select("model", "subtask", "file", *(F.get_json_object(held, f"$.{path}").cast("double").alias(name) for name, path in metrics.items()))


def model_order(results: DataFrame, metric: str, model: str = "model") -> DataFrame:
    """(model, place): the models that have the metric, best first; ties by name."""
    from pyspark.sql import Window

    return results.filter(F.col(metric).isNotNull()).select(model, F.row_number().over(Window.orderBy(F.desc(metric), model)).alias("place"))  # a row for each model


def corpus_order(passages: DataFrame, group: str, position: str, text: str) -> DataFrame:
    """Passages with a text, by group and position."""
    return passages.filter(F.col(text).isNotNull()).orderBy(group, position)


def first_samples(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order; all without n."""
    return rows.orderBy(*order) if n is None else rows.orderBy(*order).limit(n)


def kind_counts(rows: DataFrame, kind: str, known: tuple[str, ...] = ("Ayah", "Hadith")) -> DataFrame:
    """Rows of the kinds known, counted."""
    return rows.filter(F.col(kind).isin(*known)).groupBy(kind).agg(F.count("*").alias("n"))


def correction_statistics(rows: DataFrame, correction: str = "correction", confidence: str = "confidence", crossing: Column | None = None) -> DataFrame:
    """Total, corrected, uncorrected, their shares in percent, mean confidence where there is any, and how many cross passages."""
    total, found = F.count("*"), F.count(correction)
    share = lambda n: F.coalesce(100 * F.try_divide(n, total), F.lit(0.0))
    mean = F.avg(F.when(F.col(confidence) > 0, F.col(confidence)))
    return rows.agg(total.alias("total"), found.alias("corrected"), (total - found).alias("uncorrected"), share(found).alias("corrected_pct"), share(total - found).alias("uncorrected_pct"), mean.alias("mean_confidence"), F.count_if(F.lit(False) if crossing is None else crossing).alias("crossing"))
