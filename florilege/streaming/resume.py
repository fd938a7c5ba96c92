"""Resumable annotation: what is done is a table, what remains an anti-join; or a stream whose batches are each written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """ST2, O8."""
    return items.join(done.select(key), key, "left_anti")


def _there(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def begin_run(spark: SparkSession, folder: str, run: str, n_total: int) -> None:
    """ST1: note a run with the number of its items in folder/runs. A run that is there keeps its number: what is left after an interruption is not its total."""
    path = f"{folder}/runs/run={run}"
    if not _there(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(n_total,)], "n_total long").coalesce(1).write.mode("overwrite").parquet(path)


def annotate_stream(items: DataFrame, annotate: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, run: str) -> StreamingQuery:
    """ST1: annotate a stream of new items of a run; a restart from the checkpoint goes on after the last whole batch.

    Each batch is a folder of its own, named by its number and written whole: a batch that is run again, after a loss between its results and its
    commit, takes its own place, so every item's results are there once. A finished stream that is started again appends nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{folder}/results/run={run}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All results written so far, with their run and batch."""
    return spark.read.option("basePath", f"{folder}/results").parquet(f"{folder}/results")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, n_total) of the runs begun."""
    return spark.read.option("basePath", f"{folder}/runs").parquet(f"{folder}/runs").select(F.col("run").cast("string").alias("run"), "n_total")


def run_status(runs: DataFrame, results: DataFrame, run: str = "run", error: Column | None = None, **metrics: str) -> DataFrame:
    """ST1, E15: a row for each run: n_total, n_done, n_failed (rows with an error, which count as done), status (complete once n_done reaches n_total, else in_progress), and the mean of each metric (name=column) over rows without an error, 0 without any."""
    failed = F.lit(False) if error is None else error.isNotNull()
    means = [F.avg(F.when(~failed, F.col(c))).alias(f"_{name}") for name, c in metrics.items()]
    done = results.groupBy(F.col(run).cast("string").alias(run)).agg(F.count("*").alias("_done"), F.count_if(failed).alias("_failed"), *means)
    rows = runs.select(F.col(run).cast("string").alias(run), "n_total").join(done, run, "left")
    n_done = F.coalesce("_done", F.lit(0))
    return rows.select(run, "n_total", n_done.alias("n_done"), F.coalesce("_failed", F.lit(0)).alias("n_failed"), F.when(n_done >= F.col("n_total"), "complete").otherwise("in_progress").alias("status"), *(F.coalesce(f"_{name}", F.lit(0.0)).alias(name) for name in metrics))
