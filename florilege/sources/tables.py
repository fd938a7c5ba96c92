"""Intermediate tables in a folder that driver and executors share: stored once, read by every branch of a plan, dropped after."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="florilege-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of this application's own, in local mode only."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = _local(spark.sparkContext.applicationId)
    return held.rstrip("/")


def _path(df: DataFrame):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._florilege_table)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), path


def store(df: DataFrame, tag: str) -> DataFrame:
    """ST3: df written as Parquet and read back. Its plan ends here, so branches share the rows, and a lost executor costs no recomputation."""
    path = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._florilege_table = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table of store()."""
    files, path = _path(df)
    return files.getContentSummary(path).getLength()


def drop(*tables: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for df in tables:
        files, path = _path(df)
        files.delete(path, True)


class Shared:
    """Tables stored within a `with` block and dropped at its end: write what is made of them inside it.

    with Shared() as keep:
        spans = keep(verbatim_spans(docs, passages))
        scores(spans).write.parquet(out)
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Shared:
        return self

    def __call__(self, df: DataFrame, tag: str = "shared") -> DataFrame:
        self.tables.append(store(df, tag))
        return self.tables[-1]

    def __exit__(self, *error) -> None:
        drop(*self.tables)
        self.tables.clear()
