"""What the operators share: the shared scratch folder, tables that cut lineage, byte views of Arrow text."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the six characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
#: Input for each file that stash() writes where it is told of the input.
FILE_BYTES = 4 << 20
#: Tables of ids and hashes up to this size on disk (about 24 bytes a row) are broadcast.
BROADCAST_BYTES = 4 << 20


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only in local mode."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="florilege-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def stash(df: DataFrame, tag: str, from_bytes: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    from_bytes: size of the tables that df is made from; it is then written by a task for each FILE_BYTES of them, not one for each shuffle partition.
    options: the writer's.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    if from_bytes is not None:
        df = df.coalesce(-(-from_bytes // FILE_BYTES) + 1)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._florilege_path = path
    return out


def held_bytes(*tables: DataFrame) -> int:
    """Bytes on disk of tables of stash()."""
    total = 0
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._florilege_path)
        total += path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def slight(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """df, to be broadcast if the tables of stash() that it selects from (itself, if none are named) hold no more than BROADCAST_BYTES; else joins shuffle."""
    return F.broadcast(df) if held_bytes(*(sources or (df,))) <= BROADCAST_BYTES else df


def plan_bytes(df: DataFrame, unknown: int) -> int:
    """What the plan says of df's size, the bytes of its files where it reads files; `unknown` where it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else unknown


def unstash(*tables: DataFrame) -> None:
    """Delete tables of stash() that no later read needs, and let Spark forget the shuffles behind them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._florilege_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to drop unreferenced shuffles, whose files stay on the executors' disks otherwise. It is asked again a moment later: listeners hold a plan for a while after its end."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow text or binary column without a copy of the bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, np.int64))


def pieces(offsets: np.ndarray, most: int):
    """Row ranges of about `most` bytes; a longer row stands alone."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield begin, min(end, n)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prefix_sums(raw: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(sums, powers) mod 2**64: (sums[b] - sums[a]) * powers[a] is a polynomial in the bytes raw[a:b] alone. base is odd."""
    n = len(raw)
    if base not in _powers or len(_powers[base][0]) < n + 1:
        size = max(n + 1, 1 << 16)
        step, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _powers[base] = np.multiply.accumulate(step), np.multiply.accumulate(back)
    up, down = _powers[base]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    return sums, up


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of raw[start:end] for each span; equal bytes give equal hashes wherever they stand."""
    sums, up = prefix_sums(raw, base)
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
