"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, pieces, span_hashes, stash, utf8


@dataclass(frozen=True)
class Model:
    """buckets: size of the hashed feature space. target_rows: at most so many labelled rows, those with the smallest hashed ids, fit the target model. temperature: of the Gumbel noise; 1 samples in proportion to the likelihood ratio. share: kept part of all documents; None: the part of good ones among the labelled. seed: of the noise."""

    buckets: int = 1 << 16
    target_rows: int = 200_000
    temperature: float = 1.0
    smoothing: float = 1.0
    share: float | None = None
    seed: int = 7


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word and each pair of adjacent words of texts given as bytes; A-Z count as a-z.

    A word is hashed by a polynomial over its bytes, read off prefix sums with the inverse powers of an odd base.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    ink = ~blank
    starts = np.flatnonzero(ink & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
    ends = np.flatnonzero(ink & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = span_hashes(_LOWER[raw], starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = mix(hashes[pair] * np.uint64(3) + mix(hashes[pair + 1]))
    return (np.concatenate((mix(hashes), two)) % np.uint64(buckets)).astype(np.int64), np.concatenate((row, row[pair]))


def _counts(raw_and_target: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets: column 0 over all rows, column 1 over target rows. Two arrays of fixed size from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            target = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for a, b in pieces(offsets, 4 << 20):
                bucket, row = ngram_buckets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[target[a:b][row]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    sums = raw_and_target.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, buckets), np.float64)
    got = sums.toArrow()  # at most `buckets` rows
    at = got["bucket"].to_numpy()
    out[0, at], out[1, at] = got["raw"].to_numpy(), got["target"].to_numpy()
    return out


def kth_largest(scores: DataFrame, k: int, fine: int = 4096) -> tuple[float, int]:
    """(value of the k-th largest score, how many rows of just that value belong to the k), from counts of histogram bins.

    Each round narrows the range to the bin that holds the k-th row; a round moves `fine` counts to the driver.
    """
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    above, inside = 0, scores
    while lo < hi:
        width = (hi - lo) / fine
        at = F.least(F.lit(fine - 1), F.floor((F.col("score") - lo) / width).cast("int"))
        bins = inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy(F.desc("b")).collect()
        for b in bins:
            if above + b["n"] >= k:
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
        inside = scores.filter((F.col("score") >= lo) & (F.col("score") <= hi))
        if len(bins) == 1 and width <= 0:
            break
    return lo, k - above


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model = Model()) -> DataFrame:
    """One row per row of docs: id, n_grams, log_ratio (summed over the text's n-grams), score (with Gumbel noise), kept.

    Features are words and adjacent pairs hashed into `buckets`. The raw model is fitted on every document, the target model on
    those labelled good (bounded, see Model); log_ratio is the log of the text's likelihood under the target model over that under the
    raw one, the sum of log(target / raw). Gumbel noise that depends on id and seed makes the k largest scores a sample without replacement in proportion to the exponential of log_ratio / temperature.
    k is the share of all rows, rounded up. Only models, of fixed size, and histogram counts pass through the driver.

    Null or blank text has log_ratio 0 and no n-grams. A null id gets the noise of its own hash; rows that repeat have equal
    scores, and of equal scores at the boundary those with the smallest ids are kept (null last), of one id's rows as many as fit: k rows in all.
    Empty docs give an empty result; without good labels the target is the raw model, so that noise decides alone.
    Null labels are ignored. Other columns don't matter.
    """
    spark = docs.sparkSession
    order = F.xxhash64("doc_id")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    share = model.share if model.share is not None else known.agg(F.coalesce(F.avg((F.col("quality") == 1).cast("int")), F.lit(1.0))).first()[0]
    good = known.filter("quality = 1").select("doc_id").distinct()
    total = good.count()
    if total > model.target_rows:  # a bounded number of ids, picked by their hash
        good = good.orderBy(order, "doc_id").limit(model.target_rows)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = base.join(F.broadcast(good.select(F.col("doc_id").alias("id"), F.lit(True).alias("t"))), "id", "left")
    raw, target = _counts(marked.select("text", F.coalesce("t", F.lit(False)).alias("t")), model.buckets)
    if not target.sum():
        target = raw
    smooth = lambda c: np.log(c + model.smoothing) - np.log(c.sum() + model.smoothing * model.buckets)
    table = spark.sparkContext.broadcast((smooth(target) - smooth(raw)).astype(np.float32))
    buckets = model.buckets

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for a, b in pieces(offsets, 4 << 20):
                bucket, row = ngram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                n[a:b] += np.bincount(row, minlength=b - a)
                total[a:b] += np.bincount(row, weights=ratio[bucket].astype(np.float64), minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.round(total, 9))], names=["id", "n_grams", "log_ratio"])

    rows = base.mapInArrow(score, f"id {dict(base.dtypes)['id']}, n_grams long, log_ratio double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(model.seed), "id"), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = stash(rows.withColumn("score", F.col("log_ratio") - F.lit(model.temperature) * F.log(-F.log(uniform))).withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    k = int(np.ceil(share * rows.count()))
    if not k:
        return rows.select(F.col("id").alias(id_col), "n_grams", "log_ratio", "score", F.lit(False).alias("kept"))
    bound, ties = kth_largest(rows, k)
    # Of rows with just that score: whole ids in order, and of the last id as many rows as are left, in the order of their numbers.
    same = rows.filter(F.col("score") == bound)
    order = Window.orderBy(F.asc_nulls_last("id"))
    ids = same.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("id")).limit(ties)
    last = ids.withColumn("upto", F.sum("n").over(order)).filter(F.col("upto") - F.col("n") < ties).orderBy(F.desc("upto")).first()
    mine = F.col("id").eqNullSafe(F.lit(last["id"]))
    left, cut = ties - (last["upto"] - last["n"]), F.lit(True)
    if left < last["n"]:
        cut = F.col("row") <= -kth_largest(same.filter(mine).select((-F.col("row")).cast("double").alias("score")), left)[0]
    before = F.col("id").isNotNull() if last["id"] is None else F.col("id") < F.lit(last["id"])
    kept = (F.col("score") > bound) | ((F.col("score") == bound) & (F.coalesce(before, F.lit(False)) | (mine & cut)))
    return rows.select(F.col("id").alias(id_col), "n_grams", "log_ratio", "score", F.coalesce(kept, F.lit(False)).alias("kept"))
