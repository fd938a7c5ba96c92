"""A training corpus from documents: quality rules, exact dedup, near-duplicate groups, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import common, exact_dedup, jaccard, packing, quality_rules, suffix_dedup


def _hash() -> Column:
    return F.xxhash64(common.whole("text"))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, text_hash) names, with the columns of docs."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (_hash() == kept["_th"]), "left_semi")


def _one(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, text_hash) in kept, which has a row for each row of docs that it names.

    Only the texts of repeated rows are compared as whole rows, the least of which stays.
    """
    keys = common.stash(kept.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "pipeline-keys", common.plan_bytes(docs, 1 << 40))
    once, again = _only(docs, keys.filter("n = 1")), keys.filter("n > 1")
    few = again.limit(100_001).count()
    if not few:
        return once
    rows = _only(docs, F.broadcast(again) if few <= 100_000 else again)
    least = rows.groupBy("doc_id", _hash().alias("_th")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.unionByName(least.select("_row.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, whose cutoffs are certified on the labelled ones among them."""
    return _only(docs, quality_rules.quality_rules(docs, common.read(spark, sf_dir, "labels")).filter("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _one(docs, exact_dedup.exact_dedup(docs, carry={"text_hash": _hash()}).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates; of several with that id, or all without one, the one with the least text hash.

    Documents without words are in no group.
    """
    return _one(docs, jaccard.jaccard_groups(docs, first_col="first").filter("first"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 bytes or more that occur elsewhere; a character cut in two goes, and a document of which nothing is left."""
    rest = [c for c in docs.columns if c != "text"]
    out = suffix_dedup.remove_repeats(docs, keep=tuple(c for c in rest if c != "doc_id"), whole_chars=True)
    out = out.withColumn("text", F.col("kept").cast("string")).filter("n_removed = 0 OR text != ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words lie in sequences of the permitted lengths."""
    return packing.best_fit(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("suffix dedup", passages), ("packing", pack)]

#: SQL can't express suffix-array dedup and best-fit packing over whole tables at a bearable cost; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stash(docs, f"pipeline-{i}")
    return docs
