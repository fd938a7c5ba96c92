"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, exact_dedup, importance, jaccard, merkle, packing, periodic, quality_rules, sharding, suffix_dedup, url_filter, warc
from .sql import SQL  # noqa: F401


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, carry={"text_sha256": F.sha2(common.whole("text").cast("binary"), 256)})


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard (the least doc_id that it holds), its rows, the version: documents after four arrivals have been committed and their shards compacted."""
    tiers = sharding.Tiers(target_bytes=32 << 20)
    store = sharding.shard(common.read(spark, sf_dir, "documents"), f"{common.scratch(spark)}/shards-{uuid.uuid4().hex}", tiers, arrivals=4)
    rows = store.read().select("doc_id", F.col(store.shard_col()).alias("file"), F.octet_length(common.whole("text")).cast("long").alias("n_bytes"))
    files = rows.groupBy("file").agg(F.min("doc_id").alias("shard"), F.count("*").alias("shard_rows"))
    few = len(store.manifest()["shards"]) <= 20_000  # rows of some 100 bytes
    return rows.join(F.broadcast(files) if few else files, "file").drop("file").withColumn("version", F.lit(store.version()))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.bpe_encode(common.read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    tokens = tokens.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"))
    return bpe.bpe_decode(tokens, path, keep=("n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(common.read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(common.read(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(common.read(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark)).drop("url")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(common.read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: items of which some window's words all stand at most one place off, exact occurrences included."""
    rows = decontaminate.decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), slop=1)
    count = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", "n_words", "n_hit", count("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", count("near").alias("n_near"))


#: The words of a text from a on repeat with period p, for a tenth of the documents by the checksum of their ids.
_WORDS = r"array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')"
_REPEATED = f"""CASE WHEN _h % 10 = 0 THEN transform(array(named_struct('w', {_WORDS}, 'g', _h div 10)), x -> CASE WHEN size(x.w) = 0 THEN '' ELSE
  transform(array(named_struct('w', x.w, 'a', cast(x.g % size(x.w) AS int), 'p', cast(1 + (size(x.w) - x.g % size(x.w)) div (3 + x.g % 8) AS int))), y ->
    array_join(concat(slice(y.w, 1, y.a), transform(sequence(y.a, size(y.w) - 1), i -> y.w[y.a + (i - y.a) % y.p])), ' '))[0] END)[0] ELSE text END"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = periodic.periodic_runs(docs.select("doc_id", F.expr(_REPEATED).alias("text")))
    # Runs are in the order of start and period, so the first of equal exponents stays.
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> CASE WHEN r.length * b.period > b.length * r.period THEN r ELSE b END)")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = rows.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document by the checksum of its id has its text's A-Z lower-cased when its digest is folded."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower)}
    return merkle.proofs(merkle.manifest(common.read(spark, sf_dir, "documents"), claimed=claimed))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_byte_bpe, op4_suffix_dedup, op5_warc, op6_jaccard, op7_importance, op8_url_filter, op9_packing, op10_quality_rules, op11_decontamination, op12_periodic_runs, op13_merkle_manifest)}
