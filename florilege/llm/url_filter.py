"""URL filters by host-suffix and path-prefix expressions joined on short hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, else null) and verdict; one row per row.

    Each distinct (host, path) is expanded into the suffixes of the host at a dot, of the numbers of labels that rules have, times the path's prefixes of the lengths
    that rules have; expressions meet rules on 32 bits of their SHA-256, then the full digest must agree. The longest rule
    wins; of equally long ones that with the longer host, then `block` before `allow`. Without a rule: `default`.

    Distinct (host, path) pairs are made first, so a hot host or repeated URL is expanded once. Up to `broadcast_rules` rules
    (about 100 bytes each) the small side is broadcast, beyond that the join is shuffled and AQE splits hot expressions. The
    path lengths and numbers of labels of rules, at most one per possible value, are the only thing collected.

    A null URL, or one without ://, has empty host and path and fits no rule. Empty pages or empty rules give the
    default. Rules with a null host or path never fit; of repeated rules with opposite verdicts, block wins.
    Other columns of pages pass through; columns named host, path, rule or verdict are replaced.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.withColumns({"_h": host, "_p": path}).drop("host", "path", "rule", "verdict")
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv"), F.unhex(F.sha2(F.concat("host", F.lit("\n"), "path"), 256)).alias("_full")
    )
    rules = rules.withColumn("_short", F.substring("_full", 1, 4))
    lengths = sorted(r[0] for r in rules.select(F.length("_rp")).distinct().collect())
    few = rules.limit(broadcast_rules + 1).count() <= broadcast_rules

    urls = rows.select("_h", "_p").filter("_h != ''").distinct()
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."))) + 1
    counts = sorted(r[0] for r in rules.select(labels(F.col("_rh"))).distinct().collect())
    suffixes = F.array(*[F.when(labels(F.col("_h")) >= n, F.substring_index("_h", ".", -n)) for n in counts]) if counts else F.array().cast("array<string>")
    urls = urls.withColumn("_s", F.explode(F.array_compact(suffixes)))
    heads = F.array(*[F.when(F.length("_p") >= n, F.substring("_p", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    urls = urls.withColumn("_x", F.explode(F.array_compact(heads)))
    urls = urls.withColumn("_digest", F.unhex(F.sha2(F.concat("_s", F.lit("\n"), "_x"), 256))).withColumn("_short", F.substring("_digest", 1, 4))
    fits = urls.join(F.broadcast(rules) if few else rules, "_short").filter("_digest = _full")
    order = F.struct(F.length("_rh") + F.length("_rp"), F.length("_rh"), F.col("_rv") == "block")
    best = fits.groupBy("_h", "_p").agg(F.max_by(F.struct(F.concat("_rh", "_rp").alias("rule"), F.col("_rv").alias("verdict")), order).alias("_best"))
    out = rows.join(best, ["_h", "_p"], "left")
    return out.select(
        *(F.col(f"`{c}`") for c in rows.columns if c not in ("_h", "_p")), F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
