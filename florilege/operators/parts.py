"""Verification of spans that may hold several parts: narrations, verses, and the dispatch between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles, similarity
from ..functions.tokens import words
from . import verify
from .retrieve import small

#: What separates narrations within a span.
NARRATION_SEPARATORS = r"[*،؛\n]|\s*\((?U:\d)+\)\s*|(?U:\s)+و(?U:\s)+|(?U:\s)+ثم(?U:\s)+"
LEAST_PART = 5


def narration_candidates(spans: DataFrame, span_id: str, key: str, corpus: DataFrame, passage_id: str, passage_key: str, enough: int = 1000, most: int = 500) -> DataFrame:
    """(span, passage): passages that share a word of three characters, the words taken in order until over `enough` passages are found; the first `most` by id.

    Of spans over 20 words the first 15 words are taken. The stop is told from where each passage is first met, without a loop. A word that is in
    over `enough` passages ends its span's search by itself, so no later word is looked up, and of its passages the first `most` by id are all that
    can be among the span's: a span meets at most `enough` passages a word and once `most`, however common its words are. In a corpus of at most
    `enough` rows no search stops, and the first `most` by id of each word are all that can be among a span's, so nothing else is looked up.
    """
    w = words(F.col(key))
    taken = F.when(F.size(w) > 20, F.slice(w, 1, 15)).otherwise(w)
    q = spans.select(span_id, F.posexplode(taken).alias("_at", "token")).filter(F.length("token") >= 3)
    c = corpus.select(passage_id, F.explode(F.array_distinct(words(F.col(passage_key), 3))).alias("token"))
    place = F.row_number().over(Window.partitionBy(span_id).orderBy(passage_id))
    if corpus.count() <= enough:
        asked = q.select("token").distinct()
        c = c.join(F.broadcast(asked) if small(asked) else asked, "token", "left_semi")
        heads = c.withColumn("_r", F.dense_rank().over(Window.partitionBy("token").orderBy(passage_id))).filter(F.col("_r") <= most).select("token", passage_id)
        met = q.select(span_id, "token").join(heads, "token").select(span_id, passage_id).distinct()
        return met.withColumn("_r", place).filter(F.col("_r") <= most).select(span_id, passage_id)
    often = c.groupBy("token").agg(F.count_distinct(passage_id).alias("_df")).filter(F.col("_df") > enough).select("token", F.lit(True).alias("_often"))
    q = q.join(often, "token", "left").withColumn("_end", F.min(F.when(F.col("_often"), F.col("_at"))).over(Window.partitionBy(span_id))).filter("_end IS NULL OR _at <= _end")
    heads = c.join(often, "token", "left_semi").withColumn("_r", F.dense_rank().over(Window.partitionBy("token").orderBy(passage_id))).filter(F.col("_r") <= most).select("token", passage_id)
    seldom = q.filter("_often IS NULL").join(c.join(often, "token", "left_anti"), "token").select(span_id, passage_id, "_at")
    met = seldom.groupBy(span_id, passage_id).agg(F.min("_at").alias("_at"))
    upto = met.groupBy(span_id, "_at").agg(F.count("*").alias("_n")).withColumn("_n", F.sum("_n").over(Window.partitionBy(span_id).orderBy("_at")))
    stop = upto.filter(F.col("_n") > enough).select(span_id, F.col("_at").alias("_stop")).union(q.filter("_often").select(span_id, "_at")).groupBy(span_id).agg(F.min("_stop").alias("_stop"))
    met = met.union(q.filter("_often").join(heads, "token").select(span_id, passage_id, "_at")).groupBy(span_id, passage_id).agg(F.min("_at").alias("_at"))
    met = met.join(stop, span_id, "left").filter("_stop IS NULL OR _at <= _stop")
    return met.withColumn("_r", place).filter(F.col("_r") <= most).select(span_id, passage_id)


def verify_narrations(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str, threshold: float = 0.95) -> DataFrame:
    """V2: (span, is_match, similarity, passage, match_type): exact on normalised texts, else the best candidate: spans of up to eight
    words by containment (M8) or windows (M9), longer ones by the sequence ratio (M1). The bound adapts to words and kind of match (M10). Ties by id.
    """
    q = spans.select(span_id, profiles.narration_key(F.col(span_col)).alias("_q"))
    c = corpus.select(passage_id, profiles.narration_key(F.col(passage_col)).alias("_c")).filter("_c != ''")
    exact = q.join(c.groupBy("_c").agg(F.min(passage_id).alias(passage_id)), F.col("_q") == F.col("_c")).select(span_id, F.lit(1.0).alias("similarity"), passage_id, F.lit("exact").alias("match_type"))
    rest = q.join(exact, span_id, "left_anti").filter("_q != ''")
    pairs = narration_candidates(rest, span_id, "_q", c, passage_id, "_c").join(rest, span_id).join(c, passage_id).withColumn("_n", F.size(words(F.col("_q"))))
    kind = F.when(F.col("_n") > 8, "full_similarity").when(F.contains("_c", "_q"), "substring").otherwise("fuzzy_substring")
    pairs = pairs.withColumn("match_type", kind)
    of = lambda k: F.when(F.col("match_type") == k, F.col("_c"))  # noqa: E731  # null: the measure doesn't run
    score = F.greatest(F.when(F.col("match_type") == "substring", similarity.substring_score(F.col("_q"), F.col("_c"))).otherwise(0.0), similarity.window_score(F.col("_q"), of("fuzzy_substring")), similarity.sequence_ratio(F.col("_q"), of("full_similarity")))
    pairs = pairs.withColumn("similarity", score).filter("similarity > 0")
    best = pairs.groupBy(span_id, "_n").agg(F.min_by(F.struct("similarity", passage_id, "match_type"), F.struct(-F.col("similarity"), F.col(passage_id))).alias("_b"))
    best = best.filter(F.col("_b.similarity") >= similarity.adaptive_threshold(threshold, F.col("_n"), F.col("_b.match_type")))
    found = exact.unionByName(best.select(span_id, "_b.similarity", f"_b.{passage_id}", "_b.match_type"))
    return spans.select(span_id).join(found, span_id, "left").select(span_id, F.col("match_type").isNotNull().alias("is_match"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), passage_id, "match_type")


def narration_parts(span: Column) -> Column:
    """V7's split; parts that are blank drop."""
    return F.filter(F.transform(F.split(span, NARRATION_SEPARATORS), profiles.collapse), lambda p: p != "")


def verify_parts(spans: DataFrame, span_id: str, parts: Column, verifier, corpus: DataFrame, passage_id: str, passage_col: str, strategy: str = "any", least: int = 0) -> DataFrame:
    """V5, V7: (span, n_parts, n_matched, similarity, is_match): each part by `verifier` (V1, V2), the verdict by V6. Parts shorter than `least` count, but are never verified."""
    cut = spans.select(span_id, F.posexplode_outer(parts).alias("_i", "_part")).withColumn("_key", F.struct(span_id, "_i"))
    judged = cut.filter(F.length("_part") >= max(1, least))
    known = verifier(judged.select("_key", "_part"), "_key", "_part", corpus, passage_id, passage_col).select("_key", "is_match", "similarity")
    rows = cut.join(known, "_key", "left").groupBy(span_id).agg(F.count("_part").alias("n_parts"), F.count_if(F.coalesce("is_match", F.lit(False))).alias("n_matched"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"))
    return rows.withColumn("is_match", verify.strategy_vote(F.col("n_matched"), F.col("n_parts"), strategy))


def verify_spans(spans: DataFrame, span_id: str, span_col: str, kind_col: str, verses: DataFrame, narrations: DataFrame, passage_id: str, passage_col: str, strategy: str = "any") -> DataFrame:
    """V9: (span, kind, multi, n_parts, n_matched, similarity, is_match, error): verses by V1 or V5, narrations by V2 or V7, as P1 finds one part or several; other kinds get an error text, no verdict."""
    rows = spans.withColumn("_multi", verify.multi_text(F.col(span_col), F.col(kind_col)))
    outs = []
    for kind, single, split, corpus, least in (("Ayah", verify.verify_verses, verify.separate_verses, verses, 0), ("Hadith", verify_narrations, narration_parts, narrations, LEAST_PART)):
        mine = rows.filter(F.col(kind_col) == kind)
        one = single(mine.filter("NOT _multi").select(span_id, span_col), span_id, span_col, corpus, passage_id, passage_col)
        outs.append(one.select(span_id, F.lit(1).cast("long").alias("n_parts"), F.col("is_match").cast("long").alias("n_matched"), "similarity", "is_match"))
        outs.append(verify_parts(mine.filter("_multi"), span_id, split(F.col(span_col)), single, corpus, passage_id, passage_col, strategy, least).select(outs[0].columns))
    found = outs[0].unionByName(outs[1]).unionByName(outs[2]).unionByName(outs[3])
    error = F.when(F.coalesce(F.col(kind_col), F.lit("")).isin("Ayah", "Hadith"), None).otherwise(F.concat(F.lit("unknown text type: "), F.coalesce(F.col(kind_col), F.lit("null"))))
    return rows.join(found, span_id, "left").select(span_id, F.col(kind_col).alias("kind"), F.col("_multi").alias("multi"), "n_parts", "n_matched", "similarity", "is_match", error.alias("error"))
