"""Correction of quoted spans to the best canonical passage."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profiles, similarity
from ..functions.tokens import words
from ..sources.tables import store
from . import verify
from .retrieve import dedupe_first, holding, postings, token_candidates, top_k

#: Fixed value: the in-band word for "no valid correction", written by sinks only; inside the engine it is null.
SENTINEL = "خطأ"


def exact_matches(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str) -> DataFrame:
    """(span, passage) of the first passage by id whose normalised text contains the span's, wherever the span begins and ends in it.

    Spans meet the corpus on their rarest gram only (retrieve.holding); texts of under three characters have no match.
    """
    q = spans.select(span_id, profiles.matcher_key(F.col(span_col)).alias("_q"))
    c = corpus.select(passage_id, profiles.matcher_key(F.col(passage_col)).alias("_c"))
    return holding(q, span_id, "_q", c, passage_id, "_c").groupBy(span_id).agg(F.min(passage_id).alias(passage_id))


def candidates(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str, share: float = 1 / 3, cap: int = 100, floor: float = 0.15, k: int = 20) -> DataFrame:
    """(span, passage, passage_col, similarity, match_type, rank): the passage that contains the span (C1) at 1.0; of spans without one, word candidates, at most `cap` by
    hits, scored by M1, the best k over `floor`. Ties by passage id."""
    exact = store(exact_matches(spans, span_id, span_col, corpus, passage_id, passage_col), "exact")
    settled = exact.join(corpus.select(passage_id, passage_col), passage_id).select(span_id, passage_id, passage_col, F.lit(1.0).alias("similarity"), F.lit("exact_normalized").alias("match_type"), F.lit(1).alias("rank"))
    q = spans.join(exact, span_id, "left_anti").select(span_id, profiles.matcher_key(F.col(span_col)).alias("_q"))
    c = corpus.select(passage_id, passage_col, profiles.matcher_key(F.col(passage_col)).alias("_c"))
    hits = token_candidates(q, span_id, F.array_distinct(words(F.col("_q"))), postings(c, passage_id, words(F.col("_c"))), passage_id, share, few=False)
    hits = top_k(hits, span_id, cap, F.desc("hits"), F.col(passage_id)).select(span_id, passage_id)
    scored = hits.join(q, span_id).join(c, passage_id).withColumn("similarity", similarity.sequence_ratio(F.col("_q"), F.col("_c")))
    best = top_k(scored.filter(F.col("similarity") >= floor), span_id, k, F.desc("similarity"), F.col(passage_id))
    return settled.unionByName(best.select(span_id, passage_id, passage_col, "similarity", F.lit("similarity").alias("match_type"), "rank"))


def fallback(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str, cap: int = 100, k: int = 20) -> DataFrame:
    """C4: (span, passage, similarity) by the composite of n-gram, phrase and containment scores over passages that share a word."""
    q = spans.withColumn("_q", profiles.matcher_key(F.col(span_col)))
    c = corpus.withColumn("_c", profiles.matcher_key(F.col(passage_col)))
    hits = token_candidates(q, span_id, F.array_distinct(words(F.col("_q"))), postings(c, passage_id, words(F.col("_c"))), passage_id, 0.0, few=False)
    hits = top_k(hits, span_id, cap, F.desc("hits"), F.col(passage_id)).select(span_id, passage_id)
    pairs = hits.join(q.select(span_id, "_q"), span_id).join(c.select(passage_id, "_c", passage_col), passage_id)
    pairs = pairs.withColumn("_j", similarity.ngram_jaccard(F.col("_q"), F.col("_c"))).withColumn("_p", similarity.phrase_score(F.col("_q"), F.col("_c"))).withColumn("_in", similarity.containment(F.col("_q"), F.col("_c")))
    score, keep = similarity.fallback_composite(F.col("_j"), F.col("_p"), F.col("_in"))
    return top_k(pairs.withColumn("similarity", score).filter(keep), span_id, k, F.desc("similarity"), F.col(passage_id)).select(span_id, passage_id, passage_col, "similarity", "rank")


def unite(span_id: str, passage_id: str, threshold: float, first: DataFrame, *others: DataFrame, k: int = 10) -> DataFrame:
    """The union of strategies, the best row of each (span, passage), k of each span. `others` count only where the first's best is under the threshold."""
    settled = first.filter(F.col("similarity") >= threshold).select(span_id).distinct()
    rows = first.select(span_id, passage_id, "similarity")
    for o in others:
        rows = rows.unionByName(o.join(settled, span_id, "left_anti").select(span_id, passage_id, "similarity"))
    best = dedupe_first(rows, F.struct(span_id, passage_id), F.desc("similarity"))
    return top_k(best, span_id, k, F.desc("similarity"), F.col(passage_id))


def matches(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str, threshold: float, run: tuple[str, str] | None = None, score=None, sure: float = 0.95, k: int = 10) -> DataFrame:
    """(span, passages, text, similarity, match_type, rerank_score, rank): what all strategies find, the best k of each span.

    Strategies: single passages (C1, C2); with run, the names of the corpus's group and number columns, consecutive passages as one text (C3); and, for spans whose
    best single passage is under the threshold, or that have neither, the composite of the fallback (C4). passages is an array of ids, and what
    several strategies find of equal passages is one row, the most similar. In order of similarity, then fewer passages, then ids.

    score(span, text), a column: spans with several rows and none of `sure` or more are ordered anew by its blend with the similarity (C6, M14), from
    their first 30 rows. Without a score the order stays (rerank_score null).
    """
    of = lambda df, ids, text, kind: df.select(span_id, ids.alias("passages"), F.col(text).alias("text"), "similarity", kind.alias("match_type"))
    single = store(candidates(spans, span_id, span_col, corpus, passage_id, passage_col), "single")
    rows = of(single, F.array(passage_id), passage_col, F.col("match_type"))
    met = single.filter((F.col("rank") == 1) & (F.col("similarity") >= threshold)).select(span_id)
    if run:
        cross = store(cross_passages(spans, span_id, span_col, corpus, *run, passage_col, threshold, id_col=passage_id), "cross")
        rows = rows.unionByName(of(cross, F.col("ids"), "correction", F.lit("cross_passage")))
        met = met.unionByName(cross.join(single, span_id, "left_anti").select(span_id)).distinct()
    weak = fallback(spans.join(met, span_id, "left_anti"), span_id, span_col, corpus, passage_id, passage_col)
    rows = rows.unionByName(of(weak, F.array(passage_id), passage_col, F.lit("fallback")))
    rows = dedupe_first(rows, F.struct(span_id, "passages"), F.desc("similarity"), F.col("match_type"))
    order = (F.desc("similarity"), F.size("passages"), F.col("passages"))
    if score is None:
        return top_k(rows.withColumn("rerank_score", F.lit(None).cast("double")), span_id, k, *order)
    first = top_k(rows, span_id, 30, *order).withColumns({"_best": F.max("similarity").over(Window.partitionBy(span_id)), "_n": F.count("*").over(Window.partitionBy(span_id))})
    again = (F.col("_best") < sure) & (F.col("_n") > 1)
    first = first.join(spans.select(span_id, F.col(span_col).alias("_s")), span_id).withColumn("rerank_score", F.when(again, score(F.col("_s"), F.col("text"))))
    final = F.coalesce(similarity.blend(F.col("similarity"), F.col("rerank_score"), 0.6), F.col("similarity"))
    return top_k(first.withColumn("_final", final).drop("rank"), span_id, k, F.desc("_final"), *order).select(span_id, "passages", "text", "similarity", "match_type", "rerank_score", "rank")


def rerank(rows: DataFrame, span_id: str, score: Column, alpha: float = 0.6, k: int = 10) -> DataFrame:
    """Order by the blend of similarity and any score column (a model's, or a rule's)."""
    return top_k(rows.drop("rank").withColumn("rerank_score", score).withColumn("final", similarity.blend(F.col("similarity"), F.col("rerank_score"), alpha)), span_id, k, F.desc("final"), F.desc("similarity"))


def decide(spans: DataFrame, span_id: str, ranked: DataFrame, passage_col: str, threshold: float | Column) -> DataFrame:
    """The first candidate's text if its own similarity reaches the threshold, or its rerank score is over 0.5; else null."""
    top = ranked.filter("rank = 1")
    ok = F.col("similarity") >= threshold
    ok = ok | (F.col("rerank_score") > 0.5) if "rerank_score" in ranked.columns else ok
    return spans.join(top.select(span_id, F.when(ok, F.col(passage_col)).alias("correction"), "similarity"), span_id, "left")


def decide_parts(parts: DataFrame, span_id: str, part: str, correction: str, number: str | None) -> DataFrame:
    """(span, correction, confidence, n_parts): the corrections of a span's parts joined in order, each with its number in parentheses if there are several and numbers; unmatched
    parts drop, confidence is the least."""
    no = F.col(number).cast("string") if number else F.lit(None).cast("string")
    found = parts.filter(F.col(correction).isNotNull()).groupBy(span_id).agg(F.array_sort(F.collect_list(F.struct(F.col(part).alias("i"), F.col(correction).alias("t"), no.alias("n")))).alias("_p"), F.min("similarity").alias("confidence"))
    numbered = F.array_join(F.transform("_p", lambda x: F.concat(x["t"], F.coalesce(F.concat(F.lit("("), x["n"], F.lit(")")), F.lit("")))), " ")
    return found.select(span_id, F.when(F.size("_p") == 1, F.col("_p")[0]["t"]).otherwise(numbered).alias("correction"), "confidence", F.size("_p").alias("n_parts"))


def threshold_of(source: Column, verse: float = 0.85, narration: float = 0.75) -> Column:
    """By source; other names than the two kinds are an error."""
    kind = F.lower(source)
    return F.when(F.contains(kind, F.lit("ayah")), verse).when(F.contains(kind, F.lit("hadith")), narration).otherwise(F.raise_error(F.concat(F.lit("unknown span type "), F.coalesce(source, F.lit("null")))).cast("double"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def word_blocks(words_: pd.Series, reference: pd.Series) -> pd.Series:
    """M2: [start, stop) in the reference's words from the first to the last block of equal words, aligned without autojunk; null without any."""

    def one(a, b) -> list[int] | None:
        if a is None or b is None:
            return None
        blocks = [m for m in SequenceMatcher(None, list(a), list(b), False).get_matching_blocks() if m.size]
        return [blocks[0].b, blocks[-1].b + blocks[-1].size] if blocks else None

    return pd.Series([one(a, b) for a, b in zip(words_, reference, strict=True)])


def crop(prediction: Column, passage: Column) -> Column:
    """The passage's own words from the first to the last that the prediction's blocks meet, both compared without marks (N11); words that
    are marks only drop. The whole passage where nothing meets."""
    kept = F.filter(words(passage), lambda w: F.length(profiles.collapse(profiles.bare(w))) > 0)
    found = word_blocks(words(profiles.bare(prediction)), F.transform(kept, profiles.bare))
    return F.when(found.isNull(), passage).otherwise(F.array_join(F.slice(kept, found[0] + 1, found[1] - found[0]), " "))


def snap(prediction: Column, passage: Column, low: float = 0.7, high: float = 1.3) -> Column:
    """The whole passage where the prediction is about as long without marks (N11), else the crop. Null without a passage."""
    clean = profiles.drop_lone_marker(verify.stripped(prediction))
    near = (F.length(profiles.bare(clean)) / F.greatest(F.lit(1), F.length(profiles.bare(passage)))).between(low, high)
    # Null: the pair is not aligned.
    return F.when(near, passage).otherwise(F.coalesce(crop(F.when(~near, clean), F.when(~near, passage)), passage))


def consecutive_runs(passages: DataFrame, group: str, number: str, text_col: str, least: int = 2, most: int = 5, id_col: str | None = None) -> DataFrame:
    """(group, first, n, ids, plain, joined): `least` to `most` passages whose numbers follow each other without a gap; ids: of id_col, else the numbers; plain with
    spaces and joined with each number in parentheses."""
    w = Window.partitionBy(group).orderBy(number)
    # Numbers without a gap differ from their rank by one constant.
    solid = passages.withColumn("_solid", F.col(number) - F.row_number().over(w))
    ahead = F.collect_list(F.struct(F.col(number).alias("i"), F.col(text_col).alias("t"), F.col(id_col or number).alias("d"))).over(Window.partitionBy(group, "_solid").orderBy(number).rowsBetween(0, most - 1))
    runs = solid.withColumn("_a", ahead).filter(F.size("_a") >= least)
    runs = runs.select(group, F.col(number).alias("first"), F.explode(F.transform(F.sequence(F.lit(least), F.size("_a")), lambda k: F.slice("_a", 1, k))).alias("_r"))
    joined = F.transform("_r", lambda x: F.concat(x["t"], F.lit("("), x["i"].cast("string"), F.lit(")")))
    return runs.select(group, "first", F.size("_r").alias("n"), F.col("_r.d").alias("ids"), F.array_join(F.transform("_r", lambda x: x["t"]), " ").alias("plain"), F.array_join(joined, " ").alias("joined"))


def cross_passages(spans: DataFrame, span_id: str, span_col: str, passages: DataFrame, group: str, number: str, text_col: str, threshold: float = 0.85, starts: int = 30, k: int = 5, id_col: str | None = None) -> DataFrame:
    """(span, group, first, n, similarity, rank, ids, correction): runs of two to five passages as one text.

    A run starts at one of the `starts` passages that share most of the span's first eight words (a quarter of them at least, words of two
    characters and more); spans of under four words have none. The best k by similarity, then fewer passages (O2); ties by place.
    """
    q = spans.select(span_id, profiles.matcher_key(F.col(span_col)).alias("_q")).withColumn("_w", words(F.col("_q"))).filter(F.size("_w") >= 4)
    search = F.slice("_w", 1, 8)
    need = F.greatest(F.lit(1), F.floor(F.size(search) / 4))
    asked = q.select(span_id, need.alias("_need"), F.explode(search).alias("token")).filter(F.length("token") >= 2)
    held = passages.select(group, F.col(number).alias("first"), F.explode(F.array_distinct(words(profiles.matcher_key(F.col(text_col))))).alias("token"))
    hits = asked.join(held, "token").groupBy(span_id, "_need", group, "first").agg(F.count("*").alias("_hits")).filter(F.col("_hits") >= F.col("_need"))
    hits = top_k(hits, span_id, starts, F.desc("_hits"), F.col(group), F.col("first")).select(span_id, group, "first")
    runs = consecutive_runs(passages, group, number, text_col, id_col=id_col)
    keyed = consecutive_runs(passages.withColumn(text_col, profiles.matcher_key(F.col(text_col))), group, number, text_col).select(group, "first", "n", F.col("plain").alias("_c"))
    pairs = hits.join(keyed, [group, "first"]).join(q.select(span_id, "_q"), span_id)
    # A ratio of at least the threshold needs lengths that allow it.
    bound = 2 * F.least(F.length("_q"), F.length("_c")) / (F.length("_q") + F.length("_c"))
    pairs = pairs.filter(bound >= threshold - 1e-9).withColumn("similarity", similarity.sequence_ratio(F.col("_q"), F.col("_c"))).filter(F.col("similarity") >= threshold)
    best = top_k(pairs, span_id, k, F.desc("similarity"), F.col("n"), F.col(group), F.col("first")).select(span_id, group, "first", "n", "similarity", "rank")
    return best.join(runs.select(group, "first", "n", "ids", F.col("joined").alias("correction")), [group, "first", "n"])


def canonical(predictions: DataFrame, key: str, prediction: str, corpus: DataFrame, passage_id: str, passage_col: str, verse: bool = True, floor: float = 0.55, plain_col: str | None = None) -> DataFrame:
    """(key, passage, passage_col, similarity) of the passage nearest to a prediction, null under `floor`; ties by id.

    Both sides are compared without marks (N11); plain_col: the corpus's column that has its texts so, where that isn't passage_col without marks, as for
    runs of neighbours (retrieve.adjacent_passages), the corpus for verses. Candidates share max(2, a quarter) of a prediction's distinct words with it as
    verses and 30 % in any case; both are counts of an equi-join, so narrations need no loop over the corpus either: 30 % of some words is at
    least one of them. Blank predictions and the sentinel have none.
    """
    p = predictions.filter(F.trim(prediction) != SENTINEL).select(key, profiles.bare(verify.stripped(F.col(prediction))).alias("_q"))
    p = p.withColumn("_w", F.array_distinct(words(F.col("_q")))).filter(F.size("_w") > 0)
    c = corpus.select(passage_id, passage_col, (F.col(plain_col) if plain_col else profiles.bare(F.col(passage_col))).alias("_c"))
    held = c.select(passage_id, F.explode(F.array_distinct(words(F.col("_c")))).alias("token"))
    hits = p.select(key, F.size("_w").alias("_n"), F.explode("_w").alias("token")).join(held, "token").groupBy(key, "_n", passage_id).agg(F.count("*").alias("_hits"))
    least = F.greatest(F.lit(2), F.floor(F.col("_n") / 4)) if verse else F.lit(1)
    hits = hits.filter((F.col("_hits") >= least) & (F.col("_hits") / F.col("_n") >= 0.30)).select(key, passage_id)
    pairs = hits.join(p.select(key, "_q"), key).join(c, passage_id)
    bound = 2 * F.least(F.length("_q"), F.length("_c")) / (F.length("_q") + F.length("_c"))
    pairs = pairs.filter(bound >= floor - 1e-9).withColumn("similarity", similarity.sequence_ratio(F.col("_q"), F.col("_c"))).filter(F.col("similarity") >= floor)
    best = pairs.groupBy(key).agg(F.min_by(F.struct(passage_id, passage_col, "similarity"), F.struct(-F.col("similarity"), F.col(passage_id))).alias("_b"))
    return predictions.select(key).join(best.select(key, "_b.*"), key, "left")


def snapped(predictions: DataFrame, key: str, prediction: str, corpus: DataFrame, passage_id: str, passage_col: str, verse: bool = True, plain_col: str | None = None) -> DataFrame:
    """(key, correction): a prediction, without a lone marker at its end (N17), snapped to its canonical passage; null, the sinks' sentinel, where it has none."""
    clean = predictions.select(key, profiles.drop_lone_marker(verify.stripped(F.col(prediction))).alias("_clean"))
    near = canonical(clean, key, "_clean", corpus, passage_id, passage_col, verse, plain_col=plain_col)
    rows = clean.join(near.select(key, passage_col), key)
    return rows.select(key, F.when(F.col(passage_col).isNotNull(), snap(F.col("_clean"), F.col(passage_col))).alias("correction"))


def corrections(spans: DataFrame, span_id: str, span_col: str, kind_col: str, corpora: dict[str, DataFrame], passage_id: str, passage_col: str, thresholds: dict[str, float] | None = None, runs: dict[str, tuple[str, str]] | None = None, score=None) -> DataFrame:
    """(span, kind, correction, detail): a row for each span, its parts (P4) corrected each on its own by all strategies (C5) and joined.

    corpora: the passages of each kind; runs: of a kind the group and number columns by which its passages follow each other; score: as of matches(). A
    span of one part is settled by a similarity of its threshold or more, or else by a score over 0.5 (C7); a part of several by its similarity alone. detail:
    source, threshold, confidence, n_parts, passages (the ids of all parts' passages), match_type (multiple_parts for several), n_combined (the most
    passages that make up one part), is_cross, rerank_score (of one part). The correction is null, the sinks' sentinel, for blank spans, the
    sentinel itself and where nothing is settled.
    """
    thresholds = thresholds or {"Ayah": 0.85, "Hadith": 0.75}
    outs = []
    for kind, corpus in corpora.items():
        mine = spans.filter((F.col(kind_col) == kind) & (F.trim(span_col) != "") & (F.trim(span_col) != SENTINEL))
        parts = mine.select(span_id, verify.split_parts(verify.stripped(F.col(span_col))).alias("_all"))
        parts = parts.select(span_id, F.size("_all").alias("_n"), F.posexplode("_all").alias("_i", "_part")).withColumn("part_key", F.struct(span_id, "_i"))
        run = (runs or {}).get(kind)
        first = matches(parts.select("part_key", "_part"), "part_key", "_part", corpus, passage_id, passage_col, thresholds[kind], run, score).filter("rank = 1")
        rows = store(parts.join(first, "part_key").filter((F.col("similarity") >= thresholds[kind]) | (F.col("_n") == 1) & (F.coalesce("rerank_score", F.lit(0.0)) > 0.5)), "settled")
        number = passage_id if kind == "Ayah" else None
        if run:
            rows = rows.join(corpus.select(F.col(passage_id).alias("_id"), F.col(run[1]).alias("_no")), F.col("passages")[0] == F.col("_id"), "left")
            number = "_no" if kind == "Ayah" else None
        done = decide_parts(rows.withColumn(passage_id, F.col("passages")[0]), span_id, "_i", "text", number)
        facts = rows.groupBy(span_id).agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "passages"))), lambda x: x["passages"])).alias("passages"), F.min_by("match_type", "_i").alias("_kind"),
            F.max(F.size("passages")).alias("n_combined"), F.min_by("rerank_score", "_i").alias("_score"),
        )
        one = F.col("n_parts") == 1
        detail = F.struct(
            F.lit("quran" if kind == "Ayah" else "hadith").alias("source"), F.lit(thresholds[kind]).alias("threshold"), "confidence", "n_parts", "passages",
            F.when(one, F.col("_kind")).otherwise("multiple_parts").alias("match_type"), "n_combined", (F.col("n_combined") > 1).alias("is_cross"), F.when(one, F.col("_score")).alias("rerank_score"),
        )
        outs.append(done.join(facts, span_id).select(span_id, "correction", detail.alias("detail")))
    found = outs[0]
    for o in outs[1:]:
        found = found.unionByName(o)
    return spans.select(span_id, F.col(kind_col).alias("kind")).join(found, span_id, "left")
