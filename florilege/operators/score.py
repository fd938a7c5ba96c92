"""Scores of predicted spans, verdicts and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocks(start: Column, stop: Column) -> Column:
    """[start, stop) as dyadic blocks (level, number): disjoint, at most two of a level; block number i of a level k is [i * 2**k, (i + 1) * 2**k)."""

    def level(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -start, k), F.call_function("shiftright", stop, k)
        odd = F.pmod(low, F.lit(2))
        block = lambda ok, i: F.when(ok, F.struct(k.alias("level"), i.cast("long").alias("at")))
        return F.array(block((odd == 1) & (low < high), low), block((F.pmod(high, F.lit(2)) == 1) & (high - 1 >= low + odd), high - 1))

    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.lit(0).cast("long"), stop - start))).cast("int"))
    return F.array_compact(F.flatten(F.transform(levels, level)))


def paint(spans: DataFrame, doc_id: str, label: str = "label", order: str = "span_no") -> DataFrame:
    """(doc, start, stop, label) stretches of one label, later spans over earlier ones; only boundaries are exploded, never characters.

    What covers a stretch between two boundaries is found by equality, not by comparing spans with stretches: a span is cut into dyadic blocks,
    two a level at most, and the latest span of a block covers all stretches inside it, which meet it as one of the blocks that hold
    their begin. So the work is spans and stretches times the levels of the longest span, in keys that spread over all tasks, also within one document.
    """
    s = spans.select(doc_id, F.col("span_start").cast("long").alias("_a"), F.col("span_end").cast("long").alias("_b"), F.struct(F.col(order).alias("o"), F.col(label).alias("l")).alias("_x")).filter("_a < _b")
    blocks = s.withColumn("_k", F.explode(_blocks(F.col("_a"), F.col("_b")))).groupBy(doc_id, F.col("_k.level").alias("_level"), F.col("_k.at").alias("_at")).agg(F.max("_x").alias("_x"))
    edges = s.select(doc_id, F.explode(F.array("_a", "_b")).alias("start")).distinct()
    cells = edges.withColumn("stop", F.lead("start").over(Window.partitionBy(doc_id).orderBy("start"))).filter("stop IS NOT NULL")
    highest = s.agg(F.max(F.length(F.bin(F.col("_b") - F.col("_a")))).cast("int").alias("_h"))  # one row
    held = cells.crossJoin(F.broadcast(highest)).withColumn("_level", F.explode(F.sequence(F.lit(0), "_h"))).drop("_h").withColumn("_at", F.call_function("shiftright", F.col("start"), F.col("_level")))
    hit = held.join(blocks, [doc_id, "_level", "_at"])
    return hit.groupBy(doc_id, "start", "stop").agg(F.max("_x").alias("_x")).select(doc_id, "start", "stop", F.col("_x.l").alias("label"))


def overlap_counts(gold: DataFrame, pred: DataFrame, lengths: DataFrame, doc_id: str, length: str) -> DataFrame:
    """(doc, gold label, predicted label, n): characters by label pair, Neither included by arithmetic. The stretches of a side don't overlap, as those of paint()."""

    def moves(side: DataFrame, name: str) -> DataFrame:
        """Where a side's label changes: to a label, or to Neither where no stretch begins at another's end."""
        ends = side.select(doc_id, F.col("start").alias("p"), F.col("label").alias("l")).unionByName(side.select(doc_id, F.col("stop").alias("p"), F.lit(None).cast("string").alias("l")))
        return ends.groupBy(doc_id, "p").agg(F.coalesce(F.max("l"), F.lit("Neither")).alias(name))

    w = Window.partitionBy(doc_id).orderBy("p")
    edges = moves(gold, "g").join(moves(pred, "r"), [doc_id, "p"], "full")
    now = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit("Neither"))
    both = edges.select(doc_id, "p", F.lead("p").over(w).alias("q"), now("g").alias("gold"), now("r").alias("pred")).filter("q IS NOT NULL AND (gold != 'Neither' OR pred != 'Neither')")
    counts = both.groupBy(doc_id, "gold", "pred").agg(F.sum(F.col("q") - F.col("p")).cast("long").alias("n"))
    known = counts.groupBy(doc_id).agg(F.sum("n").alias("_k"))
    rest = lengths.select(doc_id, F.col(length).alias("_len")).join(known, doc_id, "left").select(doc_id, F.lit("Neither").alias("gold"), F.lit("Neither").alias("pred"), (F.col("_len") - F.coalesce("_k", F.lit(0))).cast("long").alias("n"))
    return counts.unionByName(rest.filter("n > 0")).groupBy(doc_id, "gold", "pred").agg(F.sum("n").alias("n"))


def macro_f1(counts: DataFrame, doc_id: str) -> DataFrame:
    """(doc, macro_f1): mean F1 over the labels present in truth or prediction."""
    sides = counts.select(doc_id, F.explode(F.array_distinct(F.array("gold", "pred"))).alias("label"), "gold", "pred", "n")
    per = sides.groupBy(doc_id, "label").agg(
        F.sum(F.when((F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("gold") == F.col("label"), F.col("n")).otherwise(0)).alias("in_gold"),
        F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("in_pred"),
    )
    return per.groupBy(doc_id).agg(F.avg(2 * F.col("tp") / (F.col("in_gold") + F.col("in_pred"))).alias("macro_f1"))


def class_f1(counts: DataFrame, doc_id: str, labels: list[str]) -> DataFrame:
    """F1 of fixed classes, 0 where a class occurs on neither side."""
    aggs = []
    for c in labels:
        tp, g, p = (F.sum(F.when(cond, F.col("n")).otherwise(0)) for cond in ((F.col("gold") == c) & (F.col("pred") == c), F.col("gold") == c, F.col("pred") == c))
        aggs.append(F.coalesce(F.try_divide(2 * tp, g + p), F.lit(0.0)).alias(f"f1_{c.lower()}"))
    return counts.groupBy(doc_id).agg(*aggs)


def accuracy(rows: DataFrame, right: Column, kind: str) -> DataFrame:
    """Accuracy overall (kind null) and by kind, from one pass with grouping sets."""
    return rows.withColumn("_right", right).rollup(kind).agg(F.count("*").alias("n"), F.count_if("_right").alias("n_right"), F.avg(F.col("_right").cast("int")).alias("accuracy"))


def confusion(rows: DataFrame, gold: Column, pred: Column, *by: str, similarity: Column | None = None) -> DataFrame:
    """Counters and metrics of a binary verdict; rows with a null on either side count nowhere. Divisions by zero give 0. similarity: its mean over the rows that count, as mean_similarity, 0 without any."""
    base = rows.withColumns({"_g": gold, "_p": pred})
    mean = [] if similarity is None else [F.coalesce(F.avg(F.when(F.col("_g").isNotNull() & F.col("_p").isNotNull(), similarity)), F.lit(0.0)).alias("mean_similarity")]
    out = base.groupBy(*by).agg(*mean, *(F.count_if(c).alias(k) for k, c in (("tp", F.col("_g") & F.col("_p")), ("tn", ~F.col("_g") & ~F.col("_p")), ("fp", ~F.col("_g") & F.col("_p")), ("fn", F.col("_g") & ~F.col("_p")))))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return out.withColumns({"accuracy": safe(tp + tn, tp + tn + fp + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def correction_accuracy(refs: DataFrame, preds: DataFrame, key: str, corpus: DataFrame, passage_col: str, normal) -> DataFrame:
    """Right where equal after normalising, or where the prediction holds the reference and is itself a passage. A missing prediction is wrong; several are an error."""
    p = preds.groupBy(key).agg(F.first("prediction").alias("prediction"), F.count("*").alias("_n"))
    p = p.withColumn("prediction", F.when(F.col("_n") == 1, F.col("prediction")).otherwise(F.raise_error(F.lit("more than one prediction for a key")).cast("string")))
    known = corpus.select(normal(F.col(passage_col)).alias("_t")).distinct().withColumn("_in", F.lit(True))
    rows = refs.join(p.drop("_n"), key, "left").withColumns({"_r": normal(F.col("correction")), "_t": normal(F.col("prediction"))}).join(known, "_t", "left")
    return rows.select(key, F.coalesce((F.col("_r") == F.col("_t")) | (F.contains("_t", F.col("_r")) & F.coalesce("_in", F.lit(False))), F.lit(False)).alias("is_right"))


def official_scores(refs: DataFrame, preds: DataFrame, texts: DataFrame, key: str, length: str, inclusive: bool = False) -> DataFrame:
    """(key, score) for each question of refs: null where preds lack it, so that means leave it out.

    refs: key, span_no, label, span_start, span_end (end exclusive); preds: key, span_no, span_type, span_start, span_end. The first row decides: a reference
    of NoAnnotation scores 1 against No_Spans and 0 against spans; No_Spans against spans scores 0; else macro F1 over characters, later spans
    over earlier ones. Types other than Ayah, Hadith and No_Spans, bounds outside the text and ends before starts are errors. inclusive: ends of preds are the last character.
    """
    first = lambda df, c, name: df.groupBy(key).agg(F.min_by(c, "span_no").alias(name))
    known = F.col("span_type").isin("Ayah", "Hadith", "No_Spans")
    preds = preds.withColumn("span_type", F.when(known, F.col("span_type")).otherwise(F.raise_error(F.lit("span_type must be Ayah, Hadith or No_Spans")).cast("string")))
    heads = first(refs, "label", "_ref").join(first(preds, "span_type", "_pred"), key, "left")
    plain = F.when(F.col("_ref") == "NoAnnotation", (F.col("_pred") == "No_Spans").cast("double")).when(F.col("_pred") == "No_Spans", 0.0)
    heads = heads.withColumn("_plain", F.when(F.col("_pred").isNotNull(), plain))
    judged = heads.filter("_pred IS NOT NULL AND _plain IS NULL").select(key)
    end = F.col("span_end") + (1 if inclusive else 0)
    bounds = (F.col("span_start") >= 0) & (end <= F.col(length)) & (F.col("span_start") <= F.col("span_end"))
    p = preds.join(judged, key, "left_semi").join(texts.select(key, length), key).filter(F.col("span_type") != "No_Spans")
    p = p.withColumn("span_end", F.when(bounds, end).otherwise(F.raise_error(F.lit("a span's bounds lie outside its text")).cast("long")))
    g = refs.join(judged, key, "left_semi").filter(F.col("label").isin("Ayah", "Hadith"))
    counts = overlap_counts(paint(g, key), paint(p, key, "span_type"), texts.join(judged, key, "left_semi"), key, length)
    return heads.join(macro_f1(counts, key), key, "left").select(key, F.coalesce("_plain", "macro_f1").alias("score"))


def ensemble_f1(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """(key, macro_f1, f1_ayah, f1_hadith, f1_neither): a text is as long as its last span's end and one more character; equal sides score 1 for every class, absent ones too."""
    both = gold.select(key, "span_end").union(pred.select(key, "span_end"))
    lengths = both.groupBy(key).agg((F.max("span_end") + 1).alias("_len"))
    counts = overlap_counts(paint(gold, key), paint(pred, key), lengths, key, "_len")
    equal = counts.groupBy(key).agg((F.count_if(F.col("gold") != F.col("pred")) == 0).alias("_equal"))
    out = macro_f1(counts, key).join(class_f1(counts, key, ["Ayah", "Hadith", "Neither"]), key).join(equal, key)
    return out.select(key, "macro_f1", *(F.when(F.col("_equal"), 1.0).otherwise(F.col(c)).alias(c) for c in ("f1_ayah", "f1_hadith", "f1_neither")))


def composite_id(question: Column, start: Column, end: Column) -> Column:
    """question@start-end."""
    return F.concat(question, F.lit("@"), start.cast("string"), F.lit("-"), end.cast("string"))


def composite_accuracy(refs: DataFrame, preds: DataFrame, right, kind: str = "kind") -> DataFrame:
    """Accuracy overall (kind null) and by kind of refs (question, span_start, span_end, correction, kind) against preds (id, prediction); a missing prediction is wrong. Of several predictions of an id the last by text counts."""
    p = preds.groupBy("id").agg(F.max("prediction").alias("prediction"))
    rows = refs.withColumn("id", composite_id(F.col("question"), F.col("span_start"), F.col("span_end"))).join(p, "id", "left")
    return accuracy(rows, F.coalesce(right(F.col("correction"), F.col("prediction")), F.lit(False)), kind)


def rescored(rows: DataFrame, snapped: Column, gold: Column, kind: Column, verse_form, narration_form) -> DataFrame:
    """Accuracy overall and by kind, rounded to four places, of snapped corrections: narrations are compared in one form, verses in another."""
    right = F.when(kind == "Hadith", narration_form(gold) == narration_form(snapped)).otherwise(verse_form(F.trim(gold)) == verse_form(F.trim(snapped)))
    return accuracy(rows.withColumn("kind", kind), F.coalesce(right, F.lit(False)), "kind").withColumn("accuracy", F.round("accuracy", 4))
