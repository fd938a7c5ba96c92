"""Registered queries of verification by parts, correction, answers, scores and summaries, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions.tokens import words
from ..operators import answers, correct, parts, report, retrieve, score, verify
from ..sources.tables import store
from ..streaming import resume
from .quotations import _DIAC, _KEY, _METRICS, _MKEY, _PAINT, _RULES, _VERB, _WORDS, metrics, passages, query, r6, ruled, verbatim, vowelled

#: Passages numbered within groups of four, as verses within a chapter.
_GROUPED = "SELECT item_id // 4 AS grp, item_id AS num, text FROM benchmark"


def grouped(t) -> DataFrame:
    return passages(t).select(F.floor(F.col("item_id") / 4).cast("long").alias("grp"), F.col("item_id").alias("num"), "passage")


def slices(t) -> DataFrame:
    """Of each passage its third to seventh word; those words each turned round, as what no passage holds; and the whole passage."""
    w = words(F.col("passage"))
    five = F.slice(w, 3, 5)
    forms = {"slice": F.array_join(five, " "), "turned": F.array_join(F.transform(five, lambda x: F.concat(F.reverse(x), F.reverse(x), F.reverse(x))), " "), "whole": F.col("passage")}
    return passages(t).select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), x.alias("span")) for k, x in forms.items()))).alias("f")).select("item_id", "f.form", "f.span")


_SLICES = f"""WITH w AS (SELECT item_id, text, {_WORDS.format('text')}[3:7] AS five FROM benchmark), s AS (SELECT item_id, 'slice' AS form, array_to_string(five, ' ') AS span FROM w
  UNION ALL SELECT item_id, 'turned', array_to_string(list_transform(five, lambda x: repeat(reverse(x), 3)), ' ') FROM w UNION ALL SELECT item_id, 'whole', text FROM w)"""


@query(_SLICES + f" SELECT item_id, form, EXISTS (FROM benchmark b WHERE contains({_KEY.format('b.text')}, {_KEY.format('s.span')})) AS is_match, EXISTS (FROM benchmark b WHERE {_KEY.format('b.text')} = {_KEY.format('s.span')}) AS exact FROM s")
def verify_narrations(t, spark):
    """V2 over whole passages (exact), stretches of five words of them (contained) and words that no passage has."""
    spans = slices(t).withColumn("key", F.struct("item_id", "form"))
    out = parts.verify_narrations(spans, "key", "span", passages(t), "item_id", "passage")
    return out.select("key.item_id", "key.form", "is_match", (F.coalesce(F.col("match_type"), F.lit("")) == "exact").alias("exact"))


@query(f"""WITH p AS (SELECT item_id, replace(text, chr(10), ' ') AS a, lead(replace(text, chr(10), ' ')) OVER (ORDER BY item_id) AS b FROM benchmark),
  s AS (SELECT item_id AS span_id, a AS span, CASE item_id % 3 WHEN 0 THEN 'Ayah' WHEN 1 THEN 'Hadith' ELSE 'Poem' END AS kind FROM p UNION ALL
   SELECT item_id + 1000000, a || ' * ' || b || ' * xyz', CASE item_id % 3 WHEN 0 THEN 'Ayah' WHEN 1 THEN 'Hadith' ELSE 'Poem' END FROM p WHERE b IS NOT NULL),
  m AS (SELECT *, contains(span, '*') OR (kind = 'Ayah' AND len({_WORDS.format('span')}) >= 50) AS multi FROM s)
  SELECT span_id, kind, multi, CASE WHEN kind = 'Poem' THEN NULL WHEN NOT multi THEN 1 WHEN kind = 'Ayah' THEN 0 ELSE 3 END::BIGINT AS n_parts,
   CASE WHEN kind = 'Poem' THEN NULL WHEN NOT multi THEN 1 WHEN kind = 'Ayah' THEN 0 ELSE 2 END::BIGINT AS n_matched, CASE WHEN kind != 'Poem' THEN NOT (multi AND kind = 'Ayah') END AS is_match, CASE WHEN kind = 'Poem' THEN 'unknown text type: Poem' END AS error FROM m""")
def verify_dispatch(t, spark):
    """V5, V7, V9: whole passages, and pairs of them with a third part too short to be one; a third of them of a kind that nothing verifies."""
    p = passages(t).select("item_id", F.replace("passage", F.lit("\n"), F.lit(" ")).alias("a"))
    flat = p.select("item_id", F.col("a").alias("passage"))
    kind = F.element_at(F.array(*map(F.lit, ("Ayah", "Hadith", "Poem"))), (F.col("item_id") % 3 + 1).cast("int")).alias("kind")
    after = p.withColumn("b", F.lead("a").over(Window.orderBy("item_id")))  # the benchmark's few passages
    spans = p.select(F.col("item_id").alias("span_id"), F.col("a").alias("span"), kind).union(after.filter("b IS NOT NULL").select(F.col("item_id") + 1000000, F.concat("a", F.lit(" * "), "b", F.lit(" * xyz")), kind))
    return parts.verify_spans(spans, "span_id", "span", "kind", flat, flat, "item_id", "passage").drop("similarity")


_CLASS = {"forbidden": r"*()\[\]{}﴾﴿\"«»", "end": r".,،;؛:؞؍!؟?﴾﴿)\]}…", "blocks": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"}
_ISSUES = f"""WITH s AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations), i AS (SELECT conv_id, turn, CASE WHEN t = '' THEN ['empty_or_whitespace'] ELSE list_filter([
  CASE WHEN NOT regexp_matches(t, '^[{_CLASS['blocks']}\\s]') THEN 'starts_with_non_arabic' END, CASE WHEN NOT regexp_matches(t, '[{_CLASS['blocks']}\\s]$') THEN 'ends_with_non_arabic' END,
  CASE WHEN regexp_matches(t, '[{_CLASS['forbidden']}]') THEN 'contains_forbidden_chars' END, CASE WHEN regexp_matches(t, '[{_CLASS['end']}]$') THEN 'ends_with_forbidden_punctuation' END,
  CASE WHEN contains(t, '*') THEN 'contains_verse_separator' END, CASE WHEN regexp_matches(t, '[()\\[\\]{{}}﴾﴿]') THEN 'contains_delimiters' END, CASE WHEN regexp_matches(t, '["«»]') THEN 'contains_quotes' END,
  CASE WHEN regexp_matches(t, '[^{_CLASS['blocks']}\\s{_CLASS['forbidden']}]') THEN 'contains_non_arabic_chars' END, CASE WHEN contains(t, '  ') THEN 'excessive_whitespace' END], lambda x: x IS NOT NULL) END AS issues FROM s)"""


@query(_ISSUES + " SELECT conv_id, turn, unnest(issues) AS issue FROM i")
def issue_codes(t, spark):
    return t("conversations").select("conv_id", "turn", F.explode(verify.issues(F.col("text"))).alias("issue"))


@query(_ISSUES + " SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY issue")
def issue_histogram(t, spark):
    return verify.dataset_report(t("conversations"), "text")[1]


@query(_ISSUES + " SELECT count(*) AS total_spans, count(*) FILTER (len(issues) = 0) AS valid_spans, count(*) FILTER (len(issues) > 0) AS invalid_spans, round((count(*) FILTER (len(issues) = 0))::DOUBLE / count(*), 6) AS validation_rate FROM i")
def validation_rate(t, spark):
    return verify.dataset_report(t("conversations"), "text")[0].withColumn("validation_rate", r6(F.col("validation_rate")))


@query(f"""WITH c AS (SELECT doc_id, text AS t, length(text) AS n, length(text) - length(replace(text, ',', '')) AS commas, instr(text, ',') - 1 AS pos FROM documents),
  r AS (SELECT *, CASE WHEN commas >= 2 THEN 'multiple_commas' WHEN commas = 1 AND n > 200 THEN CASE WHEN pos / n > 0.2 AND pos / n < 0.8 THEN 'long_text_middle_comma' WHEN pos > n * 0.8 THEN 'comma_near_end' END END AS reason FROM c)
  SELECT doc_id, reason AS comma_reason, len(regexp_extract_all(t, '\\([٠-٩0-9]+\\)'))::INTEGER AS n_numbers, len(regexp_extract_all(t, '[^{_CLASS['blocks']}\\s]{{3,}}'))::INTEGER AS n_runs,
   array_to_string(list_filter([CASE WHEN contains(t, '*') THEN 'asterisk' END, CASE WHEN regexp_matches(t, '\\([٠-٩0-9]+\\)') THEN 'parenthetical_numbers' END, CASE WHEN reason IS NOT NULL THEN 'regular_comma_smart' END,
   CASE WHEN regexp_matches(t, '[^{_CLASS['blocks']}\\s]{{3,}}') THEN 'non_arabic_sequences' END], lambda x: x IS NOT NULL), ' ') AS types, length(t) - length(regexp_replace(t, '\\*|[،,]|\\([٠-٩0-9]+\\)|[^{_CLASS['blocks']}\\s]{{3,}}', '', 'g')) AS n_separator_chars FROM r""")
def separator_report(t, spark):
    rows = t("documents").select("doc_id", verify.separator_report(F.col("text")).alias("r"), verify.separator_chars(F.col("text")).cast("long").alias("n_separator_chars"))
    return rows.select("doc_id", "r.comma_reason", F.size("r.numbers").alias("n_numbers"), F.size("r.runs").alias("n_runs"), F.array_join("r.types", " ").alias("types"), "n_separator_chars")


@query(f"""WITH g AS ({_GROUPED}) SELECT a.num AS span_id, a.grp, a.num AS first, 2 AS n, 1.0::DOUBLE AS similarity, a.text || '(' || a.num || ') ' || b.text || '(' || b.num || ')' AS correction FROM g a JOIN g b ON a.grp = b.grp AND b.num = a.num + 1""")
def cross_passages(t, spark):
    """Each passage with the next one of its group as one span."""
    g = grouped(t)
    spans = correct.consecutive_runs(g, "grp", "num", "passage", 2, 2).select(F.col("first").alias("span_id"), F.col("plain").alias("span"))
    return correct.cross_passages(spans, "span_id", "span", g, "grp", "num", "passage").filter("rank = 1").select("span_id", "grp", "first", "n", r6(F.col("similarity")).alias("similarity"), "correction")


@query(f"WITH g AS ({_GROUPED}) SELECT a.grp, a.num AS first, (b.num - a.num + 1)::INTEGER AS n, md5(string_agg(c.text || '(' || c.num || ')', ' ' ORDER BY c.num)) AS joined FROM g a JOIN g b ON a.grp = b.grp AND b.num BETWEEN a.num + 1 AND a.num + 4 JOIN g c ON c.grp = a.grp AND c.num BETWEEN a.num AND b.num GROUP BY a.grp, a.num, b.num HAVING count(*) = b.num - a.num + 1")
def consecutive_runs(t, spark):
    return correct.consecutive_runs(grouped(t), "grp", "num", "passage").select("grp", "first", "n", F.md5(F.col("joined").cast("binary")).alias("joined"))


def _cut() -> F.Column:
    """A passage without its first word; from 190 characters on, where the measure lets frequent characters anchor nothing, the whole."""
    return F.when(F.length("passage") < 190, F.regexp_replace("passage", r"^\S+\s", "")).otherwise(F.col("passage"))


@query("SELECT item_id AS key, item_id, item_id % 2 = 0 AS verse FROM benchmark UNION ALL SELECT item_id + 1000000, NULL, true FROM benchmark")
def canonical_passages(t, spark):
    """C14: passages cut as _cut() does, as verses and as narrations by turns, and words of none."""
    p = passages(t).select(F.col("item_id").alias("key"), _cut().alias("prediction"))
    none = p.select(F.col("key") + 1000000, F.lit("zq zw zx"))
    verse = F.col("key") % 2 == 0
    a = correct.canonical(p.filter(verse).union(none), "key", "prediction", passages(t), "item_id", "passage", True).withColumn("verse", F.lit(True))
    b = correct.canonical(p.filter(~verse), "key", "prediction", passages(t), "item_id", "passage", False).withColumn("verse", F.lit(False))
    return a.union(b).select("key", "item_id", "verse")


@query("SELECT CASE WHEN item_id % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END AS kind, count(*) AS n, count(*) FILTER (item_id % 5 != 0) AS n_right, round(avg((item_id % 5 != 0)::INTEGER), 4) AS accuracy FROM benchmark GROUP BY ROLLUP (CASE WHEN item_id % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END)")
def rescored_corrections(t, spark):
    """Predictions cut as _cut() does, and for each fifth passage words of none, snapped and scored again."""
    p = passages(t).select("item_id", "passage", F.when(F.col("item_id") % 5 == 0, "zq zw zx").otherwise(_cut()).alias("prediction"))
    kind = F.when(F.col("item_id") % 2 == 0, "Ayah").otherwise("Hadith")
    fixed = correct.snapped(p, "item_id", "prediction", passages(t).withColumnRenamed("item_id", "pid"), "pid", "passage").join(p, "item_id").withColumn("kind", kind)
    return score.rescored(fixed, F.col("correction"), F.col("passage"), F.col("kind"), profiles.snapped_diacritics, profiles.lenient_key)


#: Of each passage: five of its words; it and the next one of its group as one text (verses only); words that none has; and five words of it and of the next as two parts.
_FRAGMENTS = f"""WITH g AS (SELECT item_id, text, item_id // 4 AS grp, CASE WHEN item_id // 4 % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END AS kind, {_MKEY.format('text')} AS k, {_WORDS.format('text')}[3:7] AS five FROM benchmark),
  f AS (SELECT g.item_id, min(p.item_id) AS found FROM g JOIN (SELECT item_id, k FROM g) AS p ON contains(p.k, {_MKEY.format("array_to_string(g.five, ' ')")}) GROUP BY g.item_id),
  n AS (SELECT a.item_id, a.kind, a.text || '(' || a.item_id || ') ' || b.text || '(' || b.item_id || ')' AS run, a.k || ' ' || b.k AS k, x.found AS fa, y.found AS fb FROM g a JOIN g b ON a.grp = b.grp AND b.item_id = a.item_id + 1 JOIN f x ON x.item_id = a.item_id JOIN f y ON y.item_id = b.item_id),
  done AS (SELECT item_id * 10 AS span_id, kind, t.text AS correction, 1 AS n_parts, 1 AS n_combined, 'exact_normalized' AS match_type FROM g JOIN f USING (item_id) JOIN (SELECT item_id AS found, text FROM benchmark) AS t USING (found)
   UNION ALL SELECT item_id * 10 + 1, kind, coalesce((SELECT arg_min(text, item_id) FROM g WHERE contains(g.k, n.k)), run), 1, CASE WHEN EXISTS (FROM g WHERE contains(g.k, n.k)) THEN 1 ELSE 2 END, CASE WHEN EXISTS (FROM g WHERE contains(g.k, n.k)) THEN 'exact_normalized' ELSE 'cross_passage' END FROM n WHERE kind = 'Ayah'
   UNION ALL SELECT item_id * 10 + 2, kind, NULL, NULL, NULL, NULL FROM g
   UNION ALL SELECT n.item_id * 10 + 3, n.kind, CASE WHEN n.kind = 'Ayah' THEN x.text || '(' || fa || ') ' || y.text || '(' || fb || ')' ELSE x.text || ' ' || y.text END, 2, 1, 'multiple_parts' FROM n JOIN benchmark x ON x.item_id = fa JOIN benchmark y ON y.item_id = fb)"""


def _corrected(t) -> DataFrame:
    five = F.slice(words(F.col("passage")), 3, 5)
    g = grouped(t).withColumn("kind", F.when(F.col("grp") % 2 == 0, "Ayah").otherwise("Hadith")).withColumn("five", F.array_join(five, " "))
    after = g.select("grp", (F.col("num") - 1).alias("num"), F.col("passage").alias("next"), F.col("five").alias("next_five"))
    two = g.join(after, ["grp", "num"])
    made = [
        g.select((F.col("num") * 10).alias("span_id"), F.col("five").alias("span"), "kind"),
        two.filter("kind = 'Ayah'").select(F.col("num") * 10 + 1, F.concat("passage", F.lit(" "), "next"), "kind"),
        g.select(F.col("num") * 10 + 2, F.array_join(F.transform(five, lambda x: F.repeat(F.reverse(x), 3)), " "), "kind"),
        two.select(F.col("num") * 10 + 3, F.concat("five", F.lit(" * "), "next_five"), "kind"),
    ]
    spans = reduce(DataFrame.union, made)
    held = grouped(t).withColumnRenamed("num", "item_id")
    # The table of all passages is the corpus of both kinds; only verses have runs.
    return correct.corrections(spans, "span_id", "span", "kind", {"Ayah": held.withColumn("num", F.col("item_id")), "Hadith": held}, "item_id", "passage", runs={"Ayah": ("grp", "num")})


@query(_FRAGMENTS + " SELECT span_id, kind, correction, n_parts::INTEGER AS n_parts, n_combined::INTEGER AS n_combined, match_type, CASE WHEN correction IS NOT NULL THEN CASE kind WHEN 'Ayah' THEN 'quran' ELSE 'hadith' END END AS source, CASE WHEN correction IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM done")
def correct_table(t, spark):
    """Fragments, pairs of passages, misses and spans of two parts."""
    return _corrected(t).select("span_id", "kind", "correction", "detail.n_parts", "detail.n_combined", "detail.match_type", "detail.source", r6(F.col("detail.confidence")).alias("confidence"))


@query(_FRAGMENTS + " SELECT count(*) AS total, count(correction) AS corrected, count(*) - count(correction) AS uncorrected, round(100.0 * count(correction) / count(*), 6)::DOUBLE AS corrected_pct, 1.0::DOUBLE AS mean_confidence, count(*) FILTER (n_combined > 1) AS crossing FROM done")
def correction_stats(t, spark):
    s = report.correction_statistics(_corrected(t).withColumn("confidence", F.col("detail.confidence")), crossing=F.coalesce("detail.is_cross", F.lit(False)))
    return s.select("total", "corrected", "uncorrected", r6(F.col("corrected_pct")).alias("corrected_pct"), r6(F.col("mean_confidence")).alias("mean_confidence"), "crossing")


@query(f"""WITH l AS (SELECT doc_id, (i - 1)::INTEGER AS line, {_KEY.format('s[i]')} AS k FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
  p AS (SELECT item_id, {_KEY.format('text')} AS k FROM benchmark)
  SELECT doc_id, line, count(DISTINCT p.item_id) FILTER (l.k = p.k) > 0 AS exact, min(p.item_id) FILTER (l.k = p.k) AS same FROM l JOIN p ON l.k != '' AND contains(p.k, l.k) GROUP BY doc_id, line""")
def strict_verses(t, spark):
    """V3: each line of each document that a passage contains: whether one equals it, and the first that does."""
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "span")).withColumn("key", F.struct("doc_id", "line"))
    out = verify.verify_strictly(d, "key", "span", passages(t), "item_id", "passage").filter("is_match")
    exact = F.col("match_type") == "exact"
    return out.select("key.doc_id", "key.line", exact.alias("exact"), F.when(exact, F.col("item_id")).alias("same"))


@query(_VERB + """, m AS (SELECT doc_id, item_id, d.text AS t, b.text AS p, span_start + (item_id % 3) * 20 AS s, span_end + (item_id % 3) * 20 AS e, CASE WHEN item_id % 2 = 0 THEN 'q' ELSE 'h' END AS kind FROM v JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
  a AS (SELECT *, substr(t, greatest(0, s - 50) + 1, least(length(t), e + 50) - greatest(0, s - 50)) AS area FROM m WHERE e <= length(t))
  SELECT doc_id, item_id, CASE WHEN substr(t, s + 1, e - s) = p THEN s ELSE greatest(0, s - 50) + instr(area, p) - 1 END AS span_start, CASE WHEN substr(t, s + 1, e - s) = p AND kind = 'h' THEN 'ح' ELSE 'ق' END AS tag FROM a WHERE substr(t, s + 1, e - s) = p OR contains(area, p)""")
def place_spans(t, spark):
    """Spans whose bounds are right, or 20 or 40 characters late."""
    late = (F.col("item_id") % 3) * 20
    rows = verbatim(t).join(t("documents").select("doc_id", "text"), "doc_id").join(passages(t).withColumnRenamed("passage", "span"), "item_id")
    rows = rows.select("doc_id", "item_id", "text", "span", F.when(F.col("item_id") % 2 == 0, "q").otherwise("h").alias("kind"), (F.col("span_start") + late).cast("int").alias("start"), (F.col("span_end") + late).cast("int").alias("stop"))
    return answers.place_spans(rows).select("doc_id", "item_id", F.col("span_start").cast("long").alias("span_start"), "tag")


@query("""SELECT conv_id, (turn + 1)::INTEGER AS number, CASE WHEN turn % 3 = 0 THEN 'CorrectAyah' WHEN turn % 2 = 0 THEN 'WrongAyah' ELSE 'WrongHadith' END AS predicted FROM conversations""")
def indexed_verdicts(t, spark):
    """An answer for each conversation, with a label for each third turn, one label that isn't any, and a number that isn't one."""
    spans = t("conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("number"), F.when(F.col("turn") % 2 == 0, "Ayah").otherwise("Hadith").alias("kind"))
    items = F.transform(F.array_sort(F.collect_list(F.when((F.col("number") - 1) % 3 == 0, F.col("number")))), lambda i: F.concat(F.lit('{"index": '), i.cast("string"), F.lit(', "label": " CorrectAyah"}')))
    answer = F.concat(F.lit('Sure: {"validations": ['), F.array_join(items, ", "), F.when(F.size(items) > 0, ", ").otherwise(""), F.lit('{"index": 2, "label": "Maybe"}, {"index": "x", "label": "WrongAyah"}]} Done.'))
    return answers.verdicts(spans.groupBy("conv_id").agg(answer.alias("answer")), "conv_id", "answer", spans, "number", "kind").select("conv_id", "number", "predicted")


@query("SELECT item_id, CASE WHEN item_id % 3 = 2 THEN 'no json here' ELSE trim(text, '\"''“”‘’«»') END AS correction FROM benchmark")
def correction_texts(t, spark):
    """Corrections in JSON, plain, and in quotation marks; an answer without any."""
    p = passages(t)
    answer = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(F.col("passage").alias("correction")))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("«"), "passage", F.lit("»"))).otherwise("no json here")
    return p.select("item_id", answers.correction_text(answer).alias("correction"))


@query("SELECT conv_id, md5(string_agg(r || '. ' || text, chr(10) ORDER BY turn)) AS prompt FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id")
def numbered_prompts(t, spark):
    return answers.numbered_prompt(t("conversations"), "conv_id", "turn", "text").select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


def _questions(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, predictions and texts: verbatim spans and, of documents without any, each twentieth as NoAnnotation."""
    v = store(verbatim(t), "verbatim").withColumn("label", F.when(F.col("item_id") % 2 == 0, "Ayah").otherwise("Hadith")).withColumn("span_no", F.col("item_id"))
    bare = t("documents").filter("doc_id % 20 = 0").select("doc_id").join(v.select("doc_id").distinct(), "doc_id", "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("span_start", "span_end")]
    refs = v.select("doc_id", "span_no", "label", "span_start", "span_end").union(bare.select("doc_id", F.lit(0).cast("long"), F.lit("NoAnnotation"), *zero))
    kind = F.when(F.col("item_id") % 5 == 0, "Ayah").otherwise(F.col("label")).alias("span_type")
    some = v.filter("item_id % 7 != 0").select("doc_id", "span_no", kind, (F.col("span_start") + 5).alias("span_start"), (F.col("span_end") + 5).alias("span_end"))
    lost = v.select("doc_id").distinct().join(some, "doc_id", "left_anti").filter("doc_id % 2 = 0")
    none = lost.union(bare.filter("doc_id % 40 = 0")).select("doc_id", F.lit(0).cast("long"), F.lit("No_Spans"), *zero)
    wrong = bare.filter("doc_id % 40 != 0").select("doc_id", F.lit(0).cast("long"), F.lit("Ayah"), *zero)
    return refs, some.union(none).union(wrong), t("documents").select("doc_id", (F.length("text") + 5).alias("len"))


_OFFICIAL = _VERB + _PAINT + """, o AS (SELECT doc_id, avg(2 * coalesce(tp, 0) / (coalesce(a, 0) + coalesce(b, 0))) AS f1 FROM f WHERE coalesce(a, 0) + coalesce(b, 0) > 0 GROUP BY doc_id),
  q AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN round(f1, 6) WHEN doc_id % 2 = 0 THEN 0 END::DOUBLE AS score FROM o
   UNION ALL SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 1 ELSE 0 END::DOUBLE FROM documents WHERE doc_id % 20 = 0 AND doc_id NOT IN (SELECT doc_id FROM v))"""


@query(_OFFICIAL + " SELECT doc_id, score FROM q")
def official_scores(t, spark):
    return score.official_scores(*_questions(t), "doc_id", "len").withColumn("score", r6(F.col("score")))


@query(_OFFICIAL + " SELECT count(*) AS n_questions, count(score) AS n_answered, round(avg(score), 6) AS score FROM q")
def official_total(t, spark):
    return score.official_scores(*_questions(t), "doc_id", "len").agg(F.count("*").alias("n_questions"), F.count("score").alias("n_answered"), r6(F.avg("score")).alias("score"))


_ENSEMBLE = _VERB + _PAINT.replace("length(text) + 5", "(SELECT greatest(max(g.e), coalesce((SELECT max(p.e) FROM p WHERE p.doc_id = d.doc_id), 0)) + 1 FROM g WHERE g.doc_id = d.doc_id)") + """,
  e AS (SELECT doc_id, bool_and(gold = pred) AS same FROM k WHERE n > 0 GROUP BY doc_id), x AS (SELECT doc_id, label, coalesce(2 * tp / nullif(coalesce(a, 0) + coalesce(b, 0), 0), 0) AS f1, coalesce(a, 0) + coalesce(b, 0) > 0 AS there FROM f),
  z AS (SELECT doc_id, avg(f1) FILTER (there) AS macro_f1, max(CASE WHEN same OR label != 'Ayah' THEN same::INTEGER ELSE f1 END) FILTER (label = 'Ayah') AS f1_ayah, max(CASE WHEN same THEN 1 ELSE f1 END) FILTER (label = 'Hadith') AS f1_hadith,
   max(CASE WHEN same THEN 1 ELSE f1 END) FILTER (label = 'Neither') AS f1_neither FROM x JOIN e USING (doc_id) GROUP BY doc_id)"""


@query(_ENSEMBLE + " SELECT count(*) AS n, round(avg(macro_f1), 6) AS macro_f1, round(avg(f1_ayah), 6) AS f1_ayah, round(avg(f1_hadith), 6) AS f1_hadith, round(avg(f1_neither), 6) AS f1_neither FROM z")
def ensemble_summary(t, spark):
    """Scores of each text and their means."""
    refs, _, _ = _questions(t)
    gold = refs.filter("label != 'NoAnnotation'")
    pred = gold.filter("span_no % 7 != 0").withColumns({"span_start": F.col("span_start") + 5, "span_end": F.col("span_end") + 5, "label": F.when(F.col("span_no") % 5 == 0, "Ayah").otherwise(F.col("label"))})
    names = ["macro_f1", "f1_ayah", "f1_hadith", "f1_neither"]
    return report.ensemble_summary(score.ensemble_f1(gold, pred, "doc_id"), names).select("n", *(r6(F.col(c)).alias(c) for c in names))


@query("SELECT kind, count(*) AS n, count(*) FILTER (ok) AS n_right, round(avg(ok::INTEGER), 6) AS accuracy FROM (SELECT CASE WHEN item_id % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END AS kind, item_id % 3 = 0 AS ok FROM benchmark) GROUP BY ROLLUP (kind)")
def composite_accuracy(t, spark):
    """Predictions under composite ids, a third right, a third wrong, a third missing."""
    refs = passages(t).select("item_id", F.col("item_id").cast("string").alias("question"), F.lit(3).alias("span_start"), F.length("passage").alias("span_end"), F.col("passage").alias("correction"), F.when(F.col("item_id") % 2 == 0, "Ayah").otherwise("Hadith").alias("kind"))
    key = score.composite_id(F.col("question"), F.col("span_start"), F.col("span_end")).alias("id")
    preds = refs.filter("item_id % 3 != 2").select(key, F.when(F.col("item_id") % 3 == 0, F.col("correction")).otherwise("other").alias("prediction"))
    return score.composite_accuracy(refs, preds, lambda a, b: a == b).withColumn("accuracy", r6(F.col("accuracy")))


@query(f"SELECT model, lang, accuracy, n, row_number() OVER (ORDER BY lang, accuracy DESC NULLS LAST, model) AS place FROM ({_METRICS})")
def summary_table(t, spark):
    """The place of each row in the summary's order."""
    m = metrics(t).orderBy("model").coalesce(1)
    ordered = report.summary_table(m, "lang", "accuracy").withColumn("place", F.row_number().over(Window.orderBy("lang", F.desc_nulls_last("accuracy"), "model")))  # a row for each model and language
    return ordered.select("model", "lang", "accuracy", "n", F.col("place").cast("long").alias("place"))


@query(f"SELECT model, row_number() OVER (ORDER BY accuracy DESC, model) AS place FROM ({_METRICS}) WHERE lang = 'en'")
def model_order(t, spark):
    return report.model_order(metrics(t).filter("lang = 'en'"), "accuracy").withColumn("place", F.col("place").cast("long"))


@query(f"SELECT lang AS kind, count(*) AS n FROM ({_RULES}) WHERE lang IN ('en', 'fr') GROUP BY lang")
def kind_counts(t, spark):
    return report.kind_counts(ruled(t).withColumnRenamed("lang", "kind"), "kind", ("en", "fr"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def first_samples(t, spark):
    """The first fifty documents by two keys; the limit is the feature."""
    return report.first_samples(t("documents").select("doc_id", "n_chars", (-F.col("n_chars")).alias("_o")), 50, "_o", "doc_id").drop("_o")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations WHERE text IS NOT NULL")
def corpus_order(t, spark):
    """Places in the order of the sorted corpus: of partitions by range, numbered within, moved by what stands before them."""
    rows = report.corpus_order(t("conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn")
    return retrieve.numbered(rows, "place", "conv_id", "turn")


@query(f"WITH s AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), q AS (SELECT item_id, unnest(CASE WHEN len(w) > 20 THEN w[1:15] ELSE w END) AS token FROM s), d AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents), m AS (SELECT DISTINCT item_id, doc_id FROM q JOIN d USING (token) WHERE length(token) >= 3) SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM m) WHERE r <= 500")
def narration_candidates(t, spark):
    """R5 without the stop, which no table here reaches (sets of over 1,000): the first 500 documents that share one of the words."""
    return parts.narration_candidates(passages(t), "item_id", "passage", t("documents").select("doc_id", "text"), "doc_id", "text", enough=1 << 60)


_N3 = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}}\\x{{0640}}]', '', 'g'), '[^\\x{{0621}}-\\x{{063A}}\\x{{0641}}-\\x{{064A}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_TWO = f"""WITH s AS (SELECT doc_id, text || ' ' || {_DIAC}[doc_id % {len(_DIAC)} + 1] AS s FROM documents), raw AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('s')}) AS token FROM s),
  norm AS (SELECT DISTINCT doc_id, unnest({_WORDS.format(_N3.format('s'))}) AS token FROM s), post AS (SELECT doc_id, token, 'raw' AS form FROM raw UNION ALL SELECT n.doc_id, n.token, 'normal' FROM norm n ANTI JOIN raw r ON r.doc_id = n.doc_id AND r.token = n.token)"""


@query(_TWO + " SELECT token, form, count(*) AS n_docs FROM post GROUP BY token, form")
def two_form_index(t, spark):
    """T4: texts with a vowelled word each, indexed by their words as they stand and as normalised."""
    return retrieve.two_form_postings(vowelled(t), "doc_id", F.col("s")).groupBy("token", "form").agg(F.count("*").alias("n_docs"))


_ASKED = f"""q AS (SELECT i AS query, w FROM (SELECT i, list_concat({_WORDS.format(f"{_DIAC}[i + 1]")}, ['the', 'de']) AS w FROM (SELECT unnest(range(0, {len(_DIAC)})) AS i))),
  f AS (SELECT query, len(w) AS n, unnest(w) AS w FROM q), forms AS (SELECT query, n, w AS token FROM f UNION ALL SELECT query, n, {_N3.format('w')} FROM f WHERE {_N3.format('w')} NOT IN ('', w))"""


@query(_TWO + f", {_ASKED}, times AS (SELECT query, n, token, count(*) AS times FROM forms GROUP BY ALL) SELECT query, doc_id, sum(times)::BIGINT AS hits FROM times JOIN post USING (token) GROUP BY query, n, doc_id HAVING sum(times) >= greatest(1, floor(0.6 * n + 1e-9))")
def two_form_candidates(t, spark):
    """Each of the vowelled words with two common ones, asked of all texts; a word that a text has in both forms counts twice."""
    texts = F.array(*map(F.lit, _DIAC))
    asked = t("documents").filter("doc_id IS NOT NULL").select((F.col("doc_id") % len(_DIAC)).alias("query")).distinct()
    asked = asked.withColumn("w", F.concat(words(F.element_at(texts, (F.col("query") + 1).cast("int"))), F.array(F.lit("the"), F.lit("de"))))
    post = retrieve.two_form_postings(vowelled(t), "doc_id", F.col("s"))
    return retrieve.two_form_candidates(asked, "query", F.col("w"), post, "doc_id").select("query", "doc_id", "hits")


@query()
def clean_spans(t, spark):
    """V11 over the turns of all conversations, in quotation marks and with dots at their ends."""
    marked = F.concat(F.lit("«"), F.col("text"), F.lit("» .."))
    return t("conversations").select("conv_id", "turn", verify.clean_span(marked).alias("c")).select("conv_id", "turn", F.col("c.text").alias("text"), F.array_join("c.applied", "; ").alias("applied"))


@query(f"""WITH r AS ({_RULES}), d AS (SELECT 'a' AS run, a AS v, quality FROM r UNION ALL SELECT 'b', b, quality FROM r WHERE doc_id % 3 != 0), n AS (SELECT count(*) AS n_total FROM r)
  SELECT w.run, n_total, count(v) AS n_done, count(*) FILTER (v AND quality = 0) AS n_failed, CASE WHEN count(v) >= n_total THEN 'complete' ELSE 'in_progress' END AS status,
   round(coalesce(avg(v::INTEGER) FILTER (NOT (v AND quality = 0)), 0), 6)::DOUBLE AS share FROM (VALUES ('a'), ('b'), ('c')) AS w(run) CROSS JOIN n LEFT JOIN d ON d.run = w.run GROUP BY w.run, n_total""")
def run_status(t, spark):
    """ST1: three runs over the labelled documents: a whole one, one without each third document, one that has only begun."""
    rows = ruled(t)
    done = rows.select(F.lit("a").alias("run"), F.col("a").alias("v"), "quality").union(rows.filter("doc_id % 3 != 0").select(F.lit("b"), "b", "quality"))
    done = done.withColumn("share", F.col("v").cast("int"))
    runs = rows.agg(F.count("*").alias("n_total")).select(F.explode(F.array(*map(F.lit, "abc"))).alias("run"), "n_total")
    return resume.run_status(runs, done, error=F.when(F.col("v") & (F.col("quality") == 0), "wrong"), share="share").withColumn("share", r6(F.col("share")))


@query(f"""WITH s AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), t AS (SELECT item_id, CASE WHEN len(w) > 20 THEN w[1:15] ELSE w END AS w FROM s), q AS (SELECT item_id, i AS pos, w[i] AS token FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
  d AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents), met AS (SELECT item_id, doc_id, min(pos) AS pos FROM q JOIN d USING (token) WHERE length(token) >= 3 GROUP BY item_id, doc_id),
  upto AS (SELECT item_id, pos, sum(n) OVER (PARTITION BY item_id ORDER BY pos) AS n FROM (SELECT item_id, pos, count(*) AS n FROM met GROUP BY item_id, pos)), stop AS (SELECT item_id, min(pos) AS stop FROM upto WHERE n > 100 GROUP BY item_id)
  SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM met LEFT JOIN stop USING (item_id) WHERE stop IS NULL OR pos <= stop) WHERE r <= 500""")
def narration_candidates_stopped(t, spark):
    """R5 with its stop: words are taken in order until over 100 documents are found."""
    return parts.narration_candidates(passages(t), "item_id", "passage", t("documents").select("doc_id", "text"), "doc_id", "text", enough=100)
