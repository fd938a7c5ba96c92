"""The registered queries over documents (responses), benchmark (canonical passages), labels (verdicts) and conversations, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import profiles, similarity
from ..functions.tokens import char_ngrams, word_ngrams, words
from ..operators import correct, ensemble, retrieve, score, spans, verify
from ..sources import io
from ..sources.tables import store
from ..streaming.resume import remaining

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def passages(t) -> DataFrame:
    return t("benchmark").select("item_id", F.col("text").alias("passage"))


def r6(c) -> F.Column:
    return F.round(c, 6)


_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w != '')"
_VERB = """WITH v AS (SELECT doc_id, item_id, (instr(d.text, b.text) - 1)::BIGINT AS span_start, (instr(d.text, b.text) - 1 + length(b.text))::BIGINT AS span_end
  FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""
#: Pairs that reach 60 % of the passage's words, as the shared input of the pair measures.
_CAND = f"""WITH q AS (SELECT item_id, len(w) AS n_tokens, unnest(w) AS token FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark)),
  qt AS (SELECT item_id, n_tokens, token, count(*) AS times FROM q GROUP BY ALL),
  p AS (SELECT DISTINCT doc_id, unnest({_WORDS.format("text")}) AS token FROM documents),
  cand AS (SELECT item_id, n_tokens::BIGINT AS n_tokens, doc_id, sum(times)::BIGINT AS hits FROM p JOIN qt USING (token) GROUP BY item_id, n_tokens, doc_id HAVING sum(times) >= greatest(1, floor(0.6 * n_tokens + 1e-9)))"""


def verbatim(t) -> DataFrame:
    return spans.verbatim_spans(t("documents").select("doc_id", "text"), passages(t))


def candidates60(t) -> DataFrame:
    post = retrieve.postings(t("documents"), "doc_id", words(F.col("text")))
    out = retrieve.token_candidates(passages(t), "item_id", words(F.col("passage")), post, "doc_id")
    return out.select("item_id", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_id", "hits")


def pairs60(t, **made) -> DataFrame:
    """The pairs of candidates60 with their texts, those of a document one after another. made: columns of a document's text, made once for all its pairs."""
    found = candidates60(t).groupBy("doc_id").agg(F.collect_list("item_id").alias("_items"))
    docs = t("documents").select("doc_id", "text").join(found, "doc_id").withColumns({name: f(F.col("text")) for name, f in made.items()})
    return docs.withColumn("item_id", F.explode("_items")).drop("_items").join(F.broadcast(passages(t)) if retrieve.small(passages(t)) else passages(t), "item_id")


@query(_VERB + " SELECT * FROM v")
def verbatim_spans(t, spark):
    return verbatim(t)


@query("""SELECT doc_id, item_id, (i - 1)::BIGINT AS span_start FROM (SELECT doc_id, item_id, d.text AS t, b.text AS p, unnest(range(1, length(d.text) - length(b.text) + 2)) AS i
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE substr(t, i, length(p)) = p""")
def all_occurrences(t, spark):
    pairs = retrieve.contained(t("documents").select("doc_id", "text"), passages(t))
    return pairs.select("doc_id", "item_id", F.explode(spans.occurrences(F.col("text"), F.col("passage")).cast("array<bigint>")).alias("span_start"))


@query("""SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[،؛:.!?()«»"]', ' ', 'g'), '[0-9\\[\\]/]', ' ', 'g'), '\\s+', ' ', 'g')))) AS verse_key,
  md5(trim(regexp_replace(regexp_replace(translate(text, 'ۚ۩﴾﴿؛،.,!?:;"''()[]{}', repeat(' ', 20)), '[0-9]', '', 'g'), '\\s+', ' ', 'g'))) AS matcher_key,
  md5(trim(regexp_replace(regexp_replace(translate(text, 'ۚ۩﴾﴿؛،.,:;!?()[]"''«»-–—', repeat(' ', 23)), '[0-9]', '', 'g'), '\\s+', ' ', 'g'))) AS light_key,
  md5(trim(regexp_replace(regexp_replace(text, '[^\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS index_key,
  md5(trim(regexp_replace(regexp_replace(text, '[،؛؟,;.!?"''()\\[\\]{}]', '', 'g'), '\\s+', ' ', 'g'))) AS lenient_key, md5(translate(text, '[]|', '{},')) AS prompt_escape FROM documents""")
def normalize_profiles(t, spark):
    return t("documents").select("doc_id", *(F.md5(profiles.PROFILES[p](F.col("text")).cast("binary")).alias(p) for p in ("verse_key", "matcher_key", "light_key", "index_key", "lenient_key", "prompt_escape")))


_DIAC = ["قَال بَا", "رَبِّي", "الْكِتَابُ", "مَدَّ", "يُوسُفُ", "كِتَاباً", "لِابن"]
# The official replacements, in order, as code points.
_DEFAULT_VOWELS = [("\u064e\u0627", "\u0627"), ("\u0650\u064a", "\u064a"), ("\u064f\u0648", "\u0648"), ("\u0627\u0644\u0652", "\u0627\u0644"), ("\u0652", "")]
_SHADDA_FIRST = [(v + "\u0651", "\u0651" + v) for v in ("\u064e", "\u0650", "\u064f", "\u064b", "\u064d", "\u064c")]
_ON_ALEF = [("\u0627\u064e", "\u0627"), ("\u0627\u0650", "\u0627"), ("\u0644\u0650\u0627", "\u0644\u0627"), ("\u0627\u064b", "\u064b\u0627")]
# End of fixed values.


def _chain(c: str) -> str:
    for old, new in _DEFAULT_VOWELS + _SHADDA_FIRST + _ON_ALEF:
        c = f"replace({c}, '{old}', '{new}')"
    return c


def vowelled(t) -> DataFrame:
    """The texts of all documents, each followed by one of the vowelled words."""
    texts = F.array(*map(F.lit, _DIAC))
    return t("documents").select("doc_id", F.concat("text", F.lit(" "), F.element_at(texts, (F.col("doc_id") % len(_DIAC) + 1).cast("int"))).alias("s"))


@query(f"SELECT doc_id, md5({_chain('s')}) AS plain, {_chain('s')} != s AS changed FROM (SELECT doc_id, text || ' ' || {_DIAC}[doc_id % {len(_DIAC)} + 1] AS s FROM documents)")
def default_diac(t, spark):
    plain = profiles.official_diacritics(F.col("s"))
    return vowelled(t).select("doc_id", F.md5(plain.cast("binary")).alias("plain"), (plain != F.col("s")).alias("changed"))


_MARKED = ["a b (12)", "a (1) b (2)", "(3)", "a (x)", "a(4)  "]


@query(f"SELECT doc_id, md5(CASE WHEN regexp_matches(r, '\\([0-9]+\\)') THEN s ELSE r END) AS stripped FROM (SELECT doc_id, s, regexp_replace(s, '\\s*\\([0-9]+\\)\\s*$', '') AS r FROM (SELECT doc_id, text || ' ' || {_MARKED}[doc_id % {len(_MARKED)} + 1] AS s FROM documents))")
def strip_markers(t, spark):
    marked = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, _MARKED)), (F.col("doc_id") % len(_MARKED) + 1).cast("int")))
    return t("documents").select("doc_id", F.md5(profiles.drop_lone_marker(marked).cast("binary")).alias("stripped"))


_POST = f"p AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS token FROM documents)"


@query(f"WITH {_POST} SELECT count(*) AS unique_tokens, sum(n)::BIGINT AS postings, round(avg(n), 6) AS mean_postings, max(n) AS most_postings FROM (SELECT token, count(*) AS n FROM p GROUP BY token)")
def word_index_stats(t, spark):
    return retrieve.index_statistics(retrieve.postings(t("documents"), "doc_id", words(F.col("text"))), "doc_id").withColumn("mean_postings", r6(F.col("mean_postings")))


@query(f"WITH {_POST} SELECT token, count(*) AS n_docs FROM p GROUP BY token")
def posting_counts(t, spark):
    return retrieve.postings(t("documents"), "doc_id", words(F.col("text"))).groupBy("token").agg(F.count("*").alias("n_docs"))


@query("SELECT DISTINCT item_id, substr(text, i, 3) AS token FROM (SELECT item_id, text, unnest(range(1, greatest(2, length(text) - 1))) AS i FROM benchmark)")
def char_trigram_index(t, spark):
    return retrieve.postings(t("benchmark"), "item_id", char_ngrams(F.col("text"))).select("item_id", "token")


@query(f"SELECT item_id, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark))")
def word_trigrams(t, spark):
    return t("benchmark").select("item_id", F.explode(word_ngrams(F.col("text"), 3)).alias("gram"))


@query(f"WITH {_POST} SELECT item_id, token, doc_id FROM (SELECT item_id, token, doc_id, row_number() OVER (PARTITION BY item_id, token ORDER BY doc_id) AS r FROM (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS token FROM benchmark) JOIN p USING (token)) WHERE r <= 10")
def word_query(t, spark):
    q = retrieve.postings(passages(t), "item_id", words(F.col("passage")))
    hits = retrieve.postings(t("documents"), "doc_id", words(F.col("text"))).join(retrieve.maybe_broadcast(q), "token")
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "token").orderBy("doc_id")))
    return ranked.filter("r <= 10").select("item_id", "token", "doc_id")


@query(_CAND + " SELECT * FROM cand")
def token_candidates(t, spark):
    return candidates60(t)


@query(_CAND + " SELECT item_id, doc_id, hits, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS r FROM cand) WHERE r <= 10")
def search_topk(t, spark):
    return retrieve.top_k(candidates60(t), "item_id", 10, F.desc("hits"), F.col("doc_id")).select("item_id", "doc_id", "hits", F.col("rank").cast("long").alias("rank"))


@query(_CAND.replace("floor(0.6 * n_tokens + 1e-9)", "floor(n_tokens / 3.0 + 1e-9)").replace("unnest(w) AS token FROM (SELECT item_id, ", "unnest(w) AS token FROM (SELECT item_id, list_distinct(").replace(" AS w FROM benchmark", ") AS w FROM benchmark", 1) + " SELECT item_id, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS r FROM cand) WHERE r <= 100")
def candidate_cap100(t, spark):
    post = retrieve.postings(t("documents"), "doc_id", words(F.col("text")))
    out = retrieve.token_candidates(passages(t), "item_id", F.array_distinct(words(F.col("passage"))), post, "doc_id", 1 / 3)
    return retrieve.top_k(out, "item_id", 100, F.desc("hits"), F.col("doc_id")).select("item_id", "doc_id", "hits")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def trigram_prefilter_match(t, spark):
    return retrieve.holding(passages(t), "item_id", "passage", t("documents"), "doc_id", "text").select("doc_id", "item_id")


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
  SELECT a.conv_id, a.turn AS first, count(*)::BIGINT AS n, b.k - a.k + 1 AS m, md5(CASE WHEN count(*) = 1 THEN any_value(c.text) ELSE string_agg(c.text || ' (' || c.turn || ')', ' ' ORDER BY c.turn) END) AS joined, md5(string_agg(regexp_replace(c.text, '[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E8}\\x{06EA}-\\x{06ED}]', '', 'g'), ' ' ORDER BY c.turn)) AS plain FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k AND a.k + 9 JOIN r c ON c.conv_id = a.conv_id AND c.k BETWEEN a.k AND b.k GROUP BY a.conv_id, a.turn, a.k, b.k""")
def adjacent_passages(t, spark):
    out = retrieve.adjacent_passages(t("conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "first", F.col("n").cast("long").alias("n"), F.col("n").cast("long").alias("m"), *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("joined", "plain")))


_GRAMS = "list_distinct(CASE WHEN len({w}) < {n} THEN [array_to_string({w}, ' ')] ELSE list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n} - 1], ' ')) END)"
_J = " + ".join(f"{w} * len(list_intersect({_GRAMS.format(w='x', n=n)}, {_GRAMS.format(w='y', n=n)}))::DOUBLE / (len({_GRAMS.format(w='x', n=n)}) + len({_GRAMS.format(w='y', n=n)}) - len(list_intersect({_GRAMS.format(w='x', n=n)}, {_GRAMS.format(w='y', n=n)})))" for n, w in ((2, 0.3), (3, 0.4), (4, 0.3)))


@query(_CAND + f" SELECT item_id, doc_id, round({_J}, 6) AS jaccard FROM (SELECT item_id, doc_id, {_WORDS.format('b.text')} AS x, {_WORDS.format('d.text')} AS y FROM cand JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))")
def ngram_jaccard(t, spark):
    return pairs60(t).select("item_id", "doc_id", r6(similarity.ngram_jaccard(F.col("passage"), F.col("text"))).alias("jaccard"))


@query("WITH RECURSIVE " + _CAND.removeprefix("WITH ") + f""", pair AS (SELECT item_id, doc_id, b.text AS p, d.text AS t FROM cand JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
  g AS (SELECT item_id, doc_id, p, t, 0 AS k FROM pair WHERE NOT contains(t, p) UNION ALL SELECT item_id, doc_id, p, t, k + 1 FROM g WHERE k < length(p) AND len(list_filter(range(1, length(p) - k + 1), lambda i: contains(t, substr(p, i, k + 1)))) > 0),
  lcs AS (SELECT item_id, doc_id, max(k) AS k FROM g GROUP BY ALL)
  SELECT item_id, doc_id, round(0.3 * len(list_intersect(list_distinct(string_split(p, '')), list_distinct(string_split(t, ''))))::DOUBLE / len(list_distinct(string_split(p, '')))
  + 0.4 * len(list_intersect(list_distinct({_WORDS.format('p')}), list_distinct({_WORDS.format('t')})))::DOUBLE / len(list_distinct({_WORDS.format('p')})) + 0.3 * CASE WHEN contains(t, p) THEN 1.0 WHEN contains(p, t) THEN 0.8 WHEN k >= 3 THEN k::DOUBLE / length(p) ELSE 0.0 END, 6) AS contained FROM pair LEFT JOIN lcs USING (item_id, doc_id)""")
def containment_words_chars(t, spark):
    p = pairs60(t, chars=similarity.characters, held=similarity.kinds)
    return p.select("item_id", "doc_id", r6(similarity.containment(F.col("passage"), F.col("text"), F.col("chars"), F.col("held"))).alias("contained"))


@query(f"""SELECT doc_id, item_id, round(least(1.0, 0.75 + least(0.2, length(p) / 200) + CASE WHEN contains(' ' || j || ' ', ' ' || p || ' ') OR starts_with(j, p) OR ends_with(j, p) THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score
  FROM (SELECT doc_id, item_id, b.text AS p, array_to_string({_WORDS.format('d.text')}, ' ') AS j FROM documents d JOIN benchmark b ON contains(d.text, b.text))""")
def substring_score(t, spark):
    pairs = retrieve.contained(t("documents").select("doc_id", "text"), passages(t))
    return pairs.select("doc_id", "item_id", r6(similarity.substring_score(F.col("passage"), F.col("text"))).alias("score"))


@query(f"""SELECT item_id, m AS match_type, round((CASE WHEN n <= 3 THEN CASE m WHEN 'substring' THEN 0.75 WHEN 'fuzzy_substring' THEN 0.8 ELSE 0.75 END WHEN n <= 8 THEN CASE m WHEN 'substring' THEN 0.75 WHEN 'fuzzy_substring' THEN 0.85 ELSE 0.85 END ELSE 0.9 END)::DOUBLE, 6) AS threshold
  FROM (SELECT item_id, len({_WORDS.format('text')}) % 12 AS n FROM benchmark), (VALUES ('substring'), ('fuzzy_substring'), ('full')) AS k(m)""")
def adaptive_threshold(t, spark):
    rows = t("benchmark").select("item_id", (F.size(words(F.col("text"))) % 12).alias("n"), F.explode(F.array(*map(F.lit, ("substring", "fuzzy_substring", "full")))).alias("match_type"))
    return rows.select("item_id", "match_type", r6(similarity.adaptive_threshold(0.95, F.col("n"), F.col("match_type"))).alias("threshold"))


@query()
def sequence_ratio_match(t, spark):
    rows = pairs60(t).select("item_id", "doc_id", r6(similarity.sequence_ratio(F.col("passage"), F.col("text"))).alias("ratio"))
    return retrieve.top_k(rows, "item_id", 10, F.desc("ratio"), F.col("doc_id")).drop("rank")


@query()
def phrase_scores(t, spark):
    p = pairs60(t, held=similarity.kinds)
    return p.select("item_id", "doc_id", r6(similarity.phrase_score(F.col("passage"), F.col("text"))).alias("phrase"), r6(similarity.longest_common_substring(F.col("passage"), F.col("text"))).alias("common"), r6(similarity.positional(F.col("passage"), F.col("text"), F.col("held"))).alias("places"))


def lines(t) -> DataFrame:
    """Lines of passages, and copies of them that lack their third word, as spans to verify."""
    b = t("benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "span")).select((F.col("item_id") * 100 + F.col("line")).alias("span_id"), "span")
    return b.union(b.select(F.col("span_id") + 50, F.regexp_replace("span", r"^(\S+\s+\S+\s+)\S+\s", "$1")))


def document_lines(t) -> DataFrame:
    """Every line of every document that isn't blank, as spans to verify; their ids are negative."""
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "span")).filter("trim(span) != ''")
    return d.select((-(F.col("doc_id") * 1_000_000 + F.col("line") + 1)).alias("span_id"), "span")


@query()
def verify_exact_then_fuzzy(t, spark):
    """The lines of all documents, and those of the passages with altered copies."""
    return verify.verify_verses(lines(t).union(document_lines(t)), "span_id", "span", passages(t), "item_id", "passage").withColumn("similarity", r6(F.col("similarity")))


_KEY = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[،؛:.!?()«»\"]', ' ', 'g'), '[0-9\\[\\]/]', ' ', 'g'), '\\s+', ' ', 'g')))"


@query(f"""WITH s AS (SELECT 'document' AS kind, doc_id AS span_id, text FROM documents UNION ALL SELECT 'quoted', item_id, concat('«', text, '» (12)') FROM benchmark
  UNION ALL SELECT 'cut', item_id, regexp_replace(text, '^\\S+\\s', '') FROM benchmark)
  SELECT kind, span_id, min(item_id) AS item_id FROM s JOIN benchmark b ON {_KEY.format('s.text')} = {_KEY.format('b.text')} GROUP BY kind, span_id""")
def verify_exact(t, spark):
    """Whole documents, passages in quotation marks and passages without their first word, where a passage has the same key."""
    kinds = {"document": (t("documents"), "doc_id", F.col("text")), "quoted": (t("benchmark"), "item_id", F.concat(F.lit("«"), "text", F.lit("» (12)"))), "cut": (t("benchmark"), "item_id", F.regexp_replace("text", r"^\S+\s", ""))}
    made = [df.select(F.lit(kind).alias("kind"), F.col(i).alias("span_id"), profiles.verse_key(text).alias("k")) for kind, (df, i, text) in kinds.items()]
    keys = passages(t).select("item_id", profiles.verse_key(F.col("passage")).alias("k"))
    return made[0].union(made[1]).union(made[2]).join(keys, "k").groupBy("kind", "span_id").agg(F.min("item_id").alias("item_id"))


@query("SELECT item_id, arg_max(doc_id, (c, -doc_id)) AS doc_id, round(max(c), 6) AS coverage FROM (SELECT item_id, doc_id, length(b.text)::DOUBLE / length(d.text) AS c FROM documents d JOIN benchmark b ON contains(d.text, b.text)) GROUP BY item_id")
def strict_substring_verify(t, spark):
    pairs = retrieve.contained(t("documents").select("doc_id", "text"), passages(t)).withColumn("c", similarity.coverage(F.col("passage"), F.col("text")))
    return pairs.groupBy("item_id").agg(F.max_by("doc_id", F.struct(F.col("c"), -F.col("doc_id"))).alias("doc_id"), r6(F.max("c")).alias("coverage"))


_VOTE = "WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents), m AS (SELECT doc_id, count(*) AS n_parts, count(*) FILTER (part IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark)) AS n_matched FROM parts WHERE trim(part) != '' GROUP BY doc_id)"


@query(_VOTE + " SELECT doc_id, n_parts, n_matched, n_matched > 0 AS v_any, n_matched = n_parts AS v_all, n_matched / n_parts > 0.5 AS v_majority, n_matched / n_parts >= 0.8 AS v_high FROM m")
def strategy_vote(t, spark):
    known = t("benchmark").select(F.explode(F.split("text", "\n")).alias("part")).distinct().withColumn("hit", F.lit(1))
    parts = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("part")).filter("trim(part) != ''").join(retrieve.maybe_broadcast(known), "part", "left")
    m = parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.count("hit").alias("n_matched"))
    return m.select("*", *(verify.strategy_vote(F.col("n_matched"), F.col("n_parts"), s).alias(f"v_{s}") for s in ("any", "all", "majority", "high")))


@query(f"""SELECT doc_id, len({_WORDS.format("replace(text, '*', ' * ')")}) >= 0 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 20 AND (contains(text, '*') OR contains(text, chr(10)) OR regexp_matches(text, '\\([٠-٩0-9]+\\)')) AS multi FROM documents""")
def multi_part_flags(t, spark):
    return t("documents").select("doc_id", verify.multi_text(F.col("text"), F.lit("Hadith")).alias("multi"))


@query("SELECT item_id, (i - 1)::INTEGER AS part, p[i] AS piece FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT item_id, list_filter(list_transform(string_split(replace(text, 'e', '*'), '*'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x != '') AS p FROM benchmark))")
def split_parts(t, spark):
    return t("benchmark").select("item_id", F.posexplode(verify.split_parts(F.replace("text", F.lit("e"), F.lit("*")))).alias("part", "piece"))


@query()
def correct_best_passage(t, spark):
    """C5, C7 over the passages' lines, whole and without a word."""
    q, c = lines(t), passages(t)
    ranked = correct.matches(q, "span_id", "span", c, "item_id", "passage", 0.85)
    return correct.decide(q, "span_id", ranked, "text", 0.3).select("span_id", F.coalesce("correction", F.lit(correct.SENTINEL)).alias("correction"), r6(F.col("similarity")).alias("similarity"))


_MKEY = "trim(regexp_replace(regexp_replace(translate({0}, 'ۚ۩﴾﴿؛،.,!?:;\"''()[]{{}}', repeat(' ', 20)), '[0-9]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT doc_id, (i - 1)::INTEGER AS line, {_MKEY.format('s[i]')} AS k FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
  p AS (SELECT item_id, {_MKEY.format('text')} AS k FROM benchmark) SELECT doc_id, line, min(item_id) AS item_id FROM l JOIN p ON length(l.k) >= 3 AND contains(p.k, l.k) GROUP BY doc_id, line""")
def exact_lines(t, spark):
    """Each line of each document that some passage contains, normalised, and the first such passage."""
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "span")).withColumn("key", F.struct("doc_id", "line"))
    return correct.exact_matches(d, "key", "span", passages(t), "item_id", "passage").select("key.doc_id", "key.line", "item_id")


@query()
def snap_len_ratio(t, spark):
    q = lines(t).withColumn("item_id", F.floor(F.col("span_id") / 100)).join(passages(t), "item_id")
    return q.select("span_id", correct.snap(F.col("span"), F.col("passage")).alias("snapped"))


@query("SELECT md5(text) AS k, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents GROUP BY text")
def dedupe_keep_best(t, spark):
    out = retrieve.dedupe_first(t("documents").select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("k")), F.col("k"), F.desc("n_chars"), F.col("doc_id"))
    return out.select("k", "doc_id")


@query("""SELECT u.conv_id, u.turn, substr(a.text, 1, 40) AS head, CASE WHEN a.text LIKE '%.' THEN 'Correct' ELSE 'Wrong' END || CASE WHEN length(a.text) % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END AS label,
  CASE WHEN length(a.text) % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END AS kind, a.text LIKE '%.' AS is_right FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def response_join_slice(t, spark):
    c = t("conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    out = c.filter("role = 'user'").select("conv_id", "turn").join(a, ["conv_id", "turn"])
    label = F.concat(F.when(F.endswith("text", F.lit(".")), "Correct").otherwise("Wrong"), F.when(F.length("text") % 2 == 0, "Ayah").otherwise("Hadith"))
    kind, right = spans.label_parts(F.col("label"))
    return out.withColumn("label", label).select("conv_id", "turn", F.substring("text", 1, 40).alias("head"), "label", kind.alias("kind"), right.alias("is_right"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, turn::VARCHAR AS id, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS response FROM conversations")
def xml_questions(t, spark):
    one = F.concat(F.lit("<Question><ID> "), F.col("turn"), F.lit("</ID><Response>\n"), F.col("text"), F.lit("</Response></Question>"))
    files = t("conversations").withColumn("x", one).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"]), "\n").alias("value"))
    return files.select("conv_id", "value").transform(lambda df: df.select("conv_id", F.posexplode(F.regexp_extract_all("value", F.lit(io.QUESTION), F.lit(1))).alias("pos", "b"))).select(
        "conv_id", "pos", F.btrim(F.regexp_extract("b", "(?s)<ID>(.*?)</ID>", 1), F.lit(" \t\r\n")).alias("id"), F.md5(F.btrim(F.regexp_extract("b", "(?s)<Response>(.*?)</Response>", 1), F.lit(" \t\r\n")).cast("binary")).alias("response")
    )


_ANSWER = "CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' Done.' WHEN 2 THEN 'It is {' || props ELSE 'no answer' END"


@query(f"""SELECT event_id, CASE WHEN json_valid(plain) AND regexp_matches(plain, '^[\\[{{]') THEN plain WHEN json_valid(part) THEN part END AS block
  FROM (SELECT event_id, regexp_replace(regexp_replace(answer, '^```[A-Za-z]*\\s*', ''), '\\s*```$', '') AS plain, nullif(regexp_extract(answer, '(?s)\\{{.*\\}}'), '') AS part FROM (SELECT event_id, {_ANSWER} AS answer FROM events))""")
def json_repair(t, spark):
    """Answers in fences, amid prose, broken, and without JSON."""
    e = t("events")
    answer = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" Done.")))
    answer = answer.when(F.col("event_id") % 4 == 2, F.concat(F.lit("It is {"), "props")).otherwise("no answer")
    return e.select("event_id", spans.json_block(answer).alias("block"))


@query(_VERB + """, n AS (SELECT doc_id, span_start, span_end, row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_end) AS k FROM v)
  SELECT doc_id, coalesce(k, 0)::INTEGER AS annotation_id, coalesce(span_start, 0) AS span_start, coalesce(span_end, 0) AS span_end, CASE WHEN k IS NULL THEN 'No_Spans' ELSE 'Ayah' END AS span_type FROM documents LEFT JOIN n USING (doc_id)""")
def no_spans_rows(t, spark):
    return spans.number_spans(t("documents"), verbatim(t).select("doc_id", "span_start", "span_end", F.lit("Ayah").alias("span_type")))


def gold_and_pred(t) -> tuple[DataFrame, DataFrame]:
    """Verbatim spans as gold, with the item's parity as type; predictions are moved by five characters and lack every seventh item."""
    v = store(verbatim(t), "verbatim").withColumn("label", F.when(F.col("item_id") % 2 == 0, "Ayah").otherwise("Hadith")).withColumn("span_no", F.col("item_id"))
    return v, v.filter("item_id % 7 != 0").withColumns({"span_start": F.col("span_start") + 5, "span_end": F.col("span_end") + 5, "label": F.when(F.col("item_id") % 5 == 0, "Ayah").otherwise(F.col("label"))})


_PAINT = """, g AS (SELECT doc_id, item_id, span_start AS s, span_end AS e, CASE WHEN item_id % 2 = 0 THEN 'Ayah' ELSE 'Hadith' END AS l FROM v),
 p AS (SELECT doc_id, item_id, s + 5 AS s, e + 5 AS e, CASE WHEN item_id % 5 = 0 THEN 'Ayah' ELSE l END AS l FROM g WHERE item_id % 7 != 0),
 gc AS (SELECT doc_id, c, arg_max(l, item_id) AS l FROM (SELECT doc_id, item_id, l, unnest(range(s, e)) AS c FROM g) GROUP BY doc_id, c),
 pc AS (SELECT doc_id, c, arg_max(l, item_id) AS l FROM (SELECT doc_id, item_id, l, unnest(range(s, e)) AS c FROM p) GROUP BY doc_id, c),
 j AS (SELECT doc_id, coalesce(gc.l, 'Neither') AS gold, coalesce(pc.l, 'Neither') AS pred, count(*) AS n FROM gc FULL JOIN pc USING (doc_id, c) GROUP BY ALL),
 k AS (SELECT doc_id, gold, pred, n FROM j UNION ALL SELECT doc_id, 'Neither', 'Neither', length(text) + 5 - (SELECT sum(n) FROM j WHERE j.doc_id = d.doc_id) FROM documents d WHERE doc_id IN (SELECT doc_id FROM g)),
 f AS (SELECT doc_id, label, sum(n) FILTER (gold = label AND pred = label) AS tp, sum(n) FILTER (gold = label) AS a, sum(n) FILTER (pred = label) AS b FROM k, (VALUES ('Ayah'), ('Hadith'), ('Neither')) AS l(label) GROUP BY doc_id, label)"""


def _counts(t) -> DataFrame:
    gold, pred = gold_and_pred(t)
    lengths = t("documents").join(gold.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", (F.length("text") + 5).alias("len"))
    return score.overlap_counts(score.paint(gold, "doc_id"), score.paint(pred, "doc_id"), lengths, "doc_id", "len")


@query(_VERB + _PAINT + " SELECT doc_id, round(avg(2 * coalesce(tp, 0) / (coalesce(a, 0) + coalesce(b, 0))), 6) AS macro_f1 FROM f WHERE coalesce(a, 0) + coalesce(b, 0) > 0 GROUP BY doc_id")
def char_f1_official(t, spark):
    return score.macro_f1(_counts(t), "doc_id").withColumn("macro_f1", r6(F.col("macro_f1")))


@query(_VERB + _PAINT + " SELECT label, round(avg(coalesce(2 * tp / nullif(coalesce(a, 0) + coalesce(b, 0), 0), 0)), 6) AS mean_f1 FROM f GROUP BY label")
def class_f1_means(t, spark):
    kinds = ["Ayah", "Hadith", "Neither"]
    means = score.class_f1(_counts(t), "doc_id", kinds).agg(*(r6(F.avg(f"f1_{k.lower()}")).alias(k) for k in kinds))
    return means.unpivot([], kinds, "label", "mean_f1")


_RULES = "SELECT doc_id, lang, quality, n_chars, n_chars > 1500 AS a, length(text) - length(replace(text, chr(10), '')) > 3 AS b, length(text) - length(replace(text, ',', '')) > 10 AS c FROM labels JOIN documents USING (doc_id)"


def ruled(t) -> DataFrame:
    d = t("labels").join(t("documents").select("doc_id", "lang", "text", "n_chars"), "doc_id")
    count = lambda ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit("")))
    return d.select("doc_id", "lang", "quality", "n_chars", (F.col("n_chars") > 1500).alias("a"), (count("\n") > 3).alias("b"), (count(",") > 10).alias("c"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (a = (quality = 1)) AS n_right, round(avg((a = (quality = 1))::INTEGER), 6) AS accuracy FROM ({_RULES}) GROUP BY ROLLUP (lang)")
def accuracy_by_type(t, spark):
    return score.accuracy(ruled(t), F.col("a") == (F.col("quality") == 1), "lang").withColumn("accuracy", r6(F.col("accuracy")))


@query(f"""SELECT lang, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(m, 6) AS mean_similarity
  FROM (SELECT lang, count(*) FILTER (quality = 1 AND b) AS tp, count(*) FILTER (quality = 0 AND NOT b) AS tn, count(*) FILTER (quality = 0 AND b) AS fp, count(*) FILTER (quality = 1 AND NOT b) AS fn, avg(n_chars / 1000) AS m FROM ({_RULES}) GROUP BY lang)""")
def confusion_metrics(t, spark):
    """E10, E11; a thousandth of the length stands for the similarity whose mean is reported."""
    out = score.confusion(ruled(t), F.col("quality") == 1, F.col("b"), "lang", similarity=F.col("n_chars") / 1000)
    return out.withColumns({c: r6(F.col(c)) for c in ("accuracy", "precision", "recall", "f1", "mean_similarity")})


@query("SELECT item_id AS key, item_id % 3 != 1 AS is_right FROM benchmark")
def containment_or_corpus_accuracy(t, spark):
    refs = passages(t).select(F.col("item_id").alias("key"), F.col("passage").alias("correction"))
    shorter = F.substring("correction", 1, 20)
    preds = refs.filter("key % 3 != 1").select("key", F.col("correction").alias("prediction")).union(refs.filter("key % 6 = 1").select("key", shorter))
    return score.correction_accuracy(refs, preds, "key", passages(t), "passage", profiles.official_diacritics)


@query(f"SELECT doc_id, a::INTEGER + b::INTEGER + c::INTEGER AS n_yes, a::INTEGER + b::INTEGER + c::INTEGER >= 2 AS verdict FROM ({_RULES})")
def majority_vote(t, spark):
    votes = ruled(t).select("doc_id", F.explode(F.array("a", "b", "c")).alias("vote"))
    return ensemble.majority(votes, "doc_id").select("doc_id", F.col("n_yes").cast("int").alias("n_yes"), "verdict")


_VOTED = """, m AS (SELECT doc_id, span_start AS s, span_end AS e, item_id, CASE WHEN item_id % 2 = 0 THEN 'q' ELSE 'h' END AS l FROM v),
 s AS (SELECT *, 1 AS model FROM m UNION ALL SELECT doc_id, s + 5, e + 5, item_id, l, 2 FROM m UNION ALL SELECT doc_id, s, e - 7, item_id, 'q', 3 FROM m WHERE item_id % 3 != 0),
 c AS (SELECT doc_id, unnest(range(s, e)) AS c, l, CASE model WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.5 END AS w FROM s),
 x AS (SELECT doc_id, c, coalesce(sum(w) FILTER (l = 'q'), 0) AS q, coalesce(sum(w) FILTER (l = 'h'), 0) AS h FROM c GROUP BY doc_id, c),
 y AS (SELECT doc_id, c, CASE WHEN q > 1.1 AND q >= h THEN 'q' WHEN h > 1.1 AND h > q THEN 'h' END AS label FROM x)"""


@query(_VERB + _VOTED + " SELECT doc_id, min(c)::BIGINT AS start, (max(c) + 1)::BIGINT AS stop, label FROM (SELECT doc_id, c, label, c - row_number() OVER (PARTITION BY doc_id, label ORDER BY c) AS g FROM y WHERE label IS NOT NULL) GROUP BY doc_id, label, g")
def weighted_char_vote(t, spark):
    v = store(verbatim(t), "verbatim").withColumn("label", F.when(F.col("item_id") % 2 == 0, "q").otherwise("h"))
    rows = v.select("doc_id", F.lit(1).alias("model"), "label", "span_start", "span_end").union(v.select("doc_id", F.lit(2), "label", F.col("span_start") + 5, F.col("span_end") + 5))
    rows = rows.union(v.filter("item_id % 3 != 0").select("doc_id", F.lit(3), F.lit("q"), "span_start", F.col("span_end") - 7))
    models = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.5)], "model int, weight double")
    return ensemble.char_votes(rows, v.select("doc_id").distinct().join(F.broadcast(models)), "doc_id")


@query(f"""WITH r AS ({_RULES}), a AS (SELECT doc_id, quality, unnest(list_transform([a, b, c], lambda x: CASE WHEN x THEN 'good' ELSE 'bad' END)) AS answer FROM r), p AS (SELECT doc_id, quality, answer, count(*) AS n FROM a GROUP BY ALL)
  SELECT doc_id, arg_min(answer, (-n, answer)) AS consensus, max(n) AS n_consensus, sum(n)::BIGINT AS n_answers, coalesce(sum(n) FILTER ((answer = 'good') != (quality = 1)), 0)::BIGINT AS n_differ, count(*) = 1 AS unanimous FROM p GROUP BY doc_id HAVING coalesce(sum(n) FILTER ((answer = 'good') != (quality = 1)), 0) > 0""")
def consensus_mining(t, spark):
    answers = ruled(t).select("doc_id", "quality", F.explode(F.array(*(F.when(F.col(c), "good").otherwise("bad") for c in "abc"))).alias("answer"))
    return ensemble.consensus(answers, F.when(F.col("quality") == 1, "good").otherwise("bad"), "doc_id")


_METRICS = f"SELECT model, lang, round(avg((v = (quality = 1))::INTEGER), 4) AS accuracy, count(*) AS n FROM (SELECT 'a' AS model, lang, quality, a AS v FROM ({_RULES}) UNION ALL SELECT 'b', lang, quality, b FROM ({_RULES}) UNION ALL SELECT 'c', lang, quality, c FROM ({_RULES})) GROUP BY model, lang"


def metrics(t) -> DataFrame:
    long = ruled(t).drop("n_chars").unpivot(["lang", "quality"], ["a", "b", "c"], "model", "v")
    return long.groupBy("model", "lang").agg(F.round(F.avg((F.col("v") == (F.col("quality") == 1)).cast("int")), 4).alias("accuracy"), F.count("*").alias("n"))


@query(f"SELECT model, max(accuracy) FILTER (lang = 'de') AS de, max(accuracy) FILTER (lang = 'en') AS en, max(accuracy) FILTER (lang = 'es') AS es FROM ({_METRICS}) GROUP BY model")
def comparison_pivot(t, spark):
    m = metrics(t)
    return ensemble.comparison([m.filter(F.col("lang") == k).select("model", F.col("accuracy").alias(k)) for k in ("de", "en", "es")])


@query(f"SELECT model, lang, 'accuracy' AS metric, accuracy AS value FROM ({_METRICS}) UNION ALL SELECT model, lang, 'n', n::DOUBLE FROM ({_METRICS})")
def unpivot_metrics(t, spark):
    return metrics(t).select("model", "lang", "accuracy", F.col("n").cast("double").alias("n")).unpivot(["model", "lang"], ["accuracy", "n"], "metric", "value")


@query(f"SELECT model, max(accuracy) FILTER (lang = 'en') AS en, max(accuracy) FILTER (lang = 'fr') AS fr FROM ({_METRICS}) GROUP BY model")
def first_non_null(t, spark):
    sparse = metrics(t).select("model", *(F.when(F.col("lang") == k, F.col("accuracy")).alias(k) for k in ("en", "fr", "xx")))
    return ensemble.first_values(ensemble.without_empty_columns(sparse), "model", ["en", "fr"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(t, spark):
    return remaining(t("documents").select("doc_id"), t("labels"), "doc_id")


@query(_VERB + " SELECT doc_id, item_id, span_start, 3 AS moved FROM v")
def repair_offsets(t, spark):
    v = verbatim(t).join(t("documents").select("doc_id", "text"), "doc_id").join(passages(t), "item_id")
    return v.select("doc_id", "item_id", spans.repair(F.col("text"), F.col("passage"), (F.col("span_start") + 3).cast("int")).cast("long").alias("span_start"), F.lit(3).alias("moved"))


@query("SELECT (row_number() OVER (ORDER BY doc_id))::BIGINT AS position, CASE WHEN quality = 1 THEN 'Correct' ELSE 'Incorrect' END AS verdict FROM labels")
def verdict_lines(t, spark):
    placed = retrieve.numbered(t("labels").select("doc_id", "quality"), "place", "doc_id")
    return io.verdict_lines(placed.withColumn("pos", F.col("place") - 1), "pos", F.col("quality") == 1)


@query()
def quoted_spans(t, spark):
    marked = t("documents").select("doc_id", F.concat(F.lit('"'), F.replace("text", F.lit("\n"), F.lit('"\n"')), F.lit('"')).alias("text"))
    return spans.quoted(marked)
