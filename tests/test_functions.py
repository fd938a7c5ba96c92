import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from florilege.functions import profiles, similarity, tokens
from florilege.operators import correct, ensemble, retrieve, score, spans, verify
from florilege.sources import io
from florilege.streaming.resume import annotate_stream, remaining, results


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))).select(column(*map(F.col, names)).alias("x")).first()[0]


@pytest.mark.parametrize(
    "profile, text, want",
    [
        ("verse_key", "قَالَ، (الله) 12!", "قال الله"),
        ("narration_key", "إلى أمّةٍ", "الي امه"),
        ("index_key", "ٱلله الرَّحمن", "لله الرحمن"),
        ("matcher_key", "ٱلله ﴿١٤﴾ قال، نعم 5", "ٱلله قال نعم"),
        ("light_key", "«قال» - نعم", "قال نعم"),
        ("lenient_key", "قال،نعم ۚ", "قالنعم"),
        ("bare", "\u0642\u064f\u0644\u06e1\u06e5", "\u0642\u0644"),
        ("official_diacritics", "\u0645\u064e\u062f\u064e\u0651 \u0642\u064e\u0627", "\u0645\u064e\u062f\u0651\u064e \u0642\u0627"),
        ("official_diacritics", "\u0627\u064b", "\u064b\u0627"),
        ("prompt_escape", "[a|b]", "{a,b}"),
        ("collapse", " a  b ", "a b"),
        ("strip_quotes", "“x”", "x"),
        ("drop_lone_marker", "a (1) b (2)", "a (1) b (2)"),
        ("snapped_diacritics", "a (2)", "a(2)"),
    ],
)
def test_profiles(spark, profile, text, want):
    assert one(spark, profiles.PROFILES[profile], text) == want


def test_shadda_orders_agree_after_normalising(spark):
    a, b = "\u0631\u064e\u0628\u0651\u0650", "\u0631\u064e\u0628\u0650\u0651"
    assert one(spark, profiles.official_diacritics, a) == one(spark, profiles.official_diacritics, b)
    assert one(spark, profiles.local_diacritics, a) == unicodedata.normalize("NFC", one(spark, profiles.local_diacritics, b))


@pytest.mark.parametrize("n", [10, 199, 200, 220])
def test_sequence_ratio_keeps_autojunk_and_asymmetry(spark, n):
    text = ("abcdefghij" * 30)[:n]
    for a, b in ((text, text), (text, text[5:] + text[:5]), ("tide", "diet"), ("diet", "tide")):
        assert one(spark, similarity.sequence_ratio, a, b) == SequenceMatcher(None, a, b).ratio()
        assert one(spark, lambda x, y: similarity.sequence_ratio(x, y, False), a, b) == SequenceMatcher(None, a, b, False).ratio()


def test_jaccard_is_symmetric_and_bounded(spark):
    a, b = "one two three four five", "two three four six"
    x, y = one(spark, similarity.ngram_jaccard, a, b), one(spark, similarity.ngram_jaccard, b, a)
    assert x == y and 0 < x < 1 and one(spark, similarity.ngram_jaccard, a, a) == pytest.approx(1)


def test_short_texts_are_their_own_grams(spark):
    assert one(spark, tokens.char_ngrams, "ab") == ["ab"] and one(spark, tokens.char_ngrams, "abcab") == ["abc", "bca", "cab"]
    assert one(spark, lambda c: tokens.word_ngrams(c, 3), "a b") == ["a b"] and one(spark, lambda c: tokens.word_ngrams(c, 2), "a b c") == ["a b", "b c"]


def test_phrase_and_window_scores(spark):
    assert one(spark, similarity.phrase_score, "a b c", "x a b c") == pytest.approx(1)
    assert one(spark, similarity.phrase_score, "", "a") == 0
    assert one(spark, similarity.window_score, "the quick fox", "see the quick fox run") == 1
    assert one(spark, similarity.window_score, "no such words", "see the quick fox run") == 0


@pytest.mark.parametrize("given, reference, rejected", [("قال", "قَالَ", False), ("قَالَ", "قَالَ", False), ("قِالِ", "قَالَ", True), ("قَتل", "قَالَ", False)])
def test_diacritics(spark, given, reference, rejected):
    assert one(spark, verify.diacritics_rejected, given, reference) is rejected


def test_strategies_imply_each_other(spark):
    for n in range(1, 7):
        for k in range(n + 1):
            votes = [spark.range(1).select(verify.strategy_vote(F.lit(k), F.lit(n), s)).first()[0] for s in ("all", "high", "majority", "any")]
            assert votes == sorted(votes)
    assert spark.range(1).select(verify.strategy_vote(F.lit(0), F.lit(0), "all")).first()[0] is False


def test_splitting(spark):
    assert one(spark, verify.separate_verses, "قال نعم * قال لا (١٤) ثم") == ["قال نعم", "قال لا", "ثم"]
    assert one(spark, verify.split_parts, "***") == ["***"] and one(spark, verify.split_parts, "a (1) b [٢] c") == ["a", "b", "c"]
    assert one(spark, verify.multi_verse, "قال، نعم، لا") is True and one(spark, verify.multi_verse, "قال نعم") is False
    assert one(spark, verify.clean_span, '"(قال (١٤) نعم)".').text == 'قال (١٤) نعم)".'  # three signs in a row are a separator


def test_repair_takes_the_nearest_place(spark):
    text = "ab xx ab yy ab"
    fix = lambda guess, part: one(spark, spans.repair, text, part, guess)
    assert [fix(0, "ab"), fix(4, "ab"), fix(3, "ab"), fix(99, "ab"), fix(0, "zz"), fix(0, " ")] == [0, 6, 0, 12, None, None]
    assert one(spark, spans.occurrences, "aaaa", "aa") == [0, 1, 2]


def test_json_blocks(spark):
    assert one(spark, spans.json_block, '```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, spans.json_block, 'so {"a": 1} it is') == '{"a": 1}' and one(spark, spans.json_block, "none") is None


def test_bracketed_answers(spark):
    got = one(spark, spans.bracketed, "he  said do good\nalways", "he said [ do good | ق ] always")
    assert [(s["span_start"], s["span_end"], s["tag"]) for s in got] == [(9, 16, "ق")]
    nested = one(spark, spans.bracketed, "a b c", "[ a [ b | x ] | y ] c")
    assert [(s["span_start"], s["span_end"]) for s in nested] == [(0, 3), (2, 3)]


def test_trim_ends_at_letters(spark):
    df = spark.createDataFrame([("« قال. » x",)], "t string").select(*spans.trim_to_words(F.col("t"), F.lit(0), F.lit(8)))
    assert tuple(df.first()) == (2, 5)


def test_adjacency_goes_by_sorted_position(spark):
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 5, "c"), (2, 1, "z")], "g int, n int, t string")
    got = {(r.g, r.first, r.n): r.joined for r in retrieve.adjacent_passages(p, "g", "n", "t", 2).collect()}
    assert got == {(1, 1, 1): "a", (1, 1, 2): "a (1) b (2)", (1, 2, 1): "b", (1, 2, 2): "b (2) c (5)", (1, 5, 1): "c", (2, 1, 1): "z"}


def test_containment_by_word_equals_containment_by_scan(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox run"), (2, "a b"), (3, "quick brown")], "d int, text string")
    ps = spark.createDataFrame([(1, "quick brown fox"), (2, "a b"), (3, "e quick b"), (4, "")], "p int, passage string")
    assert sorted((r.d, r.p) for r in retrieve.contained(docs, ps, "d", "p").collect()) == [(1, 1), (1, 3), (2, 2)]


def test_runs_undo_painting(spark):
    s = spark.createDataFrame([(1, 0, 5, "q", 1), (1, 5, 9, "q", 2), (1, 7, 12, "h", 3)], "d int, span_start int, span_end int, label string, span_no int")
    got = sorted((r.start, r.stop, r.label) for r in ensemble.runs(score.paint(s, "d"), "d").collect())
    assert got == [(0, 7, "q"), (7, 12, "h")]
    painted = score.paint(s, "d")
    counts = score.overlap_counts(painted, painted, spark.createDataFrame([(1, 20)], "d int, n int"), "d", "n")
    assert score.macro_f1(counts, "d").first().macro_f1 == 1


def test_votes_tie_to_no(spark):
    v = spark.createDataFrame([(1, True), (1, False), (2, True), (2, True), (2, False), (3, None)], "k int, vote boolean")
    assert {r.k: r.verdict for r in ensemble.majority(v, "k").collect()} == {1: False, 2: True, 3: False}


def test_confusion_without_rows_of_a_kind(spark):
    v = spark.createDataFrame([(True, False), (None, True)], "g boolean, p boolean")
    r = score.confusion(v, F.col("g"), F.col("p")).first()
    assert (r.tp, r.fn, r.precision, r.f1) == (0, 1, 0.0, 0.0)


def test_corrections(spark):
    s = spark.createDataFrame([(1, "do good allways and"), (2, "zzz"), (3, "")], "s int, t string")
    c = spark.createDataFrame([(1, "do good always and ever"), (2, "be kind")], "p int, x string")
    ranked = correct.candidates(s, "s", "t", c, "p", "x")
    got = {r.s: r.correction for r in correct.decide(s, "s", ranked, "x", 0.75).collect()}
    assert got == {1: "do good always and ever", 2: None, 3: None}
    assert one(spark, correct.snap, "good always", "do good always and ever") == "good always"
    parts = spark.createDataFrame([(1, 0, "a", 3, 0.9), (1, 1, None, None, 0.1), (1, 2, "b", 4, 0.8)], "s int, i int, c string, n int, similarity double")
    assert tuple(correct.decide_parts(parts, "s", "i", "c", "n").first()) == (1, "a(3) b(4)", 0.8, 2)
    with pytest.raises(Exception, match="unknown span type"):
        one(spark, correct.threshold_of, "Poem")


def test_verification(spark):
    s = spark.createDataFrame([(1, "قال الله نعم"), (2, "قال الله نعم يا قوم"), (3, "لا شيء")], "s int, t string")
    c = spark.createDataFrame([(1, "قال الله نعم"), (2, "ثم قال الله نعم يا قوم الخير")], "p int, x string")
    got = {r.s: (r.is_match, r.p, r.match_type) for r in verify.verify_verses(s, "s", "t", c, "p", "x").collect()}
    assert got == {1: (True, 1, "exact"), 2: (True, 2, "substring"), 3: (False, None, None)}


def test_sources_round_trip(spark, tmp_path):
    xml = "<Question><ID> 1 </ID><Text>a</Text><Response>x &lt; y\n</Response></Question>\n<Question><ID>2</ID><Response>z</Response></Question>"
    (tmp_path / "q.xml").write_text(xml)
    assert [(r.id, r.response) for r in io.read_xml(spark, str(tmp_path / "q.xml"), strip=True, unescape=True).collect()] == [("1", "x < y"), ("2", "z")]
    df = spark.createDataFrame([(1, None), (2, 'say "b"')], "k int, t string")
    io.write_tsv(df, str(tmp_path / "t"), False, sentinel=correct.SENTINEL)
    assert sorted(map(tuple, io.read_tsv(spark, str(tmp_path / "t"), "k int, t string", header=False).collect())) == [(1, correct.SENTINEL), (2, 'say "b"')]
    (tmp_path / "c.json").write_text('[{"surah_id": 1, "surah_name": "x", "ayah_id": 1, "ayah_text": "t"}, null]')
    assert io.read_json_array(spark, str(tmp_path / "c.json"), io.VERSES_SCHEMA).count() == 1
    lines = io.verdict_lines(spark.createDataFrame([(0, True), (1, None), (2, False)], "i int, v boolean"), "i", F.col("v"))
    assert [tuple(r) for r in lines.collect()] == [(1, "Correct"), (3, "Incorrect")]


def test_resumption(spark, tmp_path):
    items = spark.range(5).selectExpr("id AS k")
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        annotate_stream(stream, lambda d: d.withColumn("v", F.col("k") * 2), str(tmp_path / "out"), str(tmp_path / "cp"), "r").awaitTermination(60)
    done = results(spark, str(tmp_path / "out"))
    assert done.count() == 5 and remaining(spark.range(7).selectExpr("id AS k"), done, "k").count() == 2
