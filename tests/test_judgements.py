"""Operators of verification by parts, correction, answers, scores and sources: rules against plain Python and hand-made cases."""

import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from florilege.functions import similarity
from florilege.operators import answers, correct, parts, report, retrieve, score, spans, verify
from florilege.sources import io


def one(spark, row: dict, *columns):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {v}" for k, v in zip(row, ["string" if isinstance(x, str) or x is None else "int" for x in row.values()]))).select(*columns).first()


ISSUES = {
    "": ["empty_or_whitespace"], "  \n": ["empty_or_whitespace"], None: ["empty_or_whitespace"], " سلام ": [], "سلام.": ["ends_with_non_arabic", "ends_with_forbidden_punctuation", "contains_non_arabic_chars"],
    "سلام،": ["ends_with_forbidden_punctuation"], "(سلام)": ["starts_with_non_arabic", "ends_with_non_arabic", "contains_forbidden_chars", "ends_with_forbidden_punctuation", "contains_delimiters"],
    "سلام * سلام": ["contains_forbidden_chars", "contains_verse_separator"], "«سلام»": ["starts_with_non_arabic", "ends_with_non_arabic", "contains_forbidden_chars", "contains_quotes"], "سلام  سلام": ["excessive_whitespace"],
    "سلام x سلام": ["contains_non_arabic_chars"],
}


def test_issue_codes_and_report(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(ISSUES)], "i int, s string")
    got = {r.s: r.x for r in rows.select("s", verify.issues(F.col("s")).alias("x")).collect()}
    assert got == ISSUES
    total, codes = verify.dataset_report(rows, "s")
    t = total.first()
    assert (t.total_spans, t.valid_spans, t.invalid_spans, round(t.validation_rate, 6)) == (11, 1, 10, round(1 / 11, 6))
    assert {r.issue: r.n for r in codes.collect()}["empty_or_whitespace"] == 3
    assert verify.dataset_report(rows.limit(0), "s")[0].first().validation_rate == 0.0
    r = one(spark, {"s": " سلام x سلام"}, verify.span_report(F.col("s")).alias("r"), verify.describe(F.lit("contains_quotes")).alias("d"), verify.describe(F.lit("q")).alias("u"))
    assert (r.r.n_chars, r.r.n_arabic, [(b.char, b.place) for b in r.r.bad], r.r.bad_names) == (11, 8, [("x", 5)], ["LATIN SMALL LETTER X"])
    assert r.d == "Contains quotation marks" and r.u == "Unknown issue: q"


def test_separators(spark):
    cases = {"سلام (١٤) سلام * abc": (["asterisk", "parenthetical_numbers", "non_arabic_sequences"], None), "س، س، س": (["arabic_comma_smart"], "multiple_commas"), "س، س": ([], None), "س، و" + "س" * 20: (["arabic_comma_smart"], "comma_followed_by_waw"),
             "س" * 150 + "," + "س" * 100: (["regular_comma_smart"], "long_text_middle_comma"), "س" * 250 + "," + "س": (["regular_comma_smart"], "comma_near_end"), "": ([], None)}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", verify.separator_report(F.col("s")).alias("r"), verify.separator_chars(F.col("s")).alias("n"), verify.is_arabic(F.col("s")).alias("a"))
    got = {r.s: r for r in rows.collect()}
    # A number in parentheses is a run of three characters where its digits aren't Arabic ones.
    assert {s: (r.r.types, r.r.comma_reason) for s, r in got.items()} == cases
    first = next(iter(cases))
    assert got[first].n == 1 + 3 + len("(١٤)") and not got[first].a and not got[""].a and got["س، س"].a


BASE = ["the deed is judged by its intention and every man has what he intended", "whoever believes in the day let him speak good or be silent", "short words here"]


def test_narrations_by_length(spark):
    corpus = spark.createDataFrame(list(enumerate(BASE)), "item_id int, passage string")
    cases = ["The deed is judged by its intention and every man has what he intended!", "let him speak good or", "let him speak gold or", "whoever believes in the day let him speak good or be silents", "nothing known at all", "", None]
    q = spark.createDataFrame(list(enumerate(cases)), "i int, s string")
    got = {r.i: r for r in parts.verify_narrations(q, "i", "s", corpus, "item_id", "passage").collect()}
    assert [got[i].match_type for i in range(7)] == ["exact", "substring", "fuzzy_substring", "full_similarity", None, None, None]
    assert [got[i].item_id for i in range(7)] == [0, 1, 1, 1, None, None, None] and [got[i].is_match for i in range(7)] == [True] * 4 + [False] * 3
    assert got[3].similarity == pytest.approx(SequenceMatcher(None, cases[3], BASE[1]).ratio())


def test_candidates_stop_once_there_are_enough(spark):
    corpus = spark.createDataFrame([(i, "aaa" if i < 6 else "bbb" if i < 9 else "ccc") for i in range(12)], "p int, t string")
    q = spark.createDataFrame([(1, "aaa bbb ccc")], "i int, s string")
    ids = lambda **k: sorted(r.p for r in parts.narration_candidates(q, "i", "s", corpus, "p", "t", **k).collect())
    assert ids() == list(range(12)) and ids(enough=5) == list(range(6)) and ids(enough=6) == list(range(9)) and ids(most=4) == [0, 1, 2, 3]


def test_windows_stop_after_twenty(spark):
    query, reference = "alpha beta gamma delta", " ".join(["alpha beta zeta delta"] + [f"w{i}" for i in range(60)] + ["alpha beta gamma delta"])
    assert one(spark, {"a": query, "b": reference}, similarity.window_score(F.col("a"), F.col("b")).alias("x")).x < 1.0


def test_containment_counts_the_longest_common_substring(spark):
    assert one(spark, {"a": "abcdefgh", "b": "xxcdefyy"}, similarity.containment(F.col("a"), F.col("b")).alias("x")).x == pytest.approx(0.3 * 4 / 8 + 0.3 * 4 / 8)


def test_dispatch_of_kinds_and_parts(spark):
    corpus = spark.createDataFrame(list(enumerate([*BASE, "قل هو الله احد", "الله الصمد"])), "item_id int, passage string")
    cases = [("Hadith", BASE[0]), ("Hadith", f"{BASE[0]} * {BASE[1]} * abc"), ("Ayah", "قل هو الله احد"), ("Ayah", "قل هو الله احد * الله الصمد"), ("Poem", "x"), (None, "x"), ("Hadith", None)]
    q = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(cases)], "i int, k string, s string")
    got = {r.i: (r.multi, r.n_parts, r.n_matched, r.is_match, r.error) for r in parts.verify_spans(q, "i", "s", "k", corpus, corpus, "item_id", "passage").collect()}
    assert got == {0: (False, 1, 1, True, None), 1: (True, 3, 2, True, None), 2: (False, 1, 1, True, None), 3: (True, 2, 2, True, None), 4: (False, None, None, None, "unknown text type: Poem"), 5: (False, None, None, None, "unknown text type: null"), 6: (False, 1, 0, False, None)}


def test_runs_have_no_gaps_and_cross_passages_are_found(spark):
    rows = [(1, 1, "a b c d"), (1, 2, "e f g h"), (1, 4, "i j k l"), (1, 5, "m n o p"), (1, 6, "q r s t"), (2, 7, "u v w x")]
    corpus = spark.createDataFrame([(g, n, " ".join(w * 3 for w in t.split())) for g, n, t in rows], "grp int, num int, passage string")
    runs = sorted((r["first"], r.n) for r in correct.consecutive_runs(corpus, "grp", "num", "passage").collect())
    assert runs == [(1, 2), (4, 2), (4, 3), (5, 2)]
    q = spark.createDataFrame([(1, "iii jjj kkk lll mmm nnn ooo ppp"), (2, "aaa bbb ccc")], "i int, s string")
    got = [(r.i, r["first"], r.n, r.similarity, r.correction) for r in correct.cross_passages(q, "i", "s", corpus, "grp", "num", "passage").collect()]
    assert got == [(1, 4, 2, 1.0, "iii jjj kkk lll(4) mmm nnn ooo ppp(5)")]


def test_canonical_passage_needs_shared_words(spark):
    corpus = spark.createDataFrame(list(enumerate(BASE)), "p int, t string")
    preds = spark.createDataFrame([(0, BASE[0][4:]), (1, "short"), (2, "خطأ"), (3, ""), (4, "whoever believes zzzz")], "k int, x string")
    verse = {r.k: r.p for r in correct.canonical(preds, "k", "x", corpus, "p", "t").collect()}
    assert verse == {0: 0, 1: None, 2: None, 3: None, 4: None}
    fixed = {r.k: r.correction for r in correct.snapped(preds, "k", "x", corpus, "p", "t").collect()}
    assert fixed[0] == BASE[0] and fixed[4] is None and fixed[1] is None


def test_spans_are_put_in_place(spark):
    text = "0123456789 hello world " + "x" * 100 + " hello"
    rows = [("hello world", "q", 11, 22), ("hello  world", "h", 11, 22), ("hello", "h", 30, 35), ("hello", "h", 90, 95), ("gone", "q", 0, 4), (" ", "q", 0, 1), ("hello", "z", 11, 16), ("hello", "q", 11, 999), ("hello", "q", 16, 11)]
    df = spark.createDataFrame([(i, text, *r) for i, r in enumerate(rows)], "i int, text string, span string, kind string, start int, stop int")
    got = {r.i: (r.span_start, r.span_end, r.tag) for r in answers.place_spans(df).collect()}
    assert got == {0: (11, 22, "ق"), 1: (11, 22, "ح"), 2: (11, 16, "ق"), 3: (124, 129, "ق")}
    assert one(spark, {"t": "abc", "s": "bc"}, answers.inclusive_slice(F.col("t"), F.lit(1), F.lit(2), F.col("s")).alias("x")).x


def test_answers_become_verdicts(spark):
    a = spark.createDataFrame([("q1", '```json\n{"validations": [{"index": 1, "label": "CorrectAyah"}, {"index": "2", "label": "Maybe"}, {"index": 1, "label": "WrongAyah "}]}\n```'), ("q2", "{broken")], "k string, a string")
    s = spark.createDataFrame([("q1", 1, "Ayah"), ("q1", 2, "Hadith"), ("q2", 1, "Ayah"), ("q3", 1, "Hadith")], "k string, n int, t string")
    got = {(r.k, r.n): r.predicted for r in answers.verdicts(a, "k", "a", s, "n", "t").collect()}
    assert got == {("q1", 1): "WrongAyah", ("q1", 2): "WrongHadith", ("q2", 1): "WrongAyah", ("q3", 1): "WrongHadith"}


def test_broken_json_is_no_block(spark):
    cases = {'x {"a": 1} y': '{"a": 1}', '{"a": ': None, 'x {"a": 1} {': '{"a": 1}', 'x {"a": 1} b }': None, '{"a": 1}, {"b": 2}': None, "```json\n[1]\n```": "[1]", "none": None}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", spans.json_block(F.col("s")).alias("b")).collect()
    assert {r.s: r.b for r in rows} == cases


def test_detector_and_scorer_are_plain_functions(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "fail")], "i int, p string")

    def make():
        def call(text):
            if text == "fail":
                raise ValueError("no")
            return text.upper()

        return call

    got = {r.i: (r.answer, r.error) for r in answers.detect(rows, "i", "p", "upper", make, wait=0.0).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no")}
    assert {r.error for r in answers.detect(rows, "i", "p", "nobody", lambda: None).collect()} == {"no client"}
    good = answers.scored(rows, "p", "p", lambda: lambda texts: [0.0] * len(texts)).collect()
    bad = answers.scored(rows, "p", "p", lambda: lambda texts: 1 / 0).collect()
    assert {r.rerank_score for r in good} == {0.5} and {r.rerank_score for r in bad} == {0.0}


def test_official_scores_of_every_branch(spark):
    refs = [("a", 1, "Ayah", 0, 4), ("b", 1, "NoAnnotation", 0, 0), ("c", 1, "NoAnnotation", 0, 0), ("d", 1, "Hadith", 0, 5), ("e", 1, "Ayah", 0, 5)]
    preds = [("a", 1, "Ayah", 0, 2), ("b", 1, "No_Spans", 0, 0), ("c", 1, "Ayah", 0, 3), ("d", 1, "No_Spans", 0, 0)]
    r = spark.createDataFrame(refs, "k string, span_no int, label string, span_start long, span_end long")
    p = spark.createDataFrame(preds, "k string, span_no int, span_type string, span_start long, span_end long")
    texts = spark.createDataFrame([(k, 10) for k in "abcde"], "k string, len int")
    got = {x.k: x.score for x in score.official_scores(r, p, texts, "k", "len").collect()}
    assert got == {"a": pytest.approx((2 * 2 / 6 + 2 * 6 / 14) / 2), "b": 1.0, "c": 0.0, "d": 0.0, "e": None}
    for bad in (("a", 1, "Ayah", 0, 11), ("a", 1, "Ayah", 5, 4), ("a", 1, "Other", 0, 1)):
        with pytest.raises(Exception, match="bounds|span_type"):
            score.official_scores(r, spark.createDataFrame([bad], p.schema), texts, "k", "len").collect()


def test_ensemble_scores_of_equal_sides_are_one(spark):
    schema = "k string, span_no int, label string, span_start long, span_end long"
    g = spark.createDataFrame([("a", 1, "Ayah", 0, 4), ("b", 1, "Ayah", 0, 4)], schema)
    p = spark.createDataFrame([("a", 1, "Ayah", 0, 4), ("b", 1, "Hadith", 0, 4)], schema)
    got = {r.k: (r.macro_f1, r.f1_ayah, r.f1_hadith, r.f1_neither) for r in score.ensemble_f1(g, p, "k").collect()}
    assert got["a"] == (1.0, 1.0, 1.0, 1.0) and got["b"] == (pytest.approx(1 / 3), 0.0, 0.0, 1.0)


def test_statistics_without_rows(spark):
    s = report.correction_statistics(spark.createDataFrame([], "correction string, confidence double")).first()
    assert (s.total, s.corrected, s.corrected_pct, s.mean_confidence) == (0, 0, 0.0, None)


def test_numbers_follow_the_order_over_partitions(spark):
    rows = retrieve.numbered(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("x")), "place", "x")
    assert all(r.place == r.x + 1 for r in rows.collect())


def test_bracketed_spans_with_several_tags_and_changed_words(spark):
    source, answer = "he said  be kind to all and left", "he said [ be kin to all | ق | ح ] and left"
    got = spark.createDataFrame([(source, answer)], "s string, a string").select(spans.bracketed("s", "a").alias("x")).first().x
    assert [(x.span_start, x.span_end, x.tag) for x in got] == [(9, 23, "ق"), (9, 23, "ح")]


def test_sources_of_other_shapes(spark, tmp_path):
    xml = "<r><Question ID='7'><Body>hello world</Body></Question></r>"
    rows = spark.createDataFrame([(xml, "7"), (xml, "8"), ("<r>", "7"), (None, "7")], "xml string, q string")
    assert [r.x for r in rows.select(io.body_slice(rows, F.col("q"), F.lit(0), F.lit(5)).alias("x")).collect()] == ["hello", None, None, None]
    xml = '<D><Question ID="1"><Body>hello there</Body></Question><Question ID="1"><Body>late</Body></Question><Question ID="2"><P><Body>b</Body></P></Question><Question ID="3"/><Question><Body>x</Body></Question></D>'
    documents = spark.createDataFrame([("a", xml), ("b", "<D>"), ("c", None)], "d string, xml string")
    spans = spark.createDataFrame([("a", "1", 6, 11), ("a", "1", 0, 5), ("a", "1", 0, 5), ("a", "2", 0, 1), ("a", "2", 5, 9), ("a", "3", 0, 1), ("a", "4", 0, 1), ("a", None, 0, 1), ("b", "1", 0, 1), ("c", "1", 0, 1), (None, "1", 0, 1)], "d string, q string, s int, e int")
    got = [(r.d, r.q, r.s, r.slice) for r in io.body_slices(spans, documents, "d", "q", "s", "e").collect()]
    want = {("a", "1", 6): "there", ("a", "1", 0): "hello", ("a", "2", 0): "b"}
    assert len(got) == 11 and all(x == want.get((d, q, s)) for d, q, s, x in got)
    io.write_csv(spark.createDataFrame([("a,b", 'c"d\ne')], "x string, y string"), f"{tmp_path}/t.csv")
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_path}/t.csv", "x string, y string").collect()] == [("a,b", 'c"d\ne')]
    assert io.read_first(spark, "x string, y string", f"{tmp_path}/no.csv", f"{tmp_path}/t.csv").columns == ["x", "y"]
    with pytest.raises(FileNotFoundError):
        io.read_first(spark, "x string", f"{tmp_path}/no.csv", None)
    post = retrieve.postings(spark.createDataFrame([(1, "a b a")], "i int, t string"), "i", F.split("t", " "))
    assert io.read_index(spark, f"{tmp_path}/index") is None
    io.write_index(post, retrieve.index_statistics(post, "i"), f"{tmp_path}/index")
    held, stats = io.read_index(spark, f"{tmp_path}/index")
    assert held.count() == 2 and stats.first().postings == 2
    folder = tmp_path / "sub"
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        io.submission_file(spark, str(folder))
    for name in (".hidden.tsv", "b.txt"):
        (folder / name).write_text("x")
    assert io.submission_file(spark, str(folder)).endswith("b.txt")
    (folder / "c.tsv").write_text("x")
    assert io.submission_file(spark, str(folder)).endswith("c.tsv")
    results = spark.read.json(spark.sparkContext.parallelize([json.dumps({"model": "m", "subtask": "1A", "file": "f", "aggregate_metrics": {"macro_f1": 0.5, "per_class": {"ayah": 0.25}}})]))
    flat = report.flatten_results(results, {"macro_f1": "macro_f1", "f1_ayah": "per_class.ayah", "accuracy": "accuracy"}).first()
    assert (flat.macro_f1, flat.f1_ayah, flat.accuracy) == (0.5, 0.25, None)


def test_places_of_a_part_that_overlaps_itself(spark):
    text = "ababa" * 40
    got = one(spark, {"t": text, "p": "aba"}, spans.occurrences(F.col("t"), F.col("p")).alias("x")).x
    assert got == [m.start() for m in re.finditer("(?=aba)", text)]


@pytest.mark.parametrize("enough,most", [(3, 4), (8, 3), (20, 50), (1, 1), (1000, 500)])
def test_common_words_end_the_search_for_narrations(spark, enough, most):
    """Against the loop: words in order until over `enough` passages are found, then the first `most`."""
    rng = random.Random(enough)
    word = lambda: rng.choice(["the"] * 6 + ["and"] * 4 + ["ab"] + [f"w{i:02d}" for i in range(40)])
    corpus = [(i, " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(80)] + [(3, "the w01"), (3, "the w01"), (200, ""), (201, None)]
    spans = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 8, 30])))) for i in range(60)] + [(100, None), (101, "")]
    want = set()
    for i, s in spans:
        w, found = (s or "").split(), set()
        for x in w[:15] if len(w) > 20 else w:
            found |= {p for p, t in corpus if len(x) >= 3 and x in (t or "").split()}
            if len(found) > enough:
                break
        want |= {(i, p) for p in sorted(found)[:most]}
    q, c = spark.createDataFrame(spans, "i long, s string"), spark.createDataFrame(corpus, "p long, t string")
    got = [tuple(r) for r in parts.narration_candidates(q, "i", "s", c, "p", "t", enough, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want
