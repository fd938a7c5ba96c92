"""Repeated rows and null ids in the pipeline: one document of each group stays."""

import random
from collections import Counter

import corpus_pipeline
from conftest import DATA
from test_jaccard import brute as near_brute
from test_operators import quality_brute
from test_pipeline import expected


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")


def kept(stage, spark, rows):
    return Counter(tuple(r) for r in stage(spark, frame(spark, rows), DATA).collect())


def test_exact_keeps_one_row_of_each_text(spark):
    a, b, c = text(1), text(2), text(3)
    rows = [(1, a, "en"), (1, a, "de"), (1, a, "en"), (None, b, "en"), (None, b, "en"), (None, c, "en"), (2, c, "en"), (2, a[:50], "en"), (None, None, "en"), (None, "", "en")]
    got = kept(corpus_pipeline.exact, spark, rows)
    assert Counter(t or "" for _, t, _ in got.elements()) == Counter([a, b, c, a[:50], ""])
    assert got[(1, a, "de")] == 1 and got[(2, c, "en")] == 1


def test_near_keeps_one_row_of_each_group(spark):
    a, b, c = text(4), text(5), text(6)
    rows = [(1, a, "en"), (1, a, "en"), (1, a + " more", "en"), (None, b, "en"), (None, b, "en"), (None, b + " more", "en"), (None, c, "en"), (3, "", "en"), (None, "", "en")]
    got = [t for _, t, _ in kept(corpus_pipeline.near, spark, rows).elements()]
    assert len(got) == 5
    assert {t[:50] for t in got} == {a[:50], b[:50], c[:50], ""}


def test_run_with_repeated_rows_and_null_ids(spark, tmp_path):
    want = expected()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labelled = {r.doc_id for r in labels.collect()}
    sizes = Counter(c for _, _, c in near_brute([(i, t or "") for i, t in texts.items()]))
    alone = {i for i, _, c in near_brute([(i, t or "") for i, t in texts.items()]) if sizes[c] == 1}
    lost = next(i for i, t in sorted(want.items()) if i not in labelled and i in alone and t == texts[i] and len(t) > 400)
    free = docs.filter(~docs.doc_id.isin(*labelled, lost))
    nameless = docs.filter(docs.doc_id == lost).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")
    other = nameless.selectExpr("doc_id", "text || ' more' AS text", "lang", "source", "n_chars")
    docs.filter(docs.doc_id != lost).union(free).union(nameless).union(nameless).union(other).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    total = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r.doc_id] += r.n_tokens
    n = quality_brute(want[lost])[0]
    assert total.pop(None) in (n, n + 1)
    assert total == {i: max(1, quality_brute(t)[0]) for i, t in want.items() if i != lost}


def test_passages_keeps_the_signs_that_a_text_has_and_no_half_character(spark):
    shared = "é" * 150
    rows = [(1, "alpha � beta " + "a" + shared, "en"), (2, "gamma � " + "b" + shared + "�", "en"), (3, "x" * 250, "en"), (4, "p Ḁ" + text(9, 40), "en"), (5, "q ἀ" + text(9, 40), "en")]
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, frame(spark, rows), DATA).collect()}
    # The last byte of Ḁ and of ἀ is the same, and stands before the passage that both texts have.
    assert got[1] == "alpha � beta a" and got[2] == "gamma � b�" and got[4] == "p " and got[5] == "q "
    assert 3 not in got
