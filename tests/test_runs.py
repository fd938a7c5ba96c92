"""Resumed runs: every item once, the run's own total, the right status; and postings of two forms."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from florilege.functions import profiles
from florilege.operators import retrieve, verify
from florilege.streaming import resume


def write_items(spark, folder, ids):
    spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_killed_and_restarted_stream_has_each_row_once(spark, tmp_path):
    items, out, checkpoint = (f"{tmp_path}/{x}" for x in ("items", "out", "checkpoint"))
    for k in range(3):
        write_items(spark, items, range(10 * k, 10 * k + 10))
    resume.begin_run(spark, out, "r1", 30)
    stop = {"at": 1}

    def annotate(batch):
        made = batch.withColumn("score", F.col("id") / 10).withColumn("error", F.when(F.col("id") == 4, "timeout"))
        if stop["at"] == 0:
            raise RuntimeError("killed")
        stop["at"] -= 1
        return made

    with pytest.raises(Exception, match="killed"):
        resume.annotate_stream(stream(spark, items), annotate, out, checkpoint, "r1").processAllAvailable()
    part = resume.run_status(resume.runs(spark, out), resume.results(spark, out), error=F.col("error"), score="score").first()
    assert (part.n_total, part.n_done, part.n_failed, part.status) == (30, 10, 1, "in_progress")
    # What is left is not the run's total.
    resume.begin_run(spark, out, "r1", 20)
    stop["at"] = 100
    resume.annotate_stream(stream(spark, items), annotate, out, checkpoint, "r1").awaitTermination()
    # The last batch's commit is lost after its results were written: it is run again, in its own place.
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    for crc in glob.glob(f"{checkpoint}/commits/.*.crc"):
        os.remove(crc)
    resume.annotate_stream(stream(spark, items), annotate, out, checkpoint, "r1").awaitTermination()
    resume.annotate_stream(stream(spark, items), annotate, out, checkpoint, "r1").awaitTermination()
    assert sorted(r.id for r in resume.results(spark, out).collect()) == list(range(30))
    done = resume.run_status(resume.runs(spark, out), resume.results(spark, out), error=F.col("error"), score="score").first()
    assert (done.n_total, done.n_done, done.n_failed, done.status) == (30, 30, 1, "complete")
    assert done.score == pytest.approx(sum(i / 10 for i in range(30) if i != 4) / 29)


def test_a_run_without_results_is_in_progress(spark):
    none = spark.createDataFrame([], "run string, m double")
    r = resume.run_status(spark.createDataFrame([("a", 3)], "run string, n_total long"), none, mean="m").first()
    assert (r.n_done, r.n_failed, r.status, r["mean"]) == (0, 0, "in_progress", 0.0)


TEXTS = {1: "قَالَ مُوسَى لِقَوْمِهِ", 2: "قال موسى", 3: "قَالَ رَبُّكَ لِلْمَلَائِكَةِ قَالَ", 4: None, 5: "ٱلْحَمْدُ"}


def plain(t):
    t = re.sub("[ً-ْٰـ]", "", t or "")
    return re.sub(r"[^ء-غف-ي\s]", "", t).split()


def test_postings_and_candidates_of_two_forms(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "d int, t string")
    post = retrieve.two_form_postings(docs, "d", F.col("t"))
    index = {}
    for d, t in TEXTS.items():
        for w in {*(t or "").split(), *plain(t)}:
            index.setdefault(w, set()).add(d)
    got = {}
    for r in post.collect():
        assert r.d not in got.setdefault(r.token, set())
        got[r.token].add(r.d)
    assert got == index
    queries = {1: ["قَالَ", "مُوسَى"], 2: ["قال"], 3: ["قَالَ", "قَالَ", "زيد"], 4: []}
    q = spark.createDataFrame(list(queries.items()), "q int, w array<string>")
    found = {(r.q, r.d): r.hits for r in retrieve.two_form_candidates(q, "q", F.col("w"), post, "d").collect()}
    want = {}
    for k, ws in queries.items():
        hits = {}
        for w in ws:
            norm = " ".join(plain(w))
            for form in [w, *([norm] if norm and norm != w else [])]:
                for d in index.get(form, ()):
                    hits[d] = hits.get(d, 0) + 1
        want |= {(k, d): n for d, n in hits.items() if n >= max(1, int(0.6 * len(ws)))}
    assert found == want and want
    asked = spark.createDataFrame([("قَالَ",), ("زيد",)], "word string")
    assert sorted((r.word, r.d) for r in retrieve.two_form_query(asked, "word", post, "d", 2).collect()) == [("قَالَ", 1), ("قَالَ", 2)]


BLOCKS = [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]
FORBIDDEN = set('*()[]{}﴾﴿"«»“”‘’')
END = set(".,،;؛:؞؍!؟?﴾﴿)]}…")


def clean_brute(span):
    """The rules, character by character."""
    arabic = lambda c: any(a <= ord(c) <= b for a, b in BLOCKS)

    def separates(t, i):
        if t[i] in "*،,":
            return True
        if any(m.start() <= i < m.end() for m in re.finditer(r"\([٠-٩0-9]+\)", t)):
            return True
        ink = lambda c: not arabic(c) and not c.isspace()
        if not ink(t[i]):
            return False
        a = b = i
        while a > 0 and ink(t[a - 1]):
            a -= 1
        while b + 1 < len(t) and ink(t[b + 1]):
            b += 1
        return b - a + 1 >= 3

    if not span:
        return "", ["empty_input"]
    t, done = span.strip(), []
    gone = {c for i, c in enumerate(t) if c in FORBIDDEN and not separates(t, i)}
    t = "".join(c for i, c in enumerate(t) if c not in FORBIDDEN or separates(t, i))
    if gone:
        done.append("removed_forbidden_chars: " + "".join(sorted(gone)))
    while True:
        before = t
        for side, at in (("start", 0), ("end", -1)):
            while t and (not (arabic(t[at]) or t[at].isspace()) or t[at] in END) and not separates(t, at % len(t)):
                done.append(f"removed_{side}_{'punctuation' if t[at] in END else 'non_arabic'}: {t[at]}")
                t = t[1:].lstrip() if at == 0 else t[:-1].rstrip()
        if re.search(r"\.{2,}$", t):
            t = re.sub(r"\.+$", "", t).rstrip()
            done.append("removed_trailing_dots")
        if t == before:
            break
    if re.search(r"\s{2,}", t):
        t = re.sub(r"\s+", " ", t)
        done.append("normalized_whitespace")
    return t.strip(), done


def test_cleaned_spans_against_the_rules(spark):
    import random

    rng = random.Random(12)
    signs = ["قال", "ربك", " ", "  ", ".", "..", "...", "،", ",", "؟", "(", ")", "(١٢)", "(7)", "«", "»", '"', "*", "a", "ab", "abc", "[", "]", "!", "٣", "\n", "’"]
    spans = [None, "", "   ", "...", "«»", "قال ...", "(12) قال", "قال x."] + ["".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(spans)), "i int, s string").select("i", verify.clean_span(F.col("s")).alias("c"))
    for r in df.collect():
        assert (r.c.text, r.c.applied) == clean_brute(spans[r.i]), spans[r.i]


def test_stripped_forms_are_the_profiles(spark):
    (r,) = spark.createDataFrame([("قَالَ ۚ رَبُّكَ",)], "t string").select(profiles.index_key(F.col("t")).alias("x")).collect()
    assert r.x == "قال ربك"
