"""The detector of quotations against a scan in plain Python."""

import random
import re

from pyspark.sql import functions as F

from florilege.operators import spans


def brute(doc_id, text, least=10):
    out, i, close = [], 0, {'"': '"', "«": "»", "“": "”"}
    while i < len(text):
        end = text.find(close[text[i]], i + 1) if text[i] in close else -1
        if end - i - 1 < 3:
            i += 1
            continue
        b, e = i, end + 1
        while b < e and not text[b].isalnum():
            b += 1
        while e > b and not text[e - 1].isalnum():
            e -= 1
        if sum(c.isalpha() for c in text[b:e]) >= least:
            out.append((doc_id, b, e, text[b:e]))
        i = end + 1
    return out


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(tuple(r) for r in spans.quoted(docs).collect())


def test_long_and_repeated_quotations(spark):
    line = "the same words again"
    long = "word " * 2_000
    texts = [f'"{line}" 𝄞 "{line}"\n«{line}»\n"{line}"', f'x "{long}" y “{long}”', f'"{long}', None, "", '""', f'"ab" "{line}"']
    got = found(spark, texts)
    assert got == sorted(x for i, t in enumerate(texts) for x in brute(i, t or ""))
    assert [r[1] for r in got if r[0] == 0] == [1, 26, 49, 72]
    assert max(r[2] - r[1] for r in got) == len(long.strip())


def test_equals_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(['"', "«", "»", "“", "”", "\n", " ", "a", "bé", "𝄞", "some words here", "9."]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    assert found(spark, texts) == sorted(x for i, t in enumerate(texts) for x in brute(i, t))


def test_repeated_rows_each_have_their_spans(spark):
    docs = spark.createDataFrame([(1, '"ten letters here"')] * 2, "doc_id long, text string")
    assert spans.quoted(docs).count() == 2


def test_many_quotations_in_one_text(spark):
    n = 40_000
    (r,) = spans.quoted(spark.createDataFrame([(1, ' "ten letters x"' * n), (2, "none"), (3, None)], "doc_id long, text string")).agg(F.count("*").alias("n"), F.max("span_start").alias("last"), F.countDistinct("span_start").alias("kinds")).collect()
    assert (r.n, r.kinds, r.last) == (n, n, 16 * (n - 1) + 2)
