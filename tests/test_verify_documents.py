"""verify_exact_then_fuzzy judges every line of every document."""

from difflib import SequenceMatcher

import __spark_entry__
from conftest import DATA
from florilege.functions import profiles
from pyspark.sql import functions as F


def test_every_line_of_the_documents(spark):
    key = lambda rows: {r[0]: r[1] for r in rows}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    spans = [(-(i * 1_000_000 + n + 1), x) for i, t in docs.items() for n, x in enumerate(t.split("\n")) if x.strip(" ")]
    q = key(spark.createDataFrame(spans, "id long, s string").select("id", profiles.verse_key(F.col("s"))).collect())
    c = key(spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", profiles.verse_key(F.col("text"))).collect())
    got = {r.span_id: r for r in __spark_entry__.queries()["verify_exact_then_fuzzy"](spark, DATA).collect() if r.span_id < 0}
    assert set(got) == set(q)
    token = lambda t: {w for w in t.split() if len(w) >= 3}
    tokens = {i: token(t) for i, t in c.items()}
    for i, t in list(q.items())[::7]:
        mine = token(t)
        def ratio(p):
            m = SequenceMatcher(None, t, p)
            return m.ratio() if m.real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 else 0.0
        exact = t in c.values()
        match = exact or any(mine & tokens[j] and (t in p or ratio(p) >= 0.85) for j, p in c.items())
        assert got[i].is_match == match, (i, t)
        assert (got[i].match_type == "exact") == exact
