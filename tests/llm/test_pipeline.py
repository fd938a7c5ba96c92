"""run() against the stages' definitions written out in plain Python, on the smallest table."""

import hashlib

import duckdb

import corpus_pipeline
from conftest import DATA
from florilege.llm import queries
from florilege.llm.packing import CAPACITIES
from test_jaccard import brute as near_brute
from test_operators import quality_brute


def expected():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op10_quality_rules']}) WHERE kept").fetchall()}
    docs = [(i, t or "") for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in kept]
    last = {}
    for i, t in docs:
        last[t] = max(i, last.get(t, i))
    docs = [(i, t) for i, t in docs if last[t] == i]
    docs = [(i, dict(docs)[i]) for i, _, c in near_brute(docs) if i == c]
    seen = {}
    for i, t in docs:
        raw = t.encode()
        for p in range(len(raw) - 199):
            seen.setdefault(raw[p : p + 200], []).append((i, p))
    gone = {i: bytearray(len(t.encode())) for i, t in docs}
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            gone[i][p : p + 200] = b"\1" * 200
    out = {}
    for i, t in docs:
        if any(gone[i]):
            t = bytes(b for b, g in zip(t.encode(), gone[i]) if not g).decode("utf-8", "ignore")
        if t or not any(gone[i]):
            out[i] = t
    return out


def test_run(spark):
    want = expected()
    rows = corpus_pipeline.run(spark, DATA).collect()
    total, bins = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert total == {i: max(1, quality_brute(t)[0]) for i, t in want.items()}
    assert all(r.capacity == min(c for c in CAPACITIES if c >= bins[r.bin_id]) for r in rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    texts = expected()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = docs.checkpoint()
    assert {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in docs.collect()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts.items()}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
