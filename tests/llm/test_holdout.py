"""Certified cutoffs against the SQL, with labels enough for some; repeated documents are one trial."""

import random

import duckdb

from florilege.llm import queries, quality_rules


def text(rng, n, junk=0, repeat=0):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    return "\n".join([" ".join(words[i : i + 9]) for i in range(0, n, 9)] + [" ".join(words[:9])] * repeat) + " " + "#" * junk


def table(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_cutoffs_in_force_equal_the_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, text(rng, 70, rng.randrange(0, 3)), "en") for i in range(420)] + [(1000 + i, text(rng, 70, rng.randrange(20, 300), rng.randrange(0, 9)), "en") for i in range(80)]
    rows += [(2000 + i, text(rng, 70, 40), "fr") for i in range(20)] + [(3000, None, "en"), (3001, "", None)] + [(4000 + i, t, "en") for i, t, _ in rows[:5]]
    labels = [(i, 1, 0) for i in range(420)] + [(1000 + i, 0, 0) for i in range(80)] + [(2000 + i, 1, 0) for i in range(20)] + [(4001, 0, 0), (7, None, 0)]
    table(spark, str(tmp_path), rows, labels)
    got = sorted(map(str, (tuple(r) for r in queries.op10_quality_rules(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.SQL["op10_quality_rules"]).fetchall()
    assert got == sorted(map(str, want))
    lost = [r for r in want if not r[-2] and not r[-1]]
    assert len(lost) > 40 and all(1000 <= r[0] < 1080 for r in lost)


def test_one_document_delivered_often_certifies_nothing(spark, tmp_path):
    rng = random.Random(8)
    t = text(rng, 70)
    rows = [(1, t, "en")] * 400 + [(10 + i, t, "en") for i in range(400)] + [(5, text(rng, 70, 200), "en")]
    table(spark, str(tmp_path), rows, [(1, 1, 0)] + [(10 + i, 1, 0) for i in range(400)])
    out = quality_rules.quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert all(r.kept and r.cut_symbols is None for r in out.collect())
