"""The Merkle manifest against a plain recursive one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from florilege.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part int"


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    """(left, right) siblings of node i level by level."""
    out = []
    for nodes in tree[:-1]:
        a = i // 16 * 16
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
        i //= 16
    return out


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        for i, r in enumerate(mine):
            way = path(trees[s], i) + path(top, k)
            bad = r[0] is not None and r[0] % 3 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].lower())) if bad else leaf(r)
            for a, b in way:
                node = H(a + node + b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join(a + b for a, b in way)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(spark, rows, part_rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    claimed = {"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text"))}
    m = merkle.manifest(docs, columns=COLUMNS, claimed=claimed, part_rows=part_rows)
    return sorted(map(tuple, merkle.proofs(m).collect()), key=repr)


def made(seed, n, sources):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(10 * n)]) if rng.random() < 0.05 else k, rng.choice(sources), rng.choice([None, "en", "é"]), rng.choice([None, 3]), rng.choice([None, "", "Aé B", "x:1", f"T{k}"])) for k in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("n,part", [(700, 40), (700, 1 << 16), (90, 7), (1, 5)])
def test_equals_the_recursive_trees(spark, n, part):
    rows = made(n, n, [None, "", "a", "b", "ä", "a", "a", "a", *[f"s{i}" for i in range(40)]])
    assert got(spark, rows, part) == brute(rows)


def test_one_source_and_one_leaf(spark):
    rows = made(5, 300, ["only"])
    assert got(spark, rows, 32) == brute(rows)
    assert got(spark, rows[:1], 32) == brute(rows[:1])
    assert got(spark, [(1, f"s{i}", None, None, None) for i in range(300)], 32) == brute([(1, f"s{i}", None, None, None) for i in range(300)])


def test_rows_all_alike_and_an_empty_table(spark):
    rows = [(1, "s", "en", 2, "Aa")] * 200
    assert got(spark, rows, 16) == brute(rows)
    assert got(spark, [], 16) == []
