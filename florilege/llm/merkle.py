"""A Merkle manifest of a dataset: a tree over each source's rows, and one over the sources' roots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_bytes, stash

#: Children of an inner node.
ARITY = 16
#: Rows that a task sorts and numbers.
PART_ROWS = 1 << 16
#: Hex digits of a digest.
_HEX = 64
#: The tree over the sources' roots, and what stands for its root.
_TOP, _ROOT = -1, -2
_NODE = "tree long, level int, idx long, n long, digest string, part long, children string"


def digest(columns: list[Column]) -> Column:
    """The leaf of a row: SHA-256, in hex, of its values one after the other, each its length in UTF-8 bytes, a colon and the value; a null is `-`."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)), 256)


def _join(children: str) -> str:
    return sha256(children.encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes at a level over n leaves."""
    return -(-n // ARITY**level)


class Forest:
    """Fragments of the trees: nodes that wait for siblings, by tree, level and run. Their union is associative and commutative, with the empty forest as its one.

    How many siblings a run has is known from its tree's leaves, so a run closes in whichever fragment its last sibling comes to; its
    digest is then a node one level higher, or, at the top of a source's tree, a leaf of the tree over the sources.
    """

    def __init__(self, sources: int):
        self.sources, self.waiting, self.closed = sources, {}, []

    def add(self, tree: int, level: int, idx: int, n: int, digest: str, part: int) -> None:
        while True:
            if width(n, level) == 1:  # the tree's root
                if tree == _TOP:
                    self.closed.append((_ROOT, 0, 0, n, digest, part, digest))
                    return
                tree, level, idx, n = _TOP, 0, tree, self.sources
                continue
            run = idx // ARITY
            held = self.waiting.setdefault((tree, level, run, n), [])
            held.append((idx, digest, part))
            if len(held) < min(ARITY, width(n, level) - ARITY * run):
                return
            del self.waiting[tree, level, run, n]
            held.sort()
            children, part = "".join(d for _, d, _ in held), min(p for _, _, p in held)
            digest = _join(children)
            self.closed.append((tree, level, run, n, digest, part, children))
            level, idx = level + 1, run

    def rows(self, flush: bool) -> list[tuple]:
        """The runs closed since the last call; with flush the waiting nodes too, without children."""
        out, self.closed = self.closed, []
        if flush:
            out += [(tree, level, idx, n, digest, part, None) for (tree, level, _, n), held in self.waiting.items() for idx, digest, part in held]
        return out


@dataclass
class Manifest:
    """leaves: (part, nth, j, m, id, source, leaf, claimed) in the order of the trees; places: of each part what to add for a leaf's place; runs: the closed runs of siblings; root: hex digest, null without rows."""

    leaves: DataFrame
    places: DataFrame
    runs: DataFrame
    sources: int
    most: int
    root: str | None

    def placed(self) -> DataFrame:
        """leaves with tree (the source's rank) and idx (the place among its leaves)."""
        rows = self.leaves.join(F.broadcast(self.places), "part")  # a row for each PART_ROWS leaves
        return rows.withColumn("tree", F.col("first_tree") + F.col("nth")).withColumn("idx", F.col("j") + F.when(F.col("nth") == 0, F.col("before")).otherwise(0))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted part's rows with the part, the source's place in it, the row's place in the source's stretch and the stretch's length."""
    held = list(batches)
    part = TaskContext.get().partitionId()
    if not sum(len(b) for b in held):
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    code = pc.dictionary_encode(rows["source"].combine_chunks(), null_encoding="encode")
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.append(first, len(code)))
    nth = np.repeat(np.arange(len(first)), size)
    made = {"part": np.full(len(code), part, np.int64), "nth": nth.astype(np.int64), "j": np.arange(len(code)) - first[nth], "m": size[nth]}
    out = pa.table({k: pa.array(v, pa.int64()) for k, v in made.items()} | {c: rows[c] for c in rows.column_names})
    yield from out.to_batches(max_chunksize=10_000)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: dict[str, Column] | None = None, part_rows: int = PART_ROWS) -> Manifest:
    """The trees over docs: those of the sources, whose leaves are the digests of `columns` by id, and the one over their roots, by source.

    claimed: other values of some columns, for the digests that proofs() folds in place of the leaves; a row for which all are null
    keeps its leaf. Texts are read once and only digests move. Rows are dealt by ranges of (source, id, leaf) and numbered
    within; a source of any size spans as many parts as it needs, and repeated rows are told apart by their place in the input. Each
    part builds its fragment, and fragments merge 16 at a time in rounds: a fragment of neighbouring leaves leaves at most 15 nodes waiting at
    either end of each level. What the driver sees is a row for each part.

    Nulls have their own digest; a null source comes first and is not the empty one; null ids come first in a source; equal ids are in the order of
    their leaves. An empty table has no root. Other columns don't matter.
    """
    claimed = claimed or {}
    col = lambda c: F.col(f"`{c}`")
    other = digest([F.coalesce(claimed[c], col(c)) if c in claimed else col(c) for c in columns])
    altered = F.coalesce(*(F.when(v.isNotNull(), True) for v in claimed.values()), F.lit(False)) if claimed else F.lit(False)
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), digest([col(c) for c in columns]).alias("leaf"), F.when(altered, other).alias("claimed"), F.monotonically_increasing_id().alias("_at"))
    rows = stash(rows, "merkle-rows")
    parts = -(-rows.count() // part_rows)
    keys = ["source", "id", "leaf", "_at"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "nth", "j", "m")] + [rows.schema[c] for c in ("id", "source", "leaf", "claimed")])
    leaves = rows.repartitionByRange(max(1, parts), *keys).sortWithinPartitions(*keys).drop("_at").mapInArrow(_number, schema)
    leaves = stash(leaves, "merkle-leaves")

    heads = leaves.filter("j = 0").select("part", "nth", F.struct("source", "m").alias("h")).groupBy("part")
    heads = heads.agg(F.max("nth").alias("last"), F.min_by("h", "nth").alias("a"), F.max_by("h", "nth").alias("b"), F.max("h.m").alias("most")).orderBy("part").collect()
    places, totals, tree, before, most = [], {}, -1, 0, 0
    for k, h in enumerate(heads):
        goes_on = k > 0 and heads[k - 1].b.source == h.a.source
        tree, before = (tree, before) if goes_on else (tree + 1, 0)
        places.append((h.part, tree, before, h.last))
        totals[tree] = totals.get(tree, 0) + h.a.m
        if h["last"]:
            tree += h["last"]
            totals[tree] = h.b.m
            before = h.b.m
        else:
            before += h.a.m
        most = max(most, h.most)
    sources, most = tree + 1, max([most, *totals.values()])
    held = spark.sparkContext.broadcast(({p: (first, before, last, totals[first], totals[first + last]) for p, first, before, last in places}, sources))

    def fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sources = held.value
        forest = Forest(sources)
        for batch in batches:
            for part, nth, j, m, leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "nth", "j", "m", "leaf")), strict=True):
                first, before, last, n_first, n_last = at[part]
                forest.add(first + nth, 0, j + before if nth == 0 else j, n_first if nth == 0 else n_last if nth == last else m, leaf, part)
            yield _batch(forest.rows(False))
        yield _batch(forest.rows(True))

    forest = stash(leaves.select("part", "nth", "j", "m", "leaf").mapInArrow(fragment, _NODE), "merkle-forest")
    runs, waiting, reach, round_ = forest.filter("children IS NOT NULL"), forest.filter("children IS NULL"), 1, 0
    while heads and (not round_ or reach <= heads[-1].part):
        reach, round_ = reach * ARITY, round_ + 1

        def merge(nodes: pd.DataFrame) -> pd.DataFrame:
            forest = Forest(held.value[1])
            for row in nodes[["tree", "level", "idx", "n", "digest", "part"]].itertuples(index=False):
                forest.add(*row)
            return pd.DataFrame(forest.rows(True), columns=["tree", "level", "idx", "n", "digest", "part", "children"])

        forest = stash(waiting.groupBy(F.floor(F.col("part") / reach).alias("_g")).applyInPandas(merge, _NODE), f"merkle-round-{round_}")
        runs, waiting = runs.unionByName(forest.filter("children IS NOT NULL")), forest.filter("children IS NULL")
    root = runs.filter(F.col("tree") == _ROOT).first()
    runs = runs.filter(F.col("tree") != _ROOT)
    return Manifest(leaves, spark.createDataFrame([(p, first, before) for p, first, before, _ in places], "part long, first_tree long, before long"), runs, sources, most, root.digest if root else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tree", "level", "idx", "n", "digest", "part", "children"])


def _levels(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def proofs(m: Manifest, id_col: str = "doc_id") -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, proof_sha256 (of the siblings' digests, level by level up to the root, left to right), folded_root (from the claimed digest, else the leaf, and the siblings), verified (it equals the root).

    Runs are found from the root down, a join of a node with its own run for each level; the path above a run of leaves is held once, not with each of them.
    """
    out_schema = T.StructType([T.StructField("id", m.leaves.schema["id"].dataType), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])
    if m.root is None:
        found = m.leaves.sparkSession.createDataFrame([], out_schema)
        return found.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(None).cast("string").alias("root"), "proof_sha256", "folded_root", F.lit(None).cast("boolean").alias("verified"))
    # A run's digest is the node that the run above, or what stands for the root, names.
    done = F.col("n") <= F.pow(F.lit(ARITY), F.col("level") + 1)
    top = done & (F.col("tree") == _TOP) | done & F.lit(m.sources == 1)
    runs = m.runs.select(
        F.col("tree").alias("r_tree"), F.col("level").alias("r_level"), F.col("idx").alias("r_idx"), "children",
        F.when(top, _ROOT).when(done, _TOP).otherwise(F.col("tree")).alias("tree"), F.when(done, 0).otherwise(F.col("level") + 1).alias("level"), F.when(top, F.lit(0)).when(done, F.col("tree")).otherwise(F.col("idx")).cast("long").alias("idx"),
    )
    start = [(_ROOT, 0, 0, m.root, m.root if m.sources == 1 else None, [], [])]
    nodes = m.leaves.sparkSession.createDataFrame(start, "tree long, level int, idx long, digest string, subroot string, path array<string>, spots array<int>")
    ends = []
    for step in range(_levels(m.sources) + _levels(m.most) + 1):
        both = nodes.join(runs, ["tree", "level", "idx"], "left")
        # A tree of one leaf has no run: its node is the leaf.
        lone = F.col("children").isNull()
        last = lone | (F.col("r_tree") >= 0) & (F.col("r_level") == 0)
        tree = F.when(lone, F.when(F.col("tree") == _ROOT, 0).otherwise(F.col("idx"))).otherwise(F.col("r_tree"))
        both = stash(both, f"merkle-down-{step}", held_bytes(m.leaves))
        ends.append(both.filter(last).select(tree.alias("tree"), F.when(lone, 0).otherwise(F.col("r_idx")).cast("long").alias("run"), F.when(~lone, F.col("children")).alias("children"), "subroot", "path", "spots"))
        inner = both.filter(~last).withColumn("_at", F.explode(F.sequence(F.lit(0), (F.length("children") / _HEX).cast("int") - 1)))
        node = F.substr("children", F.col("_at") * _HEX + 1, F.lit(_HEX))
        nodes = inner.select(
            F.col("r_tree").alias("tree"), F.col("r_level").alias("level"), (F.col("r_idx") * ARITY + F.col("_at")).alias("idx"), node.alias("digest"),
            F.when((F.col("r_tree") == _TOP) & (F.col("r_level") == 0), node).otherwise(F.col("subroot")).alias("subroot"), F.concat(F.array("children"), "path").alias("path"), F.concat(F.array("_at"), "spots").alias("spots"),
        )
    above = ends[0]
    for e in ends[1:]:
        above = above.unionByName(e)
    run = F.floor(F.col("idx") / ARITY).alias("run")
    mine = m.placed().groupBy("tree", run).agg(F.array_sort(F.collect_list(F.struct("idx", "id", "leaf", "claimed"))).alias("_l"))  # at most 16 leaves
    rows = mine.join(above, ["tree", "run"]).select("children", "subroot", "path", "spots", F.col("_l.id").alias("ids"), F.col("_l.leaf").alias("leaves"), F.col("_l.claimed").alias("claims"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for children, path, spots, leaves, claims in zip(*(batch.column(c).to_pylist() for c in ("children", "path", "spots", "leaves", "claims")), strict=True):
                cut = [(c[: s * _HEX], c[(s + 1) * _HEX :]) for c, s in zip(path, spots, strict=True)]
                upper = "".join(a + b for a, b in cut)
                for i, (leaf, claim) in enumerate(zip(leaves, claims, strict=True)):
                    own = [] if children is None else [(children[: i * _HEX], children[(i + 1) * _HEX :])]
                    node = claim or leaf
                    for a, b in own + cut:
                        node = _join(a + node + b)
                    out.append((_join("".join(a + b for a, b in own) + upper), node))
            ids = batch.column("ids").flatten()
            subroot = pc.take(batch.column("subroot"), pc.list_parent_indices(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([ids, batch.column("leaves").flatten(), subroot, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])

    found = rows.mapInArrow(fold, out_schema)
    root = F.lit(m.root)
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
