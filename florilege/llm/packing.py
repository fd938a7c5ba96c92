"""Variable-capacity best-fit packing of token sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import product
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slight, stash, whole

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)


def words(text_col: str = "text") -> Column:
    """Length of a text in words; a text without one still takes a place."""
    return F.greatest(F.lit(1), F.expr(f"size(array_remove(split(coalesce(`{text_col}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))"))


def _filled(lengths: list[int], counts: list[int], kinds: list[int], sizes: tuple[int, ...]) -> list[tuple[int, int]]:
    """(words held, bins) after the best fit of counts[i] pieces of lengths[i], longest first; pieces of kind k open bins of sizes[k].

    Bins of equal room that one kind of pieces opened are alike, so they are counted, not listed: a bin with the least room r takes
    r // length pieces in a row, and the work grows with the different lengths, not with the pieces.
    """
    open_: list[tuple[int, int]] = []  # (room, kind that opened it, later kinds after earlier ones), sorted
    held: dict[tuple[int, int], int] = {}

    def put(room: int, age: int, bins: int) -> None:
        if (room, age) not in held:
            held[room, age] = 0
            if room:
                insort(open_, (room, age))
        held[room, age] += bins

    for need, left, kind in zip(lengths, counts, kinds, strict=True):
        while left:
            at = bisect_left(open_, (need, -len(sizes)))
            if at == len(open_):
                put(sizes[kind], -kind, -(-left // (sizes[kind] // need)) if need else 1)
                continue
            if not need:  # takes no room
                break
            room, age = open_.pop(at)
            bins = held.pop((room, age))
            each = room // need
            full = min(bins, left // each)
            if full:
                put(room - each * need, age, full)
            left -= full * each
            if left and bins > full:
                put(room - left * need, age, 1)
                full, left = full + 1, 0
            if bins > full:
                put(room, age, bins - full)
    return [(sizes[-age] - room, bins) for (room, age), bins in held.items()]


def plan_sizes(lengths: np.ndarray, capacities: tuple[int, ...], fixed: float, most: int = 1_000) -> np.ndarray:
    """For each capacity and as an index into capacities: which size a piece opens, chosen jointly for all pieces.

    Pieces are of the kind of the smallest capacity that holds them. A plan gives each kind a size; its cost is that of its whole packing: c + fixed
    for each bin that has shrunk to capacity c. All plans are packed, up to `most` of them (six sizes have 720); with more, one kind's size
    is changed at a time, the best change first, until none helps. Of equal plans the one with the smaller sizes stands.
    """
    caps = np.asarray(capacities)
    values, counts = np.unique(lengths, return_counts=True)
    values, counts = values[::-1], counts[::-1].tolist()
    kinds = np.searchsorted(caps, values)
    present = set(kinds.tolist())
    choices = [range(k, len(caps)) if k in present else (k,) for k in range(len(caps))]
    values, kinds = values.tolist(), kinds.tolist()

    def cost(plan: tuple[int, ...]) -> tuple[float, tuple[int, ...]]:
        filled = _filled(values, counts, kinds, tuple(capacities[i] for i in plan))
        return sum((capacities[bisect_left(capacities, used)] + fixed) * bins for used, bins in filled), plan

    if prod(map(len, choices)) <= most:
        return np.asarray(min(map(cost, product(*choices)))[1])
    best, now = None, cost(tuple(range(len(caps))))
    while best is None or now < best:
        best = now
        now = min(cost((*best[1][:k], i, *best[1][k + 1 :])) for k in range(len(caps)) for i in choices[k])
    return np.asarray(best[1])


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, fixed: float = 16.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity of the bin) of each piece; pieces are taken longest first, ties in the order given.

    A piece goes to the open bin with the least room that holds it (the oldest of equals); else it opens a bin of the
    size planned for its kind. At the end each bin shrinks to the smallest permitted capacity of its contents.
    """
    capacities = tuple(sorted(capacities))
    n = len(lengths)
    which, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size_of = plan_sizes(lengths, capacities, fixed) if n else None
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    used: list[int] = []
    opened: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(used), capacities[size_of[bisect_left(capacities, need)]]
            used.append(0)
            opened.append(left)
        which[i], offset[i] = b, used[b]
        used[b] += need
        if left > need:
            insort(room, (left - need, b))
    caps = np.asarray(capacities)
    return which, offset, caps[np.searchsorted(caps, np.asarray(used, int))][which] if n else which


def best_fit(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, fixed: float = 16.0, group_rows: int = 50_000) -> DataFrame:
    """One row per piece: id, piece (0-based), piece_start, n_tokens, group_id, bin_id, bin_offset, capacity.

    A sequence longer than the largest capacity is cut into pieces of that capacity and a rest. Only lengths travel.
    Sequences are dealt by a hash of the id into groups of about `group_rows`, each packed on its own in one task with sizes planned for it:
    bins never cross groups, and a group's size doesn't follow the input. Rows of an id, or of null, that has more than `group_rows` of them are
    dealt by their numbers instead. Otherwise the result within a group depends on the ids and lengths only. A group that still holds twice the rows planned is cut into runs.

    A null or negative length counts as 0 and takes part with no token; null ids are packed like others. Repeated rows
    are pieces of their own. An empty table gives an empty result. Other columns don't matter.
    """
    length = words() if length is None else length
    rows = stash(docs.select(F.col(id_col).alias("id"), F.greatest(F.lit(0), F.coalesce(length, F.lit(0))).cast("long").alias("n")), "pack-lengths")
    groups = max(1, -(-rows.count() // group_rows))
    caps, top = tuple(sorted(capacities)), max(capacities)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        outs = []
        for at in range(0, len(pdf), 2 * group_rows):
            run = pdf.iloc[at : at + 2 * group_rows]
            n = run["n"].to_numpy(np.int64)
            k = np.maximum(1, -(-n // top))
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            size = np.minimum(top, n[row] - piece * top)
            b, offset, capacity = pack(size, caps, fixed)
            outs.append(pd.DataFrame({"id": run["id"].to_numpy()[row], "piece": piece, "piece_start": piece * top, "n_tokens": size, "group_id": run["g"].to_numpy()[row], "run": at, "bin_id": b, "bin_offset": offset, "capacity": capacity}))
        return pd.concat(outs, ignore_index=True)

    kind = dict(rows.dtypes)["id"]
    often = stash(rows.groupBy("id").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > group_rows).select(F.col("id").alias("_often"), F.lit(True).alias("_hot")), "pack-often")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.join(slight(often), numbered["id"].eqNullSafe(often["_often"]), "left").select("id", "n", F.pmod(F.when(F.col("_hot"), F.xxhash64("id", "_row")).otherwise(F.xxhash64("id")), F.lit(groups)).alias("g"))
    out = dealt.groupBy("g").applyInPandas(one, f"id {kind}, piece long, piece_start long, n_tokens long, group_id long, run long, bin_id long, bin_offset long, capacity long")
    bin_name = F.concat_ws("-", F.col("group_id").cast("string"), F.col("run").cast("string"), F.col("bin_id").cast("string"))
    return out.select(F.col("id").alias(id_col), "piece", "piece_start", "n_tokens", "group_id", bin_name.alias("bin_id"), "bin_offset", "capacity")
