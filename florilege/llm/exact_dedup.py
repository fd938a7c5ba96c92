"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_bytes, slight, stash, whole

#: Bits of the table that says which (length, prefix hash) may repeat: 16 MB when broadcast, at most.
MOST_BITS = 1 << 27
_PAGE = 1 << 15


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, carry: dict[str, Column] | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, and the `carry` expressions over the input's columns.

    Rows are equal when their texts are identical; the largest id of a group stays. Level 1 groups by byte length, level 2
    the rows of repeated lengths by a hash of the first `prefix_chars` characters, level 3 hashes the whole text (SHA-256)
    of the rows only whose (length, prefix hash) repeats. Levels 1 and 2 move 24 bytes a row. What reaches level 3 is known in the
    scan by a table of bits, broadcast in pages, with about eight bits for each row of the input and `most_bits` at most: a bit
    set by chance costs one more hash and changes no result. No text is ever shuffled, and groups are pre-aggregated, so a
    hot group of copies costs one row a task; the join that puts a group's result on its rows is splittable by AQE.

    Null text counts as empty; a null id never wins over another one, and a group of null ids has keep_id null and is kept.
    Repeated rows (same id, same text) count in group_size and share their verdict. An empty table gives an empty result.
    Columns of docs not named here don't matter, whatever their names.
    """
    carry = carry or {}
    text = whole(text_col)
    length, head = F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_head")
    keys = stash(docs.select(length, head), "dedup-keys")
    size = held_bytes(keys)
    lengths = stash(keys.groupBy("_len").count().filter("count > 1").select("_len"), "dedup-lengths", size)
    heads = keys.join(slight(lengths), "_len", "left_semi").groupBy("_len", "_head").count().filter("count > 1")
    bits = min(most_bits, max(_PAGE, 1 << size.bit_length()))
    place = F.pmod(F.xxhash64("_len", "_head"), F.lit(bits))
    pages = heads.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("_page")).agg(F.expr(f"bitmap_construct_agg(at & {_PAGE - 1})").alias("_bits"))
    pages = stash(pages, "dedup-pages", size)

    full = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    base = docs.select(F.col(id_col).alias("_id"), length, head, text.alias("_text"), *(v.alias(f"_c_{k}") for k, v in carry.items()))
    base = base.withColumn("_at", place).withColumn("_page", F.shiftright("_at", 15))
    kept = ["_id", "_len", *(f"_c_{k}" for k in carry)]
    hit = F.expr(f"_bits IS NOT NULL AND shiftright(cast(conv(hex(substring(_bits, cast(shiftright(_at & {_PAGE - 1}, 3) AS int) + 1, 1)), 16, 10) AS int), cast(_at & 7 AS int)) & 1 = 1")
    rows = stash(base.join(F.broadcast(pages), "_page", "left").select(*kept, F.when(hit, full).alias("_sha")), "dedup-rows")

    groups = rows.filter("_sha IS NOT NULL").groupBy("_len", "_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    many = rows.filter("_sha IS NOT NULL").join(groups, ["_len", "_sha"])
    alone = rows.filter("_sha IS NULL").select(*kept, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    return many.select(alone.columns).unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), *(F.col(f"_c_{k}").alias(k) for k in carry)
    )
