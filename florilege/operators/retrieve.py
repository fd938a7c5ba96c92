"""Postings tables and candidate retrieval by equi-joins on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profiles import bare, index_key
from ..functions.tokens import char_ngrams, words
from ..sources.tables import store

#: A side of up to so many rows and bytes may be broadcast; beyond, the plan is a shuffled join.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `most` rows, whose values take at most `most_bytes` as text."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(8)) for c in df.columns), F.lit(0))
    n, total = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= most and total <= most_bytes


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, most) else df


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(token, id), each pair once. Deduplicated inside the row, so there is no shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col(id_col))


def two_form_postings(docs: DataFrame, id_col: str, text: Column, normal=index_key) -> DataFrame:
    """T4: (token, id, form): each text's different words as they stand (raw), and those of its normalised text that aren't among them (normal)."""
    raw = F.array_distinct(words(text))
    both = docs.select(F.col(id_col), raw.alias("_raw"), F.array_except(words(normal(text)), raw).alias("_normal"))
    of = lambda c, form: F.transform(c, lambda w: F.struct(w.alias("token"), F.lit(form).alias("form")))
    return both.select(id_col, F.inline(F.concat(of("_raw", "raw"), of("_normal", "normal")))).select("token", id_col, "form")


def _forms(word: Column, normal) -> Column:
    """A query's word as it stands and, if it differs and anything is left, normalised."""
    other = normal(word)
    return F.array_compact(F.array(word, F.when((other != "") & (other != word), other)))


def two_form_candidates(queries: DataFrame, query_id: str, query_tokens: Column, post: DataFrame, id_col: str, share: float = 0.6, least: int = 1, normal=index_key) -> DataFrame:
    """(query, id, n_tokens, hits) over two_form_postings: each word of a query, repeats too, counts once for its own form and once for its normalised one, where a text has them;
    the hits reach max(least, int(share * words))."""
    q = queries.select(F.col(query_id), F.size(query_tokens).alias("n_tokens"), F.explode(F.flatten(F.transform(query_tokens, lambda w: _forms(w, normal)))).alias("token"))
    q = q.groupBy(query_id, "n_tokens", "token").agg(F.count("*").alias("times"))
    hits = post.join(q, "token").groupBy(query_id, "n_tokens", id_col).agg(F.sum("times").alias("hits"))
    return hits.filter(F.col("hits") >= F.greatest(F.lit(least), F.floor(share * F.col("n_tokens") + 1e-9)))


def two_form_query(words_: DataFrame, word: str, post: DataFrame, id_col: str, k: int = 10, normal=index_key) -> DataFrame:
    """(word, id, rank): the first k texts by id that have a word in either form."""
    asked = words_.select(word, F.explode(_forms(F.col(word), normal)).alias("token"))
    return top_k(post.join(asked, "token").select(word, id_col).distinct(), word, k, F.col(id_col))


def index_statistics(post: DataFrame, id_col: str) -> DataFrame:
    """Unique tokens, postings, mean postings of a token."""
    per = post.groupBy("token").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("unique_tokens"), F.sum("n").alias("postings"), F.avg("n").alias("mean_postings"), F.max("n").alias("most_postings"))


def token_candidates(queries: DataFrame, query_id: str, query_tokens: Column, post: DataFrame, id_col: str, share: float = 0.6, least: int = 1, few: bool | None = None) -> DataFrame:
    """(query, id, hits, n_tokens) where the hits of the query's tokens, repeats counted, reach max(least, int(share * n)). few: whether the queries may be broadcast; without it they are counted."""
    q = queries.select(F.col(query_id), F.size(query_tokens).alias("n_tokens"), F.explode(query_tokens).alias("token"))
    q = q.groupBy(query_id, "n_tokens", "token").agg(F.count("*").alias("times"))
    hits = post.join(maybe_broadcast(q) if few is None else F.broadcast(q) if few else q, "token").groupBy(query_id, "n_tokens", id_col).agg(F.sum("times").alias("hits"))
    return hits.filter(F.col("hits") >= F.greatest(F.lit(least), F.floor(share * F.col("n_tokens") + 1e-9)))


def top_k(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """O3: the first k rows of each key; the order must be total for the result to be one."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def contained(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "item_id", text_col: str = "text", passage_col: str = "passage") -> DataFrame:
    """Every (document, passage), with the columns of both, where the document's text contains the passage's: holding() gives the ids, and only
    texts of hits are fetched. Passages of one or two characters, which have no gram, are tried on every text."""
    pairs = holding(passages, passage_id, passage_col, docs, doc_id, text_col).distinct()
    long = docs.join(pairs, doc_id).join(passages, passage_id).filter(F.contains(text_col, passage_col))
    short = passages.filter(F.length(passage_col).isin(1, 2))
    return long if short.isEmpty() else long.unionByName(docs.join(maybe_broadcast(short), F.contains(docs[text_col], short[passage_col])))


def holding(needles: DataFrame, needle_id: str, needle: str, texts: DataFrame, text_id: str, text: str, least: int = 3) -> DataFrame:
    """(needle id, text id) where the text contains the needle, byte for byte; needles of under `least` characters have none.

    Each needle meets the texts on its rarest gram alone: of its inner words, which the text must have as whole words, the one in the fewest texts, or, of a needle without inner
    words, the rarest of its trigrams. A gram that no text has settles a needle without a comparison; only texts of the needles that are
    left are compared. Equal needles are looked up once.
    """
    q = needles.select(needle_id, F.col(needle).alias("_n")).filter(F.length("_n") >= max(3, least))
    kinds = q.select("_n").distinct()
    w = F.split("_n", r"(?U)\s+")
    inner = F.array_distinct(F.filter(F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 2)), lambda x: x != ""))
    marked = lambda c, kind: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    t = texts.select(text_id, F.col(text).alias("_t"))
    # Trigrams of the texts are made only if some needle needs them.
    no_word = not q.filter(F.size(inner) == 0).isEmpty()
    made = marked(F.array_distinct(words(F.col("_t"))), "w")
    held = t.select(text_id, F.explode(F.concat(made, marked(char_ngrams(F.col("_t")), "c")) if no_word else made).alias("gram"))
    grams = F.when(F.size(inner) > 0, marked(inner, "w")).otherwise(marked(char_ngrams(F.col("_n")), "c"))
    often = held.groupBy("gram").agg(F.count("*").alias("_df"))
    asked = kinds.select("_n", F.explode(grams).alias("gram")).join(often, "gram", "left").groupBy("_n")
    rarest = asked.agg(F.min_by("gram", F.struct("_df", "gram")).alias("gram"), F.count_if(F.col("_df").isNull()).alias("_none")).filter("_none = 0")
    pairs = rarest.select("_n", "gram").join(held, "gram").select("_n", text_id).join(t, text_id).filter(F.contains("_t", "_n")).select("_n", text_id)
    return q.join(pairs, "_n").select(needle_id, text_id)


def adjacent_passages(passages: DataFrame, group: str, position: str, text_col: str, most: int = 10, marker: bool = True) -> DataFrame:
    """Every run of 1 to `most` neighbours by sorted position within a group: (group, first, n, last, joined, plain).

    joined: the texts, each followed by its position in parentheses if there are several; plain: the texts without marks (N11) or positions.
    A window over the group looks ahead, so the table is shuffled once and never joined with itself.
    """
    w = Window.partitionBy(group).orderBy(position).rowsBetween(0, most - 1)
    runs = passages.withColumn("_ahead", F.collect_list(F.struct(F.col(position).alias("p"), F.col(text_col).alias("t"), bare(F.col(text_col)).alias("s"))).over(w))
    runs = runs.select(F.col(group), F.col(position).alias("first"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_ahead")), lambda k: F.slice("_ahead", 1, k))).alias("_i", "_run"))
    marked = F.transform("_run", lambda x: F.concat(x["t"], F.lit(" ("), x["p"].cast("string"), F.lit(")")))
    joined = F.when((F.size("_run") > 1) & F.lit(marker), F.array_join(marked, " ")).otherwise(F.array_join(F.transform("_run", lambda x: x["t"]), " "))
    return runs.select(group, "first", F.size("_run").alias("n"), F.element_at("_run", -1)["p"].alias("last"), joined.alias("joined"), F.array_join(F.transform("_run", lambda x: x["s"]), " ").alias("plain"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with their place from 1 in an order, each place once; ties in any order.

    The rows are dealt by ranges, sorted within and stored with their place in the range: bounds are sampled anew whenever a plan runs, so only
    stored ranges can be counted and numbered alike. Every place is then moved by the sizes of the ranges before (a row for each range, on the driver).
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = store(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_at", 33), "_i": F.col("_at") % (1 << 33)}).drop("_at"), "numbered")
    total, before = 0, []
    for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        before.append((r["_p"], total))
        total += r["n"]
    moved = F.broadcast(spark.createDataFrame(before, "_p long, _before long"))
    return ranged.join(moved, "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")


def dedupe_first(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_r = 1").drop("_r", "_key")
