"""Quality rules whose cutoffs are certified on labelled holdouts; DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_bytes, slight, stash, whole

#: Signal of each rule over the base counts; a document is rejected above the cutoff.
RULES = {
    "symbols": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0D END",
    "dup_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0D END",
    "repeats": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0D END",
}
#: Candidate cutoffs, loosest first, tested in this order.
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)


@dataclass(frozen=True)
class Risk:
    """At most `alpha` of a stratum's good documents may be rejected by all rules together, with confidence 1 - delta over all strata."""

    alpha: float = 0.05
    delta: float = 0.05
    min_words: int = 50
    max_repeat_pct: int = 50


def signals(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in `keep` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each text.

    Repeated windows are found by sorting one long for each word: the window's hash above, its position below. The windows
    that then look alike are compared word by word; a text where a hash has lied is counted again from the windows themselves.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    t = docs.select(*(F.col(f"`{c}`") for c in keep), whole(text_col).alias("_t"))
    t = t.withColumn("_w", F.expr(r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '')")).withColumn("_lines", F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    t = t.withColumns({"_bits": F.expr("length(bin(size(_w)))"), "_nl": F.size("_lines"), "_dl": F.size("_lines") - F.size(F.array_distinct("_lines"))})
    t = t.withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1")).drop("_lines")
    t = t.withColumn("_g", F.expr("CASE WHEN size(_w) < 4 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, size(_w) - 3), i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & ~_mask) | cast(i AS bigint))) END"))
    t = t.withColumn("_same", F.expr("filter(_g, (x, j) -> (x & ~_mask) <=> (get(_g, j - 1) & ~_mask) OR (x & ~_mask) <=> (get(_g, j + 1) & ~_mask))")).drop("_g")
    word = lambda at, d: f"_w[cast(get(_same, {at}) & _mask AS int) + {d}]"
    differ = " OR ".join(f"{word('j', d)} != {word('j - 1', d)}" for d in range(3))
    t = t.withColumn("_lied", F.expr(f"CASE WHEN size(_same) < 2 THEN false ELSE exists(sequence(1, size(_same) - 1), j -> (_same[j] & ~_mask) = (_same[j - 1] & ~_mask) AND ({differ})) END"))
    cover = lambda positions: f"aggregate({positions}, named_struct('last', -3L, 'n', 0L), (s, p) -> named_struct('last', p, 'n', s.n + least(3L, p - s.last)), s -> s.n)"
    windows = "sort_array(transform(sequence(0, size(_w) - 3), i -> struct(_w[i], _w[i + 1], _w[i + 2], cast(i AS bigint) AS at)))"
    alike = lambda a, b: " AND ".join(f"{a}.col{d} <=> {b}.col{d}" for d in (1, 2, 3))
    exact = f"transform(array({windows}), g -> sort_array(transform(filter(g, (x, j) -> ({alike('x', 'get(g, j - 1)')}) OR ({alike('x', 'get(g, j + 1)')})), x -> x.at)))[0]"
    t = t.withColumn("_at", F.expr(f"CASE WHEN _lied THEN {exact} ELSE sort_array(transform(_same, x -> x & _mask)) END"))
    gone = lambda chars: f"length(translate(_t, '{chars}', ''))"
    return t.select(
        *(F.col(f"`{c}`") for c in keep),
        F.expr("cast(size(_w) AS bigint)").alias("n_words"),
        F.expr(f"cast({gone(' \\t\\n\\u000b\\u000c\\r')} AS bigint)").alias("word_chars"),
        F.expr(f"cast(length(_t) - {gone('#*$%&|<>')} AS bigint)").alias("n_symbols"),
        F.col("_nl").cast("long").alias("n_lines"),
        F.col("_dl").cast("long").alias("n_dup_lines"),
        F.expr(cover("_at")).alias("n_repeat_words"),
    )


def base_failed(risk: Risk) -> Column:
    return F.expr(f"n_words < {risk.min_words} OR 100 * n_repeat_words > {risk.max_repeat_pct} * n_words")


def certify(good: DataFrame, stratum: str, risk: Risk = Risk(), from_bytes: int | None = None) -> DataFrame:
    """(stratum, a cutoff column for each rule): the strictest cutoffs that the holdout certifies, null where none is.

    `good` holds the signals of documents labelled good. A cutoff that falsely rejects k of n is certified when a binomial
    of n trials at alpha / rules puts no more than delta / (strata x rules) on k or fewer, which is where the exact
    (Clopper-Pearson) upper bound of its rate falls to alpha / rules. Cutoffs of one rule and stratum are tested from the
    loosest on and testing stops at the first failure, so that they need no further correction; strata and rules are
    corrected by Bonferroni. The sum over rules bounds a document's false rejection by any of them.
    """
    p = risk.alpha / len(RULES)
    aggs = [F.count_if(F.expr(f"({sql}) > {c}D")).alias(f"{r}__{i}") for r, sql in RULES.items() for i, c in enumerate(CUTOFFS)]
    counts = good.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *aggs)
    counts = stash(counts, "rules-counts", from_bytes)
    tests = max(1, counts.count() * len(RULES))
    odds = f"ln({p!r}D) - ln(1D - {p!r}D)"
    # Log terms and their log sum from 0 to k; only where k is under the mean, as the tail is no longer small beyond it.
    tail = f"""CASE WHEN x.k >= n * {p!r}D THEN 0D ELSE aggregate(sequence(0L, x.k),
        named_struct('t', 0D, 's', 0D),
        (a, i) -> CASE WHEN i = 0 THEN named_struct('t', n * ln(1D - {p!r}D), 's', n * ln(1D - {p!r}D))
            ELSE named_struct('t', a.t + ln((n - i + 1) / cast(i AS double)) + {odds},
                's', greatest(a.s, a.t + ln((n - i + 1) / cast(i AS double)) + {odds}) + ln(1D + exp(-abs(a.s - (a.t + ln((n - i + 1) / cast(i AS double)) + {odds}))))) END,
        a -> a.s) END"""
    cuts = []
    for r in RULES:
        tried = ", ".join(f"named_struct('cutoff', {c}D, 'k', `{r}__{i}`)" for i, c in enumerate(CUTOFFS))
        cuts.append(f"""aggregate(array({tried}), named_struct('open', true, 'cut', cast(NULL AS double)),
            (s, x) -> CASE WHEN s.open AND {tail} <= ln({risk.delta!r}D / {tests}) THEN named_struct('open', true, 'cut', x.cutoff) ELSE named_struct('open', false, 'cut', s.cut) END,
            s -> s.cut) AS cut_{r}""")
    return counts.selectExpr("stratum", *cuts)


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: Risk = Risk(), max_strata: int = 10_000
) -> DataFrame:
    """One row per row of docs: id, text_hash (xxhash64), stratum, the base counts, base_failed, the cutoffs in force (cut_*), kept.

    kept is false if base_failed, or if a certified rule's signal exceeds its stratum's cutoff. A stratum with too few good
    labels for any cutoff has no rule beyond the base. Texts are read once; everything after works on their counts. The
    table of cutoffs, one row for each stratum, is broadcast up to `max_strata` rows, else joined by a shuffle.

    Null text counts as empty (so base_failed); a null stratum counts as that of the empty name; labels that are null, of unknown
    documents, or for a null id are ignored; a document labelled twice counts once, and as good only if no label says
    otherwise. So does a text of a stratum: repeated rows and copies are one trial of the holdout, whatever their ids, as the
    bound is one for independent trials. Repeated rows get equal verdicts. Empty tables give an empty result or no rules. Other columns don't matter.
    """
    rows = stash(signals(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_stratum"), F.xxhash64(whole(text_col)).alias("_hash"), F.col(text_col).alias("_text")), "_text"), "rules-signals")
    size, rows = held_bytes(rows), rows.withColumn("base_failed", base_failed(risk))
    labelled = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).alias("_good"))
    labelled = stash(labelled, "rules-labelled", size)
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    good = rows.filter("NOT base_failed").join(slight(labelled), "_id").groupBy("_stratum", "_hash").agg(F.min("_good").alias("_good"), *(F.first(c).alias(c) for c in counts)).filter("_good = 1")
    cuts = stash(certify(good, "_stratum", risk, size).withColumnRenamed("stratum", "_stratum"), "rules-cuts")
    rows = rows.join(F.broadcast(cuts) if cuts.limit(max_strata + 1).count() <= max_strata else cuts, "_stratum", "left")
    passed = F.lit(True)
    for r, sql in RULES.items():
        passed = passed & ~F.coalesce(F.expr(f"({sql}) > cut_{r}"), F.lit(False))
    return rows.select(
        F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.col("_stratum").alias("stratum"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *(f"cut_{r}" for r in RULES), (~F.col("base_failed") & passed).alias("kept")
    )
