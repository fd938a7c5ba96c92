"""Words and n-grams as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column, min_length: int = 1) -> Column:
    """Runs of other than Unicode white space, of at least min_length characters."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    return F.filter(parts, lambda w: F.length(w) >= max(1, min_length))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters; a shorter text is its own."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, also where use names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def word_ngrams(text: Column, n: int) -> Column:
    """N-grams of words joined by spaces; a shorter text is its own."""
    def grams(w: Column) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) > 0, all_of).otherwise(F.array().cast("array<string>"))

    return once(words(text), grams)
