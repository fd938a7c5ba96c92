"""Detection and repair of quoted spans. Spans are half-open, in code points from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieve import contained


def verbatim_spans(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", passage_id: str = "item_id", text_col: str = "text", passage_col: str = "passage") -> DataFrame:
    """The first place of each passage in each document that contains it."""
    start = F.instr(F.col(text_col), F.col(passage_col)) - 1
    found = contained(docs, passages, doc_id, passage_id, text_col, passage_col)
    return found.select(doc_id, passage_id, start.cast("long").alias("span_start"), (start + F.length(passage_col)).cast("long").alias("span_end"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places(text: pd.Series, part: pd.Series) -> pd.Series:
    def one(t: str | None, p: str | None) -> list[int]:
        out, at = [], t.find(p) if t and p else -1
        while at >= 0:
            out.append(at)
            at = t.find(p, at + 1)
        return out

    return pd.Series([one(t, p) for t, p in zip(text, part, strict=True)])


def occurrences(text: Column, part: Column) -> Column:
    """Every start of part in text, overlapping ones too, each search going on after the last place. Texts without the part aren't searched in Python."""
    return _places(F.when(F.contains(text, part), text), part)


def repair(text: Column, part: Column, guess: Column) -> Column:
    """Guess if the slice is exact, else the nearest occurrence (the first of two as near), else null. Blank parts are null."""
    exact = F.substr(text, guess + 1, F.length(part)) == part
    near = F.array_min(F.transform(occurrences(text, part), lambda i: F.struct(F.abs(i - guess).alias("d"), i.alias("i"))))["i"]
    return F.when(F.length(F.trim(part)) > 0, F.when((guess >= 0) & exact, guess).otherwise(near))


def trim_to_words(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A4: bounds moved inward to letters and digits; marks at the end don't count."""
    part = F.substr(text, start + 1, end - start)
    lead = F.length(F.regexp_extract(part, r"^[^\p{L}\p{N}]*", 0))
    tail = F.length(F.regexp_extract(part, r"[^\p{L}\p{N}]*$", 0))
    return start + lead, F.greatest(start + lead, end - tail)


def number_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Spans numbered from 1 in order of place; a document without any gets the row (0, 0, No_Spans)."""
    order = F.row_number().over(Window.partitionBy(doc_id).orderBy("span_start", "span_end", "span_type"))
    out = docs.select(doc_id).join(spans.withColumn("annotation_id", order), doc_id, "left")
    return out.select(doc_id, F.coalesce("annotation_id", F.lit(0)).alias("annotation_id"), F.coalesce("span_start", F.lit(0)).cast("long").alias("span_start"), F.coalesce("span_end", F.lit(0)).cast("long").alias("span_end"), F.coalesce("span_type", F.lit("No_Spans")).alias("span_type"))


def json_block(answer: Column) -> Column:
    """A10: the JSON text in an answer: without code fences, else from the first brace to the last, if it parses; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    inner = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    # One value and nothing after it: amid brackets it is an array of one.
    parses = lambda c: F.coalesce(F.try_parse_json(c).isNotNull() & (F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1), F.lit(False))
    return F.when(plain.rlike(r"(?s)^[\[{].*[\]}]$") & parses(plain), plain).when(parses(inner), inner)


def tag_kind(tag: Column) -> Column:
    """A5: tags that start with the letter qaf are verses, others narrations, none is a verse."""
    return F.when(tag.isNull() | F.startswith(tag, F.lit("ق")), "Ayah").otherwise("Hadith")


def label_parts(label: Column) -> tuple[Column, Column]:
    """(kind, whether it is right) of labels such as CorrectAyah and WrongHadith."""
    return F.when(F.contains(label, F.lit("Ayah")), "Ayah").when(F.contains(label, F.lit("Hadith")), "Hadith"), F.startswith(label, F.lit("Correct"))


def without_key(schema, key: str):
    """A nested schema without one key."""
    if isinstance(schema, dict):
        return {k: without_key(v, key) for k, v in schema.items() if k != key}
    return [without_key(v, key) for v in schema] if isinstance(schema, list) else schema


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running(lengths: pd.Series) -> pd.Series:
    """Running sums, in one pass: an array grown by aggregate() is copied for each element."""
    return lengths.map(lambda x: None if x is None else np.cumsum(x))


def quoted(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", least_letters: int = 10) -> DataFrame:
    """The offline detector: stretches between quotation marks, of any length and each at its own place, edges trimmed to words, of at least `least_letters` letters, none nested.

    Repeated rows each have their spans.
    """
    marks = "\"[^\"]{3,}+\"|«[^»]{3,}+»|“[^”]{3,}+”"
    found = docs.select(doc_id, F.regexp_extract_all(F.col(text_col), F.lit(marks), F.lit(0)).alias("_m"), F.split(F.col(text_col), marks).alias("_gap"))
    # The text is gap, match, gap, ..., gap: each match ends where the lengths so far end.
    ends = _running(F.transform(F.arrays_zip("_gap", "_m"), lambda x: F.length(x["_gap"]) + F.coalesce(F.length(x["_m"]), F.lit(0))))
    found = found.filter(F.size("_m") > 0).withColumn("_at", F.zip_with(F.slice(ends, F.lit(1), F.size("_m")), "_m", lambda end, m: end - F.length(m)))
    found = found.select(doc_id, F.inline(F.slice(F.arrays_zip("_m", "_at"), F.lit(1), F.size("_m"))))
    lead, tail = trim_to_words(F.col("_m"), F.lit(0), F.length("_m"))
    out = found.select(doc_id, (F.col("_at") + lead).cast("long").alias("span_start"), (F.col("_at") + tail).cast("long").alias("span_end"), F.substr("_m", lead + 1, tail - lead).alias("span"))
    return out.filter(F.length(F.regexp_replace("span", r"[^\p{L}]", "")) >= least_letters)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("tag", T.StringType())])))
def bracketed(source: pd.Series, answer: pd.Series) -> pd.Series:
    """A1, A2, A3: spans of an answer that repeats its source with [ text | tag ] around quotations, nested ones too, mapped to the source.

    Answer words are aligned with source words at least cost: 0 for equal, 1 - Levenshtein ratio (M15) for a pair, 1 for a gap; of equal costs
    pairs before gaps. Words that begin and end both texts alike are pairs at once. Offsets are those of the source's own words, whatever the white space.
    A quotation with several tags, [ text | a | b ], is a span for each.
    """
    import re

    import numpy as np

    def unlike(x: str, y: str, known: dict) -> float:
        """1 - 2 * longest common subsequence / length of both: a substitution counts as a deletion and an insertion."""
        if (x, y) not in known:
            row = [0] * (len(y) + 1)
            for a in x:
                last = 0
                for j, b in enumerate(y, 1):
                    last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
            known[x, y] = 1 - 2 * row[-1] / (len(x) + len(y))
        return known[x, y]

    def align(x: list[str], y: list[str]) -> list[int | None]:
        head = tail = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        a, b = x[head : len(x) - tail], y[head : len(y) - tail]
        n, m = len(a), len(b)
        known: dict = {}
        cost, step = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), np.int8)
        cost[0], cost[:, 0], step[0], step[:, 0] = np.arange(m + 1), np.arange(n + 1), 2, 1
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                same = 0.0 if a[i - 1] == b[j - 1] else unlike(a[i - 1], b[j - 1], known)
                cost[i, j], step[i, j] = min((cost[i - 1, j - 1] + same, 0), (cost[i - 1, j] + 1, 1), (cost[i, j - 1] + 1, 2))
        to: list[int | None] = [*range(head), *[None] * n, *range(len(y) - tail, len(y))]
        i, j = n, m
        while i and j:
            if step[i, j] == 0:
                to[head + i - 1] = head + j - 1
            i, j = i - (step[i, j] != 2), j - (step[i, j] != 1)
        return to

    def one(s: str | None, a: str | None) -> list[dict]:
        words, open_at, spans = [], [], []
        for t in re.findall(r"\[|\]|\||[^\s\[\]|]+", a or ""):
            if t == "[":
                open_at.append([len(words), None, None])
            elif t == "|" and open_at:
                open_at[-1][1] = len(words) if open_at[-1][1] is None else open_at[-1][1]
                open_at[-1][2] = [*(open_at[-1][2] or []), ""]
            elif t == "]" and open_at:
                b, e, tags = open_at.pop()
                spans += [(b, len(words) if e is None else e, tag) for tag in tags or [None]]
            elif open_at and open_at[-1][2] is not None:
                open_at[-1][2][-1] = f"{open_at[-1][2][-1]} {t}".strip()
            else:
                words.append(t)
        places = [m.span() for m in re.finditer(r"\S+", s or "")]
        to = align(words, [(s or "")[b:e] for b, e in places])
        out = []
        for b, e, tag in sorted(spans, key=lambda x: (x[0], x[1])):
            at = [to[i] for i in range(b, e) if to[i] is not None]
            if at:
                out.append({"span_start": places[at[0]][0], "span_end": places[at[-1]][1], "tag": tag})
        return out

    return pd.Series([one(s, a) for s, a in zip(source, answer, strict=True)])
