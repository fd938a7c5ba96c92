"""Verification of quoted spans and splitting of spans with several parts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import profiles, similarity
from ..functions.profiles import ARABIC_BLOCKS
from ..functions.tokens import char_ngrams, words
from ..sources.tables import store
from .retrieve import contained, holding, maybe_broadcast

_MARKER = r"\([٠-٩0-9]+\)"
_FOREIGN = rf"(?U)[^{ARABIC_BLOCKS}\s]{{3,}}"
#: First characters of a span by which those are found that a passage may contain.
_HEAD = 16


def strategy_vote(matched: Column, total: Column, strategy: str) -> Column:
    """V6: any, all, majority or high (80 %); unknown names count as any; without parts, false."""
    share = matched / F.nullif(total, F.lit(0))
    rule = {"all": matched == total, "majority": share > 0.5, "high": share >= 0.8}.get(strategy, matched > 0)
    return F.coalesce((total > 0) & rule, F.lit(False))


def diacritics_rejected(given: Column, reference: Column, accuracy: float = 0.8) -> Column:
    """V4: whether the marks of the given text contradict the reference's. Texts without marks, or with other letters, are never rejected."""
    a, b = profiles.align_key(given), profiles.align_key(reference)
    judged = profiles.has_diacritics(a) & profiles.has_diacritics(b) & (profiles.no_diacritics(a) == profiles.no_diacritics(b))
    n = F.least(F.length(a), F.length(b))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.struct(F.substr(a, i, F.lit(1)).alias("x"), F.substr(b, i, F.lit(1)).alias("y")))
    marked = F.filter(pairs, lambda p: profiles.has_diacritics(p["x"]) | profiles.has_diacritics(p["y"]))
    right = F.size(F.filter(marked, lambda p: p["x"] == p["y"]))
    return F.coalesce(judged & (right < F.size(marked)) & (right / F.size(marked) < accuracy), F.lit(False))


def verify_verses(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str, threshold: float = 0.85) -> DataFrame:
    """(span, is_match, similarity, passage, match_type): exact on normalised texts first, then the best accepted candidate. Ties by id.

    A candidate shares a word of three characters with the span. It is accepted if it contains the span, with at least the threshold as its
    similarity if the span has over two words; or if its ratio (M1) reaches the threshold; unless its marks contradict the span's (V4). Passages that contain
    a span are found by its rarest gram, those near it by a threshold join (similarity.near_texts); spans of equal key are compared once.
    """
    marked = F.when(profiles.has_diacritics(F.col(span_col)), F.col(span_col))
    q = store(spans.select(span_id, marked.alias("_s"), profiles.verse_key(F.col(span_col)).alias("_q")), "spans")
    c = corpus.select(passage_id, F.col(passage_col).alias("_p"), profiles.verse_key(F.col(passage_col)).alias("_c"))
    first = c.groupBy("_c").agg(F.min(passage_id).alias(passage_id))
    exact = store(q.join(maybe_broadcast(first), F.col("_q") == F.col("_c")).select(span_id, F.lit(1.0).alias("similarity"), passage_id, F.lit("exact").alias("match_type")), "exact")
    rest = q.join(maybe_broadcast(exact.select(span_id)), span_id, "left_anti").filter("_q != ''")
    most = c.agg(F.max(F.length("_c"))).first()[0] or 0
    keys = store(rest.select("_q").filter(F.length("_q") <= int(most * (2 - threshold) / threshold + 1)).distinct(), "keys")
    # What a passage contains begins like some place of it, which leaves few keys to look up by their grams.
    heads = c.select(F.explode(char_ngrams(F.col("_c"), _HEAD)).alias("_h")).distinct()
    short, long = F.length("_q") < _HEAD, F.length("_q").between(_HEAD, most)
    needles = store(keys.filter(long).join(maybe_broadcast(heads), F.substring("_q", 1, _HEAD) == F.col("_h"), "left_semi").unionByName(keys.filter(short)), "needles")
    inside = holding(needles, "_q", "_q", c, passage_id, "_c").join(c.select(passage_id, "_c"), passage_id)
    inside = inside.filter(F.arrays_overlap(words(F.col("_q"), 3), words(F.col("_c"), 3))).select("_q", passage_id, similarity.sequence_ratio(F.col("_q"), F.col("_c")).alias("_r"), (F.size(words(F.col("_q"))) > 2).alias("_sub"))
    near = similarity.near_texts(keys, "_q", c, passage_id, "_c", threshold, least_word=3).select("_q", passage_id, F.col("ratio").alias("_r"), F.lit(False).alias("_sub"))
    matches = store(inside.unionByName(near), "matches")
    pairs = rest.join(maybe_broadcast(matches), "_q").join(c.select(passage_id, "_p"), passage_id)
    found = pairs.filter(F.col("_s").isNull() | ~diacritics_rejected(F.col("_s"), F.col("_p")))
    found = found.withColumn("similarity", F.when(F.col("_sub"), F.greatest(F.col("_r"), F.lit(threshold))).otherwise(F.col("_r"))).withColumn("match_type", F.when(F.col("_sub"), "substring").otherwise("fuzzy"))
    best = found.groupBy(span_id).agg(F.min_by(F.struct("similarity", passage_id, "match_type"), F.struct(-F.col("similarity"), F.col(passage_id))).alias("_b"))
    out = q.select(span_id).join(exact.unionByName(best.select(span_id, "_b.similarity", f"_b.{passage_id}", "_b.match_type")), span_id, "left")
    return out.select(span_id, F.col("match_type").isNotNull().alias("is_match"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), passage_id, "match_type")


def verify_strictly(spans: DataFrame, span_id: str, span_col: str, corpus: DataFrame, passage_id: str, passage_col: str) -> DataFrame:
    """V3 for verses: (span, is_match, similarity, passage, match_type): a passage of equal normalised text, else the one with the highest ratio (M1) among those that contain the span. Ties by id."""
    q = store(spans.select(span_id, profiles.verse_key(F.col(span_col)).alias("_q")).filter("_q != ''"), "spans")
    c = corpus.select(passage_id, profiles.verse_key(F.col(passage_col)).alias("_c"))
    pairs = contained(c, q.select("_q").distinct(), passage_id, "_q", "_c", "_q")
    pairs = pairs.select("_q", passage_id, F.when(F.col("_q") == F.col("_c"), 1.0).otherwise(similarity.sequence_ratio(F.col("_q"), F.when(F.col("_q") != F.col("_c"), F.col("_c")))).alias("similarity"), F.when(F.col("_q") == F.col("_c"), "exact").otherwise("substring").alias("match_type"))
    best = pairs.groupBy("_q").agg(F.min_by(F.struct("similarity", passage_id, "match_type"), F.struct(F.col("match_type"), -F.col("similarity"), F.col(passage_id))).alias("_b"))
    out = spans.select(span_id).join(q.join(best, "_q").select(span_id, "_b.*"), span_id, "left")
    return out.select(span_id, F.col("match_type").isNotNull().alias("is_match"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), passage_id, "match_type")


def multi_verse(span: Column) -> Column:
    """Asterisks, numbered markers and foreign runs separate; commas do if several, late, before a long waw clause, or amid a long span."""
    n = F.length(span)
    commas = F.regexp_count(span, F.lit("[،,]"))
    at = F.regexp_instr(span, F.lit("[،,]")) - 1
    tail = F.regexp_extract(span, r"(?sU)[،,]\s*و(.*)$", 1)
    comma = (commas >= 2) | ((commas == 1) & ((at > n * 0.8) | (F.length(profiles.collapse(tail)) > 15) | ((n > 200) & (at / n > 0.2) & (at / n < 0.8))))
    clear = F.contains(span, F.lit("*")) | span.rlike(_MARKER) | span.rlike(_FOREIGN)
    return F.coalesce((F.length(profiles.collapse(span)) > 0) & (clear | comma), F.lit(False))


def multi_text(span: Column, kind: Column) -> Column:
    """P1."""
    base = F.length(profiles.collapse(span)) >= 20
    verse = (F.size(words(span)) >= 50) & multi_verse(span)
    return F.coalesce(base & (F.contains(span, F.lit("*")) | F.contains(span, F.lit("\n")) | F.when(kind == "Ayah", verse).otherwise(span.rlike(_MARKER))), F.lit(False))


def separate_verses(span: Column) -> Column:
    """Parts between separators, those of under half Arabic characters dropped."""
    parts = F.transform(F.split(span, rf"(?U)\*|{_MARKER}|[^{ARABIC_BLOCKS}\s]{{3,}}|،|,"), profiles.collapse)
    ink = lambda p: F.length(F.regexp_replace(p, r"(?U)\s", ""))
    return F.filter(parts, lambda p: (ink(p) > 0) & (F.length(F.regexp_replace(p, f"[^{ARABIC_BLOCKS}]", "")) / ink(p) >= 0.5))


def split_parts(span: Column) -> Column:
    """Parts between *, (N), ornate or square markers; the whole text if none is left."""
    parts = F.filter(F.transform(F.split(span, r"\*|[(﴿\[][٠-٩0-9]+[)﴾﴿\]]"), profiles.collapse), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(span))


# The characters of each rule, and the codes with their descriptions.
FORBIDDEN = '*()[]{}﴾﴿"«»'
FORBIDDEN_END = ".,،;؛:؞؍!؟?﴾﴿)]}…"
DELIMITERS = "()[]{}﴾﴿"
QUOTES = '"«»'
CURLY_QUOTES = "“”‘’"
ISSUES = {
    "empty_or_whitespace": "Verse span is empty or contains only whitespace",
    "starts_with_non_arabic": "Verse span starts with non-Arabic character",
    "ends_with_non_arabic": "Verse span ends with non-Arabic character",
    "contains_forbidden_chars": "Contains forbidden characters (parentheses, brackets, quotes, etc.)",
    "ends_with_forbidden_punctuation": "Ends with punctuation that should not be in Quranic text",
    "contains_verse_separator": "Contains asterisk (*) which is used as verse separator",
    "contains_delimiters": "Contains parentheses, brackets, or similar delimiters",
    "contains_quotes": "Contains quotation marks",
    "contains_non_arabic_chars": "Contains non-Arabic characters in the text",
    "excessive_whitespace": "Contains excessive whitespace (multiple consecutive spaces)",
    "leading_trailing_whitespace": "Contains leading or trailing whitespace",
}
# End of fixed values.


def _class(chars: str) -> str:
    return "".join(f"\\u{ord(c):04X}" for c in chars)


def stripped(span: Column) -> Column:
    return F.regexp_replace(F.coalesce(span, F.lit("")), r"(?U)^\s+|\s+$", "")


def is_arabic(chars: Column) -> Column:
    """Whether all of a text's characters, of which there is one at least, are Arabic or white space."""
    return F.coalesce(chars.rlike(rf"(?U)^[{ARABIC_BLOCKS}\s]+$"), F.lit(False))


def separator_chars(span: Column) -> Column:
    """How many characters belong to separators: asterisks, commas, numbers in parentheses, runs of three or more that are neither Arabic nor white space."""
    kept = F.regexp_replace(F.coalesce(span, F.lit("")), rf"(?U)\*|[،,]|{_MARKER}|[^{ARABIC_BLOCKS}\s]{{3,}}", "")
    return F.length(F.coalesce(span, F.lit(""))) - F.length(kept)


def issues(span: Column) -> Column:
    """The codes of ISSUES that apply, in their order. Rules look at the stripped span, so the last code never does."""
    t = stripped(span)
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    tests = {
        "starts_with_non_arabic": ~is_arabic(first), "ends_with_non_arabic": ~is_arabic(last), "contains_forbidden_chars": t.rlike(f"[{_class(FORBIDDEN)}]"), "ends_with_forbidden_punctuation": last.rlike(f"[{_class(FORBIDDEN_END)}]"),
        "contains_verse_separator": F.contains(t, F.lit("*")), "contains_delimiters": t.rlike(f"[{_class(DELIMITERS)}]"), "contains_quotes": t.rlike(f"[{_class(QUOTES)}]"),
        "contains_non_arabic_chars": t.rlike(rf"(?U)[^{ARABIC_BLOCKS}\s{_class(FORBIDDEN)}]"), "excessive_whitespace": F.contains(t, F.lit("  ")),
    }
    return F.when(t == "", F.array(F.lit("empty_or_whitespace"))).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()])))


def describe(issue: Column) -> Column:
    """The description of a code."""
    known = F.create_map(*(F.lit(x) for item in ISSUES.items() for x in item))
    return F.coalesce(F.try_element_at(known, issue), F.concat(F.lit("Unknown issue: "), issue))


def span_report(span: Column, most: int = 10) -> Column:
    """Struct of issues, is_valid, n_chars and n_arabic of the stripped span, and its first `most` characters that are neither Arabic, white space nor forbidden, with places and names."""
    t = stripped(span)
    bad = F.filter(F.transform(F.split(t, ""), lambda c, i: F.struct(c.alias("char"), i.alias("place"))), lambda x: x["char"].rlike(rf"(?U)[^{ARABIC_BLOCKS}\s{_class(FORBIDDEN)}]"))
    bad = F.slice(bad, 1, most)
    names = character_names(F.array_join(F.transform(bad, lambda x: x["char"]), ""))
    return F.struct(issues(span).alias("issues"), (F.size(issues(span)) == 0).alias("is_valid"), F.length(t).alias("n_chars"), F.length(F.regexp_replace(t, f"[^{ARABIC_BLOCKS}]", "")).alias("n_arabic"), bad.alias("bad"), names.alias("bad_names"))


def dataset_report(spans: DataFrame, span_col: str) -> tuple[DataFrame, DataFrame]:
    """(one row of total, valid, invalid and validation_rate, 0 without spans; a row for each code with its count)."""
    rows = spans.select(issues(F.col(span_col)).alias("_i"))
    total, valid = F.count("*"), F.count_if(F.size("_i") == 0)
    counts = rows.agg(total.alias("total_spans"), valid.alias("valid_spans"), (total - valid).alias("invalid_spans"), F.coalesce(F.try_divide(valid, total), F.lit(0.0)).alias("validation_rate"))
    return counts, rows.select(F.explode("_i").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def separator_report(span: Column) -> Column:
    """P5: struct of the separator types in a span, their counts, the reason why commas count (null if they don't) and the runs of three or more characters that are neither Arabic nor white space.

    Commas count if there are several; else, over 200 characters, by their place; else before a long clause that waw begins.
    """
    t = F.coalesce(span, F.lit(""))
    n, stars, arabic, plain = F.length(t), *(F.regexp_count(t, F.lit(x)) for x in (r"\*", "،", ","))
    numbers, runs = F.regexp_extract_all(t, F.lit(_MARKER), F.lit(0)), F.regexp_extract_all(t, F.lit(_FOREIGN), F.lit(0))
    at = F.regexp_instr(t, F.lit("[،,]")) - 1
    tail = F.regexp_extract(t, r"(?sU)[،,]\s*و(.*)$", 1)
    single = F.when(n > 200, F.when((at / n > 0.2) & (at / n < 0.8), "long_text_middle_comma").when(at > n * 0.8, "comma_near_end")).when(F.length(stripped(tail)) > 15, "comma_followed_by_waw")
    reason = F.when(arabic + plain >= 2, "multiple_commas").when(arabic + plain == 1, single)
    types = F.array_compact(F.array(
        F.when(stars > 0, "asterisk"), F.when(F.size(numbers) > 0, "parenthetical_numbers"), F.when(reason.isNotNull() & (arabic > 0), "arabic_comma_smart"), F.when(reason.isNotNull() & (plain > 0), "regular_comma_smart"),
        F.when(F.size(runs) > 0, "non_arabic_sequences"),
    ))
    return F.struct(types.alias("types"), stars.alias("n_asterisks"), numbers.alias("numbers"), arabic.alias("n_arabic_commas"), plain.alias("n_commas"), reason.alias("comma_reason"), runs.alias("runs"))


_PYTHON_BLOCKS = ARABIC_BLOCKS.encode().decode("unicode_escape")
_INK = re.compile(rf"[^{_PYTHON_BLOCKS}\s]")
_SEPARATORS = tuple(re.compile(p) for p in (r"[*،,]", _MARKER, rf"[^{_PYTHON_BLOCKS}\s]{{3,}}"))
_AT_END = tuple(re.compile(f"(?:{p.pattern})$") for p in _SEPARATORS)


def _peel(text: str, end: bool, applied: list[str]) -> str:
    """Characters off one end while they are no Arabic, or punctuation that ends no verse, and belong to no separator; white space behind them goes too."""
    side, place = ("end", -1) if end else ("start", 0)
    while text and (_INK.match(text[place]) or text[place] in FORBIDDEN_END):
        if any(p.search(text[-32:]) for p in _AT_END) if end else any(p.match(text) for p in _SEPARATORS):
            break
        applied.append(f"removed_{side}_{'punctuation' if text[place] in FORBIDDEN_END else 'non_arabic'}: {text[place]}")
        text = text[:-1].rstrip() if end else text[1:].lstrip()
    return text


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.ArrayType(T.StringType()))]))
def clean_span(span: pd.Series) -> pd.DataFrame:
    """(text, applied): a span without forbidden characters, both ends peeled until nothing changes, trailing dots and repeated white space gone, and what was done, in order.

    Characters of separators (V14: asterisks, commas, numbers in parentheses, runs of three or more that are neither Arabic nor white space) are neither
    removed nor peeled. The forbidden characters removed are listed once each, in order. A null span is an empty one.
    """
    forbidden = set(FORBIDDEN + CURLY_QUOTES)

    def one(s: str | None) -> tuple[str, list[str]]:
        if not s:
            return "", ["empty_input"]
        text, applied = s.strip(), []
        held = {i for p in _SEPARATORS for m in p.finditer(text) for i in range(*m.span())}
        gone = [i for i, c in enumerate(text) if c in forbidden and i not in held]
        if gone:
            applied.append("removed_forbidden_chars: " + "".join(sorted({text[i] for i in gone})))
            text = "".join(c for i, c in enumerate(text) if c not in forbidden or i in held)
        before = None
        while text != before:
            before = text
            text = _peel(_peel(text, False, applied), True, applied)
            if re.search(r"\.{2,}$", text):
                text = re.sub(r"\.+$", "", text).rstrip()
                applied.append("removed_trailing_dots")
        if re.search(r"\s{2,}", text):
            text = re.sub(r"\s+", " ", text)
            applied.append("normalized_whitespace")
        return text.strip(), applied

    return pd.DataFrame([one(s) for s in span], columns=["text", "applied"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def character_names(chars: pd.Series) -> pd.Series:
    """Unicode names of the characters of a string, for reports."""
    return chars.map(lambda s: [unicodedata.name(c, f"U+{ord(c):04X}") for c in s or ""])
