"""Text normalisers as Column functions. Each profile is a function of its own; they differ on purpose and must not be merged."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and replacements that results depend on.
MARKS = "\\u064B-\\u0652"
MARKS_ALEF_TATWEEL = "\\u064B-\\u0652\\u0670\\u0640"
WAQF = "\\u06D6-\\u06DC\\u06DF-\\u06E4\\u06E7\\u06E8\\u06EA-\\u06ED"
SMALL_LETTERS = "\\u06E5\\u06E6"
ARABIC_LETTERS = "\\u0621-\\u063A\\u0641-\\u064A"
ARABIC_BLOCKS = "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
ALIGN_BLOCKS = "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\u0590-\\u05FF"
DIACRITIC_SET = "ًٌٍَُِّْٰٔ"
MATCHER_PUNCTUATION = "ۚ۩﴾﴿؛،.,!?:;\"'()[]{}"
LIGHT_PUNCTUATION = "ۚ۩﴾﴿؛،.,:;!?()[]\"'«»-–—"
DIGITS = "\\u06F0-\\u06F9\\u0660-\\u0669\\p{Nd}"
FATHA, DAMMA, KASRA, FATHATAN, DAMMATAN, KASRATAN, SHADDA, SUKUN, TATWEEL, ALEF = "َ", "ُ", "ِ", "ً", "ٌ", "ٍ", "ّ", "ْ", "ـ", "ا"
VOWELS = (FATHA, KASRA, DAMMA, FATHATAN, KASRATAN, DAMMATAN)
# End of fixed values.


def collapse(text: Column) -> Column:
    """Runs of any Unicode white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def delete(text: Column, charclass: str) -> Column:
    return F.regexp_replace(text, f"[{charclass}]", "")


def blank(text: Column, chars: str) -> Column:
    return F.translate(text, chars, " " * len(chars))


def _each(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def verse_key(text: Column) -> Column:
    """No marks; punctuation, digits and slashes as spaces; collapsed; lower case."""
    return F.lower(collapse(F.regexp_replace(delete(text, MARKS), r'[،؛:.!?()«»"0-9\[\]/]', " ")))


def narration_key(text: Column) -> Column:
    """N1 with alef, teh marbuta and alef maksura variants folded."""
    return F.translate(verse_key(text), "أإآةى", "اااهي")


def index_key(text: Column) -> Column:
    """Letters and white space only. Alef wasla isn't in the letters kept: it goes."""
    return collapse(F.regexp_replace(delete(text, MARKS_ALEF_TATWEEL), rf"(?U)[^{ARABIC_LETTERS}\s]", ""))


def matcher_key(text: Column) -> Column:
    """No marks, punctuation as spaces, no digits, collapsed."""
    return collapse(delete(blank(delete(text, MARKS_ALEF_TATWEEL), MATCHER_PUNCTUATION), DIGITS))


def _default_diacritics(text: Column, reorder: bool) -> Column:
    pairs = [(FATHA + ALEF, ALEF), (KASRA + "ي", "ي"), (DAMMA + "و", "و"), (ALEF + "ل" + SUKUN, ALEF + "ل"), (SUKUN, "")]
    pairs += [(v + SHADDA, SHADDA + v) for v in VOWELS] if reorder else []
    pairs += [(ALEF + FATHA, ALEF), (ALEF + KASRA, ALEF), ("ل" + KASRA + ALEF, "ل" + ALEF), (ALEF + FATHATAN, FATHATAN + ALEF)]
    return _each(text, pairs)


def official_diacritics(text: Column) -> Column:
    """Default vowels dropped, shadda before its vowel."""
    return _default_diacritics(text, True)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, for which Spark has no function."""
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def local_diacritics(text: Column) -> Column:
    """NFC; no tatweel before superscript alef, no shadda on a word's first consonant; then N5, shadda where it is."""
    out = F.regexp_replace(nfc(text), "\\u0640(?=\\u0670)", "")
    first = "[\\u0600-\\u06FF][\\u064B-\\u0650]?"
    out = F.regexp_replace(F.regexp_replace(out, f"(?<= )({first})\\u0651", "$1"), f"^({first})\\u0651", "$1")
    return _default_diacritics(out, False)


def snapped_diacritics(text: Column) -> Column:
    """N6 with verse markers attached to the word before."""
    return F.regexp_replace(local_diacritics(text), r"(?U) \((\d+)\)", "($1)")


def light_key(text: Column) -> Column:
    """No marks; punctuation, quotes and dashes as spaces; no digits; collapsed."""
    return collapse(delete(blank(delete(text, MARKS_ALEF_TATWEEL), LIGHT_PUNCTUATION), DIGITS))


def lenient_key(text: Column) -> Column:
    """No marks or pause signs, punctuation deleted, collapsed."""
    return collapse(F.regexp_replace(delete(text, MARKS_ALEF_TATWEEL + WAQF), r"[،؛؟,;.!?\"'()\[\]{}]", ""))


def bare(text: Column) -> Column:
    """No marks or pause signs, small waw and yeh included."""
    return delete(text, MARKS_ALEF_TATWEEL + WAQF + SMALL_LETTERS)


def no_diacritics(text: Column) -> Column:
    """N12."""
    return F.translate(text, DIACRITIC_SET, "")


def has_diacritics(text: Column) -> Column:
    """N13."""
    return text.rlike(f"[{DIACRITIC_SET}]")


def align_key(text: Column) -> Column:
    """Arabic and Hebrew blocks and white space only, collapsed."""
    return collapse(F.regexp_replace(text, rf"(?U)[^{ALIGN_BLOCKS}\s]", ""))


def prompt_escape(text: Column) -> Column:
    """The bracket format's own characters replaced, length kept."""
    return F.translate(text, "[]|", "{},")


def drop_lone_marker(text: Column) -> Column:
    """A final (N) goes unless another one remains."""
    rest = F.regexp_replace(text, r"(?U)\s*\(\d+\)\s*$", "")
    return F.when(rest.rlike(r"(?U)\(\d+\)"), text).otherwise(rest)


def strip_quotes(text: Column) -> Column:
    """N18."""
    return F.btrim(text, F.lit("\"'“”‘’«»"))


PROFILES = {
    "verse_key": verse_key, "narration_key": narration_key, "index_key": index_key, "matcher_key": matcher_key, "official_diacritics": official_diacritics, "local_diacritics": local_diacritics,
    "snapped_diacritics": snapped_diacritics, "light_key": light_key, "lenient_key": lenient_key, "bare": bare, "no_diacritics": no_diacritics, "align_key": align_key, "prompt_escape": prompt_escape,
    "collapse": collapse, "drop_lone_marker": drop_lone_marker, "strip_quotes": strip_quotes,
}
