"""Readers and writers of the formats that quotation data come in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = r"(?s)<Question>(.*?)</Question>"
SPAN_SCHEMA = "Question_ID string, Annotation_ID int, Label string, Span_Start int, Span_End int, Original_Span string"
CORRECTION_SCHEMA = "Question_ID string, Label string, Span_Start int, Span_End int, Original_Span string, Correction string"
TEST_SCHEMA = "Sequence_ID int, Question_ID string, Span_Type string, Span_Start int, Span_End int, Original_Span string"
VERSES_SCHEMA = "surah_id int, surah_name string, ayah_id int, ayah_text string"
NARRATIONS_SCHEMA = "hadithID string, BookID string, title string, hadithTxt string, Matn string"


def xml_questions(xml: DataFrame, text_col: str = "value", strip: bool = False, unescape: bool = False) -> DataFrame:
    """(pos, id, response) of each <Question> in rootless XML; the last of equal ids wins where `strip` readers are meant."""
    block = xml.select(F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(QUESTION), F.lit(1))).alias("pos", "_b"))

    def tag(name: str) -> Column:
        out = F.regexp_extract("_b", f"(?s)<{name}>(.*?)</{name}>", 1)
        out = F.btrim(out, F.lit(" \t\r\n")) if strip else out
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")) if unescape else ():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return block.select("pos", tag("ID").alias("id"), tag("Text").alias("text"), tag("Response").alias("response"))


def read_xml(spark: SparkSession, path: str, **options) -> DataFrame:
    return xml_questions(spark.read.text(path, wholetext=True), **options)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """S5-S8; pass header=False for prediction files. Quotes are ordinary characters."""
    return spark.read.csv(path, schema=schema, sep="\t", header=header, quote="", enforceSchema=True)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """S8, K4's reader: a table with header, quotes and any separator; quoted fields may hold line breaks."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)


def read_first(spark: SparkSession, schema: str, table: str | None, alternative: str | None) -> DataFrame:
    """The prepared CSV table where it exists, else the TSV one; without both an error."""
    for path, read in ((table, read_csv), (alternative, read_tsv)):
        if path and _exists(spark, path):
            return read(spark, path, schema)
    raise FileNotFoundError(f"neither {table} nor {alternative} exists")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def body_slice(documents: DataFrame, question: Column, start: Column, end: Column, xml_col: str = "xml") -> Column:
    """The slice of the Body of the Question whose ID attribute is `question` in a document; null where there is none or the XML is broken. For one slice a document: body_slices() parses each once."""
    return _slice(F.try_element_at(_bodies(F.col(xml_col)), question), start, end)


def body_slices(spans: DataFrame, documents: DataFrame, doc_id: str, question: str, start: str, end: str, xml_col: str = "xml") -> DataFrame:
    """Spans with `slice`, as body_slice() gives it: each document is parsed once, and spans meet its Bodies by document and question."""
    bodies = documents.select(doc_id, F.explode(_bodies(F.col(xml_col))).alias(question, "_body"))
    return spans.join(bodies, [doc_id, question], "left").withColumn("slice", _slice(F.col("_body"), F.col(start), F.col(end))).select(*spans.columns, "slice")


def _slice(body: Column, start: Column, end: Column) -> Column:
    return F.nullif(F.substr(body, start + 1, end - start), F.lit(""))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _bodies(xml: pd.Series) -> pd.Series:
    """The Body of each Question by its ID, the first of equal ones; null for a text that isn't XML."""
    from xml.etree import ElementTree

    def every(x: str | None) -> dict[str, str | None] | None:
        try:
            found = [(q.get("ID"), q.findtext(".//Body")) for q in ElementTree.fromstring(x).iter("Question")]
        except (ElementTree.ParseError, TypeError):
            return None
        return {k: body for k, body in reversed(found) if k is not None}

    return pd.Series([every(x) for x in xml], dtype=object)


def write_index(postings: DataFrame, statistics: DataFrame, path: str) -> None:
    """The tables of an index in a folder, for read_index()."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    statistics.write.mode("overwrite").parquet(f"{path}/statistics")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None] | None:
    """(postings, statistics) of an index folder; statistics may be missing (None), without postings there is no index (None)."""
    if not _exists(spark, f"{path}/postings"):
        return None
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/statistics") if _exists(spark, f"{path}/statistics") else None


def submission_file(spark: SparkSession, folder: str, ending: str = ".tsv") -> str:
    """The first file by name that has the ending, else the first that isn't hidden; an error in a folder without one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isFile())
    shown = [n for n in names if not n.rsplit("/", 1)[-1].startswith(".")]
    found = [n for n in shown if n.endswith(ending)] or shown
    if not found:
        raise FileNotFoundError(f"no {ending} file in {folder}")
    return found[0]


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Corpora kept as one JSON array; null items drop."""
    fields = ", ".join(f"{n}: {k}" for n, k in (x.split() for x in schema.split(", ")))
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"array<struct<{fields}>>")).alias("item"))
    return items.filter("item IS NOT NULL").select("item.*")


def narration_body(matn: Column, text: Column) -> Column:
    """Matn, or the full text where Matn is null or empty."""
    return F.coalesce(F.nullif(matn, F.lit("")), text)


def read_results(spark: SparkSession, pattern: str, subtasks: tuple[str, ...] = ("1A", "1B", "1C")) -> DataFrame:
    """Result documents by glob, with their file, unknown subtasks skipped."""
    df = spark.read.json(pattern, multiLine=True)
    return df.filter(F.col("subtask").isin(*subtasks)).withColumn("file", F.input_file_name())


def write_tsv(df: DataFrame, path: str, header: bool, sentinel: str | None = None, mode: str = "errorifexists") -> None:
    """K1-K3: null text columns get the sentinel here and nowhere else."""
    (df.na.fill(sentinel) if sentinel is not None else df).write.mode(mode).csv(path, sep="\t", header=header, quote="")


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """K4: with header; fields that need it are quoted."""
    df.write.mode(mode).csv(path, sep=sep, header=True, quote='"', escape='"')


def verdict_lines(rows: DataFrame, position: str, verdict: Column) -> DataFrame:
    """K3: (1-based position, Correct or Incorrect); rows without verdict are skipped but keep their number."""
    out = rows.select((F.col(position) + 1).alias("position"), F.when(verdict, "Correct").when(~verdict, "Incorrect").alias("verdict"))
    return out.filter("verdict IS NOT NULL")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5."""
    df.write.mode(mode).json(path)


def model_file_name(model: Column) -> Column:
    return F.regexp_replace(model, "[^A-Za-z0-9_-]", "_")
