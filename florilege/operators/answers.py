"""What models' answers become: spans put in their place, verdicts by number, corrections as text; and the models' own places in a plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import collapse, strip_quotes
from .spans import json_block

# The tags, and the labels of the four verdicts.
VERSE, NARRATION = "ق", "ح"
LABELS = ("CorrectAyah", "WrongAyah", "CorrectHadith", "WrongHadith")
# End of fixed values.


def place_spans(rows: DataFrame, text: str = "text", span: str = "span", kind: str = "kind", start: str = "start", stop: str = "stop", window: int = 50) -> DataFrame:
    """Rows with span_start, span_end and tag, those that stand nowhere dropped. Bounds whose slice is the span (white space apart) stay with
    their kind's tag; else the span's first place within `window` characters of the bounds counts, always as a verse. Bounds outside the text, a
    blank span and kinds other than q and h drop.
    """
    s, e, t, x = F.col(start), F.col(stop), F.col(text), F.col(span)
    tag = F.when(F.col(kind) == "q", VERSE).when(F.col(kind) == "h", NARRATION)
    valid = rows.filter((s >= 0) & (s < e) & (e <= F.length(t)) & (F.length(collapse(x)) > 0) & tag.isNotNull())
    here = collapse(F.substr(t, s + 1, e - s)) == collapse(x)
    begin = F.greatest(F.lit(0), s - window)
    area = F.substr(t, begin + 1, F.least(F.length(t), e + window) - begin)
    moved = F.nullif(F.instr(area, x), F.lit(0)) - 1 + begin
    out = valid.withColumns({"span_start": F.when(here, s).otherwise(moved), "span_end": F.when(here, e).otherwise(moved + F.length(x)), "tag": F.when(here, tag).otherwise(VERSE)})
    return out.filter("span_start IS NOT NULL")


def inclusive_slice(text: Column, start: Column, stop: Column, span: Column) -> Column:
    """Whether the slice up to and with `stop` is the span."""
    return F.coalesce((start >= 0) & (start <= stop) & (stop < F.length(text)) & (F.substr(text, start + 1, stop - start + 1) == span), F.lit(False))


def verdicts(answers: DataFrame, key: str, answer: str, spans: DataFrame, number: str, kind: str) -> DataFrame:
    """Spans (key, number from 1, kind) with predicted: the label that the answer gives the number, the last of several; Wrong and the kind where it gives none of LABELS."""
    found = answers.select(key, F.from_json(json_block(F.col(answer)), "validations array<struct<index: string, label: string>>")["validations"].alias("_v"))
    found = found.select(key, F.posexplode("_v").alias("_i", "_x")).select(key, "_i", F.expr("try_cast(_x.index AS int)").alias(number), F.trim("_x.label").alias("_label"))
    found = found.filter(F.col(number).isNotNull() & F.col("_label").isin(*LABELS)).groupBy(key, number).agg(F.max_by("_label", "_i").alias("_label"))
    return spans.join(found, [key, number], "left").withColumn("predicted", F.coalesce("_label", F.concat(F.lit("Wrong"), kind))).drop("_label")


def correction_text(answer: Column) -> Column:
    """The answer's correction, or the answer itself where it holds none; without quotation marks around it."""
    block = json_block(answer)
    return strip_quotes(F.coalesce(F.get_json_object(block, "$.correction"), answer))


def numbered_prompt(spans: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, prompt): the quotations of a key numbered from 1, a line each."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    lines = F.transform("_items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"]))
    return spans.groupBy(key).agg(items.alias("_items")).select(key, F.array_join(lines, "\n").alias("prompt"))


_clients: dict[str, object] = {}


def client(name: str, make: Callable[[], object | None]) -> object | None:
    """K8: one client of a name in each worker process, made when first asked for; None where `make` has no key for it."""
    if name not in _clients:
        _clients[name] = make()
    return _clients[name]


def detect(rows: DataFrame, id_col: str, prompt: str, name: str, make: Callable[[], Callable[[str], str] | None], tries: int = 3, wait: float = 2.0) -> DataFrame:
    """K7: (id, answer, error): a model behind a plain function, asked once for each row, again after `wait`, then twice that; null and the error's text after `tries`. Without a client: null and `no client`."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        call = client(name, make)
        for batch in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for text in batch["_prompt"]:
                answer, error = None, None if call else "no client"
                for k in range(tries if call else 0):
                    try:
                        answer, error = call(text), None
                        break
                    except Exception as e:  # whatever a client raises is its row's error
                        error = f"{type(e).__name__}: {e}"
                        if k < tries - 1:
                            time.sleep(wait * 2**k)
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({id_col: batch[id_col], "answer": answers, "error": errors})

    base = rows.select(id_col, F.col(prompt).alias("_prompt"))
    return base.mapInPandas(ask, f"{id_col} {dict(base.dtypes)[id_col]}, answer string, error string")


def scored(rows: DataFrame, query: str, passage: str, make: Callable[[], Callable[[list[str]], list[float]]], batch: int = 16, words: int = 512) -> DataFrame:
    """Rows with rerank_score, the sigmoid of what a pluggable model says of `query [SEP] passage`, `words` words at most; all 0 in a batch where it fails. The model is made once a task."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import math

        model = None
        for a, b in batches:
            texts = [" ".join(f"{x or ''} [SEP] {y or ''}".split()[:words]) for x, y in zip(a, b, strict=True)]
            out: list[float] = []
            try:
                model = model or make()
                for i in range(0, len(texts), batch):
                    out += [1 / (1 + math.exp(-x)) for x in model(texts[i : i + batch])]
            except Exception:  # a model that fails ranks nothing
                out = [0.0] * len(texts)
            yield pd.Series(out)

    return rows.withColumn("rerank_score", score(F.col(query), F.col(passage)))
