"""The full cleaner over tables: one narrow pass, no shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layers, settings as options
from ..functions.rulebook import load
from ..shipping import pieces, ship

FINDING = "struct<layer:string,kind:string,severity:string,message:string,count:bigint,examples:array<string>,by_rule:map<string,bigint>>"
COUNTS = "struct<fixed:bigint,warn:bigint,error:bigint,info:bigint>"
REPORT = f"struct<changed:boolean,original_length:bigint,cleaned_length:bigint,counts:{COUNTS},findings:array<{FINDING}>>"
SEVERITIES = ("fixed", "warn", "error", "info")

_text = pa.string()
FINDING_ARROW = pa.struct([("layer", _text), ("kind", _text), ("severity", _text), ("message", _text), ("count", pa.int64()), ("examples", pa.list_(_text)), ("by_rule", pa.map_(_text, pa.int64()))])
REPORT_ARROW = pa.struct([("changed", pa.bool_()), ("original_length", pa.int64()), ("cleaned_length", pa.int64()), ("counts", pa.struct([(s, pa.int64()) for s in SEVERITIES])), ("findings", pa.list_(FINDING_ARROW))])


def counted(findings: list[dict]) -> dict[str, int]:
    out = dict.fromkeys(SEVERITIES, 0)
    for f in findings:
        out[f["severity"]] += f["count"]
    return out


def report(before: str, after: str, findings: list[dict]) -> dict:
    return {"changed": before != after, "original_length": len(before), "cleaned_length": len(after), "counts": counted(findings), "findings": findings}


def fresh(df: DataFrame, *names: str) -> list[str]:
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _clean(how: dict, home: str | None, names: list[str], at: int = -1):
    """The text is column `at`, or else one in front that isn't given back."""
    first = int(at < 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = load(home)
        for batch in pieces(batches, max(0, at)):
            cleaned, reports = [], []
            for text in batch.column(max(0, at)).to_pylist():
                if text is None:
                    cleaned.append(None)
                    reports.append(None)
                    continue
                after, findings = layers.clean_text(text, how, rules)
                cleaned.append(after)
                made = report(text, after, findings)
                made["findings"] = [f | {"by_rule": list(f["by_rule"].items())} for f in findings]
                reports.append(made)
            columns = [*batch.columns[first:], pa.array(cleaned, pa.string()), pa.array(reports, REPORT_ARROW)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[first:], *names])

    return run


def clean(df: DataFrame, text_col: str = "text", settings: dict | None = None, rules_home: str | None = None) -> DataFrame:
    """df with columns cleaned and report (with a trailing _ each where df has these). A null text has neither."""
    ship(df.sparkSession)
    names = fresh(df, "cleaned", "report")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns] + [f"`{names[0]}` string", f"`{names[1]}` {REPORT}"])
    # A column of strings goes to the workers once, not as the text and as a column to give back.
    at = df.columns.index(text_col) if dict(df.dtypes).get(text_col) == "string" and df.columns.count(text_col) == 1 else -1
    rows = df if at >= 0 else df.select(F.col(text_col).cast("string").alias("clean_text__"), *[F.col(f"`{c}`") for c in df.columns])
    return rows.mapInArrow(_clean(options.checked(settings or {}), rules_home, names, at), schema)


def _normalize(form: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))

    return run


def normalized(df: DataFrame, text_col: str, form: str = "NFC") -> DataFrame:
    """df with the text in a normal form; texts that can't change (no mark for NFC, ASCII for the others) stay in the JVM."""
    ship(df.sparkSession)
    may = F.col(text_col).rlike("[\\x{300}-\\x{10FFFF}]" if form == "NFC" else "[^\\x{0}-\\x{7F}]")
    (made,) = fresh(df, "normal")
    df = df.withColumn(made, _normalize(form)(F.when(may, F.col(text_col))))
    return df.withColumn(text_col, F.coalesce(F.col(made), F.col(text_col))).drop(made)
