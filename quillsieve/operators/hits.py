"""Places in texts: phrases with their offsets, and what becomes of each special character."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layers, settings as options
from ..functions.rulebook import load
from ..shipping import pieces, ship

HIT = "struct<start:int,end:int,kind:string,id:string,severity:string,text:string>"
CLASS = "struct<index:int,char:string,code:int,action:string,name:string>"
_s, _i = pa.string(), pa.int32()
HIT_ARROW = pa.list_(pa.struct([("start", _i), ("end", _i), ("kind", _s), ("id", _s), ("severity", _s), ("text", _s)]))
CLASS_ARROW = pa.list_(pa.struct([("index", _i), ("char", _s), ("code", _i), ("action", _s), ("name", _s)]))


def _hits(how: dict):
    def one(text: str) -> list[dict]:
        names = ("start", "end", "kind", "id", "severity", "text")
        return [dict(zip(names, h, strict=True)) for h in layers.phrase_hits(text, how, load())]

    return one


def _classes(how: dict, every: bool):
    def one(text: str) -> list[dict]:
        decided = {i: (action, name if action != "keep" else None) for i, action, name, _ in layers.characters_of(how, load()).decisions(text)}
        places = range(len(text)) if every else decided
        return [{"index": i, "char": text[i], "code": ord(text[i]), "action": decided.get(i, ("keep", None))[0], "name": decided.get(i, ("keep", None))[1]} for i in places]

    return one


def _rows(make, how: dict, kind, *more):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make(how, *more)
        for batch in pieces(batches):
            made = [one(t) if t is not None else [] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, kind)], [*batch.schema.names[1:], "hits_found__"])

    return run


def _found(df: DataFrame, text_col: str, keys: list[str], run, kind: str) -> DataFrame:
    ship(df.sparkSession)
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"hits_found__ array<{kind}>"])
    rows = df.select(F.col(text_col).cast("string").alias("hits_text__"), *keys).mapInArrow(run, schema)
    return rows.select(*keys, F.posexplode("hits_found__").alias("ord", "hits_found__")).select(*keys, "ord", "hits_found__.*")


def phrases(df: DataFrame, *keys: str, text_col: str = "text", settings: dict | None = None) -> DataFrame:
    """A row for each phrase outside code: the keys, ord, start, end, kind, id, severity, text. Offsets are code points."""
    return _found(df, text_col, list(keys), _rows(_hits, options.checked(settings or {}), HIT_ARROW), HIT)


def characters(df: DataFrame, *keys: str, text_col: str = "text", settings: dict | None = None, every: bool = False) -> DataFrame:
    """A row for each special character (or every one): the keys, ord, index, char, code, action, name."""
    return _found(df, text_col, list(keys), _rows(_classes, options.checked(settings or {}), CLASS_ARROW, every), CLASS)


def outside(hits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """hits (key, start, end) that lie within none of the spans (key, start, end)."""
    s = spans.select(F.col(key).alias("span_key"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    return hits.join(s, (hits[key] == s.span_key) & (s.span_start <= hits.start) & (hits.end <= s.span_end), "left_anti")
