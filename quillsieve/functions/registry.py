"""The cleaner under SQL names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import layers, settings as options


def register(spark: SparkSession, settings: dict | None = None) -> None:
    """Registers clean_text(text), and text_findings(text), text_phrases(text), which give JSON arrays. A null text gives null."""
    ship(spark)
    how = options.checked(settings or {})

    def mapped(f):
        def run(texts):
            return texts.map(lambda t: None if t is None else f(t))

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "string")

    as_json = lambda x: json.dumps(x, ensure_ascii=False)
    spark.udf.register("clean_text", mapped(lambda t: layers.clean_text(t, how)[0]))
    spark.udf.register("text_findings", mapped(lambda t: as_json(layers.clean_text(t, how)[1])))
    spark.udf.register("text_phrases", mapped(lambda t: as_json(layers.phrase_hits(t, how))))
