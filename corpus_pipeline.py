"""A training-data pipeline over `documents`: quality, exact and near duplicates, mixture, pieces.

Each stage takes what its predecessor kept; all but the last return the columns of their input.

Defined results: a null text counts as empty in every stage and passes as null; a null id is a row
like others (last of its group in exact dedup, last in near dedup); of rows equal in text one stays
after exact dedup, so repeated rows come back only through the mixture, which repeats whole
documents; the null source is a source; columns beyond those named pass through all but the last
stage, whatever their names; an empty table gives an empty table with the columns of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsieve.llm import exact_dedup, minhash, mixing, pieces, quality
from quillsieve.llm.common import scratch, staged, table
from quillsieve.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 80 % of their five-word shingles, the row with the least id stays."""
    return minhash.dedup(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is two rows."""
    return mixing.repeated(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the check that they give the text back."""
    rows, new = pieces.encoded(docs.select("doc_id", "source", "text"), tokenizer_file("piece_bpe_32k.model"))
    back = rows["text"].isNull() | (rows[new["decoded"]] == rows["text"])
    return rows.select("doc_id", "source", rows[new["n_pieces"]].alias("n_pieces"), rows[new["ids_crc32"]].alias("ids_crc32"), rows[new["ids"]].alias("ids"), back.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: The classifier is fitted, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), f"stage-{k}"))
    return STAGES[-1][1](spark, docs, sf_dir)
