"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries (at most `counters` each) find every digest that more than one row in
`counters + 1` carries. What the summaries propose is verified by exact counts, and the winners
of these few digests, at most `counters` rows, are broadcast, so rows of hot groups are settled
where they are read. All other digests are shuffled as usual; none of their groups can hold
more than 1 / (counters + 1) of the rows.

Defined results: a null text counts as the empty text; a null id is smaller than any id; of rows
equal in text and id one stays; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import even_tree, fresh, staged

COUNTERS = 1024


def merge_counts(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The mergeable form of Misra-Gries: beyond so many counters, the largest that must go is taken off all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: n - cut for k, n in counts.items() if n > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            rows = pa.table([batch.column(0), batch.column(1)], ["k", "n"]).group_by("k").aggregate([("n", "sum")])
            for k, n in zip(rows["k"].to_pylist(), rows["n_sum"].to_pylist(), strict=True):
                counts[k] = counts.get(k, 0) + n
            counts = merge_counts(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["k", "n"])

    return run


def heavy_hitters(keys: DataFrame, column: str, counters: int = COUNTERS) -> list[bytes]:
    """Values of a binary column, at most `counters`, among them all that more than 1 row in counters + 1 has."""
    ship(keys.sparkSession)
    found = keys.select(F.col(column).alias("k"), F.lit(1).cast("long").alias("n")).mapInArrow(_summaries(counters), "k binary, n long")
    for parts in even_tree(max(1, keys.rdd.getNumPartitions())):
        found = found.repartition(parts).mapInArrow(_summaries(counters), "k binary, n long")
    return [bytes(r.k) for r in found.collect()[:counters]]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def settle(rows: DataFrame, key: str, order: list[Column], result: str, counters: int = COUNTERS) -> DataFrame:
    """rows with a struct column `result`: keep (the greatest struct of `order` in the row's group) and size.

    rows must be cheap to read again (a staged table).
    """
    spark = rows.sparkSession
    hot = heavy_hitters(rows, key, counters)
    names = spark.createDataFrame([(bytearray(h),) for h in hot], f"{key} binary")
    best = F.struct(F.max(F.struct(*order)).alias("keep"), F.count(F.lit(1)).alias("size"))
    winners = rows.join(F.broadcast(names), key, "left_semi").groupBy(key).agg(best.alias(result)) if hot else None
    over = Window.partitionBy(key)
    cold = rows.join(F.broadcast(names), key, "left_anti") if hot else rows
    out = cold.withColumn(result, F.struct(F.max(F.struct(*order)).over(over).alias("keep"), F.count(F.lit(1)).over(over).alias("size")))
    if hot:
        winners = spark.createDataFrame(winners.collect(), winners.schema)  # at most `counters` rows
        out = out.unionByName(rows.join(F.broadcast(winners), key))
    return out


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    done = settle(rows, "digest", [F.col("doc_id"), F.col("row")], "of", counters)
    return done.select(
        "doc_id",
        F.col("of.keep.doc_id").alias("keep_id"),
        F.col("of.size").alias("group_size"),
        (F.col("row") == F.col("of.keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns."""
    key, rank = fresh(docs, "digest", "place")
    spark = docs.sparkSession
    rows = docs.withColumn(key, digest(F.col(text_col)))
    narrow = staged(rows.select(F.col(id_col).alias("id"), F.col(key).alias("k")), "digests")
    hot = heavy_hitters(narrow, "k", counters)
    first = Window.partitionBy(key).orderBy(F.col(id_col).desc_nulls_last())
    if hot:
        names = spark.createDataFrame([(bytearray(h),) for h in hot], "k binary")
        won = narrow.join(F.broadcast(names), "k", "left_semi").groupBy("k").agg(F.max("id").alias("id")).collect()
        won_key, won_id = fresh(rows, "won_key", "won_id")
        winners = spark.createDataFrame([(r.k, r.id) for r in won], f"{won_key} binary, {won_id} {narrow.schema['id'].dataType.simpleString()}")
        rows = rows.join(F.broadcast(winners), F.col(key) == F.col(won_key), "left").where(F.col(won_key).isNull() | F.col(id_col).eqNullSafe(F.col(won_id))).drop(won_key, won_id)
    # Ties of one id and text are left to the rank, which Spark also limits before the shuffle.
    return rows.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(docs.columns)
