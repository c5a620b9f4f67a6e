"""The cleaner on streams: the same narrow pass, windowed summaries, and first rows of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean
from ..operators.findings import blocking


def read(spark: SparkSession, path: str, schema, format: str = "parquet", files_a_step: int = 64) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_a_step).load(path)


def cleaned(stream: DataFrame, **how) -> DataFrame:
    """Each row is cleaned on its own, so a stream needs no state for it."""
    return clean(stream, **how)


def once_each(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_summary(stream: DataFrame, time: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents, changes and blocks for each window of event time; late rows count until the watermark."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width))
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count_if("report.changed").alias("changed"), F.count_if(blocking(F.col("report"))).alias("blocked"), F.sum("report.counts.fixed").alias("fixed")).select(F.col("window.start").alias("start"), "files", "changed", "blocked", "fixed")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> None:
    """All that is there now, then stops; a restart goes on where it ended."""
    query = stream.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
