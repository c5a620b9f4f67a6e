"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.files import spread

#: White space of the word contracts: blank and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
#: Tables up to this many bytes may be broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, spread over the cores if it is small enough to be read by fewer tasks."""
    df = table(spark, sf_dir, name)
    return spread(df, df.columns[0])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one of our own (single-machine runs only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillsieve-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own; a session that has ended leaves it to whoever owns the shared folder."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)
    except Exception:
        return


def new_folder(spark: SparkSession, name: str, at_exit: bool = True) -> str:
    """A path of our own in the shared folder, below the name of the application, with its file system named; removed at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillsieve-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).makeQualified(path).toString()
    if at_exit:
        atexit.register(remove, spark, path)
    return path


_scopes: list[dict[str, SparkSession]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, gives sizes to the planner.

    The table goes when the innermost scratch() block ends, or at the end of the application.
    """
    spark = df.sparkSession
    path = new_folder(spark, name, at_exit=not _scopes)
    if _scopes:
        _scopes[-1][path] = spark
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables staged within the block at its end, but for those passed to the function it gives.

    Only what is kept, or has been written elsewhere, may be read afterwards.
    """
    mine: dict[str, SparkSession] = {}
    _scopes.append(mine)

    def keep(made: DataFrame) -> DataFrame:
        spark = mine.pop(made.staged_at)
        if len(_scopes) > 1:
            _scopes[-2][made.staged_at] = spark
        else:
            atexit.register(remove, spark, made.staged_at)
        return made

    try:
        yield keep
    finally:
        _scopes.pop()
        for path, spark in mine.items():
            remove(spark, path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcasting. The caller states the proven bound on its rows, which is checked against the byte limit."""
    if rows * max(64, 16 * len(df.columns)) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Running totals of an array of longs, itself excluded, with one further element for the total.

    A fold that appends copies its array at each step; within blocks of fixed size and then over
    the blocks, that costs block + n / block**2 copies an element instead of n.
    """
    zero = F.lit(0).cast("long")

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / F.lit(block)).cast("int")),
        lambda b: F.slice(lengths, b * block + 1, F.lit(block)),
    )
    scanned = F.transform(blocks, scan)
    ends = scan(F.transform(scanned, lambda s: F.element_at(s, -1)))
    moved = F.zip_with(
        scanned,
        ends,
        lambda s, e: F.when(s.isNull(), F.array().cast("array<long>")).otherwise(
            F.transform(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda v: v + e)
        ),
    )
    return F.concat(F.flatten(moved), F.array(F.element_at(ends, -1)))


def even_tree(parts: int, width: int = 32) -> list[int]:
    """Numbers of tasks for merging the summaries of so many parts step by step down to one."""
    steps = []
    while parts > 1:
        parts = math.ceil(parts / width)
        steps.append(parts)
    return steps


def literal_array(values: list, kind: str) -> Column:
    """An array that the optimizer folds to one literal, however many values it has (none of them with a comma)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def id_ranges(docs: DataFrame, id_col: str, parts: int) -> tuple[Column, int]:
    """The number of a row's range of ids, from cuts at approximate quantiles, and how many ranges there are (at most `parts`).

    Numbers rise with the id, from 0; null ids are in range 0. Ids are numbers. A row's range is
    found by binary search in one literal.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, NumericType):
        raise ValueError(f"{id_col}: ids that are put in order have to be numbers, not {kind.simpleString()}")
    shares = literal_array([i / parts for i in range(1, parts)] or [0.5], "double")
    cuts = docs.agg(F.percentile_approx(id_col, shares, 20 * parts).alias("q")).first().q
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0), 1
    edges, key = literal_array(cuts, kind.simpleString()), F.col(id_col)
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= key, at + step).otherwise(at)), len(cuts) + 1
