"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Each source gets a share of all words by weight, but at most `max_epochs` times its own; the
excess is shared by weight among the others until none is above its cap. With caps c and weights
w, the level L at which sum(min(c, L * w)) reaches the total lies behind the sources of lowest
c / w, so one running sum over the sources, sorted by c / w, gives it exactly.

A source's target is then taken as whole repetitions of every document plus one fractional
repetition: documents in order of a seeded key, up to the word where the target is reached. The
cut is found in two aggregations, first by 4096 key ranges, then by key within the one range
where the cut falls, so no group of documents is ever gathered, and applying it is a map. Sorted in
one task are the sources, one row each, and of a source the keys of one range, 1 in 4096.

Defined results: a null text has no words; the null source is a source, sorted last; documents of
one key (repeated ids) at the cut share what is left evenly, rounded down; the mixture itself
(`repeated`) holds whole documents, so a source is off its target by half a document of each id at
its cut at most; a source without words has target 0; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, scratch, small, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGES_HEX = 3  # hex digits of the key that name its range


def words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    """A seeded key of 13 hex digits; the same in every run and engine."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, total: float | None = None) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds target. total: words wanted, by default all there are."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    every_word = F.sum("source_size").over(every) if total is None else F.lit(total)
    wanted = F.least(every_word.cast("double"), F.sum("cap").over(every))
    # The level if this source and all above it were below their caps; the first where that holds is it.
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / rest
    at = caps.withColumn("try", level).withColumn("water", F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "source", "try"))).over(every)["try"])
    return at.select("source", "source_size", "weight", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water"))).alias("target"))


def plan(narrow: DataFrame, **how) -> DataFrame:
    """narrow: source, key, size. One row per source: source_size, target, whole, cut (a key or null), cut_share."""
    by_range = narrow.groupBy("source", F.substring("key", 1, RANGES_HEX).alias("range")).agg(F.sum("size").alias("size"))
    by_range = staged(by_range, "mix-ranges")
    goal = staged(targets(by_range.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "mix-targets")
    goal = goal.withColumn("whole", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
    goal = goal.withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    cut = ranges.join(goal.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s"))).where((F.col("part") > F.col("before")) & (F.col("part") <= F.col("before") + F.col("size")))
    cut = cut.select("s", "range", (F.col("part") - F.col("before")).alias("left"))
    n = goal.count()  # sources are few, but that is checked before any of this is broadcast
    inside = narrow.withColumn("range", F.substring("key", 1, RANGES_HEX)).join(small(cut.withColumnRenamed("range", "r"), n), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    keys = inside.groupBy("source", "key", "left").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).where((F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("size")))
    keys = keys.select(F.col("source").alias("s"), F.col("key").alias("cut"), ((F.col("left") - F.col("before")) / F.col("size")).alias("cut_share"))
    return goal.join(keys, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, **how) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns size, source_size, target, whole, part (words of the fractional repetition) and taken, and the names these have."""
    new = dict(zip(("size", "key", "of", "source_size", "target", "whole", "part", "taken"), fresh(docs, "size", "key", "mix_of", "source_size", "target", "whole", "part", "taken"), strict=True))
    rows = docs.withColumn(new["size"], F.col(size_col) if size_col else words(F.col(text_col))).withColumn(new["key"], order_key(F.col(id_col), seed))
    with scratch() as keep:
        narrow = staged(rows.select(F.col(source_col).alias("source"), F.col(new["key"]).alias("key"), F.col(new["size"]).alias("size")), "mix-sizes")
        made = keep(staged(plan(narrow, **how), "mix-plan"))
    n = made.count()
    of = made.select(F.struct("source", "source_size", "target", "whole", "cut", "cut_share", "part").alias(new["of"]))
    full = F.col(f"{new['of']}.part") > 0
    key, size, cut = F.col(new["key"]), F.col(new["size"]), F.col(f"{new['of']}.cut")
    part = F.when(full & (key < cut), size).when(full & (key == cut), F.floor(size * F.col(f"{new['of']}.cut_share") + F.lit(1e-9))).otherwise(F.lit(0)).cast("long")
    out = rows.join(small(of, n), F.col(source_col).eqNullSafe(F.col(f"{new['of']}.source")))
    out = out.withColumns({new[c]: F.col(f"{new['of']}.{c}") for c in ("source_size", "target", "whole")} | {new["part"]: part})
    return out.withColumn(new["taken"], size * F.col(new["whole"]) + F.col(new["part"])).drop(new["key"], new["of"]), new


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as often as it is taken, always whole; the one at a source's cut stays if at least half of it is taken."""
    mixed, new = mix(docs, **how)
    size, whole, part = (F.col(new[c]) for c in ("size", "whole", "part"))
    (copy,) = fresh(mixed, "copy")
    # A document without words comes along with the whole repetitions.
    times = whole + ((part > 0) & (2 * part >= size)).cast("long")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(docs.columns)
