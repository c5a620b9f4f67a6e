"""What reports add up to: findings as rows, counts by severity, summaries and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"error": 3, "warn": 2, "info": 1, "fixed": 0}
EXAMPLES = 8


def exploded(reports: DataFrame, *keys: str, report: str = "report") -> DataFrame:
    """A row for each finding: the keys, its place, and its parts."""
    return reports.select(*keys, F.posexplode(f"{report}.findings").alias("ord", "f")).select(*keys, "ord", "f.*")


def merged(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings of equal layer, kind, severity and message as one: counts added, the first examples, counts by rule added.

    The findings are gone through once: each gives a row for itself, for each example and for each rule.
    """
    same = [*keys, "layer", "kind", "severity", "message"]
    itself, example, rule = (F.lit(k).cast("byte") for k in range(3))
    place = lambda at: F.shiftleft(F.col("ord").cast("long"), 32) + at
    row = lambda what, name, first, n: F.struct(what.alias("what"), name.cast("string").alias("name"), first.alias("first"), n.cast("long").alias("n"))
    rows = F.concat(
        F.array(row(itself, F.lit(None), place(F.lit(0)), F.col("count"))),
        F.coalesce(F.transform("examples", lambda e, at: row(example, e, place(at), F.lit(None))), F.array()),
        F.coalesce(F.transform(F.map_entries("by_rule"), lambda r: row(rule, r["key"], F.lit(None).cast("long"), r["value"])), F.array()),
    )
    each = findings.select(*same, F.inline(rows)).groupBy(*same, "what", "name").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    # Each example once, by its first place; of these the first few, so no more than they are ever gathered.
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy(*same, "what").orderBy("first", "name"))).where((F.col("what") != example) | (F.col("rank") <= EXAMPLES))
    of = lambda what, x: F.when(F.col("what") == what, x)
    some = F.array_sort(F.collect_list(of(example, F.struct("rank", "name"))))
    return each.groupBy(*same).agg(
        F.sum(of(itself, F.col("n"))).alias("count"),
        F.shiftright(F.min(of(itself, F.col("first"))), 32).cast("int").alias("ord"),
        F.transform(some, lambda s: s["name"]).alias("examples"),
        F.map_from_entries(F.array_sort(F.collect_list(of(rule, F.struct("name", "n"))))).alias("by_rule"),
    )


def by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of every severity, zero where there is none."""
    return findings.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).cast("long").alias(s) for s in SEVERITY])


def summary(reports: DataFrame, *keys: str, report: str = "report") -> DataFrame:
    """Files, how many changed and block, and findings by severity."""
    of = lambda s: F.coalesce(F.sum(f"{report}.counts.{s}"), F.lit(0)).cast("long").alias(s)
    aggregates = [F.count(F.lit(1)).alias("files"), F.count_if(F.col(f"{report}.changed")).alias("changed"), F.count_if(blocking(F.col(report))).alias("blocked"), of("fixed"), of("warn"), of("error")]
    return reports.groupBy(*keys).agg(*aggregates) if keys else reports.agg(*aggregates)


def cube(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts over every combination of the keys."""
    return findings.cube(*keys).agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("findings"))


def blocking(report: Column) -> Column:
    return F.exists(report["findings"], lambda f: f["severity"] == "error")


def gate(reports: DataFrame, strict: bool = False, write: bool = False, report: str = "report") -> DataFrame:
    """One row with the exit code of a run: 1 if something blocks, or, in a strict check, would change."""
    blocked = F.coalesce(F.bool_or(blocking(F.col(report))), F.lit(False)) & F.lit(not write or strict)
    changed = F.coalesce(F.bool_or(F.col(f"{report}.changed")), F.lit(False)) & F.lit(strict and not write)
    return reports.agg((blocked | changed).cast("int").alias("exit_code"))


def lines(report: Column, path: Column, write: bool = True) -> Column:
    """A report as text: a head, then its findings, the gravest first."""
    tags = F.create_map(*[F.lit(x) for pair in {"info": "info", "error": "block", "fixed": "fixed" if write else "would fix", "warn": "warn"}.items() for x in pair])
    grade = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    bits = [F.when(report["counts"][s] > 0, F.concat(report["counts"][s].cast("string"), F.lit(" " + (s if write or s != "fixed" else "would fix")))) for s in ("error", "warn", "fixed")]
    numbered = F.transform(report["findings"], lambda f, i: F.struct((-F.element_at(grade, f["severity"])).alias("g"), i.alias("i"), f.alias("f")))
    ordered = F.transform(F.array_sort(F.transform(numbered, lambda x: F.struct(x["g"].alias("g"), x["i"].alias("i")))), lambda x: F.get(report["findings"], x["i"]))
    line = lambda f: F.concat(F.lit("  ["), F.element_at(tags, f["severity"]), F.lit("] "), f["message"], F.lit(" x"), f["count"].cast("string"), F.when(F.size(f["examples"]) > 0, F.concat(F.lit("  ("), F.array_join(f["examples"], ", "), F.lit(")"))).otherwise(F.lit("")))
    head = F.concat(path, F.lit("  ("), F.concat_ws(", ", *bits), F.lit(")"))
    return F.when(F.size(report["findings"]) == 0, F.concat(F.lit("clean  "), path)).otherwise(F.array_join(F.concat(F.array(head), F.transform(ordered, line)), "\n"))
