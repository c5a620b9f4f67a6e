"""A run over files: what to read, clean, write, and say."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layers
from ..operators import binary
from ..operators.clean import COUNTS, clean, report
from . import files, sink

TAGS = {"error": "block", "fixed": "fixed", "info": "info", "warn": "warn"}
GRADE = {"error": 3, "warn": 2, "info": 1, "fixed": 0}


def skipped(path: str, message: str) -> dict:
    return report("", "", [binary.finding("read", "warn", message, layer="io")]) | {"path": path}


def _plain(row) -> dict:
    return row.asDict(recursive=True)


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; a session on one machine makes its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="quillsieve-")
    return f"{shared.rstrip('/')}/quillsieve-run-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)


def _known(rows: list, limit: int) -> Iterator[tuple[int, str, str]]:
    """ord, path and message of what is never read."""
    for k, kind, path, _, length in rows:
        if kind not in files.KINDS:
            yield k, path, "path not found" if kind == "missing" else "skipped (permission denied)"
        elif length is not None and length > limit:
            yield k, path, "skipped (larger than max_file_bytes)"


def _done(spark: SparkSession, some: list, text: bool, settings: dict, write: bool) -> DataFrame:
    """ord, path, failed, changed, cleaned (bytes), lengths, counts and findings of files that are read."""
    held = files.contents(files.as_table(spark, some, "path string, ord long, suffix string"))
    if text:
        done = clean(held.select("ord", "path", "failed", files.text_of(F.col("content")).alias("text")), settings=settings)
        return done.select("ord", "path", "failed", F.lit(True).alias("text"), "report", F.when(F.col("report.changed"), F.encode("cleaned", "UTF-8")).alias("cleaned"))
    done = binary.stripped(held, "ord", "path", "failed", strip_icc=settings["strip_icc"], write=write)
    nothing = F.lit(0).cast("long")
    made = F.struct(F.col("cleaned").isNotNull().alias("changed"), nothing.alias("original_length"), nothing.alias("cleaned_length"), F.lit(None).cast(COUNTS).alias("counts"), "findings")
    return done.select("ord", "path", "failed", F.lit(False).alias("text"), made.alias("report"), "cleaned")


def _run(spark: SparkSession, paths: list[str], settings: dict, write: bool, folder: str) -> tuple[list[tuple[int, str, str]], DataFrame | None]:
    """What is never read, and ord, path, failed, text, report, refused of the rest, held in the folder (nothing if there is no rest).

    The executors read and clean; what is to be written is staged in the folder, and then (on a
    shared file system) written, so that a step that is repeated finds the file as it was when it
    was read.
    """
    rows = list(files.entries(paths, settings))
    known = list(_known(rows, files.most_bytes(settings)))
    seen, parts = {k for k, _, _ in known}, []
    for text in (True, False):
        some = [(path, k, suffix) for k, kind, path, suffix, _ in rows if k not in seen and (kind == "text") == text]
        if some:
            parts.append(f"{folder}/{'text' if text else 'binary'}")
            _done(spark, some, text, settings, write).write.parquet(parts[-1])
    if not parts:
        return known, None
    done = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in parts])
    if not write:
        return known, done.select("ord", "path", "failed", "text", "report", F.lit(None).cast("string").alias("refused"))
    told = done.select("path", "cleaned", "ord", F.col("failed").alias("unread"), "text", "report")
    sink.write_in_place(told, settings["backup"], ("ord", "unread", "text", "report")).write.parquet(f"{folder}/written")
    return known, spark.read.parquet(f"{folder}/written").select("ord", "path", F.col("unread").alias("failed"), "text", "report", F.col("failed").alias("refused"))


def reports(spark: SparkSession, paths: list[str], settings: dict, write: bool) -> Iterator[dict]:
    """A report for each path, in the order missing, unreadable, text, image, document, one after the other.

    The driver holds the list of files and one partition of reports at a time.
    """
    folder = _folder(spark)
    try:
        known, done = _run(spark, paths, settings, write, folder)
        waiting = iter(known)
        at = next(waiting, None)
        for r in done.orderBy("ord").toLocalIterator() if done is not None else ():
            while at is not None and at[0] < r.ord:
                yield skipped(*at[1:])
                at = next(waiting, None)
            yield _report(r, r.refused)
        while at is not None:
            yield skipped(*at[1:])
            at = next(waiting, None)
    finally:
        _remove(spark, folder)


def outcomes(spark: SparkSession, paths: list[str], settings: dict, write: bool) -> DataFrame:
    """path, changed and message (why a file was skipped or refused, else empty) of each report, as a table: no report comes to the driver."""
    folder = _folder(spark)
    atexit.register(_remove_at_exit, spark, folder)
    known, done = _run(spark, paths, settings, write, folder)
    out = files.as_table(spark, [(path, message) for _, path, message in known], "path string, message string").select("path", F.lit(False).alias("changed"), "message")
    if done is None:
        return out
    # As _report() has it: the first finding about reading or writing.
    told = F.get(F.transform(F.filter("report.findings", lambda f: f["layer"] == "io"), lambda f: f["message"]), F.lit(0))
    said = F.coalesce("failed", F.when(F.col("report").isNull(), F.lit("skipped (not utf-8 text)")), F.when(F.col("refused").isNotNull() & ~F.col("text"), F.col("refused")), told, "refused", F.lit(""))
    read = F.col("failed").isNull() & F.col("report").isNotNull()
    return out.unionByName(done.select("path", (read & F.col("report.changed") & F.col("refused").isNull()).alias("changed"), said.alias("message")))


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # a session that has ended leaves the folder to whoever owns the shared one
        return


def _report(r, refused: str | None) -> dict:
    if r.failed:
        return skipped(r.path, r.failed)
    if r.report is None:
        return skipped(r.path, "skipped (not utf-8 text)")
    mine = _plain(r.report)
    found = mine["findings"]
    if refused:
        mine["changed"] = False
        found = [*(found if r.text else []), binary.finding("write" if "refused" in refused else "read", "warn", refused, layer="io")]
    return mine | {"findings": found, "counts": report("", "", found)["counts"], "path": r.path}


def scan(spark: SparkSession, paths: list[str], settings: dict, write: bool) -> list[dict]:
    """All reports at once."""
    return list(reports(spark, paths, settings, write))


def clean_bytes(raw: bytes, settings: dict, path: str = "<stdin>") -> tuple[dict, bytes]:
    """One document from a pipe; bytes that aren't text come back as they are."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return skipped(path, "skipped (not utf-8 text)"), raw
    after, findings = layers.clean_text(text, settings)
    return report(text, after, findings) | {"path": path}, after.encode("utf-8")


def rendered(r: dict, write: bool = True) -> str:
    if not r["findings"]:
        return f"clean  {r['path']}"
    word = lambda s: "would fix" if s == "fixed" and not write else s
    head = ", ".join(f"{r['counts'][s]} {word(s)}" for s in ("error", "warn", "fixed") if r["counts"][s])
    lines = [f"{r['path']}  ({head})"]
    for f in sorted(r["findings"], key=lambda f: -GRADE[f["severity"]]):
        tag = "would fix" if f["severity"] == "fixed" and not write else TAGS[f["severity"]]
        lines.append(f"  [{tag}] {f['message']} x{f['count']}" + (f"  ({', '.join(f['examples'])})" if f["examples"] else ""))
    return "\n".join(lines)


def summarised(reports: list[dict], write: bool = True) -> str:
    total = {s: sum(r["counts"][s] for r in reports) for s in ("fixed", "warn", "error")}
    changed = sum(r["changed"] for r in reports)
    names = ("changed", "fixed") if write else ("would change", "would fix")
    return f"{len(reports)} files scanned  |  {changed} {names[0]}  |  {total['fixed']} {names[1]}  |  {total['warn']} warnings  |  {total['error']} blocking"


def as_json(reports: list[dict], write: bool) -> str:
    order = ("path", "changed", "original_length", "cleaned_length", "counts", "findings")
    whole = dict(mode=("check", "fix")[write], summary=summarised(reports, write), reports=[{k: r[k] for k in order} for r in reports])
    return json.dumps(whole, indent=2, ensure_ascii=False)


def exit_code(reports: list[dict], strict: bool, write: bool) -> int:
    blocked = any(f["severity"] == "error" for r in reports for f in r["findings"])
    return int(blocked and (strict or not write) or strict and not write and any(r["changed"] for r in reports))
