"""Files as tables: which there are, which are read, and their contents."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 256 << 20
LIMIT_VARIABLE = "QUILLSIEVE_MAX_FILE_BYTES"
KINDS = {"text": "text_extensions", "image": "image_extensions", "document": "document_extensions"}
ORDER = ("missing", "unreadable", "text", "image", "document")
_warned: list[str] = []


def most_bytes(settings: dict) -> int:
    """The settings' limit, else the environment's, else 256 MiB."""
    if settings.get("max_file_bytes"):
        return int(settings["max_file_bytes"])
    value = os.environ.get(LIMIT_VARIABLE, "")
    if value.isdigit() and int(value) > 0:
        return int(value)
    if value and not _warned:
        _warned.append(value)
        sys.stderr.write(f"warning: ignoring {LIMIT_VARIABLE}={value!r} (must be a positive integer)\n")
    return MOST_BYTES


def suffix_of(name: str) -> str:
    """As Path(name).suffix, of names that may be many."""
    name = name[name.rfind("/") + 1 :]
    at = name.rfind(".")
    return name[at:] if 0 < at < len(name) - 1 else ""


def kind_of(name: str, settings: dict) -> str | None:
    suffix = suffix_of(name).lower()
    return next((kind for kind, key in KINDS.items() if suffix in {e.lower() for e in settings[key]}), None)


def is_uri(path: str) -> bool:
    """Whether a path names a file system (hdfs://, s3://, file://, ...), which pyarrow then opens."""
    return re.match("[A-Za-z][A-Za-z0-9+.-]+://", path) is not None


def opened(uri: str):
    """The file system of a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _found(uri: str, exclude: set[str], unreadable: list[str], sizes: dict[str, int]):
    """As walk(), of a URI that names a file or a folder; None if there is neither."""
    from pyarrow import fs

    system, at = opened(uri)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return None
    base = uri.rstrip("/")
    if info.is_file:
        sizes[uri] = info.size
        return [uri]

    def below():
        stack = [at]
        while stack:
            folder = stack.pop()
            try:
                entries = sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda e: e.base_name)
            except OSError:
                unreadable.append(base + folder[len(at.rstrip("/")) :])
                continue
            folders = []
            for e in entries:
                if e.base_name in exclude:
                    continue
                if e.type == fs.FileType.Directory:
                    folders.append(e.path)
                elif e.is_file:
                    name = base + e.path[len(at.rstrip("/")) :]
                    sizes[name] = e.size
                    yield name
            stack += reversed(folders)

    return below()


def walk(folder: str, exclude: set[str], unreadable: list[str]):
    """Files below a folder, depth first and by name; excluded names are never entered, nor are links to folders."""
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        unreadable.append(str(folder))
        return
    for entry in entries:
        if entry.name in exclude:
            continue
        try:
            if entry.is_dir(follow_symlinks=False):
                yield from walk(entry.path, exclude, unreadable)
            elif entry.is_file():
                yield entry.path
        except OSError:
            unreadable.append(entry.path)


def listed(paths: list[str], settings: dict, sizes: dict[str, int] | None = None) -> list[tuple[str, str]]:
    """(kind, path) of all that is named, in the order of reports; one path for each real file and kind.

    sizes takes the lengths of files named by a URI. Below a URI the files of a folder come before
    those of its folders.
    """
    exclude, unreadable, sizes = set(settings["exclude"]), [], {} if sizes is None else sizes
    out: dict[str, list[str]] = {k: [] for k in ORDER}
    kinds, folders = {}, {}
    for given in paths:
        try:
            plain = given if is_uri(given) else str(Path(given))
            names = _found(given, exclude, unreadable, sizes) if is_uri(given) else [plain] if Path(given).is_file() else walk(given, exclude, unreadable) if Path(given).is_dir() else None
        except OSError:
            unreadable.append(given)
            continue
        if names is None:
            out["missing"].append(given)
            continue
        # Names below a folder are as Path has them when the folder is.
        cut = 0 if is_uri(given) or names == [plain] else len(given.rstrip("/")) + 1
        below = "" if plain == "." else plain.rstrip("/") + "/"
        for name in names:
            suffix = suffix_of(name)
            if suffix not in kinds:
                kinds[suffix] = kind_of(name, settings)
            if kind := kinds[suffix]:
                out[kind].append(below + name[cut:] if cut else name)
    out["unreadable"] = unreadable
    for kind in KINDS:
        out[kind] = list({p if is_uri(p) else _real(p, folders): p for p in reversed(out[kind])}.values())[::-1]
    return [(kind, p) for kind in ORDER for p in out[kind]]


def _real(path: str, folders: dict[str, str]) -> str:
    """As os.path.realpath(), with each folder followed once."""
    folder, name = os.path.split(path)
    if not name or name in (".", "..") or os.path.islink(path):
        return os.path.realpath(path)
    if folder not in folders:
        folders[folder] = os.path.realpath(folder)
    return os.path.join(folders[folder], name)


def entries(paths: list[str], settings: dict) -> Iterator[tuple[int, str, str, str, int | None]]:
    """ord, kind, path, suffix, length of the files named; length is null where there is none."""
    sizes: dict[str, int] = {}
    for k, (kind, p) in enumerate(listed(paths, settings, sizes)):
        try:
            size = (sizes[p] if p in sizes else os.stat(p).st_size) if kind in KINDS else None
        except OSError:
            size = None
        yield k, kind, p, suffix_of(p).lower(), size


def as_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, sent in columns: a list may be of millions of files."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    named = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(named)
    return spark.createDataFrame(pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, named, strict=True)], [name for name, _ in named]))


def listing(spark: SparkSession, paths: list[str], settings: dict) -> DataFrame:
    """The entries as a table."""
    return as_table(spark, list(entries(paths, settings)), "ord long, kind string, path string, suffix string, length long")


def bytes_of(path: str) -> bytes:
    if is_uri(path):
        system, at = opened(path)
        with system.open_input_stream(at) as file:
            return file.read()
    with open(path, "rb") as file:
        return file.read()


def _read(batches):
    import pyarrow as pa

    from ..shipping import PIECE

    for batch in batches:
        paths, start, size, content, failed = batch.column(0).to_pylist(), 0, 0, [], []
        for k, path in enumerate(paths):
            try:
                content.append(bytes_of(path))
                failed.append(None)
            except OSError as error:
                content.append(None)
                failed.append("skipped (permission denied)" if isinstance(error, PermissionError) else "skipped (i/o error)")
            size += len(content[-1] or b"")
            if size >= PIECE or k + 1 == len(paths):  # a large file goes on at once, small ones together
                yield pa.RecordBatch.from_arrays([*(c.slice(start, k + 1 - start) for c in batch.columns), pa.array(content, pa.binary()), pa.array(failed, pa.string())], [*batch.schema.names, "content", "failed"])
                start, size, content, failed = k + 1, 0, [], []


def contents(listed: DataFrame) -> DataFrame:
    """listed (path first) with content, or with what failed; the executors read, from a file system they share or one named by a URI.

    Spark's own binary source leaves out names that begin with a dot or an underscore.
    """
    from ..shipping import ship

    ship(listed.sparkSession)
    schema = ", ".join(f"`{c}` {listed.schema[c].dataType.simpleString()}" for c in listed.columns)
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks).mapInArrow(_read, f"{schema}, content binary, failed string")


def first_of_each(files: DataFrame, real: str = "realpath", order: str = "ord") -> DataFrame:
    """The first row of each real path, in the order given; the null path is a path.

    Only digests and the order are shuffled, and those with map-side combining, so that a path
    of many rows is no task's burden; the rows that stay are found by joining back on both.
    """
    from pyspark.sql import Window

    names = iter(("first_key__", "first_of__", "first_place__"))
    key, of, place = (next(n for n in (name + "_" * k for k in range(9)) if n not in files.columns) for name in names)
    rows = files.withColumn(key, F.sha2(F.coalesce(F.concat(F.lit("="), F.col(real).cast("string")), F.lit("")), 256))
    least = rows.groupBy(key).agg(F.min(F.struct(F.col(order).isNull(), F.col(order))).alias(of))
    kept = rows.join(least, key).where(F.struct(F.col(order).isNull(), F.col(order)).eqNullSafe(F.col(of)))
    # Rows of one path and one place: any one of them.
    return kept.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.col(order)))).where(F.col(place) == 1).select(files.columns)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in two partitions for each core if it is read in fewer than there are cores, as one small file is; a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def text_of(content):
    """Bytes as text; null where they aren't UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def table_texts(spark: SparkSession, path: str, text_col: str = "text", format: str = "parquet") -> DataFrame:
    """Any table with a text column."""
    return spark.read.format(format).load(path).withColumn("text", F.col(text_col).cast("string"))
