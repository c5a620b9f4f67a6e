"""Writing results: tables, reports, and files in place."""

from __future__ import annotations

import os
import shutil
import stat
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import is_uri, opened


class Refused(OSError):
    """A link that would have been written through."""


def replace_file(path: str, content: bytes, backup: bool = True) -> None:
    """New content under the same name and mode, all or nothing; the first content ever stays as name.ext.bak.

    Below a URI a file has no mode to keep, and the new one is moved over the old as its file system does that.
    """
    if is_uri(path):
        return _replace_uri(path, content, backup)
    target = Path(path)
    if target.is_symlink():
        raise Refused(f"refusing to write through symlink: {target}")
    if backup:
        old = target.with_name(target.name + ".bak")
        if not old.exists():
            shutil.copyfile(target, old)
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", suffix=".new", dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
        if target.exists():
            os.chmod(name, stat.S_IMODE(target.stat().st_mode))
        os.replace(name, target)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def _replace_uri(path: str, content: bytes, backup: bool) -> None:
    system, at = opened(path)
    folder, _, name = at.rpartition("/")
    if backup and not system.get_file_info(f"{at}.bak").is_file:
        system.copy_file(at, f"{at}.bak")
    made = f"{folder}/.{name}.{uuid.uuid4().hex}.new"
    try:
        with system.open_output_stream(made) as out:
            out.write(content)
        system.move(made, at)
    except BaseException:
        if system.get_file_info(made).is_file:
            system.delete_file(made)
        raise


def write_in_place(files: DataFrame, backup: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """files: path, cleaned (bytes or null). Writes where a file changes, from the executors; gives path, what failed (or null), and the columns to keep."""
    from ..shipping import pieces, ship

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches, 1):
            failed = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if content is not None:
                        replace_file(path, content, backup)
                    failed.append(None)
                except Refused:
                    failed.append("refused to write through symlink")
                except PermissionError:
                    failed.append("skipped (permission denied)")
                except OSError:
                    failed.append("skipped (i/o error)")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed, pa.string()), *batch.columns[2:]], ["path", "failed", *keep])

    ship(files.sparkSession)
    schema = ", ".join(["path string, failed string", *(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)])
    return files.select("path", F.col("cleaned").cast("binary"), *keep).mapInArrow(run, schema)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON object for each report."""
    reports.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
