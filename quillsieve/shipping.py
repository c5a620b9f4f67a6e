"""Brings this package to the executors' Python workers, and rows in pieces that a worker can hold."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of texts or contents that a worker has as Python objects at once, but for a single row of more.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most so many bytes of a column (or one row): batches grow with the table, slices don't."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)).cast(pa.int64()), 0)).to_numpy()
        start, before = 0, 0
        while start < len(ends):
            end = max(start + 1, int(ends.searchsorted(before + most, "right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])


_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: sends the package along, so workers can import it wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillsieve-")) / "quillsieve.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(here.parent))
    context.addPyFile(str(archive))  # Spark's own file server hands it out
    _done.add(context.applicationId)
