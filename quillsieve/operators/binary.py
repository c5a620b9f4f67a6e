"""Images, drawings and office files as rows of bytes: what would go, and the bytes without it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images, office
from ..shipping import ship
from .clean import FINDING, FINDING_ARROW
from .native import PDF_NEEDLES, SVG

BLOCK = "struct<kind:string,label:string,bytes:bigint>"
SCHEMA = f"cleaned binary, stripped int, orientation int, blocks array<{BLOCK}>, findings array<{FINDING}>"
_blocks = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("bytes", pa.int64())]))

_WORDS = {
    "raster-check": "embedded metadata present (exif/xmp/icc/c2pa)",
    "raster-fix": "stripped metadata segments losslessly (pixels untouched)",
    "raster-odd": "could not parse image (file left untouched)",
    "unsupported": "lossless metadata stripping not supported for this format (file left untouched)",
    "turned": "kept exif orientation (tag 0x0112), nothing else",
    "svg-check": "embedded svg metadata/xmp/comments present",
    "svg-fix": "stripped svg metadata, xmp and comments",
    "office-check": "embedded author/application metadata present",
    "office-fix": "stripped author/application metadata (lossless, container-level)",
    "office-odd": "could not parse (file left untouched)",
    "pdf": "pdf metadata present (author/creator/producer/xmp), not stripped: lossless pdf rewriting is not supported, use exiftool or qpdf",
    "not-text": "skipped (not utf-8 text)",
}


def finding(kind: str, severity: str, message: str, count: int = 1, layer: str = "metadata") -> dict:
    return {"layer": layer, "kind": kind, "severity": severity, "message": message, "count": count, "examples": [], "by_rule": {}}


def _svg(content: bytes, mode: str) -> tuple[bytes, int, list[dict]]:
    try:
        text = str(content, "utf-8")
    except UnicodeDecodeError:
        return content, 0, [finding("read", "warn", _WORDS["not-text"], layer="io")]
    total = sum(len(re.findall(p, text)) for p in SVG)
    if not total:
        return content, 0, []
    for p in SVG:
        text = re.sub(p, "", text)
    return text.encode("utf-8"), total, [finding("svg-metadata", "fixed", _WORDS[f"svg-{mode}"], total)]


def strip(suffix: str, content: bytes, strip_icc: bool = False, write: bool = True) -> dict:
    """cleaned, stripped, orientation, blocks and findings of one file; cleaned is null where the file stays as it is."""
    mode, out = "fix" if write else "check", {"cleaned": None, "stripped": None, "orientation": None, "blocks": [], "findings": []}
    suffix = suffix.lower()
    if suffix in images.STRIPPERS:
        done = images.STRIPPERS[suffix](content, strip_icc)
        if done is None:
            out["findings"] = [finding("raster", "warn", _WORDS["raster-odd"])]
            return out
        out |= {"stripped": len(done.blocks), "orientation": done.orientation, "blocks": [{"kind": b.kind, "label": b.label, "bytes": len(b.data)} for b in done.blocks]}
        if done.blocks and done.content != content:
            out["cleaned"] = done.content
            out["findings"] = [finding("raster", "fixed", _WORDS[f"raster-{mode}"], len(done.blocks))]
            if done.orientation is not None:
                out["findings"].append(finding("orientation", "info", _WORDS["turned"]))
    elif suffix == ".svg":
        cleaned, n, out["findings"] = _svg(content, mode)
        out |= {"stripped": n, "cleaned": cleaned if n else None}
    elif suffix in office.RULES:
        done = office.strip(content, suffix)
        if done is None:
            out["findings"] = [finding("office", "warn", _WORDS["office-odd"])]
        elif done[1]:
            out |= {"cleaned": done[0], "findings": [finding("office", "fixed", _WORDS[f"office-{mode}"], done[1])]}
        out["stripped"] = done and done[1]
    elif suffix == ".pdf":
        hits = sum(content.count(n.encode()) for n in PDF_NEEDLES)
        words, n = ("office-odd", 1) if not content.startswith(b"%PDF") else ("pdf", hits) if hits else ("unsupported", 1)
        out["findings"] = [finding("pdf", "warn", _WORDS[words], n)]
    elif suffix in images.UNTOUCHED:
        out["findings"] = [finding("raster", "warn", _WORDS["unsupported"])]
    return out


def _strip(strip_icc: bool, write: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (suffix, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                # One row at a time: files can be large.
                done = strip(suffix or "", content or b"", strip_icc, write)
                done["findings"] = [f | {"by_rule": list(f["by_rule"].items())} for f in done["findings"]]
                made = [pa.array([done["cleaned"]], pa.binary()), pa.array([done["stripped"]], pa.int32()), pa.array([done["orientation"]], pa.int32()), pa.array([done["blocks"]], _blocks), pa.array([done["findings"]], pa.list_(FINDING_ARROW))]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[2:]), *made], [*batch.schema.names[2:], "cleaned", "stripped", "orientation", "blocks", "findings"])

    return run


def stripped(files: DataFrame, *keys: str, suffix_col: str = "suffix", content_col: str = "content", strip_icc: bool = False, write: bool = True) -> DataFrame:
    """A row for each file: the keys, cleaned, stripped, orientation, blocks, findings."""
    ship(files.sparkSession)
    schema = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + [SCHEMA])
    rows = files.select(F.col(suffix_col).alias("strip_suffix__"), F.col(content_col).alias("strip_content__"), *keys)
    return rows.mapInArrow(_strip(strip_icc, write), schema)
