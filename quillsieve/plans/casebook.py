"""Queries over files and settings made from table rows: each row's content differs, and results are compared byte for byte.

Contents are put together by expressions that Spark and DuckDB both have, from pieces in hex.
Archives and folders are made by Python on both ways in, and what comes out is compared part by part.
"""

from __future__ import annotations

import atexit
import io
import json
import os
import re
import shutil
import struct
import subprocess
import tempfile
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import settings as options, translate
from ..operators import binary, findings, hits
from ..operators.clean import clean, normalized
from ..shipping import PIECE, pieces, ship
from ..sources import files, runs, staged
from ..streaming import live
from .catalog import ARTIFACT_SQL, BIDI, GONE, HITS_SQL, MODULUS, RULES, query, quoted, seeded, source, table

KEY = "lpad(CAST(doc_id AS {string}), 12, '0')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _spark_bytes(*parts: str | bytes | Column) -> Column:
    """Bytes given as they are, and KEY for the row's number in twelve digits."""
    made = [F.unhex(F.lit(p.hex())) if isinstance(p, bytes) else F.encode(F.lpad(F.col("doc_id").cast("string"), 12, "0"), "UTF-8") if isinstance(p, str) else p for p in parts]
    return F.concat(*made)


def _sql_bytes(*parts: str | bytes) -> str:
    """The same, and other strings as SQL of a blob."""
    key = KEY.format(string="VARCHAR")
    return " || ".join(f"unhex('{p.hex()}')" if isinstance(p, bytes) else f"encode({key})" if p == KEY else p for p in parts)


# --- pictures -----------------------------------------------------------------------------------


def _tiff(value: int) -> bytes:
    """Little-endian, as a camera may write it."""
    return struct.pack("<2sHIHHHIHHI", b"II", 42, 8, 1, 274, 3, 1, value, 0, 0)


def _upright(value: int) -> bytes:
    """The only field that is written back, spelled out."""
    return bytes.fromhex(f"4d4d002a000000080001011200030000000100{value:02x}000000000000")


def _by_turn(of) -> Column:
    """of(v) for the orientation v of a row, 1 to 8."""
    out = F.when(F.col("doc_id") % 8 == 0, F.unhex(F.lit(of(1).hex())))
    for k in range(1, 8):
        out = out.when(F.col("doc_id") % 8 == k, F.unhex(F.lit(of(k + 1).hex())))
    return out


def _sql_by_turn(of) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN unhex('{of(k + 1).hex()}')" for k in range(8)) + " END"


def _part(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _stripped(rows: DataFrame, suffix: str, content: Column, **how) -> DataFrame:
    made = rows.select("doc_id", F.lit(suffix).alias("suffix"), content.alias("content"))
    done = binary.stripped(made, "doc_id", **how)
    return done.select("doc_id", "stripped", "orientation", F.sha2("cleaned", 256).alias("sha256"), F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"), F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["severity"], f["count"].cast("string"))), ",").alias("found"))


def _picture_sql(stripped: int, content: str, kinds: str) -> str:
    turned = "CASE WHEN doc_id % 8 > 0 THEN CAST(doc_id % 8 + 1 AS INTEGER) END"
    return f"""SELECT doc_id, CAST({stripped} AS INTEGER) AS stripped, {turned} AS orientation, sha256({content}) AS sha256, '{kinds}' AS kinds,
        'raster:fixed:{stripped}' || CASE WHEN doc_id % 8 > 0 THEN ',orientation:info:1' ELSE '' END AS found FROM documents"""


_WEBP_HEAD = _part(b"VP8X", bytes([12]) + bytes(9))
_WEBP_PIXELS = b"VP8 " + struct.pack("<I", 12)
_WEBP_IN = 4 + 18 + 8 + 12 + 8 + 26 + 8 + 4
_WEBP_OUT = {turned: b"RIFF" + struct.pack("<I", 4 + 18 + 8 + 12 + 34 * turned) + b"WEBP" + _part(b"VP8X", bytes([8 * turned]) + bytes(9)) + _WEBP_PIXELS for turned in (0, 1)}


def _webp_end(value: int) -> bytes:
    return _part(b"EXIF", _upright(value)) if value > 1 else b""


@query("webp_strip", _picture_sql(2, f"CASE WHEN doc_id % 8 = 0 THEN {_sql_bytes(_WEBP_OUT[0], KEY)} ELSE {_sql_bytes(_WEBP_OUT[1], KEY, _sql_by_turn(_webp_end))} END", "exif,xmp"))
def webp_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = b"RIFF" + struct.pack("<I", _WEBP_IN) + b"WEBP" + _WEBP_HEAD + _WEBP_PIXELS
    return _stripped(_documents(spark, sf_dir), ".webp", _spark_bytes(head, KEY, _by_turn(lambda v: _part(b"EXIF", _tiff(v))), _part(b"XMP ", b"<x/>")))


_JFIF, _SCAN = b"\xff\xe0\x00\x07JFIF\0", b"\xff\xda\x00\x02pixels"


def _jpeg_turn(value: int) -> bytes:
    return b"\xff\xe1\x00\x22Exif\0\0" + _upright(value) if value > 1 else b""


@query("jpeg_orientation", _picture_sql(3, _sql_bytes(b"\xff\xd8" + _JFIF, _sql_by_turn(_jpeg_turn), _SCAN, KEY, b"\xff\xd9"), "exif,comment,iptc"))
def jpeg_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    exif = _by_turn(lambda v: b"\xff\xe1\x00\x22Exif\0\0" + _tiff(v))
    content = _spark_bytes(b"\xff\xd8" + _JFIF, exif, b"\xff\xfe\x00\x0e", KEY, b"\xff\xed\x00\x06iptc", _SCAN, KEY, b"\xff\xd9")
    return _stripped(_documents(spark, sf_dir), ".jpg", content)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


_PNG_HEAD = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", bytes(13))


def _png_turn(value: int) -> bytes:
    return _chunk(b"eXIf", _upright(value)) if value > 1 else b""


@query("png_orientation", _picture_sql(3, _sql_bytes(_PNG_HEAD, _sql_by_turn(_png_turn), b"\0\0\0\x0cIDAT", KEY, b"\0\0\0\0" + _chunk(b"IEND", b"") + b"tail"), "text,exif,timestamp"))
def png_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _spark_bytes(_PNG_HEAD + b"\0\0\0\x0ctEXt", KEY, b"\0\0\0\0", _by_turn(lambda v: _chunk(b"eXIf", _tiff(v))), _chunk(b"tIME", bytes(7)) + b"\0\0\0\x0cIDAT", KEY, b"\0\0\0\0" + _chunk(b"IEND", b"") + b"tail")
    return _stripped(_documents(spark, sf_dir), ".png", content)


@query(
    "clean_pictures",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN CAST(0 AS INTEGER) END AS stripped, CAST(NULL AS INTEGER) AS orientation, CAST(NULL AS VARCHAR) AS sha256, '' AS kinds,
        CASE doc_id % 4 WHEN 2 THEN 'raster:warn:1' WHEN 3 THEN 'raster:warn:1' ELSE '' END AS found FROM documents""",
)
def clean_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures without metadata, broken ones, and kinds that are never changed: no new bytes for any of them."""
    case = F.col("doc_id") % 4
    suffix = F.when(case == 0, ".png").when(case == 1, ".jpeg").when(case == 2, ".webp").otherwise(".gif")
    content = F.when(case == 0, _spark_bytes(_PNG_HEAD + b"\0\0\0\x0cIDAT", KEY, b"\0\0\0\0" + _chunk(b"IEND", b""))).when(case == 1, _spark_bytes(b"\xff\xd8" + _SCAN, KEY)).when(case == 2, _spark_bytes(b"RIFFxxxxWEBPVP8 ", KEY)).otherwise(_spark_bytes(b"GIF89a", KEY))
    rows = _documents(spark, sf_dir).select("doc_id", suffix.alias("suffix"), content.alias("content"))
    done = binary.stripped(rows, "doc_id")
    return done.select("doc_id", "stripped", "orientation", F.sha2("cleaned", 256).alias("sha256"), F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"), F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["severity"], f["count"].cast("string"))), ",").alias("found"))


_KEY_SQL = KEY.format(string="VARCHAR")


@query("svg_strip", f"SELECT doc_id, CAST(4 AS INTEGER) AS stripped, '<svg><title>' || {_KEY_SQL} || '</title></svg>' AS cleaned, 'svg-metadata:fixed:4' AS found FROM documents")
def svg_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    markup = F.concat(F.lit('<svg><metadata id="a">\n'), key, F.lit("</metadata><!-- "), key, F.lit("\n --><title>"), key, F.lit("</title><x:xmpmeta>\n"), key, F.lit("</x:xmpmeta><!----></svg>"))
    rows = _documents(spark, sf_dir).select("doc_id", F.lit(".svg").alias("suffix"), F.encode(markup, "UTF-8").alias("content"))
    found = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["severity"], f["count"].cast("string"))), ",")
    return binary.stripped(rows, "doc_id").select("doc_id", "stripped", F.decode("cleaned", "UTF-8").alias("cleaned"), found.alias("found"))


# --- archives -----------------------------------------------------------------------------------


def _archive(key: str, case: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/media/X.png", b"\0" + key.encode(), zipfile.ZIP_STORED)
        z.writestr("docProps/core.xml", f"<c><dc:title>{key}</dc:title><dc:creator>{key}</dc:creator><cp:lastModifiedBy/></c>")
        z.writestr("word/document.xml", f'<w:ins w:author="{key}" w:initials=""><w:t>{key}</w:t></w:ins>')
        z.writestr("word/media/ü.xml", f'<a w:author="{key}"/>')
    data = out.getvalue().replace(b"word/media/X.png", b"word/media/\x82.png")  # a name of the old code page
    return data[: len(data) // 2] if case == 6 else data


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([".docx"] * len(ids)), pa.array([_archive(f"{i:012d}", i % 7) for i in ids], pa.binary())], ["doc_id", "suffix", "content"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        rows = []
        for i, content, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if content is None:
                rows.append((i, -1, "", found, False))
                continue
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                whole = z.testzip() is None
                rows += [(i, k, part.filename, z.read(part).hex(), whole) for k, part in enumerate(z.infolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()))], ["doc_id", "place", "part", "content", "whole"])


def _hex_sql(text: str) -> str:
    return "lower(hex(encode(" + " || ".join(_KEY_SQL if p == "KEY" else quoted(p) for p in re.split("(KEY)", text) if p) + ")))"


@query(
    "office_parts",
    f"""WITH p AS (SELECT * FROM (VALUES (0, 'word/media/é.png'), (1, 'docProps/core.xml'), (2, 'word/document.xml'), (3, 'word/media/ü.xml')) AS v(place, part))
        SELECT doc_id, CAST(place AS INTEGER) AS place, part, CASE place WHEN 0 THEN '00' || {_hex_sql("KEY")} WHEN 1 THEN {_hex_sql("<c><dc:title>KEY</dc:title></c>")}
            WHEN 2 THEN {_hex_sql('<w:ins w:author="" w:initials=""><w:t>KEY</w:t></w:ins>')} ELSE {_hex_sql('<a w:author="KEY"/>')} END AS content, true AS whole
        FROM documents, p WHERE doc_id % 7 <> 6
        UNION ALL SELECT doc_id, -1, '', 'office:warn', false FROM documents WHERE doc_id % 7 = 6""",
)
def office_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with a stored part, names of two code pages, and broken ones; every part of the result by its bytes."""
    ship(spark)
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_packed, "doc_id long, suffix string, content binary")
    done = binary.stripped(rows, "doc_id").select("doc_id", "cleaned", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["severity"])), ",").alias("found"))
    return done.mapInArrow(_unpacked, "doc_id long, place int, part string, content string, whole boolean")


# --- voice --------------------------------------------------------------------------------------

FILLERS = {
    0: ("We tested it, without further ado, and shipped. ", "We tested it, and shipped. "),
    1: ("We say without further ado that it works. ", "We say that it works. "),
    2: ("It ends without further ado. ", "It ends. "),
    3: ("They know (in summary, at least) it. ", "They know ( at least) it. "),
    4: ("Yes; it bears mentioning that no. ", "Yes; no. "),
}


@query("filler_mid", "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {quoted(b)} || text" for k, (_, b) in FILLERS.items()) + " ELSE text END AS cleaned FROM documents")
def filler_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for k, (before, _) in FILLERS.items():
        text = F.when(F.col("doc_id") % 8 == k, F.concat(F.lit(before), F.col("text"))).otherwise(text)
    rows = _documents(spark, sf_dir).withColumn("text", text)
    return clean(rows, settings={"layers": ["voice"]}).select("doc_id", "cleaned")


@query("hit_order", f'SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC) - 1 AS INTEGER) AS ord, kind, id FROM ({HITS_SQL})')
def hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.phrases(seeded(spark, sf_dir, "voice"), "doc_id").select("doc_id", "ord", "kind", "id")


@query(
    "removed_codepoints",
    f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS char, generate_subscripts(string_split(text, ''), 1) - 1 AS idx, regexp_matches(text, '[\\x{{0590}}-\\x{{08FF}}]') AS rtl FROM {source("invisible")})
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS nth, unicode(char) AS code FROM c WHERE regexp_matches(char, '{GONE}') OR NOT rtl AND regexp_matches(char, '{BIDI}')""",
)
def removed_codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = hits.characters(seeded(spark, sf_dir, "invisible"), "doc_id").where("action = 'remove'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "code"))).alias("all"))
    return gone.select("doc_id", F.posexplode("all").alias("nth", "x")).select("doc_id", (F.col("nth") + 1).cast("int").alias("nth"), "x.code")


@query(
    "ignored_phrases",
    f"""SELECT doc_id, CAST(CASE doc_id % {MODULUS} WHEN 4 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n_banned,
        CASE doc_id % {MODULUS} WHEN 4 THEN 'a plethora of,vital and pivotal' WHEN 1 THEN 'ship the robust' ELSE '' END AS examples FROM documents WHERE text IS NOT NULL""",
)
def ignored_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = {"layers": ["voice"], "ignore_phrases": ["Delve into", "at the end of the day"], "custom_banned_phrases": ["ship the robust", "vital and pivotal"]}
    done = clean(seeded(spark, sf_dir, "voice"), settings=how).where(F.col("report").isNotNull())
    banned = F.filter("report.findings", lambda f: f["kind"] == "banned-phrase")
    return done.select("doc_id", F.aggregate(banned, F.lit(0).cast("long"), lambda n, f: n + f["count"]).alias("n_banned"), F.array_join(F.flatten(F.transform(banned, lambda f: f["examples"])), ",").alias("examples"))


_SHAPES = "Not only fast, but also good. Not only fast, but also good. "


@query("shapes_a_segment", "SELECT doc_id, CAST(1 + doc_id % 3 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def shapes_a_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One count for each segment between code, however often a shape stands in it."""
    made = F.concat(F.repeat(F.lit(_SHAPES + "`x` "), (F.col("doc_id") % 3).cast("int")), F.lit(_SHAPES), F.col("text"))
    done = clean(_documents(spark, sf_dir).withColumn("text", made), settings={"layers": ["voice"]}).where(F.col("report").isNotNull())
    shapes = F.filter("report.findings", lambda f: f["kind"] == "sentence-shape")
    return done.select("doc_id", F.aggregate(shapes, F.lit(0).cast("long"), lambda n, f: n + f["count"]).alias("n"))


_MANY = [p for p in RULES.banned if re.fullmatch("[a-z ]+", p) and not any(o != p and (o in p or p in o) for o in RULES.banned + RULES.fillers)][:12]


@query("first_examples", f"SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN {len(_MANY)} ELSE 3 END AS BIGINT) AS count, CASE WHEN doc_id % 2 = 0 THEN {quoted(','.join(_MANY[:8]))} ELSE {quoted(','.join(_MANY[-3:]))} END AS examples FROM documents WHERE text IS NOT NULL")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More phrases than a finding shows: the first eight of the rules' order, and merged over two halves of a text likewise."""
    both = [F.lit(". ".join(reversed(some)) + ". ") for some in (_MANY, _MANY[-3:])]
    rows = _documents(spark, sf_dir).withColumn("text", F.concat(F.when(F.col("doc_id") % 2 == 0, both[0]).otherwise(both[1]), F.col("text")))
    found = findings.merged(findings.exploded(clean(rows, settings={"layers": ["voice"]}), "doc_id").where("kind = 'banned-phrase'"), "doc_id")
    return found.select("doc_id", "count", F.array_join("examples", ",").alias("examples"))


# --- normal forms -------------------------------------------------------------------------------

_LETTERS = [chr(c) for c in range(0xA0, 0x250)] + list("ﬁ①²…")
_MARKED = "éåÅﬁ① ½…é "


def _form_sql(form: str) -> str:
    """nfc_normalize, or every letter of the Latin blocks by its form; texts are composed first, so none waits for a mark."""
    out = "nfc_normalize(text)"
    if form == "NFC":
        return out
    for c in _LETTERS:
        made = unicodedata.normalize(form, c)
        if made != c:
            out = f"replace({out}, {quoted(c)}, {quoted(made)})"
    return out


@query("normal_forms", " UNION ALL ".join(f"SELECT doc_id, '{form}' AS form, sha256({_form_sql(form)}) AS sha256 FROM (SELECT doc_id, {quoted(_MARKED)} || text AS text FROM documents)" for form in ("NFC", "NFD", "NFKC", "NFKD")))
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("text", F.concat(F.lit(_MARKED), F.col("text")))
    made = [normalized(rows, "text", form).select("doc_id", F.lit(form).alias("form"), F.sha2("text", 256).alias("sha256")) for form in ("NFC", "NFD", "NFKC", "NFKD")]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


# --- pipes, services, settings, rules -----------------------------------------------------------


def _piped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    how = options.checked({"layers": ["artifacts"]})
    for batch in pieces(batches, 1):
        out = [runs.clean_bytes(raw, how) for raw in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for _, c in out], pa.binary()), pa.array([r["changed"] for r, _ in out]), pa.array([r["findings"][0]["message"] if r["findings"] and r["findings"][0]["layer"] == "io" else "" for r, _ in out])], ["doc_id", "out", "changed", "message"])


@query(
    "pipe",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(encode(text) || unhex('ff')) ELSE sha256({ARTIFACT_SQL}) END AS sha256, doc_id % 5 <> 0 AND {ARTIFACT_SQL} <> text AS changed,
        CASE WHEN doc_id % 5 = 0 THEN 'skipped (not utf-8 text)' ELSE '' END AS message FROM {source("artifacts")} WHERE text IS NOT NULL""",
)
def pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in, bytes out: what isn't text comes back as it is."""
    ship(spark)
    raw = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    rows = seeded(spark, sf_dir, "artifacts").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    return rows.mapInArrow(_piped, "doc_id long, out binary, changed boolean, message string").select("doc_id", F.sha2("out", 256).alias("sha256"), "changed", "message")


def _told(text: str, target: str, source: str | None) -> tuple[str, str | None]:
    """A service that says where a text went, and takes every text to be German."""
    return f"{text}>{target}", "DE"


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        out = []
        for k, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            try:
                out.append(translate.back_and_forth(text, _told, None if k % 2 else "FR", "DE" if k % 4 == 3 else "EN"))
            except translate.TranslationError as error:
                out.append(f"! {error}")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "made"])


@query(
    "back_translation",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '! text is already in the pivot language (DE), pass a different --pivot-lang'
        ELSE text || '>EN>' || CASE WHEN doc_id % 2 = 1 THEN 'DE' ELSE 'FR' END END AS made FROM documents WHERE text IS NOT NULL""",
)
def back_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _documents(spark, sf_dir).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_rewritten, "doc_id long, made string")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, name in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            with tempfile.TemporaryDirectory() as folder:
                below = os.path.join(folder, "a", "b")
                os.makedirs(below)
                given = {"voice": k % 2 == 0, "max_file_bytes": k + 1, "exclude": [name]} if k % 5 else {"voice": "yes"}
                with open(os.path.join(folder, options.FILE_NAMES[k % 3]), "w", encoding="utf-8") as out:
                    json.dump(given, out)
                try:
                    how = options.load(None, below)
                    rows.append((k, how["voice"], how["max_file_bytes"], ",".join(how["exclude"]), how["backup"], ""))
                except options.SettingsError as error:
                    rows.append((k, None, None, None, None, str(error).rpartition(": ")[2]))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["n_nationkey", "voice", "most", "exclude", "backup", "error"])


@query(
    "settings_overlay",
    """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 2 = 0 END AS voice, CASE WHEN n_nationkey % 5 > 0 THEN CAST(n_nationkey + 1 AS BIGINT) END AS most,
        CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS exclude, CASE WHEN n_nationkey % 5 > 0 THEN true END AS backup, CASE WHEN n_nationkey % 5 > 0 THEN '' ELSE '"voice" must be true or false' END AS error FROM nation""",
)
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file for each nation, found upwards from a folder two levels below and laid over the defaults."""
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return rows.mapInArrow(_settled, "n_nationkey long, voice boolean, most long, exclude string, backup boolean, error string")


_RULE_SIZES = {"banned": 110, "fillers": 7, "shapes": 16, "quotes": len(RULES.quotes), "lookalikes": len(RULES.lookalikes), "messages": 17}


@query("rule_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in _RULE_SIZES.items()) + ") AS v(name, n)")
def rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, len(getattr(RULES, k))) for k in _RULE_SIZES]
    return spark.createDataFrame(rows, "name string, n int")


# --- folders ------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A folder that executors share, as a path: below spark.checkpoint.dir, which has to be a mounted path for these queries; a session on one machine makes its own."""
    shared = re.sub("^file:/+", "/", spark.conf.get("spark.checkpoint.dir", None) or "")
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
    elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("these queries write files: set spark.checkpoint.dir to a path that all executors share")
    path = tempfile.mkdtemp(prefix=f"quillsieve-{name}-", dir=shared if shared.startswith("/") else None)
    atexit.register(shutil.rmtree, path, True)
    return path


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write(content)
                os.chmod(path, 0o640)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    return run


def _filled(spark: SparkSession, name: str, rows: DataFrame) -> str:
    """A folder with a file for each row (name, content)."""
    ship(spark)
    folder = _folder(spark, name)
    rows.mapInArrow(_put(folder), "n long").agg(F.sum("n")).collect()
    return folder


_NAME_SQL = f"""CASE doc_id % 5 WHEN 0 THEN 'a/' || {_KEY_SQL} || '.MD' WHEN 1 THEN 'b/c/' || {_KEY_SQL} || '.png' WHEN 2 THEN 'b/node_modules/' || {_KEY_SQL} || '.md'
    WHEN 3 THEN 'b/' || {_KEY_SQL} || '.bin' ELSE '.z/' || {_KEY_SQL} || '.docx' END"""


@query(
    "files_listing",
    f"""WITH f AS (SELECT {_NAME_SQL} AS path, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'document' END AS kind, coalesce(octet_length(encode(text)), 0) AS length FROM documents WHERE doc_id % 5 IN (0, 1, 4))
        SELECT CAST(1 + row_number() OVER (ORDER BY CASE kind WHEN 'text' THEN 0 WHEN 'image' THEN 1 ELSE 2 END, path) - 1 AS BIGINT) AS ord, kind, path, CAST(length AS BIGINT) AS length FROM f
        UNION ALL SELECT 0, 'missing', 'none', NULL""",
)
def files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a file for each document, listed: kinds by suffix, excluded folders left out, by name within a kind."""
    name = F.expr(_NAME_SQL.replace("VARCHAR", "STRING"))
    folder = _filled(spark, "listing", _documents(spark, sf_dir).select(name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")))
    found = files.listing(spark, [os.path.join(folder, "none"), folder, os.path.join(folder, "a")], options.defaults())
    return found.select("ord", "kind", F.substring("path", len(folder) + 2, 1 << 20).alias("path"), "length")


def _got(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each path (the first column): the file's bytes and mode, those of its backup, and whether its folder holds no name with a dot in front."""
    tidy: dict[str, bool] = {}
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.bool_())
    for batch in batches:
        paths, rows, start, size = batch.column(0).to_pylist(), [], 0, 0
        for k, path in enumerate(paths):
            parts = []
            for name in (path, path + ".bak"):
                try:
                    with open(name, "rb") as file:
                        parts.append(file.read())
                except OSError:
                    parts.append(None)
            folder = os.path.dirname(path)
            if folder not in tidy:  # a folder is looked through once, not for each of its files
                with os.scandir(folder) as found:
                    tidy[folder] = not any(e.name.startswith(".") for e in found)
            rows.append((*parts, os.stat(path).st_mode & 0o777, tidy[folder]))
            size += sum(len(x or b"") for x in parts)
            if size >= PIECE or k + 1 == len(paths):
                made = (pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, k + 1 - start) for c in batch.columns), *made], [*batch.schema.names, "now", "before", "mode", "tidy"])
                rows, start, size = [], k + 1, 0


@query(
    "files_fixed",
    f"""WITH f AS (SELECT doc_id, text, {ARTIFACT_SQL} AS cleaned, doc_id % 9 = 0 AS odd, octet_length(encode(text)) > 6000 AND doc_id % 9 > 0 AS large FROM {source("artifacts")} WHERE text IS NOT NULL),
        g AS (SELECT *, NOT odd AND NOT large AND cleaned <> text AS changed FROM f)
        SELECT {_KEY_SQL} || '.txt' AS name, changed, CASE WHEN odd THEN sha256(unhex('fffe')) WHEN changed THEN sha256(cleaned) ELSE sha256(text) END AS now, CASE WHEN changed THEN sha256(text) END AS before,
               CAST(416 AS INTEGER) AS mode, true AS tidy, CASE WHEN odd THEN 'skipped (not utf-8 text)' WHEN large THEN 'skipped (larger than max_file_bytes)' ELSE '' END AS message FROM g""",
)
def files_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, fixed in place: new bytes, the old ones beside them, modes kept, no other file left; what is skipped and why."""
    rows = seeded(spark, sf_dir, "artifacts").where(F.col("text").isNotNull())
    odd = F.col("doc_id") % 9 == 0
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    folder = _filled(spark, "fixed", rows.select(name.alias("name"), F.when(odd, F.unhex(F.lit("FFFE"))).otherwise(F.encode("text", "UTF-8")).alias("content")))
    how = options.checked({"layers": ["artifacts"], "max_file_bytes": 6000})
    done = runs.outcomes(spark, [folder], how, True).mapInArrow(_got, "path string, changed boolean, message string, now binary, before binary, mode int, tidy boolean")
    return done.select(F.substring("path", len(folder) + 2, 100).alias("name"), "changed", F.sha2("now", 256).alias("now"), F.sha2("before", 256).alias("before"), "mode", "tidy", "message")


@query(
    "json_reports",
    f"""SELECT doc_id, CAST(CASE doc_id % {MODULUS} WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS n_findings,
        CAST(CASE doc_id % {MODULUS} WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS error,
        '1 files scanned  |  ' || CASE WHEN doc_id % {MODULUS} < 2 THEN '1' ELSE '0' END || ' would change  |  ' || CASE WHEN doc_id % {MODULUS} < 2 THEN '1' ELSE '0' END || ' would fix  |  '
            || CASE doc_id % {MODULUS} WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END || ' warnings  |  '
            || CASE doc_id % {MODULUS} WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END || ' blocking' AS summary,
        'path,changed,original_length,cleaned_length,counts,findings' AS keys FROM documents WHERE text IS NOT NULL""",
)
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of a check of each document, read back."""
    ship(spark)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = options.checked({"layers": ["voice"]})
        for batch in pieces(batches, 1):
            rows = []
            for k, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                whole = json.loads(runs.as_json([runs.clean_bytes(text.encode(), how)[0]], False))
                (one,) = whole["reports"]
                rows.append((k, len(one["findings"]), one["counts"]["error"], whole["summary"], ",".join(one)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "n_findings", "error", "summary", "keys"])

    rows = seeded(spark, sf_dir, "voice").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(told, "doc_id long, n_findings int, error long, summary string, keys string")


@query("links_refused", f"SELECT {_KEY_SQL} || '.svg' AS name, doc_id % 2 = 0 AS written, CASE WHEN doc_id % 2 = 0 THEN '<svg></svg>' ELSE '<svg><!-- ' || doc_id || ' --></svg>' END AS content FROM documents")
def links_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings behind links are never written through: even rows are files, odd rows links to files elsewhere."""
    rows = _documents(spark, sf_dir)
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".svg"))
    folder = _filled(spark, "links", rows.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "in/").otherwise("out/"), name).alias("name"), F.encode(F.concat(F.lit("<svg><!-- "), F.col("doc_id").cast("string"), F.lit(" --></svg>")), "UTF-8").alias("content")))
    os.makedirs(f"{folder}/in", exist_ok=True)
    if os.path.isdir(f"{folder}/out"):
        for entry in os.scandir(f"{folder}/out"):
            os.symlink(entry.path, f"{folder}/in/{entry.name}")
    done = runs.outcomes(spark, [f"{folder}/in"], options.defaults(), True).mapInArrow(_got, "path string, changed boolean, message string, now binary, before binary, mode int, tidy boolean")
    return done.select(F.substring_index("path", "/", -1).alias("name"), F.col("changed").alias("written"), F.decode("now", "UTF-8").alias("content"))


@query(
    "staged_files",
    """SELECT n_name || CASE n_nationkey % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.bin' ELSE '.png' END AS name,
        CASE WHEN n_nationkey % 3 = 1 OR n_nationkey % 4 = 3 THEN '' WHEN n_nationkey % 5 = 2 THEN 'partial' ELSE 'whole' END AS staged FROM nation""",
)
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation in a git work tree, some staged, some changed after that: which of them a commit would clean."""
    folder = _folder(spark, "staged")
    git = lambda *words: subprocess.run(["git", *words], cwd=folder, check=True, capture_output=True)
    git("init", "-q")
    names, later = {}, []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():
        names[r.n_nationkey] = r.n_name + (".md", ".bin", ".png")[r.n_nationkey % 3]
        with open(os.path.join(folder, names[r.n_nationkey]), "w", encoding="utf-8") as out:
            out.write(r.n_name)
        if r.n_nationkey % 4 != 3:
            git("add", "--", names[r.n_nationkey])
            later += [names[r.n_nationkey]] * (r.n_nationkey % 5 == 2)
    for name in later:
        with open(os.path.join(folder, name), "a", encoding="utf-8") as out:
            out.write(" and more")
    whole, partial = staged.files(options.defaults(), folder)
    state = {os.path.basename(p): s for paths, s in ((whole, "whole"), (partial, "partial")) for p in paths}
    return spark.createDataFrame([(n, state.get(n, "")) for n in names.values()], "name string, staged string")


# --- streams ------------------------------------------------------------------------------------


@query("stream_clean", f"SELECT doc_id, regexp_replace(text, '{GONE}|{BIDI}', '', 'g') AS cleaned FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)")
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, cleaned until no more are there."""
    out = "file://" + _folder(spark, "stream")
    held = _documents(spark, sf_dir)
    # As many files as parts are read, so that no task grows with the table; each step takes one for each core.
    held.where(F.col("text").isNotNull()).write.parquet(f"{out}/in")
    stream = live.read(spark, f"{out}/in", held.schema, files_a_step=max(2, spark.sparkContext.defaultParallelism))
    live.run_available(live.cleaned(stream, settings={"layers": ["characters"]}).select("doc_id", "cleaned"), f"{out}/out", f"{out}/state")
    return spark.read.schema(f"doc_id {held.schema['doc_id'].dataType.simpleString()}, cleaned string").parquet(f"{out}/out")
