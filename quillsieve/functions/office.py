"""Author and program names out of office files, without touching any other part of the archive."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from functools import lru_cache

MOST = 64 << 20  # bytes of a part, inflated

_CORE = ("docProps/core.xml", "remove", "creator lastModifiedBy")
_APP = ("docProps/app.xml", "remove", "Application AppVersion Company Manager Template TotalTime")
_OPEN = (("meta.xml", "remove", "creator initial-creator generator editing-duration printed-by"), ("content.xml", "empty", "creator"))
#: Part, what to do, and with which elements or attributes; a star stands for a name without a slash.
RULES = {
    ".docx": (_CORE, _APP, ("word/people.xml", "remove", "person"), ("word/*.xml", "blank", "author initials")),
    ".pptx": (_CORE, _APP, ("ppt/commentAuthors.xml", "blank", "name initials"), ("ppt/authors.xml", "blank", "name initials userId providerId")),
    ".xlsx": (_CORE, _APP, ("xl/*.xml", "empty", "author"), ("xl/persons/person.xml", "blank", "displayName userId providerId")),
    ".odt": _OPEN,
    ".odp": _OPEN,
    ".ods": _OPEN,
}


def applies(part: str, name: str) -> bool:
    return re.fullmatch(re.escape(part).replace("\\*", "[^/]*"), name) is not None


@lru_cache(maxsize=64)
def _pattern(what: str, name: str) -> re.Pattern:
    prefix, name = "(?:[\\w.]+:)?", re.escape(name)
    opening, closing = f"<{prefix}{name}\\b[^>]*", f"</{prefix}{name}>"
    if what == "remove":
        return re.compile(f"(?s){opening}/>|{opening}>.*?{closing}")
    if what == "empty":
        return re.compile(f"(?s)(?P<a>{opening}>)(?P<gone>.*?)(?P<b>{closing})")
    return re.compile(f"(?P<a>\\s{prefix}{name}=(?P<q>[\"']))(?P<gone>[^\"']*)(?P<b>(?P=q))")


def scrub(text: str, what: str, names: str) -> tuple[str, int]:
    """The text after one rule, and how much it took: elements, or contents and values that weren't empty."""
    total = 0
    for name in names.split():
        pattern = _pattern(what, name)
        if what == "remove":
            text, n = pattern.subn("", text)
        else:
            n = sum(m["gone"] != "" for m in pattern.finditer(text))
            text = pattern.sub(lambda m: m["a"] + m["b"], text)
        total += n
    return text, total


class Unreadable(Exception):
    pass


def _inflated(data: bytes, info: zipfile.ZipInfo) -> bytes:
    if info.file_size > MOST:
        raise Unreadable
    if info.compress_type == zipfile.ZIP_STORED:
        return data
    try:
        engine = zlib.decompressobj(-zlib.MAX_WBITS)
        out = engine.decompress(data, MOST + 1)
    except zlib.error as error:
        raise Unreadable from error
    if engine.unconsumed_tail or len(out) > MOST:
        raise Unreadable
    return out


def _stored(data: bytes, info: zipfile.ZipInfo) -> tuple[bytes, bytes]:
    """Local header and packed bytes of a part."""
    at = info.header_offset
    head = data[at : at + 30] if at >= 0 else b""
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise Unreadable
    start = at + 30 + sum(struct.unpack("<HH", head[26:]))
    if start + info.compress_size > len(data):
        raise Unreadable
    return data[at:start], data[start : start + info.compress_size]


def strip(data: bytes, suffix: str) -> tuple[bytes, int] | None:
    """New bytes and how much was taken; the bytes as given if nothing; None if the file can't be read."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, NotImplementedError, OSError, RuntimeError, ValueError):
        return None
    parts, total = [], 0
    try:
        for info in infos:
            odd = info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1
            if odd or max(info.compress_size, info.file_size, info.header_offset) >= 1 << 32:
                return None
            head, packed = _stored(data, info)
            sums = info.compress_type, info.CRC, info.compress_size, info.file_size
            rules = [r for r in RULES[suffix] if applies(r[0], info.filename)]
            if rules:
                try:
                    text, n = _inflated(packed, info).decode("utf-8"), 0
                except UnicodeDecodeError:
                    rules = []
                for _, what, names in rules:
                    text, k = scrub(text, what, names)
                    n += k
                if rules and n:
                    total += n
                    packed = text.encode("utf-8")
                    sums = zipfile.ZIP_STORED, zlib.crc32(packed), len(packed), len(packed)
            parts.append((info, head, packed, sums))
    except Unreadable:
        return None
    return (_written(parts), total) if total else (data, 0)


def _written(parts: list[tuple]) -> bytes:
    """The archive anew, in the order of its parts; sizes stand in the headers, no longer behind the data."""
    body, index = bytearray(), bytearray()
    parts = sorted(parts, key=lambda p: p[0].header_offset)
    for info, head, packed, (method, crc, size, full) in parts:
        at, flags = len(body), info.flag_bits & ~8
        local = bytearray(head)
        struct.pack_into("<HH", local, 6, struct.unpack_from("<H", head, 6)[0] & ~8, method)
        struct.pack_into("<III", local, 14, crc, size, full)
        body += local + packed
        year, month, day, hour, minute, second = info.date_time
        date, time = max(year - 1980, 0) << 9 | month << 5 | day, hour << 11 | minute << 5 | second // 2
        # The name's bytes as they were: marked as UTF-8, or of the old code page, in which every byte is a character.
        name, extra, comment = info.orig_filename.encode("utf-8" if flags & 0x800 else "cp437"), info.extra or b"", info.comment or b""
        index += b"PK\1\2" + struct.pack("<BBHHH", info.create_version, info.create_system, info.extract_version, flags, method)
        index += struct.pack("<HHIII", time, date, crc, size, full) + struct.pack("<HHH", len(name), len(extra), len(comment))
        index += struct.pack("<HHII", 0, info.internal_attr, info.external_attr, at) + name + extra + comment
    return bytes(body + index) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(parts), len(parts), len(index), len(body), 0)
