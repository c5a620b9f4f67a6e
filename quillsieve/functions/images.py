"""Metadata out of JPEG, PNG and WebP files, byte for byte; pixels are never decoded.

Each stripper gives the new bytes, the blocks it dropped and the orientation it kept, or None for
a file that it can't read. Orientation other than upright is written back as the only EXIF field.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple


class Block(NamedTuple):
    kind: str
    label: str
    data: bytes


class Stripped(NamedTuple):
    content: bytes
    blocks: list[Block]
    orientation: int | None


EXIF = b"Exif\0\0"
XMP = (b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0")


def orientation_of(data: bytes) -> int | None:
    """2 to 8 if the first directory of a TIFF block names it once as a short number."""
    tiff = data[len(EXIF) :] if data.startswith(EXIF) else data
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return None
    magic, at = struct.unpack_from(order + "HI", tiff, 2)
    if magic != 42 or at + 2 > len(tiff):
        return None
    (entries,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(entries):
        field = tiff[at + 2 + 12 * k :][:12]
        if len(field) < 12:
            return None
        tag, kind, count, value = struct.unpack(order + "HHIH2x", field)
        if tag == 274:
            return value if (kind, count) == (3, 1) and value in range(2, 9) else None
    return None


def orientation_block(value: int) -> bytes:
    """The smallest big-endian TIFF that says it: one directory with one field."""
    return struct.pack(">2sHIHHHIHHI", b"MM", 42, 8, 1, 274, 3, 1, value, 0, 0)


def _jpeg_kind(marker: int, payload: bytes) -> tuple[str, str]:
    if marker == 0xE1:
        return ("exif", "EXIF") if payload.startswith(EXIF) else ("xmp", "XMP") if payload.startswith(XMP) else ("metadata", "APP1")
    return {0xEB: ("c2pa", "C2PA"), 0xED: ("iptc", "IPTC"), 0xFE: ("comment", "COM"), 0xE2: ("icc", "ICC")}[marker]


def jpeg(data: bytes, strip_icc: bool = False) -> Stripped | None:
    if data[:2] != b"\xff\xd8":
        return None
    drop = {0xE1, 0xEB, 0xED, 0xFE} | ({0xE2} if strip_icc else set())
    kept, blocks, turn, at = [], [], None, 2
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker in (0xD9, 0xDA):  # the picture itself, or its end: all the rest stays
            kept.append(data[at:])
            break
        elif marker == 1 or 0xD0 <= marker <= 0xD7:
            kept.append(data[at : at + 2])
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big") if at + 4 <= len(data) else 0
            end = at + 2 + size
            if size < 2 or end > len(data):
                return None
            if marker in drop:
                payload = data[at + 4 : end]
                blocks.append(Block(*_jpeg_kind(marker, payload), data[at:end]))
                if marker == 0xE1 and turn is None:
                    turn = orientation_of(payload)
            else:
                kept.append(data[at:end])
            at = end
    if turn is not None:
        payload = EXIF + orientation_block(turn)
        place = next((k for k, s in enumerate(kept) if s[1] != 0xE0), len(kept))
        kept.insert(place, struct.pack(">BBH", 0xFF, 0xE1, len(payload) + 2) + payload)
    return Stripped(b"\xff\xd8" + b"".join(kept), blocks, turn)


PNG = b"\x89PNG\r\n\x1a\n"
PNG_KINDS = {b"tEXt": "text", b"zTXt": "text", b"iTXt": "text", b"eXIf": "exif", b"tIME": "timestamp", b"caBX": "c2pa", b"iCCP": "icc"}


def png(data: bytes, strip_icc: bool = False) -> Stripped | None:
    if not data.startswith(PNG):
        return None
    drop = set(PNG_KINDS) - (set() if strip_icc else {b"iCCP"})
    kept, blocks, turn, header, at = [PNG], [], None, 0, len(PNG)
    while at < len(data):
        if at + 8 > len(data):
            return None
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + size + 12
        if end > len(data):
            return None
        if kind in drop:
            blocks.append(Block(PNG_KINDS[kind], kind.decode(), data[at:end]))
            if kind == b"eXIf" and turn is None:
                turn = orientation_of(data[at + 8 : end - 4])
        else:
            kept.append(data[at:end])
            header = header or (len(kept) - 1 if kind == b"IHDR" else 0)
        at = end
        if kind == b"IEND":
            kept.append(data[at:])
            break
    if turn is not None:
        body = b"eXIf" + orientation_block(turn)
        kept.insert(header + 1, struct.pack(">I", len(body) - 4) + body + struct.pack(">I", zlib.crc32(body)))
    return Stripped(b"".join(kept), blocks, turn)


WEBP_KINDS = {b"EXIF": "exif", b"XMP ": "xmp", b"JUMB": "c2pa", b"C2PA": "c2pa", b"c2pa": "c2pa", b"ICCP": "icc"}
HAS_XMP, HAS_EXIF, HAS_ICC = 4, 8, 32


def webp(data: bytes, strip_icc: bool = False) -> Stripped | None:
    if len(data) < 12 or (data[:4], data[8:12]) != (b"RIFF", b"WEBP"):
        return None
    drop = set(WEBP_KINDS) - (set() if strip_icc else {b"ICCP"})
    kept: list[bytearray] = []
    blocks, turn, header, at = [], None, None, 12
    while at < len(data):
        if at + 8 > len(data):
            return None
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > len(data):
            return None
        end = at + 8 + size + size % 2
        if kind in drop:
            blocks.append(Block(WEBP_KINDS[kind], kind.decode().strip(), data[at:end]))
            if kind == b"EXIF" and turn is None:
                turn = orientation_of(data[at + 8 : at + 8 + size])
        else:
            kept.append(bytearray(data[at:end]))
            if kind == b"VP8X" and header is None and len(kept[-1]) > 8:
                header = kept[-1]
        at = end
    if header is None:  # only the extended header can announce an EXIF block
        turn = None
    elif blocks:
        header[8] &= 0xFF ^ (HAS_XMP | HAS_EXIF | (HAS_ICC if strip_icc else 0))
        header[8] |= HAS_EXIF if turn is not None else 0
    if turn is not None:
        block = orientation_block(turn)
        kept.append(bytearray(struct.pack("<4sI", b"EXIF", len(block)) + block))
    body = b"WEBP" + b"".join(kept)
    return Stripped(struct.pack("<4sI", b"RIFF", len(body)) + body, blocks, turn)


STRIPPERS = {".jpg": jpeg, ".jpeg": jpeg, ".png": png, ".webp": webp}
UNTOUCHED = frozenset(".gif .tif .tiff .heic .heif .avif".split())
