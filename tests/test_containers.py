"""Images, drawings, office files and PDF."""

import io
import struct
import zipfile
import zlib

from quillsieve.functions import images, office
from quillsieve.operators import binary


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def exif(value, order="II"):
    sign = "<" if order == "II" else ">"
    return b"Exif\0\0" + order.encode() + struct.pack(sign + "HIHHHIHHI", 42, 8, 1, 274, 3, 1, value, 0, 0)


def jpeg(*segments):
    return b"".join((b"\xff\xd8", *segments)) + b"\xff\xda\x00\x02scan\xff\x00bytes\xff\xd9"


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_jpeg_keeps_the_scan_and_orientation():
    done = images.jpeg(jpeg(segment(0xE0, b"JFIF\0"), segment(0xE1, exif(6)), segment(0xFE, b"note")))
    assert len(done.blocks) == 2 and done.orientation == 6
    assert [b.kind for b in done.blocks] == ["exif", "comment"]
    assert done.content.endswith(b"scan\xff\x00bytes\xff\xd9") and b"note" not in done.content
    again = images.jpeg(done.content)
    assert again.content == done.content and again.orientation == 6
    assert len(done.content) - len(images.jpeg(jpeg(segment(0xE0, b"JFIF\0"))).content) == 36


def test_jpeg_upright_or_broken():
    done = images.jpeg(jpeg(segment(0xE1, exif(1, "MM"))))
    assert done.orientation is None and len(done.blocks) == 1
    assert images.jpeg(b"nothing") is None
    assert images.jpeg(b"\xff\xd8\xff\xe1\xff") is None
    assert images.jpeg(b"\xff\xd8" + segment(0xE0, b"x")) is None


def test_png():
    clean = images.PNG + chunk(b"IHDR", bytes(13)) + chunk(b"iCCP", b"p") + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    assert images.png(clean).content == clean and not images.png(clean).blocks
    assert len(images.png(clean, True).blocks) == 1
    dirty = clean.replace(chunk(b"IDAT", b"x"), chunk(b"tEXt", b"a") + chunk(b"iTXt", b"b") + chunk(b"IDAT", b"x")) + b"tail"
    assert images.png(dirty).content == clean + b"tail"
    turned = images.png(images.PNG + chunk(b"IHDR", bytes(13)) + chunk(b"eXIf", exif(3)[6:]) + chunk(b"IEND", b""))
    assert turned.orientation == 3 and images.png(turned.content).content == turned.content
    assert images.png(clean[:-3]) is None


def test_webp():
    part = lambda kind, data: kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    body = b"WEBP" + part(b"VP8X", bytes([12]) + bytes(9)) + part(b"VP8 ", b"px") + part(b"EXIF", exif(6)[6:]) + part(b"XMP ", b"<x/>")
    done = images.webp(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert len(done.blocks) == 2 and done.orientation == 6 and done.content[20] == 8
    assert struct.unpack_from("<I", done.content, 4)[0] == len(done.content) - 8
    plain = b"WEBP" + part(b"VP8 ", b"px") + part(b"EXIF", exif(6)[6:])
    assert images.webp(b"RIFF" + struct.pack("<I", len(plain)) + plain).orientation is None
    assert images.webp(b"RIFFxxxxWEBPVP8 ") is None


def archive(parts, streamed=False):
    class Pipe(io.BytesIO):
        def seekable(self):
            return not streamed

        def seek(self, *a):
            if streamed:
                raise OSError
            return super().seek(*a)

    out = Pipe()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


CORE = "<a><dc:creator>Ann</dc:creator><cp:lastModifiedBy>Bo</cp:lastModifiedBy><dc:title>T</dc:title></a>"


def test_docx():
    parts = {"docProps/app.xml": "<p><Application>W</Application><Company/></p>", "docProps/core.xml": CORE + "", "word/document.xml": '<w:ins w:author="Ann" w:initials=""><w:t>body</w:t></w:ins>', "word/media/x.xml": '<a author="kept"/>'}
    for streamed in (False, True):
        new, n = office.strip(archive(parts, streamed), ".docx")
        z = zipfile.ZipFile(io.BytesIO(new))
        assert n == 5 and z.testzip() is None
        assert z.read("docProps/core.xml") == b"<a><dc:title>T</dc:title></a>"
        assert z.read("word/document.xml") == b'<w:ins w:author="" w:initials=""><w:t>body</w:t></w:ins>'
        assert z.read("word/media/x.xml") == b'<a author="kept"/>'
        assert not any(i.flag_bits & 8 for i in z.infolist())
        assert office.strip(new, ".docx") == (new, 0)


def test_other_archives():
    new, n = office.strip(archive({"meta.xml": "<m><meta:generator>G</meta:generator><meta:editing-cycles>3</meta:editing-cycles></m>", "content.xml": "<c><dc:creator>A</dc:creator><dc:creator></dc:creator></c>"}), ".odt")
    assert n == 2 and b"editing-cycles" in zipfile.ZipFile(io.BytesIO(new)).read("meta.xml")
    assert office.strip(b"PK no", ".docx") is None
    broken = bytearray(archive({"docProps/core.xml": CORE}))
    broken[6] |= 1
    at = broken.index(b"PK\1\2")
    broken[at + 8] |= 1
    assert office.strip(bytes(broken), ".docx") is None


def test_one_file_each(spark):
    svg = "<svg><metadata>a<!-- b --></metadata><!-- c --><path/></svg>".encode()
    rows = [("a", ".svg", svg), ("b", ".svg", "<svg>é</svg>".encode("latin-1")), ("c", ".pdf", b"%PDF /Author /CreatorTool"), ("d", ".pdf", b"no"), ("e", ".gif", b"GIF"), ("f", ".png", b"no"), ("g", ".docx", None), ("h", None, b"x")]
    done = {r.name: r for r in binary.stripped(spark.createDataFrame(rows, "name string, suffix string, content binary"), "name").collect()}
    assert done["a"].stripped == 3 and bytes(done["a"].cleaned) == b"<svg><path/></svg>"
    assert done["b"].findings[0].layer == "io"
    assert done["c"].findings[0]["count"] == 2 and done["c"].cleaned is None
    assert done["d"].findings[0].message.startswith("could not parse")
    assert done["e"].findings[0].severity == "warn" and done["f"].stripped is None
    assert done["g"].findings[0].kind == "office" and not done["h"].findings


def test_names_of_the_old_code_page_stay():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", "<a><dc:creator>A</dc:creator></a>")
        z.writestr("word/media/X_x.png", b"px")
        z.writestr("word/media/ü.png", b"py")
    raw = out.getvalue().replace(b"word/media/X_x.png", b"word/media/\x82_x.png")
    done, n = office.strip(raw, ".docx")
    names = lambda data: [i.filename for i in zipfile.ZipFile(io.BytesIO(data)).infolist()]
    assert n == 1 and names(done) == names(raw) and zipfile.ZipFile(io.BytesIO(done)).testzip() is None
