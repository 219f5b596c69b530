"""Media columns: signature sniffing with Aho-Corasick, structural validation, correction of declared types, carving."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batched, col

#: Types by extension of an address, for columns that declare none.
BY_EXTENSION = {
    "html": "text/html", "htm": "text/html", "xhtml": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp",
    "wav": "audio/wav", "flac": "audio/flac", "mp3": "audio/mpeg", "ogg": "audio/ogg", "mp4": "video/mp4", "avi": "video/avi", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "txt": "text/plain", "svg": "image/svg+xml",
}
UNKNOWN, PLAIN, BINARY, HTML = "", "text/plain", "application/octet-stream", "text/html"
#: Bytes of a compressed stream that are inflated at a time.
INFLATED = 1 << 16
#: A validator: of contents, a place and what was learnt about these contents so far, to the length of the valid object there, or 0.
Check = Callable[[bytes, int, dict], int]


def _png(b: bytes, at: int, known: dict) -> int:
    """Chunks from IHDR to IEND that fill their lengths, with right checksums."""
    i, parts = at + 8, []
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + size > len(b) or (not parts and (kind != b"IHDR" or size != 13)):
            return 0
        parts.append((i + 4, i + 8 + size))
        i += 12 + size
        if kind == b"IEND":
            view = memoryview(b)
            return i - at if all(zlib.crc32(view[x:y]) == struct.unpack_from(">I", b, y)[0] for x, y in parts) else 0
    return 0


def _jpeg(b: bytes, at: int, known: dict) -> int:
    """Marker segments up to the scan, then entropy-coded data and further segments up to EOI; a frame and a scan are needed."""
    i, frame, scan = at + 2, False, False
    while i + 2 <= len(b):
        if b[i] != 0xFF:
            return 0
        mark = b[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark == 0xD9:
            return i + 2 - at if frame and scan else 0
        if mark == 0x01 or 0xD0 <= mark <= 0xD8 or mark == 0:
            return 0
        if i + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2 or i + 2 + size > len(b):
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if mark == 0xDA:
            scan = True
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return 0
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
    return 0


def _gif(b: bytes, at: int, known: dict) -> int:
    """Blocks after the screen descriptor, up to the trailer."""
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1 - at if images else 0
        if kind == 0x21:
            i += 2
        elif kind == 0x2C:
            if i + 10 > len(b):
                return 0
            local = b[i + 9]
            i += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
            images += 1
        else:
            return 0
        while True:
            if i >= len(b):
                return 0
            size = b[i]
            i += 1 + size
            if not size:
                break
    return 0


def _bmp(b: bytes, at: int, known: dict) -> int:
    """The header's sizes agree with each other and with what is there."""
    if at + 30 > len(b):
        return 0
    size, zero, start, header, planes, bits = struct.unpack_from("<IIII8xHH", b, at + 2)
    good = zero == 0 and header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size <= len(b) - at
    return size if good else 0


def _riff(form: bytes) -> Check:
    def check(b: bytes, at: int, known: dict) -> int:
        """Chunks fill the length in the header."""
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b) or end < at + 20:
            return 0
        i = at + 12
        while i + 8 <= end:
            size = struct.unpack_from("<I", b, i + 4)[0]
            i += 8 + size + (size & 1)
        return end - at if i in (end, end + 1) else 0

    return check


def _flac(b: bytes, at: int, known: dict) -> int:
    """Metadata blocks from STREAMINFO to the last one, then a frame's sync code; the stream has no length, so it runs to the end."""
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, size = b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind != 0 or size != 34):
            return 0
        last, first = b[i] & 0x80, False
        i += 4 + size
        if last:
            return len(b) - at if i + 2 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: bytes, at: int, known: dict) -> int:
    """Pages of one stream, up to the one marked as last. A page from which the end wasn't reached needn't be tried again."""
    failed = known.setdefault("ogg", set())
    i, passed = at, []
    while i not in failed and i + 27 <= len(b) and b[i : i + 4] == b"OggS" and b[i + 4] == 0:
        passed.append(i)
        n = b[i + 26]
        if i + 27 + n > len(b):
            break
        flags, i = b[i + 5], i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if i > len(b):
            break
        if flags & 4:
            return i - at
    failed.update(passed)
    return 0


_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"uuid", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"pdin")


def _mp4(b: bytes, at: int, known: dict) -> int:
    """Boxes from ftyp on, moov among them. The magic bytes are four bytes into the file. Where a run of boxes ends is kept for the places in it."""
    ended = known.setdefault("mp4", {})
    i, seen, end = at, {}, None
    while i not in ended and i + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if size == 1 and i + 16 <= len(b):
            size = struct.unpack_from(">Q", b, i + 8)[0]
        if size < 8 or kind not in _BOXES:
            break
        seen[i] = kind
        i += size
        if i > len(b):
            end = 0
            break
    # where the run of boxes from each of these places ends; 0 if it runs beyond the contents
    end = ended.get(i, i) if end is None else end
    ended.update(dict.fromkeys(seen, end))
    return end - at if end and {b"ftyp", b"moov"} <= set(seen.values()) else 0


def _pdf(b: bytes, at: int, known: dict) -> int:
    """A version, a startxref that points inside, and the last end-of-file mark before another document begins."""
    if not re.match(rb"%PDF-\d\.\d", b[at : at + 8]):
        return 0
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    last = b.rfind(b"startxref", at, end) if end > 0 else -1
    found = _OFFSET.fullmatch(b, last, end) if last >= 0 else None
    return end + 5 - at if found and int(found[1]) < end - at else 0


_OFFSET = re.compile(rb"startxref\s+(\d{1,19})\s+")


def _zip(b: bytes, at: int, known: dict) -> int:
    """An end record whose directory lies where it says, seen from this start; the first such record."""
    if "zip" not in known:
        ends: dict[int, int] = {}
        i = b.find(b"PK\x05\x06")
        while 0 <= i <= len(b) - 22:
            n, size, start, note = struct.unpack_from("<10xHIIH", b, i)
            begin = i - size - start
            if n and begin >= 0 and b[begin + start : begin + start + 4] == b"PK\x01\x02" and i + 22 + note <= len(b):
                ends.setdefault(begin, i + 22 + note)
            i = b.find(b"PK\x05\x06", i + 4)
        known["zip"] = ends
    return known["zip"].get(at, at) - at


def _gzip(b: bytes, at: int, known: dict) -> int:
    """The stream inflates to its end with the right checksum and size; the output isn't kept."""
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    inflate, view, i = zlib.decompressobj(31), memoryview(b), at
    try:
        while not inflate.eof:
            data = inflate.unconsumed_tail
            if not data:
                if i >= len(b):
                    return 0
                data, i = view[i : i + INFLATED], i + INFLATED
            inflate.decompress(data, 1 << 20)
    except zlib.error:
        return 0
    return min(i, len(b)) - len(inflate.unused_data) - at


_MARKS = ((b"\xef\xbb\xbf", ""), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_SPACES = re.compile(rb"[ \t\r\n\f]*")
_COMMENT_END = re.compile(rb"--!?>")
_ROOT = re.compile(rb"<!doctype\s*html[\s>]|<html[\s>/]", re.I)


def _html(b: bytes) -> int:
    """A doctype or a root element of HTML in any case, after at most a byte order mark, white space, comments and processing instructions of any length."""
    i, data = 0, b
    for mark, coding in _MARKS:
        if b.startswith(mark):
            i, data = (len(mark), b) if not coding else (0, b[len(mark) :].decode(coding, "replace").encode())
            break
    while True:
        i = _SPACES.match(data, i).end()
        if data.startswith(b"<!--", i):
            end = _COMMENT_END.search(data, i + 2)
            i = end.end() if end else len(data)
        elif data.startswith(b"<?", i):
            # an XML declaration ends with ?>, other instructions end at the first >, as HTML reads them
            end = data.find(b"?>", i) + 1 if data[i : i + 5].lower() == b"<?xml" else 0
            end = end or data.find(b">", i)
            i = end + 1 if end >= 0 else len(data)
        else:
            return len(b) if _ROOT.match(data, i) else 0


#: Magic bytes, how far into the file they are, the type, and the validator: the length of the valid object at a place, or 0.
SIGNATURES: tuple[tuple[bytes, int, str, Check], ...] = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP")),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE")),
    (b"AVI ", 8, "video/avi", _riff(b"AVI ")),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
)
#: Types without a length of their own aren't carved from inside.
WHOLE_ONLY = ("audio/flac",)
#: The media type and its parameters may be left out; the text's padding may be too, or be escaped.
_DATA_URI = re.compile(rb"data:(?:[a-zA-Z0-9.+-]+/[a-zA-Z0-9.+-]+)?(?:;[a-zA-Z0-9=.-]+)*?;base64,([A-Za-z0-9+/]+)")


def _unpacked(text: bytes) -> bytes:
    """What base64 without its padding stands for; a last digit that is too much is left out."""
    text = text[: len(text) - (len(text) % 4 == 1)]
    return base64.b64decode(text + b"=" * (-len(text) % 4))


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def objects(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid object, outermost first: what lies inside an accepted one is part of it."""
    hits = sorted((end + 1 - len(SIGNATURES[k][0]) - SIGNATURES[k][1], k) for end, k in _AUTOMATON.iter(data.decode("latin-1")))
    out, reached, known = [], 0, {}
    # HTML has no magic bytes at a fixed place; it is the whole or nothing, and what lies inside it counts too
    if size := _html(data):
        out.append((0, size, HTML))
    for at, k in hits:
        _, _, kind, check = SIGNATURES[k]
        if at < reached or at < 0 or (at and kind in WHOLE_ONLY):
            continue
        size = check(data, at, known)
        if size:
            out.append((at, size, kind))
            reached = at + size
    return out


def sniff(data: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The type of the whole, and (offset, length, type, encoding) of the objects inside it: raw ones and those of base64 data addresses.

    The whole has the type of the object that begins it; else it is plain text if it is UTF-8 without NUL; else octets.
    """
    if not data:
        return UNKNOWN, []
    found = objects(data)
    kind = next((t for at, _, t in found if at == 0), None)
    inside = [(at, size, t, "raw") for at, size, t in found if at]
    for m in _DATA_URI.finditer(data) if b";base64," in data else ():
        held = objects(_unpacked(m[1]))
        if held and held[0][0] == 0:
            inside.append((m.start(1), held[0][1], held[0][2], "base64"))
    if kind is None:
        try:
            data.decode()
            kind = BINARY if b"\0" in data else PLAIN
        except UnicodeDecodeError:
            kind = BINARY
    return kind, sorted(inside)


_EMBEDDED = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("encoding", T.StringType())]))
_SNIFFED = T.StructType([T.StructField("detected", T.StringType()), T.StructField("embedded", _EMBEDDED)])


@F.arrow_udf(_SNIFFED)
def _sniff(content: pa.Array) -> pa.Array:
    content = content.cast(pa.large_binary())
    kinds, inside = [], []
    for value in content:
        kind, found = sniff(value.as_buffer().to_pybytes()) if value.is_valid else (None, None)
        kinds.append(kind)
        inside.append(found if found is None else [{"offset": a, "length": n, "type": t, "encoding": e} for a, n, t, e in found])
    item = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("encoding", pa.string())])
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(inside, pa.list_(item))], names=["detected", "embedded"])


def sniff_media(rows: DataFrame, id_col: str, content_col: str, declared: F.Column) -> DataFrame:
    """(id, declared, detected, corrected, media_type, embedded) of each row's content, a string or binary column.

    detected is the type that the structure confirms; corrected says that it differs from a declared one, in which case
    it is the media_type too; octets that no format claims, and plain text, don't overrule a declaration of a type that
    isn't known here; nor does plain text overrule text/html, which a part of a page may be. embedded lists
    objects inside: offset and length of raw ones, and for those in base64 data addresses the offset of the base64 text
    and the length of the decoded object. A null content has null detected and embedded and keeps its declaration; an
    empty one is detected as '' and has none. A null or blank declaration counts as none. Null ids are carried; repeated
    rows give equal rows; an empty table gives none. Contents of any length are searched whole. Other columns play no part.
    """
    known = [t for _, _, t, _ in SIGNATURES] + [HTML, PLAIN]
    said = F.nullif(F.lower(F.trim(declared)), F.lit(""))
    shown = batched(rows).select(col(id_col).alias("id"), said.alias("declared"), _sniff(col(content_col).cast("binary")).alias("v")).select("id", "declared", "v.detected", "v.embedded")
    fragment = (F.col("detected") == PLAIN) & (F.col("declared") == HTML)
    sure = ~F.col("detected").isin(UNKNOWN, PLAIN, BINARY) | (F.col("detected").isin(PLAIN, BINARY) & F.col("declared").isin(*known) & ~fragment)
    corrected = F.coalesce(sure & (F.col("declared") != F.col("detected")), F.lit(False))
    media = F.when(corrected, F.col("detected")).otherwise(F.coalesce("declared", "detected"))
    return shown.select("id", "declared", "detected", corrected.alias("corrected"), media.alias("media_type"), "embedded")


def carve(rows: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, offset, type, data) of every object inside the contents, a string or binary column.

    Offsets are those of sniff_media's embedded; data is the object itself, decoded from base64 where it was in a data
    address. What begins a content is the content and isn't carved. Null and empty contents have none. Null ids are
    carried; repeated rows give repeated objects; an empty table gives none. Contents of any length are searched whole.
    Other columns, whatever their names, play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, offsets, kinds, datas = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                data = value.as_buffer().to_pybytes()
                for at, size, kind, how in sniff(data)[1]:
                    raw = data[at : at + size] if how == "raw" else _unpacked(data[at : at + (size * 4 + 2) // 3])
                    row.append(i)
                    offsets.append(at)
                    kinds.append(kind)
                    datas.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row, np.int64))), pa.array(offsets, pa.int64()), pa.array(kinds, pa.string()), pa.array(datas, pa.binary())], names=["id", "offset", "type", "data"])

    thin = batched(rows).select(col(id_col).alias("id"), col(content_col).cast("binary").alias("content")).where("content IS NOT NULL")
    return thin.mapInArrow(run, f"id {thin.schema['id'].dataType.simpleString()}, offset bigint, type string, data binary")


def declared_by_address(url: F.Column) -> F.Column:
    """The type that an address's extension declares; null if it has none that is known."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.element_at(table, extension)
