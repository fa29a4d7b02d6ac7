"""Media columns: signature sniffing of binary values.

An Aho-Corasick automaton finds all magic byte strings in one pass. What stands at a hit is taken for
a format only if that format's validator can follow its structure to an end: chunk lengths, checksums,
block terminators. So a wrong declared type is corrected, and media inside other bytes are carved with
exact offset and length. ``encode_wav`` and ``read_wav`` store bytes losslessly as 8-bit samples.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsieve.llm.common import STEP_CHARS, sliced, texts_of, written
from binsieve.llm.encoding import kept

RATE = 8000
_STARTXREF = re.compile(rb"startxref\s+(\d{1,10})\s+$")
_XREF = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b")


class Marks:
    """What validators look up: found in the one pass over a value, so that none of them searches it again.

    ``zips`` has the length of an archive by its start, as its end record tells both; ``starts`` and
    ``ends`` are the places of PDF headers and end marks, in order.
    """

    def __init__(self, b: memoryview, hits: list[tuple[int, bytes]]):
        self.zips: dict[int, int] = {}
        self.starts = [at for at, magic in hits if magic == b"%PDF-"]
        self.ends = [at for at, magic in hits if magic == b"%%EOF"]
        for at, magic in hits:
            if magic == b"PK\5\6" and at + 22 <= len(b):
                size, offset, comment = struct.unpack_from("<IIH", b, at + 12)
                start = at - size - offset
                if start >= 0 and (not size or bytes(b[start + offset : start + offset + 4]) == b"PK\1\2") and at + 22 + comment <= len(b):
                    self.zips.setdefault(start, at + 22 + comment - start)


def _wav(b: memoryview, at: int, _: Marks) -> int:
    """RIFF/WAVE: chunks fill the declared size exactly, format before data."""
    if len(b) < at + 12 or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    here, seen = at + 12, b""
    while end <= len(b) and here + 8 <= end:
        name, size = bytes(b[here : here + 4]), struct.unpack_from("<I", b, here + 4)[0]
        if name == b"fmt " and size < 16 or name == b"data" and b"f" not in seen:
            return 0
        seen += name[:1]
        here += 8 + size + size % 2
    return end - at if here == end and b"d" in seen else 0


def _webp(b: memoryview, at: int, _: Marks) -> int:
    """RIFF/WEBP: chunks fill the declared size exactly, an image chunk first."""
    if len(b) < at + 20 or bytes(b[at + 8 : at + 12]) != b"WEBP" or bytes(b[at + 12 : at + 16]) not in (b"VP8 ", b"VP8L", b"VP8X"):
        return 0
    end, here = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    while end <= len(b) and here + 8 <= end:
        size = struct.unpack_from("<I", b, here + 4)[0]
        here += 8 + size + size % 2
    return end - at if here == end else 0


def _png(b: memoryview, at: int, _: Marks) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    here, first = at + 8, True
    while here + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, here)
        end = here + 12 + size
        if end > len(b) or first != (name == b"IHDR") or zlib.crc32(b[here + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if name == b"IEND":
            return end - at
        here, first = end, False
    return 0


def _gif(b: memoryview, at: int, _: Marks) -> int:
    """Blocks of known kinds up to the trailer."""
    if len(b) < at + 13 or bytes(b[at : at + 6]) not in (b"GIF87a", b"GIF89a"):
        return 0
    here = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)

    def skip(here: int) -> int:
        while here < len(b) and b[here]:
            here += 1 + b[here]
        return here + 1

    images = 0
    while here < len(b):
        if b[here] == 0x3B:
            return here + 1 - at if images else 0
        if b[here] == 0x21:
            here = skip(here + 2)
        elif b[here] == 0x2C and here + 11 <= len(b):
            flags = b[here + 9]
            here = skip(here + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
            images += 1
        else:
            return 0
    return 0


def _jpeg(b: memoryview, at: int, _: Marks) -> int:
    """Segments by their lengths; entropy-coded data up to a marker; ends at EOI."""
    here, frame = at + 2, False
    while here + 4 <= len(b) and b[here] == 0xFF:
        mark = b[here + 1]
        if mark == 0xD9:
            return here + 2 - at if frame else 0
        if mark == 0xFF:
            here += 1
            continue
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return 0
        here += 2 + struct.unpack_from(">H", b, here + 2)[0]
        if mark == 0xDA:
            frame = True
            while here + 1 < len(b) and not (b[here] == 0xFF and b[here + 1] and not 0xD0 <= b[here + 1] <= 0xD7):
                here += 1
    return here + 2 - at if frame and here + 2 <= len(b) and bytes(b[here : here + 2]) == b"\xff\xd9" else 0


def _bmp(b: memoryview, at: int, _: Marks) -> int:
    """A header whose sizes agree: uncompressed rows, each padded to four bytes, fit between offset and end."""
    if len(b) < at + 34:
        return 0
    size, zero, offset, header, width, height = struct.unpack_from("<IIIIii", b, at + 2)
    planes, depth, packing = struct.unpack_from("<HHI", b, at + 26)
    good = not zero and header in (40, 52, 56, 108, 124) and 14 + header <= offset <= size and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and height
    rows = (width * depth + 31) // 32 * 4 * abs(height) if packing in (0, 3) else 1
    return size if good and offset + rows <= size and at + size <= len(b) else 0


def _gzip(b: memoryview, at: int, _: Marks) -> int:
    """One member that inflates, with right checksum and length; read by pieces, so that nothing is copied twice."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    inflater, here, piece = zlib.decompressobj(31), at, 1 << 14
    try:
        while not inflater.eof:
            some = inflater.unconsumed_tail or b[here : here + piece]
            if not inflater.unconsumed_tail:
                here += len(some)
            if not some:
                return 0
            inflater.decompress(some, 1 << 20)
    except zlib.error:
        return 0
    return here - at - len(inflater.unused_data)


def _zip(b: memoryview, at: int, marks: Marks) -> int:
    """An end record whose directory lies right before it and whose first file is here."""
    return marks.zips.get(at, 0)


def _pdf(b: memoryview, at: int, marks: Marks) -> int:
    """Up to the last end mark before the next file's header where the number after startxref leads to a table or an object."""
    after = bisect_right(marks.starts, at)
    stop = marks.starts[after] if after < len(marks.starts) else len(b)
    for k in range(bisect_left(marks.ends, stop) - 1, bisect_right(marks.ends, at) - 1, -1):
        end = marks.ends[k]
        told = _STARTXREF.search(b[max(at, end - 48) : end])
        place = at + int(told[1]) if told else end
        if place < end and _XREF.match(b[place : place + 32]):
            return end + 5 - at
    return 0


def _flac(b: memoryview, at: int, _: Marks) -> int:
    """Metadata blocks from STREAMINFO on, then a frame's sync code; frames carry no length and run to the end."""
    here, first = at + 4, True
    while here + 4 <= len(b):
        kind, size = b[here], int.from_bytes(b[here + 1 : here + 4], "big")
        if first and (kind & 127 or size != 34) or kind & 127 > 6 and kind & 127 != 126:
            return 0
        here, first = here + 4 + size, False
        if kind & 128:
            return len(b) - at if here + 2 <= len(b) and b[here] == 0xFF and b[here + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: memoryview, at: int, _: Marks) -> int:
    """Pages by their segment tables, from a first to a last one."""
    here, last = at, False
    while not last and here + 27 <= len(b) and bytes(b[here : here + 5]) == b"OggS\0":
        table = b[here + 27 : here + 27 + b[here + 26]]
        if here == at and not b[here + 5] & 2:
            return 0
        last = bool(b[here + 5] & 4)
        here += 27 + len(table) + sum(table)
    return here - at if last and here <= len(b) else 0


def _mp4(b: memoryview, at: int, _: Marks) -> int:
    """Boxes of sane length from ftyp on."""
    here, boxes = at, set()
    while here + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, here)
        if size < 8 or here + size > len(b) or not name.isalnum() or not boxes and name != b"ftyp":
            break
        boxes.add(name)
        here += size
    return here - at if {b"ftyp", b"moov"} <= boxes or {b"ftyp", b"meta"} <= boxes else 0


# Name, MIME type, magic bytes and where in the format they stand.
FORMATS: list[tuple[str, str, bytes, int, Callable[[memoryview, int, Marks], int]]] = [
    ("wav", "audio/wav", b"RIFF", 0, _wav), ("webp", "image/webp", b"RIFF", 0, _webp), ("png", "image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("gif", "image/gif", b"GIF87a", 0, _gif), ("gif", "image/gif", b"GIF89a", 0, _gif), ("jpeg", "image/jpeg", b"\xff\xd8\xff", 0, _jpeg), ("bmp", "image/bmp", b"BM", 0, _bmp),
    ("gzip", "application/gzip", b"\x1f\x8b\x08", 0, _gzip), ("zip", "application/zip", b"PK\x03\x04", 0, _zip), ("pdf", "application/pdf", b"%PDF-", 0, _pdf), ("flac", "audio/flac", b"fLaC", 0, _flac),
    ("ogg", "audio/ogg", b"OggS", 0, _ogg), ("mp4", "video/mp4", b"ftyp", 4, _mp4),
]
ENDINGS = (b"PK\x05\x06", b"%%EOF")
# End of fixed values.
MIME = {name: mime for name, mime, *_ in FORMATS}


def _automaton():
    """The magic strings and endings; bytes are given to the automaton as the characters of the same number."""
    made = ahocorasick.Automaton()
    by_magic: dict[bytes, list] = {magic: [] for magic in ENDINGS}
    for entry in FORMATS:
        by_magic.setdefault(entry[2], []).append(entry)
    for magic, entries in by_magic.items():
        made.add_word(magic.decode("latin-1"), (magic, entries))
    made.make_automaton()
    return made


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(format, offset, length) of every medium that isn't inside another, in order of offset.

    A medium that starts at the first byte may hold others, which are listed after it.
    """
    view, found, free = memoryview(data), [], 0
    hits = [(last + 1 - len(magic), magic, entries) for last, (magic, entries) in kept("magic", _automaton).iter(data.decode("latin-1"))]
    marks = Marks(view, [(at, magic) for at, magic, _ in hits])
    for start, _, entries in hits:
        for name, _, _, inside, validate in entries:
            at = start - inside
            if at < free:
                continue
            if length := validate(view, at, marks):
                found.append((name, at, length))
                free = 1 if not at else at + length
                break
    return found


def encode_wav(payload: bytes) -> bytes:
    """Bytes as the samples of an 8-bit mono sound."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def read_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono sound."""
    here = 12
    while here + 8 <= len(media):
        name, size = media[here : here + 4], struct.unpack_from("<I", media, here + 4)[0]
        if name == b"data":
            return media[here + 8 : here + 8 + size]
        here += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def _batches(rows, names, kinds):
    """Record batches of rows whose last binary value keeps them to a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= 4 * STEP_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def texts_as_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as a sound. Null is empty."""
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text"):
            kind = batch.schema.field("id").type
            texts = (t.encode() for t in texts_of(batch, "text"))
            yield from _batches(((i, len(t), encode_wav(padded(t))) for i, t in zip(batch.column("id").to_pylist(), texts)), ["id", "n_bytes", "media"], [kind, pa.int64(), pa.binary()])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def sniff_media(df: DataFrame, id_column: str, media_column: str, declared_column: str | None = None, keep_carved: bool = True) -> DataFrame:
    """Sniff a column of binary values.

    Returns the id, ``media_type`` (the MIME type of what starts at the first byte, with its whole
    structure confirmed, else the declared one, else ``application/octet-stream``), ``corrected``
    (it differs from the declared one) and ``carved``, an array of (type, start, length, bytes) of
    media inside. Null values give the declared type and nothing carved. No shuffle.
    """
    declared = F.col(declared_column).cast("string") if declared_column else F.lit(None).cast("string")
    source = df.select(F.col(id_column).alias("id"), declared.alias("declared"), F.col(media_column).cast("binary").alias("media"))
    carved = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))

    def run(batches):
        for batch in sliced(batches, "media"):
            types, differ, inside = [], [], []
            for told, data in zip(batch.column("declared").to_pylist(), batch.column("media").to_pylist()):
                found = sniff(data or b"")
                whole = MIME[found[0][0]] if found and not found[0][1] else told or "application/octet-stream"
                types.append(whole)
                differ.append(told is not None and told != whole)
                inside.append([{"type": MIME[n], "start": a, "length": k, "bytes": data[a : a + k] if keep_carved else None} for n, a, k in found if a])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(types, pa.string()), pa.array(differ, pa.bool_()), pa.array(inside, carved)], names=[id_column, "media_type", "corrected", "carved"])

    return source.mapInArrow(run, f"`{id_column}` {source.schema['id'].dataType.simpleString()}, media_type string, corrected boolean, carved array<struct<type:string,start:bigint,length:bigint,bytes:binary>>")


def feature(media: bytes, samples: bytes) -> str:
    """What the stored bytes tell: type, length, carved media, and the level and spread of the samples."""
    found = sniff(media)
    name, _, length = found[0] if found and not found[0][1] else ("unknown", 0, len(media))
    values = np.frombuffer(samples, np.uint8)
    inside = "+".join(f"{n}@{a}:{k}" for n, a, k in found if a) or "none"
    counts = np.bincount(values >> 4, minlength=16)
    return f"{name};{length};{inside};mean={values.mean():.4f};std={values.std():.4f};levels={'.'.join(map(str, counts))}"


def media_round_trip(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store each text as a sound in a written table, read the stored bytes back, sniff and describe them.

    Returns the id, ``n_bytes``, ``payload_bytes``, ``payload_sha256`` and ``tail_crc32`` (of the
    payload read back), ``media_bytes``, ``media_sha256`` and ``feature``. Null and empty texts are 64
    zero bytes; rows may repeat; other columns are dropped. Stored bytes whose sniffed type isn't a
    sound, or whose length is wrong, raise an error.
    """
    stored = written(texts_as_media(df, id_column, text_column), "media")

    def run(batches):
        for batch in sliced(batches, "media"):
            rows = []
            for n, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                told = feature(media, payload := read_wav(media))
                if not told.startswith(f"wav;{len(media)};"):
                    raise ValueError("stored bytes are no sound of their length")
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), told))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, f"`{id_column}` {stored.schema['id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
