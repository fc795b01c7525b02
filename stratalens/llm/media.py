"""Media columns: storing bytes in media containers, and sniffing what a media column holds.

sniff() finds magic bytes with one Aho-Corasick automaton over the whole value and asks a
validator at every hit whether a structure of that format begins there, and how long it is.
The type of a value is that of the structure at its first byte, whatever its declared type
says; structures further inside are embedded media, which carve() cuts out. Structures within
another found structure belong to it.

A null or empty value has type "" and nothing embedded; bytes without a valid structure are
"application/octet-stream". A null declared type is never right.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

UNIT = 576
OTHER = "application/octet-stream"


# Validators: (data, start) -> end of the structure, or 0 if there is none.


def _png(d: bytes, i: int) -> int:
    at, first = i + 8, True
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or (first and (kind, n) != (b"IHDR", 13)):
            return 0
        if zlib.crc32(d[at + 4 : at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return 0


def _gif(d: bytes, i: int) -> int:
    try:
        at = i + 13 + (3 << (d[i + 10] & 7) + 1 if d[i + 10] & 128 else 0)
        while True:
            kind = d[at]
            if kind == 0x3B:
                return at + 1
            if kind == 0x21:
                at += 2
            elif kind == 0x2C:
                at += 11 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 128 else 0)
            else:
                return 0
            while d[at]:
                at += d[at] + 1
            at += 1
    except IndexError:
        return 0


def _jpeg(d: bytes, i: int) -> int:
    at, frame = i + 2, False
    while at + 2 <= len(d) and d[at] == 0xFF:
        marker = d[at + 1]
        if marker == 0xD9:
            return at + 2 if frame else 0
        if at + 4 > len(d):
            return 0
        n = struct.unpack_from(">H", d, at + 2)[0]
        if n < 2 or marker in (0, 0xFF):
            return 0
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if marker == 0xDA:  # the scan's data end at a marker that is neither stuffing nor a restart
            while (at := d.find(b"\xff", at)) >= 0 and at + 1 < len(d) and (d[at + 1] == 0 or 0xD0 <= d[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return 0
    return 0


def _bmp(d: bytes, i: int) -> int:
    if i + 54 > len(d):
        return 0
    size, zero, pixels, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, i + 2)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return 0
    return i + size if pixels + -(-width * depth // 32) * 4 * abs(height) == size and i + size <= len(d) else 0


def _riff(d: bytes, i: int) -> int:
    if i + 12 > len(d):
        return 0
    end, at = i + 8 + struct.unpack_from("<I", d, i + 4)[0], i + 12
    if end > len(d) or d[i + 8 : i + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    while at + 8 <= end:
        n = struct.unpack_from("<I", d, at + 4)[0]
        at += 8 + n + n % 2
    return end if at in (end, end + 1) else 0


def _au(d: bytes, i: int) -> int:
    if i + 24 > len(d):
        return 0
    head, n, encoding, rate, channels = struct.unpack_from(">IIIII", d, i + 4)
    return i + head + n if 24 <= head < 1 << 16 and 1 <= encoding <= 27 and 0 < rate < 1 << 20 and 0 < channels < 256 and i + head + n <= len(d) else 0


def _pgm(d: bytes, i: int) -> int:
    fields = d[i + 3 : i + 40].split(b"\n", 2)
    size = fields[0].split()
    if len(fields) < 3 or len(size) != 2 or not all(x.isdigit() for x in (*size, fields[1])) or not 0 < int(fields[1]) < 256:
        return 0
    end = i + 3 + len(fields[0]) + len(fields[1]) + 2 + int(size[0]) * int(size[1])
    return end if end <= len(d) else 0


def _gzip(d: bytes, i: int) -> int:
    z = zlib.decompressobj(31)
    try:
        at = i
        while at < len(d) and not z.eof:
            z.decompress(d[at : at + 65536])
            at += 65536
        return min(at, len(d)) - len(z.unused_data) if z.eof else 0
    except zlib.error:
        return 0


class _Marks:
    """Where end marks stand in the value at hand, looked up once per value; many begin marks would search the rest again and again."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.known:
            out, at = [], self.data.find(mark)
            while at >= 0:
                out.append(at)
                at = self.data.find(mark, at + len(mark))
            self.known[mark] = out
        return self.known[mark]

    def archives(self) -> dict[int, int]:
        """End by start of every central directory end that says where its archive begins; the first one of equal starts."""
        if b"archives" not in self.known:
            found: dict[int, int] = {}
            for at in self.places(b"PK\5\6"):
                if at + 22 <= len(self.data):
                    size, offset, note = struct.unpack_from("<IIH", self.data, at + 12)
                    if at + 22 + note <= len(self.data):
                        found.setdefault(at - size - offset, at + 22 + note)
            self.known[b"archives"] = found
        return self.known[b"archives"]


_marks: list[_Marks] = []


def _marks_of(d: bytes) -> _Marks:
    if not _marks or _marks[0].data is not d:
        _marks[:] = [_Marks(d)]
    return _marks[0]


def _zip(d: bytes, i: int) -> int:
    return _marks_of(d).archives().get(i, 0)


def _pdf(d: bytes, i: int) -> int:
    marks = _marks_of(d)
    ends, begins, tables = (marks.places(m) for m in (b"%%EOF", b"%PDF-", b"startxref"))
    k = bisect_left(ends, i)
    if k == len(ends):
        return 0
    # later ends belong to the same document as long as no other begins before them
    n = bisect_left(begins, ends[k])
    end = ends[bisect_left(ends, begins[n]) - 1] if n < len(begins) else ends[-1]
    t = bisect_left(tables, i)
    return end + 5 if t < len(tables) and tables[t] < end else 0


def _ogg(d: bytes, i: int) -> int:
    at = i
    while at + 27 <= len(d) and d[at : at + 5] == b"OggS\0" and at + 27 + d[at + 26] <= len(d):
        at += 27 + d[at + 26] + sum(d[at + 27 : at + 27 + d[at + 26]])
    return at if i < at <= len(d) else 0


def _flac(d: bytes, i: int) -> int:
    at, last = i + 4, False
    while not last and at + 4 <= len(d):
        last, kind, n = bool(d[at] & 128), d[at] & 127, int.from_bytes(d[at + 1 : at + 4], "big")
        if kind > 6 or (at == i + 4 and (kind, n) != (0, 34)):
            return 0
        at += 4 + n
    return len(d) if last and at <= len(d) else 0


def _mp4(d: bytes, i: int) -> int:
    at, n = i, 0
    while at + 8 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, at)
        if size < 8 or at + size > len(d) or not kind.isalnum():
            break
        at, n = at + size, n + 1
    return at if n > 1 else 0


#: (magic, bytes before it, type, validator)
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png), (b"GIF87a", 0, "image/gif", _gif), (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg), (b"BM", 0, "image/bmp", _bmp), (b"RIFF", 0, "audio/wav", _riff),
    (b".snd", 0, "audio/basic", _au), (b"P5\n", 0, "image/x-portable-graymap", _pgm), (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\3\4", 0, "application/zip", _zip), (b"%PDF-", 0, "application/pdf", _pdf), (b"OggS\0\2", 0, "audio/ogg", _ogg),
    (b"fLaC", 0, "audio/flac", _flac), (b"ftyp", 4, "video/mp4", _mp4),
]
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
_automaton = ahocorasick.Automaton()
for _k, (_magic, *_) in enumerate(FORMATS):
    _automaton.add_word(_magic.decode("latin-1"), _k)
_automaton.make_automaton()


@dataclass
class Found:
    kind: str
    start: int
    end: int


def structures(data: bytes) -> list[Found]:
    """The outermost valid structures of a value, in order."""
    hits = []
    for last, k in _automaton.iter(data.decode("latin-1")):
        magic, before, _, _ = FORMATS[k]
        if (start := last + 1 - len(magic) - before) >= 0:
            hits.append((start, k))
    out, end = [], 0
    for start, k in sorted(hits):
        if start >= end and (stop := FORMATS[k][3](data, start)):
            kind = FORMATS[k][2] if FORMATS[k][0] != b"RIFF" else _RIFF[data[start + 8 : start + 12]]
            out.append(Found(kind, start, stop))
            end = stop
    _marks.clear()
    return out


def sniff(data: bytes | None, declared: str | None = None) -> tuple[str, bool, list[Found]]:
    """(type, whether the declared one was right, embedded media)."""
    if not data:
        return "", (declared or "") == "", []
    found = structures(data)
    kind = found[0].kind if found and found[0].start == 0 else OTHER
    return kind, kind == declared, [f for f in found if f.start]


def carve(data: bytes) -> list[tuple[str, bytes]]:
    """Every medium of a value: (type, its bytes)."""
    return [(f.kind, data[f.start : f.end]) for f in structures(data)]


def sniff_column(df: DataFrame, column: str, declared: str) -> DataFrame:
    """`df` with media_type, declared_right and embedded (type, start, length) of a binary column; other columns stay."""

    @F.pandas_udf("media_type string, declared_right boolean, embedded array<struct<type: string, start: long, length: long>>")
    def of(values, kinds):
        import pandas as pd

        got = [sniff(None if v is None else bytes(v), k) for v, k in zip(values, kinds, strict=True)]
        return pd.DataFrame({"media_type": [g[0] for g in got], "declared_right": [g[1] for g in got], "embedded": [[(f.kind, f.start, f.end - f.start) for f in g[2]] for g in got]})

    return df.withColumn("_m", of(F.col(column), F.col(declared).cast("string"))).select(*[c for c in df.columns if c not in ("media_type", "declared_right", "embedded")], "_m.*")


# Storing payloads as 8-bit samples.


def payload(text: str | None) -> bytes:
    """The text's UTF-8 with bytes 255 up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8")
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def to_png(data: bytes, width: int = UNIT) -> bytes:
    """8-bit grey PNG, `width` samples a row."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + data[i : i + width] for i in range(0, len(data), width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(data) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    at, body = 8, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", media, at + 8)[0]
        elif kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = zlib.decompress(b"".join(body))
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def to_wav(data: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM WAV."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(head) + len(data)) + head + data


def from_wav(media: bytes) -> bytes:
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def to_bmp(data: bytes, width: int = UNIT) -> bytes:
    """8-bit BMP with a grey palette, rows from the top."""
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    return b"BM" + struct.pack("<III", start + len(data), 0, start) + struct.pack("<IiiHHIIiiII", 40, width, -(len(data) // width), 1, 8, 0, len(data), 2835, 2835, 256, 0) + palette + data


def from_bmp(media: bytes) -> bytes:
    return media[struct.unpack_from("<I", media, 10)[0] :]


CODECS = {"image/png": (to_png, from_png), "audio/wav": (to_wav, from_wav), "image/bmp": (to_bmp, from_bmp)}
_FIELDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "media": pa.binary(), "declared": pa.string()}
#: What a message puts before and after a medium that it carries.
HEAD, TAIL = b"content-transfer: binary\r\n\r\n", b"\r\n--\r\n"


def stored_form(data: bytes) -> tuple[bytes, str | None]:
    """(a payload's stored form, the type that a careless source declares).

    Container, declaration and envelope follow from the payload's checksum, so equal texts are
    stored alike: one of the CODECS; its right type, another one, none or OTHER; and for one in
    four the medium stands inside a message.
    """
    kinds, crc = list(CODECS), zlib.crc32(data)
    k, how, inside = crc % len(kinds), crc // 3 % 4, crc // 12 % 4 == 0
    medium = CODECS[kinds[k]][0](data)
    return HEAD + medium + TAIL if inside else medium, [kinds[k], kinds[(k + 1) % len(kinds)], None, OTHER][how]


def store(docs: DataFrame) -> DataFrame:
    """Every text's payload as a medium: doc_id, n_bytes, media binary, declared (for sniffing to confirm or correct).

    Rows repeat as they do in `docs`; null texts are stored as empty ones. Only doc_id and text are read.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                out = []
                for doc_id, text in zip(*(c.to_pylist() for c in big.slice(lo, 200).columns), strict=True):
                    out.append((doc_id, len((text or "").encode("utf-8")), *stored_form(payload(text))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FIELDS.values(), strict=True)], list(_FIELDS))

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_bytes long, media binary, declared string")


_READ = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media_type": pa.string(), "embedded": pa.int64()}


def decoded(data: bytes, declared: str | None) -> tuple[bytes, str, str, int]:
    """(payload, type, feature, embedded media) of stored bytes.

    The validator's structure says where the medium begins and ends: at the first byte, or else the
    first one carved out of what surrounds it. Bytes without a structure that CODECS reads are the
    payload themselves. feature: type;declared, corrected or undeclared;bytes of the
    structure;embedded ones.
    """
    found = structures(data)
    kind = found[0].kind if found and found[0].start == 0 else "" if not data else OTHER
    inside = [f for f in found if f.start]
    medium = next((f for f in found if f.kind in CODECS), None)
    got = CODECS[medium.kind][1](data[medium.start : medium.end]) if medium else data
    said = "undeclared" if declared is None else "declared" if declared == kind else "corrected"
    size = medium.end - medium.start if medium else len(data)
    return got, kind, f"{kind};{said};{size};" + ",".join(f"{f.kind}@{f.start}+{f.end - f.start}" for f in inside), len(inside)


def read_back(media: DataFrame, tail: int = 32) -> DataFrame:
    """Sniffs, carves and decodes stored payloads: digests of what was read, and what was found (see decoded())."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                out = []
                for doc_id, n, data, declared in zip(*(c.to_pylist() for c in big.slice(lo, 200).columns), strict=True):
                    got, kind, feature, inside = decoded(data, declared)
                    out.append((doc_id, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-tail:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, inside))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ.values(), strict=True)], list(_READ))

    names = {pa.int64(): "long", pa.string(): "string"}
    return in_arrow(media.select("doc_id", "n_bytes", "media", "declared"), rows, ", ".join(f"{k} {names[t]}" for k, t in _READ.items()))
