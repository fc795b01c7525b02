"""Sniffing and carving against files made here, and the exact round trip of stored payloads."""

import gzip
import hashlib
import io
import time
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from stratalens.llm import media

GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc0\x00\x05\x08\x00\x01\xff\xda\x00\x03\x01ab\xff\x00cd\xff\xd0x\xff\xd9"
AU = b".snd" + b"".join(n.to_bytes(4, "big") for n in (24, 5, 1, 8000, 1)) + b"hello"
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"


def made_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


FILES = {"image/gif": GIF, "image/jpeg": JPEG, "audio/basic": AU, "application/pdf": PDF, "application/zip": made_zip(), "application/gzip": gzip.compress(b"abc" * 50), "image/png": media.to_png(b"x" * 576), "audio/wav": media.to_wav(b"x" * 10), "image/bmp": media.to_bmp(b"x" * 576), "image/x-portable-graymap": b"P5\n3 2\n255\nabcdef"}


@pytest.mark.parametrize("kind", FILES)
def test_types_and_carving(kind):
    data = FILES[kind]
    assert media.sniff(data, "text/plain") == (kind, False, [])
    assert media.sniff(data, kind)[1]
    around = b"BM RIFF GIF89a" + data + b" PK\3\4 tail"
    assert media.carve(around) == [(kind, data)]
    assert media.sniff(around, kind)[:2] == (media.OTHER, False)
    for cut in range(1, len(data)):
        assert media.structures(data[:-cut])[:1] != [media.Found(kind, 0, len(data))]


def test_embedded_belongs_to_its_container():
    outer = media.to_wav(GIF + b"\0" * (len(GIF) % 2))
    assert media.carve(outer) == [("audio/wav", outer)]


@given(st.text(max_size=1500))
def test_round_trip(text):
    data = media.payload(text)
    assert len(data) % 576 == 0 and data.startswith(text.encode()) and data
    for to, back in media.CODECS.values():
        assert back(to(data)) == data


def test_query(spark):
    texts = [None, "", "x" * 576, "GIF89a PK\3\4 %PDF- BM RIFF", "é" * 100_000, "same", "same"] + [f"text {i} " * (i % 70) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string").selectExpr("*", "'a' AS media", "1 AS n_bytes", "2 AS declared")
    got = media.read_back(media.store(df)).collect()
    assert len(got) == len(texts) + 1
    said, carved = set(), 0
    for r in got:
        data = media.payload("no id" if r.doc_id is None else texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        # the stored form, built here from the checksum of the payload
        crc, kinds = zlib.crc32(data), ["image/png", "audio/wav", "image/bmp"]
        kind = kinds[crc % 3]
        medium = {"image/png": media.to_png, "audio/wav": media.to_wav, "image/bmp": media.to_bmp}[kind](data)
        declared = [kind, kinds[(crc + 1) % 3], None, media.OTHER][crc // 3 % 4]
        form = media.HEAD + medium + media.TAIL if crc // 12 % 4 == 0 else medium
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        seen = media.OTHER if form is not medium else kind
        how = "undeclared" if declared is None else "declared" if declared == seen else "corrected"
        inside = f"{kind}@{len(media.HEAD)}+{len(medium)}" if form is not medium else ""
        assert (r.media_type, r.feature, r.embedded) == (seen, f"{seen};{how};{len(medium)};{inside}", int(form is not medium))
        said.add(how)
        carved += r.embedded
    assert said == {"undeclared", "declared", "corrected"} and 0 < carved < len(got)
    a, b = (r for r in got if r.doc_id in (5, 6))
    assert a[1:] == b[1:]


def test_what_no_codec_reads_is_the_payload():
    assert media.decoded(b"", None) == (b"", "", "undeclared".join([";", ";0;"]), 0)
    assert media.decoded(b"plain", "text/plain")[:2] == (b"plain", media.OTHER)
    assert media.decoded(GIF, "image/gif") == (GIF, "image/gif", f"image/gif;declared;{len(GIF)};", 0)
    assert media.decoded(b"--" + media.to_wav(b"ab"), None)[0] == b"ab"


def test_many_begin_marks_take_linear_time():
    began = time.process_time()
    for data in (b"%PDF-" * 200_000 + b"startxref %%EOF", b"%PDF-" * 200_000, b"PK\3\4" * 200_000 + b"PK\5\6" * 50_000, b"%PDF- %%EOF" * 50_000, b"startxref" * 1000 + b"%PDF-%%EOF" * 50_000):
        media.structures(data)
    assert time.process_time() - began < 10


def test_sniff_column(spark):
    df = spark.createDataFrame([(1, GIF, "image/png"), (2, b"--" + AU, None), (3, None, ""), (4, b"", "x")], "id long, body binary, declared string").withColumn("embedded", __import__("pyspark").sql.functions.lit(0))
    got = {r.id: r for r in media.sniff_column(df, "body", "declared").collect()}
    assert got[1].media_type == "image/gif" and not got[1].declared_right
    assert [tuple(x) for x in got[2].embedded] == [("audio/basic", 2, len(AU))]
    assert got[3].media_type == "" and got[3].declared_right and not got[4].declared_right


def test_empty(spark):
    assert media.read_back(media.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
