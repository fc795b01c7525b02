"""Ids, packed shards and packed sequences against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from stratalens.llm import bitpack, packing
from stratalens.llm.common import new_path
from stratalens.llm.tokens import default_path, encoder

ODD = [None, "", "a  b", " a", "a ", "\n\nx y\n", "it's <|endoftext|> x", "x ", "12 ab34%% 漢字 😀 ok\t\tb", "a\n b", "é" * 3000, "word, " * 900, "same text", "same text"]


def ids(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS n", "'x' AS ids", "2 AS base") if extra else df


ROWS = [(i, t, "en", None if i % 5 == 3 else f"s{i % 2}", 0) for i, t in enumerate(ODD)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é'sS1%,. \n\t 漢😀"), max_size=40))
def test_encoder_equals_library(text):
    got = np.frombuffer(encoder(default_path()).encode(text), "<u2").tolist()
    assert got == encoder(default_path()).tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_pack_round_trip(bits, values):
    x = np.array([v % (1 << bits) for v in values], np.uint32)
    data = bitpack.pack(x, bits)
    assert len(data) == (len(x) * bits + 7) // 8
    assert bitpack.unpack(data, bits, len(x)).tolist() == x.tolist()


def test_random_access():
    x = np.arange(10_000) * 7 % 50_000
    shard = bitpack.Shard(bitpack.image([5, 9], [4_000, 6_000], x, 17, block=64))
    assert shard.document(1).tolist() == x[4_000:].tolist()
    assert shard.ids(130, 190).tolist() == x[130:190].tolist()


def test_bitpack_query(spark, tmp_path):
    rows = [*ROWS, (None, "no id", "en", "s0", 0), (3, "twice the id", "en", "s0", 0)]
    bitpack.write_files(bitpack.write_shards(frame(spark, rows, True), shard_ids=50), f"file://{tmp_path}/shards")
    files = sorted((tmp_path / "shards").glob("part-*"))
    shards = [bitpack.Shard(f.read_bytes()) for f in files]
    assert len(shards) > 3 and all(s.bits == 16 for s in shards)
    assert sorted(d for s in shards for d in s.doc_ids.tolist()) == sorted(bitpack.NO_ID if r[0] is None else r[0] for r in rows)
    got = sorted(bitpack.read_documents(bitpack.read_files(spark, f"file://{tmp_path}/shards")).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    left = [(d, len(x), crc(x)) for d, t, *_ in rows for x in [ids(t)]]
    for r in got:
        assert r.start == at
        left.remove((r.doc_id, r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not left


def test_a_cut_shard_is_refused():
    data = bitpack.image([1], [3], np.array([7, 8, 9]), 16)
    for bad in (data[:-1], data[:-2] + b"\n\n"[:1], b"x" + data[1:]):
        with pytest.raises(ValueError):
            bitpack.Shard(bad)


def test_more_sources_than_queues(spark):
    rows = [(i, f"word {i}", "en", f"host{i}", 0) for i in range(300)]
    got = packing.pack_documents(frame(spark, rows), 64, {"host1": 0.5}).collect()
    assert len({r.source for r in got}) <= packing.QUEUES and "host1" in {r.source for r in got}
    assert {r.doc_id for r in got} == set(range(300))


@pytest.mark.parametrize("target", [None, {"s0": 0.7, "s1": 0.3}])
def test_packing(spark, target):
    got = packing.pack_documents(frame(spark, ROWS, True).repartition(3), 64, target).collect()
    held, seen = {}, {}
    for r in got:
        want = ids(ROWS[r.doc_id][1])
        assert r.doc_tokens == len(want)
        assert r.ids_crc32 == crc(want[r.start : r.start + r.length])
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for pieces, total in [*((v, None) for v in held.values()), *((v, len(ids(ROWS[k][1]))) for k, v in seen.items())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == total if total else at <= 64
    assert set(seen) == set(range(len(ROWS))) and set(held) == set(range(len(held)))
    assert sum(sum(n for _, n in v) < 64 for v in held.values()) <= 1


def test_windows_keep_the_shares():
    totals = {"hot": 400_000} | {f"s{i}": 40_000 for i in range(10)}
    phases = packing.schedule(totals)
    filled = {}
    for s, n in totals.items():
        for _, size, w, _ in packing.pieces(phases, s, 0, n):
            filled.setdefault(w // 32, {}).setdefault(s, 0)
            filled[w // 32][s] += size
    for k in range(20):
        assert abs(filled[k]["hot"] / 32_768 - 0.5) < 0.001


def test_empty(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none).count() == 0
    path = new_path(spark, "t")
    bitpack.write_files(bitpack.write_shards(none), path)
    assert bitpack.read_documents(bitpack.read_files(spark, path)).count() == 0
