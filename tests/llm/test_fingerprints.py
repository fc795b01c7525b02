"""Fingerprints and neighbour comparison against plain Python."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from stratalens.llm import fingerprints as fp

TEXTS = [None, "", "a", "tie", "tie", "x" * 50_000, "The cat sat on the mat. " * 40, "é😀漢 " * 30, "one two three four five six seven eight nine ten"]


def plain(data: bytes) -> str:
    """The same fingerprint, a byte at a time."""
    mask, p, r = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
    mix = lambda x: (y := (x ^ (x >> 31)) * r & mask) ^ (y >> 29)
    value = lambda part: mix(sum((c + 1) * pow(p, k, 1 << 64) for k, c in enumerate(part)) & mask)
    if not data:
        return "3::"
    roll = {e: value(data[e - 7 : e]) >> 16 for e in range(7, len(data) + 1)}
    block = 3
    while sum(v % block == block - 1 for v in roll.values()) >= 64:
        block *= 2

    def letters(size):
        cuts = sorted({0, len(data), *(e for e, v in roll.items() if v % size == size - 1)})
        return "".join(chr(fp.ALPHABET[value(data[a:b]) >> 40 & 63]) for a, b in zip(cuts, cuts[1:], strict=False))

    return f"{block}:{letters(block)}:{letters(2 * block)}"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_fingerprint(data):
    assert fp.fingerprint(data) == plain(data)


@given(st.lists(st.tuples(st.text("abc", max_size=12), st.text("abc", max_size=12)), max_size=5))
def test_edit_distance(pairs):
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + 2 * (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    assert fp.edit_distance(pairs).tolist() == [dist(*p) for p in pairs]


def test_neighbours(spark):
    rows = [(None, "first")] + [(7 * i, t) for i, t in enumerate(TEXTS)] + [(7, "second of the id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS part", "'a' AS first")
    got = {(r.doc_id, r.fingerprint, r.edited_sha256): r for r in fp.compare_neighbours(df.repartition(3)).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    assert len(got) == len(rows)
    for k, (d, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[d, plain(text.encode()) if len(text) < 2000 else fp.fingerprint(text.encode()), hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(text) and r.edited_fingerprint == fp.fingerprint(edited.encode())
        assert r.near_edited == fp.likeness([(r.fingerprint, r.edited_fingerprint)])[0]
        assert r.near_next == fp.likeness([(r.fingerprint, fp.fingerprint(after.encode()))])[0]


def test_likeness():
    a = " ".join(f"word{i * i}" for i in range(900))
    b = " ".join(f"other{i * i * 3}" for i in range(900))
    x, y, z = (fp.fingerprint(t.encode()) for t in (a[:4000], a[:3000] + b[:1000], b[:4000]))
    assert fp.likeness([(x, x), (x, y), (x, z)])[0] == 1
    assert fp.likeness([(x, y)])[0] > 0.4 > fp.likeness([(x, z)])[0]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compare_neighbours(none).count() == 0
    one = fp.compare_neighbours(spark.createDataFrame([(1, "abcd")], none.schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fp.add_fingerprints(none).count() == 0
