"""Near duplicates against all pairs of full sets."""

import os
import random
import re

import numpy as np
import pytest
from stratalens.llm import neardup


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(top(i), -1), d is not None and d == least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def run(spark, rows, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'k' AS key", "0 AS comp")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in neardup.near_duplicates(df, percent).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    text = lambda k: [f"w{rng.randrange(900)}" for _ in range(k)]
    shared, out = text(60), []
    for _ in range(n):
        base = text(rng.choice([3, 5, 40, 200]))
        if rng.random() < 0.3:
            base += shared
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "edit"
            out.append(" ".join(own).replace("w1", rng.choice(["w1", "W1"])))
    return out


def test_set_against_plain_python():
    for text in [*corpus(1, 30), "", " \t\n", "A b", "é É x y z é", "a\x0bb\x1cc d e f g"]:
        assert len(neardup.shingle_set(text.encode())) == len(sets_of(text))


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    words = [f"word{i % 977}" for i in range(40_000)] + ["x" * 511, "y" * 512, "Z" * 513, "q" * 200_000, "end"]
    random.Random(5).shuffle(words)
    got = neardup._word_hashes("  ".join(words).encode())
    by = {}
    for w, h in zip(words, got.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert neardup._word_hashes(("z" * 513).encode())[0] == by["Z" * 513]
    # strings that collide under any polynomial modulo 2^64
    morse = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("ab"[x ^ k] for x in morse) for k in (0, 1))
    assert neardup._word_hashes(a.encode())[0] != neardup._word_hashes(b.encode())[0]


def test_estimates_and_branches():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    x, y = neardup.signature(a), neardup.signature(a[:900])
    assert 48 <= (x == y).sum() <= 64
    rows, nodes = neardup.children(np.array([5, 5, 6], np.uint64), np.array([x, x, y]), 46)
    assert sorted(nodes[rows == 0].tolist()) == sorted(nodes[rows == 1].tolist())


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (9, "one  TWO"), (5, "one two three four five"), (6, long), (7, long + " end"), (7, "one two"), (8, long), (None, long), (None, "alone in the world with no id"), (4, "one two")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_what_is_kept_of_every_document_is_smaller_than_its_text(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(800)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=1500))) for i in range(200)]
    kept, _ = neardup.classes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    bytes_kept = sum(os.path.getsize(f.removeprefix("file:").replace("//", "")) for f in kept.inputFiles())
    assert 0 < bytes_kept < 0.8 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("limit", [512, 6])
def test_against_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "LIMIT", limit)
    rows = list(enumerate(corpus(limit)))
    base = [f"h{i}" for i in range(150)]
    for i in range(60):  # a large group, each copy edited elsewhere
        own = list(base)
        own[i * 2] = f"edit{i}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    assert run(spark, rows) == brute(rows)


def test_other_thresholds(spark):
    rows = list(enumerate(corpus(77, 150)))
    for percent in (80, 95):
        assert run(spark, rows, percent) == brute(rows, percent)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.a: r.b for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {v: top(v) for v in parent if top(v) != v}
