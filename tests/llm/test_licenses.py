"""License scan against plain Python, and inheritance along paths."""

import math
import random
import re
from collections import Counter

from oracle import compare, connect
from stratalens.llm import licenses, queries


def nearest(text, side=0):
    """The cosine and name of the template nearest to a text, from the definition."""
    *sides, idf, other = licenses.vectors()
    c = Counter(t for t in re.split("[^a-z0-9]+", text.lower()) if t and t not in licenses.PROSE)
    own = {t: n * idf.get(t, other) for t, n in c.items()}
    size = math.sqrt(sum(x * x for x in own.values()))
    return max((sum(own.get(t, 0) * w for t, w in u.items()) / size if size else 0.0, k) for k, u in sides[side].items())


def whole(text, path=None):
    """(best of the runs that count or None, share of lines covered), without any filter."""
    lines = [x for x in re.split(r"\r\n|\n|\r", text or "") if x.strip(" ")]
    good = {(i, k): nearest(" ".join(lines[i : i + k])) for k in range(1, licenses.WRAP + 1) for i in range(len(lines) - k + 1)}
    good = {at: b for at, b in good.items() if b[0] >= licenses.THRESHOLD}
    lone = {i for i, k in good if k == 1}
    hits = {(i, k): b for (i, k), b in good.items() if k == 1 or not lone & set(range(i, i + k))}
    covered = {i + j for i, k in hits for j in range(k)}
    best = list(hits.values())
    if path and re.search(licenses._LICENSE_FILE, path) and (b := nearest(text or "", 1))[0] >= licenses.THRESHOLD:
        best.append(b)
    return max(best, default=None), len(covered) / len(lines) if lines else 0.0


def check(rows, texts, paths=None):
    hits = 0
    for r in rows:
        want, share = whole(texts[r.doc_id], paths and paths[r.doc_id])
        assert abs(r._share - share) < 1e-9, texts[r.doc_id]
        assert (r._own is None) == (want is None), texts[r.doc_id]
        if want:
            hits += 1
            assert abs(r._own.cosine - want[0]) < 1e-9 and r._own.license == want[1]
    return hits


LINES = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "# Redistribution and use in source and binary forms, with or without", "driving license of the mayor was reserved for use", "All rights reserved. Proprietary and confidential.", "license license license"]


def test_cosines(spark):
    texts = [f"prose\n\n{line}\r\nmore" for line in LINES] + ["// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy\n", "Redistribution and use in\nsource and binary forms,\nwith or without modification\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(licenses.scan(df).collect(), texts) >= 7
    assert nearest(LINES[0])[0] > 0.99 and nearest(LINES[5])[0] < licenses.THRESHOLD
    assert whole(texts[-1])[0][1] == "BSD-3-Clause" and whole(texts[-2])[0][1] == "MPL-2.0"


def test_license_files_are_compared_whole(spark):
    texts = [v if i % 2 else v.replace(" ", "\n", 40).upper() for i, v in enumerate(licenses.TEXTS.values())] + ["notes of the day", "", None]
    paths = [f"p{i}/LICENSE" for i in range(len(licenses.TEXTS))] + ["x/COPYING", "y/NOTICE", "z/LICENSE"]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, paths, strict=True)), "doc_id long, text string, path string")
    rows = licenses.scan(df).collect()
    check(rows, texts, paths)
    got = {r.doc_id: r._own for r in rows}
    assert [got[i].license for i in range(len(licenses.TEXTS))] == list(licenses.TEXTS)
    assert got[len(licenses.TEXTS)] is None


def test_long_lines(spark):
    line = "word " * 60_000 + "licensed under the apache license, version 2.0 " * 3
    df = spark.createDataFrame([(0, line), (1, line + "\n" + LINES[0]), (2, "license " * 50_000)], "doc_id long, text string")
    assert check(licenses.scan(df).collect(), {0: line, 1: line + "\n" + LINES[0], 2: "license " * 50_000}) == 1


def test_inheritance(spark):
    rows = [("a/LICENSE", LINES[0]), ("a/b/c/x.py", "code"), ("a/b/COPYING", LINES[2]), ("a/y.py", ""), ("z.py", None), ("a/b/own.py", "# " + LINES[1] + "\nx\ny\nz"), (None, "x"), ("ab/q.py", "x"), ("a/y.py", ""), ("d/only.txt", LINES[3]), ("d/e/f.txt", "t")]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS license", "2 AS _extra", "3 AS row", "4 AS dir", "5 AS own", "6 AS lines", "7 AS low", "8 AS n", "9 AS _own")
    got = {}
    for r in licenses.inherit(licenses.scan(df)).collect():
        got.setdefault(r.path, []).append((r.license, r.origin, r.license_dir))
    assert got["a/b/c/x.py"] == [("MIT", "directory", "a/b")]
    assert got["a/y.py"] == [("Apache-2.0", "directory", "a")] * 2
    assert got["a/b/own.py"] == [("GPL-3.0", "own", None)]
    assert got["z.py"] == got[None] == got["ab/q.py"] == [(None, "none", None)]
    assert got["d/e/f.txt"] == [("CC-BY-NC-4.0", "directory", "d")]


def test_whole_table_against_sql(spark):
    compare(spark, connect("/root/testdata/sf0.01"), "op6", queries.op6_licenses, licenses.oracle(), "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert licenses.report(docs.limit(0)).count() == 0


#: Near a template without any of the words license, licensed, redistribution, permission, reserved, redistribute, cc by.
UNNAMED = ["Unauthorized copying of this file, via any medium is strictly prohibited", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential", "Released under the MIT licence.", "with or without modification, are permitted provided that the following conditions are met:"]


def test_every_line_counts(spark):
    rng = random.Random(4)
    terms = sorted(licenses.vectors()[2])
    lines = UNNAMED + ["-----", "mit der", "the the the of"]
    for _ in range(600):  # runs of template words among other words, some many times
        words = rng.choice(list(licenses.HEADERS.values())).split()
        at = rng.randrange(len(words))
        line = words[at : at + rng.randrange(1, 30)] + [rng.choice(["x", "y", "z", rng.choice(terms)]) for _ in range(rng.randrange(12))] * rng.choice([1, 1, 3])
        rng.shuffle(line)
        for _ in range(rng.choice([0, 0, 1, 2])):
            line.insert(rng.randrange(len(line) + 1), "\n")
        lines.append(" ".join(line))
    hits = check(licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect(), lines)
    assert 50 < hits < len(lines) - 50
    assert [whole(x)[0][1] for x in UNNAMED] == ["Proprietary", "Proprietary", "MIT (short)", "BSD-3-Clause"]
