"""Reports over findings and files."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import reports


def related(rows, same_dir=0.25, same_token=0.4, top=10):
    """By all pairs."""
    out = []
    for f in {r[0] for r in rows if r[0]}:
        best = {}
        for _, d, t in (r for r in rows if r[0] == f):
            for o, od, ot in rows:
                if o and o != f and ((d and d == od) or (t and t == ot)):
                    s = (same_dir if d and d == od else 0) + (same_token if t and t == ot else 0)
                    best[o] = max(best.get(o, 0), int(s * 100 + 0.5) / 100)
        out += [(f, o, s) for o, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]]
    return sorted(out)


@pytest.mark.parametrize("weights", [(0.25, 0.4), (0.4, 0.25), (0.3, 0.3)])
def test_related_files_as_by_all_pairs(spark, weights):
    r = random.Random(7)
    names = [f"f{i}" for i in range(120)] + [None]
    rows = [(r.choice(names), r.choice(["a", "a", "a", "b", "c", None]), r.choice(["x", "x", "y", "z", "q", "w", None])) for _ in range(170)]
    rows += [("lone", "only", "here"), ("bare", None, None), ("f1", "a", "x"), ("f1", "a", "x")]
    got = reports.related_files(spark.createDataFrame(rows, "file string, dir string, token string"), *weights, salts=3)
    assert sorted(map(tuple, got.collect())) == related(rows, *weights)


def test_related_files_sums_up_no_pairs(spark):
    """No row per pair goes through an aggregation or a sort: their memory grew with 33 rows a file."""
    files = spark.range(50).select(F.col("id").cast("string").alias("file"), F.lit("d").alias("dir"), F.lit("t").alias("token"))
    plan = str(reports.related_files(files)._jdf.queryExecution().optimizedPlan()).splitlines()
    top = next(i for i, x in enumerate(plan) if "Generate explode" in x)
    assert not any(x in "".join(plan[:top]) for x in ("Aggregate", "Window", "Sort", "Join"))
