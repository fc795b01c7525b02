"""Drift rules on literal rows."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalens.operators import drift
from stratalens.plans import ORACLES, QUERIES


def parallel(rows, least):
    """By all pairs of rows."""
    n = Counter()
    for a, ra, ta in rows:
        for b, rb, tb in rows:
            if a and b and ra and rb and a < b and ra != rb:
                n[a, b] += len({t for t in ta if t is not None} & {t for t in tb if t is not None})
    return sorted((a, b, k) for (a, b), k in n.items() if k >= max(least, 1))


@pytest.mark.parametrize("least", [0, 1, 2, 3, 4])
def test_parallel_destinations_as_by_all_pairs(spark, least):
    r = random.Random(least)
    words = ["", "hot", "hot", "hot", "red", "old", "new", "ring", "bolt", "rod", None]
    rows = [(f"r{i}", r.choice(["a", "a", "b", "c"]), [r.choice(words) for _ in range(r.randrange(8))]) for i in range(90)]
    rows += [(f"long{i}", "ab"[i % 2], [f"w{k}" for k in range(i, i + 20 + i)] + ["hot", "red"]) for i in range(0, 24, 3)]
    rows += [("r1", "b", ["hot", "red"]), ("r1", "c", ["hot"]), ("r2", "a", ["red"]), ("r2", "a", ["red"]), (None, "a", ["hot", "red", "old"]), ("nil", None, ["hot", "red", "old"])]
    got = drift.parallel_destinations(spark.createDataFrame(rows, "route string, root string, tokens array<string>"), least)
    assert sorted(map(tuple, got.collect())) == parallel(rows, least)


def test_parallel_destinations_of_one_large_set(spark):
    rows = spark.range(1300).select(F.col("id").cast("string").alias("route"), (F.col("id") % 2).cast("string").alias("root"), F.array(F.lit("hot"), F.lit("rod")).alias("tokens"))
    df = drift.parallel_destinations(rows)
    assert df.count() == df.distinct().count() == 650 * 650


def test_parallel_destinations_sum_up_no_pairs(spark):
    """Routes that share few tokens pass no aggregation as pairs: 200 routes share 'hot', and none shares two."""
    rows = spark.range(200).select(F.col("id").cast("string").alias("route"), F.col("id").cast("string").alias("root"), F.array(F.lit("hot"), F.concat(F.lit("w"), F.col("id"))).alias("tokens"))
    df = drift.parallel_destinations(rows)
    assert df.count() == 0
    made = []

    def walk(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    df = drift.parallel_destinations(rows)
    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    assert max(made, default=0) <= 400 * 8


def test_parallel_destination_of_parts_without_names(spark, tmp_path):
    con = duckdb.connect()
    con.execute("""CREATE TABLE part AS SELECT * FROM (VALUES (1, 'hot ring', 'A', 'LARGE'), (2, 'ring hot', 'B', 'LARGE'), (3, NULL, 'B', 'LARGE HOT RING'), (4, 'hot ring', NULL, 'LARGE'),
        (5, 'hot ring', 'C', NULL), (6, 'hot ring', 'A/LARGE', 'LARGE'), (7, 'LARGE/hot ring', 'A', 'LARGE'), (8, '', 'D', '')) v(p_partkey, p_name, p_brand, p_type)""")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = con.execute(ORACLES["parallel_destination"]).fetchall()
    assert want and sorted(map(tuple, QUERIES["parallel_destination"](spark, str(tmp_path)).collect())) == sorted(want)
