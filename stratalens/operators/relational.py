"""Relational building blocks: DataFrame in, DataFrame out; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_per_key(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The row with the latest `ts` of each key; of equal ones the last by `seq`."""
    return first_per_key(df, key, F.col(ts).desc(), F.col(seq).desc())


def classify_sets(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """Every key of either side with its status: new, fixed or unchanged. Sides must be unique by key."""
    b, h = base.select(key, F.lit(1).alias("_b")), head.select(key, F.lit(1).alias("_h"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_h").isNull(), "fixed").otherwise("unchanged")
    return b.join(h, key, "full_outer").select(key, status.alias("status"))


def islands(df: DataFrame, part: list[str], pos: str) -> DataFrame:
    """Maximal runs of consecutive `pos` within `part`: first, last, length."""
    w = Window.partitionBy(*part).orderBy(pos)
    return df.withColumn("_g", F.col(pos) - F.row_number().over(w)).groupBy(*part, "_g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length")).drop("_g")


def midrank(df: DataFrame, value: str, out: str = "quartile") -> DataFrame:
    """Mid-rank percentile of tie blocks, snapped to quarters; fewer than four rows keep their value.

    Tie blocks are counted first, so the only global window runs over distinct values.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    pct = (2 * F.col("_before") + F.col("_c")) / (2 * F.col("_n"))
    snapped = F.when(pct < 0.25, 0.0).when(pct < 0.4375, 0.25).when(pct < 0.5625, 0.5).when(pct < 0.75, 0.75).otherwise(1.0)
    ranked = ranked.select(value, F.when(F.col("_n") < 4, F.col(value).cast("double")).otherwise(snapped).alias(out))
    return df.join(ranked, value)


def floor_index_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row: the value at index floor(p * (n - 1)) of the sorted values, by counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    ends = counts.withColumn("_end", F.sum("_c").over(Window.orderBy(value))).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    return ends.where(F.col("_end") > F.floor(F.lit(p) * (F.col("_n") - 1))).agg(F.min(value).alias("cutoff"), F.max("_n").alias("n"))


def ordered_ids(df: DataFrame, coarse: list[Column], fine: list[Column], out: str = "rank") -> DataFrame:
    """1-based rank in the order (coarse, fine). Only the distinct coarse keys meet in one window; rows are ranked within theirs."""
    names = [f"_k{i}" for i in range(len(coarse))]
    d = df.withColumns(dict(zip(names, coarse, strict=True)))
    keys = d.groupBy(*names).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = keys.select(*names, before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*names).orderBy(*fine))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = d.withColumn("_own", own).alias("a").join(keys.alias("b"), on).select("a.*", "_before")
    return joined.withColumn(out, F.col("_before") + F.col("_own")).drop("_before", "_own", *names)


def range_containment(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points with the spans of their key that hold them; an equi join with a range condition."""
    return points.join(spans, key).where(F.col(at).between(F.col(start), F.col(end)))


def nearest_ancestor(paths: DataFrame, dirs: DataFrame, path: str = "path", directory: str = "dir") -> DataFrame:
    """Every path with the deepest of `dirs` above it (null: none), by exploding each distinct parent once."""
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    d = paths.withColumn("_dir", parent)
    parts = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chain = d.select("_dir").distinct().withColumn(directory, F.explode(F.array_distinct(up)))
    near = chain.join(dirs.select(directory).distinct(), directory).groupBy("_dir").agg(F.max_by(directory, F.length(directory)).alias(directory))
    return d.join(near, "_dir", "left").drop("_dir")
