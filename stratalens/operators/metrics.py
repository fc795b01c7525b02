"""Ranking-quality and variance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, group: str, rank: str, gain: str) -> DataFrame:
    """Per group: ndcg and the first rank with a gain. rank is 1-based."""
    own = F.expr(f"(power(2.0, {gain}) - 1) / log2({rank} + 1)")
    ideal = F.row_number().over(Window.partitionBy(group).orderBy(F.col(gain).desc(), rank))
    d = ranked.withColumn("_i", ideal)
    best = F.expr(f"(power(2.0, {gain}) - 1) / log2(_i + 1)")
    g = d.groupBy(group).agg(F.sum(own).alias("dcg"), F.sum(best).alias("ideal"), F.min(F.when(F.col(gain) > 0, F.col(rank))).alias("first_relevant"))
    return g.select(group, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"), "first_relevant")


def variance_band(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, mean, sample deviation, least and most, and the band of two deviations."""
    g = samples.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.withColumn("low", F.col("mean") - 2 * F.col("sd")).withColumn("high", F.col("mean") + 2 * F.col("sd"))


def top_share(rows: DataFrame, kind: str, *order: Column, k: int = 20) -> DataFrame:
    """Among the first k rows of an order: the dominant kind, its share, and the distinct kinds."""
    g = rows.orderBy(*order).limit(k).groupBy(kind).agg(F.count("*").alias("_c"))
    return g.agg(F.max_by(kind, F.struct(F.col("_c"), F.col(kind))).alias("dominant"), (F.max("_c") / F.sum("_c")).alias("share"), F.count("*").alias("kinds"))
