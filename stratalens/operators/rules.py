"""Rules over a text corpus (file, text, shape): each gives findings or a table of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import round2

MARKER = r"\b(?:TODO|FIXME|XXX|HACK)\b"


def lines(corpus: DataFrame) -> DataFrame:
    """(file, line, content), 1-based."""
    return corpus.select("file", F.posexplode(F.split("text", "\n")).alias("_p", "content")).select("file", (F.col("_p") + 1).alias("line"), "content")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def large_file(corpus: DataFrame, budget: Column) -> DataFrame:
    """Files over their line budget; twice over is high."""
    n = line_count(F.col("text"))
    d = corpus.select("file", n.alias("lines"), budget.alias("budget")).where("lines > budget")
    ratio = F.col("lines") / F.col("budget")
    return d.withColumn("severity", F.when(ratio >= 2, "high").otherwise("medium")).withColumn("confidence", round2(F.least(0.7 + 0.15 * (ratio - 1), F.lit(0.95))))


def marker_density(corpus: DataFrame, marker: str, least: int = 3, per_kloc: float = 10.0) -> DataFrame:
    """Files with at least `least` markers or `per_kloc` of them per thousand lines."""
    d = corpus.select("file", F.regexp_count("text", F.lit(marker)).alias("markers"), line_count(F.col("text")).alias("lines")).where("markers > 0")
    d = d.withColumn("ratio", F.col("markers") * 1000.0 / F.col("lines")).where(f"markers >= {least} OR ratio >= {per_kloc}")
    high, medium = (F.col("markers") >= 20) & (F.col("ratio") >= per_kloc), (F.col("markers") >= 8) | (F.col("ratio") >= 10 * per_kloc)
    return d.withColumn("severity", F.when(high, "high").when(medium, "medium").otherwise("low")).withColumn("ratio", round2(F.col("ratio")))


def pattern_count(corpus: DataFrame, pattern: str, high: int = 3) -> DataFrame:
    """Files with matches of a literal pattern (hosts, local paths): count and severity."""
    d = corpus.select("file", F.regexp_count("text", F.lit(pattern)).alias("hits")).where("hits > 0")
    return d.withColumn("severity", F.when(F.col("hits") >= high, "high").otherwise("medium"))


def exact_groups(corpus: DataFrame, least: int = 2) -> DataFrame:
    """Texts that at least `least` files share: hash, anchor, files."""
    return corpus.groupBy(F.md5("text").alias("hash")).agg(F.min("file").alias("anchor"), F.countDistinct("file").alias("files")).where(F.col("files") >= least)


def shape(text: Column) -> Column:
    """A text without what near copies change: digits as 0, white space and marks as one space, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[^a-z0-9]+", " "))


def near_groups(corpus: DataFrame, least: int = 2) -> DataFrame:
    """Shapes of at least `least` files, none of which are exact copies of each other: shape_hash, anchor, files, texts.

    Groups that an exact group covers with two files or more are its business.
    """
    d = corpus.select("file", F.md5(shape(F.col("text"))).alias("shape_hash"), F.md5("text").alias("hash"))
    texts = d.groupBy("shape_hash", "hash").agg(F.min("file").alias("anchor"), F.countDistinct("file").alias("files"))
    g = texts.groupBy("shape_hash").agg(F.min("anchor").alias("anchor"), F.sum("files").alias("files"), F.count("*").alias("texts"), F.max("files").alias("_most"))
    return g.where((F.col("files") >= least) & (F.col("texts") > 1) & (F.col("_most") < 2)).drop("_most")


def line_scatter(corpus: DataFrame, bucket: str, least_files: int = 3, least_buckets: int = 2, least_length: int = 20) -> DataFrame:
    """Lines in at least three files and two buckets, with the least file as anchor. Partial counts come before the shuffle."""
    d = corpus.select("file", bucket, F.explode(F.array_distinct(F.split("text", "\n"))).alias("content")).where(F.length("content") >= least_length)
    g = d.groupBy("content").agg(F.countDistinct("file").alias("files"), F.countDistinct(bucket).alias("buckets"), F.min("file").alias("anchor"))
    g = g.where((F.col("files") >= least_files) & (F.col("buckets") >= least_buckets))
    severity = F.when((F.col("files") >= 5) | (F.col("buckets") >= 3), "medium").otherwise("low")
    return g.select(F.md5("content").alias("line_hash"), "anchor", "files", "buckets", severity.alias("severity"), round2(F.least(0.66 + 0.03 * F.col("files") + 0.02 * F.col("buckets"), F.lit(0.85))).alias("confidence"))


def shared_lines(left: DataFrame, right: DataFrame, least_length: int = 20) -> DataFrame:
    """Pairs of a left and a right file that share normalised lines: file, other, shared."""
    def keys(d: DataFrame, name: str) -> DataFrame:
        found = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(F.lower(x))))
        return d.select(F.col("file").alias(name), F.explode(found).alias("_l")).where(F.length("_l") >= least_length)

    return keys(left, "file").join(keys(right, "other"), "_l").groupBy("file", "other").agg(F.count("*").alias("shared"))


def links(pages: DataFrame) -> DataFrame:
    """(file, target) of the distinct href targets of pages (file, url, text)."""
    return pages.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit('href="([^"]+)"'), F.lit(1)))).alias("target"))


def broken_links(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Links to nothing, per file: file, broken, first_target."""
    return found.join(targets.select("target").distinct(), "target", "left_anti").groupBy("file").agg(F.count("*").alias("broken"), F.min("target").alias("first_target"))


def unreachable(destinations: DataFrame, *sources: DataFrame) -> DataFrame:
    """Destinations (target, …) that none of the sources (target) names."""
    for s in sources:
        destinations = destinations.join(s.select("target").distinct(), "target", "left_anti")
    return destinations


def variant_drift(df: DataFrame, key: str, *variants: str) -> DataFrame:
    """Keys whose settings differ: the number of distinct values of each variant, and a severity by how many differ."""
    g = df.groupBy(key).agg(*[F.countDistinct(v).alias(f"n_{v}") for v in variants])
    drifting = F.lit(0)
    for v in variants:
        drifting = drifting + F.when(F.col(f"n_{v}") >= 2, 1).otherwise(0)
    return g.withColumn("drifting", drifting).where("drifting > 0").withColumn("severity", F.when(F.col("drifting") >= 2, "high").otherwise("medium"))


def alias_drift(corpus: DataFrame, aliases: DataFrame, bucket: str, least_aliases: int = 2, least_buckets: int = 2) -> DataFrame:
    """Alias groups of which several aliases are in use in several buckets. aliases: (group_id, alias), a small dimension."""
    words = corpus.select("file", bucket, F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("alias"))
    used = words.join(aliases, "alias").groupBy("group_id", "alias").agg(F.countDistinct(bucket).alias("_b"), F.countDistinct("file").alias("_f")).where(F.col("_b") >= least_buckets)
    return used.groupBy("group_id").agg(F.count("*").alias("aliases"), F.sum("_f").alias("files"), F.min("alias").alias("first_alias")).where(F.col("aliases") >= least_aliases)


def layer_violations(edges: DataFrame, layers: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges (src, dst) between layers that a rule forbids. layers: (node, layer); forbidden: (from_layer, to_layer)."""
    d = edges.join(layers.select(F.col("node").alias("src"), F.col("layer").alias("from_layer")), "src").join(layers.select(F.col("node").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    g = d.join(forbidden, ["from_layer", "to_layer"]).groupBy("from_layer", "to_layer").agg(F.count("*").alias("edges"))
    return g.withColumn("severity", F.when(F.col("edges") >= 3, "high").otherwise("medium"))
