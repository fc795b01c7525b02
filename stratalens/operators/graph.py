"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of spark.checkpoint.dir; in local mode one of our own where that is unset."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="stratalens-")
            atexit.register(shutil.rmtree, folder, True)
            where = Path(folder).as_uri()
        context.setCheckpointDir(where)
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) with a path of at least one edge; a vertex on a cycle reaches itself.

    Each round extends only the pairs that the last one found; rounds are as many as the longest shortest path.
    """
    edges = _checkpointed(edges.select("src", "dst").distinct())
    reached = frontier = edges
    while not frontier.isEmpty():
        step = frontier.select("src", F.col("dst").alias("_mid")).join(edges.select(F.col("src").alias("_mid"), "dst"), "_mid").select("src", "dst").distinct()
        frontier = _checkpointed(step.join(reached, ["src", "dst"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def reach_counts(edges: DataFrame) -> DataFrame:
    """Per vertex: how many vertices reach it (transitive) and how many others point to it (direct)."""
    vertices = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    far = closure(edges).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("transitive"))
    near = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("direct"))
    d = vertices.join(far, "node", "left").join(near, "node", "left")
    return d.select("node", F.coalesce("transitive", F.lit(0)).alias("transitive"), F.coalesce("direct", F.lit(0)).alias("direct"))


def scc(edges: DataFrame) -> DataFrame:
    """Members of strongly connected components of two vertices or more: node, component (its least vertex).

    By colouring, without the closure: vertices without edges in or out are trimmed, every vertex
    takes the least vertex that reaches it as its colour, and of each colour those that reach it
    back are its component; the rest goes round again. What is kept is one row per edge and vertex.
    """
    left = _checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        n = left.count()
        while True:  # only edges between vertices with edges both in and out can be on a cycle
            outs, ins = left.select("src").distinct(), left.select("dst").distinct()
            kept = left.join(ins.withColumnRenamed("dst", "src"), "src", "left_semi").join(outs.withColumnRenamed("src", "dst"), "dst", "left_semi")
            left = _checkpointed(kept.select("src", "dst"))
            m = left.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = _checkpointed(left.select(F.col("src").alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            into = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("d"))
            new = _checkpointed(colour.join(into, "node", "left").select("node", F.least("c", F.coalesce("d", "c")).alias("c"), (F.coalesce(F.col("d"), F.col("c")) < F.col("c")).alias("moved")))
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        inner = left.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("_e")), "dst").where("c = _e").select("src", "dst", "c")
        inner = _checkpointed(inner)
        members = frontier = _checkpointed(colour.where("node = c"))
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            frontier = _checkpointed(back.join(members, ["node", "c"], "left_anti"))
            members = members.unionByName(frontier)
        members = _checkpointed(members)
        found = members if found is None else found.unionByName(members)
        gone = members.select("node")
        left = _checkpointed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("c").agg(F.count("*").alias("n")).where("n >= 2").select("c")
    return found.join(sizes, "c", "left_semi").select("node", F.col("c").alias("component"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Vertices within `depth` undirected steps of the seeds (node): node, hops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = frontier = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    for k in range(1, depth + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(reached, "node", "left_anti").withColumn("hops", F.lit(k))
        reached = reached.unionByName(frontier)
    return reached


def fan_stats(edges: DataFrame) -> DataFrame:
    """Per vertex: distinct others it points to (fan_out) and that point to it (fan_in)."""
    d = edges.where("src <> dst").select("src", "dst").distinct()
    out, into = d.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out")), d.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
