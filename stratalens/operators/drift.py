"""Cross-file drift rules, text rules over lines, and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def duplicated_navigation(entries: DataFrame, least_files: int = 2, least_labels: int = 2) -> DataFrame:
    """Destinations with several labels in several files. entries: (file, target, label)."""
    g = entries.groupBy("target").agg(F.countDistinct("file").alias("files"), F.countDistinct("label").alias("labels"), F.min("file").alias("anchor"))
    return g.where((F.col("files") >= least_files) & (F.col("labels") >= least_labels))


def contract_drift(fields: DataFrame, least_overlap: float = 0.6) -> DataFrame:
    """Pairs of contracts of one concept that share 60 % of the smaller's fields and disagree on some. fields: (concept, contract, field, kind)."""
    sizes = fields.groupBy("concept", "contract").agg(F.countDistinct("field").alias("n"))
    a, b = fields.alias("a"), fields.alias("b")
    same = (F.col("a.concept") == F.col("b.concept")) & (F.col("a.field") == F.col("b.field")) & (F.col("a.contract") < F.col("b.contract"))
    g = a.join(b, same).groupBy(F.col("a.concept").alias("concept"), F.col("a.contract").alias("left"), F.col("b.contract").alias("right"))
    g = g.agg(F.count("*").alias("shared"), F.count_if(F.col("a.kind") != F.col("b.kind")).alias("disagreements"))
    for side in ("left", "right"):
        g = g.join(sizes.select("concept", F.col("contract").alias(side), F.col("n").alias(f"n_{side}")), ["concept", side])
    least = F.least("n_left", "n_right")
    return g.where((F.col("shared") >= least_overlap * least) & ((F.col("disagreements") > 0) | (F.col("n_left") != F.col("n_right"))))


def route_drift(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Frontend calls (file, method, route) against backend routes (method, route), both normalised.

    orphan: no such route though its first segment exists; method: the route exists with other methods only.
    """
    first = F.split("route", "/")[0]
    spaces = routes.select(first.alias("_space")).distinct()
    known = routes.groupBy("route").agg(F.collect_set("method").alias("_methods"))
    d = calls.join(known, "route", "left").withColumn("_space", first).join(spaces.withColumn("_in", F.lit(True)), "_space", "left")
    problem = F.when(F.col("_methods").isNull() & F.col("_in"), "orphan").when(F.col("_methods").isNotNull() & ~F.array_contains("_methods", F.col("method")), "method")
    return d.withColumn("problem", problem).where("problem IS NOT NULL").select("file", "method", "route", "problem")


def type_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Enumerations (name, values) of two languages that overlap by half of the smaller and differ."""
    d = left.join(right.select("name", F.col("values").alias("_r")), "name")
    both = F.size(F.array_intersect("values", "_r"))
    d = d.select("name", both.alias("shared"), F.size(F.array_except("values", "_r")).alias("only_left"), F.size(F.array_except("_r", "values")).alias("only_right"), F.least(F.size("values"), F.size("_r")).alias("_least"))
    d = d.where("shared * 2 >= _least AND (only_left > 0 OR only_right > 0)").drop("_least")
    return d.withColumn("severity", F.when((F.col("only_left") > 0) & (F.col("only_right") > 0), "high").otherwise("medium"))


def _set_pairs(sets: DataFrame, least: int, salts: int, short: int = 32) -> DataFrame:
    """Pairs (left, right, shared, and parts of the right; each once, a set also with itself) of distinct sets (tokens, parts) that share `least` tokens.

    Two tokens (one if least is 1) of the rarest ones that each set can't do without pair them, and a
    pair counts only where those are the first that it shares, so nothing is summed up by pair. Sets
    of more than `short` tokens, which hold many pairs of tokens, meet the others by single ones.
    """
    n = min(least, 2)
    t = sets.where(F.size("tokens") >= least).select("tokens", "parts", F.explode("tokens").alias("t"), F.pmod(F.xxhash64("tokens"), F.lit(salts)).alias("_salt"))
    often = t.groupBy("t").agg(F.count("*").alias("_often")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = t.join(often, ["t", "_salt"]).groupBy("tokens", "parts").agg(F.array_sort(F.collect_list(F.struct("_often", "t"))).alias("_o")).select(F.col("_o.t").alias("by"), "parts")
    head = lambda k: F.slice("by", 1, F.size("by") - (least - k))
    one = lambda rows: rows.select("by", "parts", F.explode(F.transform(head(1), lambda x: F.array(x))).alias("key"))
    two = lambda rows: rows.select("by", "parts", F.explode(F.flatten(F.transform(head(2), lambda x, k: F.transform(F.slice(head(2), k + 2, F.size("by")), lambda y: F.array(x, y))))).alias("key"))
    both, long = F.array_intersect("a.by", "b.by"), F.size("by") > short
    same = (F.col("a.key") == F.col("b.key")) & (F.size(both) >= least)

    def pairs(a, b, k, order):
        found = a.alias("a").join(b.alias("b"), same & (F.slice(both, 1, k) == F.col("a.key")) & order)
        return found.select(F.array_sort("a.by").alias("left"), F.array_sort("b.by").alias("right"), F.size(both).cast("bigint").alias("shared"), "b.parts")

    order = F.col("a.by") <= F.col("b.by")
    if n == 1:
        return pairs(one(d), one(d), 1, order)
    few = two(d.where(~long))
    return pairs(few, few, 2, order).unionByName(pairs(one(d.where(long)), one(d), 1, order | (F.size("b.by") <= short)))


def parallel_destinations(routes: DataFrame, least: int = 2, salts: int = 8) -> DataFrame:
    """Pairs of routes of different roots that share tokens: route, other, shared. routes: (route, root, tokens).

    Distinct sets of tokens are paired, then their routes, in up to `salts` parts of a set with many, so memory and
    what is moved follow the routes and the pairs found. Only a route with several rows, whose tokens
    add up over them, is paired by token.
    """
    least = max(least, 1)
    tokens = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())))
    d = routes.where("route IS NOT NULL AND root IS NOT NULL").select("route", "root", tokens.alias("tokens"), F.count("*").over(Window.partitionBy("route")).alias("_n"))
    one = d.where("_n = 1").withColumn("parts", F.least(F.ceil(F.count("*").over(Window.partitionBy("tokens")) / 500), F.lit(salts)))
    pairs = _set_pairs(one.select("tokens", "parts").distinct(), least, salts)
    a = one.select(F.col("tokens").alias("left"), F.col("route").alias("_a"), F.col("root").alias("_root"))
    b = one.select(F.col("tokens").alias("right"), F.col("route").alias("_b"), "root", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("_salt"))
    found = pairs.join(a, "left").withColumn("_salt", F.pmod(F.xxhash64("_a"), F.col("parts"))).join(b, ["right", "_salt"]).where((F.col("_root") != F.col("root")) & ((F.col("left") != F.col("right")) | (F.col("_a") < F.col("_b"))))
    t = d.select("route", "root", "_n", F.explode("tokens").alias("t"))
    m, o = t.where("_n > 1").alias("m"), t.alias("o")
    on = (F.col("m.t") == F.col("o.t")) & (F.col("m.root") != F.col("o.root")) & ((F.col("m.route") < F.col("o.route")) | ((F.col("m.route") > F.col("o.route")) & (F.col("o._n") == 1)))
    several = m.join(o, on).groupBy(F.col("m.route").alias("_a"), F.col("o.route").alias("_b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    out = found.select("_a", "_b", "shared").unionByName(several)
    return out.select(F.least("_a", "_b").alias("route"), F.greatest("_a", "_b").alias("other"), "shared")


def undeclared(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports (file, package) that no manifest of a governing directory declares. declared: (dir, package)."""
    parts = F.split(F.regexp_extract("file", "^(.*?)/?[^/]*$", 1), "/")
    up = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    found = imports.select("file", "package", F.explode(up).alias("dir")).join(declared, ["dir", "package"], "left_semi").select("file", "package").distinct()
    return imports.select("file", "package").distinct().join(found, ["file", "package"], "left_anti")


def capped(findings: DataFrame, part: str, caps: int, *order: Column) -> DataFrame:
    """The first rows per file of a report: caps are its feature."""
    return findings.withColumn("_rn", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_rn") <= caps).drop("_rn")


def pass_rates(results: DataFrame, agent: str, passed: str, total: str) -> DataFrame:
    g = results.groupBy(agent).agg(F.sum(passed).alias("passed"), F.sum(total).alias("total"))
    return g.withColumn("rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))


def population_diff(before: DataFrame, after: DataFrame, key: str, score: str) -> DataFrame:
    """One row: how many keys entered, left and stayed, and the means of their scores."""
    d = before.select(key, F.col(score).alias("_a")).join(after.select(key, F.col(score).alias("_b")), key, "full_outer")
    new, gone, same = F.col("_a").isNull(), F.col("_b").isNull(), F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return d.agg(F.count_if(new).alias("entered"), F.count_if(gone).alias("gone"), F.count_if(same).alias("stable"), F.avg(F.when(new, F.col("_b"))).alias("entered_mean"), F.avg(F.when(gone, F.col("_a"))).alias("gone_mean"), F.avg(F.when(same, F.col("_b"))).alias("stable_mean"))


def depth_margins(findings: DataFrame, fixture: str, depth: str, floor: int) -> DataFrame:
    """Per fixture: least margin to the floor, rows, share of all rows, and whether it is a cliff (margin <= 5 and share > 1/4)."""
    g = findings.groupBy(fixture).agg(F.min(F.abs(F.col(depth) - floor)).alias("margin"), F.count("*").alias("rows"))
    d = g.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
    return d.withColumn("cliff", (F.col("margin") <= 5) & (F.col("share") > 0.25))


def floor_placement(findings: DataFrame, depth: str, floor: int) -> DataFrame:
    """One row: the nearest depths below and at or above a floor, and the margins."""
    c = F.col(depth)
    g = findings.agg(F.max(F.when(c < floor, c)).alias("below"), F.min(F.when(c >= floor, c)).alias("above"))
    return g.withColumn("margin_below", floor - F.col("below")).withColumn("margin_above", F.col("above") - floor)
