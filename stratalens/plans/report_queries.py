"""Queries of what reports say, on the driver's tables and on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import severity_rank
from ..operators import render, reports
from .fixtures import literal
from .registry import SNAP, W, _findings, longs, query, table


def _expect(types: str, rows: list[tuple]) -> str:
    return literal(dict(x.split() for x in types.split(", ")), rows)


SCORED = f"(SELECT fingerprint || ':' || CAST(o_orderkey AS VARCHAR) AS fingerprint, file, type, severity, {W} * CAST(1 + o_orderkey % 7 AS DOUBLE) AS rank_score FROM ({SNAP}))"


def _scored(spark, sf_dir):
    d = _findings(spark, sf_dir).withColumn("fingerprint", F.concat_ws(":", "fingerprint", F.col("o_orderkey").cast("string")))
    return d.withColumn("rank_score", severity_rank(F.col("severity")) * (1 + F.col("o_orderkey") % 7).cast("double"))


@query(f"SELECT file, sum(rank_score) AS score, CAST(max({W}) AS BIGINT) AS max_severity, count(*) AS findings, count(DISTINCT type) AS types FROM {SCORED} GROUP BY 1")
def file_groups(spark, sf_dir):
    return longs(render.file_groups(_scored(spark, sf_dir)))


@query(f"""WITH g AS (SELECT file, sum(rank_score) AS score, max({W}) AS m, count(*) AS n FROM {SCORED} GROUP BY 1 ORDER BY score DESC, m DESC, file LIMIT 5),
r AS (SELECT s.*, n, row_number() OVER (PARTITION BY s.file ORDER BY rank_score DESC, fingerprint) AS place FROM {SCORED} s JOIN g USING (file))
SELECT file, fingerprint, place, greatest(n - 8, 0) AS left_out FROM r WHERE place <= 8""")
def grouped_report(spark, sf_dir):
    return longs(render.shown(_scored(spark, sf_dir)).select("file", "fingerprint", "place", "left_out"))


@query(f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS n FROM events GROUP BY 1), f AS (SELECT file, max({W}) AS m FROM ({SNAP}) GROUP BY 1),
j AS (SELECT coalesce(c.file, f.file) AS file, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM c FULL JOIN f ON c.file = f.file),
h AS (SELECT *, floor((CAST(0.6 AS DOUBLE)*least(n/CAST(20 AS DOUBLE), CAST(1 AS DOUBLE))+CAST(0.4 AS DOUBLE)*CASE m WHEN 3 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE) WHEN 1 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)*100+0.5)/100 AS risk FROM j),
t AS (SELECT * FROM h ORDER BY risk DESC, n DESC, m DESC, file LIMIT 25)
SELECT file, risk, n AS change_count, CASE WHEN (SELECT min(risk) = max(risk) FROM t) THEN 'all listed files have the same risk' END AS note FROM t""")
def hotspot_order(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.count("*").alias("change_count"))
    return render.hotspot_order(reports.hotspots(c, _findings(spark, sf_dir)), 25).select("file", "risk", "change_count", "note")


@query("""WITH d AS (SELECT CAST(l_suppkey AS VARCHAR) AS file, l_discount AS churn, l_tax AS blast_radius, (l_linenumber % 4) / CAST(4 AS DOUBLE) AS test_gap FROM lineitem),
g AS (SELECT file, test_gap, count(*) AS n FROM d GROUP BY 1, 2), m AS (SELECT file, arg_max(test_gap, ROW(n, -test_gap)) AS test_gap FROM g GROUP BY 1)
SELECT d.file, max(churn) AS churn, max(blast_radius) AS blast_radius, any_value(m.test_gap) AS test_gap FROM d JOIN m ON d.file = m.file GROUP BY 1""")
def risk_summary(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_discount").alias("churn"), F.col("l_tax").alias("blast_radius"), ((F.col("l_linenumber") % 4) / 4.0).alias("test_gap"))
    return render.risk_summary(d)


VERDICTS = [("worse", 2, "fix the new high findings before merging"), ("worse", 0, "look at the new findings: they outweigh what was cleaned up"), ("better", 0, "merge: it removes more weight than it adds"), ("unchanged", 0, "nothing changed against the base"), ("mixed", 0, "a trade-off: look at new and fixed findings alike")]


@query(_expect("verdict VARCHAR, new_high BIGINT, action VARCHAR", VERDICTS))
def recommended_action(spark, sf_dir):
    d = spark.createDataFrame([v[:2] for v in VERDICTS], "verdict string, new_high long")
    return d.withColumn("action", render.recommended_action(F.col("verdict"), F.col("new_high")))


DISPOSITIONS = [("fix-now", "tp"), ("fix-later", "tp"), ("needs-design", "tp"), ("scaffolding", "known"), ("wont-fix", "ask"), ("other", None)]


@query(_expect("disposition VARCHAR, verdict VARCHAR", DISPOSITIONS))
def triage_verdict(spark, sf_dir):
    return spark.createDataFrame([(d,) for d, _ in DISPOSITIONS], "disposition string").withColumn("verdict", render.triage_verdict(F.col("disposition")))


VERSIONS = [("0.9.3", "0.10.0", True), ("v1.2.0", "1.2.9", False), ("2.0.0", "1.9.0", False), ("soon", "1.0.0", False), (None, "1.0.0", False), ("0.9", "1.0", True)]


@query(_expect("pinned VARCHAR, current VARCHAR, behind BOOLEAN", VERSIONS))
def behind_minor(spark, sf_dir):
    d = spark.createDataFrame([v[:2] for v in VERSIONS], "pinned string, current string")
    return d.withColumn("behind", render.behind_minor(F.col("pinned"), F.col("current")))


FEEDBACK = [("2024-01-02 00:00:00", "0.9.0", "a::x", "large_file", "fp", "long by nature"), ("2024-01-01 00:00:00", "0.9.1", "a::y", "large_file", "tp", None), ("2024-01-03 00:00:00", "1.0.0", "b::x", "todo_density", "tp", "")]


def _feedback(spark):
    return spark.createDataFrame(FEEDBACK, "timestamp string, version string, fingerprint string, finding_type string, verdict string, note string")


@query(_expect("fingerprint VARCHAR, release_note VARCHAR", [("a::x", "budgets by kind"), ("a::y", "budgets by kind")]))
def feedback_recheck(spark, sf_dir):
    return render.recheck(_feedback(spark), F.lit("1.0.3"), spark.createDataFrame([("large_file", "budgets by kind")], "finding_type string, note string")).select("fingerprint", "release_note")


@query(_expect("finding_type VARCHAR, text VARCHAR", [("large_file", "## large_file\n\n- [tp] a::y\n- [fp] a::x: long by nature"), ("todo_density", "## todo_density\n\n- [tp] b::x")]))
def feedback_export(spark, sf_dir):
    return render.feedback_markdown(_feedback(spark))


@query(_expect("rank BIGINT, text VARCHAR", [(1, "!!! fnd_00001  src/a.ts:3  too long"), (2, "!   fnd_00002  src/b.ts:1  one mark")]))
def scan_lines(spark, sf_dir):
    rows = [(1, "fnd_00001", "high", "src/a.ts", 3, "too long"), (2, "fnd_00002", "low", "src/b.ts", 1, "one mark")]
    return render.scan_lines(spark.createDataFrame(rows, "rank long, id string, severity string, file string, line_start int, summary string"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS fingerprint, c_mktsegment AS reason FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)")
def suppression_remove(spark, sf_dir):
    store = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("fingerprint"), F.col("c_mktsegment").alias("reason"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 400000")
    return render.remove(store, done.select(F.col("o_custkey").cast("string").alias("fingerprint")))


@query(_expect("fingerprint VARCHAR, effort VARCHAR, fix_shape VARCHAR", [("a", "large", "split"), ("b", "medium", "own words"), ("c", "small", "review")]))
def effort_backfill(spark, sf_dir):
    rows = [("a", "large_file", "huge", " "), ("b", "large_file", "medium", "own words"), ("c", "other", None, None)]
    d = spark.createDataFrame(rows, "fingerprint string, type string, effort string, fix_shape string")
    return render.backfilled(d, spark.createDataFrame([("large_file", "large", "split")], "type string, effort string, fix_shape string")).select("fingerprint", "effort", "fix_shape")


@query(_expect("agent VARCHAR, change VARCHAR", [("a", "up"), ("b", "same"), ("c", "down")]))
def rate_change(spark, sf_dir):
    one = lambda rows: spark.createDataFrame(rows, "agent string, rate double")
    return render.rate_change(one([("a", 0.9), ("b", 0.6), ("c", 0.2)]), one([("a", 0.7), ("b", 0.55), ("c", 0.5)])).select("agent", "change")


@query("SELECT floor(sum(p_retailprice * p_size) / sum(p_size) * 10000 + 0.5) / 10000 AS mean, CAST(sum(p_size) AS BIGINT) AS weight FROM part")
def weighted_mean(spark, sf_dir):
    d = render.weighted_mean(table(spark, sf_dir, "part"), "p_retailprice", "p_size")
    return d.withColumn("mean", F.floor(F.col("mean") * 10000 + 0.5) / 10000)
