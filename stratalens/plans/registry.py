"""The queries of the library's own operators on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import findings, graph, metrics, relational, reports, rules

FLAGSHIP = "scan_report"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-06-30"
HOST = "[A-Za-z0-9-]+[.]example[.]com"
MARK = "token|password"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text", "lang", "source")


def longs(df: DataFrame) -> DataFrame:
    """Whole-number columns as bigint."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


C = "(SELECT CAST(doc_id AS VARCHAR) AS file, text, lang, source FROM documents)"
R2 = "floor(({})*100+0.5)/100"


# Rules over texts.


@query(f"""WITH l AS (SELECT file, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CASE WHEN lang = 'en' THEN 8 ELSE 6 END AS budget FROM {C})
SELECT file, lines, CAST(budget AS BIGINT) AS budget, CASE WHEN CAST(lines AS DOUBLE)/budget >= 2 THEN 'high' ELSE 'medium' END AS severity,
floor(least(CAST(0.7 AS DOUBLE)+CAST(0.15 AS DOUBLE)*(CAST(lines AS DOUBLE)/budget-1), CAST(0.95 AS DOUBLE))*100+0.5)/100 AS confidence FROM l WHERE lines > budget""")
def large_file(spark, sf_dir):
    return longs(rules.large_file(corpus(spark, sf_dir), F.when(F.col("lang") == "en", 8).otherwise(6)))


@query(f"""WITH m AS (SELECT file, CAST(len(regexp_extract_all(text, '{MARK}')) AS BIGINT) AS markers, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM {C}),
r AS (SELECT *, markers*CAST(1000 AS DOUBLE)/lines AS ratio FROM m WHERE markers > 0)
SELECT file, markers, lines, floor(ratio*100+0.5)/100 AS ratio, CASE WHEN markers >= 20 AND ratio >= 10 THEN 'high' WHEN markers >= 8 OR ratio >= 100 THEN 'medium' ELSE 'low' END AS severity
FROM r WHERE markers >= 3 OR ratio >= 10""")
def marker_density(spark, sf_dir):
    return longs(rules.marker_density(corpus(spark, sf_dir), MARK))


@query(f"""SELECT file, CAST(len(regexp_extract_all(text, '{HOST}')) AS BIGINT) AS hits, CASE WHEN len(regexp_extract_all(text, '{HOST}')) >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM {C} WHERE len(regexp_extract_all(text, '{HOST}')) > 0""")
def url_literals(spark, sf_dir):
    return longs(rules.pattern_count(corpus(spark, sf_dir), HOST))


@query(f"SELECT md5(text) AS hash, min(file) AS anchor, count(DISTINCT file) AS files FROM {C} GROUP BY 1 HAVING count(DISTINCT file) >= 2")
def exact_duplicate_block(spark, sf_dir):
    return rules.exact_groups(corpus(spark, sf_dir))


NAMES = "(SELECT CAST(c_custkey AS VARCHAR) AS file, c_mktsegment || ': ' || c_name || ', ' || CAST(c_nationkey AS VARCHAR) AS text FROM customer)"
SHAPE = "trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT md5({SHAPE}) AS shape_hash, md5(text) AS h, min(file) AS anchor, count(DISTINCT file) AS files FROM {NAMES} GROUP BY 1, 2)
SELECT shape_hash, min(anchor) AS anchor, CAST(sum(files) AS BIGINT) AS files, count(*) AS texts FROM t GROUP BY 1 HAVING sum(files) >= 2 AND count(*) > 1 AND max(files) < 2""")
def near_duplicate_block(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rules.near_groups(c.select(F.col("c_custkey").cast("string").alias("file"), F.concat("c_mktsegment", F.lit(": "), "c_name", F.lit(", "), F.col("c_nationkey").cast("string")).alias("text")))


@query(f"""WITH l AS (SELECT DISTINCT file, source, unnest(string_split(text, chr(10))) AS content FROM {C}),
g AS (SELECT content, count(DISTINCT file) AS files, count(DISTINCT source) AS buckets, min(file) AS anchor FROM l WHERE length(content) >= 20 GROUP BY 1)
SELECT md5(content) AS line_hash, anchor, files, buckets, CASE WHEN files >= 5 OR buckets >= 3 THEN 'medium' ELSE 'low' END AS severity,
floor(least(CAST(0.66 AS DOUBLE)+CAST(0.03 AS DOUBLE)*files+CAST(0.02 AS DOUBLE)*buckets, CAST(0.85 AS DOUBLE))*100+0.5)/100 AS confidence FROM g WHERE files >= 3 AND buckets >= 2""")
def line_scatter(spark, sf_dir):
    return rules.line_scatter(corpus(spark, sf_dir), "source")


@query(f"""WITH a AS (SELECT DISTINCT file, trim(lower(l)) AS k FROM (SELECT file, unnest(string_split(text, chr(10))) AS l FROM {C}) WHERE length(trim(lower(l))) >= 20),
b AS (SELECT DISTINCT other, trim(lower(l)) AS k FROM (SELECT CAST(item_id AS VARCHAR) AS other, unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE length(trim(lower(l))) >= 20)
SELECT file, other, count(*) AS shared FROM a JOIN b USING (k) GROUP BY 1, 2""")
def cross_corpus_overlap(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("file"), "text")
    return rules.shared_lines(corpus(spark, sf_dir), bench)


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), "url", F.col("html").alias("text"))


HREFS = "(SELECT DISTINCT CAST(page_id AS VARCHAR) AS file, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"


@query(f"SELECT file, count(*) AS broken, min(target) AS first_target FROM {HREFS} WHERE target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY 1")
def docs_code_drift(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return rules.broken_links(rules.links(pages), pages.select(F.col("url").alias("target")))


@query(f"SELECT url AS target, count(*) AS pages FROM pages WHERE url NOT IN (SELECT target FROM {HREFS}) AND url IS NOT NULL GROUP BY 1")
def orphaned_destination(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    own = pages.where("url IS NOT NULL").groupBy(F.col("url").alias("target")).agg(F.count("*").alias("pages"))
    return rules.unreachable(own, rules.links(pages))


@query("""WITH g AS (SELECT p_brand, count(DISTINCT p_type) AS n_p_type, count(DISTINCT p_size) AS n_p_size FROM part GROUP BY 1),
d AS (SELECT *, CASE WHEN n_p_type >= 2 THEN 1 ELSE 0 END + CASE WHEN n_p_size >= 2 THEN 1 ELSE 0 END AS drifting FROM g)
SELECT p_brand, n_p_type, n_p_size, CAST(drifting AS BIGINT) AS drifting, CASE WHEN drifting >= 2 THEN 'high' ELSE 'medium' END AS severity FROM d WHERE drifting > 0""")
def config_drift(spark, sf_dir):
    return longs(rules.variant_drift(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size"))


ALIASES = [("article", "the"), ("article", "der"), ("article", "le"), ("join", "and"), ("join", "und"), ("join", "et"), ("rare", "zzzz")]
_VALUES = ", ".join(f"('{g}', '{a}')" for g, a in ALIASES)


@query(f"""WITH w AS (SELECT DISTINCT file, source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS alias FROM {C}), al(group_id, alias) AS (VALUES {_VALUES}),
u AS (SELECT group_id, alias, count(DISTINCT source) AS b, count(DISTINCT file) AS f FROM w JOIN al USING (alias) GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2)
SELECT group_id, count(*) AS aliases, CAST(sum(f) AS BIGINT) AS files, min(alias) AS first_alias FROM u GROUP BY 1 HAVING count(*) >= 2""")
def concept_alias_drift(spark, sf_dir):
    dim = spark.createDataFrame(ALIASES, "group_id string, alias string")
    return rules.alias_drift(corpus(spark, sf_dir), dim, "source")


@query(f"""WITH f AS (SELECT file, source AS dir, regexp_extract(lower(text), '^[^a-z]*([a-z]+)', 1) AS token FROM {C}), g AS (SELECT file, dir, nullif(token, '') AS token FROM f),
p AS (SELECT a.file, b.file AS other, coalesce(CAST(a.dir = b.dir AS INT) * CAST(0.25 AS DOUBLE), 0) + coalesce(CAST(a.token = b.token AS INT) * CAST(0.4 AS DOUBLE), 0) AS s FROM g a JOIN g b ON a.file <> b.file AND (a.dir = b.dir OR a.token = b.token))
SELECT file, other, floor(s*100+0.5)/100 AS score FROM p QUALIFY row_number() OVER (PARTITION BY file ORDER BY floor(s*100+0.5)/100 DESC, other) <= 10""")
def related_files(spark, sf_dir):
    word = F.nullif(F.regexp_extract(F.lower("text"), "^[^a-z]*([a-z]+)", 1), F.lit(""))
    return reports.related_files(corpus(spark, sf_dir).select("file", F.col("source").alias("dir"), word.alias("token")))


@query("""WITH e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey),
l(node, layer) AS (SELECT n_name, CASE WHEN n_regionkey < 2 THEN 'core' ELSE 'edge' END FROM nation), r(node, layer) AS (SELECT r_name, CASE WHEN r_regionkey < 3 THEN 'core' ELSE 'edge' END FROM region),
f(from_layer, to_layer) AS (VALUES ('edge', 'core'), ('core', 'edge'))
SELECT l.layer AS from_layer, r.layer AS to_layer, count(*) AS edges, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM e JOIN l ON e.src = l.node JOIN r ON e.dst = r.node JOIN f ON f.from_layer = l.layer AND f.to_layer = r.layer GROUP BY 1, 2""")
def layer_violation(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    layers = n.select(F.col("n_name").alias("node"), F.expr("IF(n_regionkey < 2, 'core', 'edge')").alias("layer")).unionByName(r.select(F.col("r_name").alias("node"), F.expr("IF(r_regionkey < 3, 'core', 'edge')").alias("layer")))
    forbidden = spark.createDataFrame([("edge", "core"), ("core", "edge")], "from_layer string, to_layer string")
    return rules.layer_violations(edges, layers, forbidden)


# Change log, graph and scores.


@query("SELECT event_type AS file, count(*) AS change_count, max(ts) AS latest, count(DISTINCT user_id) AS authors FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 90 DAY GROUP BY 1")
def churn(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("_last"))
    recent = e.join(F.broadcast(last), F.col("ts") > F.col("_last") - F.expr("INTERVAL 90 DAYS"))
    return recent.groupBy(F.col("event_type").alias("file")).agg(F.count("*").alias("change_count"), F.max("ts").alias("latest"), F.countDistinct("user_id").alias("authors"))


@query("""WITH d AS (SELECT user_id, max(CAST(ts AS DATE)) AS day FROM events GROUP BY 1), t AS (SELECT max(day) AS today FROM d), a AS (SELECT user_id, date_diff('day', day, today) AS age FROM d, t)
SELECT user_id, CAST(age AS BIGINT) AS age, floor((CASE WHEN age <= 7 THEN CAST(1 AS DOUBLE) WHEN age >= 14 THEN 0 ELSE (14-age)/CAST(7 AS DOUBLE) END)*100+0.5)/100 AS recency FROM a""")
def recency(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("day"))
    today = d.agg(F.max("day").alias("today"))
    return longs(d.join(F.broadcast(today)).select("user_id", F.datediff("today", "day").alias("age"), scoring.round2(scoring.recency(F.col("day"), F.col("today"))).alias("recency")))


@query("""WITH g AS (SELECT CAST(d.doc_id AS VARCHAR) AS file, CASE WHEN l.quality = 1 THEN CAST(0 AS DOUBLE) WHEN l.quality = 0 THEN 0.5 ELSE 1 END AS gap FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (SELECT *, (2*(rank() OVER (ORDER BY gap)-1)+count(*) OVER (PARTITION BY gap))/(2*CAST(count(*) OVER () AS DOUBLE)) AS pct, count(*) OVER () AS n FROM g)
SELECT file, gap, CASE WHEN n < 4 THEN gap WHEN pct < 0.25 THEN CAST(0 AS DOUBLE) WHEN pct < 0.4375 THEN 0.25 WHEN pct < 0.5625 THEN 0.5 WHEN pct < 0.75 THEN 0.75 ELSE 1 END AS quartile FROM p""")
def test_gap_quartile(spark, sf_dir):
    return relational.midrank(_gaps(spark, sf_dir), "gap").select("file", "gap", "quartile")


def _gaps(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gap = F.when(F.col("quality") == 1, 0.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return d.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").select(F.col("doc_id").cast("string").alias("file"), gap.alias("gap"))


@query("""WITH s AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT v AS cutoff, n FROM s WHERE i = CAST(floor(CAST(0.95 AS DOUBLE)*(n-1)) AS BIGINT)+1""")
def floor_index_percentile(spark, sf_dir):
    return relational.floor_index_percentile(table(spark, sf_dir, "documents"), "n_chars", 0.95)


EDGES = "(SELECT DISTINCT event_type || ':' || k AS src, lead(event_type || ':' || k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM (SELECT *, CAST(user_id % 7 AS VARCHAR) AS k FROM events))"


def _edges(spark, sf_dir):
    from pyspark.sql import Window

    state = F.concat_ws(":", "event_type", (F.col("user_id") % 7).cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(state.alias("src"), F.lead(state).over(w).alias("dst")).where("dst IS NOT NULL").distinct()


CLOSURE = f"e AS (SELECT * FROM {EDGES} WHERE dst IS NOT NULL), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"


@query(f"""WITH RECURSIVE {CLOSURE}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, (SELECT count(DISTINCT src) FROM c WHERE c.dst = node) AS transitive, (SELECT count(DISTINCT src) FROM e WHERE e.dst = node AND src <> dst) AS direct FROM v""")
def reach_counts(spark, sf_dir):
    return graph.reach_counts(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE}, b AS (SELECT a.src AS node, a.dst AS other FROM c a JOIN c z ON a.src = z.dst AND a.dst = z.src)
SELECT node, min(other) AS component FROM b GROUP BY 1 HAVING count(DISTINCT other) >= 2""")
def circular_dependency(spark, sf_dir):
    return graph.scc(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE}, v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
n AS (SELECT node, (SELECT count(DISTINCT src) FROM c WHERE c.dst = node) AS t, (SELECT count(DISTINCT src) FROM e WHERE e.dst = node AND src <> dst) AS d FROM v)
SELECT node, floor((CAST(0.85 AS DOUBLE)*least(CAST(1 AS DOUBLE), ln(1+t)/ln(CAST(2001 AS DOUBLE)))+CAST(0.15 AS DOUBLE)*least(CAST(1 AS DOUBLE), ln(1+d)/ln(CAST(251 AS DOUBLE))))*100+0.5)/100 AS blast_radius FROM n""")
def blast_radius(spark, sf_dir):
    n = graph.reach_counts(_edges(spark, sf_dir))
    return n.select("node", scoring.round2(scoring.blast_radius(F.col("transitive"), F.col("direct"))).alias("blast_radius"))


CHAIN = "(SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH e AS (SELECT src, dst FROM {CHAIN} UNION SELECT dst, src FROM {CHAIN}), h0 AS (SELECT 'FRANCE' AS node), s AS (SELECT min(src) AS node FROM {CHAIN}),
h1 AS (SELECT DISTINCT dst AS node FROM e JOIN s ON e.src = s.node WHERE dst NOT IN (SELECT node FROM s)),
h2 AS (SELECT DISTINCT dst AS node FROM e JOIN h1 ON e.src = h1.node WHERE dst NOT IN (SELECT node FROM s UNION SELECT node FROM h1))
SELECT node, CAST(0 AS BIGINT) AS hops FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def neighbourhood(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return longs(graph.neighbourhood(edges, edges.agg(F.min("src").alias("node")), 2))


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM {EDGES} WHERE dst IS NOT NULL AND src <> dst), o AS (SELECT src AS node, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1)
SELECT node, coalesce(o, 0) AS fan_out, coalesce(i, 0) AS fan_in FROM o FULL JOIN i USING (node)""")
def high_fan_in_fan_out(spark, sf_dir):
    return graph.fan_stats(_edges(spark, sf_dir))


# Reports: two snapshots of findings from orders.

SNAP = """SELECT 'order::' || CAST(o_custkey AS VARCHAR) || '::' || o_orderstatus AS fingerprint, CAST(o_custkey AS VARCHAR) AS file, 'order' AS type,
CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'medium' ELSE 'low' END AS severity, o_orderkey FROM orders"""
HALF = "(SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 FROM orders)"
FIRST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY file, severity) AS rn FROM ({})) WHERE rn = 1"
DATED = SNAP.replace(" FROM orders", ", o_orderdate FROM orders")
BASE = FIRST.format(f"SELECT * FROM ({DATED}) WHERE o_orderdate < TIMESTAMP '1995-01-01'")
HEAD = FIRST.format(f"SELECT * FROM ({DATED}) WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
DIFF = f"""SELECT coalesce(b.fingerprint, h.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN h.fingerprint IS NULL THEN 'fixed' ELSE 'unchanged' END AS status,
coalesce(h.severity, b.severity) AS severity FROM ({BASE}) b FULL JOIN ({HEAD}) h ON b.fingerprint = h.fingerprint"""


def _findings(spark, sf_dir, side: str | None = None):
    o = table(spark, sf_dir, "orders")
    if side:
        o = o.where("o_orderdate " + ("<" if side == "base" else ">=") + " TIMESTAMP '1995-01-01'")
    first = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.concat_ws("::", F.lit("order"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("fingerprint"), F.col("o_custkey").cast("string").alias("file"), F.lit("order").alias("type"),
        F.when(first.isin("1", "2"), "high").when(first == "3", "medium").otherwise("low").alias("severity"), "o_orderkey", "o_orderdate",
    )


@query(DIFF)
def diff(spark, sf_dir):
    return reports.diff(_findings(spark, sf_dir, "base"), _findings(spark, sf_dir, "head"))


W = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query(f"""WITH r AS (SELECT coalesce(sum(CASE WHEN status = 'new' THEN {W} END), 0) AS n, coalesce(sum(CASE WHEN status = 'fixed' THEN {W} END), 0) AS f, count(CASE WHEN status = 'new' AND severity = 'high' THEN 1 END) AS h FROM ({DIFF}))
SELECT CAST(n AS BIGINT) AS new_weight, CAST(f AS BIGINT) AS fixed_weight, h AS new_high, CASE WHEN h > 0 THEN 'worse' WHEN n = 0 AND f = 0 THEN 'unchanged' WHEN n > f THEN 'worse' WHEN n < f THEN 'better' ELSE 'mixed' END AS verdict FROM r""")
def verdict(spark, sf_dir):
    return longs(reports.verdict(diff(spark, sf_dir)))


@query(f"SELECT status, count(*) AS findings, count(CASE WHEN severity = 'high' THEN 1 END) AS high FROM ({DIFF}) GROUP BY 1")
def baseline_check(spark, sf_dir):
    return diff(spark, sf_dir).groupBy("status").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "high").alias("high"))


@query(f"SELECT count(CASE WHEN {W} >= 2 THEN 1 END) AS hits, count(*) AS findings, count(CASE WHEN {W} >= 2 THEN 1 END) > 0 AS failed FROM ({HEAD})")
def severity_gate(spark, sf_dir):
    head = relational.first_per_key(_findings(spark, sf_dir, "head"), "fingerprint", F.col("file"), F.col("severity"))
    return reports.gate(head, "medium")


@query(f"SELECT count(*) AS total, count(CASE WHEN severity = 'high' THEN 1 END) AS high, count(CASE WHEN severity = 'medium' THEN 1 END) AS medium, count(CASE WHEN severity = 'low' THEN 1 END) AS low FROM ({SNAP})")
def severity_counts(spark, sf_dir):
    return reports.severity_counts(_findings(spark, sf_dir))


STORE = "(SELECT 'order::' || CAST(c_custkey AS VARCHAR) || '::O' AS fingerprint, c_mktsegment AS reason, CAST(c_nationkey AS BIGINT) AS pinned_minor FROM customer WHERE c_custkey % 3 = 0)"


def _store(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return c.select(F.concat(F.lit("order::"), F.col("c_custkey").cast("string"), F.lit("::O")).alias("fingerprint"), F.col("c_mktsegment").alias("reason"), F.col("c_nationkey").cast("bigint").alias("pinned_minor"))


@query(f"SELECT CASE WHEN reason IS NULL THEN 'active' WHEN pinned_minor < 12 THEN 'resurfaced' ELSE 'suppressed' END AS state, count(*) AS findings FROM ({SNAP}) LEFT JOIN {STORE} USING (fingerprint) GROUP BY 1")
def suppress(spark, sf_dir):
    return reports.suppressed(_findings(spark, sf_dir), _store(spark, sf_dir), F.lit(12)).groupBy("state").agg(F.count("*").alias("findings"))


DISPOSITIONS = "CASE pinned_minor % 4 WHEN 0 THEN 'fix-now' WHEN 1 THEN 'wont-fix' WHEN 2 THEN 'scaffolding' ELSE 'needs-design' END"


@query(f"""WITH t AS (SELECT fingerprint, {DISPOSITIONS} AS disposition FROM {STORE})
SELECT CASE WHEN disposition IS NULL THEN 'shown' WHEN disposition IN ('wont-fix', 'scaffolding') THEN 'hidden' WHEN disposition LIKE 'fix-%' THEN 'shown' ELSE 'annotated' END AS visibility, count(*) AS findings FROM ({SNAP}) LEFT JOIN t USING (fingerprint) GROUP BY 1""")
def triage(spark, sf_dir):
    t = _store(spark, sf_dir).select("fingerprint", F.expr(DISPOSITIONS).alias("disposition"))
    return reports.triaged(_findings(spark, sf_dir), t).groupBy("visibility").agg(F.count("*").alias("findings"))


@query(f"""WITH ch AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS file FROM orders WHERE o_orderstatus = 'P'), h AS (SELECT h.* FROM ({HEAD}) h WHERE file IN (SELECT file FROM ch))
SELECT h.fingerprint, h.file, CASE WHEN s.fingerprint IS NOT NULL THEN 'triage' ELSE 'baseline' END AS origin FROM h LEFT JOIN {STORE} s ON h.fingerprint = s.fingerprint LEFT JOIN ({BASE}) b ON h.fingerprint = b.fingerprint
WHERE s.fingerprint IS NOT NULL OR b.fingerprint IS NOT NULL""")
def resurface(spark, sf_dir):
    one = lambda side: relational.first_per_key(_findings(spark, sf_dir, side), "fingerprint", F.col("file"), F.col("severity"))
    changed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("file"))
    return reports.resurfaced(_store(spark, sf_dir), one("base"), changed, one("head"))


@query("""WITH s AS (SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint, o_orderpriority AS reason, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS age FROM orders)
SELECT fingerprint, reason, CAST(age AS BIGINT) AS age_days, age > 2000 AS stale, length(reason) < 6 AS short_reason, regexp_matches(lower(reason), '^(todo|later|tmp|temp|ignore|skip|n/?a|false positive)') AS vague_reason
FROM s WHERE age > 2000 OR length(reason) < 6 OR regexp_matches(lower(reason), '^(todo|later|tmp|temp|ignore|skip|n/?a|false positive)')""")
def suppression_audit(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_orderpriority").alias("reason"), F.to_date("o_orderdate").alias("created_at"))
    return longs(reports.audit(s, F.lit("1998-12-31").cast("date"), 2000, 6).drop("created_at"))


@query(f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS change_count FROM events GROUP BY 1), f AS (SELECT file, count(*) AS finding_count, max({W}) AS m FROM ({SNAP}) GROUP BY 1),
j AS (SELECT coalesce(c.file, f.file) AS file, coalesce(change_count, 0) AS change_count, coalesce(finding_count, 0) AS finding_count, coalesce(m, 0) AS m FROM c FULL JOIN f ON c.file = f.file)
SELECT file, change_count, finding_count, CAST(m AS BIGINT) AS max_severity, floor((CAST(0.6 AS DOUBLE)*least(change_count/CAST(20 AS DOUBLE), CAST(1 AS DOUBLE))+CAST(0.4 AS DOUBLE)*CASE m WHEN 3 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(0.6 AS DOUBLE) WHEN 1 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)*100+0.5)/100 AS risk FROM j""")
def hotspots(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.count("*").alias("change_count"))
    return longs(reports.hotspots(c, _findings(spark, sf_dir)))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1")
def feedback_latest(spark, sf_dir):
    return relational.latest_per_key(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "role")


@query("SELECT role AS verdict, count(*) AS latest, max(turn) AS most_turns FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1) GROUP BY 1")
def feedback_summary(spark, sf_dir):
    latest = relational.latest_per_key(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return latest.groupBy(F.col("role").alias("verdict")).agg(F.count("*").alias("latest"), F.max("turn").alias("most_turns"))


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def coverage(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("""WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, CAST(sum(n) AS BIGINT) AS files, max(n) AS m FROM g GROUP BY 1)
SELECT t.source, files, (SELECT min(lang) FROM g WHERE g.source = t.source AND 2*g.n > files) AS dominant FROM t""")
def coverage_by_package(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    paths = docs.select("lang", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    near = relational.nearest_ancestor(paths, docs.select(F.col("source").alias("dir")).distinct())
    g = near.groupBy(F.col("dir").alias("source"), "lang").agg(F.count("*").alias("n"))
    t = g.groupBy("source").agg(F.sum("n").alias("files"), F.max(F.struct("n", "lang")).alias("_m"))
    return t.select("source", "files", F.when(2 * F.col("_m.n") > F.col("files"), F.col("_m.lang")).alias("dominant"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem), i AS (SELECT k, date_diff('day', DATE '1990-01-01', d) - row_number() OVER (PARTITION BY k ORDER BY d) AS g, date_diff('day', DATE '1990-01-01', d) AS x FROM p)
SELECT k AS supplier, CAST(min(x) AS BIGINT) AS first, CAST(max(x) AS BIGINT) AS last, count(*) AS length FROM i GROUP BY k, g HAVING count(*) >= 3""")
def consecutive_runs(spark, sf_dir):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("day")).distinct()
    return longs(relational.islands(d, ["supplier"], "day").where("length >= 3"))


@query("""SELECT o.o_orderkey AS k, CAST(sum(CASE WHEN l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY 1""")
def range_containment(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("until"))
    return relational.range_containment(points, spans, "k", "l_shipdate", "o_orderdate", "until").groupBy("k").agg(F.count("*").alias("inside"))


@query("""WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rnk, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS gain FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gain DESC, rnk) AS ideal FROM r),
g AS (SELECT k, sum((power(2.0::DOUBLE, gain)-1)/log2(rnk+1)) AS dcg, sum((power(2.0::DOUBLE, gain)-1)/log2(ideal+1)) AS best, min(CASE WHEN gain > 0 THEN rnk END) AS fr FROM i GROUP BY 1)
SELECT k, floor((CASE WHEN best > 0 THEN dcg/best ELSE 0 END)*10000+0.5)/10000 AS ndcg, fr AS first_relevant FROM g""")
def ndcg(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber")
    gain = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("rnk"), gain.alias("gain"))
    return longs(metrics.ndcg(r, "k", "rnk", "gain").withColumn("ndcg", F.floor(F.col("ndcg") * 10000 + 0.5) / 10000))


V4 = "floor(({})*10000+0.5)/10000"


@query(f"""WITH g AS (SELECT label, count(label) AS n, avg(CAST(vec_id % 97 AS DOUBLE)) AS mean, coalesce(stddev_samp(CAST(vec_id % 97 AS DOUBLE)), 0) AS sd, min(CAST(vec_id % 97 AS DOUBLE)) AS least, max(CAST(vec_id % 97 AS DOUBLE)) AS most FROM embeddings GROUP BY 1)
SELECT CAST(label AS BIGINT) AS label, n, {V4.format("mean")} AS mean, {V4.format("sd")} AS sd, least, most, {V4.format("mean-2*sd")} AS low, {V4.format("mean+2*sd")} AS high FROM g""")
def variance_band(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 97).cast("double").alias("v"))
    d = metrics.variance_band(e, "label", "v")
    return longs(d.withColumns({c: F.floor(F.col(c) * 10000 + 0.5) / 10000 for c in ("mean", "sd", "low", "high")}))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), g AS (SELECT p_brand, count(*) AS c FROM r WHERE k <= 20 GROUP BY 1)
SELECT (SELECT p_brand FROM g ORDER BY c DESC, p_brand DESC LIMIT 1) AS dominant, max(c)/CAST(sum(c) AS DOUBLE) AS share, count(*) AS kinds FROM g""")
def top_share(spark, sf_dir):
    return metrics.top_share(table(spark, sf_dir, "part"), "p_brand", -F.col("p_retailprice"), F.col("p_partkey"))


HUMPS = "regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')"


@query(f"""WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower({HUMPS.format("p_name")}), '[^a-z0-9]+')) AS w FROM part)
SELECT p_partkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS toks FROM t WHERE w <> '' GROUP BY 1""")
def tokenised_names(spark, sf_dir):
    toks = F.array_sort(text.tokens(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(toks, " ").alias("toks")).where("toks <> ''")


# The whole scan: rules, scores, rank, ids.

SCAN = f"""WITH l AS (SELECT file, len(string_split(text, chr(10))) AS lines, CASE WHEN lang = 'en' THEN 8 ELSE 6 END AS budget FROM {C}),
f1 AS (SELECT 'large_file::' || file || '::' AS fingerprint, 'large_file' AS type, CASE WHEN CAST(lines AS DOUBLE)/budget >= 2 THEN 'high' ELSE 'medium' END AS severity,
floor(least(CAST(0.7 AS DOUBLE)+CAST(0.15 AS DOUBLE)*(CAST(lines AS DOUBLE)/budget-1), CAST(0.95 AS DOUBLE))*100+0.5)/100 AS confidence, file FROM l WHERE lines > budget),
m AS (SELECT file, len(regexp_extract_all(text, '{MARK}')) AS markers, len(string_split(text, chr(10))) AS lines FROM {C}),
f2 AS (SELECT 'marker_density::' || file || '::', 'marker_density', CASE WHEN markers >= 20 AND markers*1000.0::DOUBLE/lines >= 10 THEN 'high' WHEN markers >= 8 OR markers*1000.0::DOUBLE/lines >= 100 THEN 'medium' ELSE 'low' END, CAST(0.8 AS DOUBLE), file
FROM m WHERE markers > 0 AND (markers >= 3 OR markers*1000.0::DOUBLE/lines >= 10)),
f3 AS (SELECT 'exact_duplicate_block::' || min(file) || '::' || md5(text), 'exact_duplicate_block', 'medium', CAST(0.95 AS DOUBLE), min(file) FROM {C} GROUP BY md5(text) HAVING count(DISTINCT file) >= 2),
f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3),
t AS (SELECT max(CAST(ts AS DATE)) AS today FROM events), e AS (SELECT CAST(user_id AS VARCHAR) AS file, count(*) AS n, max(CAST(ts AS DATE)) AS day FROM events GROUP BY 1),
e2 AS (SELECT file, least(n/CAST(20 AS DOUBLE), CAST(1 AS DOUBLE)) AS churn, CASE WHEN date_diff('day', day, today) <= 7 THEN CAST(1 AS DOUBLE) WHEN date_diff('day', day, today) >= 14 THEN 0 ELSE (14-date_diff('day', day, today))/CAST(7 AS DOUBLE) END AS recency FROM e, t),
g AS (SELECT CAST(d.doc_id AS VARCHAR) AS file, CASE WHEN l.quality = 1 THEN CAST(0 AS DOUBLE) WHEN l.quality = 0 THEN 0.5 ELSE 1 END AS gap FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT f.*, floor(coalesce(churn, 0)*100+0.5)/100 AS churn, floor(coalesce(recency, 0)*100+0.5)/100 AS recency, floor(coalesce(gap, 1)*100+0.5)/100 AS test_gap FROM f LEFT JOIN e2 ON f.file = e2.file LEFT JOIN g ON f.file = g.file),
a AS (SELECT *, floor(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE)*CASE type WHEN 'large_file' THEN CAST(0.4 AS DOUBLE) WHEN 'marker_density' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END+CAST(0.2 AS DOUBLE)*churn+CAST(0.2 AS DOUBLE)*test_gap+CAST(0.2 AS DOUBLE)*0))*100+0.5)/100 AS agent_risk FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY agent_risk*(1+CAST(0.5 AS DOUBLE)*recency) DESC, {W} DESC, confidence DESC, file, fingerprint) AS rank FROM a)
SELECT printf('fnd_%05d', rank) AS id, rank, fingerprint, type, severity, confidence, file, churn, recency, test_gap, agent_risk FROM k"""


@query(SCAN)
def scan_report(spark, sf_dir):
    c = corpus(spark, sf_dir)
    f = findings.finding
    large = f(rules.large_file(c, F.when(F.col("lang") == "en", 8).otherwise(6)), "large_file", F.col("severity"), F.col("confidence"), F.col("file"), F.format_string("%d lines", "lines"))
    marks = f(rules.marker_density(c, MARK), "marker_density", F.col("severity"), F.lit(0.8), F.col("file"), F.format_string("%d markers", "markers"))
    exact = f(rules.exact_groups(c), "exact_duplicate_block", F.lit("medium"), F.lit(0.95), F.col("anchor"), F.format_string("%d files", "files"), F.col("hash"))
    rows = large.unionByName(marks).unionByName(exact)
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.count("*").alias("n"), F.max(F.to_date("ts")).alias("day"))
    today = table(spark, sf_dir, "events").agg(F.max(F.to_date("ts")).alias("today"))
    log = e.join(F.broadcast(today)).select("file", scoring.churn_score(F.col("n")).alias("churn"), scoring.recency(F.col("day"), F.col("today")).alias("recency"))
    none = spark.createDataFrame([], "file string, blast_radius double")
    intrinsic = F.when(F.col("type") == "large_file", 0.4).when(F.col("type") == "marker_density", 0.3).otherwise(0.5)
    gaps = _gaps(spark, sf_dir).withColumnRenamed("gap", "test_gap")
    out = findings.ranked(findings.scored(rows, log.select("file", "churn"), gaps, none, log.select("file", "recency"), intrinsic))
    return out.select("id", "rank", "fingerprint", "type", "severity", "confidence", "file", "churn", "recency", "test_gap", "agent_risk")
