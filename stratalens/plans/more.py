"""Further queries: drift rules, text rules, summaries and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import drift, relational, rules, source_rules
from ..sources import files
from .registry import HEAD, R2, SNAP, C, W, _findings, corpus, longs, query, table

PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


def _urls(spark, sf_dir):
    u = table(spark, sf_dir, "pages")
    return u.select(F.col("page_id").cast("string").alias("file"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS file, {PATH} AS path FROM pages WHERE regexp_matches({PATH}, '^/(?:.*/)?[^/]*\\.html$') AND NOT regexp_matches({PATH}, '^/fr/.*$')")
def discovery(spark, sf_dir):
    return files.discover(_urls(spark, sf_dir).select("file", "path"), ["/**/*.html"], ["/fr/**"], path="path")


EXT = "['ts', 'py', 'jsx', 'md', 'pyi', 'go', 'MJS']"


@query(f"SELECT CASE WHEN e IN ('ts', 'jsx', 'MJS') THEN 'language-js' WHEN e IN ('py', 'pyi') THEN 'language-py' ELSE 'universal' END AS pack, count(*) AS files FROM (SELECT {EXT}[p_partkey % 7 + 1] AS e FROM part) GROUP BY 1")
def pack_router(spark, sf_dir):
    names = F.array(*[F.lit(e) for e in EXT.strip("[]").replace("'", "").split(", ")])
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit("."), F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "part").groupBy(files.pack(path).alias("pack")).agg(F.count("*").alias("files"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS file, lower(regexp_replace(regexp_replace({PATH}, '/[0-9]+', '/{{}}', 'g'), '^/+|/+$', '', 'g')) AS route FROM pages")
def route_normalise(spark, sf_dir):
    return _urls(spark, sf_dir).select("file", text.route_key(F.regexp_replace("path", "/[0-9]+", "/:id")).alias("route"))


NAV = "(SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\">[^<]*</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href=\"[^\"]+\">([^<]*)</a>', 1)) AS label FROM pages)"


@query(f"""SELECT lower(target) AS target, count(DISTINCT CAST(page_id AS VARCHAR)) AS files, count(DISTINCT label) AS labels, min(CAST(page_id AS VARCHAR)) AS anchor FROM {NAV} GROUP BY 1
HAVING count(DISTINCT page_id) >= 2 AND count(DISTINCT label) >= 2""")
def duplicated_navigation_source(spark, sf_dir):
    html = table(spark, sf_dir, "pages")
    found = lambda g: F.regexp_extract_all("html", F.lit('<a href="([^"]+)">([^<]*)</a>'), F.lit(g))
    pairs = html.select(F.col("page_id").cast("string").alias("file"), F.explode(F.arrays_zip(found(1).alias("target"), found(2).alias("label"))).alias("x"))
    return drift.duplicated_navigation(pairs.select("file", F.lower("x.target").alias("target"), F.col("x.label").alias("label")))




@query("""WITH f AS (SELECT p_brand AS concept, CAST(p_size % 5 AS VARCHAR) AS contract, p_type AS field, CAST(min(p_size % 2) AS VARCHAR) AS kind FROM part GROUP BY 1, 2, 3),
s AS (SELECT concept, contract, count(DISTINCT field) AS n FROM f GROUP BY 1, 2),
g AS (SELECT a.concept, a.contract AS "left", b.contract AS "right", count(*) AS shared, count(CASE WHEN a.kind <> b.kind THEN 1 END) AS disagreements FROM f a JOIN f b ON a.concept = b.concept AND a.field = b.field AND a.contract < b.contract GROUP BY 1, 2, 3)
SELECT g.*, l.n AS n_left, r.n AS n_right FROM g JOIN s l ON g.concept = l.concept AND g."left" = l.contract JOIN s r ON g.concept = r.concept AND g."right" = r.contract
WHERE shared >= CAST(0.6 AS DOUBLE)*least(l.n, r.n) AND (disagreements > 0 OR l.n <> r.n)""")
def contract_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.groupBy(F.col("p_brand").alias("concept"), (F.col("p_size") % 5).cast("string").alias("contract"), F.col("p_type").alias("field")).agg(F.min(F.col("p_size") % 2).cast("string").alias("kind"))
    return drift.contract_drift(f)


@query(f"""WITH c AS (SELECT CAST(page_id AS VARCHAR) AS file, CASE page_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, lower(regexp_replace({PATH}, '^/+|/+$', '', 'g')) AS route FROM pages),
r AS (SELECT DISTINCT method, route FROM c WHERE CAST(file AS BIGINT) % 2 = 0), calls AS (SELECT * FROM c WHERE CAST(file AS BIGINT) % 2 = 1),
j AS (SELECT calls.*, (SELECT count(*) FROM r WHERE r.route = calls.route) AS k, (SELECT count(*) FROM r WHERE r.route = calls.route AND r.method = calls.method) AS m, string_split(route, '/')[1] IN (SELECT string_split(route, '/')[1] FROM r) AS s FROM calls)
SELECT file, method, route, CASE WHEN k = 0 THEN 'orphan' ELSE 'method' END AS problem FROM j WHERE (k = 0 AND s) OR (k > 0 AND m = 0)""")
def cross_language_route_drift(spark, sf_dir):
    u = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1))
    c = u.select("page_id", F.col("page_id").cast("string").alias("file"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), text.route_key(F.col("path")).alias("route"))
    # the two sides of the comparison: odd pages call, even ones serve
    return drift.route_drift(c.where("page_id % 2 = 1"), c.where("page_id % 2 = 0").select("method", "route").distinct())


@query("""WITH l AS (SELECT p_brand AS name, list(DISTINCT p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), r AS (SELECT p_brand AS name, list(DISTINCT p_size) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1),
j AS (SELECT name, len(list_intersect(l.v, r.v)) AS shared, len(l.v) AS a, len(r.v) AS b FROM l JOIN r USING (name))
SELECT name, shared, a-shared AS only_left, b-shared AS only_right, CASE WHEN a > shared AND b > shared THEN 'high' ELSE 'medium' END AS severity FROM j WHERE shared*2 >= least(a, b) AND (a > shared OR b > shared)""")
def cross_language_type_drift(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda cond: p.where(cond).groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_size").alias("values"))
    return longs(drift.type_drift(side("p_partkey % 2 = 0"), side("p_partkey % 2 = 1")))


@query("""WITH r AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name AS route, p_brand AS root, p_type || ' ' || p_name AS words FROM part), t AS (SELECT route, root, unnest(list_distinct(regexp_split_to_array(lower(words), '[^a-z0-9]+'))) AS t FROM r)
SELECT a.route, b.route AS other, count(*) AS shared FROM t a JOIN t b ON a.t = b.t AND a.route < b.route AND a.root <> b.root GROUP BY 1, 2 HAVING count(*) >= 3""")
def parallel_destination(spark, sf_dir):
    routes = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name").alias("route"), F.col("p_brand").alias("root"), F.concat("p_type", F.lit(" "), "p_name").alias("words")).distinct()
    return drift.parallel_destinations(routes.select("route", "root", F.split(F.lower("words"), "[^a-z0-9]+").alias("tokens")), least=3)


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS file, CAST(l_partkey % 50 AS VARCHAR) AS package FROM lineitem), m AS (SELECT DISTINCT CAST(p_partkey % 50 AS VARCHAR) AS package FROM part WHERE p_size > 48)
SELECT 'pkg/' || CAST(file AS VARCHAR) || '/m.py' AS file, package FROM d WHERE package NOT IN (SELECT package FROM m)""")
def dependency_provenance_gap(spark, sf_dir):
    imports = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("pkg/"), F.col("l_suppkey").cast("string"), F.lit("/m.py")).alias("file"), (F.col("l_partkey") % 50).cast("string").alias("package")).distinct()
    declared = table(spark, sf_dir, "part").where("p_size > 48").select(F.lit("pkg").alias("dir"), (F.col("p_partkey") % 50).cast("string").alias("package")).distinct()
    return drift.undeclared(imports, declared)


@query(f"SELECT file, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+@[a-z0-9]+')) AS BIGINT) AS hits, CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+@[a-z0-9]+')) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM {C} WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+@[a-z0-9]+')) > 0")
def hardcoded_literal(spark, sf_dir):
    return longs(rules.pattern_count(corpus(spark, sf_dir), "[A-Za-z0-9]+@[a-z0-9]+"))


MASKED = "text"
for _pattern, _mask in [
    (r"\b([A-Z][A-Z0-9_]{2,}(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL|AUTH)[A-Z0-9_]*)\s*=\s*\S+", r"\1=***"), (r"(?i)(--?(?:token|key|secret|password|auth|api[-_]?key)[= ])\S+", r"\1***"),
    (r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)\"?[^\s\"]+\"?", r"\1\2***"), (r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}", r"\1 ***"),
    (r"\b(?:sk|pk|ghp|gho|ghs|ghu|ghr|xox[abposr])[-_][A-Za-z0-9_-]{8,}", "***"), (r"\b[A-Za-z0-9+/]{40,}={0,2}", "***"),
]:
    MASKED = f"regexp_replace({MASKED}, '{_pattern}', '{_mask}', 'g')"


@query(f"SELECT file, md5({MASKED}) AS redacted FROM {C} WHERE regexp_matches(text, '[0-9]') AND {MASKED} <> text")
def secret_redaction(spark, sf_dir):
    d = corpus(spark, sf_dir).where(F.col("text").rlike("[0-9]")).withColumn("_r", text.redacted(F.col("text")))
    return d.where("_r <> text").select("file", F.md5("_r").alias("redacted"))


@query("""WITH a AS (SELECT doc_id, octet_length(encode(text)) AS size FROM documents) SELECT doc_id, size / CAST(1000 AS DOUBLE) AS kb, CASE WHEN size >= 10000 THEN 'high' WHEN size >= 5000 THEN 'medium' ELSE 'low' END AS severity FROM a WHERE size >= 2000""")
def oversized_asset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return source_rules.oversized(d, F.col("size"), (2, 5, 10)).select("doc_id", "kb", "severity")


@query(f"SELECT fingerprint, file, o_orderkey FROM ({SNAP}) QUALIFY row_number() OVER (PARTITION BY file ORDER BY {W} DESC, o_orderkey) <= 3")
def per_file_cap(spark, sf_dir):
    return drift.capped(_findings(spark, sf_dir), "file", 3, -scoring.severity_rank(F.col("severity")), F.col("o_orderkey")).select("fingerprint", "file", "o_orderkey")


@query(f"SELECT file, CAST(max({W}) AS BIGINT) AS worst, count(*) AS findings, CASE max({W}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk_level FROM ({HEAD}) GROUP BY 1")
def context_risk(spark, sf_dir):
    h = relational.first_per_key(_findings(spark, sf_dir, "head"), "fingerprint", F.col("file"), F.col("severity"))
    g = h.groupBy("file").agg(F.max(scoring.severity_rank(F.col("severity"))).alias("worst"), F.count("*").alias("findings"))
    return longs(g.withColumn("risk_level", F.when(F.col("worst") == 3, "high").when(F.col("worst") == 2, "medium").otherwise("low")))


LADDER = "greatest(CAST(0.05 AS DOUBLE), least(CAST(0.98 AS DOUBLE), CAST(0.72 AS DOUBLE) + CASE WHEN l_discount > 0.05 THEN CAST(0.15 AS DOUBLE) ELSE 0 END + CASE WHEN l_tax > 0.04 THEN CAST(-0.3 AS DOUBLE) ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN CAST(0.2 AS DOUBLE) ELSE 0 END))"


@query(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {R2.format(LADDER)} AS confidence, CASE WHEN {LADDER} >= CAST(0.7 AS DOUBLE) THEN 'high' WHEN {LADDER} >= CAST(0.4 AS DOUBLE) THEN 'medium' ELSE 'low' END AS severity FROM lineitem")
def confidence_ladder(spark, sf_dir):
    c = scoring.ladder(0.72, (F.col("l_discount") > 0.05, 0.15), (F.col("l_tax") > 0.04, -0.3), (F.col("l_returnflag") == "R", 0.2))
    return longs(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.round2(c).alias("confidence"), scoring.severity_of(c).alias("severity")))


@query("SELECT role AS agent, CAST(sum(turn % 3) AS BIGINT) AS passed, CAST(sum(3) AS BIGINT) AS total, floor(sum(turn % 3)/CAST(sum(3) AS DOUBLE)*10000+0.5)/10000 AS rate FROM conversations GROUP BY 1")
def pass_rate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("role").alias("agent"), (F.col("turn") % 3).alias("p"), F.lit(3).cast("bigint").alias("t"))
    return drift.pass_rates(c, "agent", "p", "t").withColumn("rate", F.floor(F.col("rate") * 10000 + 0.5) / 10000)


M4 = "floor(avg({})*10000+0.5)/10000"


@query(f"""WITH a AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (user_id))
SELECT count(CASE WHEN a IS NULL THEN 1 END) AS entered, count(CASE WHEN b IS NULL THEN 1 END) AS gone, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS stable,
{M4.format("CASE WHEN a IS NULL THEN b END")} AS entered_mean, {M4.format("CASE WHEN b IS NULL THEN a END")} AS gone_mean, {M4.format("CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END")} AS stable_mean FROM j""")
def population_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda k: e.where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.count("*").cast("double").alias("n"))
    d = drift.population_diff(side(0), side(1), "user_id", "n")
    return d.withColumns({c: F.floor(F.col(c) * 10000 + 0.5) / 10000 for c in ("entered_mean", "gone_mean", "stable_mean")})


@query("""WITH g AS (SELECT source, min(abs(n_chars-2000)) AS margin, count(*) AS "rows" FROM documents GROUP BY 1), s AS (SELECT *, "rows"/CAST(sum("rows") OVER () AS DOUBLE) AS x FROM g)
SELECT source, margin, "rows", floor(x*10000+0.5)/10000 AS share, margin <= 5 AND x > 0.25 AS cliff FROM s""")
def depth_margins(spark, sf_dir):
    d = drift.depth_margins(table(spark, sf_dir, "documents"), "source", "n_chars", 2000)
    return d.withColumn("share", F.floor(F.col("share") * 10000 + 0.5) / 10000)


@query("SELECT max(CASE WHEN n_chars < 2000 THEN n_chars END) AS below, min(CASE WHEN n_chars >= 2000 THEN n_chars END) AS above, 2000-max(CASE WHEN n_chars < 2000 THEN n_chars END) AS margin_below, min(CASE WHEN n_chars >= 2000 THEN n_chars END)-2000 AS margin_above FROM documents")
def floor_placement(spark, sf_dir):
    return drift.floor_placement(table(spark, sf_dir, "documents"), "n_chars", 2000)


@query(f"SELECT substring(sha1(text), 1, 12) AS discriminator, count(*) AS files FROM {C} GROUP BY 1")
def content_discriminator(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy(text.discriminator(F.col("text")).alias("discriminator")).agg(F.count("*").alias("files"))
