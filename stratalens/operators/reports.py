"""Reports: set algebra over findings (fingerprint, type, severity, file, …) and stores keyed by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import SEVERITIES, hotspot_risk, round2, severity_rank
from .relational import classify_sets, first_per_key


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """fingerprint, status and severity (of the head, else the base); the first row per fingerprint counts on either side."""
    b, h = (first_per_key(d, "fingerprint", F.col("file"), F.col("severity")) for d in (base, head))
    sides = b.select("fingerprint", F.col("severity").alias("_s")).join(h.select("fingerprint", "severity"), "fingerprint", "full_outer")
    return classify_sets(b, h, "fingerprint").join(sides.select("fingerprint", F.coalesce("severity", "_s").alias("severity")), "fingerprint")


def verdict(changes: DataFrame) -> DataFrame:
    """One row: weighted new and fixed severities and the verdict. A new high is worse; a tie mixed; nothing unchanged."""
    w = severity_rank(F.col("severity"))
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, w)), F.lit(0))
    high = F.count(F.when((F.col("status") == "new") & (F.col("severity") == "high"), 1))
    row = changes.agg(of("new").alias("new_weight"), of("fixed").alias("fixed_weight"), high.alias("new_high"))
    same = (F.col("new_weight") == 0) & (F.col("fixed_weight") == 0)
    name = F.when(F.col("new_high") > 0, "worse").when(same, "unchanged").when(F.col("new_weight") > F.col("fixed_weight"), "worse").when(F.col("new_weight") < F.col("fixed_weight"), "better").otherwise("mixed")
    return row.withColumn("verdict", name)


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """One row: findings at or above a severity, and whether the gate fails."""
    hit = severity_rank(F.col("severity")) >= SEVERITIES[fail_on]
    return findings.agg(F.count(F.when(hit, 1)).alias("hits"), F.count("*").alias("findings")).withColumn("failed", F.col("hits") > 0)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")])


def suppressed(findings: DataFrame, suppressions: DataFrame, minor: Column) -> DataFrame:
    """Findings with state: active, suppressed, or resurfaced where the pinned minor version is behind `minor`."""
    d = findings.join(suppressions.select("fingerprint", "reason", "pinned_minor"), "fingerprint", "left")
    state = F.when(F.col("reason").isNull(), "active").when(F.col("pinned_minor") < minor, "resurfaced").otherwise("suppressed")
    return d.withColumn("state", state)


def triaged(findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Findings with visibility by disposition: hidden (wont-fix, scaffolding), shown (fix-*), or annotated."""
    d = findings.join(triage.select("fingerprint", "disposition"), "fingerprint", "left")
    v = F.when(F.col("disposition").isNull(), "shown").when(F.col("disposition").isin("wont-fix", "scaffolding"), "hidden").when(F.col("disposition").startswith("fix-"), "shown").otherwise("annotated")
    return d.withColumn("visibility", v)


def resurfaced(triage: DataFrame, baseline: DataFrame, changed: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of changed files that triage or the baseline knew: fingerprint, origin; triage goes first."""
    here = findings.join(changed.select("file").distinct(), "file", "left_semi")
    d = here.join(triage.select("fingerprint", F.lit("triage").alias("_t")), "fingerprint", "left").join(baseline.select("fingerprint", F.lit("baseline").alias("_b")), "fingerprint", "left")
    return d.withColumn("origin", F.coalesce("_t", "_b")).where("origin IS NOT NULL").select("fingerprint", "file", "origin")


def audit(suppressions: DataFrame, today: Column, stale_days: int = 180, least_reason: int = 16) -> DataFrame:
    """Suppressions that are stale, or whose reason is short or vague."""
    age = F.datediff(today, F.col("created_at"))
    d = suppressions.withColumn("age_days", age).withColumn("stale", age > stale_days).withColumn("short_reason", F.length("reason") < least_reason)
    d = d.withColumn("vague_reason", F.lower("reason").rlike("^(?:todo|later|tmp|temp|ignore|skip|n/?a|false positive)"))
    return d.where("stale OR short_reason OR vague_reason")


def hotspots(churn: DataFrame, findings: DataFrame) -> DataFrame:
    """Per file of either side: change_count, finding_count, max_severity (rank) and risk."""
    f = findings.groupBy("file").agg(F.count("*").alias("finding_count"), F.max(severity_rank(F.col("severity"))).alias("max_severity"))
    d = churn.join(f, "file", "full_outer").select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("change_count", "finding_count", "max_severity")])
    return d.withColumn("risk", round2(hotspot_risk(F.col("change_count"), F.col("max_severity"))))


def upsert(store: DataFrame, rows: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The store with `rows` in place of those of equal key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def related_files(files: DataFrame, same_dir: float = 0.25, same_token: float = 0.4, top: int = 10, salts: int = 32) -> DataFrame:
    """Per file its `top` most related ones (a report limit): file, other, score. files: (file, dir, token), by whose evidence files are related.

    A file's partners are scored by what they share: directory and token, one of them, or nothing
    (then they are no partners); equal scores go by name. Since all members of a group score alike,
    the first top + 1 of each group suffice, and those of a directory or a token are among the first
    of its parts. A group's names meet its files in `salts` parts, so a group of any size is no single
    task's work, and a row never carries more than two such lists: no pairs are listed or summed up.
    """
    # keys within structs: no filter on nulls gets below the windows, so all kinds share one exchange of `few`
    d = files.where("file IS NOT NULL").select("file", *[F.struct(F.col(k).alias("of")).alias(k) for k in ("dir", "token")], F.pmod(F.xxhash64("file"), F.lit(salts)).alias("_salt"))
    first = lambda rows, *by: rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy("file"))).where(F.col("_r") <= top + 1).drop("_r")
    few = first(d, "dir", "token", "_salt")
    d = d.withColumn("_best", F.array().cast("array<struct<less: double, other: string>>"))
    kinds = [(["dir", "token"], same_dir + same_token), (["token"], same_token), (["dir"], same_dir)]
    none = F.array().cast("array<string>")
    for keys, weight in sorted(kinds, key=lambda k: -k[1]):
        others = first(few, *keys).groupBy(*keys).agg(F.collect_set("file").alias("_others"))  # at most top + 1
        d = d.join(few.select(*keys, "_salt").distinct().join(others, keys), [*keys, "_salt"], "left")
        known = F.concat(*[f"{k}.of" for k in keys]).isNotNull()
        new = F.array_except(F.coalesce(F.when(known, F.col("_others")), none), F.concat(F.array("file"), F.col("_best.other")))
        less = -round2(F.lit(weight))
        found = F.transform(new, lambda x: F.struct(less.alias("less"), x.alias("other")))  # noqa: B023
        d = d.withColumn("_best", F.slice(F.array_sort(F.concat("_best", found)), 1, top)).drop("_others")
    own = Window.partitionBy("file")  # a file may have several rows of evidence
    d = d.select("file", F.collect_list("_best").over(own).alias("_all"), F.row_number().over(own.orderBy("file")).alias("_rn")).where("_rn = 1")
    every = F.array_sort(F.flatten("_all"))
    names = F.slice(F.array_distinct(F.transform(every, lambda x: x["other"])), 1, top)
    best = F.transform(names, lambda o: F.filter(every, lambda x: x["other"] == o)[0])
    d = d.select("file", F.explode(F.when(F.size("_all") == 1, F.col("_all")[0]).otherwise(best)).alias("_b"))
    return d.select("file", "_b.other", (-F.col("_b.less")).alias("score"))
