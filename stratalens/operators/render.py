"""What reports say: groups, caps, sentences, and lines for people. Caps here are a report's feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import severity_rank

TOP_FILES, PER_FILE, REPO = 5, 8, 5
EFFORTS, DEFAULT_EFFORT = ("trivial", "small", "medium", "large"), "small"


def file_groups(findings: DataFrame) -> DataFrame:
    """Per file: the sum of rank scores, the worst severity (rank), how many findings, and their types."""
    return findings.groupBy("file").agg(F.sum("rank_score").alias("score"), F.max(severity_rank(F.col("severity"))).alias("max_severity"), F.count("*").alias("findings"), F.countDistinct("type").alias("types"))


def shown(findings: DataFrame, top_files: int = TOP_FILES, per_file: int = PER_FILE) -> DataFrame:
    """The findings that a grouped report shows: the first `per_file` of each of the `top_files` files, with the number left out."""
    first = file_groups(findings).orderBy(F.col("score").desc(), F.col("max_severity").desc(), "file").limit(top_files)
    w = Window.partitionBy("file").orderBy(F.col("rank_score").desc(), "fingerprint")
    d = findings.join(first.select("file", "findings"), "file").withColumn("place", F.row_number().over(w))
    return d.where(F.col("place") <= per_file).withColumn("left_out", F.greatest(F.col("findings") - per_file, F.lit(0))).drop("findings")


def risk_summary(findings: DataFrame) -> DataFrame:
    """Per file: the most churn and blast radius, and the commonest test gap (the least of equally common ones)."""
    gaps = findings.groupBy("file", "test_gap").agg(F.count("*").alias("n")).groupBy("file").agg(F.max_by("test_gap", F.struct("n", -F.col("test_gap"))).alias("test_gap"))
    return findings.groupBy("file").agg(F.max("churn").alias("churn"), F.max("blast_radius").alias("blast_radius")).join(gaps, "file")


def hotspot_order(hotspots: DataFrame, top: int) -> DataFrame:
    """The first hotspots by risk, changes, severity and name, with a note where all of them have the same risk."""
    d = hotspots.orderBy(F.col("risk").desc(), F.col("change_count").desc(), F.col("max_severity").desc(), "file").limit(top)
    every = Window.partitionBy()
    tie = (F.min("risk").over(every) == F.max("risk").over(every)) & (F.count("*").over(every) > 1)  # at most `top` rows
    return d.withColumn("note", F.when(tie, "all listed files have the same risk"))


def recommended_action(verdict: Column, new_high: Column) -> Column:
    worse = F.when(new_high > 0, "fix the new high findings before merging").otherwise("look at the new findings: they outweigh what was cleaned up")
    return F.when(verdict == "worse", worse).when(verdict.isin("better", "cleaner"), "merge: it removes more weight than it adds").when(verdict == "unchanged", "nothing changed against the base").otherwise("a trade-off: look at new and fixed findings alike")


def triage_verdict(disposition: Column) -> Column:
    """The feedback that a triage disposition stands for."""
    return F.when(disposition.startswith("fix-") | (disposition == "needs-design"), "tp").when(disposition == "scaffolding", "known").when(disposition == "wont-fix", "ask")


def behind_minor(pinned: Column, current: Column) -> Column:
    """Whether a version's major.minor is less than another's; what cannot be read counts as equal."""
    part = lambda c, k: F.nullif(F.regexp_extract(c, r"^v?(\d+)\.(\d+)", k), F.lit("")).cast("int")
    pair = lambda c: F.struct(part(c, 1).alias("a"), part(c, 2).alias("b"))
    known = part(pinned, 1).isNotNull() & part(current, 1).isNotNull()
    return F.when(known, pair(pinned) < pair(current)).otherwise(False)


def recheck(feedback: DataFrame, current: Column, notes: DataFrame) -> DataFrame:
    """Feedback of earlier minor versions, with the release note on its type, if any. notes: (finding_type, note)."""
    d = feedback.where(behind_minor(F.col("version"), current))
    return d.join(notes.select("finding_type", F.col("note").alias("release_note")), "finding_type", "left")


def feedback_markdown(feedback: DataFrame) -> DataFrame:
    """(finding_type, text): a section per type with a line per finding, in order of time; a section holds its type's own feedback."""
    line = F.format_string("- [%s] %s%s", "verdict", "fingerprint", F.when(F.length(F.coalesce("note", F.lit(""))) > 0, F.concat(F.lit(": "), F.col("note"))).otherwise(""))
    g = feedback.groupBy("finding_type").agg(F.sort_array(F.collect_list(F.struct("timestamp", line.alias("line")))).alias("rows"))
    return g.select("finding_type", F.concat(F.lit("## "), F.col("finding_type"), F.lit("\n\n"), F.array_join("rows.line", "\n")).alias("text"))


def scan_lines(findings: DataFrame) -> DataFrame:
    """(rank, text): a line per finding for people."""
    mark = F.when(F.col("severity") == "high", "!!!").when(F.col("severity") == "medium", "!! ").otherwise("!  ")
    return findings.select("rank", F.format_string("%s %s  %s:%d  %s", mark, F.col("id"), F.col("file"), F.col("line_start"), F.col("summary")).alias("text"))


def remove(store: DataFrame, keys: DataFrame, key: str = "fingerprint") -> DataFrame:
    """A store without the rows of some keys."""
    return store.join(keys.select(key).distinct(), key, "left_anti")


def backfilled(findings: DataFrame, defaults: DataFrame) -> DataFrame:
    """Findings with effort and fix_shape; missing or invalid ones from the type's defaults (type, effort, fix_shape), else general ones."""
    d = findings.join(defaults.select("type", F.col("effort").alias("_e"), F.col("fix_shape").alias("_f")), "type", "left")
    effort = F.when(F.col("effort").isin(*EFFORTS), F.col("effort")).otherwise(F.coalesce("_e", F.lit(DEFAULT_EFFORT)))
    return d.withColumn("effort", effort).withColumn("fix_shape", F.coalesce(F.nullif(F.trim("fix_shape"), F.lit("")), "_f", F.lit("review"))).drop("_e", "_f")


def rate_change(rates: DataFrame, pinned: DataFrame, band: float = 0.1) -> DataFrame:
    """Per agent: rate, pinned rate, difference, and up, down or same within the band."""
    d = rates.join(pinned.select("agent", F.col("rate").alias("pinned")), "agent").withColumn("delta", F.col("rate") - F.col("pinned"))
    return d.withColumn("change", F.when(F.col("delta") > band, "up").when(F.col("delta") < -band, "down").otherwise("same"))


def weighted_mean(samples: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the mean of values by weight, and the sum of weights; no weight gives a null mean."""
    return samples.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))
