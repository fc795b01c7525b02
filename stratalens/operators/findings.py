"""The finding row, its scoring, ranking and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import agent_risk, round2, severity_rank
from .relational import ordered_ids

COLUMNS = ["fingerprint", "type", "severity", "confidence", "file", "symbol", "line_start", "line_end", "summary"]


def finding(df: DataFrame, type_: str, severity: Column, confidence: Column, file: Column, summary: Column, symbol: Column | None = None, line: Column | None = None) -> DataFrame:
    """Rows of a rule as findings; the fingerprint is type::file::symbol and knows no lines."""
    sym = F.lit("") if symbol is None else F.coalesce(symbol.cast("string"), F.lit(""))
    at = (F.lit(1) if line is None else line).cast("int")
    return df.select(
        F.concat_ws("::", F.lit(type_), file.cast("string"), sym).alias("fingerprint"), F.lit(type_).alias("type"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), file.cast("string").alias("file"), sym.alias("symbol"), at.alias("line_start"), at.alias("line_end"), summary.alias("summary"),
    )


def disambiguated(findings: DataFrame, candidate: str = "summary") -> DataFrame:
    """Fingerprints made unique in groups that share one: by content if that is unique there, else with the line."""
    from pyspark.sql import Window

    same = Window.partitionBy("fingerprint")
    n = F.count("*").over(same)
    k = F.count("*").over(Window.partitionBy("fingerprint", candidate))
    tail = F.when(k == 1, F.substring(F.sha1(candidate), 1, 12)).otherwise(F.concat(F.substring(F.sha1(candidate), 1, 12), F.lit("@L"), F.col("line_start").cast("string")))
    return findings.withColumn("fingerprint", F.when(n > 1, F.concat_ws("::", "fingerprint", tail)).otherwise(F.col("fingerprint")))


def scored(findings: DataFrame, churn: DataFrame, gaps: DataFrame, blast: DataFrame, recency: DataFrame, intrinsic: Column) -> DataFrame:
    """Findings with churn, test_gap, blast_radius, recency (0 where unknown; test gap 1) and agent_risk, two decimals."""
    d = findings
    for side, name, default in ((churn, "churn", 0.0), (gaps, "test_gap", 1.0), (blast, "blast_radius", 0.0), (recency, "recency", 0.0)):
        d = d.join(side.select("file", name), "file", "left").withColumn(name, round2(F.coalesce(name, F.lit(default))))
    return d.withColumn("agent_risk", round2(agent_risk(intrinsic, F.col("churn"), F.col("test_gap"), F.col("blast_radius"))))


def ranked(findings: DataFrame, prefix: str = "fnd") -> DataFrame:
    """rank and id by agent_risk * (1 + recency / 2), severity and confidence, all descending, then file, line, fingerprint."""
    score = F.col("agent_risk") * (1 + 0.5 * F.col("recency"))
    d = findings.withColumn("rank_score", score)
    out = ordered_ids(d, [-F.col("rank_score"), -severity_rank(F.col("severity")), -F.col("confidence")], [F.col("file"), F.col("line_start"), F.col("fingerprint")])
    return out.withColumn("id", F.format_string(f"{prefix}_%05d", F.col("rank")))
