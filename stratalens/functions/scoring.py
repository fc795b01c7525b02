"""Scalar scoring functions as column expressions. Rounding is floor(x * 100 + 0.5) / 100 throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = {"low": 1, "medium": 2, "high": 3}


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def severity_of(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def churn_score(changes: Column) -> Column:
    return F.least(changes / 20.0, F.lit(1.0))


def recency(day: Column, today: Column) -> Column:
    """1 up to 7 days old, 0 from 14 on, linear between; whole UTC days."""
    age = F.datediff(today, day)
    return F.when(age <= 7, 1.0).when(age >= 14, 0.0).otherwise((14 - age) / 7.0)


def blast_radius(transitive: Column, direct: Column) -> Column:
    part = lambda n, most: F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(most)))
    return 0.85 * part(transitive, 2000.0) + 0.15 * part(direct, 250.0)


def agent_risk(intrinsic: Column, churn: Column, test_gap: Column, blast: Column, structural: Column | None = None) -> Column:
    risk = clamp01(0.4 * intrinsic + 0.2 * churn + 0.2 * test_gap + 0.2 * blast)
    return risk if structural is None else F.when(structural, risk * 0.3).otherwise(risk)


def hotspot_risk(changes: Column, severity: Column) -> Column:
    weight = F.when(severity == 3, 1.0).when(severity == 2, 0.6).when(severity == 1, 0.3).otherwise(0.0)
    return 0.6 * churn_score(changes) + 0.4 * weight


def intrinsic_ladder(base: float, step: float, cap: float, n: Column) -> Column:
    return F.least(base + (n - 1) * step, F.lit(cap))


def ladder(base: float, *signals: tuple[Column, float]) -> Column:
    """base plus the deltas of the signals that hold, within [0.05, 0.98]."""
    total = F.lit(base)
    for holds, delta in signals:
        total = total + F.when(holds, delta).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.98), total))
