"""Mixing against a plain fit, its targets, and defined results for odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalens.llm import mixing


def test_quantised():
    p = np.random.default_rng(0).dirichlet([0.3] * 5, 500)
    q = mixing.quantised(p)
    assert (q.sum(axis=1) == mixing.STEPS).all() and np.abs(q / mixing.STEPS - p).max() < 1 / mixing.STEPS


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(1)
    q = mixing.quantised(rng.dirichlet([0.2] * 4, 400))
    tokens = rng.integers(0, 900, 400).astype(float)
    cells = spark.createDataFrame([(a.tolist(), float(t)) for a, t in zip(q, tokens, strict=True)], "_q array<int>, _tokens double")
    for target, total in ((None, None), ([0.4, 0.3, 0.2, 0.1], 50_000.0)):
        history, goal, reached = mixing.fit_rates(cells, 4, target, total)
        assert np.allclose(goal, reached, rtol=1e-3)
        r = np.ones(400)
        for g in history:
            r = np.maximum(0, r - q @ np.array(g) / mixing.STEPS)
        got = [x.r for x in cells.select(mixing.rate(F.col("_q"), history).alias("r")).collect()]
        assert np.allclose(got, r) and r.min() >= 0
        assert np.allclose((r * tokens) @ q / mixing.STEPS, reached)


def test_posteriors_and_copies(spark, data):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels).join(docs.select("doc_id", F.col("lang").alias("_l")), "doc_id").collect()
    assert len(got) == docs.count()
    assert sum(r.domain in (r._l, "junk") for r in got) / len(got) > 0.85
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    # no domain's target is under its natural tokens, so next to nothing goes
    assert sum(r.copies == 0 for r in got) / len(got) < 0.03
    out = mixing.mixed_documents(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_natural_total_lowers_large_domains_and_least_keeps_every_row(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mix(docs, labels, total="natural").collect()
    tokens = sum(r.tokens for r in got)
    assert min(r.rate for r in got) < 1 < max(r.rate for r in got)
    assert abs(sum(r.tokens * r.rate for r in got) / tokens - 1) < 1e-3
    by = {r.domain: (r.domain_target, r.domain_reached) for r in got}
    assert all(abs(a - b) <= mixing.CLOSE * max(a, 1) for a, b in by.values())
    out = mixing.mixed_documents(docs, labels, least=1.0)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in got}
    some = mixing.mix(docs, labels, target={"en": 0.5, "de": 0.5}, total=10_000.0).collect()
    assert min(r.rate for r in some) == 0 and sum(r.copies for r in some) < len(some)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "en"), (2, "a" * 100_000, "en"), (3, "b c", "de"), (3, "b c", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS tokens", "2 AS rate")
    labels = spark.createDataFrame([(2, 1), (3, 1), (3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert mixing.mix(docs, labels).count() == 5
    none = labels.limit(0)
    assert [r.rate for r in mixing.mix(docs, none).collect()] == [1.0] * 5
    assert mixing.mixed_documents(docs, none).count() == 5
    assert mixing.mix(docs.limit(0), labels).count() == 0 and mixing.mixed_documents(docs.limit(0), labels).count() == 0


def test_close_domains_reach_their_targets(spark):
    def fit(posteriors, tokens, *more):
        q = mixing.quantised(np.array(posteriors))
        cells = spark.createDataFrame([(a.tolist(), float(t)) for a, t in zip(q, tokens, strict=True)], "_q array<int>, _tokens double")
        history, goal, reached = mixing.fit_rates(cells, q.shape[1], *more)
        r = np.ones(len(q))
        for g in history:
            r = np.maximum(0, r - q @ np.array(g) / mixing.STEPS)
        assert np.allclose((r * tokens) @ q / mixing.STEPS, reached)
        return np.array(goal), np.array(reached)

    for p in ([(0.95, 0.05), (0.85, 0.15), (0.3, 0.7)], [(0.9, 0.1), (0.7, 0.3), (0.6, 0.4)]):
        goal, reached = fit(p, [900, 90, 10])
        assert (np.abs(reached - goal) <= mixing.CLOSE * goal).all()
    rng = np.random.default_rng(3)
    for k in range(3):  # targets of hidden rates, so they can be reached; many rates are 0
        p, tokens = rng.dirichlet([2.0] * 4, 300), rng.integers(1, 900, 300)
        want = (rng.integers(0, 3, 300) * (rng.random(300) < 0.3) * tokens) @ mixing.quantised(p) / mixing.STEPS
        goal, reached = fit(p, tokens, (want / want.sum()).tolist(), want.sum())
        assert (np.abs(reached - goal) <= mixing.CLOSE * goal).all()
    # out of reach: the nearest by relative misses, here rate r of one cell with (0.5, 0.5)
    goal, reached = fit([(0.5, 0.5)], [100], [0.25, 0.75], 100.0)
    r = (0.5 / 0.25 + 0.5 / 0.75) / ((0.5 / 0.25) ** 2 + (0.5 / 0.75) ** 2)
    assert np.allclose(reached, [50 * r, 50 * r], rtol=1e-3)


def test_missed_targets_are_named(spark):
    cells = spark.createDataFrame([([32, 32], 100.0)], "_q array<int>, _tokens double")
    with pytest.warns(UserWarning, match="not reached: de: .* of 25 tokens, en"):
        mixing._fitted(cells, ["de", "en"], {"de": 0.25, "en": 0.75}, 100.0)
