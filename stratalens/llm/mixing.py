"""Mixing to target weights by soft membership.

A classifier trained on the labelled table gives every document posterior weights over domains:
its language where labelled good, or "junk" where labelled bad. Nonnegative rates per document
(how often it is taken) are fitted so that the expected tokens of each domain, the sum of rate *
tokens * posterior, meet their targets with the least change from rate 1 (squares, by tokens).
Such rates are max(0, 1 + posteriors * multipliers), so Newton steps on one multiplier per domain
find them, each from one distributed sum. A rate depends on the posteriors alone, so documents
are first summed into cells of posteriors in steps of 1 / STEPS; their number is bounded by the
grid, not by the table. Targets that no nonnegative rates reach are met with least squares of the
relative misses, and a warning names them.

Targets are shares. By default they are the natural shares to the power ALPHA (rare domains
rise). The total is given, or the corpus' own ("natural": domains above their share shrink), or
the least that lowers no domain; then rates of documents between domains may still fall under 1,
unless `least` forbids it. A document's copies are its rate, rounded up with the probability of
its fraction, by a hash of its id.

Null texts count as empty; an empty text has no tokens, even posteriors and rate as its cell.
Domains absent from the labels have no target. Without labels every document has rate 1. Rows of
equal doc_id and text get equal rates.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

STEPS, ALPHA, CLOSE = 64, 0.7, 1e-4
#: Newton steps at most; a fit that needs more is named by the warning.
ROUNDS = 200
#: Weight of the multipliers against the relative misses: so small that reachable targets are met far within CLOSE.
SOFT = 1e-8
#: Totals that are tried when no row may go, as multiples of the least that lowers no domain.
GROW = (1.0, 1.02, 1.05, 1.1, 1.2, 1.4, 2.0)
#: Labelled rows that the classifier is fitted on, the first by a hash of their id.
SAMPLE = 8_000


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the 256 byte values."""
    n = np.bincount(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), minlength=256)
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """(features + 1) x classes weights by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], classes), np.float32)
    last, goal = w, np.eye(classes, dtype=np.float32)[y]
    for k in range(rounds):
        ahead = w + (w - last) * np.float32(k / (k + 3))
        last = w
        w = ahead - np.float32(rate) * (x.T @ (_softmax(x @ ahead) - goal) / len(x) + np.float32(ridge) * ahead)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def quantised(p: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Posteriors as whole numbers that sum to `steps`, by largest remainder."""
    low = np.floor(p * steps + 1e-9).astype(np.int32)
    order = np.argsort(low - p * steps, axis=1, kind="stable")
    more = np.arange(p.shape[1])[None, :] < (steps - low.sum(axis=1))[:, None]
    np.put_along_axis(low, order, np.take_along_axis(low, order, 1) + more, 1)
    return low


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, domain, text) of at most `sample` labelled documents."""
    once = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    ids = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    domain = F.when(F.col("_q") == 0, "junk").otherwise(F.coalesce("lang", F.lit("?")))
    return docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id").select("doc_id", domain.alias("domain"), "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(domains, weights) of the classifier; only features of the sample reach the driver."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(features, na_action=None)

    rows = labelled(docs, labels, sample).select("doc_id", "domain", of("text").alias("x")).collect()  # at most `sample` rows of 256 numbers
    rows.sort(key=lambda r: (r.doc_id, r.domain))
    domains = sorted({r.domain for r in rows})
    if len(domains) < 2:
        return domains, np.zeros((257, max(1, len(domains))), np.float32)
    x, y = np.array([r.x for r in rows], np.float32), np.array([domains.index(r.domain) for r in rows])
    return domains, softmax_regression(x, y, len(domains))


def posteriors(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with _tokens (words) and _q (posteriors in steps, whole numbers that sum to STEPS)."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("tokens long, q array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            q = np.zeros((len(s), weights.shape[1]), np.int32)
            for lo in range(0, len(s), 200):
                x = np.array([features(t) for t in s.iloc[lo : lo + 200]], np.float32)
                q[lo : lo + 200] = quantised(_softmax(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ weights))
            yield pd.DataFrame({"tokens": [len((t or "").split()) for t in s], "q": list(q)})

    return docs.withColumn("_p", of(F.col(text))).select(*docs.columns, F.col("_p.tokens").alias("_tokens"), F.col("_p.q").alias("_q"))


def rate(q: Column, history: list[list[float]], least: float = 0.0) -> Column:
    """A document's rate: from 1, down each gradient in turn, never below `least`."""
    if not history:
        return F.lit(1.0)
    # one column of numbers per step; the posteriors are constant within a row
    r = F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in history])
    slope = lambda g: F.aggregate(F.zip_with(q, g, lambda a, b: a * b / STEPS), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(steps, r, lambda acc, g: F.greatest(F.lit(float(least)), acc - slope(g)))


def _sums(cells: DataFrame, by: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens by domain, Gram matrix of the posteriors with a free rate, the dual's sum over cells) at multipliers `by`."""
    n = len(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n + n * n + 1)
        for pdf in batches:
            if len(pdf):
                q, tokens = np.stack(pdf["_q"].to_list()).astype(float) / STEPS, pdf["_tokens"].to_numpy(float)
                free = q @ by
                r = np.maximum(least, 1 + free)
                total += np.concatenate([(r * tokens) @ q, ((q * (tokens * (1 + free >= least))[:, None]).T @ q).ravel(), [(tokens * (r * free - (r - 1) ** 2 / 2)).sum()]])
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    out = np.zeros(n + n * n + 1)
    for r in cells.select("_q", "_tokens").mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # one row per entry
        out[r.k] = r.v
    return out[:n], out[n:-1].reshape(n, n), out[-1]


def fit_rates(cells: DataFrame, n: int, target: list[float] | None = None, total: float | None = None, least: float = 0.0, times: float = 1.0) -> tuple[list[list[float]], list[float], list[float]]:
    """(gradients, targets, reached) for cells (_q, _tokens): until every domain is within CLOSE of its target, or as near as can be.

    Rates are at least `least`. Without `total` it is the least that lowers no domain, `times` over.
    """
    by = np.zeros(n)
    now, gram, dual = _sums(cells, by, least)
    natural = now
    if not natural.sum():
        return [], [0.0] * n, [0.0] * n
    there = natural > 0
    shares = np.where(there, natural, 0) ** ALPHA if target is None else np.where(there, np.array(target, float), 0)
    shares = np.where(there, shares, 0)
    shares = shares / shares.sum()
    goal = shares * (total if total is not None else times * max(e / w for e, w in zip(natural, shares, strict=True) if w))
    scale = np.maximum(goal, 1)
    soft = SOFT * scale**2 / scale.sum()
    # the dual of the least change, and its slope: tokens less their targets
    height = lambda x, sums: sums - x @ goal + x @ (soft * x) / 2
    for _ in range(ROUNDS):
        if np.max(np.abs(now - goal)[there] / scale[there]) < CLOSE:
            break
        slope = np.where(there, now - goal + soft * by, 0)
        if np.max(np.abs(slope) / scale) < CLOSE / 100:
            break
        # in relative units, so that rare domains count
        inner = (gram + np.diag(soft)) / np.outer(scale, scale) * scale.sum()
        step = np.linalg.lstsq(inner, slope / scale * scale.sum(), rcond=1e-15)[0] / scale
        size, here = 1.0, height(by, dual)
        while True:
            found = _sums(cells, by - size * step, least)
            if height(by - size * step, found[2]) <= here - 1e-4 * size * (slope @ step) or size < 1e-6:
                break
            size /= 2
        if size < 1e-6:
            break  # the height has no more digits
        by = by - size * step
        now, gram, dual = found
    return ([(-by).tolist()] if by.any() else []), goal.tolist(), now.tolist()


@dataclass
class Fit:
    """What a fit found: gradients of the rates, and per domain its target and the expected tokens at those rates."""

    domains: list[str]
    history: list[list[float]]
    target: list[float]
    reached: list[float]
    least: float = 0.0

    def missed(self) -> list[str]:
        return [f"{d}: {b:.0f} of {a:.0f} tokens" for d, a, b in zip(self.domains, self.target, self.reached, strict=True) if abs(b - a) >= CLOSE * max(a, 1)]


def _fitted(cells: DataFrame, domains: list[str], target: dict[str, float] | None, total: float | str | None, least: float = 0.0) -> Fit:
    """The fit over cells (_q, _tokens); warns of the targets that are not reached.

    Where rates have a floor of 1 and no total is given, the total grows by steps of GROW until
    the targets are reached.
    """
    if not domains:
        return Fit([], [], [], [])
    if total == "natural":
        total = float(cells.agg(F.sum("_tokens")).first()[0] or 0)
    for times in GROW if least and total is None else GROW[:1]:
        fit = Fit(domains, *fit_rates(cells, len(domains), target and [target.get(d, 0.0) for d in domains], total, least, times), least)
        if not fit.missed():
            return fit
    warnings.warn("mixing targets not reached: " + ", ".join(fit.missed()), stacklevel=3)
    return fit


def _cells(scored: DataFrame) -> DataFrame:
    return stored(scored.groupBy("_q").agg(F.sum("_tokens").cast("double").alias("_tokens")), "cells")


def _copies(fit: Fit) -> Column:
    """A row's whole copies: its rate, rounded up with the probability of its fraction by a hash of doc_id."""
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate(F.col("_q"), fit.history, fit.least) + chance).cast("int")


_OWN = ("text", "domain", "tokens", "posterior", "rate", "copies", "domain_target", "domain_reached")


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, total: float | str | None = None) -> DataFrame:
    """`docs` without text, with domain (likeliest), tokens, posterior, rate, copies, and the domain's target and expected tokens.

    total: tokens after mixing; "natural": as many as there are, so that domains above their
    share shrink; None: the least total that lowers no domain. Columns of `docs` with one of the
    new names are replaced.
    """
    domains, weights = train(docs, labels)
    keep = [c for c in docs.columns if c not in (*_OWN, "_q", "_tokens", "_p")]
    scored = stored(posteriors(docs.select(*keep, "text"), weights).drop("text"), "posteriors")
    fit = _fitted(_cells(scored), domains, target, total)
    of = lambda values, none: F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit(none))
    best = F.array_position("_q", F.array_max("_q")).cast("int")
    return (
        scored.withColumn("domain", F.element_at(of(domains, "?"), best))
        .withColumn("tokens", F.col("_tokens"))
        .withColumn("posterior", F.transform("_q", lambda v: v / STEPS))
        .withColumn("rate", rate(F.col("_q"), fit.history))
        .withColumn("copies", _copies(fit))
        .withColumn("domain_target", F.element_at(of(fit.target, 0.0), best))
        .withColumn("domain_reached", F.element_at(of(fit.reached, 0.0), best))
        .drop("_q", "_tokens")
    )


def mixed_documents(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, total: float | str | None = None, least: float = 0.0) -> DataFrame:
    """`docs`, each row as often as its copies say.

    The rows are written once with their posteriors, so the classifier reads every text once and
    the copies are made without Python. least: 1.0 keeps every row at least once. Columns named _q, _tokens, _n or _p are refused.
    """
    if clash := {"_q", "_tokens", "_n", "_p"} & set(docs.columns):
        raise ValueError(f"column names taken: {sorted(clash)}")
    domains, weights = train(docs, labels)
    if not domains:
        return docs
    scored = stored(posteriors(docs, weights), "scored")
    copies = _copies(_fitted(_cells(scored), domains, target, total, least))
    return scored.withColumn("_n", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*docs.columns)
