"""The registry, its errors, and the ranges and windows of its queries."""

import pytest

from stratalens.operators import engine, graph
from stratalens.plans import fixtures
from stratalens.plans.source_queries import EXPECTED


def test_selection():
    names = [r.name for r in engine.select()]
    assert names == sorted(engine.RULES) and set(EXPECTED) == set(names)
    assert [r.name for r in engine.select(["large_file", "direct_date"], ["direct_date"])] == ["large_file"]
    with pytest.raises(ValueError, match="unknown rules: nothing"):
        engine.select(disable=["nothing"])


def test_options(spark):
    facts = engine.Facts(fixtures.files(spark).where("file = 'src/todo.ts'"))
    assert engine.scan(facts, enable=["todo_density"]).count() == 1
    assert engine.scan(facts, enable=["todo_density"], options={"todo_density": {"least": 4, "per_kloc": 1000.0}}).count() == 0
    assert engine.scan(facts, enable=[]).count() == 0
    for bad in ({"todo_density": {"nothing": 1}}, {"todo_density": {"least": "x"}}, {"large_file": {}}):
        with pytest.raises(ValueError):
            engine.scan(facts, enable=["todo_density"], options=bad)


def test_own_rules(spark):
    facts = engine.Facts(spark.createDataFrame([("a.md", "secret"), ("vendor/b.md", "secret")], "file string, text string"))
    own = engine.Rule("says_secret", lambda f, o: f.files.where(f.files.text.contains(o["word"])).selectExpr("file", "'low' AS severity"), options={"word": "secret"})
    assert [r.file for r in engine.scan(facts, rules={"says_secret": own}).collect()] == ["a.md"]
    with pytest.raises(ValueError):
        engine.register(engine.RULES["large_file"])


def test_findings_are_told_apart(spark):
    facts = engine.Facts(fixtures.files(spark))
    prints = [r.fingerprint for r in engine.scan(facts).collect()]
    assert len(prints) == len(set(prints))
    again = [r.fingerprint for r in engine.scan(engine.Facts(facts.files.repartition(5))).collect()]
    assert sorted(again) == sorted(prints)
    none = engine.scan(engine.Facts(facts.files.where("false")))
    assert none.count() == 0
    assert [r.item for r in engine.context(none, facts, "gone.ts").where("section = 'note'").collect()] == ["no such file", "no findings"]
    assert engine.unmatched(spark.createDataFrame([("gone.ts",), ("none.ts",)], "file string"), facts.files).count() == 1


def test_ranges_and_windows():
    assert engine.diff_range("main...HEAD") == ("main", "HEAD")
    for bad in ("", "main", "a..b", "a....b", "a...b...c", "...b", "a..."):
        with pytest.raises(ValueError):
            engine.diff_range(bad)
    assert [engine.window_days(x) for x in ("90d", "2w", "6m", "1y", "last week")] == [90, 14, 180, 365, None]


def test_components_without_a_closure(spark):
    import random

    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(i, i + 1) for i in range(100, 130)] + [(130, 100), (200, 201), (201, 200), (201, 300), (5, 5)]
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
        reach.setdefault(b, set())
    grown = True
    while grown:
        grown = False
        for v in reach:
            more = set().union(*(reach[w] for w in reach[v])) - reach[v] if reach[v] else set()
            if more:
                reach[v] |= more
                grown = True
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in reach if any(w != v and v in reach[w] for w in reach[v])}
    got = {r.node: r.component for r in graph.scc(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert graph.scc(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).count() == 0
