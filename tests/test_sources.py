"""Sources, stores and streams."""

import re

from pyspark.sql import functions as F

from stratalens.sources import files
from stratalens.streaming import streams


def test_globs():
    for glob, yes, no in [("**/*.ts", "a/b.ts", "a/b.tsx"), ("src/*.py", "src/x.py", "src/a/x.py"), ("**/*.{js,jsx}", "x.jsx", "x.css"), ("docs/**", "docs/a/b.md", "doc/a"), ("a?.c", "ab.c", "a/.c")]:
        assert re.search(files.glob_regex(glob), yes) and not re.search(files.glob_regex(glob), no)


def test_tree(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "src/gen/b.py": "# @generated\n", "tests/test_a.py": "import a\n", "node_modules/m.js": "1", "web/c.tsx": "y" * 600}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    d = files.sources(files.read_tree(spark, str(tmp_path), ["**/*.py", "**/*.tsx", "**/*.js"], ["src/gen/**"]))
    got = {r.file: (r.pack, r.scope) for r in d.collect()}
    assert got == {"src/a.py": ("language-py", "production"), "tests/test_a.py": ("language-py", "test"), "web/c.tsx": ("language-js", "production")}
    assert [r.file for r in d.where(files.is_minified(F.col("text"))).collect()] == ["web/c.tsx"]


def test_ignore_rules(spark):
    paths = spark.createDataFrame([("a/x.log",), ("a/b/x.log",), ("y.txt",), ("x.log",)], "file string")
    rules = spark.createDataFrame([("", 0, r"\.log$", True), ("a/b", 0, r"^x\.log$", False)], "dir string, rule_no int, pattern string, ignore boolean")
    assert sorted(r.file for r in files.ignored(paths, rules).collect()) == ["a/b/x.log", "y.txt"]


def test_tool_patterns_and_undiscovered(spark):
    p = spark.createDataFrame([("ruff", "gen/"), ("mypy", "gen/"), ("ruff", "old/"), ("ruff", "old/")], "tool string, pattern string")
    assert [r.pattern for r in files.corroborated(p).collect()] == ["gen/"]
    listed = spark.createDataFrame([(f"f{i}.e{i % 12}",) for i in range(30)] + [("seen.py",), ("Makefile",)], "file string")
    got = {r.ext: r.files for r in files.undiscovered(listed, listed.where("file = 'seen.py'")).collect()}
    assert sum(got.values()) == 31 and len(got) == 11


def test_stores(spark, tmp_path):
    (tmp_path / "fb.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","fingerprint":"a","verdict":"tp","repo":"r"}\nnot json\n')
    fb = files.read_feedback(spark, str(tmp_path / "fb.jsonl"))
    assert fb.count() == 1
    new = files.append_new(fb, fb.unionByName(fb.withColumn("fingerprint", F.lit("b"))), "repo", "timestamp", "fingerprint")
    assert [r.fingerprint for r in new.collect()] == ["b"]
    files.append_feedback(new, str(tmp_path / "out"))
    assert files.read_feedback(spark, str(tmp_path / "out"), strict=True).count() == 1


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    got = run(spark, streams.churn_stream(stream, "event_type", "ts", "user_id"), "churn", "complete")
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").count()
    assert got.agg(F.sum("change_count")).first()[0] == batch.count() and got.count() == want.count()
    assert run(spark, streams.sessions(stream, "user_id", "ts"), "sessions", "complete").agg(F.sum("events")).first()[0] == batch.count()
    last = run(spark, streams.latest_stream(stream, "user_id", "ts", "event_id"), "latest", "complete")
    want = {r.user_id: r.e for r in batch.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert {r.user_id: r.event_id for r in last.collect()} == want
