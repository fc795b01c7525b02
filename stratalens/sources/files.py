"""Source trees as DataFrames: files, commits, keyed JSON stores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directories that are never walked, whatever a user includes.
NEVER = (".git", ".hg", ".svn", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".turbo", ".gradle", "node_modules")
# What is read, and what is left out of it unless a user lifts the defaults.
INCLUDE = ["**/*.{ts,tsx,js,jsx,mjs,cjs,cts,mts}", "**/*.{py,pyi}", "**/*.{rs,go,rb,java,kt,scala,swift,c,h,cpp,hpp,cs,php,ex,exs,lua,sh,bash,zsh}", "**/*.{md,mdx,markdown,rst,adoc,asciidoc,txt}", "**/*.{json,yaml,yml,toml}"]
EXCLUDE = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/out/**", "**/coverage/**", "**/*.min.js", "**/*.generated.*", "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock", "**/npm-shrinkwrap.json", "**/Cargo.lock", "**/poetry.lock", "**/uv.lock", "**/composer.lock", "**/*.lock", "**/tsconfig*.json", "**/pnpm-workspace.yaml"]
ASSETS = ["**/*.{png,jpg,jpeg,gif,webp,avif,svg}"]
COMMITS = T.StructType([T.StructField("file", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("author", T.StringType())])
FEEDBACK = T.StructType([T.StructField(n, t) for n, t in (("timestamp", T.TimestampType()), ("version", T.StringType()), ("fingerprint", T.StringType()), ("finding_type", T.StringType()), ("verdict", T.StringType()), ("note", T.StringType()), ("repo", T.StringType()), ("_corrupt_record", T.StringType()))])
STORES = {
    "baseline": "fingerprint string, type string, charge string, severity string, file string, symbol string",
    "suppressions": "fingerprint string, type string, file string, symbol string, reason string, created_at timestamp, created_by string, source string, pinned_version string",
    "triage": "fingerprint string, type string, file string, symbol string, disposition string, reason string, owner string, date date",
}


def glob_regex(pattern: str) -> str:
    """A glob with **, *, ? and {a,b} as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def matches(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def discover(paths: DataFrame, include: list[str], exclude: list[str] = (), path: str = "file") -> DataFrame:
    """Rows whose path is included, not excluded and under none of the directories that are never walked."""
    c = F.col(path)
    walked = ~c.rlike("(?:^|/)(?:" + "|".join(map(re.escape, NEVER)) + ")/")
    return paths.where(matches(c, list(include)) & ~matches(c, list(exclude)) & walked)


def read_tree(spark: SparkSession, root: str, include: list[str] = ("**",), exclude: list[str] = ()) -> DataFrame:
    """(file, size, content) of a tree in any store Spark reads; binary until decoded. Spark lists no files of zero bytes."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    base = re.sub("^[a-z]+:/+", "/", root).rstrip("/") + "/"
    return discover(d.select(F.substring(at, len(base) + 1, 1 << 30).alias("file"), F.col("length").alias("size"), "content"), list(include), list(exclude))


def sources(tree: DataFrame) -> DataFrame:
    """(file, text, pack, scope) of the files of a tree that are text."""
    d = tree.select("file", F.decode("content", "UTF-8").alias("text"))
    return d.withColumn("pack", pack(F.col("file"))).withColumn("scope", scope(F.col("file")))


def pack(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), "language-js").when(ext.isin("py", "pyi"), "language-py").otherwise("universal")


def scope(path: Column) -> Column:
    """What a file is for, by its path; the first that fits."""
    test = r"(?i)(?:^|/)(?:tests?|__tests__|spec|e2e)/|(?:^|/)test_[^/]+\.py$|_test\.(?:py|go)$|\.(?:test|spec)\.[a-z]+$|(?:^|/)conftest\.py$"
    folders = lambda *names: "(?:^|/)(?:" + "|".join(names) + ")/"
    rules = [
        ("generated", folders("__generated__", "generated", r"\.generated", "node_modules") + r"|\.(?:generated|gen)\.[cm]?[jt]sx?$|(?:^|/)(?:schema|graphql|api)\.generated\.|_pb2(?:_grpc)?\.pyi?$|\.pb\.go$"),
        ("vendored", folders(r"[._]?(?:vendor|vendored|third[-_]party|thirdparty|external|\.yarn)") + r"|[.-]min\.(?:js|css|mjs|cjs)$"),
        ("migration", folders("migrations?", "db/migrate", "alembic/versions", "prisma/migrations") + r"|(?:^|/)\d{6,}[-_][\w-]+\.[cm]?[jt]s$"),
        ("fixture", folders("fixtures?", "__fixtures__", "__snapshots__", "__mocks__", "snapshots?", "examples?", "samples?", "testdata", "mocks?", "stubs?")),
        ("test", test),
        ("config", r"(?:^|/)[^/]*\.config\.[cm]?[jt]s$|(?:^|/)(?:\.eslintrc|\.prettierrc|tsup|vite|vitest|webpack|rollup|jest|babel|next|tailwind|postcss)\.config\."),
    ]
    out = None
    for name, pattern in rules:
        out = F.when(path.rlike(pattern), name) if out is None else out.when(path.rlike(pattern), name)
    return out.otherwise("production")


def reportable(path: Column) -> Column:
    """Whether findings in a file are reported at all: not in generated and vendored ones."""
    return ~scope(path).isin("generated", "vendored")


def excludes(user: list[str] = (), defaults: bool = True) -> list[str]:
    """The user's exclude patterns, after the default ones unless those are lifted."""
    return list(dict.fromkeys([*(EXCLUDE if defaults else []), *user]))


def tier(path: Column, outside: list[str]) -> Column:
    """"nonDomain" for paths that one of the globs fits, else "domain"."""
    return F.when(matches(path, list(outside)), "nonDomain").otherwise("domain")


def linguist_generated(lines: DataFrame) -> DataFrame:
    """(dir, pattern) of lines (dir, line) of attribute files that mark generated sources; "-linguist-generated" and "=false" do not."""
    mark = F.regexp_extract("line", r"^\s*(?!#)(\S+)\s+(?:\S+\s+)*linguist-generated(?:=true)?(?:\s|$)", 1)
    return lines.select("dir", mark.alias("pattern")).where("pattern <> ''").distinct()


def covers(path: Column, patterns: DataFrame) -> list[str]:
    """The globs of linguist_generated() as patterns on whole paths; a bounded list of settings."""
    out = []
    for r in patterns.select("dir", "pattern").distinct().toLocalIterator():
        base = f"{r.dir}/" if r.dir else ""
        out.append(f"{base}{r.pattern}" if "/" in r.pattern.strip("/") else f"{base}**/{r.pattern}")
    return out


def is_generated(text: Column) -> Column:
    """Whether a generator's mark stands in the first 40 lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, 40), "\n").rlike("(?i)@generated|DO NOT EDIT")


def is_minified(text: Column) -> Column:
    return F.exists(F.slice(F.split(text, "\n"), 1, 40), lambda x: F.length(x) >= 500)


def ignored(paths: DataFrame, rules: DataFrame, path: str = "file") -> DataFrame:
    """Paths that ignore files don't exclude. rules: (dir, rule_no, pattern as regex on the path below dir, ignore boolean).

    Rules hold below their directory; the deepest, then the last that matches decides. Paths meet rules by their ancestors.
    """
    parts = F.split(F.regexp_extract(path, "^(.*?)/?[^/]*$", 1), "/")
    up = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    d = paths.select(path, F.explode(up).alias("dir")).join(rules, "dir")
    below = F.when(F.col("dir") == "", F.col(path)).otherwise(F.expr(f"substring({path}, length(dir) + 2)"))
    hit = d.where(F.regexp(below, F.col("pattern")))
    decided = hit.groupBy(path).agg(F.max_by("ignore", F.struct(F.length("dir"), F.col("rule_no"))).alias("_ignore")).where("_ignore")
    return paths.join(decided.select(path), path, "left_anti")


def corroborated(patterns: DataFrame, least: int = 2) -> DataFrame:
    """Exclude patterns that at least `least` distinct tools name. patterns: (tool, pattern)."""
    return patterns.groupBy("pattern").agg(F.countDistinct("tool").alias("tools")).where(F.col("tools") >= least)


def undiscovered(listed: DataFrame, discovered: DataFrame, top: int = 10) -> DataFrame:
    """Histogram by extension of listed files that weren't discovered: the `top` ones, the rest as "(other extensions)"."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("file", r"(\.[A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("(none)"))
    g = listed.join(discovered.select("file"), "file", "left_anti").groupBy(ext.alias("ext")).agg(F.count("*").alias("files"))
    # the first ones by a limit, not by a window over all extensions
    first = g.orderBy(F.col("files").desc(), "ext").limit(top).withColumn("_top", F.lit(True)).select("ext", "_top")
    named = g.join(first, "ext", "left").withColumn("ext", F.when(F.col("_top"), F.col("ext")).otherwise("(other extensions)"))
    return named.groupBy("ext").agg(F.sum("files").alias("files"))


def commits(log: DataFrame, marker: str = "COMMIT") -> DataFrame:
    """(file, ts, author) of change logs (source, text): blocks of "marker time author", then a path a line, then a blank line."""
    block = F.explode(F.split("text", r"\r?\n[ \t]*(?:\r?\n)+"))
    d = log.select("source", block.alias("block")).withColumn("at", F.regexp_extract("block", rf"(?m)^{marker}[ ]+(\S+)", 1)).where("at <> ''")
    head = rf"(?m)^{marker}[ ]+\S+[ ]*(.*)$"
    rows = d.select(F.col("at").cast("timestamp").alias("ts"), F.trim(F.regexp_extract("block", head, 1)).alias("author"), F.explode(F.split("block", r"\r?\n")).alias("file"))
    return rows.where(~F.col("file").rlike(rf"^{marker}(?: |$)") & (F.trim("file") != "")).select("file", "ts", "author")


def changes(commits: DataFrame, since: Column | None = None) -> DataFrame:
    """Per file: change_count, latest, authors (named ones)."""
    d = commits if since is None else commits.where(F.col("ts") >= since)
    return d.groupBy("file").agg(F.count("*").alias("change_count"), F.max("ts").alias("latest"), F.countDistinct(F.nullif("author", F.lit(""))).alias("authors"))


def changed_files(working: DataFrame, compared: DataFrame, existing: DataFrame) -> DataFrame:
    """(file): what the working tree or the comparison with a base names, as far as it exists."""
    return working.select("file").unionByName(compared.select("file")).distinct().join(existing.select("file"), "file", "left_semi")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMITS).json(path)


def read_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A keyed JSON store (baseline, suppressions, triage), strictly by its schema."""
    return spark.read.schema(STORES[kind]).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_feedback(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Feedback lines; bad lines are skipped unless `strict`."""
    d = spark.read.schema(FEEDBACK).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return d.where("fingerprint IS NOT NULL").drop("_corrupt_record")


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_new(store: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows that the store lacks by key, each once: what an idempotent append writes."""
    return rows.dropDuplicates(list(key)).join(store.select(*key), list(key), "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
