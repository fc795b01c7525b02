"""Rules that need function shapes, the import graph, manifests or documents beside a file's own text.

Inputs are DataFrames of facts; nothing is collected. Every rule gives a row per offender with a severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .relational import floor_index_percentile

TEST = r"(?i)(?:^|/)(?:tests?|__tests__|spec|e2e)/|\.(?:test|spec)\.[a-z]+$"
# Lines that a function of a shape may have, and the severities from there and from twice that on.
BUDGETS = {
    "domain": (60, "medium", "high"), "route_handler": (100, "medium", "high"), "react_component": (200, "medium", "high"), "page_export": (200, "medium", "high"),
    "test_callback": (200, "low", "medium"), "cli_command_registrar": (200, "low", "medium"), "unknown": (80, "medium", "high"),
}
HOT, REQUEST, SUPPRESSING = ("route_handler", "page_export", "react_component", "domain"), ("route_handler", "page_export", "react_component"), ("test_callback", "cli_command_registrar")


def shapes(bodies: DataFrame) -> DataFrame:
    """Functions (file, owner, line, end_line, head, body) with `shape`: what kind of function each is, by its first line, name and path."""
    head, owner, file = F.col("head"), F.col("owner"), F.col("file")
    test = (owner == "") & head.rlike(r"\b(?:it|test|describe|suite|bench|beforeAll|beforeEach|afterAll|afterEach)(?:\.\w+)*\s*\(")
    cli = owner.rlike(r"^register[A-Z][A-Za-z0-9]*(?:Command|Subcommand)$") & F.col("body").contains(".command(") | (owner == "") & head.rlike(r"\.action\s*\(")
    verb = owner.isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS") & head.rlike(r"\bexport\b") & ~head.rlike(r"\bdefault\b") & file.rlike(r"(?:^|/)(?:src/)?app/")
    api = head.rlike(r"\bexport\s+default\b") & file.rlike(r"(?:^|/)(?:src/)?pages/api/")
    page = head.rlike(r"\bexport\s+default\b") & (file.rlike(r"(?:^|/)(?:src/)?app/(?:.*/)?(?:page|layout|template|default|error|loading|not-found)\.[jt]sx?$") | file.rlike(r"(?:^|/)(?:src/)?pages/(?!api/)\S*\.[jt]sx?$"))
    react = owner.rlike("^[A-Z]") & F.col("body").rlike(r"<[A-Za-z][\w.]*(?:\s[^<>]*)?/?>") & file.rlike(r"\.[jt]sx$")
    shape = F.when(test, "test_callback").when(cli, "cli_command_registrar").when(verb | api, "route_handler").when(page, "page_export").when(react, "react_component").when(owner != "", "domain").otherwise("unknown")
    return bodies.withColumn("shape", shape)


def large_function(shaped: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """Functions longer than their shape's budget; twice over is worse."""
    limit, low, high = (F.lit(BUDGETS["unknown"][k]) for k in range(3))
    for name, (n, a, b) in BUDGETS.items():
        own = F.col("shape") == name
        limit, low, high = F.when(own, (budgets or {}).get(name, n)).otherwise(limit), F.when(own, a).otherwise(low), F.when(own, b).otherwise(high)
    d = shaped.select("file", "owner", "line", "shape", (F.col("end_line") - F.col("line") + 1).alias("lines"), limit.alias("budget"), low.alias("_low"), high.alias("_high")).where("lines > budget")
    return d.withColumn("severity", F.when(F.col("lines") >= 2 * F.col("budget"), F.col("_high")).otherwise(F.col("_low"))).drop("_low", "_high")


def direct_date(facts: DataFrame) -> DataFrame:
    """Files that read the clock, outside tests and clock modules; where no reading is compared, medium at most."""
    d = facts.where("kind = 'clock'").where(~F.col("file").rlike(TEST) & ~F.col("file").rlike(r"(?:^|/)(?:clock|time)\.[cm]?[jt]sx?$"))
    g = d.groupBy("file").agg(F.count("*").alias("reads"), F.count_if("flag").alias("compared"), F.min("line").alias("line"))
    return g.withColumn("severity", F.when((F.col("compared") > 0) & (F.col("reads") >= 8), "high").when(F.col("reads") >= 2, "medium").otherwise("low"))


def sync_io_in_hotpath(facts: DataFrame, shaped: DataFrame) -> DataFrame:
    """Blocking calls within functions that run on requests, renders or domain calls, unless a test or command registrar is around them."""
    calls = facts.where("kind = 'sync_io'").select("file", "name", F.col("line").alias("at"))
    around = calls.join(shaped.select("file", "shape", "line", "end_line"), "file").where("at BETWEEN line AND end_line")
    is_in = lambda names: F.max(F.col("shape").isin(*names))
    g = around.groupBy("file", "name", "at").agg(is_in(HOT).alias("hot"), is_in(REQUEST).alias("request"), is_in(SUPPRESSING).alias("off")).where("hot AND NOT off")
    g = g.groupBy("file").agg(F.count("*").alias("calls"), F.max("request").alias("request"), F.min("at").alias("line"))
    return g.withColumn("severity", F.when(F.col("request") & (F.col("calls") >= 2), "high").when(F.col("request"), "medium").otherwise("low"))


def circular_dependency(edges: DataFrame) -> DataFrame:
    """Cycles of files over imports of values (src, dst, type_only): anchor, size, members."""
    value = edges.where("NOT coalesce(type_only, false)") if "type_only" in edges.columns else edges
    g = graph.scc(value.select("src", "dst")).groupBy(F.col("component").alias("anchor")).agg(F.count("*").alias("size"))
    return g.withColumn("severity", F.when(F.col("size") >= 3, "high").otherwise("medium"))


def fan_offenders(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose fan-in or fan-out reaches the 95th percentile of all (5 at least); the 99th (8 at least) is medium.

    Fan-in of which four fifths only want types is never more than low. Fewer than five files: none.
    """
    d = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(F.coalesce("type_only", F.lit(False))).alias("type_only"))
    out = d.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("fan_out"))
    into = d.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("fan_in"), F.count_if("type_only").alias("typed"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = files.select("file").distinct().join(out, "file", "left").join(into, "file", "left").select("file", n("fan_out"), n("fan_in"), n("typed"))
    cut = None
    for side in ("fan_in", "fan_out"):
        for p, least, name in ((0.95, 5, "cutoff"), (0.99, 8, "far")):
            one = floor_index_percentile(every, side, p).select(F.greatest("cutoff", F.lit(least)).alias(f"{side}_{name}"), F.col("n").alias(f"_{side}_{name}"))
            cut = one if cut is None else cut.crossJoin(one)  # one row each
    d = every.join(F.broadcast(cut)).where("_fan_in_cutoff >= 5 AND (fan_in >= fan_in_cutoff OR fan_out >= fan_out_cutoff)")
    asked = (F.col("fan_in") >= F.col("fan_in_far")) & ~((F.col("fan_in") > 0) & (F.col("typed") >= 0.8 * F.col("fan_in")))
    return d.select("file", "fan_in", "fan_out", F.when(asked | (F.col("fan_out") >= F.col("fan_out_far")), "medium").otherwise("low").alias("severity"))


# Words of rules, and the concepts that a rule may be about with the forms that name them.
RULE_TERMS = ["must", "never", "always", "only", "required", "forbidden", "unless", "except", "until", "after", "before", "do not", "don't", "cannot", "can't", "important"]
CONCEPTS = {
    "admin": ["admin", "administrator"], "owner": ["owner", "ownership"], "role": ["role"], "plan": ["plan"], "tier": ["tier"], "billing": ["billing"], "payment": ["payment"],
    "refund": ["refund"], "timezone": ["timezone"], "utc": ["utc"], "cache": ["cache"], "retry": ["retry", "retries"], "idempotent": ["idempotent", "idempotency"], "permission": ["permission"],
    "auth": ["auth", "authz", "authn", "authorize", "authorise", "authorization", "authorisation", "authenticate", "authentication"],
}


def _says(text: Column, forms: list[str]) -> Column:
    return text.rlike("(?<![a-z0-9])(?:" + "|".join(forms) + ")(?:s|es|d|ed|r|rs|ing)?(?![a-z0-9])")


def logic_in_comments(facts: DataFrame, files: DataFrame, nearby: int = 16, per_file: int = 5) -> DataFrame:
    """Comments that state a rule about a concept that the next `nearby` lines do not mention; the first `per_file` of a file (a report limit)."""
    c = facts.where("kind = 'comment'").where(~F.col("name").startswith("/**") & ~F.col("name").rlike("(?i)TODO|FIXME|XXX|HACK")).select("file", "line", "end_line", F.lower("name").alias("said"))
    after = F.lower(F.array_join(F.slice(F.split("text", "\r?\n"), F.col("end_line") + 1, nearby), "\n"))
    c = c.join(files.select("file", "text"), "file").select("file", "line", "end_line", "said", after.alias("after"))
    terms = F.size(F.filter(F.array(*[F.when(_says(F.col("said"), [t]), F.lit(t)) for t in RULE_TERMS]), lambda x: x.isNotNull()))
    named = F.filter(F.array(*[F.when(_says(F.col("said"), f), F.lit(k)) for k, f in CONCEPTS.items()]), lambda x: x.isNotNull())
    # in code a concept may be part of a longer name
    missing = F.filter(F.array(*[F.when(_says(F.col("said"), f) & ~F.col("after").rlike("|".join(f)), F.lit(k)) for k, f in CONCEPTS.items()]), lambda x: x.isNotNull())
    d = c.select("file", "line", "end_line", terms.alias("rules"), F.size(named).alias("concepts"), missing.alias("missing")).where("rules >= 2 AND concepts >= 1 AND size(missing) > 0")
    route = F.col("file").rlike(r"(?i)(?:^|/)(?:routes?|api|app)/|route\.[jt]sx?$")
    d = d.withColumn("severity", F.when(route | (F.col("rules") + F.col("concepts") >= 6), "medium").otherwise("low"))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("_n") <= per_file).drop("_n")


# Manifests and documents.


def manifests(files: DataFrame) -> DataFrame:
    """(dir, kind, package, specifier) of the dependencies that package.json files declare."""
    d = files.where(F.col("file").rlike(r"(?:^|/)package\.json$")).select(F.regexp_extract("file", "^(.*?)/?[^/]*$", 1).alias("dir"), "text")
    parts = []
    for kind in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        own = F.from_json(F.get_json_object("text", f"$.{kind}"), "map<string,string>")
        parts.append(d.select("dir", F.lit(kind).alias("kind"), F.explode(own).alias("package", "specifier")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def specifier_shape(c: Column) -> Column:
    """exact, range, any, workspace, git (pinned-git with a full hash), file, alias or tag."""
    git = c.rlike(r"^(?:git\+|git:|github:|gitlab:|bitbucket:)|\.git(?:#|$)|^[\w.-]+/[\w.-]+(?:#|$)")
    return (
        F.when(c.rlike(r"^(?:workspace|catalog):"), "workspace").when(c.rlike(r"^(?:file|link|portal):|^\.{0,2}/"), "file").when(c.startswith("npm:"), "alias")
        .when(git & c.rlike(r"#[0-9a-f]{40}$"), "pinned-git").when(git, "git").when(c.isin("", "*", "latest", "x"), "any")
        .when(c.rlike(r"^v?\d+\.\d+\.\d+(?:[-+][\w.-]+)?$"), "exact").when(c.rlike(r"^[~^<>=\d]|\d\.x"), "range").otherwise("tag")
    )


def unpinned(declared: DataFrame) -> DataFrame:
    """Dependencies whose specifier pins nothing: any version, a tag, or a moving git reference."""
    d = declared.withColumn("shape", specifier_shape(F.col("specifier"))).where("shape IN ('any', 'git', 'tag')")
    return d.withColumn("severity", F.when(F.col("shape") == "tag", "low").otherwise("medium"))


def lock_names(files: DataFrame) -> DataFrame:
    """(dir, package) that lock files of npm, pnpm and yarn name."""
    at = F.regexp_extract("file", "^(.*?)/?[^/]*$", 1).alias("dir")
    of = lambda name, pattern: files.where(F.col("file").rlike(rf"(?:^|/){name}$")).select(at, F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("package"))
    npm = of(r"package-lock\.json", r'"(?:[^"]*/)?node_modules/((?:@[\w.-]+/)?[\w.-]+)"\s*:')
    pnpm = of(r"pnpm-lock\.yaml", r"(?m)^\s{2,}'?/?((?:@[\w.-]+/)?[\w.-]+)@[^:\n]+:")
    yarn = of(r"yarn\.lock", r'(?m)^"?((?:@[\w.-]+/)?[\w.-]+)@[^\n]+:\s*$')
    return npm.unionByName(pnpm).unionByName(yarn).distinct()


def lock_gaps(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared dependencies, workspace and file ones apart, that the lock file of their directory does not name; directories without one are left."""
    d = declared.where(~specifier_shape(F.col("specifier")).isin("workspace", "file")).join(locked.select("dir").distinct(), "dir", "left_semi")
    return d.join(locked, ["dir", "package"], "left_anti").select("dir", "package", F.lit("medium").alias("severity"))


def doc_commands(files: DataFrame) -> DataFrame:
    """(file, bin, sub) that documents mention in code spans or command lines."""
    docs = files.where(F.lower("file").rlike(r"\.mdx?$"))
    lines = F.regexp_extract_all("text", F.lit(r"(?m)`(?:\$ )?([a-z][\w-]* [a-z][\w-]*)|^\s*\$ ([a-z][\w-]* [a-z][\w-]*)"), F.lit(0))
    d = docs.select("file", F.explode(lines).alias("hit")).select("file", F.regexp_replace("hit", r"^[`\s$]+", "").alias("hit"))
    return d.select("file", F.split("hit", " ")[0].alias("bin"), F.split("hit", " ")[1].alias("sub")).distinct()


def command_drift(files: DataFrame) -> DataFrame:
    """Documents that mention subcommands which the sources of a declared command do not offer; none where none is offered."""
    j = F.get_json_object("text", "$.bin")
    named = F.when(j.startswith("{"), F.json_object_keys(j)).otherwise(F.array(F.get_json_object("text", "$.name")))
    bins = files.where(F.col("file").rlike(r"(?:^|/)package\.json$") & j.isNotNull()).select(F.explode(named).alias("bin")).where("bin IS NOT NULL").distinct()
    offered = files.where(F.col("file").rlike(r"\.[cm]?[jt]s$")).select(F.explode(F.regexp_extract_all("text", F.lit(r"\.command\(\s*[\"'`]([a-z][\w-]*)"), F.lit(1))).alias("sub")).distinct()
    any_offered = offered.limit(1).select(F.lit(1).alias("_any"))
    d = doc_commands(files).join(bins, "bin", "left_semi").join(any_offered).join(offered, "sub", "left_anti")
    return d.groupBy("file").agg(F.count("*").alias("missing"), F.min("sub").alias("first_missing")).withColumn("severity", F.lit("low"))


def headings(files: DataFrame) -> DataFrame:
    """(file, line, level, title) of Markdown headings outside fenced code."""
    d = files.where(F.lower("file").rlike(r"\.mdx?$")).select("file", F.posexplode(F.split("text", "\r?\n")).alias("p", "content"))
    fences = F.sum(F.when(F.col("content").rlike(r"^\s*(?:```|~~~)"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("p"))
    d = d.withColumn("fences", fences).where("fences % 2 = 0").where(F.col("content").rlike(r"^#{1,6} "))
    return d.select("file", (F.col("p") + 1).alias("line"), F.length(F.regexp_extract("content", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("content", r"^#+\s+|\s+#+\s*$", "")).alias("title"))


def env_inventory(files: DataFrame) -> DataFrame:
    """(file, name, value) of example environment files; files of real settings are never opened."""
    d = files.where(F.col("file").rlike(r"(?:^|/)\.?env\.(?:example|sample|template|dist)$|(?:^|/)\.env\.(?:example|sample|template|dist)$"))
    line = F.explode(F.split("text", "\r?\n")).alias("line")
    d = d.select("file", line).where(F.col("line").rlike(r"^\s*(?:export\s+)?[A-Za-z_]\w*\s*="))
    return d.select("file", F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_]\w*)", 1).alias("name"), F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1)).alias("value"))


def agent_directives(files: DataFrame) -> DataFrame:
    """(file, line, directive) of documents for agents that loosen limits: commands run unasked, checks skipped, all tools allowed."""
    docs = files.where(F.col("file").rlike(r"(?i)(?:^|/)(?:agents|claude|gemini)\.md$|(?:^|/)\.cursorrules$|copilot-instructions\.md$"))
    d = docs.select("file", F.posexplode(F.split("text", "\r?\n")).alias("p", "directive"))
    loose = r"(?i)\b(?:never ask|without (?:asking|confirmation|approval)|skip (?:the )?(?:tests?|hooks?|checks?|review)|--no-verify|force[- ]push|dangerously|allow all|full access|ignore (?:errors|warnings))\b"
    return d.where(F.col("directive").rlike(loose)).select("file", (F.col("p") + 1).alias("line"), "directive", F.lit("low").alias("severity"))


# Routes, labels and vocabulary.


def route_metadata_drift(labels: DataFrame, least: int = 3) -> DataFrame:
    """Routes with at least `least` label sources and as many distinct token sets. labels: (route, source, tokens array)."""
    own = F.array_join(F.array_sort(F.array_distinct("tokens")), " ")
    g = labels.groupBy("route").agg(F.countDistinct("source").alias("sources"), F.countDistinct(own).alias("variants"), F.min("source").alias("anchor"))
    return g.where((F.col("sources") >= least) & (F.col("variants") >= least)).withColumn("severity", F.when(F.col("variants") >= 4, "medium").otherwise("low"))


def language_alias_drift(words: DataFrame, aliases: DataFrame, top: int = 3) -> DataFrame:
    """Alias groups that two languages name by different aliases: the `top` ones by 10 * aliases + files (a report limit). words: (file, language, alias)."""
    used = words.join(aliases, "alias").groupBy("group_id", "language", "alias").agg(F.countDistinct("file").alias("f"))
    g = used.groupBy("group_id").agg(F.countDistinct("language").alias("languages"), F.countDistinct("alias").alias("aliases"), F.sum("f").alias("files"), F.countDistinct("language", "alias").alias("uses"))
    # somewhere an alias is used by one language only
    d = g.where("languages >= 2 AND aliases >= 2 AND uses < languages * aliases").withColumn("score", 10 * F.col("aliases") + F.col("files"))
    return d.orderBy(F.col("score").desc(), "group_id").limit(top).select("group_id", "aliases", "files", "score")


def pass_through_functions(bodies: DataFrame) -> DataFrame:
    """(file, owner, line, callee) of named functions that only forward their parameters to one call."""
    only = r"(?s)^[^{]*\{\s*return\s+(?:await\s+)?([\w$.]+)\([\w$,\s.]*\);?\s*\}\s*;?\s*$"
    return bodies.where(F.col("body").rlike(only) & (F.col("owner") != "")).select("file", "owner", "line", F.regexp_extract("body", only, 1).alias("callee"))


def pass_through_chains(wrappers: DataFrame, least: int = 3, deepest: int = 8) -> DataFrame:
    """Chains of at least `least` wrappers that forward to each other by name: start, length, files (at most `deepest` links are followed)."""
    step = wrappers.select(F.col("owner").alias("from"), F.regexp_extract("callee", r"([\w$]+)$", 1).alias("to"), "file").where("from <> to")
    unique = step.groupBy("from").agg(F.count("*").alias("_n"), F.first("to").alias("to"), F.first("file").alias("file")).where("_n = 1").drop("_n")
    heads = unique.join(unique.select(F.col("to").alias("from")).distinct(), "from", "left_anti")
    walk = heads.select(F.col("from").alias("start"), F.col("to").alias("at"), F.lit(1).alias("length"), F.array("file").alias("files"))
    found = walk
    for _ in range(deepest - 1):
        walk = walk.join(unique.withColumnRenamed("from", "at").withColumnRenamed("to", "_next"), "at").select("start", F.col("_next").alias("at"), (F.col("length") + 1).alias("length"), F.array_union("files", F.array("file")).alias("files"))
        found = found.unionByName(walk)
    g = found.groupBy("start").agg(F.max("length").alias("length"), F.max_by(F.size("files"), "length").alias("files")).where(F.col("length") >= least)
    return g.withColumn("severity", F.when(F.col("files") >= 3, "medium").otherwise("low"))


def policy_key(c: Column) -> Column:
    """A condition with white space and quotes made even, receivers' roots numbered away and the sides of && and || in order."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\s+", ""), "[\"'`]", "'")
    rooted = F.regexp_replace(plain, r"(?<![\w$.'])[A-Za-z_$][\w$]*\.(?=[A-Za-z_$])", "$1_.".replace("$1", ""))
    parts = lambda s, cut, glue: F.array_join(F.array_sort(F.split(s, cut)), glue)
    return F.when(rooted.contains("||"), parts(rooted, r"\|\|", "||")).otherwise(parts(rooted, "&&", "&&"))


POLICY_WORDS = r"(?i)(?<![a-z])(?:role|roles|permission|permissions|scope|grant|acl|policy|admin|plan|tier|billing|quota|subscription|status|refund|owner|tenant)(?![a-z])"


def duplicated_policy(files: DataFrame, least: int = 2) -> DataFrame:
    """Conditions of business vocabulary that at least `least` files state alike: rule, files, anchor."""
    found = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:if|while)\s*\(([^\n{;]*?(?:[!=]==?|>=|<=|&&|\|\|)[^\n{;]*)\)\s*[{\n;r]"), F.lit(1))).alias("condition"))
    words = F.regexp_replace("condition", "([a-z0-9])([A-Z])", "$1 $2")
    d = found.where(words.rlike(POLICY_WORDS)).select("file", policy_key(F.col("condition")).alias("rule"))
    g = d.groupBy("rule").agg(F.countDistinct("file").alias("files"), F.min("file").alias("anchor")).where(F.col("files") >= least)
    return g.withColumn("severity", F.when(F.col("files") >= 3, "high").otherwise("medium"))


def likely_tests(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, test, reason) for sources: tests that import them, else that share their name."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.[A-Za-z]+$", ""), r"^test_|_test$|\.(?:test|spec)$", "")
    d = files.select("file", name.alias("name"), F.col("file").rlike(TEST + r"|(?:^|/)test_[^/]+\.py$").alias("is_test"))
    tests = d.where("is_test")
    by_import = edges.select(F.col("src").alias("test"), F.col("dst").alias("file")).join(tests.select(F.col("file").alias("test")), "test", "left_semi").select("file", "test", F.lit("imports it").alias("reason"))
    by_name = d.where("NOT is_test").join(tests.select(F.col("file").alias("test"), "name"), "name").select("file", "test", F.lit("same name").alias("reason"))
    return by_import.unionByName(by_name.join(by_import.select("file", "test"), ["file", "test"], "left_anti")).distinct()


def test_gaps(files: DataFrame, tests: DataFrame) -> DataFrame:
    """(file, gap): 0 for tests and what a test imports, 0.5 where a test has the name, else 1."""
    best = tests.groupBy("file").agg(F.max(F.when(F.col("reason") == "imports it", 2).otherwise(1)).alias("_b"))
    is_test = F.col("file").rlike(TEST + r"|(?:^|/)test_[^/]+\.py$")
    gap = F.when(is_test | (F.col("_b") == 2), 0.0).when(F.col("_b") == 1, 0.5).otherwise(1.0)
    return files.select("file").distinct().join(best, "file", "left").select("file", gap.alias("gap"))
