"""The registry of rules and the scans over it.

A rule is a function from Facts and its options to a DataFrame of offenders; registering it names
its pack, its options with their defaults, and what a report says about it. scan() runs the chosen
rules over one set of lazily built facts and returns findings; explain(), context() and the gates
work on those. Unknown rules and options are errors, so a wrong setting never passes silently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import severity_rank
from ..sources import files as sources
from . import code_rules, js_facts, python_facts, rules, source_rules
from .findings import COLUMNS, disambiguated, finding

JS, PY, ANY = "language-js", "language-py", "universal"
# Types that belong to the repository rather than to their file.
REPO_LEVEL = ("dependency_provenance_gap", "agent_permission_sprawl", "missing_agent_context", "config_drift", "command_drift_docs_code_drift", "finder_duplicate_filename")


@dataclass
class Facts:
    """What rules read: files (file, text), and tables made from them when first asked for."""

    files: DataFrame
    assets: DataFrame | None = None
    aliases: DataFrame | None = None
    layers: DataFrame | None = None
    forbidden: DataFrame | None = None

    @cached_property
    def js_files(self) -> DataFrame:
        return self.files.where(sources.pack(F.col("file")) == JS)

    @cached_property
    def py_files(self) -> DataFrame:
        return self.files.where(sources.pack(F.col("file")) == PY)

    @cached_property
    def js(self) -> DataFrame:
        return js_facts.facts(self.js_files).persist()

    @cached_property
    def py(self) -> DataFrame:
        return python_facts.facts(self.py_files).persist()

    @cached_property
    def bodies(self) -> DataFrame:
        return source_rules.bodies(self.js, self.js_files)

    @cached_property
    def shaped(self) -> DataFrame:
        return code_rules.shapes(self.bodies)

    @cached_property
    def js_edges(self) -> DataFrame:
        return js_facts.import_edges(self.js, self.js_files)

    @cached_property
    def py_edges(self) -> DataFrame:
        return python_facts.import_edges(self.py)

    @cached_property
    def tests(self) -> DataFrame:
        return source_rules.test_cases(self.bodies)


@dataclass(frozen=True)
class Rule:
    name: str
    run: Callable[[Facts, dict], DataFrame]
    pack: str = ANY
    description: str = ""
    why: str = ""
    options: dict[str, object] = field(default_factory=dict)
    confidence: float = 0.7
    intrinsic: float = 0.3
    effort: str = "small"
    fix: str = "review"
    on: bool = True

    def chosen(self, given: dict | None) -> dict:
        """The rule's options with the given ones over the defaults; unknown names and other types are errors."""
        for key, value in (given or {}).items():
            if key not in self.options:
                raise ValueError(f"rule {self.name} has no option {key}")
            want = type(self.options[key])
            if not isinstance(value, want) and not (want is float and isinstance(value, int)):
                raise ValueError(f"option {key} of rule {self.name} must be of type {want.__name__}")
        return {**self.options, **(given or {})}


RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    if rule.name in RULES:
        raise ValueError(f"rule {rule.name} is registered already")
    RULES[rule.name] = rule
    return rule


def select(enable: Iterable[str] | None = None, disable: Iterable[str] = (), rules: dict[str, Rule] | None = None) -> list[Rule]:
    """The rules to run, by name. enable: only these (and such as are off by default); disable wins."""
    known = RULES if rules is None else rules
    if unknown := sorted((set(enable or ()) | set(disable)) - set(known)):
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    wanted = set(enable) if enable is not None else {n for n, r in known.items() if r.on}
    return [known[n] for n in sorted(wanted - set(disable))]


def rows_of(rule: Rule, facts: Facts, options: dict | None = None) -> DataFrame:
    """A rule's offenders as findings."""
    d = rule.run(facts, rule.chosen(options))
    have = set(d.columns)
    first = lambda *names: next((F.col(n) for n in names if n in have), None)
    file = first("file", "anchor")
    if file is None:
        file = F.lit("")
    detail = sorted(have - {"file", "anchor", "severity", "confidence", "line", "end_line", "symbol", "owner", "missing"})
    shown = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in detail]
    summary = F.concat_ws(" ", F.lit(rule.name), *shown)
    confidence = first("confidence")
    return finding(d, rule.name, F.col("severity"), F.lit(rule.confidence) if confidence is None else confidence, file, summary, first("symbol", "owner", "name", "shape"), first("line"))


def scan(facts: Facts, enable: Iterable[str] | None = None, disable: Iterable[str] = (), options: dict[str, dict] | None = None, only: DataFrame | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Findings of the chosen rules, without those in generated and vendored files.

    options: by rule. only (file): files that may report; what rules know still covers all files.
    Fingerprints that several findings share are told apart by their content, then by line.
    """
    chosen = select(enable, disable, rules)
    if unknown := sorted(set(options or ()) - {r.name for r in chosen}):
        raise ValueError(f"options for rules that do not run: {', '.join(unknown)}")
    out = None
    for rule in chosen:
        own = rows_of(rule, facts, (options or {}).get(rule.name)).select(*COLUMNS)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = facts.files.sparkSession.createDataFrame([], "fingerprint string, type string, severity string, confidence double, file string, symbol string, line_start int, line_end int, summary string")
    out = disambiguated(out.where(sources.reportable(F.col("file"))))
    return out if only is None else out.join(only.select("file").distinct(), "file", "left_semi").select(*COLUMNS)


def unmatched(only: DataFrame, files: DataFrame) -> DataFrame:
    """Files that were asked for and do not exist: what a report warns of."""
    return only.select("file").distinct().join(files.select("file"), "file", "left_anti")


def repo_level(findings: DataFrame) -> DataFrame:
    """Findings with section: "repository" or "files"."""
    base = F.regexp_replace("type", r"\.(?:js|py|x)$", "")
    return findings.withColumn("section", F.when(base.isin(*REPO_LEVEL), "repository").otherwise("files"))


def intrinsics() -> dict[str, float]:
    """The declared intrinsic risk by rule; others have 0.3."""
    return {n: r.intrinsic for n, r in RULES.items()}


def explain(name: str) -> dict[str, object]:
    """What a rule is about: its texts, options, and how its findings are suppressed."""
    if name not in RULES:
        raise ValueError(f"unknown rules: {name}")
    r = RULES[name]
    return {"rule": r.name, "pack": r.pack, "description": r.description, "why": r.why, "options": dict(r.options), "default_on": r.on, "effort": r.effort, "fix_shape": r.fix, "suppress": f"suppress --type {r.name} --reason '...'"}


def context(findings: DataFrame, facts: Facts, file: str, edges: DataFrame | None = None) -> DataFrame:
    """What to know before changing one file: rows (section, item, detail) of its findings, risk, importers, imports and likely tests."""
    own = findings.where(F.col("file") == file)
    worst = own.agg(F.max(severity_rank(F.col("severity"))).alias("w"), F.count("*").alias("n"))
    level = F.when(F.col("w") == 3, "high").when(F.col("w") == 2, "medium").when(F.col("w") == 1, "low").otherwise("none")
    edges = facts.js_edges.select("src", "dst").unionByName(facts.py_edges.select("src", "dst")) if edges is None else edges.select("src", "dst")
    exists = facts.files.where(F.col("file") == file).agg(F.count("*").alias("n"))
    parts = [
        own.select(F.lit("finding").alias("section"), F.col("type").alias("item"), F.col("severity").alias("detail")),
        worst.select(F.lit("risk"), level, F.col("n").cast("string")),
        edges.where(F.col("dst") == file).select(F.lit("imported by"), "src", F.lit("")),
        edges.where(F.col("src") == file).select(F.lit("imports"), "dst", F.lit("")),
        code_rules.likely_tests(facts.files, edges).where(F.col("file") == file).select(F.lit("likely test"), "test", "reason"),
        exists.where("n = 0").select(F.lit("note"), F.lit("no such file"), F.lit("")),
        worst.where("n = 0").select(F.lit("note"), F.lit("no findings"), F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


DURATION = re.compile(r"^(\d+)\s*([dwmy])$")


def window_days(since: str) -> int | None:
    """Days of a compact window such as 90d, 2w, 6m or 1y; None for other phrases."""
    m = DURATION.match(since.strip())
    return int(m[1]) * {"d": 1, "w": 7, "m": 30, "y": 365}[m[2]] if m else None


def diff_range(text: str) -> tuple[str, str]:
    """(base, head) of "base...head"; anything else is an error that says why."""
    if not text:
        raise ValueError("range is empty")
    if "..." not in text:
        raise ValueError("two dots are not supported; use three" if ".." in text else "no three dots between base and head")
    base, _, head = text.partition("...")
    if head.startswith("."):
        raise ValueError("more than three dots")
    if "..." in head:
        raise ValueError("more than one range")
    if not base or not head:
        raise ValueError("base is empty" if not base else "head is empty")
    return base, head


def _rule(name: str, run: Callable[[Facts, dict], DataFrame], pack: str = ANY, description: str = "", **more) -> None:
    register(Rule(name, run, pack, description, **more))


def _large_file(f: Facts, o: dict) -> DataFrame:
    docs, test = F.col("file").rlike(r"(?i)\.(?:md|mdx|markdown|rst|adoc|asciidoc|txt)$"), sources.scope(F.col("file")) == "test"
    budget = F.when(docs, o["docs"]).when(test, o["test"]).otherwise(o["domain"])
    d = rules.large_file(f.files.where("text IS NOT NULL"), budget)
    over = F.col("lines") >= 2 * F.col("budget")
    return d.withColumn("severity", F.when(docs | test, F.when(over, "medium").otherwise("low")).otherwise(F.when(over, "high").otherwise("medium")))


def _literals(pattern: str, outside: str) -> Callable[[Facts, dict], DataFrame]:
    return lambda f, o: rules.pattern_count(f.files.where("text IS NOT NULL").where(~F.col("file").rlike(outside)), pattern)


def _exact(f: Facts, o: dict) -> DataFrame:
    d = python_facts.clones(f.js.unionByName(f.py), least_tokens=o["tokens"], least_lines=o["lines"])
    return d.withColumn("severity", F.lit("medium")).withColumnRenamed("hash", "symbol")


def _near(f: Facts, o: dict) -> DataFrame:
    return python_facts.near_clones(f.js.unionByName(f.py), least_tokens=o["tokens"], least_lines=o["lines"]).withColumn("severity", F.lit("low")).withColumnRenamed("hash", "symbol")


_rule("large_file", _large_file, description="Files over their line budget.", why="Long files hide what belongs together.", options={"domain": 300, "test": 1500, "docs": 1000}, intrinsic=0.4, fix="split by responsibility")
_rule("todo_density", lambda f, o: rules.marker_density(f.files.where("text IS NOT NULL"), rules.MARKER, o["least"], o["per_kloc"]), description="Files full of work markers.", options={"least": 3, "per_kloc": 10.0}, confidence=0.8)
_rule("hardcoded_local_path", _literals(r"(?:/Users/|/home/|C:\\Users\\)[A-Za-z0-9._-]+", code_rules.TEST + r"|(?:^|/)scripts?/"), description="Paths of one machine.", confidence=0.85)
_rule("hardcoded_localhost", _literals(r"(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]):[0-9]{2,5}", code_rules.TEST + r"|(?i)config|\.mdx?$|(?:^|/)docs?/"), description="Local hosts with ports outside settings and documents.", confidence=0.8)
_rule("finder_duplicate_filename", lambda f, o: source_rules.finder_duplicate_filename(f.files), description="Copies that a file manager made.", confidence=0.95)
_rule("commented_out_code", lambda f, o: source_rules.commented_out_code(f.files.where("text IS NOT NULL"), o["least"], o["code_lines"]), description="Code kept in comments.", options={"least": 4, "code_lines": 3})
_rule("logic_in_comments", lambda f, o: code_rules.logic_in_comments(f.js, f.js_files, o["nearby"]), JS, "Rules that only comments state.", options={"nearby": 16}, confidence=0.62)
_rule("weak_test_signal", lambda f, o: source_rules.weak_test_signal(f.tests), JS, "Tests that assert nothing, or little.")
_rule("mock_saturation", lambda f, o: source_rules.mock_saturation(f.tests), JS, "Tests of mocks only.")
_rule("option_bag_junk_drawer", lambda f, o: source_rules.option_bag_junk_drawer(f.bodies, o["least"]), JS, "Options with many unrelated fields.", options={"least": 6})
_rule("return_shape_roulette", lambda f, o: source_rules.return_shape_roulette(f.bodies), JS, "Functions that return objects of many shapes.")
_rule("negative_flag_maze", lambda f, o: source_rules.negative_flag_maze(f.js_files), JS, "Conditions of several negated flags.")
_rule("name_behavior_mismatch", lambda f, o: source_rules.name_behavior_mismatch(f.bodies), JS, "Functions that do more than their name says.")
_rule("missing_agent_context", lambda f, o: source_rules.missing_agent_context(f.files), description="Commands without a document for agents.")
_rule("command_drift_docs_code_drift", lambda f, o: code_rules.command_drift(f.files), JS, "Documents that mention commands which are gone.")
_rule("large_function", lambda f, o: code_rules.large_function(f.shaped, {"domain": o["domain"]}), JS, "Functions longer than their shape's budget.", options={"domain": 60}, intrinsic=0.45, fix="extract functions")
_rule("direct_date", lambda f, o: code_rules.direct_date(f.js), JS, "Clock reads in domain code.", confidence=0.9, intrinsic=0.45, fix="inject a clock")
_rule("timezone_unsafe_parse", lambda f, o: source_rules.timezone_unsafe_parse(f.js_files), JS, "Dates parsed without a zone.")
_rule("mixed_utc_local_methods", lambda f, o: source_rules.mixed_utc_local_methods(f.js_files).withColumnRenamed("receiver", "symbol"), JS, "One value read in two zones.")
_rule("locale_drift", lambda f, o: source_rules.locale_drift(f.js_files), JS, "Formatting by the machine's locale.")
_rule("dst_naive_arithmetic", lambda f, o: source_rules.dst_naive_arithmetic(f.js_files), JS, "Days of fixed length.")
_rule("date_string_concat", lambda f, o: source_rules.date_string_concat(f.js_files), JS, "Dates glued to strings.")
_rule("boolean_naming_drift", lambda f, o: source_rules.boolean_naming_drift(f.js_files), JS, "Booleans that do not read as questions.")
_rule("singular_plural_type_mismatch", lambda f, o: source_rules.singular_plural_type_mismatch(f.js_files), JS, "Names whose number does not fit their type.")
_rule("sync_io_in_hotpath", lambda f, o: code_rules.sync_io_in_hotpath(f.js, f.shaped), JS, "Blocking calls on requests and renders.", intrinsic=0.5, fix="use the asynchronous call")
_rule("design_token_escape", lambda f, o: js_facts.design_token_escape(f.js, o["least"]), JS, "Raw style values.", options={"least": 5})
_rule("accessible_interaction_risk", lambda f, o: source_rules.accessible_interaction_risk(f.js_files), JS, "Clickable boxes out of reach of keyboards.")
_rule("responsive_fragility", lambda f, o: source_rules.responsive_fragility(f.js_files), JS, "Fixed sizes.")
_rule("swallowed_error", lambda f, o: js_facts.swallowed_errors(f.js), JS, "Failures that nobody sees.", confidence=0.72)
_rule("unsafe_retry", lambda f, o: source_rules.unsafe_retry(f.bodies), JS, "Repeated changes without a key.")
_rule("unbounded_async_fanout", lambda f, o: source_rules.unbounded_async_fanout(f.bodies), JS, "Calls for every item at once.")
_rule("magic_domain_literal_scatter", lambda f, o: js_facts.literal_scatter(f.js), JS, "Literals with a meaning in many files.")
_rule("exact_duplicate_block", _exact, description="Functions that stand in several files.", options={"tokens": 40, "lines": 8}, confidence=0.95, intrinsic=0.5, fix="share one function")
_rule("near_duplicate_block", _near, description="Functions that differ in names only.", options={"tokens": 40, "lines": 8}, confidence=0.85)
_rule("duplicate_component_shape", lambda f, o: source_rules.component_shapes(f.bodies).withColumnRenamed("shape", "symbol"), JS, "Markup of one shape in many components.")
_rule("duplicated_role_status_plan_check", lambda f, o: source_rules.repeated_checks(f.js_files).withColumnRenamed("value", "symbol"), JS, "One check in many files.")
_rule("permission_ia_drift", lambda f, o: source_rules.permission_ia_drift(f.js_files).withColumnRenamed("target", "symbol"), JS, "Destinations under several permissions.")
_rule("circular_dependency", lambda f, o: code_rules.circular_dependency(f.js_edges), JS, "Files that import each other.", confidence=0.95, fix="break the cycle")
_rule("deep_import", lambda f, o: source_rules.deep_import(f.js), JS, "Imports from inside other packages.")
_rule("high_fan_in_fan_out", lambda f, o: code_rules.fan_offenders(f.js_edges, f.js_files), JS, "Files that all others depend on.")
_rule("duplicated_policy", lambda f, o: code_rules.duplicated_policy(f.js_files, o["least"]).withColumnRenamed("rule", "symbol"), JS, "Business rules stated twice.", options={"least": 2}, confidence=0.6)
_rule("config_drift", lambda f, o: js_facts.config_drift(f.js).withColumnRenamed("name", "symbol").withColumn("severity", F.lit("medium")), JS, "Settings read in different ways.")
_rule("pass_through_abstraction", lambda f, o: source_rules.pass_through(f.bodies, o["least"]), JS, "Layers that only forward.", options={"least": 4})
_rule("dependency_provenance_gap", lambda f, o: code_rules.unpinned(code_rules.manifests(f.files)).withColumnRenamed("dir", "file").withColumnRenamed("package", "symbol"), JS, "Dependencies that nothing pins.")
_rule("agent_permission_sprawl", lambda f, o: source_rules.agent_permission_sprawl(f.files), description="Broad settings for agents.", confidence=0.39)
_rule("svg_with_embedded_raster", lambda f, o: source_rules.svg_with_embedded_raster(f.files), description="Rasters within vectors.")
_rule("large_function.py", lambda f, o: python_facts.large_functions(f.py), PY, "Functions longer or deeper than their budget.")
_rule("direct_date.py", lambda f, o: python_facts.direct_dates(f.py), PY, "Clock reads, naive ones above all.")
_rule("mixed_utc_local_methods.py", lambda f, o: python_facts.mixed_utc_local(f.py), PY, "Naive times of two zones.")
_rule("boolean_naming_drift.py", lambda f, o: python_facts.boolean_naming(f.py), PY, "Booleans that do not read as questions.")
_rule("circular_dependency.py", lambda f, o: code_rules.circular_dependency(f.py_edges), PY, "Modules that import each other.", confidence=0.95)
_rule("deep_import.py", lambda f, o: python_facts.deep_imports(f.py), PY, "Imports from deep inside packages.")
_rule("sync_io_in_hotpath.py", lambda f, o: python_facts.blocking_in_hot_path(f.py).withColumn("severity", F.lit("medium")), PY, "Blocking calls in handlers and coroutines.")
_rule("weak_test_signal.py", lambda f, o: python_facts.weak_tests(f.py), PY, "Tests that assert nothing.")
