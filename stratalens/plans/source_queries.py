"""Queries of the rules and source readers on the virtual repository of fixtures, each with the rows that it must give as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import text
from ..operators import code_rules, engine, js_facts, python_facts, source_rules
from ..sources import files as sources
from . import fixtures
from .registry import ORACLES, QUERIES, longs, query

#: Per rule the findings (file, symbol, severity) that the fixtures were written to hold; no symbol where it is a hash.
EXPECTED: dict[str, list[tuple]] = {
    "accessible_interaction_risk": [(f"src/ui/Card{k}.tsx", "", "medium") for k in (1, 2, 3)],
    "agent_permission_sprawl": [(".claude/settings.json", "", "low")],
    "boolean_naming_drift": [("src/names.ts", "", "low")],
    "boolean_naming_drift.py": [("py/core/a.py", "", "low")],
    "circular_dependency": [("src/ring/one.ts", "", "high")],
    "circular_dependency.py": [("py/core/a.py", "", "medium")],
    "command_drift_docs_code_drift": [("README.md", "", "low")],
    "commented_out_code": [("src/dead.ts", "", "low")],
    "config_drift": [("src/env/a.ts", "API_URL", "medium")],
    "date_string_concat": [("src/dates.ts", "", "low")],
    "deep_import": [("src/deep.ts", "", "low")],
    "deep_import.py": [("py/core/b.py", "", "medium")],
    "dependency_provenance_gap": [("", "any", "medium"), ("", "moving", "medium")],
    "design_token_escape": [("src/style.ts", "", "low")],
    "direct_date": [("src/dates.ts", "", "medium")],
    "direct_date.py": [("py/core/a.py", "", "medium")],
    "dst_naive_arithmetic": [("src/dates.ts", "", "medium")],
    "duplicate_component_shape": [("src/ui/Card1.tsx", None, "low")],
    "duplicated_policy": [("src/policy/a.ts", "_.active&&_.plan==='pro'", "medium"), ("src/ui/Card1.tsx", "_.role==='admin'", "high")],
    "duplicated_role_status_plan_check": [("src/ui/Card1.tsx", "admin", "medium")],
    "exact_duplicate_block": [("py/core/a.py", None, "medium"), ("src/a/total.ts", None, "medium"), ("src/ui/Card1.tsx", None, "medium")],
    "finder_duplicate_filename": [("src/copy 2.ts", "", "low")],
    "hardcoded_local_path": [("src/paths.ts", "", "medium")],
    "hardcoded_localhost": [("src/paths.ts", "", "medium")],
    "high_fan_in_fan_out": [("src/hub/hub.ts", "", "medium")],
    "large_file": [("src/big.ts", "", "high")],
    "large_function": [("src/long.ts", "work", "high")],
    "large_function.py": [("py/big.py", "big", "high")],
    "locale_drift": [("src/dates.ts", "", "low")],
    "logic_in_comments": [("src/refund.ts", "", "medium")],
    "magic_domain_literal_scatter": [("src/a/state.ts", "order_open", "medium")],
    "missing_agent_context": [("", "", "medium")],
    "mixed_utc_local_methods": [("src/dates.ts", "day", "high")],
    "mixed_utc_local_methods.py": [("py/core/a.py", "", "medium")],
    "mock_saturation": [("src/tests/cart.test.ts", "", "medium")],
    "name_behavior_mismatch": [("src/names.ts", "getUser", "medium")],
    "near_duplicate_block": [("src/near/x.ts", None, "low")],
    "negative_flag_maze": [("src/flags.ts", "", "low")],
    "option_bag_junk_drawer": [("src/options.ts", "build", "low")],
    "pass_through_abstraction": [("src/wrap.ts", "", "low")],
    "permission_ia_drift": [("", "/admin", "medium")],
    "responsive_fragility": [("src/wide.css.ts", "", "low")],
    "return_shape_roulette": [("src/shapes.ts", "pick", "low")],
    "singular_plural_type_mismatch": [("src/names.ts", "", "low")],
    "svg_with_embedded_raster": [("src/icon.svg", "", "medium")],
    "swallowed_error": [("src/errors.ts", "load", "medium")],
    "sync_io_in_hotpath": [("src/app/api/route.ts", "", "high")],
    "sync_io_in_hotpath.py": [("py/web.py", "view", "medium")],
    "timezone_unsafe_parse": [("src/dates.ts", "", "medium")],
    "todo_density": [("src/generated/api.ts", "", "medium"), ("src/todo.ts", "", "medium")],
    "unbounded_async_fanout": [("src/fan.ts", "all", "medium")],
    "unsafe_retry": [("src/retry.ts", "pay", "medium")],
    "weak_test_signal": [("src/tests/cart.test.ts", "", "medium")],
    "weak_test_signal.py": [("py/tests/test_a.py", "", "medium")],
}
HASHED = {n for n, rows in EXPECTED.items() if rows[0][1] is None}


def _of_rule(name: str) -> Callable:
    def run(spark, sf_dir):
        d = engine.rows_of(engine.RULES[name], engine.Facts(fixtures.files(spark)))
        return d.select("file", (F.lit(None).cast("string") if name in HASHED else F.col("symbol")).alias("symbol"), "severity")

    return run


for _name, _rows in EXPECTED.items():
    key = "rule_" + _name.replace(".", "_")
    QUERIES[key] = _of_rule(_name)
    ORACLES[key] = fixtures.literal({"file": "VARCHAR", "symbol": "VARCHAR", "severity": "VARCHAR"}, _rows)


def _expect(types: str, rows: list[tuple]) -> str:
    return fixtures.literal(dict(x.split() for x in types.split(", ")), rows)


#: What a whole scan says of the fixtures: the findings above, without the generated file's.
_ALL = [(r[0], n, r[2]) for n, rows in EXPECTED.items() for r in rows if r[0] != "src/generated/api.ts"]


@query(_expect("file VARCHAR, type VARCHAR, severity VARCHAR", _ALL))
def engine_scan(spark, sf_dir):
    return engine.scan(engine.Facts(fixtures.files(spark))).select("file", "type", "severity")


@query(_expect("type VARCHAR, severity VARCHAR", [(n, r[2]) for n, rows in EXPECTED.items() for r in rows if r[0] == "src/dates.ts" and n != "locale_drift"]))
def engine_working_set(spark, sf_dir):
    only = spark.createDataFrame([("src/dates.ts",)], "file string")
    return engine.scan(engine.Facts(fixtures.files(spark)), disable=["locale_drift"], only=only).select("type", "severity")


@query(_expect("section VARCHAR, findings BIGINT", [("files", len(_ALL) - 7), ("repository", 7)]))
def repo_level_partition(spark, sf_dir):
    return engine.repo_level(engine.scan(engine.Facts(fixtures.files(spark)))).groupBy("section").agg(F.count("*").alias("findings"))


@query(_expect("section VARCHAR, item VARCHAR, detail VARCHAR", [("finding", "circular_dependency", "high"), ("risk", "high", "1"), ("imported by", "src/ring/three.ts", ""), ("imported by", "src/ring/two.ts", ""), ("imports", "src/ring/two.ts", "")]))
def engine_context(spark, sf_dir):
    facts = engine.Facts(fixtures.files(spark))
    return engine.context(engine.scan(facts, enable=["circular_dependency"]), facts, "src/ring/one.ts")


@query(_expect("rule VARCHAR, pack VARCHAR, effort VARCHAR, option VARCHAR", [("large_file", "universal", "small", "docs"), ("large_file", "universal", "small", "domain"), ("large_file", "universal", "small", "test")]))
def engine_explain(spark, sf_dir):
    e = engine.explain("large_file")
    return spark.createDataFrame([(e["rule"], e["pack"], e["effort"], o) for o in e["options"]], "rule string, pack string, effort string, option string")


LOG = "COMMIT 2024-05-15T14:30:00+00:00 ann@x.org\nsrc/a.ts\nsrc/b.ts\n\nCOMMIT 2024-05-14T10:00:00+02:00 bob@x.org\r\nsrc/a.ts\r\n\r\nCOMMIT 2024-05-13T00:00:00Z\nsrc/a.ts\n\nCOMMIT 2024-05-12T00:00:00Z ann@x.org\n\nstray line\n"


@query(_expect("file VARCHAR, change_count BIGINT, latest TIMESTAMP, authors BIGINT", [("src/a.ts", 3, "2024-05-15 14:30:00", 2), ("src/b.ts", 1, "2024-05-15 14:30:00", 1)]))
def change_log(spark, sf_dir):
    return sources.changes(sources.commits(spark.createDataFrame([("log", LOG)], "source string, text string")))


@query(_expect("file VARCHAR", [("src/clean.ts",), ("src/fan.ts",)]))
def changed_files(spark, sf_dir):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file string")
    return sources.changed_files(one("src/clean.ts", "gone.ts"), one("src/fan.ts", "src/clean.ts"), fixtures.files(spark))


PATHS = {
    "src/a.ts": ("production", True, "domain"), "src/api.generated.ts": ("generated", False, "domain"), "proto/x_pb2.py": ("generated", False, "domain"), "lib/_vendor/y.py": ("vendored", False, "domain"), "web/lib.min.js": ("vendored", False, "domain"),
    "db/migrations/1.sql": ("migration", True, "domain"), "mocks/a.ts": ("fixture", True, "domain"), "examples/app/b.ts": ("fixture", True, "domain"), "src/a.test.ts": ("test", True, "nonDomain"), "tests/t.py": ("test", True, "domain"),
    "vite.config.ts": ("config", True, "domain"), "scripts/go.sh": ("production", True, "nonDomain"), "vendor/migrations/2.ts": ("vendored", False, "domain"),
}


@query(_expect("file VARCHAR, scope VARCHAR, reportable BOOLEAN, tier VARCHAR", [(k, *v) for k, v in PATHS.items()]))
def scope_classifier(spark, sf_dir):
    p, d = F.col("file"), spark.createDataFrame([(x,) for x in PATHS], "file string")
    return d.select("file", sources.scope(p).alias("scope"), sources.reportable(p).alias("reportable"), sources.tier(p, ["**/*.test.{ts,tsx}", "scripts/**"]).alias("tier"))


@query(_expect("file VARCHAR", [("src/a.ts",), ("README.md",), ("dist2/x.py",), (".agents/run.sh",)]))
def default_discovery(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in ("src/a.ts", "README.md", "dist/x.js", "node_modules/m/i.js", "a/.tox/b.py", "yarn.lock", "package-lock.json", "x.png", "dist2/x.py", ".agents/run.sh", "lib.min.js", "user/skip.ts")], "file string")
    return sources.discover(d, sources.INCLUDE, sources.excludes(["user/**"]))


@query(_expect("file VARCHAR", [("api/gen.ts",), ("deep/er/schema.ts",), ("web/out/x.ts",)]))
def linguist_generated(spark, sf_dir):
    lines = spark.createDataFrame([("", "# comment linguist-generated"), ("", "schema.ts linguist-generated"), ("", "api/*.ts text linguist-generated=true"), ("", "src/* -linguist-generated"), ("", "b.ts linguist-generated=false"), ("web", "out/** linguist-generated")], "dir string, line string")
    paths = spark.createDataFrame([(x,) for x in ("api/gen.ts", "deep/er/schema.ts", "web/out/x.ts", "src/a.ts", "b.ts", "out/y.ts")], "file string")
    return paths.where(sources.matches(F.col("file"), sources.covers(paths, sources.linguist_generated(lines))))


@query(_expect("dir VARCHAR, kind VARCHAR, package VARCHAR, shape VARCHAR", [("", "dependencies", "left", "range"), ("", "dependencies", "any", "any"), ("", "dependencies", "moving", "git"), ("", "dependencies", "fixed", "exact"), ("", "devDependencies", "mine", "workspace")]))
def manifest_reader(spark, sf_dir):
    return code_rules.manifests(fixtures.files(spark)).select("dir", "kind", "package", code_rules.specifier_shape(F.col("specifier")).alias("shape"))


@query(_expect("dir VARCHAR, package VARCHAR, severity VARCHAR", [("", "fixed", "medium")]))
def lock_gaps(spark, sf_dir):
    f = fixtures.files(spark)
    return code_rules.lock_gaps(code_rules.manifests(f), code_rules.lock_names(f))


@query(_expect("line BIGINT, level BIGINT, title VARCHAR", [(1, 1, "Shop"), (8, 2, "Use")]))
def markdown_headings(spark, sf_dir):
    return longs(code_rules.headings(fixtures.files(spark)).select("line", "level", "title"))


@query(_expect("bin VARCHAR, sub VARCHAR", [("shop", "start"), ("shop", "vanish")]))
def documented_commands(spark, sf_dir):
    return code_rules.doc_commands(fixtures.files(spark)).select("bin", "sub")


@query(_expect("name VARCHAR, value VARCHAR", [("API_URL", "http://x"), ("RETRIES", "3")]))
def env_inventory(spark, sf_dir):
    return code_rules.env_inventory(fixtures.files(spark)).select("name", "value")


TREE = [("src/cart.ts", ""), ("src/tests/cart.test.ts", "import { c } from '../cart';"), ("src/price.ts", ""), ("src/price.test.ts", ""), ("src/alone.ts", "")]


@query(_expect("file VARCHAR, test VARCHAR, reason VARCHAR", [("src/cart.ts", "src/tests/cart.test.ts", "imports it"), ("src/price.ts", "src/price.test.ts", "same name")]))
def likely_tests(spark, sf_dir):
    f = engine.Facts(spark.createDataFrame(TREE, "file string, text string"))
    return code_rules.likely_tests(f.files, f.js_edges)


@query(_expect("file VARCHAR, gap DOUBLE", [("src/cart.ts", 0.0), ("src/tests/cart.test.ts", 0.0), ("src/price.ts", 0.5), ("src/price.test.ts", 0.0), ("src/alone.ts", 1.0)]))
def test_gap_evidence(spark, sf_dir):
    f = engine.Facts(spark.createDataFrame(TREE, "file string, text string"))
    return code_rules.test_gaps(f.files, code_rules.likely_tests(f.files, f.js_edges))


CHAIN = "export function a1(x) { return b1(x); }\nexport function b1(x) { return c1(x); }\nexport function c1(x) { return real(x); }\nexport function real(x) { const y = x + 1; return y; }\n"


@query(_expect("start VARCHAR, length BIGINT, files BIGINT, severity VARCHAR", [("a1", 3, 1, "low")]))
def pass_through_chains(spark, sf_dir):
    f = engine.Facts(spark.createDataFrame([("src/chain.ts", CHAIN)], "file string, text string"))
    return longs(code_rules.pass_through_chains(code_rules.pass_through_functions(f.bodies)))


@query(_expect("route VARCHAR, sources BIGINT, variants BIGINT, severity VARCHAR", [("/a", 3, 3, "low")]))
def route_metadata_drift(spark, sf_dir):
    rows = [("/a", "nav", ["plans"]), ("/a", "title", ["pricing"]), ("/a", "crumb", ["plans", "prices"]), ("/b", "nav", ["x"]), ("/b", "title", ["x"]), ("/b", "crumb", ["x"])]
    return longs(code_rules.route_metadata_drift(spark.createDataFrame(rows, "route string, source string, tokens array<string>")).drop("anchor"))


@query(_expect("group_id VARCHAR, aliases BIGINT, files BIGINT, score BIGINT", [("person", 2, 3, 23)]))
def cross_language_concept_alias_drift(spark, sf_dir):
    words = spark.createDataFrame([("a.ts", "js", "user"), ("b.ts", "js", "user"), ("c.py", "py", "member"), ("a.ts", "js", "cart"), ("c.py", "py", "cart"), ("d.py", "py", "basket"), ("b.ts", "js", "basket")], "file string, language string, alias string")
    groups = spark.createDataFrame([("person", "user"), ("person", "member"), ("cart", "cart"), ("cart", "basket")], "group_id string, alias string")
    return longs(code_rules.language_alias_drift(words, groups))


@query(_expect("group_id VARCHAR, hits BIGINT, first_alias VARCHAR, severity VARCHAR", [("keep", 3, "keep", "low")]))
def copy_ia_drift(spark, sf_dir):
    label = "<b>{}</b>"
    texts = [(f"{w}{k}.tsx", label.format(w)) for w in ("Save", "Store", "Keep") for k in range(2)] + [("once.tsx", label.format("Persist"))]
    groups = spark.createDataFrame([("keep", w) for w in ("save", "store", "keep", "persist")], "group_id string, alias string")
    return longs(source_rules.action_label_drift(spark.createDataFrame(texts, "file string, text string"), groups))


NAMES = {
    "userId": ("identifier field", "user_id", False), "OrgName": ("tenancy field", "org_name", False), "roles": ("permission field", "role", False), "orderStatus": ("status field", "order_status", False), "totalPrice": ("money field", "total_price", False),
    "createdAt": ("timestamp field", "created_at", False), "UserDTO": (None, "user", False), "InvoiceModel": (None, "invoice", False), "saveInvoices": (None, "save_invoice", True), "area": (None, "area", False),
}


@query(_expect("name VARCHAR, reason VARCHAR, concept VARCHAR, mutating BOOLEAN", [(k, *v) for k, v in NAMES.items()]))
def domain_vocabulary(spark, sf_dir):
    c = F.col("name")
    return spark.createDataFrame([(x,) for x in NAMES], "name string").select("name", text.critical_reason(c).alias("reason"), text.concept_key(c).alias("concept"), text.mutating(c).alias("mutating"))


@query(_expect("src VARCHAR, dst VARCHAR, type_only BOOLEAN", [("src/ring/one.ts", "src/ring/two.ts", False), ("src/ring/two.ts", "src/ring/three.ts", False), ("src/ring/two.ts", "src/ring/one.ts", True), ("src/ring/three.ts", "src/ring/one.ts", False)]))
def js_import_resolution(spark, sf_dir):
    f = fixtures.files(spark).where("file LIKE 'src/ring/%'")
    return js_facts.import_edges(js_facts.facts(f), f).select("src", "dst", "type_only")


@query(_expect("src VARCHAR, dst VARCHAR", [("py/core/a.py", "py/core/b.py"), ("py/core/b.py", "py/core/a.py")]))
def python_import_resolution(spark, sf_dir):
    return python_facts.import_edges(engine.Facts(fixtures.files(spark)).py)


@query(_expect("owner VARCHAR, shape VARCHAR", [("GET", "route_handler"), ("work", "domain"), ("Card1", "react_component"), ("Card2", "react_component"), ("Card3", "react_component")]))
def function_shapes(spark, sf_dir):
    return engine.Facts(fixtures.files(spark)).shaped.where("owner IN ('GET', 'work', 'Card1', 'Card2', 'Card3')").select("owner", "shape")


@query(_expect("kind VARCHAR, name VARCHAR, flag BOOLEAN", [("clock", "datetime.utcnow", True), ("clock", "datetime.now", True), ("bool", "paid", None), ("bool", "ready", None)]))
def python_facts_of_file(spark, sf_dir):
    return engine.Facts(fixtures.files(spark)).py.where("file = 'py/core/a.py' AND kind IN ('clock', 'bool')").select("kind", "name", "flag")
