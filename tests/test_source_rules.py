"""Rules over source text: each on a file that it should find, one it should leave, and a null text."""

import struct

import pytest

from stratalens.operators import js_facts as js
from stratalens.operators import source_rules as sr

APP = """import x from "lib/a/internal/b";
const paid = true;
function getUser(options) {
  options.a; options.b; options.c; options.d; options.e; options.f;
  return db.save(options);
}
function shape(k) {
  if (k) return { a, b };
  if (!k) return { c };
  return { d, e };
}
async function send(n) {
  for (let attempt = 0; attempt < n; attempt++) { await fetch(u, { method: "POST" }); }
}
async function all(ids) { return Promise.all(ids.map((i) => fetch(i))); }
const d = new Date("2024-01-02 10:00");
day.getUTCHours(); day.getHours(); other.getDate();
const s = d.getMonth() + "/" + d.getDate() + "/";
const next = now + 86400000; d.toLocaleDateString();
if (disableCache && skipAuth) {}
if (user.role === "admin") {}
// const a = f(1);
// if (a) {
//   run(a);
// }
"""
UI = """export function Card(p) { return <div onClick={() => p.go()}><b>Save</b><i>x</i><u>y</u></div>; }
<div style="width: 400px; width: 500px; font-size: 20px"></div><Link href="/admin">Admin</Link> hasPermission("p.PERM")
if (role === 'admin') {}
"""
TEST = """it("does nothing", () => { run(); });
it("is there", () => { expect(run()).toBeDefined(); });
it("calls", () => { const a = jest.fn(); const b = jest.fn(); run(a, b); expect(a).toHaveBeenCalled(); });
it("works", () => { expect(run()).toEqual(3); });
"""
CLEAN = "export const isOn = true;\nconst d = new Date('2024-01-02T10:00:00Z');\nfunction getA() { return 1; }\n"
FILES = [("src/app.ts", APP), ("src/ui/Card1.tsx", UI), ("src/ui/Card2.tsx", UI), ("src/ui/Card3.tsx", UI.replace("PERM", "q")), ("a.test.ts", TEST), ("clean.ts", CLEAN), ("none.ts", None), ("My File 2.ts", "")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file string, text string").cache()


@pytest.fixture(scope="module")
def facts(files):
    return js.facts(files).cache()


@pytest.fixture(scope="module")
def bodies(facts, files):
    return sr.bodies(facts, files).cache()


def hits(df, *cols):
    return sorted(tuple(r[c] for c in cols or ("file", "severity")) for r in df.collect())


def test_dates(files):
    assert hits(sr.timezone_unsafe_parse(files)) == [("src/app.ts", "medium")]
    assert hits(sr.mixed_utc_local_methods(files), "file", "receiver") == [("src/app.ts", "day")]
    assert hits(sr.locale_drift(files)) == [("src/app.ts", "low")]
    assert hits(sr.dst_naive_arithmetic(files)) == [("src/app.ts", "medium")]
    assert hits(sr.date_string_concat(files), "file", "hits") == [("src/app.ts", 2)]


def test_names(files, bodies):
    assert hits(sr.boolean_naming_drift(files), "file", "first_name") == [("src/app.ts", "paid")]
    assert hits(sr.option_bag_junk_drawer(bodies), "owner", "properties") == [("getUser", 6)]
    assert hits(sr.negative_flag_maze(files), "file", "flags") == [("src/app.ts", 2)]
    assert hits(sr.name_behavior_mismatch(bodies), "owner", "severity") == [("getUser", "medium")]
    assert hits(sr.return_shape_roulette(bodies), "owner", "shapes") == [("shape", 3)]
    assert sr.singular_plural_type_mismatch(files).count() == 0


def test_io(bodies):
    assert hits(sr.unsafe_retry(bodies), "owner", "severity") == [("send", "medium")]
    assert hits(sr.unbounded_async_fanout(bodies), "owner") == [("all",)]
    assert sr.pass_through(bodies).count() == 0


def test_tests(bodies):
    cases = sr.test_cases(bodies)
    assert hits(sr.weak_test_signal(cases), "line", "severity") == [(1, "medium"), (2, "low")]
    assert hits(sr.mock_saturation(cases), "line", "mocks") == [(3, 2)]


def test_comments_and_paths(files, facts):
    assert hits(sr.commented_out_code(files), "file", "line", "end_line") == [("src/app.ts", 22, 25)]
    assert hits(sr.finder_duplicate_filename(files), "file") == [("My File 2.ts",)]
    assert hits(sr.deep_import(facts)) == [("src/app.ts", "low")]


def test_markup(spark, files, bodies):
    ui = [f for f, _ in FILES if f.startswith("src/ui")]
    assert hits(sr.accessible_interaction_risk(files), "file") == [(f,) for f in ui]
    assert hits(sr.responsive_fragility(files), "file", "hits") == [(f, 3) for f in ui]
    assert hits(sr.component_shapes(bodies), "files", "anchor") == [(3, ui[0])]
    assert hits(sr.repeated_checks(files), "subject", "value", "files") == [("role", "admin", 4)]
    assert hits(sr.permission_ia_drift(files), "target", "files", "permissions") == [("/admin", 3, 2)]
    aliases = spark.createDataFrame([(1, "save"), (1, "admin")], "group_id int, alias string")
    assert hits(sr.action_label_drift(files, aliases, 2), "group_id", "hits") == [(1, 2)]


def test_assets_and_settings(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 16, 300) + b"\0" * 9
    gif = b"GIF89a" + struct.pack("<HH", 32, 64) + b"\0" * 250_000
    assets = spark.createDataFrame([("a.png", png), ("b.gif", gif), ("c.bin", b"x"), ("d.png", None)], "file string, content binary")
    assert hits(sr.raster_should_be_vector(assets), "file", "width", "height") == [("b.gif", 32, 64)]
    assert hits(sr.oversized_raster(assets)) == [("b.gif", "low")]
    texts = spark.createDataFrame(
        [("i.svg", "data:image/png;base64,AA data:image/png;base64,BB"), ("package.json", '{"bin": {"x": "y"}}'), ("s.json", '{"permissions": {"allow": ["Bash(*)", "Read(src/**)"]}, "hooks": {"a": "curl x | sh"}}'), ("n.json", None)], "file string, text string"
    )
    assert hits(sr.svg_with_embedded_raster(texts)) == [("i.svg", "high")]
    assert sr.missing_agent_context(texts).count() == 1
    assert sr.missing_agent_context(texts.unionByName(spark.createDataFrame([("AGENTS.md", "")], "file string, text string"))).count() == 0
    assert hits(sr.agent_permission_sprawl(texts), "file", "broad", "hooks") == [("s.json", 1, 1)]
    empty = texts.where("false")
    assert sr.agent_permission_sprawl(empty).count() == sr.missing_agent_context(empty).count() == 0
