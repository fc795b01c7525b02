"""The lexer and the rules over its facts."""

from stratalens.operators import graph, js_facts as js

A = """import { b } from "./b";
import type { T } from './types.js';
// a comment
// goes on
const url = process.env.API_URL ?? "http://x";
const re = /"not a string/g, half = 4 / 2;
export function load(rows) {
  try { return fetch(`/api/x`, { method: "POST" }); } catch (e) {}
  const now = Date.now(); return "order_status";
}
const go = async (x) => { readFileSync("f"); try { x() } catch (e) { console.error(e) } };
"""
B = "import { load } from './a';\nexport const u = process.env.API_URL;\nexport function load2(items) {\n  try { return fetch(`/api/x`, { method: \"POST\" }); } catch (e) {}\n  const now = Date.now(); return \"order_status\";\n}\nconst s = ['#fff', '12px', 'rgb(1,2,3)', '#a1b2c3', '0 1px 2px #000'];\n"
FILES = {"src/a.ts": A, "src/b/index.ts": B, "src/c/d.ts": "const s = 'order_status'; import('../a');", "src/types.ts": "", "src/bad.ts": "const x = 'open\n } ) `", "src/none.ts": None}


def test_facts(spark):
    files = spark.createDataFrame(list(FILES.items()), "file string, text string")
    f = js.facts(files).cache()
    rows = {}
    for r in f.collect():
        rows.setdefault((r.file, r.kind), []).append(r)
    assert [(r.name, r.flag) for r in rows["src/a.ts", "import"]] == [("./b", False), ("./types.js", True)]
    assert [(r.line, r.end_line) for r in rows["src/a.ts", "comment"]] == [(3, 4)]
    assert {r.name for r in rows["src/a.ts", "function"]} == {"load", "go"}
    assert [r.detail for r in rows["src/a.ts", "fetch"]] == ["POST"] and len(rows["src/a.ts", "clock"]) == 1
    assert "not a string" not in str(rows["src/a.ts", "literal"])
    assert {(r.owner, r.detail) for r in js.swallowed_errors(f).where("file = 'src/a.ts'").collect()} == {("load", "empty"), ("go", "log")}
    assert [(r.name, r.files) for r in js.config_drift(f).collect()] == [("API_URL", 2)]
    assert [(r.name, r.files, r.dirs) for r in js.literal_scatter(f).collect()] == [("order_status", 3, 3)]
    assert [(r.file, r.values) for r in js.design_token_escape(f).collect()] == [("src/b/index.ts", 5)]
    edges = js.import_edges(f, files)
    assert {(r.src, r.dst, r.type_only) for r in edges.collect()} == {("src/a.ts", "src/b/index.ts", False), ("src/a.ts", "src/types.ts", True), ("src/c/d.ts", "src/a.ts", False)}
    clones = [r for r in f.where("kind = 'clone'").collect() if r.owner in ("load", "load2")]
    assert clones[0].name == clones[1].name and clones[0].detail == clones[1].detail
    assert graph.fan_stats(edges).where("node = 'src/a.ts'").first().fan_out == 2
