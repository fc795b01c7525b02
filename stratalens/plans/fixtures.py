"""A small virtual repository: every rule has something to find in it, and clean files to leave alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BLOCK = """export function NAME(rows) {
  let total = 0;
  for (const row of rows) {
    if (row.price > 3) {
      total = total + row.price * 2;
    } else {
      total = total - row.price;
    }
  }
  if (total > 10) {
    return total;
  }
  return null;
}
"""
_PY_BLOCK = """def NAME(rows):
    total = 0
    for row in rows:
        if row.price > 3:
            total = total + row.price * 2
        else:
            total = total - row.price
    if total > 10:
        return total
    return None
"""
_CARD = """export function CardNAME(props) {
  return (
    <section>
      <h2>Plan</h2>
      <div onClick={() => props.go()}>
        <b>Save</b>
      </div>
      <Link href="/admin">Open</Link>
    </section>
  );
}
if (props.role === "admin") { hasPermission("PERM"); }
"""

REPO: dict[str, str | None] = {
    "package.json": '{"name": "shop", "bin": {"shop": "./cli.js"}, "dependencies": {"left": "^1.2.0", "any": "*", "moving": "github:a/b", "fixed": "1.0.0"}, "devDependencies": {"mine": "workspace:*"}}',
    "package-lock.json": '{"packages": {"node_modules/left": {}, "node_modules/any": {}, "node_modules/moving": {}}}',
    "README.md": "# Shop\n\nRun `shop start` or `shop vanish`.\n\n```\n# not a heading\n```\n## Use\n",
    ".env.example": "API_URL=http://x\n# comment\nexport RETRIES = 3\n",
    ".claude/settings.json": '{"permissions": {"allow": ["Bash(*)", "Read(src/**)"]}, "hooks": {"a": "curl x | sh"}}',
    "src/cli.js": 'program.command("start");\nprogram.command("stop");\n',
    "src/big.ts": "const n = 1;\n" * 700,
    "src/todo.ts": "// TODO one\n// FIXME two\n// HACK three\nexport const x = 1;\n",
    "src/paths.ts": 'const p = "/Users/ann/data";\nconst q = "http://localhost:3000";\n',
    "src/copy 2.ts": "export const y = 1;\n",
    "src/dead.ts": "const k = 1;\n// const a = f(1);\n// if (a) {\n//   run(a);\n// }\nexport { k };\n",
    "src/refund.ts": "// Only an administrator must approve a refund, never the owner.\nexport function send(x) {\n  return post(x);\n}\n",
    "src/options.ts": "export function build(options) {\n  use(options.a, options.b, options.c);\n  use(options.d, options.e, options.f);\n}\n",
    "src/shapes.ts": "export function pick(k) {\n  if (k === 1) return { a, b };\n  if (k === 2) return { c };\n  return { d, e };\n}\n",
    "src/flags.ts": "if (disableCache && skipAuth) { go(); }\n",
    "src/names.ts": "export function getUser(id) {\n  return db.save(id);\n}\nconst paid = true;\ninterface R { names: string; }\n",
    "src/dates.ts": 'const d = new Date("2024-01-02 10:00");\nday.getUTCHours(); day.getHours();\nconst s = d.getMonth() + "/" + d.getDate() + "/";\nconst next = t + 86400000; d.toLocaleDateString();\nconst a = Date.now();\nif (Date.now() - a > 5) { go(); }\n',
    "src/long.ts": "export function work(x) {\n" + "  step(x);\n" * 130 + "}\n",
    "src/app/api/route.ts": 'export async function GET(req) {\n  const a = readFileSync("a");\n  const b = readFileSync("b");\n  return a + b;\n}\n',
    "src/style.ts": "const c = ['#fff', '#a1b2c3', '12px', 'rgb(1,2,3)', '16px'];\n",
    "src/wide.css.ts": "const s = `width: 400px; width: 500px; font-size: 20px`;\n",
    "src/errors.ts": "export function load() {\n  try { run(); } catch (e) {}\n}\n",
    "src/retry.ts": 'export async function pay(n) {\n  for (let attempt = 0; attempt < n; attempt++) { await fetch(u, { method: "POST" }); }\n}\n',
    "src/fan.ts": "export async function all(ids) { return Promise.all(ids.map((i) => fetch(i))); }\n",
    "src/a/state.ts": 'const s = "order_open";\n',
    "src/b/state.ts": 'const s = "order_open";\n',
    "src/c/state.ts": 'const s = "order_open";\n',
    "src/a/total.ts": _BLOCK.replace("NAME", "totalA"),
    "src/b/total.ts": _BLOCK.replace("NAME", "totalB"),
    "src/c/total.ts": _BLOCK.replace("NAME", "totalC").replace("row", "item").replace("total", "sum"),
    "src/ui/Card1.tsx": _CARD.replace("NAME", "1"),
    "src/ui/Card2.tsx": _CARD.replace("NAME", "2"),
    "src/ui/Card3.tsx": _CARD.replace("NAME", "3").replace("PERM", "other"),
    "src/ring/one.ts": 'import { two } from "./two";\nexport const one = two;\n',
    "src/ring/two.ts": 'import { three } from "./three";\nimport type { one } from "./one";\nexport const two = three;\n',
    "src/ring/three.ts": 'import { one } from "./one";\nexport const three = 1;\n',
    "src/near/x.ts": _BLOCK.replace("NAME", "sumX").replace("* 2", "* 2 + 1"),
    "src/near/y.ts": _BLOCK.replace("NAME", "sumY").replace("* 2", "* 2 + 1").replace("row", "line").replace("price", "cost"),
    "src/deep.ts": 'import x from "lib/a/internal/b";\n',
    **{f"src/hub/user{i}.ts": 'import { hub } from "./hub";\n' for i in range(9)},
    "src/hub/hub.ts": "export const hub = 1;\n",
    "src/policy/a.ts": 'if (user.plan === "pro" && user.active) { go(); }\n',
    "src/policy/b.ts": "if (account.active && account.plan === 'pro') { stop(); }\n",
    "src/env/a.ts": 'const u = process.env.API_URL ?? "http://a";\n',
    "src/env/b.ts": 'const u = process.env.API_URL ?? "http://b";\n',
    "src/wrap.ts": "".join(f"export function w{i}(x) {{ return inner.w{i}(x); }}\n" for i in range(4)),
    "src/icon.svg": "<svg>data:image/png;base64,AA</svg>",
    "src/tests/cart.test.ts": 'it("does nothing", () => { run(); });\nit("calls", () => { const a = jest.fn(); const b = jest.fn(); run(a, b); expect(a).toHaveBeenCalled(); });\nit("works", () => { expect(run()).toEqual(3); });\n',
    "src/generated/api.ts": "// TODO a\n// TODO b\n// TODO c\n",
    "src/clean.ts": "export const isOn = true;\nconst d = new Date('2024-01-02T10:00:00Z');\nexport function area(w, h) { return w * h; }\n",
    "py/core/a.py": "from . import b\nimport datetime\nx = datetime.datetime.utcnow()\ny = datetime.datetime.now()\npaid = True\nready = True\n" + _PY_BLOCK.replace("NAME", "total_a"),
    "py/core/b.py": "from py.core.a import total_a\nimport p.q.r.s.t\n" + _PY_BLOCK.replace("NAME", "total_b"),
    "py/big.py": "def big(a):\n" + "    a = a + 1\n" * 160 + "    return a\n",
    "py/web.py": "import time\n@app.get('/x/{id}')\ndef view(id):\n    time.sleep(1)\n",
    "py/tests/test_a.py": "def test_one():\n    pass\ndef test_two():\n    assert 1\n",
    "py/clean.py": "def area(w, h):\n    return w * h\n",
    "none.ts": None,
}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REPO.items()), "file string, text string")


def literal(types: dict[str, str], rows: list[tuple]) -> str:
    """SQL of a literal table."""

    def one(v):
        return "NULL" if v is None else "TRUE" if v is True else "FALSE" if v is False else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items()) + f" FROM (VALUES {body}) v({', '.join(types)})"
