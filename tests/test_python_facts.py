"""The Python pack over small source trees."""

from stratalens.operators import graph, python_facts as pf

LONG = "def big(a):\n" + "".join(f"    a = a + {i}\n" for i in range(160)) + "    return a\n"
BODY = "def {}({}):\n    total = 0\n    for item in {}:\n        if item > 3:\n            total = total + item * 2\n        else:\n            total = total - item\n    if total > 10:\n        return total\n    return None\n"
FILES = {
    "app/core/a.py": "from . import b\nimport datetime\nfrom datetime import datetime as dt\nx = datetime.datetime.utcnow()\ny = datetime.datetime.now()\nready = True\npaid = True\nis_ok = True\n" + BODY.format("f", "rows", "rows"),
    "app/core/b.py": "from app.core.a import f\n" + BODY.format("f", "rows", "rows"),
    "app/core/c.py": "import app.core.b\nimport a.b.c.d.e\n" + BODY.format("g", "items", "items"),
    "app/big.py": LONG,
    "app/bad.py": "def (:\n",
    "app/empty.py": None,
    "app/web.py": "import time\n@app.get('/x/{id}')\ndef view(id):\n    time.sleep(1)\nasync def go():\n    open('f')\ndef plain():\n    time.sleep(1)\n",
    "tests/test_a.py": "def check(x):\n    helper(x)\ndef helper(x):\n    assert_equal(x, 1)\ndef test_one():\n    pass\ndef test_two():\n    check(2)\ndef test_three():\n    assert 1\ndef test_four():\n    print(1)\n",
}


def facts(spark):
    df = spark.createDataFrame(list(FILES.items()), "file string, text string")
    return pf.facts(df).cache()


def test_rules(spark):
    f = facts(spark)
    by = lambda d: {r.file: r for r in d.collect()}
    assert [r.file for r in f.where("kind = 'error'").collect()] == ["app/bad.py"]
    assert by(pf.large_functions(f))["app/big.py"].severity == "high"
    assert by(pf.direct_dates(f))["app/core/a.py"].naive == 2
    assert set(by(pf.mixed_utc_local(f))) == {"app/core/a.py"}
    assert by(pf.boolean_naming(f))["app/core/a.py"].names == 1  # paid; ready may stand alone
    assert by(pf.deep_imports(f))["app/core/c.py"].severity == "medium"
    assert {r.owner for r in pf.blocking_in_hot_path(f).collect()} == {"view", "go"}
    weak = by(pf.weak_tests(f))["tests/test_a.py"]
    assert (weak.tests, weak.hollow, weak.severity) == (4, 2, "medium")
    exact, near = pf.clones(f).collect(), pf.clones(f, near=True).collect()
    assert [(r.anchor, r.files) for r in exact] == [("app/core/a.py", 2)] and [r.files for r in near] == [3]
    assert [(r.name, r.detail) for r in f.where("kind = 'route'").collect()] == [("/x/{id}", "get")]


def test_imports(spark):
    f = facts(spark)
    edges = pf.import_edges(f)
    assert {("app/core/a.py", "app/core/b.py"), ("app/core/b.py", "app/core/a.py"), ("app/core/c.py", "app/core/b.py")} == {tuple(r) for r in edges.collect()}
    assert {r.node: r.component for r in graph.scc(edges).collect()} == {"app/core/a.py": "app/core/a.py", "app/core/b.py": "app/core/a.py"}
    assert {r.module: (r.total, r.test) for r in pf.module_references(f).collect()}["app.core.a"] == (1, 0)
