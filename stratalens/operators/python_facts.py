"""Facts of Python sources by the standard library's parser, and the rules of the Python pack.

facts() is the one Python stage: every file's tree is walked once, in Arrow batches, and gives one
row per fact: (file, kind, name, owner, line, end_line, n, flag, detail). Files that don't parse
give a row of kind "error". Rules are DataFrame operations over the facts.

kinds: function (n: deepest nesting, flag: async, detail: shape), clock (flag: naive), bool (a
declared boolean: name), import (n: dots of a relative import), call (detail: the called name),
test (n: assertions), class (detail: first base), literal, clone (n: tokens, detail: exact hash,
name: shape hash), route (name: path, detail: method).
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, kind string, name string, owner string, line int, end_line int, n int, flag boolean, detail string"
BUDGETS = {"domain": 50, "route": 80, "cli": 120, "test": 150, "dunder": 70, "unknown": 60}
PREFIXES = r"^_*(?:is|has|can|should|was|will|did|does|are|had|must|needs|allow|allows|enable|enabled|disable|disabled|include|use|supports|requires)(?:_|$)"
# Names of booleans that read as such without a prefix.
BARE = "ok valid invalid found done ready active enabled disabled visible hidden verbose quiet debug dry_run strict recursive force overwrite success failed dirty empty loaded cached closed open".split()
_METHODS = {"get", "post", "put", "patch", "delete", "route", "head", "options"}
_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith, ast.Match)
_BLOCKING = {"time.sleep", "requests.get", "requests.post", "requests.put", "requests.delete", "subprocess.run", "subprocess.call", "subprocess.check_output", "os.system", "open", "urllib.request.urlopen"}


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)] if isinstance(node, ast.Name) else ["", *reversed(parts)])


def _depth(node: ast.AST, at: int = 0) -> int:
    best, stack = 0, [(c, 0) for c in ast.iter_child_nodes(node)]
    while stack:
        x, d = stack.pop()
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        d += isinstance(x, _NESTING)
        best = max(best, d)
        stack += [(c, d) for c in ast.iter_child_nodes(x)]
    return best


def _shape_of(node: ast.FunctionDef, file: str) -> str:
    marks = [_dotted(d.func if isinstance(d, ast.Call) else d).split(".") for d in node.decorator_list]
    if any(m[-1] in _METHODS and len(m) > 1 for m in marks):
        return "route"
    if any(m[-1] in ("command", "group") for m in marks) or node.name in ("main", "cli"):
        return "cli"
    if node.name.startswith("test"):
        return "test"
    if node.name.startswith("__") and node.name.endswith("__"):
        return "dunder"
    return "domain" if any(x in file.split("/") for x in ("domain", "core", "services", "models")) else "unknown"


def _hashes(node: ast.AST) -> tuple[int, str, str]:
    """(tokens, exact hash, shape hash) of a function's body; the shape numbers names by first appearance."""
    exact, shape, seen = [], [], {}
    for x in ast.walk(node):
        kind = type(x).__name__
        own = x.id if isinstance(x, ast.Name) else x.arg if isinstance(x, ast.arg) else x.attr if isinstance(x, ast.Attribute) else ""
        value = repr(x.value) if isinstance(x, ast.Constant) else ""
        exact.append(f"{kind} {own} {value}")
        shape.append(f"{kind} ${seen.setdefault(own, len(seen))}" if own else f"{kind} {type(x.value).__name__ if value else ''}")
    digest = lambda rows: hashlib.sha1("\n".join(rows).encode("utf-8", "replace")).hexdigest()
    return len(exact), digest(exact[1:]), digest(shape[1:])


def of_source(file: str, source: str | None) -> list[tuple]:
    """The facts of one file."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(file, "error", type(e).__name__, "", getattr(e, "lineno", None), None, None, None, None)]
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, owner = todo.pop()
        add = lambda kind, name, line=None, end=None, n=None, flag=None, detail=None, owner=owner: out.append((file, kind, name, owner, line, end, n, flag, detail))
        inside = owner
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inside = f"{owner}.{node.name}".lstrip(".")
            shape = _shape_of(node, file)
            add("function", inside, node.lineno, node.end_lineno, _depth(node), isinstance(node, ast.AsyncFunctionDef), shape)
            tokens, exact, form = _hashes(node)
            add("clone", form, node.lineno, node.end_lineno, tokens, None, exact, inside)
            if shape == "test":
                checks = sum(isinstance(x, ast.Assert) or isinstance(x, ast.Call) and (_dotted(x.func).split(".")[-1].lower().startswith("assert") or _dotted(x.func).split(".")[-1] in ("raises", "warns", "fail")) for x in ast.walk(node))
                add("test", inside, node.lineno, node.end_lineno, checks)
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and _dotted(d.func).split(".")[-1] in _METHODS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    add("route", d.args[0].value, d.lineno, None, None, None, _dotted(d.func).split(".")[-1], inside)
            for a in [*node.args.args, *node.args.kwonlyargs]:
                if isinstance(a.annotation, ast.Name) and a.annotation.id == "bool":
                    add("bool", a.arg, a.lineno, None, None, None, "parameter", inside)
        elif isinstance(node, ast.ClassDef):
            inside = f"{owner}.{node.name}".lstrip(".")
            add("class", inside, node.lineno, node.end_lineno, len(node.bases), None, _dotted(node.bases[0]) if node.bases else None)
        elif isinstance(node, ast.Import):
            for a in node.names:
                add("import", a.name, node.lineno, None, 0, False)
        elif isinstance(node, ast.ImportFrom):
            add("import", node.module or "", node.lineno, None, node.level, node.level > 0, ",".join(a.name for a in node.names))
        elif isinstance(node, ast.Call):
            name = _dotted(node.func)
            add("call", name, node.lineno, None, len(node.args), name in _BLOCKING)
            tail = ".".join(name.split(".")[-2:])
            if tail in ("datetime.now", "datetime.utcnow", "datetime.today", "date.today", "time.time"):
                add("clock", tail, node.lineno, None, None, tail != "time.time" and not (tail == "datetime.now" and (node.args or node.keywords)))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.annotation, ast.Name) and node.annotation.id == "bool" and isinstance(node.target, ast.Name):
            add("bool", node.target.id, node.lineno, None, None, None, "annotated")
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, bool):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    add("bool", t.id, node.lineno, None, None, None, "assigned")
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            add("literal", node.value, node.lineno)
        todo += [(c, inside) for c in ast.iter_child_nodes(node)]
    return out


def facts(files: DataFrame) -> DataFrame:
    """Facts of (file, text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                found = [r for f, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in of_source(f, t)]
                cols = zip(*found, strict=True) if found else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("file", "text").mapInArrow(rows, SCHEMA)


def large_functions(f: DataFrame) -> DataFrame:
    budget = F.lit(BUDGETS["unknown"])
    for shape, n in BUDGETS.items():
        budget = F.when(F.col("detail") == shape, n).otherwise(budget)
    d = f.where("kind = 'function'").select("file", F.col("name").alias("symbol"), "line", "detail", F.col("n").alias("nesting"), (F.col("end_line") - F.col("line") + 1).alias("lines"), budget.alias("budget"))
    d = d.where("lines > budget OR nesting >= 4")
    ratio = F.col("lines") / F.col("budget")
    return d.withColumn("severity", F.when(F.col("detail").isin("test", "cli"), "low").when(ratio >= 2.5, "high").when((ratio >= 1.4) | (F.col("nesting") >= 4), "medium").otherwise("low"))


def direct_dates(f: DataFrame) -> DataFrame:
    g = f.where("kind = 'clock'").groupBy("file").agg(F.count("*").alias("total"), F.count_if("flag").alias("naive"), F.min("line").alias("line"))
    return g.withColumn("severity", F.when((F.col("naive") >= 4) | (F.col("total") >= 8), "high").when((F.col("naive") >= 1) | (F.col("total") >= 2), "medium").otherwise("low"))


def mixed_utc_local(f: DataFrame) -> DataFrame:
    g = f.where("kind = 'clock' AND flag").groupBy("file").agg(F.count_if(F.col("name") == "datetime.utcnow").alias("utc"), F.count_if(F.col("name").isin("datetime.now", "datetime.today", "date.today")).alias("local"))
    return g.where("utc > 0 AND local > 0").withColumn("severity", F.when(F.col("utc") + F.col("local") >= 5, "high").otherwise("medium"))


def boolean_naming(f: DataFrame) -> DataFrame:
    d = f.where("kind = 'bool'").where(~F.col("name").rlike(PREFIXES) & ~F.lower("name").isin(*BARE)).groupBy("file").agg(F.countDistinct("name", "owner").alias("names"))
    return d.withColumn("severity", F.when(F.col("names") >= 4, "medium").otherwise("low"))


def deep_imports(f: DataFrame) -> DataFrame:
    depth = F.size(F.split("name", r"\."))
    d = f.where("kind = 'import'").withColumn("depth", depth).where((F.col("depth") > 4) | (F.col("n") >= 3))
    g = d.groupBy("file").agg(F.count("*").alias("offenders"), F.max("depth").alias("deepest"))
    return g.withColumn("severity", F.when((F.col("deepest") >= 7) | (F.col("offenders") >= 6), "high").when((F.col("deepest") >= 5) | (F.col("offenders") >= 3), "medium").otherwise("low"))


def blocking_in_hot_path(f: DataFrame, top: int = 3) -> DataFrame:
    """Blocking calls inside async functions and routes, by innermost function, at most `top` functions a file (a report limit)."""
    from pyspark.sql import Window

    hot = f.where("kind = 'function' AND (flag OR detail = 'route')").select("file", F.col("name").alias("owner"))
    g = f.where("kind = 'call' AND flag").join(hot, ["file", "owner"]).groupBy("file", "owner").agg(F.count("*").alias("calls"), F.min("line").alias("line"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.col("calls").desc(), "line"))).where(F.col("_r") <= top).drop("_r")


def weak_tests(f: DataFrame) -> DataFrame:
    """Tests without assertions, with credit for helpers of the same file, up to two hops, that assert."""
    funcs = f.where("kind = 'function'").select("file", F.col("name").alias("callee"))
    asserts = f.where("kind = 'call'").where(F.regexp_extract("name", r"([^.]*)$", 1).rlike("(?i)^assert")).select("file", F.col("owner").alias("callee")).distinct()
    calls = f.where("kind = 'call'").select("file", F.col("owner"), F.regexp_extract("name", r"([^.]*)$", 1).alias("callee")).join(funcs, ["file", "callee"]).distinct()
    one = calls.join(asserts, ["file", "callee"]).select("file", F.col("owner").alias("callee")).distinct()
    good = asserts.unionByName(one).distinct()
    two = calls.join(good, ["file", "callee"]).select("file", F.col("owner").alias("name")).distinct()
    tests = f.where("kind = 'test'").select("file", "name", (F.col("n") == 0).alias("hollow")).join(two.withColumn("_credit", F.lit(True)), ["file", "name"], "left")
    g = tests.groupBy("file").agg(F.count("*").alias("tests"), F.count_if(F.col("hollow") & F.col("_credit").isNull()).alias("hollow")).where("hollow > 0")
    share = F.col("hollow") / F.col("tests")
    return g.withColumn("severity", F.when((share >= 0.5) & (F.col("hollow") >= 3), "high").when((share >= 0.25) | (F.col("hollow") >= 2), "medium").otherwise("low"))


def clones(f: DataFrame, near: bool = False, least_tokens: int = 40, least_lines: int = 8) -> DataFrame:
    """Functions with equal bodies (near: equal but for names) in two files or more: hash, anchor, files."""
    d = f.where(f"kind = 'clone' AND n >= {least_tokens} AND end_line - line + 1 >= {least_lines}")
    key = "name" if near else "detail"
    g = d.groupBy(F.col(key).alias("hash")).agg(F.min("file").alias("anchor"), F.countDistinct("file").alias("files"), F.countDistinct("detail").alias("bodies")).where("files >= 2")
    return g.where("bodies > 1") if near else g


def near_clones(f: DataFrame, least_tokens: int = 40, least_lines: int = 8) -> DataFrame:
    """Functions equal but for names in two files or more, without groups of which an exact group covers two sites or more: hash, anchor, files."""
    d = f.where(f"kind = 'clone' AND n >= {least_tokens} AND end_line - line + 1 >= {least_lines}")
    exact = d.groupBy("name", "detail").agg(F.countDistinct("file").alias("same"))
    covered = exact.where("same >= 2").select(F.col("name").alias("hash")).distinct()
    g = d.groupBy(F.col("name").alias("hash")).agg(F.min("file").alias("anchor"), F.countDistinct("file").alias("files"), F.countDistinct("detail").alias("bodies")).where("files >= 2 AND bodies > 1")
    return g.join(covered, "hash", "left_anti")


def import_edges(f: DataFrame) -> DataFrame:
    """(src, dst) of imports that name a module of the table, relative ones by the importing file's package; never a self-edge."""
    path = F.regexp_replace(F.regexp_replace("file", r"\.pyi?$", ""), "(?:^|/)__init__$", "")
    modules = f.select("file").distinct().withColumn("module", F.translate(path, "/", "."))
    package = F.regexp_replace(F.regexp_extract("file", "^(.*?)/?[^/]*$", 1), "/", ".")
    up = F.array_join(F.slice(F.split(package, r"\."), F.lit(1), F.greatest(F.size(F.split(package, r"\.")) - F.col("n") + 1, F.lit(0))), ".")
    target = F.when(F.col("n") == 0, F.col("name")).otherwise(F.array_join(F.filter(F.array(up, F.col("name")), lambda x: x != ""), "."))
    d = f.where("kind = 'import'").withColumn("target", target)
    # from package import module: the module itself, else the package
    names = F.concat(F.array(F.col("target")), F.transform(F.split(F.coalesce("detail", F.lit("")), ","), lambda x: F.concat_ws(".", F.nullif(F.col("target"), F.lit("")), x)))
    edges = d.select(F.col("file").alias("src"), F.explode(F.array_distinct(names)).alias("module")).join(modules.withColumnRenamed("file", "dst"), "module")
    return edges.where("src <> dst").select("src", "dst").distinct()


def module_references(f: DataFrame) -> DataFrame:
    """Per imported module name: references, and those from tests."""
    d = f.where("kind = 'import' AND name <> ''")
    return d.groupBy(F.col("name").alias("module")).agg(F.count("*").alias("total"), F.count_if(F.col("file").rlike("(?:^|/)tests?/|(?:^|/)test_")).alias("test"))
