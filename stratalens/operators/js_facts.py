"""Facts of JavaScript and TypeScript sources by a lexer, and rules over them.

No parser for these languages runs on executors here, so a lexer stands in: strings, templates,
comments, regular expressions and brackets are told apart exactly; functions, handlers and retry
sites are found by their token patterns. Facts about imports, literals, comments, environment
reads and clock reads are exact; those about functions and handlers are approximate.

facts(): (file, kind, name, owner, line, end_line, n, flag, detail). kinds: import (flag: type
only, detail: static or dynamic), literal, comment (n: lines), env (detail: default), clock (flag: compared
or reckoned with), function, clone (name: shape hash, detail: exact hash, n: tokens), handler (detail: empty, log or
other), fetch (name: path, detail: method), sync_io, style (raw style values), error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, kind string, name string, owner string, line int, end_line int, n int, flag boolean, detail string"
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<template>`(?:\\.|[^`\\])*`?)"
    r"|(?P<number>\b\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<mark>=>|\?\?|\|\||&&|\.\.\.|[^\s\w])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};") | {"return", "typeof", "case", "=>", "&&", "||", "??"}
_KEYWORDS = set("if for while switch catch return function class const let var new await async throw try else do typeof import export from default extends static get set".split())
_STYLE = re.compile(r"^(?:#[0-9a-fA-F]{3,8}|rgba?\([^)]*\)|\d+px|0 \d+px \d+px .*)$")


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of a source; a slash where a value can begin opens a regular expression."""
    out: list[tuple[str, str, int]] = []
    at, line, last = 0, 1, "("
    while m := _TOKEN.search(source, at):
        line += source.count("\n", at, m.start())
        kind, text, end = m.lastgroup, m[0], m.end()
        if text == "/" and last in _BEFORE_REGEX and (r := _REGEX.match(source, m.start())):
            kind, text, end = "regex", r[0], r.end()
        out.append((kind, text, line))
        if kind != "comment":
            last = text
        line += text.count("\n")
        at = end
    return out


def _brackets(code: list[tuple[str, str, int]]) -> dict[int, int]:
    """The index of every bracket's partner, both ways; an opening one without a partner has the last token's."""
    closes, open_at, out = {"}": "{", ")": "(", "]": "["}, {"{": [], "(": [], "[": []}, {}
    for k, (kind, text, _) in enumerate(code):
        if kind != "mark":
            continue
        if text in open_at:
            open_at[text].append(k)
        elif text in closes and open_at[closes[text]]:
            i = open_at[closes[text]].pop()
            out[i], out[k] = k, i
    return {i: len(code) - 1 for left in open_at.values() for i in left} | out


def _owners(spans: list[tuple[int, int, str]], n: int) -> list[str]:
    """For every token the name of the innermost function around it."""
    out, open_now, at = [""] * n, [], 0
    spans = sorted(spans, key=lambda s: (s[0], -s[1]))
    for i in range(n):
        while at < len(spans) and spans[at][0] == i:
            open_now.append(spans[at])
            at += 1
        while open_now and open_now[-1][1] < i:
            open_now.pop()
        if open_now:
            out[i] = open_now[-1][2]
    return out


def _named_at(code: list[tuple[str, str, int]], j: int) -> int:
    """Walking back from j over an arrow function's parameters: the index of the mark that gives it a name, or 0."""
    depth = 0
    for k in range(j, 0, -1):
        kind, text, _ = code[k]
        if kind != "mark":
            continue
        if text in ")]}":
            depth += 1
        elif depth:
            depth -= text in "([{"
        elif text in "=:" and code[k - 1][0] == "name":
            return k
        elif text in "([{;,=":
            return 0
    return 0


def of_source(file: str, source: str | None) -> list[tuple]:
    every = tokens(source or "")
    code = [t for t in every if t[0] != "comment"]
    out: list[tuple] = []
    spans: list[tuple[int, int, str]] = []
    texts = [t[1] for t in code]
    partner, last_import = _brackets(code), None
    add = lambda kind, name, line, end=None, n=None, flag=None, detail=None, owner="": out.append((file, kind, name, owner, line, end, n, flag, detail))
    bare = lambda s: s[1:-1] if len(s) > 1 and s[-1] == s[0] else s[1:]
    for i, (_, text, _) in enumerate(code):
        if text == "{" and i and texts[i - 1] in (")", "=>"):
            if texts[i - 1] == ")":
                k = partner.get(i - 1, -1)
                name = texts[k - 1] if k > 0 and code[k - 1][0] == "name" else ""
            else:
                k = _named_at(code, i - 2)
                name = texts[k - 1] if k else ""
            if name in _KEYWORDS - {"function", "get", "set"}:
                continue
            end = partner.get(i, len(code) - 1)
            name = "" if name == "function" else name
            spans.append((i, end, name))
            add("function", name, code[k - 1 if k > 0 else i][2], code[end][2], end - i)
            if end - i >= 2:
                seen: dict[str, int] = {}
                body = code[i : end + 1]
                shape = [f"${seen.setdefault(t, len(seen))}" if k == "name" and t not in _KEYWORDS else k if k in ("string", "number", "template") else t for k, t, _ in body]
                digest = lambda xs: hashlib.sha1(" ".join(xs).encode("utf-8", "replace")).hexdigest()
                add("clone", digest(shape), code[i][2], code[end][2], len(body), None, digest([t for _, t, _ in body]), name)
    owners = _owners(spans, len(code))
    owner_of = owners.__getitem__
    for i, (kind, text, line) in enumerate(code):
        after = texts[i + 1 : i + 8]
        before = texts[max(0, i - 3) : i]
        if kind == "name" and text in ("import", "export"):
            last_import = i
        if kind in ("string", "template") and text[:1] != "`":
            if before[-1:] == ["from"] or before[-1:] == ["import"]:
                start = i if last_import is None else last_import
                add("import", bare(text), line, None, None, texts[start + 1 : start + 2] == ["type"], "static")
                continue
            if before[-2:] in (["import", "("], ["require", "("]):
                add("import", bare(text), line, None, None, False, "dynamic")
                continue
            add("literal", bare(text), line, owner=owner_of(i))
            if _STYLE.match(bare(text)):
                add("style", bare(text), line)
        elif kind == "name":
            if text == "process" and after[:3] == [".", "env", "."] and len(after) > 3:
                rest = after[4:6]
                add("env", after[3], line, detail=rest[1] if rest[:1] in (["??"], ["||"]) and len(rest) > 1 else None, owner=owner_of(i))
            elif text == "Date" and (after[:2] == [".", "now"] or before[-1:] == ["new"] and after[:2] == ["(", ")"]):
                now = after[0] == "."
                # Date.now() or new Date(): what stands before and after the call
                around = texts[i - (1 if now else 2) : i - (0 if now else 1)] + texts[i + (5 if now else 3) : i + (6 if now else 4)]
                add("clock", "Date.now" if now else "new Date", line, flag=any(t in ("<", ">", "-", "+") for t in around), owner=owner_of(i))
            elif text == "catch":
                at = i + 1
                if at < len(code) and texts[at] == "(":
                    at = partner.get(at, len(code) - 1) + 1
                if at < len(code) and texts[at] == "{":
                    body = texts[at + 1 : partner.get(at, len(code) - 1)]
                    add("handler", "catch", line, n=len(body), detail="empty" if not body else "log" if body[0] == "console" and "throw" not in body and body.count(";") <= 1 else "other", owner=owner_of(i))
            elif text == "fetch" and after[:1] == ["("] and i + 2 < len(code) and code[i + 2][0] in ("string", "template"):
                method = next((bare(texts[j + 2]) for j in range(i, min(partner.get(i + 1, len(code)), len(code) - 2)) if texts[j] == "method" and texts[j + 1] == ":"), "GET")
                add("fetch", bare(texts[i + 2]), line, detail=method.upper(), owner=owner_of(i))
            elif text.endswith("Sync") and after[:1] == ["("]:
                add("sync_io", text, line, owner=owner_of(i))
    block: list[tuple[str, int]] = []
    for kind, text, line in [*every, ("end", "", -1)]:
        if kind == "comment" and (not block or text.startswith("//") and line == block[-1][1] + 1):
            block.append((text, line))
            continue
        if block:
            body = "\n".join(t for t, _ in block)
            add("comment", body, block[0][1], block[-1][1] + block[-1][0].count("\n"), body.count("\n") + 1)
        block = [(text, line)] if kind == "comment" else []
    return out


def facts(files: DataFrame) -> DataFrame:
    """Facts of (file, text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 50):
                part = b.slice(lo, 50)
                found = [r for f, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in of_source(f, t)]
                cols = zip(*found, strict=True) if found else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("file", "text").mapInArrow(rows, SCHEMA)


def swallowed_errors(f: DataFrame) -> DataFrame:
    d = f.where("kind = 'handler' AND detail IN ('empty', 'log')")
    return d.select("file", "owner", "line", "detail", F.when(F.col("detail") == "empty", "medium").otherwise("low").alias("severity"))


def config_drift(f: DataFrame) -> DataFrame:
    """Environment variables with several defaults, or required in one file and optional in another."""
    g = f.where("kind = 'env'").groupBy("name").agg(F.countDistinct("detail").alias("defaults"), F.count_if(F.col("detail").isNull()).alias("required"), F.countDistinct("file").alias("files"), F.min("file").alias("anchor"))
    return g.where("defaults >= 2 OR (required > 0 AND defaults > 0 AND files >= 2)")


def literal_scatter(f: DataFrame, pattern: str = r"^[a-z][a-z0-9]*(?:[_-][a-z0-9]+)+$") -> DataFrame:
    """Domain literals in three files and two directories."""
    d = f.where("kind = 'literal'").where(F.col("name").rlike(pattern)).withColumn("dir", F.regexp_extract("file", "^(.*?)/?[^/]*$", 1))
    g = d.groupBy("name").agg(F.countDistinct("file").alias("files"), F.countDistinct("dir").alias("dirs"), F.min("file").alias("anchor")).where("files >= 3 AND dirs >= 2")
    return g.withColumn("severity", F.when((F.col("files") >= 5) | (F.col("dirs") >= 3), "medium").otherwise("low"))


def design_token_escape(f: DataFrame, least: int = 5) -> DataFrame:
    g = f.where("kind = 'style'").groupBy("file").agg(F.count("*").alias("values")).where(F.col("values") >= least)
    return g.withColumn("severity", F.when(F.col("values") >= 10, "medium").otherwise("low"))


def import_edges(f: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, type_only, dynamic) of relative imports: the first that exists of path, its extensions and index files."""
    d = f.where("kind = 'import' AND name LIKE '.%'").select(F.col("file").alias("src"), "name", F.col("flag").alias("type_only"), (F.col("detail") == "dynamic").alias("dynamic"))
    raw = F.split(F.concat_ws("/", F.regexp_extract("src", "^(.*?)/?[^/]*$", 1), "name"), "/")
    step = lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    path = F.regexp_replace(F.array_join(F.aggregate(raw, F.array().cast("array<string>"), step), "/"), r"\.(?:js|jsx|mjs)$", "")
    tails = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
    tried = d.withColumn("_p", path).select("src", "name", "type_only", "dynamic", F.posexplode(F.array(*[F.concat("_p", F.lit(t)) for t in tails])).alias("_k", "dst"))
    hit = tried.join(files.select(F.col("file").alias("dst")), "dst").groupBy("src", "name", "type_only", "dynamic").agg(F.min_by("dst", "_k").alias("dst"))
    return hit.where("src <> dst").select("src", "dst", "type_only", "dynamic").distinct()
