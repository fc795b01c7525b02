"""Rules over source files (file, text) as column expressions: dates, naming, conditions, retries, tests, markup, assets, agent settings.

Everything runs inside the JVM. Rules over functions take bodies(), the text of each function that
the lexer found; the others count matches in the whole text, so strings and comments count too.
Null texts have no matches. Every rule gives one row per offender, with a severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import lines

UI_PATH = r"(?i)\.(?:tsx|jsx|vue|svelte)$|/(?:components|pages|views|ui)/"
SENSITIVE_PATH = r"(?i)billing|invoice|payment|calendar|schedul|booking|payroll|subscription"
_PART = "(?:FullYear|Month|Date|Day|Hours|Minutes|Seconds|Milliseconds)"


def _counted(files: DataFrame, pattern: str, severity: Column, least: int = 1) -> DataFrame:
    return files.select("file", F.regexp_count("text", F.lit(pattern)).alias("hits")).where(F.col("hits") >= least).withColumn("severity", severity)


def _by(high: int | None = None, medium: int | None = None, low: str = "low") -> Column:
    out = F.lit(low)
    if medium is not None:
        out = F.when(F.col("hits") >= medium, "medium").otherwise(out)
    return out if high is None else F.when(F.col("hits") >= high, "high").otherwise(out)


def _found(files: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    """(file, name): a row per match."""
    return files.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias(name))


# Dates and locales.


def timezone_unsafe_parse(files: DataFrame) -> DataFrame:
    """Dates parsed from a string that names no zone."""
    return _counted(files, r"""new Date\(\s*["'`]\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?["'`]\s*\)""", _by(high=5, low="medium"))


def mixed_utc_local_methods(files: DataFrame) -> DataFrame:
    """Receivers of which both UTC and local date methods are called."""
    calls = _found(files, rf"\b[A-Za-z_$][\w$]*\.[gs]et(?:UTC)?{_PART}\(", 0, "call")
    d = calls.select("file", F.substring_index("call", ".", 1).alias("receiver"), F.col("call").rlike(r"\.[gs]etUTC").alias("utc"))
    return d.groupBy("file", "receiver").agg(F.count_if("utc").alias("utc"), F.count_if(~F.col("utc")).alias("local")).where("utc > 0 AND local > 0").withColumn("severity", F.lit("high"))


def locale_drift(files: DataFrame) -> DataFrame:
    """Locale formatting without a locale."""
    ui = F.col("file").rlike(UI_PATH)
    return _counted(files, r"\.toLocale(?:Date|Time)?String\(\s*\)", F.when(ui, _by(high=5, low="medium")).otherwise(_by(medium=3)))


def dst_naive_arithmetic(files: DataFrame) -> DataFrame:
    """Days as a fixed number of milliseconds."""
    severity = F.when(F.col("file").rlike(SENSITIVE_PATH) | (F.col("hits") >= 3), "high").otherwise("medium")
    return _counted(files, r"\b86_?400_?000\b|\b24\s*\*\s*60\s*\*\s*60\s*\*\s*1_?000\b|\b24\s*\*\s*3_?600\s*\*\s*1_?000\b", severity)


def date_string_concat(files: DataFrame) -> DataFrame:
    """Date parts glued to strings."""
    return _counted(files, rf"""\.get(?:UTC)?{_PART}\(\)(?:\s*\+\s*1\s*\))?\s*\+\s*["'`]""", _by(medium=3))


# Names.


def boolean_naming_drift(files: DataFrame) -> DataFrame:
    """Boolean declarations whose name doesn't read as a question."""
    names = _found(files, r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::\s*boolean\s*)?=\s*(?:true|false)\b", 1, "name")
    d = names.where(~F.col("name").rlike(r"^_*(?:is|has|had|can|could|should|will|would|did|does|do|was|were|are|allow|enable|disable|needs?|must|use|show|hide|IS_|HAS_)(?:[A-Z_]|$)"))
    g = d.groupBy("file").agg(F.count("*").alias("hits"), F.min("name").alias("first_name"))
    return g.withColumn("severity", _by(medium=5))


def singular_plural_type_mismatch(files: DataFrame) -> DataFrame:
    """Plural names of one value, singular names of a list."""
    return _counted(files, r"\b[a-z]\w*(?<![su])s\??:\s*(?:string|number|boolean)\b(?!\s*\[)|\b[a-z]\w*[^s\W]\??:\s*(?:string|number|boolean)\[\]", _by(medium=4))


def option_bag_junk_drawer(bodies: DataFrame, least: int = 6) -> DataFrame:
    """Functions that read at least `least` distinct properties of an options parameter."""
    read = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(?:options|opts|config|settings|params|props)\.([A-Za-z_$][\w$]*)"), F.lit(1)))
    return bodies.select("file", "owner", "line", F.size(read).alias("properties")).where(F.col("properties") >= least).withColumn("severity", F.lit("low"))


def negative_flag_maze(files: DataFrame) -> DataFrame:
    """Conditions with at least two negative flags."""
    d = _found(files, r"\b(?:if|while)\s*\(([^\n{]*)\)", 1, "condition")
    flags = F.array_distinct(F.regexp_extract_all("condition", F.lit(r"\b(?:is|has|should|can)?(?:[nN]o|[nN]ot|[nN]on|[dD]isabled?|[sS]kip|[hH]idden|[hH]ide|[iI]gnore|[wW]ithout|[pP]revent|[eE]xclude)(?:[A-Z]\w*)\b"), F.lit(0)))
    return d.select("file", "condition", F.size(flags).alias("flags")).where("flags >= 2").withColumn("severity", F.lit("low"))


# Functions.


def bodies(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, owner, line, end_line, head, body) of the functions among lexer facts; head is the first line."""
    own = facts.where("kind = 'function'").select("file", F.col("name").alias("owner"), "line", "end_line")
    part = F.slice(F.split("text", "\n"), F.greatest(F.col("line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1)))
    return own.join(files.select("file", "text"), "file").select("file", "owner", "line", "end_line", part[0].alias("head"), F.array_join(part, "\n").alias("body"))


_STRONG = r"\b(?:fetch|axios(?:\.\w+)?|writeFile\w*|unlink\w*|rmSync|execSync)\(|\.(?:save|delete|insert|update|destroy|remove|send)\("
_WEAK = r"\bthis\.\w+\s*=(?!=)|\blocalStorage\.set|\bconsole\.\w+\(|\.(?:emit|dispatch|publish)\(|\bset[A-Z]\w*\("


def name_behavior_mismatch(bodies: DataFrame) -> DataFrame:
    """Functions whose name promises a pure answer but that act: one strong sign, or two."""
    d = bodies.where(F.col("owner").rlike(r"^(?:get|is|has|can|find|compute|calculate|format|parse|validate|check|to)[A-Z_]"))
    d = d.select("file", "owner", "line", F.regexp_count("body", F.lit(_STRONG)).alias("strong"), F.regexp_count("body", F.lit(_WEAK)).alias("weak"))
    return d.where("strong > 0 OR weak >= 2").withColumn("severity", F.when(F.col("strong") > 0, "medium").otherwise("low"))


def return_shape_roulette(bodies: DataFrame) -> DataFrame:
    """Functions without a return type that return three kinds of objects, two of which share less than half of their keys."""
    keys = lambda inner: F.array_sort(F.filter(F.transform(F.split(inner, ","), lambda p: F.regexp_extract(p, r"^\s*([A-Za-z_$][\w$]*)", 1)), lambda k: k != ""))
    shapes = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"\breturn\s*\{([^{}]*)\}"), F.lit(1)), keys))
    d = bodies.where(~F.col("head").rlike(r"\)\s*:\s*\w")).select("file", "owner", "line", shapes.alias("kinds")).where(F.size("kinds") >= 3)
    overlap = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    weakest = F.array_min(F.flatten(F.transform("kinds", lambda a: F.transform("kinds", lambda b: overlap(a, b)))))
    return d.select("file", "owner", "line", F.size("kinds").alias("shapes"), weakest.alias("overlap")).where("overlap < 0.5").withColumn("severity", F.lit("low"))


def unsafe_retry(bodies: DataFrame) -> DataFrame:
    """Functions that repeat a change without an idempotency key."""
    again = F.col("body").rlike(r"\b(?:for|while)\b[^\n]*(?i:retr|attempt|tries)|\b(?:retry|withRetry|pRetry)\(")
    change = r"""method:\s*["'](?:POST|PUT|PATCH|DELETE)|\.(?:post|put|patch|delete|insert|create|save|charge)\("""
    safe = F.col("body").rlike(r"(?i)idempoten|dedup|request_?id")
    d = bodies.where(again & F.col("body").rlike(change) & ~safe)
    money = F.col("body").rlike(r"(?i)charge|payment|invoice|refund") | F.col("file").rlike(SENSITIVE_PATH)
    return d.select("file", "owner", "line", F.when(money, "high").otherwise("medium").alias("severity"), F.lit(0.62).alias("confidence"))


def unbounded_async_fanout(bodies: DataFrame) -> DataFrame:
    """Promise.all over a collection of unknown size, with I/O in it and no limit."""
    many = F.col("body").rlike(r"Promise\.(?:all|allSettled)\(\s*[\w$.]+\.map\(")
    io = F.col("body").rlike(r"\b(?:fetch|axios|readFile|writeFile|request|query)\b|\.(?:find|findOne|findMany|query|get|post|send|save)\(")
    limited = F.col("body").rlike(r"(?i)p-?limit|concurrency|chunk|batch|semaphore|\.slice\(\s*0\s*,\s*[1-8]\s*\)")
    return bodies.where(many & io & ~limited).select("file", "owner", "line", F.lit("medium").alias("severity"), F.lit(0.6).alias("confidence"))


def pass_through(bodies: DataFrame, least: int = 4) -> DataFrame:
    """Files with at least `least` functions that only forward their call."""
    d = bodies.where(F.col("body").rlike(r"(?s)^[^{]*\{\s*return\s+(?:await\s+)?[\w$.]+\([\w$,\s.]*\);?\s*\}\s*;?\s*$") & (F.col("owner") != ""))
    return d.groupBy("file").agg(F.count("*").alias("wrappers"), F.min("owner").alias("first_owner")).where(F.col("wrappers") >= least).withColumn("severity", F.lit("low"))


# Tests.


def test_cases(bodies: DataFrame) -> DataFrame:
    """(file, line, asserts, weak, calls, mocks) of the bodies that a test call opens."""
    n = lambda p: F.regexp_count("body", F.lit(p))
    return bodies.where(F.col("head").rlike(r"\b(?:it|test)(?:\.\w+)?\s*\(\s*[\"'`]")).select(
        "file", "line", n(r"\bexpect\(|\bassert\w*[.(]").alias("asserts"), n(r"\.(?:toBeTruthy|toBeFalsy|toBeDefined|toBeUndefined)\(|\.not\.toBeNull\(").alias("weak"),
        n(r"\.toHaveBeenCalled\w*\(|\.toBeCalled\w*\(").alias("calls"), n(r"\b(?:jest|vi|sinon)\.(?:fn|mock|spyOn|stub|spy)\(").alias("mocks"),
    )


def weak_test_signal(cases: DataFrame) -> DataFrame:
    """Tests that assert nothing, or only that something is there."""
    return cases.where("asserts = 0 OR weak >= asserts").select("file", "line", "asserts", F.when(F.col("asserts") == 0, "medium").otherwise("low").alias("severity"))


def mock_saturation(cases: DataFrame) -> DataFrame:
    """Tests with two mocks or more that only assert how those were called."""
    return cases.where("mocks >= 2 AND asserts > 0 AND calls >= asserts").select("file", "line", "mocks", F.lit("medium").alias("severity"))


# Comments and paths.


def commented_out_code(files: DataFrame, least: int = 4, code_lines: int = 3) -> DataFrame:
    """Runs of at least `least` comment lines of which `code_lines` read as code: file, line, end_line, code."""
    d = lines(files).where(F.col("content").rlike(r"^\s*(?:#|//|--)")).withColumn("inner", F.regexp_replace("content", r"^\s*(?:#+|//+|--+)\s?", ""))
    run = Window.partitionBy("file").orderBy("line")
    d = d.withColumn("island", F.col("line") - F.row_number().over(run))
    code = F.col("inner").rlike(r"[;{}]\s*$|^\s*(?:if|for|while|return|def|import|class|var|let|const|else|elif|try)\b.*[:(;={]|^\s*[\w.\[\]]+\s*[-+*/]?=[^=]|^\s*[\w.]+\(.*\)\s*;?$")
    g = d.groupBy("file", "island").agg(F.min("line").alias("line"), F.max("line").alias("end_line"), F.count("*").alias("n"), F.count_if(code).alias("code"))
    return g.where((F.col("n") >= least) & (F.col("code") >= code_lines)).select("file", "line", "end_line", "code", F.when(F.col("n") >= 40, "medium").otherwise("low").alias("severity"))


def finder_duplicate_filename(files: DataFrame) -> DataFrame:
    """Paths like "name 2.ext"."""
    return files.where(F.col("file").rlike(r"[^/] [2-9]\d*\.[A-Za-z0-9]+$")).select("file", F.lit("low").alias("severity"))


def deep_import(facts: DataFrame) -> DataFrame:
    """Files that import from inside other packages: at least three path segments, one of them private."""
    parts = F.split("name", "/")
    tail = F.slice(parts, F.when(F.col("name").startswith("@"), 3).otherwise(2), F.size(parts))
    d = facts.where("kind = 'import' AND name NOT LIKE '.%' AND name NOT LIKE '/%'").where(F.size(tail) >= 3)
    d = d.where(F.exists(tail, lambda x: x.rlike(r"(?i)^(?:internals?|private|dist|src|lib|build|impl|_.*)$")))
    return d.groupBy("file").agg(F.count("*").alias("hits")).withColumn("severity", _by(high=10, medium=3))


# Markup and styles.


def accessible_interaction_risk(files: DataFrame) -> DataFrame:
    """Clickable boxes that keyboards and readers don't reach."""
    d = _found(files, r"<(?:div|span|li|td)\b(?:=>|[^>])*\bonClick=(?:=>|[^>])*>", 0, "tag")
    d = d.where(~F.col("tag").rlike(r"\b(?:role|tabIndex|onKeyDown|onKeyUp|onKeyPress)="))
    return d.groupBy("file").agg(F.count("*").alias("hits")).withColumn("severity", F.lit("medium"))


def responsive_fragility(files: DataFrame, least: int = 3) -> DataFrame:
    """Files with fixed widths over 320 px, pixel grids, and large fixed fonts without a media query."""
    over = lambda p, n: F.size(F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda v: v.cast("int") > n))
    fonts = F.when(F.col("text").contains("@media"), 0).otherwise(over(r"font-?[sS]ize:\s*[\"']?(\d{1,6})px", 16))
    hits = over(r"(?<![-\w])(?:min-?)?[wW]idth:\s*[\"']?(\d{1,6})px", 320) + fonts + F.regexp_count("text", F.lit(r"grid-?[tT]emplate-?[cC]olumns:[^;\n]*\d+px"))
    return files.select("file", hits.alias("hits")).where(F.col("hits") >= least).withColumn("severity", F.lit("low"))


def component_shapes(bodies: DataFrame, least_files: int = 3, nodes: int = 4) -> DataFrame:
    """Sequences of at least `nodes` markup tags that components of `least_files` files share."""
    tags = F.regexp_extract_all("body", F.lit(r"<(/?[A-Za-z][\w.]*)(?=[\s/>])"), F.lit(1))
    d = bodies.select("file", "owner", tags.alias("tags")).where(F.size(F.filter("tags", lambda t: ~t.startswith("/"))) >= nodes)
    g = d.groupBy(F.sha1(F.array_join("tags", " ")).alias("shape")).agg(F.countDistinct("file").alias("files"), F.min("file").alias("anchor"))
    return g.where(F.col("files") >= least_files).withColumn("severity", F.lit("low"))


def repeated_checks(files: DataFrame, least: int = 3) -> DataFrame:
    """Comparisons of a role, status or plan with one literal in at least `least` files."""
    d = _found(files, r"""\b(?:role|status|plan|tier)\s*[!=]==?\s*["'`][\w-]+["'`]""", 0, "check")
    d = d.select("file", F.regexp_extract("check", r"^\w+", 0).alias("subject"), F.regexp_extract("check", r"""["'`]([\w-]+)""", 1).alias("value"))
    g = d.groupBy("subject", "value").agg(F.countDistinct("file").alias("files"), F.min("file").alias("anchor")).where(F.col("files") >= least)
    return g.withColumn("severity", F.when(F.col("files") >= 5, "high").otherwise("medium"))


def action_label_drift(files: DataFrame, aliases: DataFrame, least: int = 3) -> DataFrame:
    """Actions that the markup's labels name in at least `least` ways, each in two files. aliases: (group_id, alias), a dimension."""
    labels = _found(files, r">\s*([A-Za-z][A-Za-z ]{0,30})\s*</", 1, "alias").withColumn("alias", F.lower(F.trim("alias")))
    used = labels.join(aliases, "alias").groupBy("group_id", "alias").agg(F.countDistinct("file").alias("f")).where("f >= 2")
    g = used.groupBy("group_id").agg(F.count("*").alias("hits"), F.min("alias").alias("first_alias")).where(F.col("hits") >= least)
    return g.withColumn("severity", _by(medium=4))


def permission_ia_drift(files: DataFrame) -> DataFrame:
    """Destinations that three files or more name under two permissions or more."""
    where_to = _found(files, r"""(?:href|to|path)[=:]\s*[{]?["'`](/[\w/-]*)["'`]""", 1, "target").distinct()
    token = _found(files, r"""(?:can|require|has|check)(?:Permission|Role|Access)?\(\s*["'`]([\w:.-]+)["'`]""", 1, "permission").distinct()
    g = where_to.join(token, "file").groupBy("target").agg(F.countDistinct("file").alias("files"), F.countDistinct("permission").alias("permissions"))
    return g.where("files >= 3 AND permissions >= 2").withColumn("severity", F.lit("medium"))


# Assets (file, content binary) and settings.


def oversized(assets: DataFrame, size: Column, kb: tuple[int, int, int] = (200, 500, 1000)) -> DataFrame:
    """Rows of at least kb[0] kilobytes, with a severity by the three steps."""
    d = assets.withColumn("kb", size / 1000)
    return d.where(F.col("kb") >= kb[0]).withColumn("severity", F.when(F.col("kb") >= kb[2], "high").when(F.col("kb") >= kb[1], "medium").otherwise("low"))


def oversized_raster(assets: DataFrame, kb: tuple[int, int, int] = (200, 500, 1000)) -> DataFrame:
    d = assets.where(F.lower("file").rlike(r"\.(?:png|jpe?g|gif|webp|bmp|tiff?|avif)$"))
    return oversized(d, F.octet_length("content"), kb).select("file", "kb", "severity")


def raster_size(content: Column) -> Column:
    """struct(width, height) from the header of a PNG, GIF or BMP; null for other bytes."""
    number = lambda at, n, little: F.conv(F.concat(*[F.hex(F.substring(content, at + (n - 1 - k if little else k), 1)) for k in range(n)]), 16, 10).cast("long")
    size = lambda w, h, n, little: F.struct(number(w, n, little).alias("width"), number(h, n, little).alias("height"))
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", size(17, 21, 4, False)).when(head.startswith("474946383"), size(7, 9, 2, True)).when(head.startswith("424D"), size(19, 23, 4, True))


def raster_should_be_vector(assets: DataFrame, most: int = 64) -> DataFrame:
    """Rasters of at most `most` pixels either way."""
    d = assets.select("file", raster_size(F.col("content")).alias("s")).select("file", "s.width", "s.height")
    return d.where(f"width BETWEEN 1 AND {most} AND height BETWEEN 1 AND {most}").withColumn("severity", F.lit("low"))


def svg_with_embedded_raster(files: DataFrame) -> DataFrame:
    return _counted(files.where(F.lower("file").endswith(".svg")), r"data:image/(?:png|jpe?g|gif|webp);base64", _by(high=2, low="medium"))


def missing_agent_context(files: DataFrame) -> DataFrame:
    """One row if a manifest declares commands and no document for agents exists."""
    bins = F.count_if(F.col("file").rlike(r"(?:^|/)package\.json$") & F.get_json_object("text", "$.bin").isNotNull())
    docs = F.count_if(F.col("file").rlike(r"(?i)(?:^|/)(?:agents|claude|gemini)\.md$|(?:^|/)\.cursorrules$|copilot-instructions\.md$"))
    return files.agg(bins.alias("manifests"), docs.alias("documents")).where("manifests > 0 AND documents = 0").withColumn("severity", F.lit("medium"))


def agent_permission_sprawl(files: DataFrame) -> DataFrame:
    """Broad rules and dangerous hooks of agent settings (JSON)."""
    allow = F.from_json(F.get_json_object("text", "$.permissions.allow"), "array<string>")
    broad = F.filter(F.coalesce(allow, F.array().cast("array<string>")), lambda r: r.rlike(r"^(?:\*|(?:Bash|Write|Edit|WebFetch)(?:\((?:\*|:\*)?\))?|Bash\((?:sudo|rm|curl|sh|bash)\b.*\))$"))
    hooks = F.regexp_count(F.coalesce(F.get_json_object("text", "$.hooks"), F.lit("")), F.lit(r"curl[^\"]*\|\s*(?:ba)?sh|rm -rf|sudo "))
    d = files.where(F.col("file").endswith(".json")).select("file", F.size(broad).alias("broad"), hooks.alias("hooks"))
    return d.where("broad > 0 OR hooks > 0").withColumn("severity", F.lit("low")).withColumn("confidence", F.lit(0.39))
