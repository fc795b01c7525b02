"""Personal data and secrets by weak supervision, in DataFrame and SQL functions only.

The base patterns (email, ip, card, phone) and their checks give spans that always stay. Broader
patterns give candidates: phone numbers without a country code, national numbers, IBANs, titled
names, street addresses, provider keys, assigned passwords and tokens, opaque hexadecimal
strings. Four labelers vote on each candidate, yes, no or not at all:

* pattern: a strict check of the kind (check digits, lengths, ranges) holds or fails;
* gazetteer: a part of the span is a known word (given names, street types, dialling codes,
  country codes, key prefixes); never no;
* context: the words before the span name its kind (yes) or something else (no);
* shape: length and mix of characters are usual for the kind or not.

Expectation-maximisation over the counts of vote patterns (81 a kind, whatever the table's size)
estimates how often each labeler votes what on true and on other spans, and so a posterior for
every pattern. The final span classifier is a logistic regression per kind on features of span
and context (FEATURES), fitted on the counts of their combinations with the posteriors as soft
labels; it decides on spans of any votes. It becomes a SQL expression.

Null text: empty. Offsets are code points, end exclusive. Texts of any length are matched whole;
patterns use possessive groups or bounded ones and start only where a match can begin, so they
neither recurse nor retry. Rows repeat as they do in the input; an empty table gives an empty
result. Columns of the input may have any names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A match begins at the first character of a run, or where the last match ended: the leftmost one, found without retries.
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq|Terrace|Way"
#: Broader candidates that only the classifier can turn into spans.
BROAD = {
    "phone_local": r"(?<![+\w.-])(?:\([0-9]{2,4}\)[ ]?|0)[0-9]{2,4}[ -][0-9]{3,4}(?:[ -]?[0-9]{2,4})?(?![\w-])",
    "national_id": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?!\w)",
    "address": rf"(?<![\w.,-])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:{_STREET})(?!\w)",
    "key": r"(?<![A-Za-z0-9])(?:A[KGIRS][IPDO]A[0-9A-Z]{12,40}|gh[opsu]_[A-Za-z0-9]{20,80}|github_pat_[A-Za-z0-9_]{20,100}|glpat-[A-Za-z0-9_-]{16,60}|xox[abprs]-[A-Za-z0-9-]{10,80}|[rs]k_(?:live|test)_[A-Za-z0-9]{10,80}|AIza[A-Za-z0-9_-]{30,50})(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|bearer)[\"']?[ ]?[=:][ ]?[\"']?[^\s\"'<>,;]{6,200}",
    "opaque": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9])",
}
KINDS = [*BASE, *BROAD]

# Common given names.
_NAMES = "Adam Alan Albert Alex Alice Amanda Amy Ana Andrea Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben Benjamin Brian Carl Carlos Carmen Caroline Catherine Charles Charlotte Chris Christian Christine Claire Claudia Daniel David Deborah Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francis Frank George Gerald Grace Greg Hans Harold Heather Helen Henry Ines Isabel Jack Jacob James Jane Janet Jason Javier Jean Jeffrey Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Juan Julia Julie Karen Karl Kate Keith Kenneth Kevin Klaus Larry Laura Lauren Linda Lisa Louis Louise Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mario Mark Marta Martin Mary Matthew Megan Michael Michelle Miguel Monica Nancy Nicholas Nicole Nina Olga Oliver Oscar Pablo Pamela Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Ralph Raymond Rebecca Richard Robert Roger Ronald Rosa Roy Ruth Samuel Sandra Sara Sarah Scott Sharon Simon Sofia Sophie Stefan Stephen Steven Susan Teresa Thomas Timothy Victor Victoria Vincent Walter Wayne William Wolfgang Zoe"
# Countries of the IBAN registry that most accounts are in.
_IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR|UA"
GAZETTEER = {
    "phone_local": r"^(?:\([2-9]|0[1-9])",
    "national_id": None,
    "iban": rf"^(?:{_IBAN_COUNTRIES})",
    "person": rf"(?<!\w)(?:{'|'.join(_NAMES.split())})(?!\w)",
    "address": rf"(?:{_STREET})$",
    "key": r"^(?:AKIA|ASIA|AGPA|AIDA|AROA|gh[opsu]_|github_pat_|glpat-|xox|[rs]k_live|AIza)",
    "secret": r"(?i)^(?:password|token|secret|api)",
    "opaque": None,
}
#: (words before a span that name its kind, words that name something else).
CONTEXT = {
    "phone_local": (r"(?i)(?:phone|tel|call|mobile|cell|fax|number)\W*$", r"(?i)(?:isbn|version|page|order|invoice|ref)\W*$"),
    "national_id": (r"(?i)(?:ssn|social security|national id|insurance|tax id)(?: (?:no|number))?\W*$", r"(?i)(?:part|order|model|ref|isbn)(?: (?:no|number))?\W*$"),
    "iban": (r"(?i)(?:iban|account|konto|bank)\W*$", r"(?i)(?:serial|model|part)\W*$"),
    "person": (r"(?i)(?:dear|signed|regards|by|name|contact|from|to)\W*$", None),
    "address": (r"(?i)(?:at|address|lives|live|located|office)\W*$", None),
    "key": (r"(?i)(?:key|id|access|aws|secret|token|credential)\W*$", None),
    "secret": (None, r"(?i)(?:your|a|the|enter|new)\W*$"),
    "opaque": (r"(?i)(?:key|token|secret|password|auth|api|bearer)\W*$", r"(?i)(?:sha\d*|md5|commit|hash|checksum|digest|revision|uuid)\W*$"),
}
_USUAL = {"phone_local": (9, 16), "national_id": (11, 11), "iban": (15, 42), "person": (6, 40), "address": (8, 60), "key": (16, 100), "secret": (12, 200), "opaque": (32, 64)}
#: Characters before a span that the context labeler sees.
BEFORE = 24
LABELERS = ["pattern", "gazetteer", "context", "shape"]
#: What the final classifier sees of a span: is or has (0 or 1), or a small whole number.
FEATURES = ["known", "named", "misnamed", "usual", "digits", "upper", "lower", "marks", "assigned", "quoted", "opens"]
THRESHOLD = 0.5
_SPAN = "array<struct<start:int,end:int,word:string,before:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(chars, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _mod97(word: Column) -> Column:
    """Whether an IBAN's check digits are right: its letters as 10 to 35, country and check digits last, leave 1."""
    plain = F.regexp_replace(word, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)) == 1


def _valid(kind: str, s: Column) -> Column:
    """The check of a base kind."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _strict(kind: str, s: Column) -> Column:
    """The strict check of a broad kind."""
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return {
        "phone_local": digits.between(9, 12),
        "national_id": s.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
        "iban": _mod97(s),
        "person": s.rlike(r" [A-Z][a-z]+ [A-Z]|(?i:dr|prof)"),
        "address": s.rlike(r"^[1-9]"),
        "key": s.rlike(r"^(?:A[KGIRS][IPDO]A[0-9A-Z]{16}$|[a-z]|AIza)"),
        "secret": s.rlike(r"[=:].*[0-9]") & s.rlike(r"[=:].*[A-Za-z]"),
        "opaque": F.length(s).isin(32, 40, 64) & s.rlike("[0-9]") & s.rlike("[A-Fa-f]"),
    }[kind]


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, word, before): the pattern's matches with their offsets, by the lengths of what lies between."""
    words, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(words)).alias("gap"), words.alias("word"))
    none = F.array().cast(_SPAN)

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["word"])
        found = F.struct(start.alias("start"), end.alias("end"), p["word"].alias("word"), F.right(p["gap"], F.lit(BEFORE)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    folded = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a["found"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _base(text: Column) -> Column:
    """Array of (kind, start, end) of the base spans, by kind as in BASE, then start."""

    def of(kind: str, pattern: str) -> Column:
        good = F.filter(_matches(text, pattern), lambda m: _valid(kind, m["word"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[of(k, p) for k, p in BASE.items()])


def _judged(kind: str, m: Column) -> Column:
    """A candidate with its votes (1, 0 or -1) and features."""
    word, before, (low, high), (names, other) = m["word"], m["before"], _USUAL[kind], CONTEXT[kind]
    yes = lambda c: F.when(c, 1).otherwise(0)
    named = before.rlike(names) if names else F.lit(False)
    wrong = before.rlike(other) if other else F.lit(False)
    known = word.rlike(GAZETTEER[kind]) if GAZETTEER[kind] else F.lit(False)
    usual = F.length(word).between(low, high)
    votes = [F.when(_strict(kind, word), 1).otherwise(-1), yes(known), F.when(named, 1).when(wrong, -1).otherwise(0), F.when(usual, 1).otherwise(-1)]
    digits = F.floor(4 * F.length(F.regexp_replace(word, "[^0-9]", "")) / F.length(word)).cast("int")
    seen = [yes(known), yes(named), yes(wrong), yes(usual), digits, yes(word.rlike("[A-Z]")), yes(word.rlike("[a-z]")), yes(word.rlike(r"[^A-Za-z0-9 ]")), yes(before.rlike(r"[=:]\W*$")), yes(before.rlike("[\"']$")), yes(before == "")]
    fields = [F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")]
    return F.struct(*fields, *[v.cast("int").alias(k) for k, v in zip(LABELERS, votes, strict=True)], *[v.alias(k) for k, v in zip(FEATURES, seen, strict=True)])


def _candidates(text: Column) -> Column:
    of = lambda kind: lambda m: _judged(kind, m)
    return F.concat(*[F.transform(_matches(text, p), of(k)) for k, p in BROAD.items()])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row: the columns of `docs`, base: its base spans, more: the candidates with votes and features)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = docs.select(F.struct(*docs.columns).alias("row"), whole.alias("whole"))
    return held.select("row", _base(F.col("whole")).alias("base"), _candidates(F.col("whole")).alias("more"))


# How often a labeler votes yes, not at all, no: on true spans and on others, before anything is seen.
_TRUE, _OTHER = (0.75, 0.2, 0.05), (0.2, 0.4, 0.4)
#: What these beliefs weigh, in spans.
WEIGHT = 8.0


def posteriors(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], dict[str, list]]:
    """(chance of a true span by vote pattern, (rates on true spans, rates on others) by labeler) by expectation-maximisation."""
    total, prior = sum(counts.values()), 0.5
    rates = {k: [list(_TRUE), list(_OTHER)] for k in LABELERS}
    chance: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in counts:
            z = math.log(prior / (1 - prior))
            for name, v in zip(LABELERS, votes, strict=True):
                z += math.log(rates[name][0][1 - v] / rates[name][1][1 - v])
            chance[votes] = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        mass = sum(chance[v] * c for v, c in counts.items())
        # one prior count on either side keeps rates off 0 and 1
        prior = (mass + 1) / (total + 2)
        for j, name in enumerate(LABELERS):
            for side, start in ((0, _TRUE), (1, _OTHER)):
                seen = [0.0, 0.0, 0.0]
                for v, c in counts.items():
                    seen[1 - v[j]] += c * (chance[v] if side == 0 else 1 - chance[v])
                rates[name][side] = [(s + WEIGHT * b) / (sum(seen) + WEIGHT) for s, b in zip(seen, start, strict=True)]
    return chance, rates


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Coefficients (constant first) of soft labels y by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b, own = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    own[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x.T * (weight * (p * (1 - p) + 1e-9))) @ x + own, x.T @ (weight * (y - p)) - own @ b)
    return b


def fit(counted: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> dict[str, list[float]]:
    """The classifier's coefficients by kind, from (kind, votes, features, how many)."""
    out = {}
    for kind in BROAD:
        own = [(v, f, c) for k, v, f, c in counted if k == kind]
        if not own:
            continue
        counts: dict[tuple[int, ...], int] = {}
        for v, _, c in own:
            counts[v] = counts.get(v, 0) + c
        chance, _ = posteriors(counts)
        x, y, w = np.array([f for _, f, _ in own], float), np.array([chance[v] for v, _, _ in own]), np.array([c for *_, c in own], float)
        # a large table decides by itself; the ridge then counts for little
        out[kind] = logistic(x, y, w).tolist()
    return out


def train(rows: DataFrame) -> dict[str, list[float]]:
    """The classifier of candidates(): only counts of combinations reach the driver, whose number is bounded by the features, not by the table."""
    each = rows.select(F.explode("more").alias("s"))
    names = ["kind", *LABELERS, *FEATURES]
    counted = each.groupBy(*[F.col(f"s.{k}").alias(k) for k in names]).count().collect()
    return fit([(r.kind, tuple(r[k] for k in LABELERS), tuple(r[k] for k in FEATURES), r["count"]) for r in counted])


def probability(model: dict[str, list[float]], s: Column) -> Column:
    """The classifier as an expression over a candidate."""
    out = F.lit(0.0)
    for kind, b in model.items():
        z = sum((F.lit(w) * s[k] for k, w in zip(FEATURES, b[1:], strict=True)), F.lit(b[0]))
        out = F.when(s["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def detect(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(row, base, spans): the columns `keep` of `docs` (None: all), the base spans, and all spans, by kind as in KINDS, then start.

    The candidates are written once in the shared folder, for the classifier to be trained on
    and applied to. An added span overlaps no base one; added ones of several kinds may overlap.
    """
    found = candidates(docs, text)
    if keep is not None:
        found = found.select(F.struct(*[F.col(f"row.{c}") for c in keep]).alias("row"), "base", "more")
    rows = stored(found, "spans")
    model = train(rows)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    good = F.filter("more", lambda s: (probability(model, s) >= threshold) & free(s))
    slim = F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("row", "base", F.concat("base", slim).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base_columns() -> list[Column]:
    of = lambda kind: lambda s: s["kind"] == kind
    return [*[F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256")]


def base_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"))
    return whole.select("doc_id", _base(F.col("whole")).alias("base")).select("doc_id", *_base_columns())


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans, n_spans (all of them), n_secrets (keys, assigned and opaque ones)."""
    secret = lambda s: s["kind"].isin("key", "secret", "opaque")
    more = [listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", secret)).cast("long").alias("n_secrets")]
    d = detect(docs.select("doc_id", "text"), keep=["doc_id"])
    return d.select("row.doc_id", *_base_columns(), *more)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by [KIND]; null texts stay null. Spans that overlap go together, under the kind that begins first (the longer of two)."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    chars = F.split(F.col(f"row.{text}"), "")

    def step(acc, s):
        gap = F.array_join(F.slice(acc["chars"], acc["at"] + 1, s["start"] - acc["at"]), "")
        piece = F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        into = lambda at, out: F.struct(acc["chars"].alias("chars"), at.alias("at"), out.alias("out"))
        inside = into(F.greatest(acc["at"], -s["last"]), acc["out"])
        return F.when(s["start"] < acc["at"], inside).otherwise(into(-s["last"], F.concat(acc["out"], F.array(piece))))

    end = lambda a: F.concat(F.array_join(a["out"], ""), F.array_join(F.slice(a["chars"], a["at"] + 1, F.size(a["chars"])), ""))
    none = F.struct(chars.alias("chars"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.when(F.size("spans") > 0, F.aggregate(order, none, step, end)).otherwise(F.col(f"row.{text}"))
    return detect(docs, text).select(*[done.alias(c) if c == text else F.col(f"row.{c}") for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for base_report() over documents, with the patterns as they are written in the contract."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rows = " UNION ALL ".join(f"SELECT doc_id, n, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}') AS ws, regexp_split_to_array(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')" for i, (k, p) in enumerate(patterns.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
m AS ({rows}),
u AS (SELECT n, rank, kind, unnest(ws) AS w, unnest(gs[:len(ws)]) AS g, unnest(range(1, len(ws) + 1)) AS i FROM m),
p AS (SELECT n, rank, kind, w, sum(length(g) + length(w)) OVER (PARTITION BY n, kind ORDER BY i) - length(w) AS s, regexp_replace(w, '[^0-9]', '', 'g') AS ds FROM u),
ok AS (SELECT n, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + length(w) AS BIGINT) AS e FROM p WHERE kind = 'email'
 OR kind = 'ip' AND len(list_filter(string_split(w, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right('000' || ltrim(x, '0'), 3) AS INT) > 255)) = 0
 OR kind = 'phone' AND length(ds) BETWEEN 9 AND 15
 OR kind = 'card' AND length(ds) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda j: CASE WHEN (length(ds) - j) % 2 = 0 THEN CAST(ds[j] AS INT) WHEN CAST(ds[j] AS INT) > 4 THEN 2 * CAST(ds[j] AS INT) - 9 ELSE 2 * CAST(ds[j] AS INT) END)) % 10 = 0),
g AS (SELECT n, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS l FROM ok GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN g USING (n)"""
