"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of an identifier or path: cut at non-alphanumerics, camel humps, acronyms and digits."""
    humps = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda t: t != ""))


def singular(c: Column) -> Column:
    return F.when(c.rlike("(ss|us|is)$"), c).when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y")).when(c.rlike("(xes|ches|shes|sses)$"), F.regexp_replace(c, "es$", "")).otherwise(F.regexp_replace(c, "s$", ""))


def route_key(c: Column) -> Column:
    """A route with its parameters as {}, without outer slashes, in lower case."""
    p = F.regexp_replace(c, r"\$?\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*", "{}")
    return F.lower(F.regexp_replace(p, "^/+|/+$", ""))


def overlap(a: Column, b: Column) -> Column:
    """Common elements as a share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def redacted(c: Column) -> Column:
    """Values of secret-like assignments, flags, credentials, provider tokens and long opaque runs masked."""
    masks = [
        (r"\b([A-Z][A-Z0-9_]{2,}(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL|AUTH)[A-Z0-9_]*)\s*=\s*\S+", "$1=***"),
        (r"(?i)(--?(?:token|key|secret|password|auth|api[-_]?key)[= ])\S+", "$1***"),
        (r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)\"?[^\s\"]+\"?", "$1$2***"),
        (r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 ***"),
        (r"\b(?:sk|pk|ghp|gho|ghs|ghu|ghr|xox[abposr])[-_][A-Za-z0-9_-]{8,}", "***"),
        (r"\b[A-Za-z0-9+/]{40,}={0,2}", "***"),
    ]
    for pattern, mask in masks:
        c = F.regexp_replace(c, pattern, mask)
    return c


def package_of(specifier: Column) -> Column:
    """The package of an import specifier: @scope/name or name; null for relative ones."""
    return F.when(specifier.rlike(r"^[./]"), None).when(specifier.startswith("@"), F.regexp_extract(specifier, "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(specifier, "^([^/]+)", 1))


def discriminator(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def concept_key(c: Column) -> Column:
    """The concept that a type's name stands for: words without those that only say what kind of type it is, the last one singular."""
    words = F.filter(tokens(c), lambda t: ~t.isin("dto", "model", "entity", "schema", "type", "interface", "record", "data", "props", "i"))
    last = F.element_at(words, -1)
    return F.when(F.size(words) > 0, F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(singular(last))), "_"))


def critical_reason(c: Column) -> Column:
    """Why a field is critical, the first of: identifier, tenancy, permission, status, money, timestamp; null if it is not."""
    words = tokens(c)
    last, has = F.element_at(words, -1), lambda s: F.arrays_overlap(words, F.array(*[F.lit(w) for w in s.split()]))
    return (
        F.when(F.size(words) == 0, None).when(last.isin("id", "uuid", "guid", "ref"), "identifier field")
        .when(has("tenant workspace organization organisation org account namespace"), "tenancy field")
        .when(has("role roles permission permissions scope scopes acl grant grants privilege privileges"), "permission field")
        .when(has("status state phase"), "status field")
        .when(has("amount price cost total subtotal balance currency cents tax fee discount refund charge"), "money field")
        .when(last.isin("at", "on", "timestamp", "date"), "timestamp field")
    )


# Words of calls that change something.
MUTATING = "create insert update upsert delete destroy remove save write put post patch publish emit enqueue queue dispatch send submit charge capture refund transfer pay commit apply provision deploy register revoke grant increment decrement mutate execute exec run"


def mutating(c: Column) -> Column:
    """Whether a called name says that it changes something."""
    return F.arrays_overlap(tokens(c), F.array(*[F.lit(w) for w in MUTATING.split()]))
