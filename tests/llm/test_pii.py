"""Base spans against plain regular expressions; the label model; redaction."""

import hashlib
import random
import re

import numpy as np
from oracle import compare, connect
from stratalens.llm import pii
from stratalens.llm.common import table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "x.y@z-1.com", "@", ".", "_x", "1.2.3.4", "255.256.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (415) 555-2671", "+49.30.1234567", " ", " ", "-", "  ", "é😀", "\n", "12", "+", "(", ")", "call ", "Mr Smith ", "123-45-6789"]
    fixed = [None, "", "a@b.c@d.e", "a@b.c._x@d.e", "1.2.3.4.5.6.7.8", "x" * 60_000, "1" * 40_000, "1 " * 20_000, "+1" + " " * 20_000, "a.b" * 9_000 + "@c.de", "😀 me@x.org", "same 1.2.3.4", "same 1.2.3.4", "phone: (415) 555-2671 and SSN 123-45-6789, Dear Mr James Brown"]
    return fixed + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(400)]


def test_base_spans(spark):
    all_texts = texts()
    df = spark.createDataFrame([*enumerate(all_texts), (None, "1.2.3.4")], "doc_id long, text string").selectExpr("*", "'z' AS spans", "1 AS kind", "2 AS base", "3 AS row", "4 AS whole", "5 AS more")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(all_texts) + 1
    for i, text in enumerate(all_texts):
        want = plain(text)
        listed = ",".join(":".join(map(str, s)) for s in want)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (text[:90], want, r.spans[:200])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN]
        assert {":".join(map(str, s)) for s in want} <= set(r.spans.split(",")) | {""}


def test_base_spans_against_sql(spark):
    compare(spark, connect("/root/testdata/sf0.01"), "pii_base", lambda s, d: pii.base_report(table(s, d, "documents")), pii.oracle(), "/root/testdata/sf0.01")


def test_posteriors():
    rng = random.Random(1)
    counts, true_by = {}, {}
    rates = [((0.9, 0.05), (0.1, 0.7)), ((0.6, 0.4), (0.2, 0.8)), ((0.5, 0.45), (0.05, 0.45)), ((0.9, 0.05), (0.5, 0.1))]
    for _ in range(6000):
        true = rng.random() < 0.3
        votes = []
        for t, o in rates:
            yes, none = t if true else o
            x = rng.random()
            votes.append(1 if x < yes else 0 if x < yes + none else -1)
        v = tuple(votes)
        counts[v] = counts.get(v, 0) + 1
        true_by[v] = true_by.get(v, 0) + true
    chance, found = pii.posteriors(counts)
    assert abs(sum(chance[v] * c for v, c in counts.items()) / 6000 - 0.3) < 0.06
    assert abs(found["pattern"][0][0] - 0.9) < 0.08 and abs(found["context"][1][2] - 0.5) < 0.08
    wrong = sum(abs(true_by[v] - chance[v] * c) for v, c in counts.items())
    assert wrong / 6000 < 0.08


def test_final_classifier_follows_features():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 3)).astype(float)
    p = 1 / (1 + np.exp(-(-1 + 2 * x[:, 0] - 3 * x[:, 2])))
    assert np.allclose(pii.logistic(x, p, np.ones(2000), ridge=1e-6), [-1, 2, 0, -3], atol=1e-2)
    assert pii.fit([]) == {}


PLANTS = {
    "phone_local": lambda i: f"call (415) 555-{2000 + i}",
    "national_id": lambda i: f"SSN 123-45-{6001 + i}",
    "iban": lambda i: ["account GB82 WEST 1234 5698 7654 32", "IBAN DE89370400440532013000", "konto FR1420041010050500013M02606"][i % 3],
    "person": lambda i: ["Dear Dr. Maria Stone", "signed Mr Paul Brown", "Mrs Anna Lee"][i % 3],
    "address": lambda i: f"lives at {12 + i} Maple Hill Road",
    "key": lambda i: f"AKIA{'QWERTYUIOPASDF'}{i:02d}",
    "secret": lambda i: [f"password=f93ab{i:02d}c55", f'token = "a1b2c3d4e5{i:02d}"', f"api_key: zz9Zz8{i:02d}yy"][i % 3],
    "opaque": lambda i: f"auth {hashlib.md5(str(i).encode()).hexdigest()}",
}
#: What looks like the kind and is something else.
OTHERS = ["isbn 0123 456-7890", "part no 900-00-0000", "serial AB12 CD34 EF56 GH78", "the Dr house", "version 0", "enter the new token: whatever", f"commit {hashlib.sha1(b'x').hexdigest()}", "42 is the answer", "in 1999 - 2001"]


def test_planted_kinds(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    rows, wanted = [], {}
    for i in range(60):
        for kind, make in PLANTS.items():
            head, tail = (" ".join(word() for _ in range(rng.randrange(20))) for _ in range(2))
            wanted[len(rows)] = kind
            rows.append((len(rows), f"{head} {make(i)} {tail}"))
    clean = range(len(rows), len(rows) + 300)
    rows += [(i, " ".join([word(), OTHERS[i % len(OTHERS)], word(), word()])) for i in clean]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in PLANTS:
        own = [i for i, k in wanted.items() if k == kind]
        assert sum(f"{kind}:" in got[i].spans for i in own) / len(own) >= 0.9, kind
    assert sum(got[i].n_spans > 0 for i in clean) / len(clean) < 0.25
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())


def test_added_spans_and_redaction(spark):
    rows = [(i, f"phone: (415) 555-{2000 + i} or mail a{i}@b.org. x 123-45-67{i % 90 + 10} Dear Dr. Maria Stone") for i in range(80)] + [(900, None), (901, "nothing"), (902, "9.9.9.9"), (903, "é😀 4111 1111 1111 1111@b.org 😀"), (904, "😀" * 9 + " 1.2.3.4 " + "é" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS _text", "1 AS _all", "2 AS row", "3 AS spans", "4 AS base", "7 AS extra")
    assert sum("phone_local" in r.spans for r in pii.report(df).collect()) == 80
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].text.startswith("phone: [PHONE_LOCAL] or mail [EMAIL] x ") or got[3].text.startswith("phone: [PHONE_LOCAL] or mail [EMAIL]. x ")
    assert got[900].text is None and got[901].text == "nothing" and got[902].text == "[IP]" and got[902].extra == 7 and got[902].row == 2
    # a card and an email that share digits go together
    assert got[903].text == "é😀 [CARD] 😀"
    assert got[904].text == "😀" * 9 + " [IP] " + "é" * 20_000


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).count() == 0 and pii.redact(none).columns == none.columns
