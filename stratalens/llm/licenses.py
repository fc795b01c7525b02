"""License scan: sparse TF-IDF cosine of headers and license files to templates, then inheritance along directories. DataFrame functions only.

A header is a run of 1 to WRAP nonblank lines: license notices wrap. Every run's term vector is
compared with the notices in HEADERS by cosine, weights being tf * idf. idf counts the templates that
hold a term, so terms outside the templates weigh what a term of one template does, and a run's
own length lowers its cosine; words of PROSE weigh nothing. A run of several lines counts only where none of its lines counts
alone. A file named like a license file (LICENSE, COPYING, NOTICE) is compared as a whole with the
license texts in TEXTS, too. The best match at `threshold` or above names the file's license.

A run is left out before its cosine only if it cannot reach the threshold: by Cauchy-Schwarz a
cosine is at most the length of the template's unit vector on the run's terms. Texts without a
telling term (see `telling`) are passed over by that, then runs whose terms are too light. Vectors
live within the row: nothing is exploded or shuffled, since the templates are constants here.

Files named like license files, or whose lines are mostly license notices, license their
directory. Files without a license of their own inherit that of the nearest ancestor directory
that has one: every directory is joined with its own ancestors, by path, and the deepest match is
taken. Conflicting license files of a directory: the highest cosine, then the greater name.

Null text: empty. Null path: the directory "". Long texts are read whole; time grows with their
words, also within a line. Rows that repeat are scanned each by itself. An empty table gives an
empty result. Columns of the input named like one of the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

THRESHOLD, WRAP = 0.6, 3
#: A file licenses its directory if this share of its lines is license text.
MOSTLY = 0.5
# Words that prose is full of.
PROSE = set("a all an and any are as at be but by can do for from has have if in is it its may no not of on or other so such that the this to under use was which will with you".split())

# The notices that files carry for their license, in lower case without marks.
HEADERS = {
    "Apache-2.0": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "Apache-2.0 (short)": "licensed under the apache license version 2 0",
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "MIT (short)": "released under the mit license",
    "GPL-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
    "GPL-3.0 (short)": "this work is licensed under the gnu general public license version 3",
    "GPL-2.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2",
    "LGPL-2.1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1",
    "AGPL-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license version 3",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-3-Clause (short)": "use of this source code is governed by a bsd style license",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "EPL-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "BSL-1.0": "distributed under the boost software license version 1 0",
    "Zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "CC0-1.0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "CC-BY-NC-4.0": "licensed under cc by nc 4 0",
    "CC-BY-SA-4.0": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CC-BY-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "Proprietary": "all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
}

_PERMIT_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_AS_IS_BSD = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_NO_ENDORSEMENT = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_IS_ISC = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
# The texts of whole license files, the long ones by title, preamble and first grant.
TEXTS = {
    "MIT": "mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSD-2-Clause": f"bsd 2 clause license {_PERMIT_BSD} {_AS_IS_BSD}",
    "BSD-3-Clause": f"bsd 3 clause license {_PERMIT_BSD} {_NO_ENDORSEMENT} {_AS_IS_BSD}",
    "ISC": f"isc license permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_AS_IS_ISC}",
    "0BSD": f"bsd zero clause license permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_AS_IS_ISC}",
    "Zlib": "zlib license this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    "Unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "BSL-1.0": "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    "WTFPL": "do what the fuck you want to public license version 2 everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed terms and conditions for copying distribution and modification you just do what the fuck you want to",
    "Apache-2.0": "apache license version 2 0 january 2004 terms and conditions for use reproduction and distribution definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "GPL-2.0": "gnu general public license version 2 june 1991 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    "GPL-3.0": "gnu general public license version 3 29 june 2007 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users",
    "LGPL-3.0": "gnu lesser general public license version 3 29 june 2007 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "AGPL-3.0": "gnu affero general public license version 3 19 november 2007 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "MPL-2.0": "mozilla public license version 2 0 definitions contributor means each individual or legal entity that creates contributes to the creation of or owns covered software contributor version means the combination of the contributions of others if any used by a contributor and that particular contributor s contribution covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form of such source code form and modifications of such source code form",
    "EPL-2.0": "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement definitions contribution means in the case of the initial contributor the initial content distributed under this agreement",
    "CC0-1.0": "creative commons legal code cc0 1 0 universal creative commons corporation is not a law firm and does not provide legal services distribution of this document does not create an attorney client relationship statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights upon the creator and subsequent owners of an original work of authorship",
    "CC-BY-4.0": "creative commons attribution 4 0 international public license by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license to the extent this public license may be interpreted as a contract you are granted the licensed rights in consideration of your acceptance of these terms and conditions",
    "CC-BY-SA-4.0": "creative commons attribution sharealike 4 0 international public license by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license",
    "CC-BY-NC-4.0": "creative commons attribution noncommercial 4 0 international public license by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license",
}
_LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)(?:[.-][\w.-]*)?$"


def vectors(headers: dict[str, str] = HEADERS, texts: dict[str, str] = TEXTS) -> tuple[dict[str, dict[str, float]], dict[str, dict[str, float]], dict[str, float], float]:
    """(unit vectors by header, by license text, idf by term, idf of any other term)."""
    sides = [{k: Counter(t for t in re.findall(r"[a-z0-9]+", v) if t not in PROSE) for k, v in side.items()} for side in (headers, texts)]
    n = sum(map(len, sides))
    df = Counter(t for side in sides for c in side.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + m)) + 1 for t, m in df.items()}
    out = []
    for side in sides:
        units = {}
        for k, c in side.items():
            own = {t: m * idf[t] for t, m in c.items()}
            size = math.sqrt(sum(x * x for x in own.values()))
            units[k] = {t: x / size for t, x in own.items()}
        out.append(units)
    return out[0], out[1], idf, math.log((1 + n) / 2) + 1


def telling(units: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms without any of which no text can reach the threshold with any template, whatever its counts: all but numbers that are light enough."""
    terms = {t for u in units.values() for t in u}
    light = {t for t in terms if t.isdigit()}
    for u in units.values():
        while (own := {t: w * w for t, w in u.items() if t in light}) and sum(own.values()) >= max(threshold, 0.0) ** 2 - 1e-9:
            light.remove(max(own, key=lambda t: (own[t], t)))
    return sorted(terms - light)


def _has_any(text: Column, chosen: list[Column]) -> Column:
    """Whether a lower-case text holds one of the terms."""
    return F.exists(F.split(text, "[^a-z0-9]+"), lambda w: w.isin(*chosen))


def _map(values: dict[str, str]) -> Column:
    """A constant map from terms to SQL literals, parsed in one go."""
    return F.expr("map(" + ", ".join(f"'{t}', {v}" for t, v in sorted(values.items())) + ")")


def _may_reach(text: Column, units: dict[str, dict[str, float]], threshold: float) -> Column:
    """False only if no cosine can reach the threshold: each term counted by its greatest share of any template's squared length."""
    most = {t: max(u.get(t, 0.0) ** 2 for u in units.values()) for u in units.values() for t in u}
    weights = _map({t: repr(w) + "D" for t, w in most.items()})
    known = F.filter(F.array_distinct(F.split(text, "[^a-z0-9]+")), lambda w: w.isin(*sorted(most)))
    return F.aggregate(known, F.lit(0.0), lambda acc, t: acc + weights[t]) >= max(threshold, 0.0) ** 2 - 1e-9


def _nearest(units: dict[str, dict[str, float]], idf: dict[str, float], other: float):
    """A function from a lower-case text to struct(cosine, license) of its nearest template; the greater name of equal ones."""
    names = list(units)
    literals = lambda ws: [F.lit(w) for w in sorted(ws)]
    terms, every, prose = literals({t for u in units.values() for t in u}), literals(idf), literals([*PROSE, ""])
    rows = _map({t: "array(" + ", ".join(repr(idf[t] * units[n].get(t, 0.0)) + "D" for n in names) + ")" for t in {t for u in units.values() for t in u}})
    weights = _map({t: repr(w**2) + "D" for t, w in idf.items()})
    licenses = F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")")

    def repeats(words: Column, weight) -> Column:
        # the n-th of equal words, side by side when sorted, adds n^2 - (n - 1)^2 times its weight
        def step(acc, w):
            n = F.when(acc["w"] == w, acc["n"] + 1.0).otherwise(F.lit(1.0))
            return F.struct(w.alias("w"), n.alias("n"), (acc["total"] + weight(w) * (2.0 * n - 1.0)).alias("total"))

        none = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))
        return F.aggregate(F.sort_array(words), none, step, lambda acc: acc["total"])

    def of_words(x: Column) -> Column:
        known = F.filter(x["words"], lambda w: w.isin(*every))
        dots = F.aggregate(F.filter(known, lambda w: w.isin(*terms)), F.expr(f"array_repeat(0.0D, {len(names)})"), lambda acc, w: F.zip_with(acc, rows[w], lambda a, b: a + b))
        one = lambda w: F.lit(1.0)
        size = F.sqrt(repeats(known, lambda w: weights[w]) + (repeats(x["words"], one) - repeats(known, one)) * (other * other))
        return F.struct(dots.alias("dots"), size.alias("size"))

    def of_sums(x: Column) -> Column:
        return F.array_max(F.zip_with(x["dots"], licenses, lambda dot, n: F.struct(F.coalesce(F.try_divide(dot, x["size"]), F.lit(0.0)).alias("cosine"), n.alias("license"))))

    def best(text: Column) -> Column:
        words = F.struct(F.filter(F.split(text, "[^a-z0-9]+"), lambda w: ~w.isin(*prose)).alias("words"))
        return F.transform(F.transform(F.array(words), of_words), of_sums)[0]

    return best


def scan(files: DataFrame, text: str = "text", path: str = "path", threshold: float = THRESHOLD, headers: dict[str, str] = HEADERS, texts: dict[str, str] = TEXTS) -> DataFrame:
    """`files` with _own (struct cosine, license; null: none) and _share, the share of nonblank lines within license notices.

    Without a column `path` no file is compared as a whole.
    """
    units, whole, idf, other = vectors(headers, texts)
    chosen, notice = [F.lit(t) for t in telling(units, threshold)], _nearest(units, idf, other)
    any_of = lambda s: _has_any(s, chosen) if threshold > 0 else F.lit(True)
    names = [c for c in files.columns if c not in ("_own", "_share")]
    given = files.select(F.struct(*names).alias("row"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    lines = F.when(any_of(F.col("low")), F.filter(F.split("low", r"\r\n|\n|\r"), lambda x: F.trim(x) != "")).otherwise(F.array().cast("array<string>"))
    given = given.withColumn("lines", lines).withColumn("n", F.size("lines")).withColumn("tells", F.transform("lines", any_of))
    none = F.array().cast("array<struct<at:int,n:int,best:struct<cosine:double,license:string>>>")

    def runs(n: int) -> Column:
        text_of = lambda i: F.array_join(F.slice("lines", i, n), " ")
        at = F.filter(F.sequence(F.lit(1), F.col("n") - (n - 1)), lambda i: F.exists(F.slice("tells", i, n), lambda x: x) & _may_reach(text_of(i), units, threshold))
        scored = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), notice(text_of(i)).alias("best")))
        return F.when(F.col("n") >= n, F.filter(scored, lambda s: s["best"]["cosine"] >= threshold)).otherwise(none)

    d = given.withColumn("alone", runs(1)).withColumn("lone", F.transform("alone", lambda s: s["at"]))
    free = lambda s: ~F.exists("lone", lambda i: i.between(s["at"], s["at"] + s["n"] - 1))
    hits = F.concat("alone", *[F.filter(runs(n), free) for n in range(2, WRAP + 1)])
    d = d.withColumn("hits", hits)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    own = F.array_max(F.transform("hits", lambda s: s["best"]))
    if path in files.columns:
        named = F.coalesce(F.col(f"row.{path}"), F.lit("")).rlike(_LICENSE_FILE)
        full = F.when(named, _nearest(whole, idf, other)(F.col("low")))
        own = F.greatest(own, F.when(full["cosine"] >= threshold, full))
    share = F.when(F.col("n") > 0, F.coalesce(covered, F.lit(0)) / F.col("n")).otherwise(0.0)
    return d.select("row.*", own.alias("_own"), share.alias("_share"))


_RESULT = ("license", "cosine", "origin", "license_dir")


def inherit(files: DataFrame, path: str = "path") -> DataFrame:
    """Scanned files with license, cosine, origin ("own", "directory" or "none") and license_dir (of an inherited one)."""
    folder = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(.*)/[^/]*$", 1), "/+$", "")
    names = [c for c in files.columns if c not in (*_RESULT, "_own", "_share")]
    place = F.coalesce(F.col(path), F.lit(""))
    d = files.select(F.struct(*names).alias("row"), folder(place).alias("dir"), F.col("_own").alias("own"), (place.rlike(_LICENSE_FILE) | (F.col("_share") >= MOSTLY)).alias("gives"))
    roots = d.where(F.col("own").isNotNull() & F.col("gives")).groupBy("dir").agg(F.max("own").alias("given"))
    # every directory once, with its ancestors, itself included
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chain = d.select("dir").distinct().withColumn("anc", F.explode(F.array_distinct(ancestors)))
    near = chain.join(roots.withColumnRenamed("dir", "anc"), "anc").groupBy("dir").agg(F.max_by(F.struct("anc", "given"), F.length("anc")).alias("near"))
    has = F.col("own").isNotNull()
    chosen = F.coalesce(F.col("own"), F.col("near.given"))
    return d.join(near, "dir", "left").select(
        "row.*",
        F.regexp_replace(chosen["license"], r" \(short\)$", "").alias("license"),
        chosen["cosine"].alias("cosine"),
        F.when(has, "own").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(~has, F.col("near.anc")).alias("license_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / block of 4096 ids / block of 64 ids / doc_id.txt (null source: "none")."""
    i = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    step = lambda n: F.floor(i / n).cast("string")
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), step(4096), step(64), F.concat(i.cast("string"), F.lit(".txt"))).alias("path"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, path, license, cosine, origin, license_dir. Texts are scanned once; what was found is written, and inherited by path."""
    return inherit(stored(scan(document_paths(docs)).drop("text"), "scanned")).select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin", "license_dir")


def _values(side: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in side.items())


def oracle() -> str:
    """DuckDB SQL for report() over documents: every run of lines is compared, without any term being looked for first."""
    prose = ", ".join(f"'{w}'" for w in sorted(PROSE))
    return f"""WITH h(name, body) AS (VALUES {_values(HEADERS)}), x(name, body) AS (VALUES {_values(TEXTS)}),
both_sides AS (SELECT 'h' AS side, name, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS t FROM h UNION ALL SELECT 'x', name, unnest(regexp_extract_all(body, '[a-z0-9]+')) FROM x),
tf AS (SELECT side, name, t, count(*) AS n FROM both_sides WHERE t NOT IN ({prose}) GROUP BY ALL),
total AS (SELECT count(DISTINCT (side, name)) AS n FROM tf),
idf AS (SELECT t, ln((1.0 + (SELECT n FROM total)) / (1 + count(*))) + 1 AS w FROM tf GROUP BY t),
weights AS (SELECT name, t, n * w AS v, sqrt(sum((n * w) ^ 2) OVER (PARTITION BY name)) AS size FROM tf JOIN idf USING (t) WHERE side = 'h'),
units AS (SELECT name, t, v / size AS u FROM weights),
files AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), CAST(floor(coalesce(doc_id, -1) / 4096) AS BIGINT), CAST(floor(coalesce(doc_id, -1) / 64) AS BIGINT)) AS dir FROM documents),
lists AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\r\\n|\\n|\\r'), lambda s: trim(s, ' ') <> '') AS ls FROM files),
numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM lists),
counts AS (SELECT doc_id, (SELECT max(m.i) FROM numbered m WHERE m.doc_id = numbered.doc_id) AS n FROM numbered GROUP BY doc_id),
words AS (SELECT doc_id, i, t, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(line, '[a-z0-9]+')) AS t FROM numbered) WHERE t NOT IN ({prose}) GROUP BY ALL),
runs AS (SELECT doc_id, i AS i0, k FROM numbered JOIN counts USING (doc_id), range(1, {WRAP + 1}) r(k) WHERE i + k - 1 <= counts.n),
tokens AS (SELECT r.doc_id, r.i0, r.k, w.t, sum(w.n) AS n FROM runs r JOIN words w ON w.doc_id = r.doc_id AND w.i BETWEEN r.i0 AND r.i0 + r.k - 1 GROUP BY ALL),
sizes AS (SELECT doc_id, i0, k, sqrt(sum((n * coalesce(w, ln((1.0 + (SELECT n FROM total)) / 2) + 1)) ^ 2)) AS size FROM tokens LEFT JOIN idf USING (t) GROUP BY ALL),
dots AS (SELECT doc_id, i0, k, name, sum(n * w * u) AS dot FROM tokens JOIN idf USING (t) JOIN units USING (t) GROUP BY ALL),
best AS (SELECT doc_id, i0, k, max(ROW(dot / size, name)) AS b FROM dots JOIN sizes USING (doc_id, i0, k) GROUP BY ALL),
good AS (SELECT doc_id, i0, k, b[1] AS cosine, b[2] AS license FROM best WHERE b[1] >= {THRESHOLD}),
hits AS (SELECT * FROM good g WHERE k = 1 OR NOT EXISTS (SELECT 1 FROM good a WHERE a.doc_id = g.doc_id AND a.k = 1 AND a.i0 BETWEEN g.i0 AND g.i0 + g.k - 1)),
own AS (SELECT doc_id, max(ROW(cosine, license)) AS b FROM hits GROUP BY doc_id),
share AS (SELECT doc_id, count(DISTINCT i0 + j) / max(counts.n) AS s FROM hits JOIN counts USING (doc_id), range(0, {WRAP}) r(j) WHERE j < k GROUP BY doc_id),
roots AS (SELECT dir, max(b) AS b FROM files JOIN own USING (doc_id) JOIN share USING (doc_id) WHERE s >= {MOSTLY} GROUP BY dir),
near AS (SELECT d.dir, arg_max(r.dir, length(r.dir)) AS anc, arg_max(r.b, length(r.dir)) AS b FROM (SELECT DISTINCT dir FROM files) d JOIN roots r ON d.dir = r.dir OR starts_with(d.dir, r.dir || '/') GROUP BY d.dir)
SELECT f.doc_id, f.dir || '/' || CAST(coalesce(f.doc_id, -1) AS VARCHAR) || '.txt' AS path, replace(coalesce(own.b[2], near.b[2]), ' (short)', '') AS license, round(coalesce(own.b[1], near.b[1]), 6) AS cosine,
CASE WHEN own.b IS NOT NULL THEN 'own' WHEN near.b IS NOT NULL THEN 'directory' ELSE 'none' END AS origin, CASE WHEN own.b IS NULL THEN near.anc END AS license_dir
FROM files f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN near ON near.dir = f.dir"""
