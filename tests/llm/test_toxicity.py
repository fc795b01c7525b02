"""Toxicity: held-out accuracy, and defined results for odd input."""

import os
import zlib

import pytest

from stratalens.llm import toxicity
from stratalens.llm.queries import op3_toxicity


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    got = op3_toxicity(spark, data).collect()
    assert len(got) == len({r.doc_id for r in got}) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    english = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'").select("doc_id").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels and (r.doc_id in english or not labels[r.doc_id])]
    toxic, clean = ([p for y, p in held if y == k] for k in (1, 0))
    # other languages have some forty toxic rows here, each word in two or three
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.02


def test_odd_rows(spark):
    plain = [f"the plain words of text {i} are quiet and long enough {i * 7}" for i in range(60)]
    rude = [f"{t} you rudeword{i % 3} and nastyword here" for i, t in enumerate(plain)]
    texts = [*plain, *rude, None, "", "w" * 100_000, plain[0], plain[0]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string").selectExpr("*", "1 AS toxic", "0.5D AS score")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)] + [(0, 0), (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.add_scores(docs.drop("score"), model).collect()}
    assert len(got) == len(texts) + 1 and all(0 <= s <= 1 for s in got.values())
    assert got[120] == got[121] and got[123] == got[124] == got[0]
    assert min(got[i] for i in range(60, 120)) > max(got[i] for i in range(60))


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.add_scores(docs, model).collect()] == [0.0]


def test_scores_against_plain_compression():
    import math
    import random

    import zstandard

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    plain = [word() for _ in range(400)]
    texts, toxic = [], []
    for i in range(240):
        own = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            own[rng.randrange(len(own))] = rng.choice(["zzbad", "zzworse", "zzworst"])
        texts.append(" ".join(own))
        toxic.append(int(i % 4 == 0))
    model = toxicity.fit(texts, toxic)
    scorer = toxicity.Scorer(model)

    def length(data, side):
        params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        own = zstandard.ZstdCompressionDict(side, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(data))

    for text in [*texts[:30], "", None, "zzbad " * 50, "word " * 3000]:
        found = toxicity.words(text)
        weights = []
        for w in found:
            data = f" {w} ".encode() * toxicity.REPEAT
            weights.append(model.weights.get((length(data, model.toxic), length(data, model.ordinary)), 0.0))
        top = ([max(0.0, x) for x in sorted(weights, reverse=True)[: toxicity.TOP]] + [0.0] * toxicity.TOP)[: toxicity.TOP]
        z = sum(a * b for a, b in zip([1.0, *top, math.log1p(len(found))], model.coef, strict=True))
        assert abs(scorer.score(text) - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="needs the larger tables")
def test_every_language_on_held_out_rows():
    import zlib

    import duckdb

    at = lambda t: f"/root/testdata/check_s/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"/root/testdata/check_s/{t}.parquet") else "")
    rows = duckdb.sql(f"SELECT doc_id, lang, text, max(toxic) FROM '{at('documents')}' JOIN '{at('labels')}' USING (doc_id) WHERE toxic IS NOT NULL GROUP BY ALL").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    order = sorted((r for r in rows if not held(r)), key=lambda r: zlib.crc32(str(r[0]).encode()))
    sample = [r for y in (0, 1) for r in [x for x in order if x[3] == y][: toxicity.SAMPLE]]
    scorer = toxicity.Scorer(toxicity.fit((r[2] for r in sample), (r[3] for r in sample)))
    for lang in ("en", "de", "fr", "es"):
        own = [(scorer.score(r[2]) >= toxicity.THRESHOLD, r[3]) for r in rows if held(r) and r[1] == lang]
        assert sum(h for h, y in own if y) >= 0.9 * sum(y for _, y in own), lang
        assert sum(h for h, y in own if not y) <= 0.01 * len(own), lang
