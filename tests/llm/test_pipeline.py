"""The stages of the pipeline, each against its own input."""

import re

import corpus_pipeline as cp
from stratalens.llm import neardup, pii, toxicity
from stratalens.llm.common import stored, table
from stratalens.llm.queries import HELD_OUT

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    results = {}
    for name, stage in cp.STAGES:
        results[name] = docs = stored(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == cp.COLUMNS
    start = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    clean = {r.doc_id for r in results["toxicity"].collect()}
    scored = toxicity.add_scores(start, toxicity.train(start, labels, training=f"NOT ({HELD_OUT})")).collect()
    assert clean == {r.doc_id for r in scored if r.score < 0.7}
    gone = {r.doc_id for r in start.collect()} - clean
    wrong = labels.where("toxic = 0").where(labels.doc_id.isin(list(gone))).count()
    assert gone and wrong <= 0.03 * labels.where("toxic = 0").count()
    kept = {r.doc_id for r in results["near_duplicates"].collect()}
    assert kept == {r.doc_id for r in neardup.near_duplicates(results["toxicity"], 80).collect() if r.kept}
    assert all(r.kept for r in neardup.near_duplicates(results["near_duplicates"], 80).collect())
    before = {r.doc_id: r.text for r in results["near_duplicates"].collect()}
    after = {r.doc_id: r for r in results["personal_data"].collect()}
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values())
    assert any("[EMAIL]" in r.text for r in after.values())
    for d, r in after.items():
        if not re.search(rf"\[(?:{'|'.join(pii.KINDS)})\]", r.text, re.I):
            assert r.text == before[d]
    found = pii.report(results["personal_data"]).collect()
    assert not any(r.n_email or r.n_ip for r in found)
    mixed = results["mixing"].collect()
    assert {r.doc_id for r in mixed} == after.keys()
    pieces = results["packing"].collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sum(r.start == 0 for r in pieces) == len(mixed)


def test_empty(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DATA, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_entry_has_every_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
