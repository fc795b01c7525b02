"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, fingerprints, html, licenses, media, mixing, neardup, packing, pii, toxicity
from .common import new_path, stored, table


#: Tokenizers, trained models, container formats and hashes of our own have no SQL; those queries are held against brute force in tests.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Exact links by an equi join on shingles; components by closure.
NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
ORACLES: dict[str, str] = {"op5_neardup": NEAR, "op6_licenses": licenses.oracle(), "pii_base_spans": pii.oracle()}
HELD_OUT = "coalesce(crc32(CAST(doc_id AS STRING)) % 3 = 1, false)"


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(stored(media.store(table(spark, sf_dir, "documents")), "media"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, training=f"NOT ({HELD_OUT})")
    scored = toxicity.add_scores(docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), total="natural")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_pii that SQL can express."""
    return pii.base_report(table(spark, sf_dir, "documents"))


def op9_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    bitpack.write_files(bitpack.write_shards(table(spark, sf_dir, "documents")), path)
    return bitpack.read_documents(bitpack.read_files(spark, path))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_html, op3_toxicity, op4_mixing, op5_neardup, op6_licenses, op7_packing, op8_pii, pii_base_spans, op9_bitpack, op10_fingerprints, pipeline)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
