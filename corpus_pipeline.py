"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it as the next stage's documents. As its documents are
written, a stage first deletes the tables that earlier stages used on their way, but those that
its documents are read from. Columns other than those of documents are not carried on. Null texts and ids, repeated
rows and empty tables go through every stage as its operator states.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stratalens.llm import mixing, neardup, packing, pii, toxicity
from stratalens.llm.common import collecting, release, stored, table
from stratalens.llm.queries import HELD_OUT

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages have used on their way and that are not deleted yet.
_used: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _used, docs)
        with collecting() as own:
            out = f(spark, docs, sf_dir)
        _used.extend(own)
        return out

    return go


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; the model is that of op3_toxicity, so held-out labels stay unseen."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training=f"NOT ({HELD_OUT})")
    return toxicity.add_scores(docs, model, out="_score").where(f"_score < {toxicity.THRESHOLD}").select(COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of every component of near duplicates, of similarity 0.8 or more."""
    return neardup.deduplicate(docs, percent=80).select(COLUMNS)


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by their kinds; n_chars follows the new text."""
    return pii.redact(docs).selectExpr("doc_id", "text", "lang", "source", "CASE WHEN text IS NULL THEN n_chars ELSE CAST(char_length(text) AS BIGINT) END AS n_chars")


@_stage
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each at least once, those of rare domains more often, so that expected tokens meet the targets."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), least=1.0).select(COLUMNS)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data), ("mixing", mix_domains), ("packing", pack)]

#: SQL can't express the stages (trained models, tokenizer); tests hold them against their operators and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with collecting() as own:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, docs)
        before = own[-1:]
    release(spark, _used, docs)
    return docs
