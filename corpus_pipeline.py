"""A training corpus from documents, in five stages. Each takes (spark, docs, sf_dir) and gives the next one's docs.

1. language_id: documents whose language can't be told go.
2. near_dedup: one document of each group of near-duplicates (a Jaccard index of 0.8 or more on five-word shingles) stays.
3. secret_scan: secrets in texts are replaced by a mark; n_chars follows.
4. mixing: documents are drawn to the sources' target weights, some more than once.
5. byte_bpe: texts become token ids.

All columns of documents, others besides included, whatever their names, go through the first four stages.

Nulls and edge cases: documents whose text is null, empty or without a letter go in stage 1, as their language can't be told. A null
doc_id, lang or source is kept: null keys are one key, a null source is a source of its own. Of repeated rows, and of rows alike, one
stays (stage 2); where keys tie, that with the smallest hash of its text. Very long texts are worked on whole. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm import byte_bpe, language_id, mixing, near_dedup, secrets
from rowsieve.llm._common import delete, fresh_path, read_table, settled


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_identified(docs, net)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, places=False)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", stage_language),
    ("near_dedup", stage_dedup),
    ("secret_scan", stage_secrets),
    ("mixing", stage_mixing),
    ("byte_bpe", stage_encode),
]

#: No SQL: the stages learn, hash and encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written goes as soon as the next one has."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = path, fresh_path(spark, f"pipeline-{name}")
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), path)  # noqa: B023
        if before:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
