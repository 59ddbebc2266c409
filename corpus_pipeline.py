"""A training corpus from raw documents in five stages, each of which works on all that the one before kept.

1. quality: documents that the quality classifier rejects go.
2. near_dedup: of every class of near duplicates the document of the smallest id stays.
3. secrets: every secret found by the blob ledger is replaced by a mark in the text.
4. mixing: sources are mixed to their target weights; a document stands as often as the mix takes it.
5. encoding: every text is encoded to token ids and decoded again.

All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, mixing, neardup, quality, secrets
from pulsegrid.llm.base import table, written
from pulsegrid.llm.queries import quality_model, tokenizer_path
from pulsegrid.session import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ACCEPT = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least `ACCEPT`. The classifier learns from the labels of documents that are given."""
    return quality.score(docs, quality_model(spark, docs, sf_dir), COLUMNS).filter(F.col("score") >= ACCEPT).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per class of near duplicates."""
    return neardup.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; found secrets are masked and the length follows. A NULL text stays NULL."""
    ledger = new_folder(spark, "ledger")
    secrets.scan(docs, ledger)
    d = docs.select(*COLUMNS).withColumn("blob", secrets.blob_id(F.col("text"))).join(secrets.masks(ledger, spark), "blob", "left")
    found = F.col("cuts").isNotNull()
    d = d.withColumn("text", F.when(found, secrets.redact(F.col("text"), F.col("cuts"))).otherwise(F.col("text")))
    return d.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    return mixing.repeated(docs).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded again) of every row."""
    return bpe.encode(docs, tokenizer_path(), ["doc_id", "source"], digests=True)


STAGES = [("quality", keep_quality), ("near_dedup", keep_one_of_each), ("secrets", mask_secrets), ("mixing", mix_sources), ("encoding", encode_texts)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
