"""From raw documents to a token-encoded training mix, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all the
rows it is given and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, jaccard, langid, mixing, toxicity
from ledgerlens.llm.common import crc_mod, shared_dir, table
from ledgerlens.llm.queries import tokenizer_file


#: Rows that Python workers are handed at once: documents can be long.
BATCH = 256


def _short_batches(spark: SparkSession) -> None:
    """For the session, since a stage's result is only computed when it is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(BATCH, int(spark.conf.get(name)) if int(spark.conf.get(name)) > 0 else BATCH)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts, texts without a letter, and texts whose
    PPM code is far longer than those of the language that codes them best."""
    _short_batches(spark)
    trees = langid.train(docs, where=crc_mod("doc_id", 3) != 1, limits=True)
    return langid.keep_identified(docs, trees)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose calibrated toxicity is 0.5 or more."""
    _short_batches(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard similarity of
    0.8 or more) stays, that of the smallest id."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their target weights."""
    return mixing.keep_sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the BPE ids of their whole texts."""
    _short_batches(spark)
    return bpe.encode(docs, bpe.vocabulary(tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("language ID", language_id),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: PPM code lengths, boosted trees and BPE merges have no SQL form; tests compare the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the
    session's batch size is its own again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    finally:
        spark.conf.set(name, before)
    return docs
