"""The corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet to the
shared folder and read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontamination, language, packing, secrets, simhash
from strandlake.llm.common import discard, settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID doesn't reject: those in which a learned language is recognised.

    Rejected are null texts, texts without a letter, and texts with at least ``language.ENOUGH`` n-grams of which no
    language holds even ``language.ACCEPT``. A document in another language than its label says stays.
    """
    return language.accepted(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; of its repeated rows, one."""
    return simhash.deduplicate(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows a text that changed."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]
#: Fingerprint links, trained filters and a tokenizer are not to be had in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages. What a stage wrote on its way, and its input, are deleted once its result is written; of the last
    stage, whose result is still to be read, they stay."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
