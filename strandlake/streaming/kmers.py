"""Running k-mer counts over FASTA files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import kmers
from strandlake.sources import fasta


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(sequence) of each record of clean FASTA files; a file is read when it appears."""
    blocks = spark.readStream.option("lineSep", "\n>").text(folder)
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", ""), "\n")
    return blocks.select(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("sequence"))


def record_stream(spark: SparkSession, folder: str, kind: str = "fastq", settle_seconds: float = 2) -> DataFrame:
    """The records of FASTA or FASTQ files, of any form the batch reader takes, as they appear in a folder.

    The offset is the last file's time and path, so a query that restarts from its checkpoint goes on after it, and each record
    counts once.
    """
    fasta.register(spark)
    return spark.readStream.format(kind).option("settleSeconds", settle_seconds).load(folder)


def running_counts(sequences: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(kmer, count) so far; the state is one row for each distinct k-mer, hashed over the state partitions."""
    return kmers.kmers(sequences, k, canonical).groupBy("kmer").agg(F.count("*").alias("count"))
