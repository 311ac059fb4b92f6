"""Sequences, reads, genotypes and pairs derived from the benchmark's tables, for Spark and, as SQL, for DuckDB.

The tables hold no nucleotides: letters of texts are mapped to A, C, G, T and N, always over whole texts and tables.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import vector

FROM, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN"
READ = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out if the input has fewer splits than there are cores, as one small file has; larger inputs don't move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived(df: DataFrame) -> DataFrame:
    """The same table, below which no predicate goes: observed metrics keep work above the step that deals rows out, and what
    is derived is derived once instead of in each predicate."""
    return df.observe(f"derived-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def nucleotides(text: str = "text"):
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), FROM, TO)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sequence)."""
    return derived(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", nucleotides().alias("sequence")))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sequence, quality): scores of 0 to 40 by letter, place and document."""
    return derived(sequences(spark, sf_dir).withColumn("quality", F.arrow_udf(_quality, "string")("sequence", F.col("doc_id").cast("long"))))


def _quality(texts: pa.Array, ids: pa.Array) -> pa.Array:
    """33 and the remainder by 41, with the sign of the id, of seven times the letter, three times the place and the id."""
    made = []
    for part in vector.chunked([pa.RecordBatch.from_arrays([texts, ids], ["text", "id"])], "text"):
        known = pc.if_else(pc.is_valid(part.column("id")), part.column("text"), "")
        data, ends = vector.flat(known)
        sizes = np.diff(ends, prepend=0)
        place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        scores = 33 + np.fmod(data * np.int64(7) + place * 3 + np.repeat(pc.fill_null(part.column("id"), 0).to_numpy(zero_copy_only=False), sizes), 41)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        made.append(pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(scores.astype(np.uint8))))
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, sequence): the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), nucleotides().alias("sequence"))


def placed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, event_id, sequence, start, strand, quality): each event is a read of one of the references.

    Even ones lie in the first half, odd ones in the second, with a hole between; most have another letter at every
    50th place; a third is on the minus strand.
    """
    refs = references(spark, sf_dir)
    numbered = refs.selectExpr("row_number() OVER (ORDER BY ref_id) - 1 AS slot", "ref_id", "sequence")  # the benchmark is one small table
    n = F.broadcast(refs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))  # one row
    events = table(spark, sf_dir, "events").select("event_id").crossJoin(n).select("event_id", (F.col("event_id") % F.col("n")).alias("slot"), F.floor(F.col("event_id") / F.col("n")).alias("k"))
    joined = events.join(numbered, "slot").withColumn("half", F.floor(F.length("sequence") / 2))
    start = F.when(F.col("k") % 2 == 0, (F.col("k") * 7) % F.greatest(F.col("half") - 40, F.lit(1))).otherwise(F.col("half") + (F.col("k") * 11) % F.greatest(F.col("half") - READ, F.lit(1)))
    cut = joined.withColumn("start", start.cast("int")).withColumn("cut", F.substring("sequence", F.col("start") + 1, F.lit(READ)))
    letters = F.when(F.length("cut") > 0, F.split("cut", "")).otherwise(F.array().cast("array<string>"))
    changed = F.array_join(F.transform(letters, lambda c, i: F.when(((F.col("start") + i) % 50 == 7) & (F.col("k") % 10 < 8), F.translate(c, "ACGT", "CGTA")).otherwise(c)), "")
    minus = F.col("k") % 3 == 0
    cut = cut.withColumn("forward", changed)
    sequence = F.when(minus, F.translate(F.reverse("forward"), "ACGT", "TGCA")).otherwise(F.col("forward"))
    quality = F.array_join(F.transform(letters, lambda c, i: F.char((43 + (F.col("event_id") * 7 + i * 5) % 31).cast("int"))), "")
    return cut.select("ref_id", "event_id", sequence.alias("sequence"), "start", F.when(minus, "-").otherwise("+").alias("strand"), quality.alias("quality"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(individual, marker, dosage): 0, 1 or 2 by the sign of a vector's components, some missing."""
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("individual"), F.posexplode("embedding").alias("marker", "x"))
    dosage = F.when((F.col("individual") + F.col("marker")) % 37 == 0, F.lit(None).cast("double")).when(F.col("x") < -0.05, 0.0).when(F.col("x") > 0.05, 2.0).otherwise(1.0)
    return each.select("individual", "marker", dosage.alias("dosage"))


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(individual, label, y): an effect of the label and a part of the vector's first component."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("individual"), "label", (F.col("label") % 3 * 0.5 + F.element_at("embedding", 1).cast("double")).alias("y"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, cells): a table of customers and a few numbers of theirs as texts, some missing or not numbers."""
    c = table(spark, sf_dir, "customer")
    text = lambda x: F.format_string("%d", x)
    key = F.col("c_custkey")
    return c.select(
        key.alias("row_idx"),
        F.array(
            F.when(key % 11 == 0, "NA").otherwise(F.concat(text(key % 7), F.lit(","), text(key % 10))), F.when(key % 5 == 0, "").otherwise(text(key % 3)),
            F.when(key % 13 == 0, "nan").otherwise(text((key * 7) % 4)), F.when(key % 3 == 2, "x").otherwise("1"), F.when(key % 4 == 0, "-").otherwise(F.concat(text(key % 2), F.lit(".5"))),
        ).alias("cells"),
    )


# DuckDB: the same as common table expressions.
NUCLEOTIDES = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{FROM}', '{TO}')"
SEQS = f"seqs AS (SELECT doc_id, {NUCLEOTIDES} AS sequence FROM documents)"
READS = f"""{SEQS}, reads AS (SELECT doc_id, sequence, array_to_string(list_transform(range(1, length(sequence) + 1),
  lambda i: chr(CAST(33 + (ascii(substr(sequence, i, 1)) * 7 + (i - 1) * 3 + doc_id) % 41 AS INT))), '') AS quality FROM seqs)"""
REFS = f"refs AS (SELECT item_id AS ref_id, {NUCLEOTIDES} AS sequence FROM benchmark)"
PLACED = f"""{REFS}, numbered AS (SELECT row_number() OVER (ORDER BY ref_id) - 1 AS slot, ref_id, sequence, length(sequence) // 2 AS half FROM refs),
ev AS (SELECT event_id, event_id % n AS slot, event_id // n AS k FROM events, (SELECT greatest(count(*), 1) AS n FROM refs)),
started AS (SELECT ref_id, event_id, k, sequence AS whole, CASE WHEN k % 2 = 0 THEN (k * 7) % greatest(half - 40, 1) ELSE half + (k * 11) % greatest(half - {READ}, 1) END AS start FROM ev JOIN numbered USING (slot)),
cut AS (SELECT *, substr(whole, start + 1, {READ}) AS cut FROM started),
fwd AS (SELECT *, array_to_string(list_transform(range(1, length(cut) + 1), lambda i: CASE WHEN (start + i - 1) % 50 = 7 AND k % 10 < 8 THEN translate(substr(cut, i, 1), 'ACGT', 'CGTA') ELSE substr(cut, i, 1) END), '') AS forward FROM cut),
placed AS (SELECT ref_id, event_id, start, CASE WHEN k % 3 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN k % 3 = 0 THEN translate(reverse(forward), 'ACGT', 'TGCA') ELSE forward END AS sequence,
  array_to_string(list_transform(range(1, length(cut) + 1), lambda i: chr(CAST(43 + (event_id * 7 + (i - 1) * 5) % 31 AS INT))), '') AS quality FROM fwd)"""
GENO = """geno AS (SELECT vec_id AS individual, j - 1 AS marker, CASE WHEN (vec_id + j - 1) % 37 = 0 THEN NULL WHEN embedding[j] < CAST(-0.05 AS DOUBLE) THEN CAST(0 AS DOUBLE) WHEN embedding[j] > CAST(0.05 AS DOUBLE) THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS dosage
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings))"""
PHENO = "pheno AS (SELECT vec_id AS individual, label, label % 3 * CAST(0.5 AS DOUBLE) + CAST(embedding[1] AS DOUBLE) AS y FROM embeddings)"
CELLS = """cells AS (SELECT c_custkey AS row_idx, [CASE WHEN c_custkey % 11 = 0 THEN 'NA' ELSE (c_custkey % 7) || ',' || (c_custkey % 10) END, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey % 3 AS VARCHAR) END,
  CASE WHEN c_custkey % 13 = 0 THEN 'nan' ELSE CAST((c_custkey * 7) % 4 AS VARCHAR) END, CASE WHEN c_custkey % 3 = 2 THEN 'x' ELSE '1' END, CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE (c_custkey % 2) || '.5' END] AS cells FROM customer),
long AS (SELECT row_idx, c - 1 AS col, lower(trim(cells[c])) IN ('', 'na', 'nan', 'null', 'none', '-', 'nd') AS missing,
  TRY_CAST(CASE WHEN regexp_full_match(cells[c], '-?[0-9]+,[0-9]+') THEN replace(cells[c], ',', '.') ELSE cells[c] END AS DOUBLE) AS number FROM (SELECT row_idx, cells, unnest(range(1, 6)) AS c FROM cells)),
vals AS (SELECT row_idx, col, CASE WHEN NOT missing THEN number END AS value, NOT missing AND number IS NULL AS bad FROM long),
kept AS (SELECT col FROM vals WHERE col > 0 GROUP BY col HAVING count(value) > 0 AND NOT bool_or(bad)),
people AS (SELECT row_idx, value AS y, row_number() OVER (ORDER BY row_idx) - 1 AS individual FROM vals WHERE col = 0 AND value IS NOT NULL),
body AS (SELECT individual, k AS marker, value AS dosage FROM vals JOIN (SELECT col, row_number() OVER (ORDER BY col) - 1 AS k FROM kept) USING (col) JOIN people USING (row_idx))"""
