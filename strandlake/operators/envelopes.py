"""One-row answers of the analysis services: the same fields, checks and rounding, over in-memory requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import kmers, pileup, qc, quant


#: The services' requests, as JSON.
REQUESTS = {
    "quality": "sequences array<string>, qualities array<string>",
    "kmers": "sequences array<string>, k int, canonical boolean, min_abundance long, top int",
    "variants": "reference string, reads array<struct<sequence:string,start:int,strand:string>>, min_depth long, min_alt_freq double",
    "mixed_model": "phenotypes array<double>, genotypes array<array<double>>, method string, max_iter int, kinship_method string",
    "breeding_values": "phenotypes array<double>, genotypes array<array<double>>, genetic_variance double, residual_variance double, kinship_method string, max_iter int",
}


def parse_requests(lines: DataFrame, kind: str, *keys: str) -> DataFrame:
    """The keys and the fields of each JSON line (value), null where left out; a line that isn't such JSON is an error."""
    if kind not in REQUESTS:
        raise ValueError(f"kind: one of {sorted(REQUESTS)}")
    return lines.select(*keys, F.from_json("value", REQUESTS[kind], {"mode": "FAILFAST"}).alias("r")).select(*keys, "r.*")


def analyze_quality(spark: SparkSession, sequences: list[str], qualities: list[str] | None = None) -> DataFrame:
    """num_sequences, gc_content_percent, base_composition, mean_length and, for qualities, quality_mean and quality_by_position.

    Sequences and qualities go in pairs as far as the shorter list.
    """
    seqs = spark.createDataFrame([(s,) for s in sequences], "sequence string")
    found = qc.sequence_report(seqs)
    if not sequences:
        found = found.withColumn("base_composition", F.create_map().cast("map<string,bigint>"))
    if qualities:
        reads = spark.createDataFrame([(str(i), s, q) for i, (s, q) in enumerate(zip(sequences, qualities, strict=False))], "read_id string, sequence string, quality string")
        more = qc.report(reads).select(F.bround("mean_quality", 2).alias("quality_mean"), F.transform("quality_by_position", lambda x: F.bround(x, 2)).alias("quality_by_position"))
        return found.crossJoin(more)  # one row by one row
    return found.withColumn("quality_mean", F.lit(None).cast("double")).withColumn("quality_by_position", F.lit(None).cast("array<double>"))


def count_kmers(spark: SparkSession, sequences: list[str], k: int = 21, canonical: bool = True, min_abundance: int = 1, top: int = 20) -> DataFrame:
    return kmers.report(spark.createDataFrame([(s,) for s in sequences], "sequence string"), k, canonical, min_abundance, top)


def call_variants(spark: SparkSession, reference: str, reads: list[dict], min_depth: int = 10, min_alt_freq: float = 0.2) -> DataFrame:
    """variants (by position), total_variants, snvs, deletions, mean_depth. Base qualities are accepted and don't count."""
    refs = spark.createDataFrame([(0, reference)], "ref_id int, sequence string")
    rows = spark.createDataFrame([(0, r["sequence"], r["start"], r.get("strand", "+"), None) for r in reads], "ref_id int, sequence string, start int, strand string, quality string")
    calls = pileup.call_variants(refs, rows, min_depth, min_alt_freq).drop("ref_id")
    listed = calls.agg(F.array_sort(F.collect_list(F.struct("position", "ref", "alt", "type", "depth", "alt_count", "freq", F.map_entries("bases").alias("bases")))).alias("variants"))
    return listed.crossJoin(pileup.summary(refs, rows, min_depth, min_alt_freq).drop("ref_id"))  # one row by one row


def _checked(phenotypes: list[float], genotypes: list[list[float | None]], method: str) -> None:
    if len(phenotypes) != len(genotypes):
        raise ValueError("phenotypes and genotypes differ in number")
    if len(phenotypes) < 5:
        raise ValueError("at least 5 individuals are needed")
    if len({len(g) for g in genotypes}) > 1:
        raise ValueError("genotype rows differ in length")
    if method not in quant.METHODS:
        raise ValueError(f"kinship_method: one of {quant.METHODS}")


def _inputs(spark: SparkSession, phenotypes, genotypes, kinship_method):
    _checked(phenotypes, genotypes, kinship_method)
    long = spark.createDataFrame([(i, m, None if v is None else float(v)) for i, g in enumerate(genotypes) for m, v in enumerate(g)], "individual long, marker int, dosage double")
    relationships = quant.kinship(long, kinship_method).withColumn("group", F.lit("all"))
    people = spark.createDataFrame([("all", i, i, float(y), [1.0]) for i, y in enumerate(phenotypes)], "group string, individual long, level long, y double, x array<double>")
    return people, relationships


def _rounded(fits: DataFrame, n_markers: int, fields: list[str], blup: list[str]) -> DataFrame:
    numbers = {"genetic_variance": 6, "residual_variance": 6, "heritability": 6, "log_likelihood": 4}
    listed = F.transform("blup", lambda b: F.struct((b["individual"] + 1).alias("individual"), *[F.bround(b[c], 6).alias(c) for c in blup]))
    found = fits.withColumn("n_markers", F.lit(n_markers)).withColumn("fixed_effects", F.transform("fixed_effects", lambda x: F.bround(x, 6))).withColumn("blup", listed)
    return found.withColumns({c: F.bround(c, d) for c, d in numbers.items()}).select(fields)


def fit_mixed_model(spark: SparkSession, phenotypes: list[float], genotypes: list[list[float | None]], method: str = "reml", max_iter: int = 100, kinship_method: str = "vanraden") -> DataFrame:
    people, relationships = _inputs(spark, phenotypes, genotypes, kinship_method)
    fits = quant.fit_groups(people, relationships, method, max_iter=max_iter, kind="lmm")
    return _rounded(fits, len(genotypes[0]), ["n_individuals", "n_markers", "genetic_variance", "residual_variance", "heritability", "log_likelihood", "iterations", "converged", "fixed_effects", "blup"], ["value"])


def predict_breeding_values(spark: SparkSession, phenotypes: list[float], genotypes: list[list[float | None]], kinship_method: str = "vanraden", genetic_variance: float | None = None, residual_variance: float | None = None, max_iter: int = 100) -> DataFrame:
    people, relationships = _inputs(spark, phenotypes, genotypes, kinship_method)
    fits = quant.fit_groups(people, relationships, "reml", genetic_variance, residual_variance, max_iter)
    fields = ["n_individuals", "n_markers", "genetic_variance", "residual_variance", "variance_source", "log_likelihood", "iterations", "converged", "fixed_effects", "blup"]
    return _rounded(fits, len(genotypes[0]), fields, ["value", "reliability", "accuracy"])


def status(spark: SparkSession) -> DataFrame:
    """One row (version, master, cores, application): what the work runs on."""
    context = spark.sparkContext
    return spark.createDataFrame([(spark.version, context.master, context.defaultParallelism, context.appName)], "version string, master string, cores int, application string")
