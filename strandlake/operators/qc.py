"""Quality control of reads: one pass of per-read expressions and one aggregation for each report.

Reads are rows (read_id, sequence, quality, ...); other columns go along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.functions import vector as V

BASES = "ACGT"


def composition(sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """One row (a, c, g, t, n): letters over all sequences. n is always 0: ambiguous letters aren't counted."""
    s = S.normalise(column)
    return sequences.agg(*[F.coalesce(F.sum(S.count_of(s, b)), F.lit(0)).alias(b.lower()) for b in BASES]).withColumn("n", F.lit(0).cast("long"))


def composition_map(prefix: str = "") -> F.Column:
    return F.create_map(*[x for b in "ACGTN" for x in (F.lit(b), F.col(prefix + b.lower()))])


def composition_shares(sequences: DataFrame, column: str = "sequence") -> DataFrame:
    """One row (a, c, g, t, n): shares of the counted letters, 0 where none is counted."""
    total = F.nullif(sum(F.col(b.lower()) for b in BASES), F.lit(0))
    return composition(sequences, column).select(*[F.coalesce(F.col(b) / total, F.lit(0.0)).alias(b) for b in "acgtn"])


def quality_by_position(reads: DataFrame, max_position: int | None = None, offset: int = 33) -> DataFrame:
    """(position, mean_quality): the sum of scores over the number of scores above zero, at least 1, at each position."""
    sums = V.position_sums(reads, max_position, offset)
    return sums.select("position", (F.col("total") / F.greatest("above", F.lit(1))).alias("mean_quality"))


def trim_by_quality(reads: DataFrame, min_quality: float = 20, window: int = 5, offset: int = 33) -> DataFrame:
    """Reads cut where the first low window starts; reads cut to nothing are dropped."""
    cut = F.col("_cut").cast("int")
    found = reads.withColumn("_cut", V.trim_position("quality", min_quality, window, offset)).where("_cut > 0")
    return found.withColumn("sequence", F.substring("sequence", F.lit(1), cut)).withColumn("quality", F.substring("quality", F.lit(1), cut)).drop("_cut")


def trim_with_report(reads: DataFrame, min_quality: float = 20, window: int = 5, offset: int = 33) -> tuple[DataFrame, Observation]:
    """The trimmed reads, and an observation that has their figures once the reads have been written or counted.

    One scan and one evaluation by Arrow serve both: the batch that finds a read's cut also sums the scores before it. The
    figures are those of ``report`` but for the curve by position: num_reads, total_bases, mean_read_length, mean_quality,
    gc_content_percent and a, c, g, t. An observation is of one run: of a plan that is read twice, of the first.
    """
    cut = F.col("_trim.cut").cast("int")
    found = reads.withColumn("_trim", V.trim_sums("quality", min_quality, window, offset)).where("_trim.cut > 0")
    trimmed = found.withColumn("sequence", F.substring("sequence", F.lit(1), cut)).withColumn("quality", F.substring("quality", F.lit(1), cut))
    s, seen = S.normalise("sequence"), Observation(f"trim-{uuid.uuid4().hex}")
    observed = trimmed.observe(
        seen,
        F.count(F.lit(1)).alias("num_reads"),
        F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("total_bases"),
        F.coalesce(F.avg(F.length("sequence")), F.lit(0.0)).alias("mean_read_length"),
        F.coalesce(F.sum("_trim.total") / F.nullif(F.sum(F.length("quality")), F.lit(0)), F.lit(0.0)).alias("mean_quality"),
        F.coalesce(F.avg(S.gc_percent("sequence")), F.lit(0.0)).alias("gc_content_percent"),
        *[F.coalesce(F.sum(S.count_of(s, b)), F.lit(0)).alias(b.lower()) for b in BASES],
    )
    return observed.drop("_trim"), seen


def filter_by_quality(reads: DataFrame, min_mean_quality: float = 20.0, min_length: int = 20, max_n_ratio: float = 0.1, offset: int = 33) -> DataFrame:
    """Reads that meet all three bounds, each included."""
    cheap = reads.where((F.length("sequence") >= min_length) & (S.n_ratio("sequence") <= max_n_ratio))
    return cheap.where(V.mean_score("quality", offset) >= min_mean_quality)


def report(reads: DataFrame, offset: int = 33) -> DataFrame:
    """One row: counts, mean length, mean quality over bases, mean GC over reads, composition, quality by position."""
    s = S.normalise("sequence")
    per_read = reads.select(
        F.length("sequence").cast("long").alias("len"),
        S.gc_percent("sequence").alias("gc"),
        F.round(V.mean_score("quality", offset) * F.length("quality")).cast("long").alias("q"),
        F.length("quality").cast("long").alias("nq"),
        *[S.count_of(s, b).alias(b.lower()) for b in BASES],
    )
    total = per_read.agg(
        F.count("*").alias("num_reads"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("total_bases"),
        F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean_read_length"),
        F.coalesce(F.sum("q") / F.nullif(F.sum("nq"), F.lit(0)), F.lit(0.0)).alias("mean_quality"),
        F.coalesce(F.avg("gc"), F.lit(0.0)).alias("gc_content_percent"),
        *[F.coalesce(F.sum(b.lower()), F.lit(0)).alias(b.lower()) for b in BASES],
    ).withColumn("n", F.lit(0).cast("long"))
    # as many rows as the longest read has positions
    curve = quality_by_position(reads, offset=offset).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean_quality"))), lambda x: x["mean_quality"]).alias("quality_by_position"))
    return total.withColumn("base_composition", composition_map()).drop("a", "c", "g", "t", "n").crossJoin(curve)  # one row by one row


def summary_lines(reads: DataFrame, offset: int = 33) -> DataFrame:
    """(line): the report as text, a row for each fact."""
    number = lambda c: F.format_string("%.2f", F.col(c))
    letters = F.array_join(F.transform(F.map_entries("base_composition"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", ")
    facts = {"Reads": F.col("num_reads").cast("string"), "Bases": F.col("total_bases").cast("string"), "Mean length": number("mean_read_length"), "Mean quality": number("mean_quality"), "GC percent": number("gc_content_percent"), "Letters": letters}
    return report(reads, offset).select(F.explode(F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in facts.items()])).alias("line"))


def sequence_report(sequences: DataFrame) -> DataFrame:
    """One row for sequences without qualities: number, mean GC over sequences, mean length, composition."""
    s = S.normalise("sequence")
    found = sequences.agg(
        F.count("*").alias("num_sequences"),
        F.coalesce(F.bround(F.avg(S.gc_percent("sequence")), 4), F.lit(0.0)).alias("gc_content_percent"),
        F.coalesce(F.bround(F.avg(F.length("sequence")), 1), F.lit(0.0)).alias("mean_length"),
        *[F.coalesce(F.sum(S.count_of(s, b)), F.lit(0)).alias(b.lower()) for b in BASES],
    ).withColumn("n", F.lit(0).cast("long"))
    return found.select("num_sequences", "gc_content_percent", composition_map().alias("base_composition"), "mean_length")


def windowed_report(sequences: DataFrame, window: int = 1_000_000) -> DataFrame:
    """As ``sequence_report``, but GC is the mean over windows weighted by their length, ambiguous letters included.

    Long sequences are dealt out by windows, so that one chromosome isn't one task.
    """
    parts = sequences.select(S.normalise("sequence").alias("_s")).select(F.explode(S.tiles("_s", window)).alias("w")).select("w.tile")
    s = S.normalise("tile")
    bases = parts.agg(
        F.sum(S.gc_content("tile") * F.length("tile")).alias("gc"), F.sum(F.length("tile")).alias("total"), *[F.sum(S.count_of(s, b)).alias(b.lower()) for b in BASES]
    ).withColumn("n", F.lit(0).cast("long"))
    some = F.coalesce(F.col("total"), F.lit(0)) > 0
    return sequences.agg(F.count("*").alias("records")).crossJoin(bases).select(  # one row by one row
        F.when(some, F.col("records")).otherwise(0).alias("num_sequences"),
        F.when(some, F.bround(F.col("gc") / F.col("total") * 100, 4)).otherwise(0.0).alias("gc_content_percent"),
        F.when(some, composition_map()).otherwise(F.create_map().cast("map<string,bigint>")).alias("base_composition"),
        F.when(some, F.bround(F.col("total") / F.col("records"), 1)).otherwise(0.0).alias("mean_length"),
    )


def reports_of(reads: DataFrame, *keys: str, offset: int = 33) -> DataFrame:
    """A service's answer for each value of the keys, over reads (keys, sequence, quality): num_sequences, gc_content_percent,
    mean_length, base_composition, quality_mean and quality_by_position, rounded as in ``sequence_report``.

    Positions are summed by key and place, so a key with many reads is no one task's.
    """
    s = S.normalise("sequence")
    facts = reads.groupBy(*keys).agg(
        F.count("*").alias("num_sequences"), F.bround(F.avg(S.gc_percent("sequence")), 4).alias("gc_content_percent"), F.bround(F.avg(F.length("sequence")), 1).alias("mean_length"),
        *[F.sum(S.count_of(s, b)).alias(b.lower()) for b in BASES],
    ).withColumn("n", F.lit(0).cast("long"))
    scores = reads.select(*keys, F.posexplode(S.phred("quality", offset)).alias("position", "score")).groupBy(*keys, "position")
    places = scores.agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("above"))
    curve = F.transform(F.array_sort(F.collect_list(F.struct("position", "total", "above"))), lambda x: F.bround(x["total"] / F.greatest(x["above"], F.lit(1)), 2))
    quality = places.groupBy(*keys).agg(F.bround(F.sum("total") / F.sum("n"), 2).alias("quality_mean"), curve.alias("quality_by_position"))
    both = F.expr(" AND ".join(f"f.`{k}` <=> q.`{k}`" for k in keys))
    joined = facts.withColumn("base_composition", composition_map()).alias("f").join(quality.alias("q"), both, "left")
    return joined.select(*[f"f.{k}" for k in keys], "num_sequences", "gc_content_percent", "mean_length", "base_composition", "quality_mean", "quality_by_position")


def record_stats(sequences: DataFrame, *keys: str) -> DataFrame:
    """Length, GC percent, letters with their percentages, other letters and the first 100 bases of each sequence."""
    s, n = F.upper("sequence"), F.length("sequence")
    counts = {b.lower(): S.count_of(s, b) for b in BASES}
    gc = F.when(n > 0, S.count_of(s, "GCS") / F.nullif(S.count_of(s, "GCSATWU").cast("double"), F.lit(0.0)) * 100)
    return sequences.select(
        *keys, n.cast("long").alias("length"), F.coalesce(gc, F.lit(0.0)).alias("gc_percent"), *[c.alias(f"n_{b}") for b, c in counts.items()],
        *[F.coalesce(c / F.nullif(n, F.lit(0)) * 100, F.lit(0.0)).alias(f"pct_{b}") for b, c in counts.items()],
        (n - sum(counts.values())).cast("long").alias("others"), F.substring("sequence", 1, 100).alias("first_bases"),
    )


def dataset_stats(sequences: DataFrame) -> DataFrame:
    n = F.length("sequence").cast("long")
    return sequences.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bases"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(S.gc_percent("sequence")).alias("mean_gc_percent")
    )
