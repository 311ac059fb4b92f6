"""From a genome's records to its k-mers, simulated reads, variants and an alignment, in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import align, kmers, pileup, qc
from strandlake.sources import fasta


def analyze_genome(records: DataFrame, k: int = 21, fragment: int = 1000, num_reads: int = 200, read_length: int = 50, snvs: dict[int, str] | None = None, seed: int = 1) -> DataFrame:
    """One row about (record_id, description, sequence): records, total_bases, gc_percent, codes (of the encoded
    letters, how many of each as a map), base_composition, distinct_kmers, top_kmer, genome_size, snvs, deletions, alignment_score and cigar.

    Reads are simulated without errors but for the planted ``snvs`` (0-based place: letter) from every record; the
    alignment is that of the first record's first 60 bases with the same after the planted changes.
    """
    genome = records.select("record_id", F.upper("sequence").alias("sequence")).persist()
    facts = genome.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("total_bases"), F.avg(S.gc_percent("sequence")).alias("gc_percent"))
    coded = genome.select(F.explode(S.encode("sequence")).alias("code")).groupBy("code").count()  # 15 codes
    codes = coded.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "count")))).alias("codes"))
    letters = qc.composition(genome).select(qc.composition_map().alias("base_composition"))
    counts = kmers.count(fasta.fragments(genome, fragment, k), k).persist()
    best = counts.agg(F.count("*").alias("distinct_kmers"), F.max_by("kmer", F.struct("count", -F.col("code"))).alias("top_kmer"))
    size = kmers.genome_size(counts).select("genome_size")
    refs = genome.select(F.col("record_id").alias("ref_id"), "sequence")
    reads = fasta.simulate_reads(refs, num_reads, read_length, 0.0, snvs, seed)
    calls = pileup.call_variants(refs, reads, 3, 0.5).agg(F.count_if(F.col("type") == "SNV").alias("snvs"), F.count_if(F.col("type") == "DEL").alias("deletions"))
    first = genome.agg(F.substring(F.min_by("sequence", "record_id"), 1, 60).alias("target"))
    query = F.array_join(F.transform(S.letters(F.col("target")), lambda c, i: _planted(c, i, snvs)), "")
    aligned = align.align_pairs(first.withColumn("query", query)).select(F.col("score").alias("alignment_score"), "cigar")
    return facts.crossJoin(codes).crossJoin(letters).crossJoin(best).crossJoin(size).crossJoin(calls).crossJoin(aligned)  # one row each


def _planted(letter, place, snvs):
    if not snvs:
        return letter
    planted = F.create_map(*[x for p, b in snvs.items() for x in (F.lit(p), F.lit(b))])
    return F.coalesce(F.try_element_at(planted, place), letter)
