import random

from strandlake.operators import workflow


def test_genome_from_records_to_variants(spark):
    genome = "".join(random.Random(12).choices("ACG", k=1500))
    df = spark.createDataFrame([("r1", None, genome)], "record_id string, description string, sequence string")
    r = workflow.analyze_genome(df, num_reads=600, snvs={30: "T", 700: "T"}).first()
    windows = {genome[s : s + 1000][i : i + 21] for s in (0, 1000) for i in range(len(genome[s : s + 1000]) - 20)}
    canonical = {min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in windows}
    assert (r.records, r.total_bases, r.distinct_kmers) == (1, 1500, len(canonical))
    assert r.snvs == 2 and r.alignment_score == 2 * 59 - 1 and r.cigar == "30M1X29M"
    assert abs(r.gc_percent - 100 * sum(c in "CG" for c in genome) / 1500) < 1e-9 and r.genome_size > 0
    assert r.codes == {k: genome.count(b) for k, b in enumerate("ACG")} and r.base_composition == {"A": genome.count("A"), "C": genome.count("C"), "G": genome.count("G"), "T": 0, "N": 0}
