import random

from pyspark.sql import functions as F
from strandlake.functions import sql, tables
from strandlake.operators import align, kmers, qc
from strandlake.plans import derive as D


def made(spark, n=200):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        size = rng.randrange(0, 60)
        rows.append((i, "".join(rng.choices("ACGTNRu", [9, 9, 9, 9, 2, 1, 1], k=size)), "".join(chr(33 + rng.randrange(41)) for _ in range(size))))
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "", "")], "read_id long, sequence string, quality string")


def test_trimming_and_its_report_share_one_evaluation(spark):
    reads = made(spark)
    trimmed, seen = qc.trim_with_report(reads, 15, 4)
    plan = trimmed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Scan") == 1
    want = qc.trim_by_quality(reads, 15, 4)
    assert sorted(map(tuple, trimmed.collect())) == sorted(map(tuple, want.collect()))
    facts, report = seen.get, qc.report(want).first()
    assert 0 < facts["num_reads"] < 200
    for name in ("num_reads", "total_bases", "mean_read_length", "mean_quality", "gc_content_percent"):
        assert abs(facts[name] - report[name]) < 1e-9
    assert {b: facts[b.lower()] for b in "ACGT"} == {b: report.base_composition[b] for b in "ACGT"}
    plan = want._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_predicates_stay_above_what_deals_rows_out(spark):
    reads = D.reads(spark, "/root/testdata/sf0.001")
    plan = qc.filter_by_quality(reads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("CollectMetrics") < plan.index("Relation") and plan.count("regexp_replace") == 1


def test_reports_by_key_equal_single_reports(spark):
    reads = made(spark).where("sequence IS NOT NULL").withColumn("k", F.when(F.col("read_id") % 3 > 0, F.col("read_id") % 3))
    got = {r.k: r for r in qc.reports_of(reads, "k").collect()}
    for key, r in got.items():
        own = reads.where("k IS NULL" if key is None else f"k = {key}")
        one, full = qc.sequence_report(own).first(), qc.report(own).first()
        assert (r.num_sequences, r.gc_content_percent, r.mean_length, r.base_composition) == (one.num_sequences, one.gc_content_percent, one.mean_length, one.base_composition)
        assert abs(r.quality_mean - full.mean_quality) < 0.00501 and all(abs(a - b) < 0.00501 for a, b in zip(r.quality_by_position, full.quality_by_position, strict=True))
    assert set(got) == {None, 1, 2} and qc.reports_of(reads.limit(0), "k").count() == 0


def test_table_functions(spark):
    assert set(tables.register(spark)) == {"kmer_table", "pileup_table", "align_table"}
    sql.register(spark)
    made(spark).createOrReplaceTempView("some_reads")
    for canonical in (True, False):
        got = spark.sql(f"SELECT kmer_decode(code, 5) AS kmer, sum(n) AS n FROM kmer_table(TABLE(SELECT sequence FROM some_reads), 5, {str(canonical).lower()}) GROUP BY code").collect()
        want = kmers.count(made(spark), 5, canonical).collect()
        assert {r.kmer: r.n for r in got} == {r.kmer: r["count"] for r in want}
    pairs = spark.createDataFrame([(1, "ACGGTACC", "ACGTACC"), (2, "", "AC"), (3, None, "AC"), (4, "AXGT", "ANGT")], "id long, query string, target string")
    pairs.createOrReplaceTempView("some_pairs")
    got = spark.sql("SELECT * FROM align_table(TABLE(some_pairs))").collect()
    want = align.align_pairs(pairs).select("id", "score", "aligned_query", "aligned_target").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    spark.createDataFrame([(7, "acgN", "III!", "-", 3, 6, 0)] * 3 + [(7, "AC", None, "+", -1, 6, 0)], "ref_id long, sequence string, quality string, strand string, start int, length long, tile long").createOrReplaceTempView("placed")
    rows = {r.pos: (r.a, r.c, r.g, r.t) for r in spark.sql("SELECT pos, sum(a) a, sum(c) c, sum(g) g, sum(t) t FROM pileup_table(TABLE(placed) PARTITION BY (ref_id, tile), 20) GROUP BY pos").collect()}
    assert rows == {4: (0, 3, 0, 0), 5: (0, 0, 3, 0)}
    rows = spark.sql("SELECT sum(a + c + g + t) AS n FROM pileup_table(TABLE(placed) PARTITION BY (ref_id), -1)").first()
    assert rows.n == 7
