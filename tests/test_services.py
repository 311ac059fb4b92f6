import gzip
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F
from strandlake.functions import seq as S
from strandlake.operators import align, envelopes, qc
from strandlake.sources import fasta, grid, uploads


def test_uploads_have_ids(spark):
    kept = uploads.store(spark.createDataFrame([(">a b",), ("ACGT",)], "value string").coalesce(1))
    assert len(kept) == 32 and [r.sequence for r in fasta.read_fasta(spark, uploads.upload_path(spark, kept)).collect()] == ["ACGT"]
    for wrong, error in (("../x", ValueError), ("A" * 32, ValueError), ("0" * 32, FileNotFoundError)):
        with pytest.raises(error):
            uploads.upload_path(spark, wrong)


def test_lenient_headers(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">  id1  two   words \nAC\nGT\n>\nTTTT\n>id2\n")
    rows = [(r.record_id, r.description, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path), lenient=True).orderBy("record_index").collect()]
    assert rows == [("id1", "two words", "ACGT"), ("id2", None, "")]
    with pytest.raises(Exception, match="without an id"):
        fasta.read_fasta(spark, str(tmp_path)).collect()


def test_packed_inputs(spark, tmp_path):
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@a\nAC\n+\nII\n@b\nGT\n+\nII\n")
    assert fasta.count_reads(spark, str(tmp_path / "r.fastq.gz")).first().reads == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("folder/mdp.txt", "one\r\ntwo\n")
        z.writestr("other.txt", "no")
    assert [r.value for r in fasta.zip_lines(spark, str(tmp_path / "z.zip"), "mdp.txt").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="absent"):
        fasta.zip_lines(spark, str(tmp_path / "z.zip"), "absent.txt").collect()


def test_batches_of_codes(spark):
    df = spark.createDataFrame([("ACU",), ("g",), (None,), ("",)], "sequence string")
    rows = [(r.codes, r.length) for r in S.encode_batch(df).collect()]
    assert rows == [([0, 1, 3], 3), ([2, 4, 4], 1), ([4, 4, 4], 0), ([4, 4, 4], 0)]
    hot = S.encode_batch(df, one_hot_codes=True).first().codes
    assert hot == [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0, 1, 0]]
    with pytest.raises(ValueError):
        S.encode_batch(df.limit(0))
    wide = df.withColumn("b", F.when(F.col("sequence").isNotNull(), F.length("sequence") % 2))
    longest = {}
    for r in wide.collect():
        longest[r.b] = max(longest.get(r.b, 0), len(r.sequence or ""))
    assert all(len(r.codes) == longest[r.b] for r in S.encode_batch(wide, batch="b").collect()) and S.encode_batch(wide.limit(0), batch="b").count() == 0
    assert df.select(S.encode_char("sequence").alias("c")).where("sequence = 'g'").first().c == 2
    assert spark.sql("SELECT '\u00df' s UNION ALL SELECT NULL").select(S.encode_char("s").alias("c")).collect()[0].c == 4


def test_summary_and_shares(spark):
    reads = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "GG", "II")], "read_id string, sequence string, quality string")
    lines = [r.line for r in qc.summary_lines(reads).collect()]
    assert lines == ["Reads: 2", "Bases: 6", "Mean length: 3.00", "Mean quality: 40.00", "GC percent: 75.00", "Letters: A=1, C=1, G=3, T=1, N=0"]
    assert qc.composition_shares(reads).first().g == 0.5 and qc.composition_shares(reads.limit(0)).first().asDict() == dict.fromkeys("acgtn", 0.0)


def test_sample_traits(spark):
    lines = grid.sample_traits(spark, 200, 40, 0.6)
    assert sorted(lines.collect()) == sorted(grid.sample_traits(spark, 200, 40, 0.6).repartition(3).collect())
    rows = grid.parse_dosage_lines(lines.selectExpr("monotonically_increasing_id() AS line", "value")).collect()
    doses = [d for r in rows for d in r.dosages]
    assert len(rows) == 200 and set(doses) == {0.0, 1.0, 2.0} and {len(r.dosages) for r in rows} == {40}
    ys = [r.phenotype for r in rows]
    mean = sum(ys) / 200
    assert 9.5 < mean < 10.5 and 0.4 < sum((y - mean) ** 2 for y in ys) / 199 < 1.8


def test_requests_and_benchmark(spark):
    lines = spark.createDataFrame([('{"phenotypes": [1.0, 2.5], "genotypes": [[0, null], [1, 2]]}',)], "value string")
    r = envelopes.parse_requests(lines, "mixed_model").first()
    assert r.genotypes == [[0.0, None], [1.0, 2.0]] and r.method is None
    with pytest.raises(Exception):
        envelopes.parse_requests(spark.createDataFrame([("{",)], "value string"), "kmers").collect()
    with pytest.raises(ValueError):
        envelopes.parse_requests(lines, "other")
    found = align.benchmark(spark, 30, 20)
    assert found["pairs"] == 20 and found["pairs_per_second"] > 0


@pytest.mark.parametrize("extended", [-0.5, None])
def test_alignment_by_parts_is_the_same(monkeypatch, extended):
    rng = random.Random(3)
    pairs = []
    for _ in range(40):
        a = "".join(rng.choices("ACGTN", k=rng.randrange(0, 120)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choices("ACGT", k=rng.randrange(0, 40)))
        pairs += [(a, b), (b, a), (a, "")]
    whole = align.local_alignments(pairs, 2, -1, -2, extended)
    monkeypatch.setattr(align, "CELLS", 1)
    assert align.local_alignments(pairs, 2, -1, -2, extended) == whole


def test_long_alignment_memory():
    rng = random.Random(4)
    a = "".join(rng.choices("ACGT", k=6000))
    b = a[:3000] + "ACGT" + a[3000:5990]
    tracemalloc.start()
    score, x, y = align.local_alignments([(a, b)], 2, -1, -2, -0.5)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 < 5 * 6000 * 6000 and score == 2 * 5990 - 2 - 3 * 0.5
    assert x.replace("-", "") == a[:5990] and y.replace("-", "") == b
