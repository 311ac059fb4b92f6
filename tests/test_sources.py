import gzip
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from strandlake.functions import sql
from strandlake.operators import envelopes
from strandlake.sources import fasta, grid
from strandlake.streaming import kmers as stream


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text("junk\n>s1 first one\nACGT\n\nacgt\n>s2\n> s3  late\r\nNN\n")
    got = fasta.read_fasta(spark, str(path)).orderBy("record_index").collect()
    assert [(r.record_id, r.description, r.sequence) for r in got] == [("s1", "first one", "ACGTacgt"), ("s2", None, ""), ("s3", "late", "NN")]
    seqs = spark.createDataFrame([("q1", "test", "ACGT" * 40), ("q2", None, ""), ("q3", "", "A" * 60)], "record_id string, description string, sequence string")
    fasta.write_fasta(seqs.coalesce(1), str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.record_id, r.description, r.sequence) for r in again.collect())[0] == ("q1", "test", "ACGT" * 40)
    lines = "\n".join(r.value for r in fasta.fasta_lines(seqs).collect()).split("\n")
    assert max(len(x) for x in lines) == 60 and lines[0] == ">q1 test" and lines.count(">q2") == 1
    assert fasta.fasta_lines(seqs, 0).first().value == ">q1 test\n" + "ACGT" * 40
    text = fasta.read_fasta_text(spark, str(tmp_path / "out"))
    assert sorted((r.record_id, r.description, r.sequence) for r in text.collect()) == sorted((r.record_id, r.description, r.sequence) for r in again.collect())


def test_fasta_folder_batches_and_summary(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for k in range(3):
        with gzip.open(tmp_path / "x" / f"{k}.fa.gz", "wt") as f:
            f.write("".join(f">r{k}_{i}\n{'ACGT' * 100}\n" for i in range(5)))
    df = fasta.read_fasta(spark, str(tmp_path / "x"))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 15
    assert fasta.with_batches(df, 2).groupBy("source_file").agg(F.max("batch_id").alias("m")).where("m = 2").count() == 3
    one = fasta.upload_summary(df).first()
    assert (one.records, one.total_bases, one.first.record_id, one.first.length) == (15, 6000, "r0_0", 400)
    assert fasta.validate_fasta(df).first().total_bases == 6000
    with pytest.raises(Exception, match="sufficient length"):
        fasta.validate_fasta(df.limit(1)).collect()
    with pytest.raises(Exception, match="no records"):
        fasta.upload_summary(df.limit(0)).collect()


def test_fastq(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text("@r1 desc\nACGTACGTAA\n+\nIIIII\nEEEEE\n\n@r2\nACGT\n+r2\nIIII\n")
    got = fasta.read_fastq(spark, str(path)).orderBy("record_index").collect()
    assert [(r.read_id, r.sequence, r.quality, r.plus) for r in got] == [("r1", "ACGTACGTAA", "IIIIIEEEEE", "+"), ("r2", "ACGT", "IIII", "+r2")]
    fasta.write_fastq(fasta.read_fastq(spark, str(path)).coalesce(1), str(tmp_path / "out"))
    assert fasta.read_fastq(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="must start with @"):
        fasta.read_fastq(spark, str(path), strict=True).collect()
    for bad, what in (("r1\nAC\n+\nII\n", "must start"), ("@r\nAC\n+\nI\n", "2 bases and 1"), ("@r\nAC\n", "incomplete"), ("@r\n\n+\n\n", "incomplete")):
        path.write_text(bad)
        with pytest.raises((PythonException, Exception), match=what):
            fasta.read_fastq(spark, str(path)).collect()


def test_lines_and_simulated_reads(spark):
    lines = spark.createDataFrame([("acgt,3",), (" ggg , 5 , - ",), ("",)], "value string")
    assert [tuple(r) for r in fasta.parse_reads(lines).collect()] == [("ACGT", 3, "+"), ("GGG", 5, "-")]
    assert [r.sequence for r in fasta.parse_sequences(spark.createDataFrame([(" acg ",), (" ",)], "value string")).collect()] == ["ACG"]
    refs = spark.createDataFrame([(1, "ACGTTGCA" * 30), (2, "AC")], "ref_id int, sequence string")
    reads = fasta.simulate_reads(refs, 50, 40, 0.0, {100: "T"}).collect()
    assert len(reads) == 50 and all(30 <= ord(c) - 33 <= 40 for r in reads for c in r.quality)
    for r in reads:
        want = list(("ACGTTGCA" * 30)[r.start : r.start + 40])
        if r.start <= 100 < r.start + 40:
            want[100 - r.start] = "T"
        assert r.sequence == "".join(want)
    wrong = fasta.simulate_reads(refs, 200, 40, 0.1).collect()
    share = sum(a != b for r in wrong for a, b in zip(r.sequence, ("ACGTTGCA" * 30)[r.start :], strict=False)) / 8000
    assert 0.08 < share < 0.12
    parts = fasta.fragments(refs, 50).orderBy("fragment_start").collect()
    assert [len(p.sequence) for p in parts] == [50, 50, 50, 50, 40]


def xlsx(path, rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if not isinstance(v, (int, float)) else f'<c r="{chr(65 + j)}{i + 1}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')


def test_grids(spark, tmp_path):
    assert [grid.sniff_delimiter(x) for x in ("a,b;c", "a;b;c,d", "a\tb", "abc", "a;b,c")] == [",", ";", "\t", ",", ","]
    (tmp_path / "a.csv").write_bytes('﻿x,"y, z"\n\n 1 ,2,3\n,,\n'.encode())
    assert [r.cells for r in grid.load_grid(spark, str(tmp_path / "a.csv")).orderBy("row_idx").collect()] == [["x", "y, z", ""], ["1", "2", "3"]]
    xlsx(tmp_path / "a.xlsx", [["f", "m1"], [1.5, None, 2], ["NA"]])
    assert [r.cells for r in grid.load_grid(spark, str(tmp_path / "a.xlsx")).orderBy("row_idx").collect()] == [["f", "m1", ""], ["1.5", "", "2"], ["NA", "", ""]]
    (tmp_path / "e.csv").write_text("\n")
    for name in ("e.csv", "b.xls"):
        with pytest.raises(ValueError):
            grid.load_grid(spark, str(tmp_path / name))
    lines = spark.createDataFrame([(0, "1.5, 0,NA"), (1, "2,,2"), (2, "")], "line int, value string")
    assert [(r.phenotype, r.dosages) for r in grid.parse_dosage_lines(lines).orderBy("line").collect()] == [(1.5, [0.0, None]), (2.0, [None, 2.0])]
    for bad in ("1,2", "x,1,2", "1,y,2"):
        with pytest.raises(Exception, match="lines must|not a"):
            grid.parse_dosage_lines(spark.createDataFrame([(0, bad)], "line int, value string")).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\nACGTACGT\n>b\nACGT\n")
    counts = stream.running_counts(stream.fasta_stream(spark, str(tmp_path / "in")), 4)
    q = counts.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {r.kmer: r["count"] for r in spark.table("running").collect()} == {"ACGT": 3, "CGTA": 2, "GTAC": 1}


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT revcomp('acgun') a, gc_content('GCGCAT') b, kmer_decode(kmer_code('GATTACA'), 7) c, kmer_canonical('TTT') d, phred_scores('I!') e, seq_normalise('aXu') f, gc_content('') g").first()
    assert (row.a, round(row.b, 6), row.c, row.d, row.e, row.f, row.g) == ("NACGT", 0.666667, "GATTACA", "AAA", [40, 0], "ANT", 0.0)
    assert envelopes.status(spark).first().version == spark.version
