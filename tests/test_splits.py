import gzip
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F
from strandlake.operators import kmers
from strandlake.sources import fasta, splits
from strandlake.streaming import kmers as stream


def fastq_text(rng, n, at=0.5, multi=0.2, blank=0.2):
    """Records with qualities that begin with @ and +, in one or more lines, and blanks between records."""
    out = []
    for i in range(n):
        size = rng.randrange(1, 30)
        bases = "".join(rng.choice("ACGTN@") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(size))
        quality = "".join(rng.choice("@+I!#>") for _ in range(size))
        if rng.random() < at:
            quality = "@" + quality[1:]
        lines = [f"@r{i} @x", bases, "+" if rng.random() < 0.7 else f"+r{i}"]
        if rng.random() < multi and size > 4:
            cut = rng.randrange(2, size - 1)
            lines += [quality[:cut], "I" + quality[cut + 1 :]]
        else:
            lines.append(quality)
        out += lines + [""] * (rng.random() < blank)
    return "\n".join(out) + "\n"


def sequential(text, kind="fastq"):
    return list(splits.parsed((x.strip() for x in text.split("\n")), kind, False))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_every_size_give_the_same_records(tmp_path, seed):
    rng = random.Random(seed)
    text = fastq_text(rng, 40, at=(0.0, 0.5, 1.0)[seed % 3])
    path = tmp_path / "a.fq"
    path.write_text(text)
    want = sequential(text)
    for size in [*range(1, 60, 3), 100, 1000, 10**6]:
        parts = splits.ranges_of(splits.files_of(str(path)), size)
        got = [r[:4] for p in parts for r in splits.read_ranges(p, "fastq", False)]
        assert got == want
    fa = "junk\n" + "".join(f">s{i} d\n" + "".join(rng.choice("ACGT") + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randrange(80))) + "\n" for i in range(30))
    (tmp_path / "a.fa").write_text(fa)
    for size in [*range(1, 60, 7), 500]:
        got = [r[:3] for p in splits.ranges_of(splits.files_of(str(tmp_path / "a.fa")), size) for r in splits.read_ranges(p, "fasta", False)]
        assert got == sequential(fa, "fasta")


def bgzf(data, block):
    """Members of up to ``block`` bytes with their lengths, and an empty one at the end."""
    out = b""
    for part in [data[i : i + block] for i in range(0, len(data), block)] + [b""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += splits.BLOCK_MAGIC + struct.pack("<H", len(body) + len(splits.BLOCK_MAGIC) + 9) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def collected(df, n=4):
    rows = sorted(((r["source_file"], r["split_start"], r["record_index"]), tuple(r)[:n]) for r in df.collect())
    assert len({k for k, _ in rows}) == len(rows)
    return [v for _, v in rows]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_splits_of_the_text_reader(spark, tmp_path, small_splits):
    rng = random.Random(9)
    (tmp_path / "q").mkdir()
    texts = [fastq_text(rng, 150, at=a) for a in (0.0, 0.6, 1.0)]
    for i, t in enumerate(texts):
        (tmp_path / "q" / f"{i}.fq").write_text(t)
    with gzip.open(tmp_path / "q" / "3.fq.gz", "wt") as f:
        f.write(texts[0])
    long = f"@long\n{'A' * 5000}\n+\n{'@' * 5000}\n"  # over several splits
    (tmp_path / "q" / "4.fq").write_text(texts[1] + long + texts[2])
    found = splits.read_splits(spark, str(tmp_path / "q"), "fastq")
    assert found.columns == ["read_id", "sequence", "quality", "plus", "source_file", "split_start", "record_index"]
    want = [r for t in (*texts, texts[0], texts[1] + long + texts[2]) for r in sequential(t)]
    assert collected(found) == want and found.select("source_file", "split_start").distinct().count() > 30
    for size in (90, 700):
        (tmp_path / "b").mkdir(exist_ok=True)
        (tmp_path / "b" / "x.bgz").write_bytes(bgzf((texts[1] + texts[2]).encode(), size))
        found = splits.read_splits(spark, str(tmp_path / "b" / "x.bgz"), "fastq")
        assert collected(found) == sequential(texts[1] + texts[2]) and found.select("split_start").distinct().count() > 5
    fa = "junk\n>a é\n" + "ACGT\n" * 900 + ">b\n>c\nNN\n" + "".join(f">s{i}\nAC\n" for i in range(200))
    (tmp_path / "a.fa").write_text(fa)
    assert collected(splits.read_splits(spark, str(tmp_path / "a.fa"), "fasta"), 3) == sequential(fa, "fasta")
    (tmp_path / "e.fq").write_text("")
    assert splits.read_splits(spark, str(tmp_path / "e.fq"), "fastq").count() == 0


def test_errors_are_those_of_the_whole_file(spark, tmp_path, small_splits):
    good = fastq_text(random.Random(3), 100)
    for bad, what in (("@x\nACG\n+\nII\n", "3 bases and 2"), ("@x\nAC\n", "incomplete|bases and"), ("\n\njunk\n", "must start with @")):
        (tmp_path / "x.fq").write_text(good + bad)
        with pytest.raises(Exception, match=what):
            splits.read_splits(spark, str(tmp_path / "x.fq"), "fastq").collect()
        with pytest.raises(Exception, match=what):
            fasta.register(spark)
            spark.read.format("fastq").option("splitBytes", 300).load(str(tmp_path / "x.fq")).collect()


def test_batches_go_over_splits(spark, tmp_path):
    text = "".join(f">r{i}\nACGT\n" for i in range(100))
    (tmp_path / "a.fa").write_text(text)
    fasta.register(spark)
    df = spark.read.format("fasta").option("splitBytes", 64).load(str(tmp_path / "a.fa"))
    assert df.rdd.getNumPartitions() > 10
    rows = fasta.with_batches(df, 30).collect()
    assert all(r.batch_id == int(r.record_id[1:]) // 30 and r.record_index == int(r.record_id[1:]) for r in rows) and len(rows) == 100


def test_sink(spark, tmp_path):
    fasta.register(spark)
    rows = [(f"s{i}", None if i % 2 else f"d {i}", "ACGTN" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, description string, sequence string").repartition(4)
    path = str(tmp_path / "out")
    df.write.format("fasta").mode("append").option("lineWidth", 7).save(path)
    for scheme in ("file:", "file://"):
        assert spark.read.format("fasta").load(scheme + path).count() == 40
    read = lambda: sorted(tuple(r)[:3] for r in spark.read.format("fasta").load(path).collect())
    assert read() == sorted(rows) and {len(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split("\n") if x and x[0] != ">"} <= set(range(1, 8))
    df.write.format("fasta").mode("append").save(path)
    assert read() == sorted(rows + rows)
    df.limit(3).write.format("fasta").mode("overwrite").option("compress", "true").save(path)
    assert len(read()) == 3 and not list((tmp_path / "out").glob("_temporary*"))
    reads = spark.createDataFrame([("r1", "ACGT", "@III", None), ("r2", "AC", "II", "+x")], "read_id string, sequence string, quality string, plus string")
    reads.write.format("fastq").mode("append").save(str(tmp_path / "q"))
    assert sorted(tuple(r)[:4] for r in spark.read.format("fastq").load(str(tmp_path / "q")).collect()) == [("r1", "ACGT", "@III", "+"), ("r2", "AC", "II", "+x")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    fasta.register(spark)
    path = tmp_path / "out"
    good = spark.range(100).select(F.col("id").cast("string").alias("record_id"), F.lit("ACGT").alias("sequence")).repartition(4)
    good.write.format("fasta").mode("append").save(str(path))
    before = sorted(f.name for f in path.iterdir())
    bad = good.withColumn("sequence", F.when(F.col("record_id") == "77", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("sequence")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="stop"):
            bad.write.format("fasta").mode(mode).save(str(path))
        assert sorted(f.name for f in path.iterdir()) == before
    with pytest.raises(Exception, match="can't be empty"):
        spark.createDataFrame([("r", "", "")], "read_id string, sequence string, quality string").write.format("fastq").mode("append").save(str(tmp_path / "q"))
    with pytest.raises(Exception, match="column is missing"):
        good.drop("sequence").write.format("fasta").mode("append").save(str(tmp_path / "z"))


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    fasta.register(spark)
    folder, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("fastq").option("settleSeconds", 0).option("splitBytes", 200).load(str(folder)).select("read_id", "sequence")
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return sorted(r.read_id for r in spark.read.parquet(out).collect())

    rng, want = random.Random(4), []
    for k in range(3):
        for j in range(2):
            text = fastq_text(rng, 20).replace("@r", f"@f{k}{j}_")
            (folder / f"{9 - k}{j}.fq").write_text(text)  # names don't follow the order of arrival
            want += [r[0] for r in sequential(text)]
            time.sleep(0.02)
        assert run() == sorted(want)
    assert run() == sorted(want)


def test_running_counts_restart_and_equal_the_batch(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    rng, texts, last = random.Random(8), [], {}

    def keep(batch, _number):
        last.update({r.kmer: r["count"] for r in batch.collect()})

    for k in range(3):
        texts.append(fastq_text(rng, 15))
        (folder / f"{5 - k}.fq").write_text(texts[-1])
        counts = stream.running_counts(stream.record_stream(spark, str(folder), settle_seconds=0).select("sequence"), 4)
        query = counts.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination(200)
        reads = spark.createDataFrame([(r[1],) for t in texts for r in sequential(t)], "sequence string")
        assert last == {r.kmer: r["count"] for r in kmers.count(reads, 4).collect()}
        time.sleep(0.02)
