"""FASTA and FASTQ as data sources, and their sinks.

``spark.read.format("fasta")`` and ``format("fastq")`` take a file, a folder or a comma-separated list, and are read in
ranges of ``splitBytes``; files ending in .gz are unpacked, each in one task. ``readStream`` takes the same, a folder's
files as they appear, and ``write`` puts a file for each task in place when all are done. These open paths with Python, on
the executors: local ones and those of object stores and HDFS that Arrow knows. For stores that only Spark reads, and for
files packed by blocks, use ``splits.read_splits``.
"""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    CaseInsensitiveDict, DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from strandlake.functions import seq as S
from strandlake.sources import splits

#: record_index is a record's number in its split; splits are ordered by source_file and split_start.
FASTA_SCHEMA = "record_id string, description string, sequence string, source_file string, split_start long, record_index long"
FASTQ_SCHEMA = "read_id string, sequence string, quality string, plus string, source_file string, split_start long, record_index long"
#: Bases that one Arrow batch holds; a longer record is a batch of its own.
BATCH_BASES = 8 << 20


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: CaseInsensitiveDict, kind: str) -> None:
        self.options, self.kind = options, kind
        self.names = [f.name for f in schema.fields]
        if not options.get("path"):
            raise ValueError("load() needs a path")
        self.option = options.get("lenient" if kind == "fasta" else "strict", "false").lower() == "true"
        self.split_bytes = int(options.get("splitBytes", splits.SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return splits.ranges_of(splits.files_of(self.options["path"]), self.split_bytes)

    def read(self, partition: splits.FileRange) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        types = [pa.int64() if n in ("record_index", "split_start") else pa.string() for n in self.names]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], self.names)

        for record in splits.read_ranges(partition, self.kind, self.option):
            rows.append(record)
            held += sum(len(x) for x in record[:-2] if x)
            if held >= BATCH_BASES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class _Stream(_Reader, DataSourceStreamReader):
    """Files of a folder as they appear, in the order of (time of change, path). The offset is the last file's.

    A file counts once it hasn't changed for ``settleSeconds`` (2 by default), so that none is read half-written and none
    appears before the offset afterwards; files must not change later.
    """

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def _files(self) -> list[tuple[tuple[int, str], tuple[str, int, int]]]:
        return sorted(((changed, path), (path, size, changed)) for path, size, changed in splits.files_of(self.options["path"]))

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(float(self.options.get("settleSeconds", 2)) * 1e9)
        last = max((key for key, _ in self._files() if key[0] <= settled), default=(0, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = ((o["time"], o["path"]) for o in (start, end))
        return splits.ranges_of([file for key, file in self._files() if after < key <= until], self.split_bytes)

    def commit(self, end: dict) -> None:
        pass


class Written(WriterCommitMessage):
    """What a task has written: the file in the job's folder, and its records."""

    def __init__(self, name: str, records: int) -> None:
        self.name, self.records = name, records


class _Writer(DataSourceArrowWriter):
    """One file for each task, written to a folder of the job and moved to its place when all tasks are done.

    A task that fails deletes its file; a job that fails, its folder. Of a task that ran twice the committed file counts.
    Options: ``lineWidth`` (60; 0 for one line a sequence) and ``compress`` (true for gzip).
    """

    def __init__(self, schema: StructType, options: CaseInsensitiveDict, kind: str, overwrite: bool) -> None:
        missing = {"fasta": {"record_id", "sequence"}, "fastq": {"read_id", "sequence", "quality"}}[kind] - set(schema.names)
        if missing or not options.get("path"):
            raise ValueError(f"a column is missing: {', '.join(sorted(missing))}" if missing else "save() needs a path")
        self.path, self.kind, self.overwrite, self.job = splits.plain(options["path"]), kind, overwrite, uuid.uuid4().hex
        self.width = int(options.get("lineWidth", 60))
        self.packed = options.get("compress", "false").lower() == "true"

    @property
    def folder(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def _text(self, batch: pa.RecordBatch) -> Iterator[str]:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        nothing = [None] * batch.num_rows
        if self.kind == "fasta":
            for name, about, bases in zip(columns["record_id"], columns.get("description", nothing), columns["sequence"], strict=True):
                bases = bases or ""
                lines = [bases[i : i + self.width] for i in range(0, len(bases), self.width)] if self.width > 0 else [bases]
                yield "\n".join([f">{name} {about}" if about else f">{name}", *lines]) + "\n"
        else:
            for row in zip(columns["read_id"], columns["sequence"], columns.get("plus", nothing), columns["quality"], strict=True):
                if not row[1] or not row[3]:
                    raise ValueError(f"a FASTQ record can't be empty: {row[0]!r}")
                yield f"@{row[0]}\n{row[1]}\n{row[2] or '+'}\n{row[3]}\n"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = splits.store_of(self.folder)
        store.create_dir(folder)
        name, records = f"{uuid.uuid4().hex}.{self.kind}{'.gz' if self.packed else ''}", 0
        try:
            with store.open_output_stream(f"{folder}/{name}", compression="gzip" if self.packed else None) as out:
                for batch in iterator:
                    out.write("".join(self._text(batch)).encode("utf-8", "surrogatepass"))
                    records += batch.num_rows
        except BaseException:
            store.delete_file(f"{folder}/{name}")
            raise
        return Written(name, records)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = splits.store_of(self.path)
        _, folder = splits.store_of(self.folder)
        if self.overwrite:
            for info in store.get_file_info(pyarrow.fs.FileSelector(path)):
                if info.is_file:
                    store.delete_file(info.path)
        for k, message in enumerate(messages):
            if message is not None and message.records:
                store.move(f"{folder}/{message.name}", f"{path}/part-{k:05d}-{message.name}")
        store.delete_dir(folder)
        store.open_output_stream(f"{path}/_SUCCESS", compression=None).close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = splits.store_of(self.folder)
        if store.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(folder)


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options, "fasta")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options, "fasta")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, "fasta", overwrite)


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options, "fastq")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options, "fastq")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, "fastq", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaDataSource)
    spark.dataSource.register(FastqDataSource)


def read_fasta(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("fasta").option("lenient", str(lenient).lower()).load(path)


def read_fastq(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("fastq").option("strict", str(strict).lower()).load(path)


def count_reads(spark: SparkSession, path: str) -> DataFrame:
    """One row (reads): a fourth of the lines of FASTQ files, packed by gzip or not, with four lines to a record."""
    return spark.read.text(path).agg(F.floor(F.count("*") / 4).alias("reads"))


def zip_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(value): lines of the members whose path ends in ``member``, of each archive; none fails. An archive is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = [n for n in archive.namelist() if n.endswith(member)]
                    if not found:
                        raise FileNotFoundError(f"{member} in {name}")
                    for one in found:
                        with io.TextIOWrapper(archive.open(one), "utf-8") as lines:
                            while held := list(islice(lines, 1 << 16)):
                                yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in held])], ["value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "value string")


def read_fasta_text(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, description, sequence) by Spark's text reader: splits large files and reads any store.

    For clean files: headers start at the beginning of their lines.
    """
    blocks = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), F.col("value").startswith(">").alias("_first"))
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    head = F.trim(F.element_at(lines, 1))
    words = F.split(head, r"\s+", 2)
    sequence = F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda c: F.trim(c)), "")
    return blocks.where(head != "").select(F.element_at(words, 1).alias("record_id"), F.when(F.size(words) > 1, F.element_at(words, 2)).alias("description"), sequence.alias("sequence"))


def fasta_value(line_width: int = 60) -> Column:
    """A header line and the sequence in lines of ``line_width`` letters, or in one line for 0 or less."""
    body = F.regexp_replace("sequence", f"(.{{{line_width}}})(?=.)", "$1\n") if line_width > 0 else F.col("sequence")
    rest = F.when((F.length("sequence") > 0) | F.lit(line_width <= 0), F.concat(F.lit("\n"), body)).otherwise("")
    return F.concat(F.lit(">"), S.header("record_id", "description"), rest)


def fasta_lines(records: DataFrame, line_width: int = 60) -> DataFrame:
    """(value): the text of each record."""
    return records.select(fasta_value(line_width).alias("value"))


def write_fasta(records: DataFrame, path: str, line_width: int = 60) -> None:
    """A folder of text files, one for each partition."""
    fasta_lines(records, line_width).write.text(path)


def fastq_lines(reads: DataFrame) -> DataFrame:
    plus = F.coalesce(F.nullif(F.col("plus"), F.lit("")), F.lit("+")) if "plus" in reads.columns else F.lit("+")
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), F.col("sequence"), plus, F.col("quality")).alias("value"))


def write_fastq(reads: DataFrame, path: str) -> None:
    fastq_lines(reads).write.text(path)


def with_batches(records: DataFrame, batch_size: int) -> DataFrame:
    """Adds batch_id: records of one file in groups of ``batch_size``, in file order.

    Where records have a split_start, record_index becomes their number in the file: splits are counted first.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    if "split_start" in records.columns:
        counts = records.groupBy("source_file", "split_start").agg(F.count("*").alias("_n"))
        before = "sum(_n) OVER (PARTITION BY source_file ORDER BY split_start ROWS UNBOUNDED PRECEDING) - _n AS _before"
        placed = records.join(counts.selectExpr("source_file", "split_start", before), ["source_file", "split_start"])
        records = placed.withColumn("record_index", F.col("record_index") + F.col("_before")).select(records.columns)
    return records.withColumn("batch_id", F.floor(F.col("record_index") / batch_size).cast("long"))


def upload_summary(records: DataFrame) -> DataFrame:
    """One row: records, total_bases, and id, description and length of the first record; fails without records."""
    first = F.min_by(F.struct("record_id", "description", F.length("sequence").alias("length")), F.struct(*[c for c in ("source_file", "split_start", "record_index") if c in records.columns]))
    found = records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("total_bases"), first.alias("first"))
    return found.withColumn("records", F.when(F.col("records") > 0, F.col("records")).otherwise(F.raise_error(F.lit("no records")).cast("long")))


def validate_fasta(records: DataFrame, min_bases: int = 1000) -> DataFrame:
    """One row (total_bases); fails without a record or with fewer bases."""
    found = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("total_bases"))
    fails = (F.col("n") == 0) | (F.col("total_bases") < min_bases)
    return found.select(F.when(fails, F.raise_error(F.lit("not a FASTA file of sufficient length")).cast("long")).otherwise(F.col("total_bases")).alias("total_bases"))


def parse_reads(lines: DataFrame) -> DataFrame:
    """(sequence, start, strand) of lines "sequence,start[,strand]"; the strand is + by default."""
    parts = F.split(F.trim("value"), ",")
    part = lambda k: F.trim(F.get(parts, F.lit(k)))
    return lines.where(F.trim("value") != "").select(F.upper(part(0)).alias("sequence"), part(1).try_cast("int").alias("start"), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("+")).alias("strand"))


def parse_sequences(lines: DataFrame) -> DataFrame:
    return lines.select(F.upper(F.trim("value")).alias("sequence")).where("sequence <> ''")


def fragments(records: DataFrame, window: int, least: int = 21) -> DataFrame:
    """The columns of the records with sequence cut into neighbouring windows of at least ``least`` bases."""
    others = [c for c in records.columns if c != "sequence"]
    return records.select(*others, F.explode(S.tiles("sequence", window)).alias("_w")).select(*others, F.col("_w.start").alias("fragment_start"), F.col("_w.tile").alias("sequence")).where(F.length("sequence") >= least)


def simulate_reads(references: DataFrame, num_reads: int, read_length: int, error_rate: float = 0.01, snvs: dict[int, str] | None = None, seed: int = 1) -> DataFrame:
    """(ref_id, read_idx, sequence, start, strand, quality): random starts, planted SNVs, else random errors; Phred 30 to 40.

    Random numbers are hashes of the read and the place, so results don't depend on partitions.
    """
    drawn = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30)) / float(1 << 30)
    reads = references.where(F.length("sequence") >= read_length).select("ref_id", "sequence", F.explode(F.sequence(F.lit(0), F.lit(num_reads - 1))).alias("read_idx"))
    reads = reads.withColumn("start", F.floor(drawn(F.col("ref_id"), F.col("read_idx"), F.lit("s")) * (F.length("sequence") - read_length + 1)).cast("int"))
    letters = F.transform(S.letters(S.piece(F.col("sequence"), F.col("start") + 1, read_length)), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    planted = F.create_map(*[x for p, b in (snvs or {}).items() for x in (F.lit(p), F.lit(b))]) if snvs else None

    def base(x):
        place = F.col("start") + x["i"]
        draw = drawn(F.col("ref_id"), F.col("read_idx"), x["i"], F.lit("e"))
        others = F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: b != F.upper(x["c"]))
        other = F.get(others, F.floor(drawn(F.col("ref_id"), F.col("read_idx"), x["i"], F.lit("b")) * 3).cast("int"))
        wrong = F.when(draw < error_rate, other).otherwise(x["c"])
        return F.coalesce(F.try_element_at(planted, place), wrong) if planted is not None else wrong

    quality = F.transform(letters, lambda x: F.char(F.lit(63) + F.floor(drawn(F.col("ref_id"), F.col("read_idx"), x["i"], F.lit("q")) * 11).cast("int")))
    return reads.select("ref_id", "read_idx", F.array_join(F.transform(letters, base), "").alias("sequence"), "start", F.lit("+").alias("strand"), F.array_join(quality, "").alias("quality"))
