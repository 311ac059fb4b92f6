"""An offset index of FASTA files, and reading parts of records without reading the rest.

A row of the index is a run of lines with equally many bases, of at most TILE bases: where it starts in its record and in its
file. So files with any line lengths can be indexed, a chromosome is many rows, and the place of each base is arithmetic.
The index is a Parquet table in the order of records, so its row groups tell which records they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    CaseInsensitiveDict, DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from strandlake.sources import splits

TILE = 1 << 20
INDEX = "record_id string, start long, bases long, offset long, line_bases long, line_width long, source_file string"
BASES = "record_id string, start long, end long, sequence string, source_file string, read_bytes long"


def runs_of(part: splits.FileRange, tile: int) -> Iterator[tuple]:
    """The index rows of the records that begin in a range."""
    if part.end < 0:
        raise ValueError(f"a packed file has no offsets to go to: {part.path}")
    with splits.opened(part.path) as file:
        at, end = splits.first_record(file, part.start, "fasta"), splits.first_record(file, part.end, "fasta")
        file.seek(at)
        name, place, run, closed = None, 0, None, False
        while at < end and (line := file.readline()):
            bases = line.strip()
            if bases.startswith(b">"):
                if run:
                    yield (name, *run, part.path)
                words = bases[1:].split(None, 1)
                if not words:
                    raise ValueError("a header without an id")
                name, place, run, closed = words[0].decode(), 0, None, False
            elif bases and name is not None:
                n, plain = len(bases), line.startswith(bases)
                # [start, bases, offset, line_bases, line_width]
                if run and not closed and plain and n <= run[3] and run[1] + n <= tile and at == run[2] + run[1] // run[3] * run[4]:
                    run[1] += n
                else:
                    if run:
                        yield (name, *run, part.path)
                    run = [place, n, at + line.index(bases), n, len(line)]
                closed = not plain or n < run[3]
                place += n
            at += len(line)
        if run:
            yield (name, *run, part.path)


class _IndexReader(DataSourceReader):
    def __init__(self, options: CaseInsensitiveDict) -> None:
        self.path, self.tile = options["path"], int(options.get("tile", TILE))
        self.split_bytes = int(options.get("splitBytes", splits.SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return splits.ranges_of(splits.files_of(self.path), self.split_bytes)

    def read(self, partition: splits.FileRange) -> Iterator[tuple]:
        return runs_of(partition, self.tile)


class FastaIndexDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IndexReader(self.options)


class IndexPart(InputPartition):
    def __init__(self, path: str, group: int) -> None:
        self.path, self.group = path, group


def bytes_of(run: dict, start: int, end: int) -> tuple[int, int]:
    """Offset and number of the bytes of the bases from ``start`` to before ``end`` of the record, which lie in the run."""
    at = [run["offset"] + (p - run["start"]) // run["line_bases"] * run["line_width"] + (p - run["start"]) % run["line_bases"] for p in (start, end - 1)]
    return at[0], at[1] + 1 - at[0]


def read_run(file, run: dict, start: int, end: int) -> tuple[str, int]:
    """The bases of a part of a run, and how many bytes were read for it."""
    offset, n = bytes_of(run, start, end)
    file.seek(offset)
    data = file.read(n)
    return data.translate(None, b"\r\n").decode(), len(data)


class _BasesReader(DataSourceReader):
    """Reads what filters on record_id, start and end leave. Index rows are left out by the statistics of their row groups on
    the driver, which reads only footers, and one by one in the tasks; ``from`` and ``to`` cut runs before they are read."""

    def __init__(self, options: CaseInsensitiveDict) -> None:
        self.index = options["path"]
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 1 << 62))
        self.records: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, (EqualTo, In)) and column == ("record_id",):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.records = wanted if self.records is None else self.records & wanted
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == ("start",):
                self.before = min(getattr(self, "before", 1 << 62), value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == ("end",):
                self.after = max(getattr(self, "after", 0), value - isinstance(f, GreaterThanOrEqual))
            yield f  # what is pushed leaves out runs only; Spark decides on rows

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, _, _ in splits.files_of(self.index):
            with splits.opened(path) as file:
                footer = pyarrow.parquet.ParquetFile(file).metadata
            names = [footer.schema.column(i).name for i in range(footer.num_columns)]
            for g in range(footer.num_row_groups):
                stats = footer.row_group(g).column(names.index("record_id")).statistics
                if self.records is None or stats is None or not stats.has_min_max or any(stats.min <= r <= stats.max for r in self.records):
                    found.append(IndexPart(path, g))
        return found

    def read(self, partition: IndexPart) -> Iterator[pa.RecordBatch]:
        with splits.opened(partition.path) as file:
            rows = pyarrow.parquet.ParquetFile(file).read_row_group(partition.group)
        before, after = min(self.high, getattr(self, "before", 1 << 62)), max(self.low, getattr(self, "after", 0))
        held, path = None, None
        names = [f.split()[0] for f in BASES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        try:
            for batch in rows.to_batches(1 << 16):
                for run in batch.to_pylist():
                    start, end = max(run["start"], self.low), min(run["start"] + run["bases"], self.high)
                    if (self.records is not None and run["record_id"] not in self.records) or start >= end or run["start"] >= before or run["start"] + run["bases"] <= after:
                        continue
                    if run["source_file"] != path:
                        if held:
                            held.close()
                        path = run["source_file"]
                        store, at = splits.store_of(path)
                        held = store.open_input_file(at)  # unbuffered: no byte is read that isn't asked for
                    text, n = read_run(held, run, start, end)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((run["record_id"], start, end, text, path, n), types, strict=True)], names)
        finally:
            if held:
                held.close()


class FastaBasesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_bases"

    def schema(self) -> str:
        return BASES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BasesReader(self.options)


def build_index(spark: SparkSession, path: str, index: str, tile: int = TILE, split_bytes: int = splits.SPLIT_BYTES) -> None:
    """Write the index of the FASTA files at ``path`` to ``index``, read in ranges and written in the order of records."""
    spark.dataSource.register(FastaIndexDataSource)
    rows = spark.read.format("fasta_index").option("tile", tile).option("splitBytes", split_bytes).load(path)
    rows.repartitionByRange("record_id", "start").sortWithinPartitions("record_id", "start").write.parquet(index)


def record_lengths(index: DataFrame) -> DataFrame:
    """(record_id, length, runs)."""
    return index.groupBy("record_id").agg(F.sum("bases").alias("length"), F.count("*").alias("runs"))


def read_bases(spark: SparkSession, index: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(record_id, start, end, sequence, source_file, read_bytes): runs of the records, in full or from ``start`` to ``end``.

    Filters on record_id and on start and end are applied before bases are read; read_bytes counts what was read for a row.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaBasesDataSource)
    source = spark.read.format("fasta_bases")
    if start is not None:
        source = source.option("from", start)
    if end is not None:
        source = source.option("to", end)
    return source.load(index)


def read_intervals(spark: SparkSession, index: str, wanted: DataFrame, tile: int = TILE) -> DataFrame:
    """The bases of many intervals: ``wanted`` (record_id, start, end, ...) with sequence and read_bytes.

    An interval meets the runs that it overlaps under its record and the tiles it touches, and each task reads its parts'
    bytes alone. Intervals are cut at the record's ends; those without a base, or of an unknown record, are left out. Each
    row of ``wanted`` counts, repeated ones too.
    """
    numbered = wanted.where("start < end AND end > 0").select(F.struct(*(F.col(f"`{c}`") for c in wanted.columns)).alias("row"), F.monotonically_increasing_id().alias("number"))
    low, high = F.greatest(F.col("row.start"), F.lit(0)), F.col("row.end")
    asked = numbered.select("row", "number", F.explode(F.sequence(F.floor(low / tile), F.floor((high - 1) / tile))).alias("tile"), F.col("row.record_id").alias("record_id"))
    last = F.col("start") + F.col("bases") - 1
    runs = spark.read.parquet(index).select("*", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor(last / tile))).alias("tile"))
    met = asked.join(runs, ["record_id", "tile"])
    begin, end = F.greatest(low, F.col("start")), F.least(high, F.col("start") + F.col("bases"))
    # a run and an interval may meet under two tiles; the one in which their common part begins counts
    parts = met.select("row", "number", begin.alias("begin"), end.alias("stop"), "tile", "start", "bases", "offset", "line_bases", "line_width", "source_file").where((F.col("begin") < F.col("stop")) & (F.floor(F.col("begin") / tile) == F.col("tile")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, None
        for batch in batches:
            found = []
            for r in batch.select(["begin", "stop", "start", "bases", "offset", "line_bases", "line_width", "source_file"]).to_pylist():
                if r["source_file"] != path:
                    path = r["source_file"]
                    store, at = splits.store_of(path)
                    held = store.open_input_file(at)
                found.append(read_run(held, r, r["begin"], r["stop"]))
            columns = [batch.column("number"), batch.column("begin"), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["number", "begin", "text", "n"])

    read = parts.sortWithinPartitions("source_file", "offset").drop("row").mapInArrow(run, "number long, begin long, text string, n long")
    whole = read.groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]), "").alias("sequence"), F.sum("n").alias("read_bytes"))
    return numbered.join(whole, "number").select(*[F.col("row").getField(c).alias(c) for c in wanted.columns], "sequence", "read_bytes")
