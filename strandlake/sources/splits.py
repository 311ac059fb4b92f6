"""Where records begin in the middle of a file, and records read from splits of files.

A FASTA record begins at a line with >. In a FASTQ a quality may begin with @ too, so a split is read in all ways that
are possible from its first line on, side by side: each keeps what it expects next and how long the sequence is, and
ends where it would be an error. The first header that all remaining ways agree on begins a record. What comes before
belongs to the record that an earlier split leaves open.

``read_ranges`` serves the data sources, for stores that Python opens: a range goes on to the first record of the next.
``read_splits`` reads by Spark's text reader, so from any store of its own: splits give their complete records, and the
open ends and beginnings at their borders are put together by file.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

FIELDS = {"fasta": ("record_id", "description", "sequence"), "fastq": ("read_id", "sequence", "quality", "plus")}
#: Bytes of a file that a data source's partition begins in, by default.
SPLIT_BYTES = 64 << 20
#: Ranges above which these become longer than was asked for.
MOST_RANGES = 1 << 10
#: What begins each member of a file packed by blocks; the member's length follows.
BLOCK_MAGIC = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
BLOCKED = (".bgz", ".bgzf")
#: What a FASTQ line can be: a header or more quality, a sequence, a plus, a quality; a header or a blank.
NEXT, SEQUENCE, PLUS, QUALITY, BETWEEN = range(5)


def fasta_records(lines: Iterator[str], lenient: bool = False) -> Iterator[tuple[str, str | None, str]]:
    """(id, description, sequence). What comes before the first header is left out; a header without an id is an error.

    If ``lenient``, a record without an id is left out, and a description's runs of blanks become one.
    """
    head, body = None, []
    for line in lines:
        if line.startswith(">"):
            if head is not None:
                yield (*head, "".join(body))
            words = line[1:].strip().split(None, 1)
            if lenient and not words:
                head, body = None, []
                continue
            if not words:
                raise ValueError("a header without an id")
            if lenient:
                words[1:] = [" ".join(w.split()) for w in words[1:]]
            head, body = (words[0], words[1] if len(words) > 1 else None), []
        elif line and head is not None:
            body.append(line)
    if head is not None:
        yield (*head, "".join(body))


def fastq_records(lines: Iterator[str], strict: bool = False) -> Iterator[tuple[str, str, str, str]]:
    """(id, sequence, quality, plus). Lines after a record that don't start with @ go on with its quality.

    Blank lines between records are skipped, or an error if ``strict``.
    """
    ended = object()
    line = next(lines, ended)
    while line is not ended:
        if not line and not strict:
            line = next(lines, ended)
            continue
        if not line.startswith("@"):
            raise ValueError(f"a record must start with @: {line[:40]!r}")
        name = (line[1:].split() or [""])[0]
        sequence, plus, quality = (next(lines, ended) for _ in range(3))
        if quality is ended or not sequence or not quality:
            raise ValueError(f"record {name!r} is incomplete")
        line = next(lines, ended)
        while line is not ended and line and not line.startswith("@"):
            quality += line
            line = next(lines, ended)
        if len(sequence) != len(quality):
            raise ValueError(f"record {name!r}: {len(sequence)} bases and {len(quality)} qualities")
        yield name, sequence, quality, plus


def parsed(lines: Iterator[str], kind: str, option: bool) -> Iterator[tuple]:
    """``option`` is ``lenient`` for FASTA and ``strict`` for FASTQ."""
    return fasta_records(lines, option) if kind == "fasta" else fastq_records(lines, option)


class Search:
    """Finds the first line that begins a record, given stripped lines from anywhere in a file."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        #: (what is expected, bases of the open record or -1 where unknown, qualities so far)
        self.ways = {(NEXT, -1, 0), (SEQUENCE, -1, 0), (PLUS, -1, 0), (QUALITY, -1, 0)}

    def begins(self, line: str) -> bool:
        if self.kind == "fasta":
            return line.startswith(">")
        self.ways = {w for w in (self._after(way, line) for way in self.ways) if w}
        return self.ways == {(SEQUENCE, -1, 0)} and line.startswith("@")

    def _after(self, way: tuple[int, int, int], line: str) -> tuple[int, int, int] | None:
        state, bases, scores = way
        if state == SEQUENCE:
            return (PLUS, len(line), 0) if line else None
        if state == PLUS:
            return QUALITY, bases, 0
        if state == QUALITY:
            fits = line and (bases < 0 or len(line) <= bases)
            return (NEXT, bases, len(line)) if fits else None
        whole = bases < 0 or bases == scores
        if not line:
            return (BETWEEN, -1, 0) if whole else None
        if line.startswith("@"):
            return (SEQUENCE, -1, 0) if whole else None
        fits = state == NEXT and (bases < 0 or scores + len(line) <= bases)
        return (NEXT, bases, scores + len(line)) if fits else None


# ------------------------------------------------------------------------------ ranges of files that Python opens


class FileRange(InputPartition):
    """The records that begin from ``start`` to before ``end``; ``end`` -1 is a whole file, as packed ones are read."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def plain(path: str) -> str:
    """A path without the scheme of local files, in whichever form it is written."""
    return re.sub("^file:/+", "/", path.strip())


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = plain(path)
    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def files_of(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files that a comma-separated list names, in order; hidden ones in folders
    are left out."""
    found = []
    for one in path.split(","):
        one = plain(one)
        store, at = store_of(one)
        info = store.get_file_info(at)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(one)
        prefix = one[: len(one) - len(at)] if one.endswith(at) else ""
        if info.type == pyarrow.fs.FileType.Directory:
            each = [i for i in store.get_file_info(pyarrow.fs.FileSelector(at)) if i.is_file and i.base_name[0] not in "._"]
        else:
            each = [info]
        found += sorted((prefix + i.path, i.size, i.mtime_ns or 0) for i in each)
    return found


def ranges_of(files: list[tuple[str, int, int]], split_bytes: int = SPLIT_BYTES) -> list[FileRange]:
    """Ranges of about ``split_bytes``, or of as many as keep them to about ``MOST_RANGES``, though not more than ``SPLIT_BYTES``
    for that; packed files are whole. A range is a task, which has its cost however short it is."""
    found = []
    split_bytes = max(split_bytes, min(SPLIT_BYTES, -(-sum(size for _, size, _ in files) // MOST_RANGES)))
    for path, size, _ in files:
        if path.endswith((".gz", *BLOCKED)):
            found.append(FileRange(path, 0, -1))
        else:
            found += [FileRange(path, a, min(size, a + split_bytes)) for a in range(0, max(size, 1), max(1, split_bytes))]
    return found


def opened(path: str) -> io.BufferedReader:
    store, at = store_of(path)
    return io.BufferedReader(store.open_input_file(at), 1 << 20)


def first_record(file: io.BufferedReader, offset: int, kind: str) -> int:
    """Where the first record begins that begins at ``offset`` or later; the file's end if there is none."""
    if offset == 0:
        return 0
    file.seek(offset - 1)
    at = offset - 1 + len(file.readline())
    search = Search(kind)
    while line := file.readline():
        if search.begins(line.decode("utf-8", "replace").strip()):
            return at
        at += len(line)
    return at


def range_lines(part: FileRange, kind: str) -> Iterator[str]:
    """The stripped lines of a range's records."""
    if part.end < 0:
        with gzip.open(opened(part.path), "rt", encoding="utf-8") as lines:
            yield from (line.strip() for line in lines)
        return
    with opened(part.path) as file:
        start, end = first_record(file, part.start, kind), first_record(file, part.end, kind)
        file.seek(start)
        while start < end and (line := file.readline()):
            start += len(line)
            yield line.decode("utf-8").strip()


def read_ranges(part: FileRange, kind: str, option: bool) -> Iterator[tuple]:
    """(fields of the record, path, start of the range, number in the range)."""
    for index, record in enumerate(parsed(range_lines(part, kind), kind, option)):
        yield (*record, part.path, part.start, index)


# ------------------------------------------------------------------------------ splits by Spark's text reader


class Split:
    """One split's lines: gives its complete records; keeps what comes before the first and the open last one."""

    def __init__(self, kind: str, option: bool, at_start: bool) -> None:
        self.kind, self.option = kind, option
        self.found, self.search = at_start, Search(kind)
        self.head, self.open, self.n = [], [], 0

    def feed(self, lines: list[str]) -> Iterator[tuple]:
        at = 0
        while not self.found and at < len(lines):
            self.found = self.search.begins(lines[at])
            if not self.found:
                self.head.append(lines[at])
                at += 1
        mark, least = (">", 1) if self.kind == "fasta" else ("@", 4)
        for line in lines[at:]:
            if line.startswith(mark) and len(self.open) >= least:
                yield from self._records(self.open)
                self.open = [line]
            elif line or self.open or self.option:  # no blanks before the first header, unless they are errors
                self.open.append(line)

    def _records(self, lines: list[str]) -> Iterator[tuple]:
        for record in parsed(iter(lines), self.kind, self.option):
            yield (*record, self.n)
            self.n += 1

    def ends(self, last: str) -> tuple[str, str | None, int]:
        """Text before the first record, from the last one on (null if none begins here), and the complete records' number.
        ``last`` is a line that goes on in the next split, after the others."""
        head, tail = ("".join(f"{x}\n" for x in lines) for lines in (self.head, self.open))
        return (head, tail + last, self.n) if self.found else (head + last, None, self.n)


def unpacked(block: bytes) -> bytes:
    """The data of one member of a file packed by blocks, given what follows its magic."""
    if not block:
        return b""
    size = int.from_bytes(block[:2], "little") + 1
    if len(block) + len(BLOCK_MAGIC) != size:
        raise ValueError("a block of another length than it says")
    data = zlib.decompress(block[2:-8], -15)
    if zlib.crc32(data) != int.from_bytes(block[-8:-4], "little"):
        raise ValueError("a block's checksum differs")
    return data


def _parts(spark: SparkSession, path: str, kind: str, option: bool, borders: bool) -> DataFrame:
    """The complete records of all splits, or what they leave open at their borders."""
    blocked = all(p.strip().endswith(BLOCKED) for p in path.split(","))
    source = spark.read.option("lineSep", BLOCK_MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1") if blocked else spark.read
    value = F.col("value").cast("binary") if blocked else F.col("value")
    lines = source.text([p.strip() for p in path.split(",")]).select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    fields = FIELDS[kind]
    names = ["file", "split", "head", "tail", "n"] if borders else [*fields, "file", "split", "n"]
    types = [pa.int64() if c in ("split", "n") else pa.string() for c in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split, carry, rows, size = None, None, b"", [], 0

        def finished() -> Iterator[tuple]:
            last = carry.decode("utf-8")
            if last and split.found:  # a header that is cut off still ends the record before it
                mark, least = (">", 1) if kind == "fasta" else ("@", 4)
                if last.startswith(mark) and len(split.open) >= least:
                    yield from ((*r[:-1], *held, r[-1]) for r in split._records(split.open) if not borders)
                    split.open = []
            if borders:
                yield (*held, *split.ends(last))

        for batch in batches:
            if not batch.num_rows:
                continue
            files, splits = batch.column("file").to_pylist(), batch.column("split").to_pylist()
            at = 0
            while at < batch.num_rows:
                to = at + 1
                while to < batch.num_rows and splits[to] == splits[at] and files[to] == files[at]:
                    to += 1
                if held != (files[at], splits[at]):
                    if held:
                        rows += finished()
                    held, carry = (files[at], splits[at]), b""
                    split = Split(kind, option, held[1] == 0)
                    fresh = blocked and held[1] != 0
                part = batch.column("value").slice(at, to - at)
                if blocked:
                    *whole, carry = (carry + b"".join(map(unpacked, part.to_pylist()))).split(b"\n")
                    text = [w.decode("utf-8") for w in whole]
                    if fresh and text:  # the rest of a line that begins in the split before
                        split.head.append(text.pop(0).rstrip("\r"))
                        fresh = False
                    text = [t.strip() for t in text]
                else:
                    text = pc.utf8_trim_whitespace(part).to_pylist()
                found = [(*r[:-1], *held, r[-1]) for r in split.feed(text)]
                if not borders:
                    rows += found
                size += sum(map(len, text))
                at = to
            if rows and size >= 8 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        if held:
            rows += finished()
        if rows:
            yield batch_of(rows)

    return lines.mapInArrow(run, ", ".join(f"{c} {'long' if c in ('split', 'n') else 'string'}" for c in names))


def read_splits(spark: SparkSession, path: str, kind: str, option: bool = False) -> DataFrame:
    """The records of FASTA or FASTQ files, in parallel within files, from any store that Spark reads.

    Columns as those of the data sources: the record's, source_file, split_start and record_index, its number in the split.
    Files ending in .gz are one split; those packed by blocks, .bgz or .bgzf, are split between blocks, and a list has
    either all or none of these. A record is an error exactly where it is one for a reader of the whole file.
    The text is read twice, once for the records inside splits and once for what is open at their borders.
    """
    fields = FIELDS[kind]
    borders = _parts(spark, path, kind, option, borders=True)
    # the split that a beginning goes on from: the last one before in which a record begins
    owned = borders.selectExpr("*", "last(CASE WHEN tail IS NOT NULL THEN split END, true) OVER (PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    pieces = owned.where("tail IS NOT NULL").selectExpr("file", "split AS owner", "split", "tail AS text", "n").unionByName(
        owned.where("head <> ''").selectExpr("file", "coalesce(before, 0) AS owner", "split", "head AS text", "CAST(NULL AS BIGINT) AS n")
    )
    order = F.struct("split", F.col("n").isNull().alias("rest"), "text")
    joined = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(order)).alias("texts"), F.max("n").alias("n"))
    names = [*fields, "file", "split", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lines = "".join(t["text"] for t in r["texts"]).removesuffix("\n").split("\n")
                rows = [(*x, r["file"], r["owner"], r["n"] + i) for i, x in enumerate(parsed((line.strip() for line in lines if line or len(lines) > 1), kind, option))]
                types = [pa.int64() if c in ("split", "n") else pa.string() for c in names]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = ", ".join(f"{c} {'long' if c in ('split', 'n') else 'string'}" for c in names)
    found = _parts(spark, path, kind, option, borders=False).unionByName(joined.select("file", "owner", "texts", "n").mapInArrow(run, schema))
    return found.select(*fields, F.col("file").alias("source_file"), F.col("split").alias("split_start"), F.col("n").alias("record_index"))
