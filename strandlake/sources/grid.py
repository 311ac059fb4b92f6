"""Tables of cells: CSV, TSV, text and Excel files as rows (row_idx, cells array<string>).

Cells are stripped, rows without any content dropped, and rows padded to the widest. Whether there is a header, and which
columns are numbers, is for ``operators.prep`` to find out.
"""

from __future__ import annotations

import csv
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, EXCEL = (".csv", ".tsv", ".txt"), (".xlsx", ".xlsm")
#: Rows of a file: the split they are in, their number in it, their cells, and whether a cell goes on over the line's end.
CELLS = "split long, n long, cells array<string>, several boolean"


def sniff_delimiter(line: str) -> str:
    """The most frequent of comma, semicolon and tab; of equals the first of these."""
    return max(",;\t", key=lambda d: (line.count(d), -",;\t".index(d)))


def text_rows(data: bytes) -> list[list[str]]:
    lines = [x for x in data.decode("utf-8-sig").splitlines() if x.strip()]
    return list(csv.reader(io.StringIO("\n".join(lines)), delimiter=sniff_delimiter(lines[0]))) if lines else []


def excel_rows(data: bytes) -> list[list[str]]:
    """Values of the active sheet of a workbook, as text."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = [("".join(t.text or "" for t in s.iter(f"{{{space['m']}}}t"))) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", space)] if "xl/sharedStrings.xml" in names else []
        workbook = ET.fromstring(book.read("xl/workbook.xml"))
        view = workbook.find("m:bookViews/m:workbookView", space)
        sheets = workbook.findall("m:sheets/m:sheet", space)
        active = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[active.get(relation)]
        sheet = ET.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in sheet.findall("m:sheetData/m:row", space):
        cells: list[str] = []
        for c in row.findall("m:c", space):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            value, kind = c.find("m:v", space), c.get("t")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t"))
            elif value is None or value.text is None:
                text = ""
            else:
                text = shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else value.text
            while len(cells) < at - 1:
                cells.append("")
            cells.append(text)
        rows.append(cells)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["split", "n", "cells", "several"])


def line_cells(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Rows of a text file's splits, line by line; ``several`` where a quoted cell goes on over the line's end."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = None, 0
        for batch in batches:
            out = []
            for at, text in zip(batch.column("split").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if at != split:
                    split, n, text = at, 0, text.removeprefix("\ufeff") if at == 0 else text
                for line in text.splitlines():
                    if not line.strip():
                        continue
                    parsed = list(csv.reader([line, ""], delimiter=delimiter))  # an open cell takes the second line in
                    cells = [c.strip() for c in parsed[0]]
                    if any(cells):
                        out.append((split, n, cells, len(parsed) < 2))
                        n += 1
            yield _batch(out)

    return lines.mapInArrow(run, CELLS)


def whole_cells(spark: SparkSession, path: str, excel: bool) -> DataFrame:
    """The rows of a file that is parsed as a whole, in one task: a workbook, or a text with cells over several lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = [[c.strip() for c in r] for r in (excel_rows if excel else text_rows)(content)]
                kept = [r for r in rows if any(r)]
                for at in range(0, len(kept), 10_000):
                    yield _batch([(0, at + k, r, False) for k, r in enumerate(kept[at : at + 10_000])])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CELLS)


def load_grid(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, cells) of one file. An unknown suffix or a file without rows is an error.

    Lines of a text are parsed where its splits are read, with the delimiter of its first line; the driver sees the number of
    rows and the width of each split. A workbook, and a text with quoted line ends, is one task.
    """
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in TEXT + EXCEL:
        raise ValueError(f"unsupported file type {suffix!r}; one of {TEXT + EXCEL}")
    rows = whole_cells(spark, path, True)
    if suffix in TEXT:
        first = spark.read.text(path).where(F.trim(F.replace("value", F.lit("\ufeff"), F.lit(""))) != "").first()
        rows = line_cells(spark, path, sniff_delimiter(first.value if first else ""))
    facts = lambda r: r.groupBy("split").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("width"), F.bool_or("several").alias("several")).orderBy("split").collect()
    found = facts(rows)
    if any(f.several for f in found):
        rows = whole_cells(spark, path, False)
        found = facts(rows)
    if not found:
        raise ValueError("the file has no rows")
    ends = np.cumsum([f.rows for f in found]).tolist()
    offsets = F.broadcast(spark.createDataFrame([(f.split, end - f.rows) for f, end in zip(found, ends, strict=True)], "split long, before long"))  # a row for each split
    width = max(f.width for f in found)
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.lit(width) - F.size("cells")))
    return rows.join(offsets, "split").select((F.col("before") + F.col("n")).alias("row_idx"), padded.alias("cells"))


def parse_dosage_lines(lines: DataFrame, order: str = "line") -> DataFrame:
    """(line, phenotype, dosages) of strict lines "phenotype,dose,...": equal widths of 3 or more, doses blank or na for missing."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    kept = lines.where(F.trim("value") != "").select(order, cells.alias("cells"))
    width = kept.agg(F.size(F.min_by("cells", order)).alias("_w"))
    fail = lambda what: F.raise_error(F.lit(what)).cast("double")
    number = lambda c, what: F.coalesce(c.try_cast("double"), fail(what))
    checked = kept.crossJoin(width).withColumn(  # one row
        "_ok", F.when((F.size("cells") != F.col("_w")) | (F.col("_w") < 3), fail("lines must have equal widths of at least 3")).otherwise(0.0)
    )
    dose = lambda c: F.when((c == "") | (F.lower(c) == "na"), F.lit(None).cast("double")).otherwise(number(c, "not a dosage"))
    return checked.where("_ok = 0").select(order, number(F.element_at("cells", 1), "not a phenotype").alias("phenotype"), F.transform(F.slice("cells", F.lit(2), F.col("_w") - 1), dose).alias("dosages"))


def sample_traits(spark: SparkSession, individuals: int = 60, markers: int = 30, heritability: float = 0.5, seed: int = 42) -> DataFrame:
    """(value): made-up lines "phenotype,dose,..." for ``parse_dosage_lines``.

    Doses are 0, 1 or 2 by two draws against a marker's frequency; the phenotype is the doses' sum of effects and noise, of
    which about ``heritability`` is due to the effects. Draws are hashes, so results don't depend on partitions.
    """
    drawn = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(1 << 30)) / float(1 << 30)
    normal = lambda *x: F.sqrt(-2 * F.log(1 - drawn(*x, F.lit("r")))) * F.cos(2 * np.pi * drawn(*x, F.lit("a")))
    person, numbers = F.col("id"), F.sequence(F.lit(0), F.lit(markers - 1))
    share = lambda m: 0.1 + 0.8 * drawn(m, F.lit("p"))
    dose = lambda m: sum((drawn(person, m, F.lit(k)) < share(m)).cast("int") for k in (0, 1))
    each = F.transform(numbers, lambda m: F.struct(dose(m).alias("dose"), (2 * share(m)).alias("mean"), normal(m, F.lit("e")).alias("effect"), (2 * share(m) * (1 - share(m))).alias("spread")))
    total = lambda f: F.aggregate(F.transform("each", f), F.lit(0.0), lambda a, x: a + x)
    genetic, variance = total(lambda e: (e["dose"] - e["mean"]) * e["effect"]), total(lambda e: e["spread"] * e["effect"] * e["effect"])
    noise = normal(person, F.lit("n")) * float(np.sqrt(1 - heritability))
    value = 10 + genetic / F.sqrt(variance) * float(np.sqrt(heritability)) + noise
    made = spark.range(individuals).select("id", each.alias("each")).select("id", F.round(value, 3).alias("y"), F.transform("each", lambda e: e["dose"].cast("string")).alias("doses"))
    return made.select(F.concat_ws(",", F.col("y").cast("string"), F.array_join("doses", ",")).alias("value"))
