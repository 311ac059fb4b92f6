"""Cleaning of phenotype and genotype tables: cells in, long genotypes and a report out.

The first column is the phenotype. Columns, rows and imputation are decided by aggregations over (row, column, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources import grid

# Texts that mean a missing cell, in lower case.
MISSING = ("", "na", "nan", "null", "none", "-", "nd")
METHODS = {"mean": "mean", "media": "mean", "mode": "mode", "moda": "mode"}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_missing(cell: Column) -> Column:
    return F.coalesce(F.lower(F.trim(cell)).isin(*MISSING), F.lit(True))


def to_number(cell: Column) -> Column:
    """A finite decimal number, with a comma as its point if there is nothing but digits around it; else null."""
    text = F.trim(cell)
    pointed = F.when(text.rlike(r"^-?\d+,\d+$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)
    return F.when(~is_missing(cell) & pointed.rlike(NUMBER), pointed.try_cast("double"))


def is_bad(cell: Column) -> Column:
    """Neither missing nor a number."""
    return ~is_missing(cell) & to_number(cell).isNull()


def header_of(cells: DataFrame) -> tuple[bool, list[str]]:
    """Whether the first row has a cell that is bad, and the columns' names."""
    first = cells.orderBy("row_idx").limit(1).select("cells", F.exists("cells", is_bad).alias("bad")).first()
    names = [n if first.bad and n else f"col_{k + 1}" for k, n in enumerate(first.cells)]
    return bool(first.bad), names


def long_cells(cells: DataFrame, skip_first: bool) -> DataFrame:
    """(row_idx, col, value, bad) of the body."""
    body = cells.join(cells.agg(F.min("row_idx").alias("_first")), F.col("row_idx") > F.col("_first")) if skip_first else cells
    each = body.select("row_idx", F.posexplode("cells").alias("col", "cell"))
    return each.select("row_idx", "col", to_number(F.col("cell")).alias("value"), is_bad(F.col("cell")).alias("bad"))


def kept_markers(long: DataFrame) -> DataFrame:
    """(col, kept): markers with a number and no bad cell, over all rows, also those that go for want of a phenotype."""
    return long.where("col > 0").groupBy("col").agg(((F.count("value") > 0) & ~F.bool_or("bad")).alias("kept"))


def impute(genotypes: DataFrame, method: str = "mean") -> DataFrame:
    """(individual, marker, dosage, imputed): missing dosages are the mean of the marker's, or the most common; of equals the least.

    A marker without any dosage stays missing.
    """
    if method not in METHODS:
        raise ValueError(f"impute_method: one of {sorted(METHODS)}")
    clean = genotypes.select("individual", "marker", F.nanvl(F.col("dosage").cast("double"), F.lit(None).cast("double")).alias("dosage"))
    fill = F.avg("dosage") if METHODS[method] == "mean" else F.mode("dosage", True)
    fills = clean.groupBy("marker").agg(fill.alias("_fill"))
    filled = clean.join(fills, "marker").select("individual", "marker", F.coalesce("dosage", "_fill").alias("dosage"), (F.col("dosage").isNull() & F.col("_fill").isNotNull()).alias("imputed"))
    return filled


def numbered(rows: DataFrame, order: str, out: str, span: int = 1 << 16) -> DataFrame:
    """Adds ``out``: numbers from 0 in the order of a column of unique integers, counted within spans of it."""
    dealt = rows.withColumn("_span", F.expr(f"`{order}` div {span}"))
    counts = dealt.groupBy("_span").agg(F.count("*").alias("_n"))  # a row for each span
    before = counts.selectExpr("_span", "sum(_n) OVER (ORDER BY _span ROWS UNBOUNDED PRECEDING) - _n AS _before")
    return dealt.join(before, "_span").selectExpr("*", f"row_number() OVER (PARTITION BY _span ORDER BY `{order}`) - 1 + _before AS {out}").drop("_span", "_before")


def preprocess(cells: DataFrame, impute_method: str = "mean", file_name: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Phenotypes (individual, y), genotypes (individual, marker, dosage) and the report of a grid.

    Individuals and markers are numbered from 0 in the order of kept rows and columns. Fails with fewer than 5 kept rows
    or 2 kept markers.
    """
    if impute_method not in METHODS:
        raise ValueError(f"impute_method: one of {sorted(METHODS)}")
    has_header, names = header_of(cells)
    long = long_cells(cells, has_header).persist()
    decided = kept_markers(long).persist()  # one row for each column
    found = decided.agg(F.count_if("kept").alias("kept"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("col")))).alias("dropped")).first()  # the report names those that go
    counts = long.where("col = 0").agg(F.count("*").alias("rows"), F.count("value").alias("kept")).first()
    if counts.kept < 5:
        raise ValueError("at least 5 individuals with a phenotype are needed")
    if found.kept < 2:
        raise ValueError("at least 2 markers are needed")
    rows = long.where("col = 0 AND value IS NOT NULL").select("row_idx", F.col("value").alias("y"))
    rows = numbered(rows, "row_idx", "individual").select("individual", "row_idx", "y")
    at = numbered(decided.where("kept").select("col"), "col", "marker").select("col", F.col("marker").cast("int").alias("marker"))
    body = long.join(at, "col").join(rows.select("row_idx", "individual"), "row_idx").select("individual", "marker", F.col("value").alias("dosage"))
    filled = impute(body, impute_method).persist()
    report = {
        "rows_read": counts.rows + has_header, "header_detected": has_header, "columns_total": len(names), "dropped_columns": [names[c] for c in found.dropped],
        "dropped_rows_no_phenotype": counts.rows - counts.kept, "imputed_cells": filled.where("imputed").count(), "impute_method": impute_method, "final_rows": counts.kept,
        "final_markers": found.kept, "file": file_name,
    }
    return rows.select("individual", "y"), filled.drop("imputed"), report


def prepare(spark: SparkSession, path: str, impute_method: str = "mean") -> tuple[DataFrame, DataFrame, dict]:
    return preprocess(grid.load_grid(spark, path), impute_method, path.rstrip("/").rsplit("/", 1)[-1])
