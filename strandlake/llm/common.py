"""What the operators of this subpackage share: shared storage, shipping of code, batches of text, components."""

from __future__ import annotations

import gc
import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers get these functions by value, so that the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Text that one numpy step handles at once; bounds the memory of a Python worker.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and Python, where the session has Spark's default of 64 MB.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """The same table; its session's Arrow batches are bounded in bytes, so that long texts don't add up in memory."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF).rstrip("b") == str(64 << 20):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For each call of ``settle`` that this thread is in, the tables that ``materialize`` made in it.
MADE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset: a temporary one if the master is
    local, as in tests, and an error on a cluster, whose machines would not find it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._strandlake_path = path
    for made in calls():
        made.add(path)
    return found


def calls() -> list[set[str]]:
    return MADE.__dict__.setdefault("calls", [])


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    _delete(df.sparkSession, df._strandlake_path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for made in calls():
        made.discard(path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """Materialise what ``make`` returns and delete the tables that this thread wrote on the way to it. Nothing that ``make``
    leaves behind may read those; what other threads write meanwhile is theirs."""
    calls().append(set())
    try:
        found = materialize(make())
    finally:
        made = calls().pop()
    for path in made - {found._strandlake_path}:
        _delete(found.sparkSession, path)
    release(found.sparkSession)
    return found


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, such as those of tables just written."""
    gc.collect()
    spark._jvm.System.gc()


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(df: DataFrame) -> DataFrame:
    """The rows as one struct column, ``row``, so that names that are added can't clash with theirs."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"))


def columns_of(rows: DataFrame, df: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``df`` again from ``row``, some of them ``changed``."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in df.columns))


def filter_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows that ``run`` leaves of the Arrow batches, in which only ``text`` has its own name: schemas quote none."""
    plain = bounded(docs).toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def worker_cache() -> types.ModuleType:
    """A module that lives as long as the Python worker; functions shipped by value have no lasting globals."""
    return sys.modules.setdefault("_strandlake_worker_cache", types.ModuleType("_strandlake_worker_cache"))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in the string column; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a long, b long).

    Alternates the large-star and the small-star step of Kiveris et al. (2014) until nothing changes. Each step is
    one aggregation and one join on a node; a hub's rows are pre-aggregated and its side of the join can be split by
    the skew-join rule. Every round is written to the shared folder, so lineage stays short. Nothing but two
    counters reaches the driver. Nulls and loops are ignored; an empty table gives an empty table.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if not new.n or new == state:
            break
        state = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small = (
            star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        last, now = now, materialize(small)
        discard(last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each group of ``by``, unique and repeatable for unique ``order``.

    A group is dealt into buckets by a hash of ``order``; rows are numbered inside a bucket, and the buckets' counts
    give each bucket's offset. So no task sorts a whole group, however large it is.
    """
    spread = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ", ".join([*by, "_bucket"])
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.selectExpr(
        *by, "_bucket",
        f"sum(_n) OVER (PARTITION BY {', '.join(by)} ORDER BY _bucket ROWS UNBOUNDED PRECEDING) - _n AS _offset",
    )
    return (
        dealt.join(offsets, [*by, "_bucket"])
        .selectExpr("*", f"row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(order)}) - 1 + _offset AS {out}")
        .drop("_bucket", "_offset")
    )
