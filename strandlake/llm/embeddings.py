"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on PROJECTIONS random directions. A pair at cosine c or more differs by at most
sqrt(2 - 2c), so on each direction it falls within a window around either side's projection with a known probability;
it is a candidate if it collides on at least ``least_collisions`` directions, the largest count that keeps the
calibrated recall, and then the cosine decides in double precision.

Candidates come from tables. In a table, vectors are dealt into cells by some further projections and sorted by one, and
a pair meets if it shares a cell and lies within the sorting projection's window; a pair counts in the first table where
it meets. How many projections make a cell, and how many tables it then takes to keep the recall, is chosen from the
number of vectors under a label, so that the pairs compared stay a vanishing share of all pairs as a label grows; a small
label is one table of one cell. Cells with many vectors are cut into blocks. A task compares two blocks and emits, for
each vector, how many it links with, and the links that join two trees of a forest; never all pairs.

Equal vectors under one label are one class from the start, with a weight.
"""

from __future__ import annotations

from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table
from .simhash import Forest, whole_keys

COSINE, PROJECTIONS, RECALL = 0.98, 24, 0.9999
#: Windows, in standard deviations of the difference's projection: of each direction, and of the sorting one.
WINDOW, SORT_WINDOW = 3.0, 5.0
BLOCK, STEP = 1024, 1 << 14
FIRST = 8
#: Width of a cell's projections, in standard deviations of the difference's projection; the recall of all tables together.
CELL, TABLE_RECALL = 6.0, 0.9999
#: What filing a vector in one more table costs, in comparisons of pairs.
FILING = 2000
#: Parts that the rows of a cell are dealt to where its number of blocks is joined, however many rows it has.
SALTS = 64


def directions(d: int, m: int = PROJECTIONS) -> np.ndarray:
    """m random unit directions (columns), orthogonal in blocks of d; the same for the same d."""
    rng = np.random.default_rng(1000 + d)
    return np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-m // d))], axis=1)[:, :m] if d > 1 else np.ones((1, m))


def miss_probability(d: int, t: float) -> float:
    """The chance that a coordinate of a random unit vector exceeds t in size."""
    if t >= 1:
        return 0.0
    x = np.linspace(0, 1, 200_001)[1:] - 0.5 / 200_000
    density = (1 - x**2) ** ((d - 3) / 2)
    return float(density[x > t].sum() / density.sum())


def windows(d: int, cosine: float) -> tuple[float, float]:
    """Half widths for collisions and for the sorting projection; never more than the largest difference there is."""
    gap = sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-12
    return min(1.0, WINDOW / sqrt(d)) * gap, min(1.0, SORT_WINDOW / sqrt(d)) * gap


def least_collisions(d: int, cosine: float, m: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The largest count that a pair at exactly ``cosine`` reaches with the wanted probability."""
    miss = miss_probability(d, min(1.0, WINDOW / sqrt(d)))
    reached = 0.0
    for misses in range(m + 1):
        reached += comb(m, misses) * miss**misses * (1 - miss) ** (m - misses)
        if reached >= recall:
            return m - misses
    return 0


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def share_of_cells(width: float, deviation: float) -> float:
    """The chance that a difference of normal ``deviation`` leaves two values in one of the cells of that width, laid at random."""
    x = (np.arange(2000) + 0.5) / 2000 * width
    return float(((1 - x / width) * 2 * np.exp(-0.5 * (x / deviation) ** 2) / (deviation * sqrt(2 * np.pi))).sum() * width / 2000)


def cell_plan(n: int, d: int, cosine: float, recall: float = TABLE_RECALL, most: int = 40) -> tuple[int, int]:
    """(projections of a cell, tables) for n vectors: the recall's cheapest. Unit vectors spread evenly differ by 2 / d in
    the variance of a projection, those at ``cosine`` by (2 - 2 cosine) / d."""
    gap = sqrt(max(2 - 2 * cosine, 1e-12) / d)
    near, far = share_of_cells(CELL * gap, gap), min(1.0, share_of_cells(CELL * gap, sqrt(2 / d)))
    best, plan = None, (0, 1)
    for k in range(most + 1):
        tables = 1 if k == 0 else max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-(near**k)))))
        cost = tables * (FILING + n / 2 * far**k)
        if best is None or cost < best:
            best, plan = cost, (k, tables)
    return plan


def cells_of(x: np.ndarray, k: int, tables: int, cosine: float) -> np.ndarray:
    """The cell of each unit vector in each table, as a number; cells of different tables differ."""
    d, numbers = x.shape[1], np.arange(tables, dtype=np.uint64)
    out = np.repeat(numbers[None, :], len(x), axis=0)
    rng = np.random.default_rng(7000 + d)
    width = CELL * sqrt(max(2 - 2 * cosine, 1e-12) / d)
    for t in range(tables if k else 0):
        axes = rng.standard_normal((d, k))
        place = np.floor(x @ (axes / np.sqrt((axes * axes).sum(axis=0))) / width + rng.random(k)).astype(np.int64)
        for c in range(k):
            out[:, t] = (out[:, t] ^ place[:, c].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, t] ^= out[:, t] >> np.uint64(29)
    return out.view(np.int64)


def quantised(x: np.ndarray) -> np.ndarray:
    """Projections in steps of 1 / STEP."""
    return np.rint(x @ directions(x.shape[1]) * STEP).astype(np.int32).astype(np.int16)


class Block:
    """Vectors of one cell of a table, sorted by the table's projection."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, places: np.ndarray, cells: np.ndarray, number: int) -> None:
        self.order = np.argsort(places[:, number % PROJECTIONS], kind="stable")
        self.x, self.weight, self.places, self.cells = (v[self.order] for v in (x, weight, places, cells))
        self.sorted = self.places[:, number % PROJECTIONS].astype(np.int32)


def compare(left: Block, right: Block | None, cosine: float, number: int = 0, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of two blocks of table ``number``, or within one, that no earlier table has: weights linked for each side, and
    the links that join trees; in the order in which the blocks were given."""
    a_side, b_side = left, right or left
    d = a_side.x.shape[1]
    width, sort_width = (int(np.ceil(w * STEP)) + 1 for w in windows(d, cosine))
    least = least_collisions(d, cosine)
    columns = np.ascontiguousarray(b_side.places.T)
    na, nb = np.zeros(len(a_side.x), np.int64), np.zeros(len(b_side.x), np.int64)
    forest, links, base = Forest(len(na) + (len(nb) if right else 0)), [], len(na) if right else 0
    allowed = PROJECTIONS - least
    for at in range(0, len(na), chunk):
        own = a_side.places[at : at + chunk].astype(np.int32)
        values = a_side.sorted[at : at + chunk]
        low, high = (int(np.searchsorted(b_side.sorted, v, s)) for v, s in ((values[0] - sort_width, "left"), (values[-1] + sort_width, "right")))
        hits = np.zeros((len(own), high - low), np.uint8)
        for k in range(FIRST):  # |difference| <= width as one unsigned comparison
            lower = (own[:, k] - width).astype(np.int32)
            hits += (columns[k, low:high].astype(np.int32)[None, :] - lower[:, None]).view(np.uint32) <= np.uint32(2 * width)
        i, j = np.nonzero(hits >= max(0, FIRST - allowed))
        i, j = i + at, j + low
        if right is None:
            i, j = i[j > i], j[j > i]
        for part in range(0, len(i), 1 << 15):
            a, b = i[part : part + (1 << 15)], j[part : part + (1 << 15)]
            near = np.abs(a_side.places[a].astype(np.int32) - b_side.places[b])
            met = (near[:, number % PROJECTIONS] <= sort_width) & ((near <= width).sum(axis=1) >= least)
            a, b, near = a[met], b[met], near[met]
            linked = np.einsum("ij,ij->i", a_side.x[a], b_side.x[b]) >= cosine
            for t in range(number):
                linked &= (a_side.cells[a, t] != b_side.cells[b, t]) | (near[:, t % PROJECTIONS] > sort_width)
            a, b = a[linked], b[linked]
            np.add.at(na, a, b_side.weight[b])
            np.add.at(nb, b, a_side.weight[a])
            a, b = a_side.order[a], b_side.order[b] + base
            apart = forest.root[a] != forest.root[b]
            links += forest.join(a[apart], b[apart])
    if right is None:
        na += nb
    out_a, out_b = np.zeros_like(na), np.zeros_like(nb)
    out_a[a_side.order], out_b[b_side.order] = na, nb
    return out_a, out_b, links


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` left join ``facts``, one row for each of few keys that may have very many rows: these go to SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(facts.select("*", salts), [*keys, "_salt"], "left").drop("_salt")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, plan: tuple[int, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null and their lengths are equal. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. Rows that repeat are vectors of their own:
    equal vectors under one label are linked; 0.0 and -0.0 are equal. A null vec_id has a null component and isn't kept,
    and links nothing. An empty table gives an empty table; other columns aren't read. ``plan`` gives the projections of
    a cell and the number of tables of every label, instead of those chosen from its size.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast(element)))  # -0.0 is 0.0, in the key too
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    key = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string")).cast("binary"), 256)
    rows = materialize(vectors.select("vec_id", F.when(usable, key).alias("_key")))
    classes = vectors.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.select("label", F.size("embedding").alias("d"), F.col("embedding").alias("v"), "rep", "n", key.alias("_key")))
    group = ["label", "d"]
    # labels so small that one cell is cheapest need no count
    few = FILING
    large = classes.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") > few)
    sized = salted_join(classes, large, group, "rep").withColumn("size", F.coalesce("size", F.lit(0)))

    def placed(batches):
        for batch in batches:
            sizes, total = batch.column("d").to_numpy(), batch.column("size").to_numpy()
            flat, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
            places, cells = [None] * len(sizes), [None] * len(sizes)
            for d, size in sorted(set(zip(sizes.tolist(), total.tolist(), strict=True))):
                at = np.flatnonzero((sizes == d) & (total == size))
                x = unit(flat[(ends[at] - d)[:, None] + np.arange(d)])
                found = cells_of(x, *(plan or cell_plan(size, d, cosine)), cosine)
                for i, p, c in zip(at.tolist(), quantised(x), found, strict=True):
                    places[i], cells[i] = p.tobytes(), c
            kept = batch.drop_columns(["size"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], [*kept.schema.names, "places", "cells"])

    label = vectors.schema["label"].dataType.simpleString()
    points = materialize(sized.mapInArrow(placed, f"label {label}, d int, v array<{element}>, rep long, n long, _key string, places binary, cells array<long>"))
    filed = points.select(*group, F.posexplode("cells").alias("t", "cell"), "v", "rep", "n", "places", "cells")
    where = [*group, "t", "cell"]
    full = points.select(*group, F.posexplode("cells").alias("t", "cell")).groupBy(*where).agg(F.ceil(F.count("*") / block).cast("int").alias("k")).where("k > 1")
    dealt = salted_join(filed, full, where, "rep").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    pairs = dealt.select(
        *where, "v", "rep", "n", "places", "cells",
        F.explode(F.expr("transform(sequence(0, k - 1), i -> named_struct('i', least(i, b), 'j', greatest(i, b), 'side', if(i = b, 2, if(i > b, 0, 1))))")).alias("p"),
    ).select(*where, "p.*", "v", "rep", "n", "places", "cells")

    def linked(found: pa.Table) -> pa.Table:
        d, number, side = found.column("d")[0].as_py(), found.column("t")[0].as_py(), found.column("side").to_numpy()
        x = unit(found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
        places = np.frombuffer(b"".join(found.column("places").to_pylist()), np.int16).reshape(len(x), -1)
        cells = found.column("cells").combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        rep, n = found.column("rep").to_numpy(), found.column("n").to_numpy()
        parts = [np.flatnonzero(side == 2)] if side[0] == 2 else [np.flatnonzero(side == k) for k in (0, 1)]
        blocks = [Block(x[at], n[at], places[at], cells[at], number) for at in parts if len(at)]
        order = rep[np.concatenate(parts)]
        if len(blocks) < len(parts):
            counts, links = np.zeros(len(order), np.int64), []
        else:
            na, nb, links = compare(blocks[0], blocks[1] if len(blocks) > 1 else None, cosine, number)
            counts = np.concatenate([na, nb])[: len(order)]
        some = np.flatnonzero(counts)
        a, b = (order[np.array([e[k] for e in links], np.int64)] for k in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([a, order[some]])),
            "b": pa.concat_arrays([pa.array(b), pa.nulls(len(some), pa.int64())]),
            "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), counts[some]])),
        })

    def run(batches):
        for rows_, first in whole_keys(batches, [*where, "i", "j"]):
            for at, end in zip(first, np.append(first[1:], rows_.num_rows), strict=True):
                if end - at > 1:
                    yield from linked(rows_.slice(at, end - at)).to_batches()

    sorted_pairs = pairs.repartition(*where, "i", "j").sortWithinPartitions(*where, "i", "j")
    found = materialize(sorted_pairs.mapInArrow(run, "a long, b long, n long"))
    totals = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_links"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    facts = points.select("_key", "rep", "n").join(totals, "rep", "left").join(parts, "rep", "left")
    facts = facts.select("_key", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("_component"))
    return rows.join(facts, "_key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(False)).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE raw AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM raw
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(r.m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = e.vec_id"""

QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLES = {"op1_embedding_dedup": ORACLE}
