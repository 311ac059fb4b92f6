"""Centroid clustering by sort-means, in exact integers.

Each round knows, for every centroid, the others in ascending order of their distance from it. A vector is first
compared with the centroid it had before; then the others are scanned in that centroid's order, and the scan stops at
the first one that lies strictly further from it than twice the vector's own distance: by the triangle inequality
neither it nor any later one can be as near. Equally near centroids aren't skipped, so ties go to the smaller number.

A task sums its own vectors by centroid, so a round shuffles (tasks x centroids) rows of sums and the driver sees
centroids x components numbers, however many vectors there are; no key groups vectors, so none can be hot. The
previous assignment isn't stored each round: a task replays the rounds since the last written table from their
centroids, and every REPLAY rounds the assignments are written, which bounds the replay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, table

COMPONENTS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3:"
#: Rounds that a task may replay before assignments are written again.
REPLAY = 4
#: Components beyond this have squared distances that no long holds.
LARGEST = 1 << 27


def nearest(points: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest centroid (of equals the smaller number) and the squared distance."""
    apart = np.square(centroids[:, None, :] - centroids[None, :, :]).sum(axis=2)
    cluster, distance = before.copy(), np.empty(len(points), np.int64)
    for c in np.unique(before).tolist():
        at = np.flatnonzero(before == c)
        own = np.square(points[at] - centroids[c]).sum(axis=1)
        best, found = own.copy(), np.full(len(at), c)
        live = np.arange(len(at))
        for j in np.argsort(apart[c], kind="stable").tolist():
            if j == c:
                continue
            # distances are squared, so twice the distance is four times here
            live = live[apart[c, j] <= 4 * own[live]]
            if not len(live):
                break
            d = np.square(points[at[live]] - centroids[j]).sum(axis=1)
            better = (d < best[live]) | ((d == best[live]) & (j < found[live]))
            best[live[better]], found[live[better]] = d[better], j
        cluster[at], distance[at] = found, best
    return cluster, distance


def replayed(batch: pa.RecordBatch, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of a batch with their nearest centroid, and its distance, after all rounds of ``history``."""
    points = np.stack(batch.column("point").to_numpy(zero_copy_only=False)).astype(np.int64)
    cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
    for centroids in history:
        cluster, distance = nearest(points, centroids, cluster)
    return points, cluster, distance


def sums(points: DataFrame, history: list[np.ndarray]) -> list[tuple[int, int, list[int], int]]:
    """For each non-empty cluster its number, its vectors, their componentwise sum, and their summed distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = history[-1].shape
        count, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                at, cluster, distance = replayed(batch, history)
                np.add.at(count, cluster, 1)
                np.add.at(inertia, cluster, distance)
                for c in np.unique(cluster).tolist():
                    total[c] += at[cluster == c].sum(axis=0)
        of = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(of.astype(np.int32)), pa.array(count[of]), pa.array(list(total[of]), pa.list_(pa.int64())), pa.array(inertia[of])],
            ["cluster", "n", "total", "inertia"],
        )

    parts = points.select("point", "cluster").mapInArrow(run, "cluster int, n long, total array<long>, inertia long")
    by_place = parts.select("cluster", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x"))
    totals = by_place.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("total"))
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).join(totals, "cluster")
    return [(r["cluster"], r["n"], r["total"], r["inertia"]) for r in found.collect()]


def assigned(points: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The points with cluster and distance after ``history``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance = replayed(batch, history)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("point"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "point", "cluster", "distance"]
                )

    schema = f"id {points.schema['id'].dataType.simpleString()}, point array<int>, cluster int, distance long"
    return points.select("id", "point", "cluster").mapInArrow(run, schema)


def grid_points(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, point array<int>, cluster 0) of the usable rows of (vec_id, embedding): each component is floor(scale * x)."""
    x = F.col("embedding")
    usable = (
        (F.size(x) == components)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
        & ~F.exists(x, lambda v: F.abs(v.cast("double")) * scale >= LARGEST)  # infinities too
    )
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("int"))
    return vectors.where(usable).select(F.col("vec_id").alias("id"), whole.alias("point"), F.lit(0).alias("cluster"))


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, salt: str = SALT
) -> DataFrame:
    """Cluster the rows of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another length, or hold null or non-finite components are left out, and so are those
    with a component of LARGEST or more after scaling, whose distances no long holds. Centroids start as the vectors
    with the smallest SHA-256 of ``salt`` and vec_id (a null vec_id counts as an empty text; rows with one vec_id go
    by their components); with fewer usable vectors than ``clusters`` there are fewer centroids. Repeated rows each
    count and are each returned; equal centroids both stay, and the smaller number takes the vectors. An empty table
    gives an empty table. Other columns, of any name, are ignored.
    """
    base = materialize(grid_points(bounded(vectors).select("vec_id", "embedding"), components, scale))
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = base.select("point", order.alias("h")).orderBy("h", "point").limit(clusters).collect()
    schema = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(vectors.schema["vec_id"].dataType.simpleString())
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    history = [np.array([r["point"] for r in first], np.int64)]
    for _ in range(rounds):
        centroids = history[-1].copy()
        for c, n, total, _inertia in sums(base, history):
            centroids[c] = [t // n for t in total]
        if len(history) == REPLAY:
            last, base = base, materialize(assigned(base, history).drop("distance"))
            discard(last)
            history = []
        history.append(centroids)
    inertia = {c: total for c, _, _, total in sums(base, history)}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in history[-1].tolist()]
    of_cluster = F.broadcast(  # as many rows as there are centroids
        vectors.sparkSession.createDataFrame(
            [(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    )
    found = assigned(base, history).join(of_cluster, "cluster")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out; distances to all centroids, without pruning."""
    assign = """{a} AS MATERIALIZED (
  SELECT id, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT p.id, k.c, sum((p.x - k.x) * (p.x - k.x))::BIGINT AS d FROM points p JOIN {k} k USING (place) GROUP BY p.id, k.c) GROUP BY id)"""
    update = """{k2} AS MATERIALIZED (
  SELECT k.c, k.place, coalesce(n.x, k.x) AS x FROM {k} k LEFT JOIN (
    SELECT a.cluster AS c, p.place, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM {a} a JOIN points p USING (id) GROUP BY a.cluster, p.place) n USING (c, place))"""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS point
  FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"points AS MATERIALIZED (SELECT id, unnest(point) AS x, unnest(range({COMPONENTS})) AS place FROM kept)",
        f"""seeds AS (SELECT point, row_number() OVER (ORDER BY sha256('{SALT}' || coalesce(vec_id::VARCHAR, '')), point) - 1 AS c FROM kept
  QUALIFY c < {CLUSTERS})""",
        f"k0 AS MATERIALIZED (SELECT c, unnest(point) AS x, unnest(range({COMPONENTS})) AS place FROM seeds)",
    ]
    for r in range(ROUNDS):
        parts += [assign.format(a=f"a{r}", k=f"k{r}"), update.format(a=f"a{r}", k=f"k{r}", k2=f"k{r + 1}")]
    parts += [
        assign.format(a="final", k=f"k{ROUNDS}"),
        f"digests AS (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM k{ROUNDS} GROUP BY c)",
    ]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,"
        " (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM final JOIN kept USING (id) JOIN digests USING (cluster)"
    )


QUERIES = {"op12_sort_means": op12_sort_means}
ORACLES = {"op12_sort_means": _sql()}
