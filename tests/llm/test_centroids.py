import hashlib
import math
import random

import numpy as np
from oracle import agree
from strandlake.llm import centroids
from strandlake.llm.centroids import cluster_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, `a.b c` string, cluster string, id string"


def brute(rows, clusters, rounds, size):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    cs = [p for _, p in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(cs)) for _, p in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(cs)):
            own = [p for (_, p), (_, c) in zip(kept, of, strict=True) if c == j]
            if own:
                cs[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(
        (i if i is not None else -1, c, d, sum(e for e, k in of if k == c), sum(e for e, _ in of), sha[c]) for (i, _), (d, c) in zip(kept, of, strict=True)
    )


def collected(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_scan_equals_all_distances():
    rng = np.random.default_rng(1)
    for span in (2, 5, 300):  # few values make many ties and equal centroids
        points, cs = rng.integers(-span, span, (400, 4)), rng.integers(-span, span, (9, 4))
        cs[5] = cs[2]
        all_distances = np.square(points[:, None] - cs[None]).sum(axis=2)
        for before in (np.zeros(400, np.int64), rng.integers(0, 9, 400)):
            cluster, distance = nearest(points, cs, before)
            assert (cluster == all_distances.argmin(axis=1)).all() and (distance == all_distances.min(axis=1)).all()


def test_scan_leaves_far_centroids_out(monkeypatch):
    seen = []
    square = np.square
    monkeypatch.setattr(centroids.np, "square", lambda a: seen.append(len(a)) or square(a))
    points = np.repeat(np.array([[0, 0], [10_000, 0]]), 500, axis=0) + np.arange(1000)[:, None] % 7
    cs = np.array([[0, 0], [10_000, 0], [20_000, 0], [30_000, 0]])
    nearest(points, cs, np.repeat([0, 1], 500))
    assert sum(seen[1:]) == 1000  # each vector met its own centroid only


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0] * 5), (104, [1.0, None, 0.0, 0.0]), (105, [float("nan")] * 4), (106, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.5] * 4), (1, rows[1][1]), (1, rows[1][1]), (2, [-0.0, 0.0, 1e-9, -1e-9]), (107, [0.0] * 4)]
    df = spark.createDataFrame([(i, e, None, "x", "y", "z") for i, e in rows], SCHEMA).repartition(5)
    assert collected(cluster_vectors(df, clusters=6, rounds=9, components=4)) == brute(rows, 6, 9, 4)
    assert collected(cluster_vectors(df, clusters=6, rounds=0, components=4)) == brute(rows, 6, 0, 4)
    huge = spark.createDataFrame([(7, [3e38] * 4, None, "x", "y", "z"), (8, [1.0] * 4, None, "x", "y", "z")], SCHEMA)
    assert [r[0] for r in collected(cluster_vectors(huge, components=4))] == [8]


def test_few_and_none(spark):
    rows = [(i, [0.25, 0.5]) for i in range(3)]
    df = spark.createDataFrame([(i, e, None, "x", "y", "z") for i, e in rows], SCHEMA)
    got = collected(cluster_vectors(df, components=2))
    assert got == brute(rows, 8, 10, 2) and {r[1] for r in got} == {0}
    empty = cluster_vectors(df.limit(0), components=2)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not empty.count()


def test_query(spark):
    agree(centroids.op12_sort_means(spark, "/root/testdata/sf0.01"), centroids.ORACLES["op12_sort_means"], "/root/testdata/sf0.01")
