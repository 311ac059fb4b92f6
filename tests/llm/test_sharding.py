import random
import zlib

import pytest
from pyspark.sql import functions as F
from strandlake.llm.sharding import CapacityTree, best_fit_decreasing, equal_shards, shard_documents, shard_groups, size_histogram

SCHEMA = "doc_id long, text string, shard string, _class long, size string"


def brute_best_fit(sizes, capacity, bins):
    left = [capacity] * bins
    out = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(left) if r >= s]
        if not fits:
            return None
        _, b = min(fits)
        left[b] -= s
        out.append((s, b))
    return out


def test_tree_takes_the_tightest():
    rng, tree, held = random.Random(1), CapacityTree(), []
    for i in range(300):
        x = (rng.randrange(50), i)
        tree.add(*x)
        held.append(x)
        want = rng.randrange(60)
        expect = min((h for h in held if h[0] >= want), default=None)
        assert tree.take_tightest(want) == expect
        if expect:
            held.remove(expect)


def test_bulk_runs_equal_one_by_one():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))]
        hist = [(s, sizes.count(s)) for s in set(sizes)]
        capacity = max(30, -(-sum(sizes) // 5) + rng.randrange(8))
        brute, runs = brute_best_fit(sizes, capacity, 5), best_fit_decreasing(hist, capacity, 5)
        assert (brute is None) == (runs is None)
        if runs:
            assert sorted((s, b) for s, x, y, b in runs for _ in range(x, y)) == sorted(brute)


def test_hot_group_has_its_own_bin():
    runs = equal_shards([(1000, 1), (1, 23)], 24)
    assert len({b for *_, b in runs}) == 24
    assert equal_shards([], 24) == []
    assert best_fit_decreasing([(0, 5)], 10, 2) == [(0, 0, 5, 0)]
    assert best_fit_decreasing([(20, 2)], 10) == [(20, 0, 1, 0), (20, 1, 2, 1)]


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdé") * rng.randrange(1, 9) for _ in range(rng.randrange(40)))) for i in range(2000)]
    rows += [(3000 + i, "hot copy " * 9) for i in range(300)] + [(4000, None), (4001, None), (4002, ""), (5000, "x" * 2_000), (1, rows[1][1]), (1, rows[1][1]), (None, "t")]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = [r.asDict() for r in shard_documents(df).collect()]
    assert len(got) == len(rows)
    for shard in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    of = {}
    total = [0] * 24
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert of.setdefault(t, r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
    own = of["hot copy " * 9]  # larger than its share, so alone
    assert [r["doc_id"] >= 3000 for r in got if r["shard"] == own] == [True] * 300
    others = [x for b, x in enumerate(total) if b != own]
    assert max(others) - min(others) < 60


def test_edges(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    groups = spark.createDataFrame([(i, 6 if i % 2 else 4) for i in range(100)], "g long, s long")
    assert shard_groups(groups, "g", "s", capacity=10).select("shard").distinct().count() == 50
    with pytest.raises(ValueError):
        shard_groups(groups, "g", "s")


def test_large_groups_count_exactly(spark):
    sizes = [9001 + 7 * i for i in range(48)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "g long, s long")
    total = [0] * 24
    for r in shard_groups(groups, "g", "s", shards=24).collect():
        total[r.shard] += sizes[r.g]
    assert set(total) == {9001 + 9001 + 7 * 47}


def test_histogram_is_bounded(spark):
    groups = spark.range(1, 60_001).select(F.col("id").alias("g"), (F.col("id") * 1009).alias("s"))
    bits, exact = size_histogram(groups, "s")
    assert bits == 63 and len(exact) == 60_000
    bits, classes = size_histogram(groups, "s", most=20_000)
    assert 13 <= bits < 63 and len(classes) <= 20_000 and sum(n for _, n in classes) == 60_000
    assert size_histogram(groups, "s", most=1)[0] == 13
    total = [0] * 24
    for r in shard_groups(groups, "g", "s", shards=24).collect():
        total[r.shard] += 1009 * r.g
    assert sum(total) == 1009 * 30_000 * 60_001 and max(total) - min(total) <= 1009
