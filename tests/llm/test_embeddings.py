import numpy as np
import pytest
from oracle import agree
from strandlake.llm.embeddings import ORACLE, Block, cell_plan, cells_of, compare, directions, least_collisions, miss_probability, near_duplicate_vectors, op1_embedding_dedup, quantised, unit, windows

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n string, cell double, d string"


def test_calibration():
    rng = np.random.default_rng(0)
    for d in (2, 3, 8, 64):
        u = rng.standard_normal((200_000, d))
        share = (np.abs(u[:, 0] / np.sqrt((u * u).sum(axis=1))) > 0.3).mean()
        assert abs(miss_probability(d, 0.3) - share) < 0.006
    assert least_collisions(64, 0.98) >= 20 and directions(64).shape == (64, 24) and directions(5).shape == (5, 24)
    assert least_collisions(4, 0.98) == 24 and windows(4, 0.98)[0] >= np.sqrt(0.04)


def test_recall_at_the_threshold():
    """Pairs just above the threshold: at least the calibrated share is found, and nothing below is linked."""
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((3000, 64)))
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    for cosine, low, high in ((0.9801, 2990, 3000), (0.9799, 0, 0)):
        y = cosine * x + np.sqrt(1 - cosine**2) * unit(z)
        nx, _, _ = compare(*(Block(v, np.ones(3000, np.int64), quantised(v), cells_of(v, 0, 1, 0.98), 0) for v in (x, y)), 0.98)
        assert low <= nx.sum() <= high


def rows():
    rng = np.random.default_rng(2)
    out = []
    for label in (0, 1, None):
        for _ in range(25):
            center = rng.standard_normal(16)
            for _ in range(rng.integers(1, 12)):
                out.append(((center + rng.standard_normal(16) * rng.choice([0, 0.03, 0.1, 0.2])).tolist(), label))
    hot = rng.standard_normal(16).tolist()
    out += [(hot, 1)] * 60 + [([x * 3 for x in hot], 1)] * 2 + [(hot, 0), (hot, None), (None, 1), ([0.0] * 16, 1), ([0.0] * 16, 1), ([], 1)]
    out += [([None, *hot[1:]], 1), ([float("nan"), *hot[1:]], 1), ([float("inf"), *hot[1:]], 1), (hot[:8], 1), (hot[:8], 1), ([2.0], 1), ([5.0], 1), ([-5.0], 1)]
    ids = rng.permutation(5000)[: len(out)].tolist()
    return [(i, v, l) for i, (v, l) in zip(ids, out, strict=True)]


def brute(data):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, l in data if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in data}
    links = {i: set() for i, _, _ in data}
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and label[i] == label[j] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i].add(j)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def test_plans_keep_the_recall_and_compare_a_vanishing_share():
    shares = []
    for n in (10**5, 10**7, 10**9):
        k, tables = cell_plan(n, 64, 0.98)
        rng = np.random.default_rng(3)
        x = unit(rng.standard_normal((2000, 64)))
        z = rng.standard_normal(x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        a, b = (cells_of(v, k, tables, 0.98) for v in (x, 0.9801 * x + np.sqrt(1 - 0.9801**2) * unit(z)))
        assert (a == b).any(axis=1).sum() >= 1996
        shares.append((a[:1000] == a[1000:]).sum() / 1000)
    assert shares[0] < 0.2 and shares[2] <= shares[1] <= shares[0] and cell_plan(1500, 64, 0.98) == (0, 1)


def test_recall_through_the_cells(spark):
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((500, 64)))
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * unit(z)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_duplicate_vectors(df, plan=cell_plan(10**6, 64, 0.98)).collect()}
    found = [i for i in range(500) if got[i].n_links == 1 and got[i + 500].component_id == i]
    assert len(found) >= 498 and all(r.n_links <= 1 for r in got.values())


@pytest.mark.parametrize(("block", "plan"), [(4096, None), (7, None), (7, (2, 20)), (64, (1, 12))])
def test_equals_brute_force(spark, block, plan):
    data = rows()
    df = spark.createDataFrame([(i, v, l, "a", "b", 0.5, "c") for i, v, l in data], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, block=block, plan=plan).collect()}
    assert got == brute(data)


def test_edges(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, "a", "b", 0.5, "c"), (4, [1.0, 2.0], 1, "a", "b", 0.5, "c"), (4, [1.0, 2.0], 1, "a", "b", 0.5, "c")], SCHEMA)
    assert sorted(near_duplicate_vectors(df).collect(), key=str) == [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, False)]
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def test_query(spark):
    agree(op1_embedding_dedup(spark, "/root/testdata/sf0.01"), ORACLE, "/root/testdata/sf0.01")


def test_negative_zero_is_zero(spark):
    rows = [(1, [0.0, 1.0], 5), (2, [-0.0, 1.0], 5), (3, [-0.0, 1.0], 5), (4, [-0.0, -1.0], 5)]
    for element in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()}
        assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}
