import random
from collections import Counter

import numpy as np
import pytest
from strandlake.functions import vector
from strandlake.operators import kmers

PAIRS = str.maketrans("ACGT", "TGCA")


def brute(texts, k, canonical):
    found = Counter()
    for t in texts:
        t = (t or "").upper().replace("U", "T")
        for i in range(len(t) - k + 1):
            w = t[i : i + k]
            if not set(w) - set("ACGT"):
                found[min(w, w[::-1].translate(PAIRS)) if canonical else w] += 1
    return found


@pytest.mark.parametrize(("k", "m"), [(1, 1), (3, 3), (5, 2), (21, 7), (31, 11)])
def test_bins_equal_plain_counts(spark, k, m):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGTNacgtu", [9, 9, 9, 9, 1, 2, 2, 2, 2, 1], k=rng.randrange(0, 200))) for _ in range(80)]
    repeat = "".join(rng.choices("ACGT", k=60))
    texts += ["A" * 9000, "ACGT" * 500, repeat * 40, None, "", "N" * 50, repeat[::-1].translate(PAIRS)]
    df = spark.createDataFrame([(t,) for t in texts], "sequence string").repartition(3)
    for canonical in (True, False):
        got = {r.kmer: r["count"] for r in kmers.count_binned(df, k, canonical, m=m, bins=16).collect()}
        assert got == brute(texts, k, canonical)
    assert kmers.count_binned(df.limit(0), k, m=m).count() == 0


def test_a_window_and_its_reverse_complement_share_a_bin():
    rng = random.Random(2)
    for _ in range(100):
        w = "".join(rng.choices("ACGT", k=15))
        keys = {vector.stretches(vector.DIGITS[np.frombuffer(x.encode(), np.uint8)], 15, 5)[0][0] for x in (w, w[::-1].translate(PAIRS))}
        assert len(keys) == 1


def test_packing_is_a_round_trip():
    rng = np.random.default_rng(3)
    digit = rng.integers(0, 4, 9000).astype(np.uint8)
    start, size = np.array([0, 5, 17, 400]), np.array([1, 7, 8, 4126])
    rows = vector.packed_stretches(digit, start, size)
    out, sizes = vector.unpacked_stretches(rows.to_pylist())
    assert sizes.tolist() == size.tolist()
    assert out.tolist() == [x for a, n in zip(start, size, strict=True) for x in [*digit[a : a + n].tolist(), 4]]
