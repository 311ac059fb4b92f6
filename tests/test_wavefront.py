import random

import numpy as np
import pytest
from strandlake.operators import align, wavefront


def texts(rng, n, longest=60):
    out = []
    for _ in range(n):
        a = "".join(rng.choices("ACGTN", k=rng.randrange(1, longest)))
        b = "".join(rng.choice("ACGT") if rng.random() < 0.2 else c for c in a if rng.random() > 0.1) if rng.random() < 0.7 else "".join(rng.choices("ACGT", k=rng.randrange(1, longest)))
        out.append((a, b))
    return out


@pytest.mark.parametrize("scores", [(2.0, -1.0, -2.0, -0.5), (2.0, -1.0, -1.0, None), (1.0, -2.0, -3.0, -1.0)])
def test_blocks_equal_the_whole_matrix(scores):
    """The best cell over blocks, handed on by their sides, is that of the matrix in one block."""
    rng = random.Random(8)
    for a, b in texts(rng, 60):
        if not b:
            continue
        q, t = (np.frombuffer(x.encode(), np.uint8) for x in (a, b))
        *_, whole = wavefront.block_scores(q, t, [None] * 4, scores)
        assert whole[0] == align.local_alignments([(a, b)], *scores)[0][0]
        size, sides, best = rng.randrange(1, 20), {}, []
        for r in range(-(-len(q) // size)):
            for c in range(-(-len(t) // size)):
                up, before = sides.get((r - 1, c)), sides.get((r, c - 1))
                edges = [up[0] if up else None, up[1] if up else None, before[2] if before else None, before[3] if before else None]
                *sides[r, c], (s, i, j) = wavefront.block_scores(q[r * size : (r + 1) * size], t[c * size : (c + 1) * size], edges, scores)
                if s:
                    best.append((-s, r * size + i, c * size + j))
        s, i, j = min(best, default=(0.0, 0, 0))
        assert (-s, i, j) == whole


@pytest.mark.parametrize("gap_extend", [-0.5, None])
def test_equals_one_task(spark, gap_extend):
    pairs = [*texts(random.Random(9), 25, 40), ("", "ACGT"), (None, "ACGT"), ("AAAA", "CCCC"), ("ACGTACGT", "ACGTACGT")]
    df = spark.createDataFrame([(k, a, b, k) for k, (a, b) in enumerate(pairs)], "k int, query string, target string, br int")
    want = sorted(map(str, align.align_pairs(df, gap_extend=gap_extend).collect()))
    got = wavefront.align_long(df, key="k", gap_extend=gap_extend, block=16).select(*align.align_pairs(df).columns)
    assert sorted(map(str, got.collect())) == want


def test_empty_table(spark):
    assert wavefront.align_long(spark.createDataFrame([], "pair int, query string, target string")).collect() == []
