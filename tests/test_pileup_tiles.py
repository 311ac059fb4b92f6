import random
from collections import Counter

import pytest
from strandlake.operators import pileup

PAIRS = str.maketrans("ACGT", "TGCA")
SCHEMA = "ref_id string, sequence string, start int, strand string, quality string"


def brute(refs, reads, least=None, turn=False):
    found = Counter()
    for ref, s, start, strand, q in reads:
        s = (s or "").upper().replace("U", "T")
        if strand == "-":
            s, q = s[::-1].translate(PAIRS), q[::-1] if turn and q else q
        for i, b in enumerate(s):
            score = ord(q[i]) - 33 if q and i < len(q) else 0
            if b in "ACGT" and 0 <= start + i < len(refs.get(ref, "")) and (least is None or score >= least):
                found[ref, start + i, b] += 1
    return found


@pytest.mark.parametrize("held", [1 << 22, 40])
def test_tiles_equal_plain_counts(spark, held, monkeypatch):
    monkeypatch.setattr(pileup, "HELD", held)
    rng = random.Random(held)
    refs = {f"r{i}": "A" * n for i, n in enumerate((50, 40_000, 0, 16_384))}
    reads = []
    for _ in range(600):
        n = rng.randrange(0, 40)
        q = "".join(chr(33 + rng.randrange(41)) for _ in range(rng.choice([n, n, max(0, n - 3), n + 2])))
        reads.append((rng.choice([*refs, "none"]), "".join(rng.choice("ACGTacgtuNRé") for _ in range(n)), rng.choice([-5, 0, 30, 16_370, 39_990]), rng.choice("+-"), rng.choice([q, None])))
    reads += [("r1", "ACGT", 100, "+", "IIII")] * 500 + [("r1", None, 3, None, None)]
    ref_df = spark.createDataFrame(list(refs.items()), "ref_id string, sequence string")
    df = spark.createDataFrame(reads, SCHEMA).repartition(3)
    for least, turn in ((None, False), (20, False), (20, True)):
        got = Counter()
        for r in pileup.covered(ref_df, df, least, reverse_qualities=turn).collect():
            assert r.depth == r.a + r.c + r.g + r.t > 0
            for b in "ACGT":
                if r[b.lower()]:
                    got[r.ref_id, r.pos, b] += r[b.lower()]
        assert got == brute(refs, reads, least, turn)


def test_rows_shuffled_follow_tiles(spark):
    ref_df = spark.createDataFrame([(1, "A" * 1000)], "ref_id int, sequence string")
    df = spark.createDataFrame([(1, "ACGT" * 10, k % 900, "+", None) for k in range(4000)], "ref_id int, sequence string, start int, strand string, quality string").repartition(3)
    assert pileup.tile_counts(ref_df, df).count() == 1
    assert pileup.covered(ref_df, df.limit(0)).count() == 0
