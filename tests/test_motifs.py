import random
import re
import time

import pytest
from strandlake.functions import seq as S
from strandlake.functions import vector as V


def brute(text, motif, both):
    text, motif = (text or "").upper().replace("U", "T"), motif.upper().replace("U", "T")
    turned, out = motif[::-1].translate(V.COMPLEMENT), []
    for strand, m in (("+", motif), ("-", turned)):
        if strand == "+" or (both and turned != motif):
            rx = re.compile("(?=" + "".join(f"[{V.AMBIGUOUS[x]}]" for x in m) + ")")
            out += [(strand, x.start()) for x in rx.finditer(text)]
    return out


def test_hits_equal_plain_search(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTUacgtN") for _ in range(rng.randrange(0, 300))) for _ in range(40)] + [None, "", "AAAA" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sequence string").repartition(3)
    motifs = {"a": "AA", "b": "aau", "c": "NAC", "d": "GAATTC", "e": "RYKM", "f": "SWBDHV", "again": "AA"}
    for both in (False, True):
        got = sorted((r.id, r.motif, r.strand, r.position) for r in V.motif_hits(df, "id", motifs, both).collect())
        assert got == sorted((i, n, *h) for i, t in enumerate(texts) for n, m in motifs.items() for h in brute(t, m, both))
    assert V.motif_hits(df.limit(0), "id", motifs).count() == 0 and V.motif_hits(df, "id", {}).count() == 0
    for bad in ("", "AXC", "N" * 12):
        with pytest.raises(ValueError):
            V.motif_hits(df, "id", {"bad": bad})


def test_cut_sites_equal_one_scan_an_enzyme(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=4000))) for i in range(30)], "id int, sequence string")
    want = sorted((r.id, e, p) for e in S.ENZYMES for r in df.select("id", S.cut_positions("sequence", e).alias("p")).collect() for p in r.p)
    assert sorted(tuple(r) for r in S.cut_sites(df, "id").collect()) == want


def test_many_motifs_cost_little_more_than_few(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=50_000))) for i in range(80)], "id int, sequence string").repartition(4).cache()
    df.count()

    def seconds(n):
        motifs = {str(i): "".join(rng.choices("ACGT", k=12)) for i in range(n)}
        V.motif_hits(df, "id", motifs).count()
        took = []
        for _ in range(3):
            began = time.time()
            V.motif_hits(df, "id", motifs).count()
            took.append(time.time() - began)
        return min(took)

    assert seconds(500) < 2 * seconds(5) + 0.5
    df.unpersist()
