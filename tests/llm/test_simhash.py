import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from strandlake.llm.simhash import (
    SEGMENTS, WIDE_SEGMENTS, close_pairs, deduplicate, distinct_sets, fingerprints, guarded_pairs, hamming_components, meeting, met_rows, near_duplicates, near_groups, sketch_table,
)

SCHEMA = "doc_id long, text string, fp string, node long, component string"


def brute_fp(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgÉ", k=rng.randrange(2, 7)))
    out = [None, "", " \t\n", "one", "one two three", "ONE two Three", "a b c d", "x " * 3000, "É é nbsp em"]
    for _ in range(30):
        base = [word() for _ in range(rng.choice([5, 40, 300]))]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(" ".join(base).upper())
    return out


def test_fingerprints():
    t = texts()
    assert fingerprints([x or "" for x in t]).tolist() == [brute_fp(x) for x in t]
    assert fingerprints([]).tolist() == [] and fingerprints([""]).tolist() == [0]


def test_documents(spark):
    t = texts()
    df = spark.createDataFrame([(5 * i + 3, x, "c", 1, "d") for i, x in enumerate(t)] + [(3, None, "c", 1, "d"), (None, "one", "c", 1, "d")], SCHEMA)
    rows = near_duplicates(df).collect()
    assert len(rows) == len(t) + 2
    fps = {5 * i + 3: brute_fp(x) for i, x in enumerate(t)}
    want = brute_components(fps)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == f"{brute_fp('one'):016x}"
        else:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize(("bucket", "segments"), [(4096, None), (60, None), (5, None), (4096, WIDE_SEGMENTS), (5, WIDE_SEGMENTS)])
def test_components_equal_brute_force(spark, bucket, segments):
    rng = random.Random(12)
    fps = {}
    for c in range(12):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            fp = center
            for _ in range(rng.randrange(8)):
                fp ^= 1 << rng.randrange(64)
            fps[1000 + 7 * len(fps)] = fp
    fps |= {1: 0, 2: (1 << 64) - 1, 3: 1, 4: 0, 5: 0b11111, 6: 0b111110000}
    df = spark.createDataFrame([(i, signed(x)) for i, x in fps.items()], "doc_id long, fp long")
    want = brute_components(fps)
    got = {r.fp: r.component for r in hamming_components(df, segments, bucket=bucket).collect()}
    assert {i: got[signed(x)] for i, x in fps.items()} == want


def test_segments_miss_nothing():
    rng = np.random.default_rng(13)
    for _ in range(2000):
        flips = rng.choice(64, rng.integers(0, 5), replace=False)
        x = sum(1 << int(b) for b in flips)
        for segments in (SEGMENTS, WIDE_SEGMENTS):
            assert any(bin(x >> low & ((1 << bits) - 1)).count("1") <= allowance for low, bits, allowance in segments)


def jaccard(a, b, k=5):
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def near_copies():
    """Groups of copies with ever more changed words, and texts that have nothing in common."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        out.append(" ".join(base))
        for share in (0.0, 0.004, 0.01, 0.015, 0.05, 0.2):
            copy = [word() if rng.random() < share else w for w in base]
            out.append(" ".join(copy))
    hot = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(hot)
        copy[rng.randrange(120)] = word()
        out.append(" ".join(copy))
    return out + [None, "", "one two", "one two", "one three"]


@pytest.mark.parametrize("bucket", [4096, 40])
def test_near_copies_go_and_others_stay(spark, bucket):
    t = near_copies()
    df = spark.createDataFrame([(3 * i + 1, x, "c", 1, "d") for i, x in enumerate(t)] + [(1, t[0], "c", 1, "d"), (None, "one two", "c", 1, "d"), (None, "one two", "c", 1, "d")], SCHEMA)
    out = deduplicate(df, bucket=bucket)
    assert out.columns == df.columns
    rows = out.collect()
    assert [r.doc_id for r in rows].count(None) == 2
    kept = [(r.doc_id - 1) // 3 for r in rows if r.doc_id is not None]
    assert len(kept) == len(set(kept))
    gone = set(range(len(t))) - set(kept)
    # whoever goes is similar to an earlier text; whoever stays is not clearly similar to one that stays
    assert all(any(jaccard(t[i], t[j]) >= 0.7 for j in range(i)) for i in gone)
    clear = [(i, j) for i in kept for j in kept if j < i and jaccard(t[i], t[j]) >= 0.84]
    assert clear == []
    assert len([i for i in kept if 420 <= i < 570]) <= 2


def test_recall_on_the_small_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in deduplicate(docs).collect()}
    assert not any(jaccard(text[i], text[j]) >= 0.84 for i in kept for j in kept if j < i and abs(len(text[i]) - len(text[j])) < 0.2 * len(text[i]) and text[i][:3] == text[j][:3])
    holders = {}
    for i, t in text.items():
        holders.setdefault(t, []).append(i)
    assert all(len(kept & set(ids)) <= 1 for ids in holders.values()) and len(kept) > 850


def crowd(n, shared, own, pairs=0, changed=0, seed=23):
    """n texts with a long passage in common and words of their own; near copies of the first ones, with changed words at the end."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    passage = [word() for _ in range(shared)]
    bodies = [[word() for _ in range(own)] for _ in range(n)]
    copies = [b[:-changed] + [word() for _ in range(changed)] for b in bodies[:pairs]]
    return [" ".join(passage + b) for b in bodies + copies]


def kept_of(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "c", 1, "d") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id for r in deduplicate(df, **how).collect()}


def test_false_neighbours_hide_no_near_copy(spark):
    t = crowd(1500, 160, 43, pairs=300, changed=16)
    assert 0.63 < jaccard(t[0], t[1]) < 0.67 and 0.83 < jaccard(t[0], t[1500]) < 0.87
    kept = kept_of(spark, t)
    assert len([i for i in range(1500, 1800) if i in kept]) <= 3


def test_crowds_that_share_passages_stay(spark):
    t = crowd(2500, 170, 36)
    assert 0.69 < jaccard(t[0], t[1]) < 0.72
    assert kept_of(spark, t) == set(range(2500))


def test_recall_from_the_threshold_and_exact_decision(spark):
    rng = random.Random(29)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    t = []
    for k in range(600):
        base = [word() for _ in range(204)]
        t += [" ".join(base), " ".join(base[: -(17 + k % 12)] + [word() for _ in range(17 + k % 12)])]
    for _ in range(100):  # 5 of 6 shingles in common, or 4 of 5
        base = [word() for _ in range(10)]
        t += [" ".join(base), " ".join([*base[:-1], word()])]
    kept = kept_of(spark, t)
    similar = [i for i in range(1, len(t), 2) if jaccard(t[i], t[i - 1]) >= 0.8]
    assert 200 < len(similar) < 500
    assert {i for i in range(len(t)) if i not in kept} <= set(similar)
    assert len([i for i in similar if i in kept]) <= 0.03 * len(similar)


def test_overfull_keys_are_compared_in_blocks(spark):
    t = crowd(120, 170, 24, pairs=40, changed=10)
    assert 0.75 < jaccard(t[0], t[1]) < 0.8 and jaccard(t[0], t[120]) > 0.87
    assert kept_of(spark, t, bucket=2, block=16) == kept_of(spark, t) == set(range(120))


def test_clashing_columns_and_an_empty_table(spark):
    names = ["doc_id", "text", "row", "kept", "again", "_kept", "id", "component_id"]
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, long, "a", "b", "c", "d", "e", "f"), (2, long, "a", "b", "c", "d", "e", "f"), (3, "other words", *"abcdef"), (3, "other words", *"abcdef"), (None, long, *"abcdef")]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = deduplicate(df)
    assert out.columns == names and sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4]]))
    assert deduplicate(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    texts = [" ".join(words), " ".join([*words[:-3], "x", "y", "z"]), "short", "a " * 30_000]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3] and kept_of(spark, texts) == {0, 2, 3}


def test_who_is_in_one_group_already_meets_no_more():
    key, home = np.zeros(5, np.int64), np.ones(5, bool)
    fp, component, group = np.zeros((5, 2), np.uint64), np.arange(5), np.array([0, 0, 0, 3, 4])
    fp[3:] = np.uint64(2**64 - 1)
    fp[4, 0] ^= np.uint64(1)
    met, apart = meeting(key, fp, home, component, group)
    assert met.tolist() == [True] * 5 and apart.tolist() == [False] * 3 + [True] * 2
    met, apart = meeting(key, fp, home, component, component)
    assert apart.tolist() == [True] * 5


def test_meetings_of_a_crowd_stay_few(spark):
    n = 400
    df = spark.createDataFrame([(i, t, "c", 1, "d") for i, t in enumerate(crowd(n, 170, 36))], SCHEMA)
    nodes = distinct_sets(sketch_table(df, 5)).drop("same").localCheckpoint()
    alone = nodes.select("node", "n", F.col("node").alias("component"), F.col("node").alias("group"), "sketch", "weak")
    near = guarded_pairs(close_pairs(nodes), nodes)
    numbered = [met_rows(u, 4096).where("meet IS NOT NULL").count() for u in (alone, near_groups(nodes, near, spark.createDataFrame([], "node long, component long")))]
    assert numbered[0] > 10 * n and numbered[1] < numbered[0] / 2
