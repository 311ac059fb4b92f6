import hashlib
import random
import re
from collections import Counter

import numpy as np
from oracle import agree
from pyspark.sql import functions as F
from strandlake.llm import substrings
from strandlake.llm.substrings import FMIndex, WaveletMatrix, anchored_runs, least_of, remove_repeats, repeated_windows

SCHEMA = "doc_id long, text string, `a.b c` string, id string, words string, digest string"


def brute(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in df.collect()), key=repr)


def test_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 1), (63, 3), (64, 2), (65, 70), (700, 9)):
        symbols = rng.integers(0, sigma + 1, n)
        tree = WaveletMatrix(symbols)
        for c in range(int(symbols.max()) + 1):
            places = np.arange(n + 1)
            ranks = tree.sink(np.full(n + 1, c), places) - tree.sink(np.array([c]), np.array([0]))
            assert ranks.tolist() == [int((symbols[:i] == c).sum()) for i in places]


def test_backward_search_weighs_occurrences():
    rng = random.Random(2)
    segments = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    weights = [rng.randrange(1, 4) for _ in segments]
    symbols = np.array([x for s in segments for x in [*s, 0]])
    index = FMIndex(symbols, np.repeat(weights, [len(s) + 1 for s in segments]))
    for _ in range(300):
        want = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))]
        low, high = np.array([0]), np.array([index.n])
        for c in reversed(want):
            low, high = index.extend(np.array([c]), low, high)
        n = sum(w * sum(s[i : i + len(want)] == want for i in range(len(s))) for s, w in zip(segments, weights, strict=True))
        assert index.total(low, high)[0] == n


def test_matching_intervals():
    rng = random.Random(3)
    for window in (1, 2, 5):
        for _ in range(20):
            made = {" ".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 40))) for _ in range(8)}
            segments, weights = [s.encode() for s in sorted(made)], [rng.choice([1, 1, 2]) for _ in made]
            counts = Counter()
            for s, w in zip(sorted(made), weights, strict=True):
                x = s.split()
                for i in range(len(x) - window + 1):
                    counts[tuple(x[i : i + window])] += w
            got = repeated_windows(segments, np.array(weights), window)
            for s, found in zip(sorted(made), got, strict=True):
                x = s.split()
                want = [i for i in range(len(x) - window + 1) if counts[tuple(x[i : i + window])] > 1]
                assert [i for a, b in found for i in range(a, b)] == want


def test_every_window_is_in_one_run():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(n)).encode() for n in (0, 3, 9, 10, 11, 200, 2000)] + [b"x " * 1500, b"", b" \t\n"]
    of, start, stop, key, n = anchored_runs(texts, 10, 4)
    seen, anchors = [], {}
    for t, a, b, k, _ in zip(of.tolist(), start.tolist(), stop.tolist(), key.tolist(), n.tolist(), strict=True):
        assert 0 < b - a <= substrings.RUN
        words = texts[t].split()
        for i in range(a, b):
            seen.append((t, i))
            assert anchors.setdefault(tuple(words[i : i + 10]), k) == k
    assert sorted(seen) == [(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 9)]
    values = np.random.default_rng(5).integers(0, 99, 50)
    assert all(least_of(values, w).tolist() == [int(values[i : i + w].min()) for i in range(51 - w)] for w in range(1, 20))


def corpus(rng):
    vocabulary = [f"w{i}é" for i in range(40)] + ["a", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long_ = text(14), text(300)
    rows = [(i, text(rng.randrange(0, 60))) for i in range(120)]
    rows += [(200 + i, text(rng.randrange(0, 9)) + " " + passage + "\n" + text(rng.randrange(0, 9))) for i in range(150)]  # hot passage, new neighbours
    rows += [(400 + i, long_) for i in range(40)]  # hot copies
    rows += [(500 + i, long_.replace(rng.choice(vocabulary), "new", 1)) for i in range(30)]  # near copies
    rows += [(600, None), (601, ""), (602, " \t\x0b "), (603, "a " * 1500), (None, passage), (1, rows[1][1]), (1, rows[1][1]), (1, "another text"), (700, text(3000)), (701, "  x y \x1c " * 9)]
    return rows


def test_documents(spark):
    rows = corpus(random.Random(6))
    df = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], SCHEMA).repartition(5)
    want = brute(rows, 8)
    assert sum(r[2] for r in want) > 10_000
    assert collected(remove_repeats(df, window=8, anchor=3)) == want
    assert collected(remove_repeats(df, window=8, anchor=3, shard_words=50, heavy_words=60)) == want  # many shards and split anchors
    assert collected(remove_repeats(df, window=35)) == brute(rows, 35)
    assert not remove_repeats(df.limit(0)).count()
    sha = remove_repeats(df, F.sha2(F.col("kept").cast("binary"), 256).alias("h"), window=8)
    assert sorted((r["h"] for r in sha.collect())) == sorted(hashlib.sha256(w[3].encode()).hexdigest() for w in want)


def test_anchors_spread_a_hot_passage(spark):
    """What a shard gets of a passage in all documents doesn't grow with the documents."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, 1, " ".join(f"u{rng.randrange(10**9)}" for _ in range(50)) + " " + passage) for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, copies long, text string")
    where, what = substrings.segments_of(texts, anchored_runs, 35, 8)
    inside = what.where("weight = 300")
    assert inside.count() >= 1 and what.where("weight > 1").count() < 12
    assert where.join(inside, "segment").count() == 300 * inside.count()


def test_query(spark):
    agree(substrings.op11_substring_dedup(spark, "/root/testdata/sf0.01"), substrings.ORACLES["op11_substring_dedup"], "/root/testdata/sf0.01")
