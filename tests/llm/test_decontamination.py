import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from strandlake.llm.decontamination import RADIUS, WORD, Benchmark, counted, decontaminate, find_contamination, op2_decontamination, similarity, window_prints, word_hashes, prefix_lanes, shingles, window_shares

SCHEMA = "doc_id long, text string, item_id string, similarity int, first_word string"


def brute(text, item):
    """The greatest similarity of a window of the item's length."""
    a, b = WORD.findall((text or "").lower()), WORD.findall((item or "").lower())
    k = min(5, len(b))
    if not b or len(a) < k:
        return 0.0
    n = min(len(a), len(b))
    return max(similarity(counted(b, k), counted(a[s : s + n], k)) for s in range(len(a) - n + 1))


def test_prints_of_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for n in (1, 4, 255, 256, 700):
        starts = np.array([0, 3, 150])
        got = window_prints(prefix_lanes(h), starts, n)
        for s, fp in zip(starts, got, strict=True):
            want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[s : s + n]) > n)
            assert int(fp) == want


def test_words():
    texts = ["Hello, wörld 42!", None, "", "a", "b  a", "x" * 5000]
    words, ends = word_hashes(pa.array(texts))
    assert ends.tolist() == [3, 3, 3, 4, 6, 7]
    assert words[3] == words[5] and len(set(words.tolist())) == 6
    assert len(shingles(words[:3], 5)) == 0


def test_tables_find_all_within_the_radius():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(20))) for i in range(70)]
    bench = Benchmark.of(items)
    prints = np.array([p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(40))) for p in bench.prints], np.uint64)
    got = set(zip(*(x.tolist() for x in bench.within(20, prints)[:2]), strict=True))
    want = {(w, i) for w, p in enumerate(prints.tolist()) for i, q in enumerate(bench.prints) if bin(p ^ q).count("1") <= RADIUS}
    assert got == want


def documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (60, 60, 30, 14, 300, 6, 5, 3, 1)] + [None, "", "?!", "rose is a rose is a rose is a rose"]
    items.append(items[2] + " tail end")
    docs = [None, "", "!!", "short", items[3], items[2].upper()]
    for _ in range(120):
        base = [word() for _ in range(rng.randrange(0, 150))]
        item = WORD.findall(rng.choice([i for i in items if i]))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if item:
                item[rng.randrange(len(item))] = word()
        at = rng.randrange(len(base) + 1)
        docs.append(" ".join(base[:at] + item[rng.choice([0, 0, 1, 3]) :] + base[at:]))
    return items, docs + [("filler word " * 40_000) + items[0]]


def test_matches_equal_brute_force(spark):
    items, docs = documents()
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i): s for d, text in enumerate([*docs[:-1], "filler word " * 100 + items[0]]) for i, item in enumerate(items) if (s := brute(text, item)) >= 0.8}
    for size in (1 << 20, 600):
        got = {(r.doc_id, r.item_id): r.similarity for r in find_contamination(df, bench, pass_bytes=size).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(set(range(len(docs))) - {d for d, _ in want})


def test_edges(spark):
    items, docs = documents()
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in enumerate(docs[:4])] + [(None, items[2], "a", 1, "b")] * 2, SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_contamination(df, bench).collect() if r.item_id == 2] == [(None, 2)] * 2
    assert find_contamination(df, bench.limit(0)).collect() == [] and find_contamination(df.limit(0), bench).collect() == []
    assert decontaminate(df, bench.limit(0)).count() == 6


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in op2_decontamination(spark, sf).collect()}
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert planted <= got and len(planted) > 10
    texts, by_item = {d.doc_id: d.text for d in docs}, {i.item_id: i.text for i in items}
    assert all(brute(texts[d], by_item[i]) >= 0.8 for d, i in got)


def test_shares_of_windows():
    rng = random.Random(6)
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randrange(5, 60))]
        item = [rng.choice("abcd") for _ in range(rng.randrange(1, 20))]
        kinds = sorted(set(item))
        weights = np.array([item.count(c) for c in kinds])
        places = np.array([i for i, c in enumerate(words) if c in kinds], np.int64)
        code = np.array([kinds.index(words[p]) for p in places], np.int64)
        n = rng.randrange(1, len(words) + 1)
        starts = np.array(sorted(rng.sample(range(len(words) - n + 1), rng.randrange(1, len(words) - n + 2))))
        want = [sum(min(v, Counter(item)[c]) for c, v in Counter(words[s : s + n]).items()) for s in starts]
        assert window_shares(places, code, weights, starts, n).tolist() == want


def test_repeated_and_nearly_equal_items_take_linear_time_and_little_memory():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]

    def near():
        copy = list(base)
        copy[rng.randrange(400)] = "other"
        return " ".join(copy)

    items = [(i, near()) for i in range(300)]
    bench, one = Benchmark.of(items), Benchmark.of(items[:1])
    clock = []
    for copies in (5, 40):
        began = time.perf_counter()
        assert len(list(one.matches(pa.array([" ".join([items[0][1]] * copies)]), 0.8))) == 1
        clock.append(time.perf_counter() - began)
    assert clock[1] < 40 * max(clock[0], 0.01)
    text = pa.array([" ".join([items[0][1]] * 40)])
    tracemalloc.start()
    got = list(bench.matches(text, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 300 and peak < 300 << 20
    assert len(list(Benchmark.of([(0, "a " * 400)]).matches(pa.array(["a " * 40_000]), 0.8))) == 1
