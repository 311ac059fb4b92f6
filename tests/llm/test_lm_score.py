import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from strandlake.llm import lm_score as L
from strandlake.llm.common import materialize
from strandlake.llm.decontamination import word_hashes

SCHEMA = "doc_id long, text string, log_prob string, n_words int, word long"


def corpus():
    """Sentences of word pairs: each word is known from the one beside it."""
    rng = random.Random(31)
    pairs = [(f"a{i}", f"b{i}") for i in range(40)]
    return [" ".join(w for _ in range(rng.randrange(5, 60)) for w in rng.choice(pairs)) for _ in range(400)]


def hashes(text):
    return word_hashes(pa.array([text], pa.string()))[0]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    flat = L.initial().astype(np.float64)
    ids = rng.integers(1, L.SIZE, 60).astype(np.uint16)
    padded, where = L.contexts([ids[:25], ids[:0], ids[25:]])
    assert (padded[where] == ids).all() and len(padded) == 60 + 4 * L.SIDE and (padded[np.setdiff1d(np.arange(len(padded)), where)] == 0).all()
    step = L.gradient(L.split(flat), padded, where)
    loss = lambda f: -L.forward(L.split(f), padded, where).log_prob.mean()
    for at in np.argsort(-np.abs(step))[::40][:12]:
        up, down = flat.copy(), flat.copy()
        up[at] += 1e-3
        down[at] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - step[at]) < 1e-3 * max(1, abs(step[at]))


def loop_log_probs(net, ids):
    """Of each word, by the definition."""
    ids, out = [0, 0, *ids, 0, 0], []
    for i in range(2, len(ids) - 2):
        h = np.tanh(net["bias"] + sum(net["embed"][k][ids[i + o]] for k, o in enumerate((-2, -1, 1, 2))))
        one = 0.0
        for logits, right in ((h @ net["w_class"] + net["b_class"], ids[i] // L.WITHIN), (h @ net["w_in"][ids[i] // L.WITHIN] + net["b_in"][ids[i] // L.WITHIN], ids[i] % L.WITHIN)):
            one += logits[right] - np.log(np.exp(logits).sum())
        out.append(one)
    return out


@pytest.fixture(scope="module")
def wide():
    """Texts of so many words that the network doesn't know all."""
    rng = random.Random(5)
    return [" ".join(f"w{int(rng.paretovariate(0.35))}" for _ in range(80)) for _ in range(120)] + ["zz yy zz"]


def test_scores_equal_loops(spark, wide):
    """Every word's probability is the network's of its id times its share of its bucket, also where counts are joined."""
    df = frame(spark, wide)
    counts = materialize(L.count_words(df))
    words = L.frequent_words(counts)
    n = {}
    for h in np.concatenate([hashes(t) for t in wide]).tolist():
        n[h] = n.get(h, 0) + 1
    assert words.total == sum(n.values()) and len(words.hashes) == len(n) > L.SIZE
    known = set(sorted(n, key=lambda h: (-n[h], np.int64(np.uint64(h).view(np.int64))))[: L.SIZE - L.BUCKETS - 1])
    of = lambda h: (h >> 20) % L.BUCKETS
    totals = [sum(c for h, c in n.items() if h not in known and of(h) == b) for b in range(L.BUCKETS)]
    assert words.buckets.tolist() == totals
    flat = (np.random.default_rng(2).standard_normal(len(L.initial())) * 0.3).astype(np.float32)
    kept = np.flatnonzero((words.shares == 0) | (np.arange(len(words.hashes)) % 2 == 0))
    fewer = replace(words, hashes=words.hashes[kept], ids=words.ids[kept], shares=words.shares[kept])
    for w in (words, fewer):
        got = {r.doc_id: r for r in L.score_rows(L.encoded(df, w), w, counts, flat).collect()}
        for i in (0, 7, 120):
            own = hashes(wide[i]).tolist()
            want = sum(loop_log_probs(L.split(flat), words.look_up(np.array(own, np.uint64))[0].tolist())) + sum(np.log(n[h] / totals[of(h)]) for h in own if h not in known)
            assert got[i].n_words == len(own) and abs(got[i].log_prob - want) < 1e-3


def test_probabilities_add_up(spark, wide):
    flat = (np.random.default_rng(3).standard_normal(len(L.initial())) * 0.3).astype(np.float32)
    total = 0.0
    for word in range(L.SIZE):
        total += np.exp(L.forward(L.split(flat), np.array([0, 0, 5, word, 7, 0, 0], np.int32), np.array([3])).log_prob[0])
    assert abs(total - 1) < 1e-3
    words = L.frequent_words(L.count_words(frame(spark, wide)))
    in_buckets = words.ids >= L.SIZE - L.BUCKETS
    shares = np.bincount(words.ids[in_buckets], np.exp(words.shares[in_buckets]))[L.SIZE - L.BUCKETS :]
    assert np.allclose(shares[words.buckets > 0], 1)


def test_few_frequent_words(spark):
    counts = spark.createDataFrame([(i, 1 + 100 * (i % 4 == 0)) for i in range(400)], "word long, n long")
    assert len(L.frequent_words(counts, top=150).hashes) == 100 and len(L.frequent_words(counts, top=99).hashes) == 0
    assert L.frequent_words(counts, top=99).buckets.sum() == L.frequent_words(counts).total == 400 + 100 * 100


def test_a_round_equals_loops_and_partitions_do_not_matter(spark):
    texts = corpus()[:90] + ["", None, "only"]
    flat = L.initial()
    found = []
    for parts in (1, 5):
        df = frame(spark, texts).repartition(parts)
        words = L.frequent_words(L.count_words(df))
        rows = L.encoded(df, words)
        found.append(L.train_round(rows, flat, 0, 7))
    assert np.abs(found[0] - found[1]).max() < 1e-6
    kept = rows.where("n_words > 0").select((F.pmod(F.xxhash64("ids", F.lit(-1)), F.lit(7))).alias("s"), F.xxhash64("ids", F.lit(0)).alias("p"), "ids").collect()
    total, seen = np.zeros(len(flat)), 0
    for shard in range(7):
        own, squares, held, count = flat.copy(), np.full(len(flat), 1e-6, np.float32), [], 0
        mine = [np.frombuffer(r.ids, "<u2") for r in sorted((r for r in kept if r.s == shard), key=lambda r: (r.p, bytes(r.ids)))]
        for k, ids in enumerate(mine):
            held.append(ids)
            if sum(map(len, held)) >= L.STEP_WORDS or k == len(mine) - 1:
                padded, where = L.contexts(held)
                for at in range(0, len(where), L.STEP_WORDS):
                    g = L.gradient(L.split(own), padded, where[at : at + L.STEP_WORDS])
                    squares += g * g
                    own = own - L.RATE * g / np.sqrt(squares)
                count, held = count + len(where), []
        total, seen = total + own.astype(float) * count, seen + count
    assert seen == sum(len(hashes(t)) for t in texts) and np.abs(total / seen - found[0]).max() < 1e-5


def test_training_helps_and_knows_order(spark):
    train = frame(spark, corpus()).repartition(2)
    rng = random.Random(4)
    held = [" ".join(w for _ in range(30) for w in rng.choice([(f"a{i}", f"b{i}") for i in range(40)])) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 60)) for t in held]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(held + mixed)] + [(100, None, "x", 1, 2), (101, "?!", "x", 1, 2), (102, "a1 b1 " * 30_000, "x", 1, 2), (0, held[0], "x", 1, 2), (None, "a1", "x", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = L.score(docs, train, rounds=8).collect()
    assert len(got) == len(rows)
    mean = {r.doc_id: r.mean_log_prob for r in got}
    before = {r.doc_id: r.mean_log_prob for r in L.score(docs, train, rounds=0).collect()}
    average = lambda m, a, b: np.mean([m[i] for i in range(a, b)])
    assert average(mean, 0, 20) > average(mean, 20, 40) + 0.5
    assert average(mean, 0, 20) > average(before, 0, 20) + 1.0
    empty = [r for r in got if r.doc_id in (100, 101)]
    assert all((r.n_words, r.log_prob, r.mean_log_prob, r.perplexity) == (0, 0.0, None, None) for r in empty)
    assert all(abs(r.perplexity - np.exp(-r.mean_log_prob)) < 1e-6 * r.perplexity for r in got if r.n_words)


def test_rare_words_are_told_apart_by_their_counts(spark, wide):
    rng = random.Random(6)
    once = [" ".join(f"q{rng.randrange(10**9)}" for _ in range(60)) for _ in range(20)]
    texts = wide + once + once[:10]
    got = {r.doc_id: r.log_prob for r in L.score(frame(spark, texts), rounds=1).collect()}
    twice, single = [got[len(wide) + i] for i in range(10)], [got[len(wide) + i] for i in range(10, 20)]
    assert min(twice) > max(single)


def test_nothing_to_learn(spark):
    df = frame(spark, [None])
    assert L.score(df).collect()[0].n_words == 0
    assert L.score(df.limit(0)).collect() == []
