"""LM scoring by masked pseudo-likelihood.

A network over a window of words on both sides predicts each word; the sum of the words' conditional log-probabilities
scores a document. The network knows the most frequent words of the whole corpus, by hash, and has buckets for all others;
within its bucket, a word has the share of its count in the corpus, so that every word of any corpus has a probability of
its own. The output is factored: the word's class, and the word within its class.

Training is synchronous. Documents are dealt to shards by a hash of their words, of about SHARD_WORDS words each, and put in
an order that another hash decides; in each round a pass over all positions of a shard starts from the common parameters,
and the shards' parameters are averaged by the positions they saw. So the model depends on the texts, not on partitions.
What is gathered grows with the input: counts of all words, and the sum of parameters from each task, added up in the
cluster in two steps; the driver gets one set, and the counts of at most TOP words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, materialize, table
from .decontamination import word_hashes

#: Words have SIZE ids, the last BUCKETS of which are for words that the network doesn't know; id 0 is what lies beyond a text.
CLASSES, WITHIN, BUCKETS, HIDDEN, SIDE = 32, 32, 64, 16, 2
SIZE = CLASSES * WITHIN
#: Frequent words whose counts go to every task; the others' are joined.
TOP = 1 << 17
#: Passes over all positions, words in a step, Adagrad's step size, words of a shard.
ROUNDS, STEP_WORDS, RATE, SHARD_WORDS = 2, 4096, 0.1, 2_000_000
SLOTS, BLOCKS = 64, 8
CONTEXT = 2 * SIDE
SHAPES = {"embed": (CONTEXT, SIZE, HIDDEN), "bias": (HIDDEN,), "w_class": (HIDDEN, CLASSES), "b_class": (CLASSES,), "w_in": (CLASSES, HIDDEN, WITHIN), "b_in": (CLASSES, WITHIN)}
LENGTHS = {k: int(np.prod(s)) for k, s in SHAPES.items()}
#: Bounds of the scores before the exponential.
MOST = 60.0


def initial() -> np.ndarray:
    rng = np.random.default_rng(3)
    scale = {"embed": 0.1, "w_class": 0.1, "w_in": 0.1}
    return np.concatenate([(rng.standard_normal(n) * scale.get(k, 0)).astype(np.float32) for k, n in LENGTHS.items()])


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum(list(LENGTHS.values()))
    return {k: flat[e - LENGTHS[k] : e].reshape(SHAPES[k]) for k, e in zip(SHAPES, ends.tolist(), strict=True)}


# ---------------------------------------------------------------------------------------------- words


def count_words(docs: DataFrame) -> DataFrame:
    """(word long, n) over all texts; a word is its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 8 << 20):
            found, n = np.unique(word_hashes(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return bounded(docs).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Words:
    """Frequent words by their sorted hashes: the network's id, and the logarithm of the word's share of its bucket."""

    hashes: np.ndarray
    ids: np.ndarray
    shares: np.ndarray
    #: Words in each bucket, all told, and in the corpus.
    buckets: np.ndarray
    total: int

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, logarithms of shares, and which words aren't among the frequent ones (share 0)."""
        ids, shares = (SIZE - BUCKETS + bucket_of(hashes)).astype(np.uint16), np.zeros(len(hashes))
        if not len(self.hashes):
            return ids, shares, np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        ids[found], shares[found] = self.ids[at[found]], self.shares[at[found]]
        return ids, shares, ~found


def frequent_words(counts: DataFrame, top: int = TOP) -> Words:
    """By a histogram of counts on a logarithmic scale, the classes of the highest counts that have at most ``top`` words
    together; those are all that reaches the driver."""
    scale = F.floor(F.log2("n") * 8).cast("int")
    rows = {r.c: r for r in counts.groupBy(scale.alias("c")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()}  # a few hundred
    least, words = None, 0
    for c in sorted(rows, reverse=True):
        words += rows[c].words
        if words > top:
            break
        least = c
    found = sorted(((r.n, r.word) for r in counts.where(scale >= least).collect()), key=lambda x: (-x[0], x[1])) if least is not None else []
    hashes, n = (np.array([r[k] for r in found], np.int64) for k in (1, 0))
    hashes, known = hashes.view(np.uint64), min(len(found), SIZE - BUCKETS - 1)
    part = F.call_function("shiftrightunsigned", F.col("word"), F.lit(20)).bitwiseAND(F.lit(BUCKETS - 1))
    buckets = np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(part.alias("b")).agg(F.sum("n").alias("n")).collect():
        buckets[r.b] = r.n
    np.subtract.at(buckets, bucket_of(hashes[:known]), n[:known])
    ids = np.concatenate([np.arange(1, known + 1), SIZE - BUCKETS + bucket_of(hashes[known:])]).astype(np.uint16)
    shares = np.concatenate([np.zeros(known), np.log(n[known:] / buckets[bucket_of(hashes[known:])])])
    order = np.argsort(hashes)
    return Words(hashes[order], ids[order], shares[order], buckets, sum(r.n for r in rows.values()))


def encoded(docs: DataFrame, words: Words) -> DataFrame:
    """(row, doc_id, n_words, ids binary, share double, rare array<long>) of every row, written to the shared folder: ids of
    the words in 2 bytes each, the sum of the logarithms of shares, and the hashes of words that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            hashes, ends = word_hashes(batch.column("text"))
            ids, shares, rare = words.look_up(hashes)
            starts, data = np.concatenate([[0], ends[:-1]]), ids.astype("<u2").tobytes()
            sums = np.concatenate([[0.0], np.cumsum(shares)])
            before = np.concatenate([[0], np.cumsum(rare)])
            offsets = pa.array(np.concatenate([[0], before[ends]]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.array([data[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    pa.array(sums[ends] - sums[starts]), pa.ListArray.from_arrays(offsets, pa.array(hashes[rare].view(np.int64))),
                ],
                ["doc_id", "n_words", "ids", "share", "rare"],
            )

    rows = bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, ids binary, share double, rare array<long>")
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


# ---------------------------------------------------------------------------------------------- the network


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids with SIDE zeros before each text and after the last, and where the words are."""
    sizes = np.array([len(t) for t in texts], np.int64)
    where = np.arange(sizes.sum()) + SIDE * (np.repeat(np.arange(len(texts)), sizes) + 1)
    padded = np.zeros(sizes.sum() + SIDE * (len(texts) + 1), np.int32)
    if len(texts):
        padded[where] = np.concatenate(texts)
    return padded, where


OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    np.clip(x, -MOST, MOST, out=x)
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], np.float32)


@dataclass
class Pass:
    """What the network says of some words, in the order of their classes."""

    where: np.ndarray
    around: list[np.ndarray]
    hidden: np.ndarray
    own: np.ndarray
    inner: np.ndarray
    edges: np.ndarray
    classes: np.ndarray
    class_sums: np.ndarray
    within: np.ndarray
    within_sums: np.ndarray
    log_prob: np.ndarray


def forward(net: dict, padded: np.ndarray, where: np.ndarray) -> Pass:
    own = (padded[where] // WITHIN).astype(np.uint8)
    order = np.argsort(own, kind="stable")
    where, own = where[order], own[order]
    inner = padded[where] % WITHIN
    around = [padded[where + o] for o in OFFSETS]
    hidden = net["embed"][0].take(around[0], axis=0)
    for k in range(1, CONTEXT):
        hidden += net["embed"][k].take(around[k], axis=0)
    hidden += net["bias"]
    np.tanh(hidden, out=hidden)
    x = hidden @ net["w_class"]
    x += net["b_class"]
    y = np.empty((len(where), WITHIN), hidden.dtype)
    edges = np.searchsorted(own, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(edges)).tolist():
        at = slice(edges[c], edges[c + 1])
        np.matmul(hidden[at], net["w_in"][c], out=y[at])
        y[at] += net["b_in"][c]
    (e, e_sums), (f, f_sums), row = exponentials(x), exponentials(y), np.arange(len(where))
    return Pass(where, around, hidden, own, inner, edges, e, e_sums, f, f_sums, x[row, own] + y[row, inner] - np.log(e_sums) - np.log(f_sums))


def gradient(net: dict, padded: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability, as one array."""
    p = forward(net, padded, where)
    n, row = len(where), np.arange(len(where))
    out, ones = np.zeros(sum(LENGTHS.values()), np.float32), np.ones(n, np.float32)
    grad = split(out)
    d_class, d_in = p.classes, p.within
    d_class /= (p.class_sums * n)[:, None]
    d_in /= (p.within_sums * n)[:, None]
    d_class[row, p.own] -= 1 / n
    d_in[row, p.inner] -= 1 / n
    np.matmul(p.hidden.T, d_class, out=grad["w_class"])
    grad["b_class"][:] = ones @ d_class
    d_hidden = d_class @ net["w_class"].T
    for c in np.flatnonzero(np.diff(p.edges)).tolist():
        at = slice(p.edges[c], p.edges[c + 1])
        grad["w_in"][c] = p.hidden[at].T @ d_in[at]
        grad["b_in"][c] = ones[at] @ d_in[at]
        d_hidden[at] += d_in[at] @ net["w_in"][c].T
    d_hidden *= 1 - p.hidden * p.hidden
    grad["bias"][:] = ones @ d_hidden
    for k in range(CONTEXT):
        ids = p.around[k].astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        grad["embed"][k][ids[first]] = np.add.reduceat(d_hidden.take(order, axis=0), first, axis=0)
    return out


class Learner:
    """Adagrad over the texts of one shard, in steps that only their order decides."""

    def __init__(self, flat: np.ndarray, step_words: int = STEP_WORDS) -> None:
        self.own, self.squares, self.seen = flat.copy(), np.full(flat.shape, 1e-6, np.float32), 0
        self.net, self.step_words = split(self.own), step_words
        self.texts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.texts.append(ids)
        self.held += len(ids)
        if self.held >= self.step_words:
            self.flush()

    def flush(self) -> None:
        padded, where = contexts(self.texts)
        for at in range(0, len(where), self.step_words):
            step = gradient(self.net, padded, where[at : at + self.step_words])
            self.squares += step * step
            self.own -= RATE * step / np.sqrt(self.squares)
        self.seen += len(where)
        self.texts, self.held = [], 0


def train_round(rows: DataFrame, flat: np.ndarray, number: int, shards: int) -> np.ndarray:
    """The average of the parameters that the shards reach from ``flat``, over (ids binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen, shard, learner = np.zeros(flat.shape), 0, None, None

        def finish() -> int:
            learner.flush()
            np.add(sums, learner.own.astype(np.float64) * learner.seen, out=sums)
            return learner.seen

        for batch in batches:
            for own, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != shard:
                    seen += finish() if learner else 0
                    shard, learner = own, Learner(flat)
                learner.add(np.frombuffer(ids, "<u2"))
        seen += finish() if learner else 0
        if seen:
            slot, parts = TaskContext.get().partitionId() % SLOTS, np.array_split(sums, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([slot] * BLOCKS, pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["block", "slot", "seen", "sums"],
            )

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in rows.column("sums").to_pylist())
        return pa.table({"block": rows.column("block")[:1], "slot": rows.column("slot")[:1], "seen": pa.array([sum(rows.column("seen").to_pylist())]), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, slot int, seen long, sums binary"
    dealt = rows.where("n_words > 0").select(F.pmod(F.xxhash64("ids", F.lit(-1)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("ids", F.lit(number)).alias("place"), "ids")
    ordered = bounded(dealt).repartition("shard").sortWithinPartitions("shard", "place", "ids").select("shard", "ids")
    parts = ordered.mapInArrow(run, kind).groupBy("block", "slot").applyInArrow(added, kind)
    found = sorted(parts.groupBy("block").applyInArrow(added, kind).collect())  # one set of parameters
    if not found:
        return flat
    return np.concatenate([np.frombuffer(r.sums, np.float64) / r.seen for r in found]).astype(np.float32)


def train(rows: DataFrame, words: Words, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """Parameters learned from all positions of ``encoded`` rows, in each round."""
    flat = initial()
    for number in range(rounds):
        flat = train_round(rows, flat, number, max(1, words.total // shard_words))
    return flat


def log_probs(flat: np.ndarray, texts: list[np.ndarray], step: int = 1 << 13) -> np.ndarray:
    """For each text, the sum of its ids' conditional log-probabilities."""
    padded, where = contexts(texts)
    net, each = split(flat), np.zeros(len(padded))
    for at in range(0, len(where), step):
        p = forward(net, padded, where[at : at + step])
        each[p.where] = p.log_prob
    sums, ends = np.concatenate([[0.0], np.cumsum(each[where])]), np.cumsum([len(t) for t in texts])
    return sums[ends] - np.concatenate([[0.0], sums[ends[:-1]]]) if len(texts) else np.zeros(0)


def score_rows(rows: DataFrame, words: Words, counts: DataFrame, flat: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob, perplexity of ``encoded`` rows. Rare words' counts come by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ids"):
            found = log_probs(flat, [np.frombuffer(b, "<u2") for b in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array(found + batch.column("share").to_numpy())], ["row", "doc_id", "n_words", "known"])

    known = bounded(rows).select("row", "doc_id", "n_words", "share", "ids").mapInArrow(run, "row long, doc_id long, n_words long, known double")
    uses = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    part = F.call_function("shiftrightunsigned", F.col("word"), F.lit(20)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    totals = F.array(*[F.lit(float(np.log(max(1, n)))) for n in words.buckets.tolist()])
    tail = uses.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * (F.log(F.coalesce("n", F.lit(1)).cast("double")) - F.element_at(totals, part + 1))).alias("tail"))
    log_prob = F.col("known") + F.coalesce("tail", F.lit(0.0))
    mean = F.when(F.col("n_words") > 0, log_prob / F.col("n_words"))
    return known.join(tail, "row", "left").select("doc_id", "n_words", log_prob.alias("log_prob"), mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def score(docs: DataFrame, training: DataFrame | None = None, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob, perplexity of every row, by a model of ``training`` (of docs themselves).

    A null text, or one without words, has log_prob 0 of 0 words and null mean and perplexity. Rows that repeat have scores
    of their own, equal ones for equal texts; a null doc_id stays null. A word that training hasn't counts as if it occurred
    once. An empty table gives an empty table; other columns aren't read. Scores don't depend on how rows are partitioned.
    """
    corpus = docs if training is None else training
    counts = materialize(count_words(corpus))
    words = frequent_words(counts)
    rows = encoded(corpus, words)
    flat = train(rows, words, rounds, shard_words)
    return score_rows(rows if training is None else encoded(docs, words), words, counts, flat)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
