"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item of L words is looked for in the windows of L words that hold its word shingles at as many places as the similarity
needs at least (counted by running sums). The window's SimHash is looked up among the items of that length: fingerprints
are cut into BLOCKS bytes, and a table for each byte value holds the items within RADIUS // BLOCKS bits of it, so every
item within RADIUS bits of the window is found. RADIUS is the largest that the tables guarantee; at the similarity
asked for, a fingerprint lies farther off with a chance of about one in a million. Candidates within RADIUS are verified by
the exact weighted Jaccard similarity of their shingles, weights being the times a shingle occurs.

Words are runs of ASCII letters, digits and non-ASCII characters in lower case.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, filter_rows, table

WORDS, SIMILARITY = 5, 0.8
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Bytes of benchmark texts that one pass over the documents may broadcast; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20
#: Windows times items that are looked up at once.
CHUNK_PAIRS = 1 << 21
WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
LANES = np.uint64(0x0101010101010101)
P, Q, M1, M2 = (np.uint64(x) for x in (0x100000001B3, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
MATCHES = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and where each text's words end."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b" ".join(lowered.cast(pa.binary()).to_pylist()) + b" ", np.uint8)
    is_word = np.zeros(256, bool)
    is_word[97:123] = is_word[48:58] = is_word[128:] = True
    inside = is_word[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.searchsorted(starts, np.cumsum(sizes + 1))
    if not len(starts):
        return np.zeros(0, np.uint64), ends
    widths = stops - starts
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(widths.max()), P))])
    first = np.cumsum(widths) - widths
    place = np.arange(int(widths.sum())) - np.repeat(first, widths)
    return mixed(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)), ends


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles that start at each word; fewer than k words have none."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * Q + words[j : j + n]
    return mixed(h + np.uint64(k))


def prefix_lanes(hashes: np.ndarray) -> list[np.ndarray]:
    """Running sums of the bits in byte lanes. Differences over up to 255 hashes are exact though the sums wrap."""
    return [np.concatenate([[np.uint64(0)], np.cumsum((hashes >> np.uint64(b)) & LANES, dtype=np.uint64)]) for b in range(8)]


def window_prints(lanes: list[np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start."""
    out = np.zeros(len(starts), np.uint64)
    for b, sums in enumerate(lanes):
        ones = np.zeros((len(starts), 8), np.int64)
        for at in range(0, n, 255):
            part = sums[starts + min(n, at + 255)] - sums[starts + at]
            ones += part.astype("<u8").view(np.uint8).reshape(-1, 8)
        out |= ((2 * ones > n).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(b))).sum(axis=1, dtype=np.uint64)
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the sum of the lesser weights over the sum of the greater."""
    least = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return least / (sum(a.values()) + sum(b.values()) - least)


def counted(words: list[str], k: int) -> Counter:
    return Counter(zip(*(words[j:] for j in range(k)), strict=False))


@dataclass
class Benchmark:
    """Items by length, with tables that find all fingerprints within RADIUS."""

    ids: list[int] = field(default_factory=list)
    shingle_words: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    prints: list[int] = field(default_factory=list)
    counters: list[Counter] = field(default_factory=list)
    #: of each item: its sorted shingles' hashes, and how often it has each
    hashes: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    #: for each shingle size: sorted hashes; where each one's holders begin and end; holders, and the weights they give it
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    by_length: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Benchmark:
        self = cls()
        for item, text in sorted(items, key=repr):
            lowered = pc.utf8_lower(pa.array([text or ""]))
            words = WORD.findall(lowered[0].as_py())
            if not words:
                continue
            k = min(WORDS, len(words))
            hashes = shingles(word_hashes(pa.array([text]))[0], k)
            self.ids.append(item)
            self.shingle_words.append(k)
            self.lengths.append(len(words))
            self.prints.append(int(window_prints(prefix_lanes(hashes), np.zeros(1, np.int64), len(hashes))[0]))
            self.counters.append(counted(words, k))
            found, n = np.unique(hashes, return_counts=True)
            self.hashes.append(found)
            self.weights.append(n)
        for k in set(self.shingle_words):
            own = [i for i, words in enumerate(self.shingle_words) if words == k]
            hashes = np.concatenate([self.hashes[i] for i in own])
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            items_ = np.repeat(own, [len(self.hashes[i]) for i in own])[order]
            self.known[k] = known, np.append(first, len(order)), items_, np.concatenate([self.weights[i] for i in own])[order]
        bits = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= NEAR
        for length in set(self.lengths):
            at = np.array([i for i, n in enumerate(self.lengths) if n == length])
            self.by_length[length] = at
            own = np.array([self.prints[i] for i in at], np.uint64)
            # [block, byte value, items in packed bits]
            self.tables[length] = np.stack([np.packbits(near[:, (own >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)], axis=1) for b in range(BLOCKS)])
        return self

    def within(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all windows and items of that length within RADIUS bits."""
        found = np.zeros((len(prints), self.tables[length].shape[2]), np.uint8)
        for b in range(BLOCKS):
            found |= self.tables[length][b, (prints >> np.uint64(8 * b) & np.uint64(255)).astype(np.int64)]
        window, at = np.nonzero(np.unpackbits(found, axis=1, count=len(self.by_length[length])))
        item = self.by_length[length][at]
        distance = np.bitwise_count(prints[window] ^ np.array(self.prints, np.uint64)[item])
        near = distance <= RADIUS
        return window[near], item[near], distance[near]

    def matches(self, texts: pa.Array, least: float) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, distance, similarity): the most similar window of each text and item."""
        if not self.ids:
            return
        words, ends = word_hashes(texts)
        owner_start = np.concatenate([[0], ends[:-1]])
        for k, (known, *_) in self.known.items():
            h = shingles(words, k)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hits = np.flatnonzero(known[at] == h)
            text = np.searchsorted(ends, hits, "right")
            whole = hits + k <= ends[text]
            hits, text = hits[whole], text[whole]
            if not len(text):
                continue
            edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(text)], strict=True):
                t = int(text[a])
                yield from self._in_text(t, texts[t].as_py(), words[owner_start[t] : ends[t]], hits[a:b] - owner_start[t], at[hits[a:b]], k, least)

    def _in_text(self, t: int, text: str, words: np.ndarray, places: np.ndarray, at: np.ndarray, k: int, least: float):
        """Of a text's places that hold the known shingles ``at``. Work and memory are linear in the places of each item
        that the text covers well enough, windows going in chunks."""
        _, borders, holders, weights = self.known[k]
        total = len(words) - k + 1
        distinct = np.unique(at)
        spans = [slice(a, b) for a, b in zip(borders[distinct], borders[distinct + 1], strict=True)]
        # a window shares at most what the whole text has of an item's weight
        shared = np.bincount(np.concatenate([holders[s] for s in spans]), np.concatenate([weights[s] for s in spans]))
        lengths: dict[int, list[int]] = defaultdict(list)
        for item in np.flatnonzero(shared).tolist():
            m = self.lengths[item] - k + 1
            if shared[item] >= needed(min(m, total), m, least):
                lengths[self.lengths[item]].append(item)
        if not lengths:
            return
        hashes, spelled = self.known[k][0][at], None
        lanes = prefix_lanes(shingles(words, k))
        for length, items in lengths.items():
            m = length - k + 1
            n = min(m, total)
            reached, occurrences = np.zeros(total - n + 1, bool), {}
            for item in items:
                code = np.minimum(np.searchsorted(self.hashes[item], hashes), len(self.hashes[item]) - 1)
                held = self.hashes[item][code] == hashes
                occurrences[item] = places[held].astype(np.int32), code[held].astype(np.int32)
                count = np.cumsum(np.bincount(places[held], minlength=total))
                reached |= count[n - 1 :] - np.concatenate([[0], count[: total - n]]) >= needed(n, m, least)
            starts, best = np.flatnonzero(reached), {}
            step = max(64, CHUNK_PAIRS // len(self.by_length[length]))
            for begin in range(0, len(starts), step):
                chunk = starts[begin : begin + step]
                window, item, distance = self.within(length, window_prints(lanes, chunk, n))
                for i in np.unique(item).tolist():
                    if i not in occurrences:
                        continue
                    mine = window[item == i]
                    share = window_shares(*occurrences[i], self.weights[i], chunk[mine], n)
                    found = share / (n + m - share)
                    top = int(np.argmax(found))
                    if found[top] >= least and (i not in best or found[top] > best[i][0]):
                        best[i] = found[top], int(chunk[mine[top]]), int(distance[item == i][top])
            for i, (_, start, d) in best.items():
                if spelled is None:
                    spelled = WORD.findall(pc.utf8_lower(pa.array([text]))[0].as_py())
                exact = similarity(self.counters[i], counted(spelled[start : start + n + k - 1], k))
                if exact >= least:
                    yield t, self.ids[i], start, n + k - 1, d, exact


def needed(n: int, m: int, least: float) -> float:
    """What a window of n and an item of m shingles must share for the similarity; a trifle less, for rounding."""
    return least * (n + m) / (1 + least) - 1e-6


def window_shares(places: np.ndarray, code: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The summed lesser weights of an item's shingles in the windows of n places from each of the sorted ``starts``.

    A place counts in those windows that hold it, but not as many earlier places of its shingle as the item has.
    """
    inside = slice(*np.searchsorted(places, [starts[0], starts[-1] + n]))
    places, code = places[inside], code[inside]
    order = np.lexsort((places, code))
    by_code, by_place = code[order], places[order]
    rank = np.arange(len(order))
    back = rank - weights[by_code]
    full = (back >= 0) & (by_code[np.maximum(back, 0)] == by_code)
    after = np.where(full, by_place[np.maximum(back, 0)] + 1, 0)  # the first start past so many earlier ones
    low = np.searchsorted(starts, np.maximum(after, by_place - n + 1))
    high = np.searchsorted(starts, by_place, "right")
    change = np.bincount(low, minlength=len(starts) + 1) - np.bincount(np.maximum(high, low), minlength=len(starts) + 1)
    return np.cumsum(change[:-1])


def benchmark_passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[Benchmark]:
    """The items (item_id, text) in parts of about ``pass_bytes``; one part if the benchmark is small."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first().b or 0
    parts = max(1, -(-size // pass_bytes))
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else items
        yield Benchmark.of([(r.item_id, r.text) for r in mine.collect()])  # at most about pass_bytes


def find_contamination(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A row for each document and item of which a window of the document has the similarity, with the best window.

    Null and empty texts hold nothing, and null or wordless items match nothing. An item of fewer than five words has
    one shingle, all its words; a document shorter than an item is one window. Repeated rows each have their matches;
    of equally similar windows the first is given. Empty tables on either side give an empty table.
    """
    out = None
    for items in benchmark_passes(benchmark, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                ids = batch.column("doc_id")
                rows = list(items.matches(batch.column("text"), least))
                columns = [[r[k] for r in rows] for k in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True))],
                    ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"],
                )

        found = bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents, all columns as they are and of any names, that no benchmark item is found in. Repeated rows go or stay
    together; an empty table, or an empty benchmark, leaves the table as it is."""
    for items in benchmark_passes(benchmark, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in items.matches(batch.column("text"), least)]] = False
                yield batch.filter(pa.array(keep))

        docs = filter_rows(docs, run)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
