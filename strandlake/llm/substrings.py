"""Repeated passages, found by compressed full-text indexes of shards of the corpus.

A passage is repeated if a window of WINDOW words in it also starts anywhere else. An index of the whole corpus fits no
machine, and searching every document in every shard's index is quadratic, so windows are dealt to shards by content:
a window's anchor is the least hash of its short word sequences, equal windows have equal anchors, and all segments (runs
of windows with one anchor) of an anchor go to one shard. An anchor that the whole corpus has once can't have a
repeated window, so only segments of repeated anchors move, and of equal segments only one, with a weight.

A shard builds the Burrows-Wheeler transform of its segments over word numbers, as a wavelet matrix of packed bits with
counts for each 64, and streams the segments against it: backward search extends a match to the left while the matched
suffixes weigh two or more, that is, computes matching statistics up to the longest match asked for. What matches over
a window or more is reported as intervals. A mismatch proves all windows around it unrepeated, so these are skipped.

Anchors with more distinct segments than a shard should hold, such as those next to a passage that a third of all
documents have, are split once more, by the hash of the whole window, with the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, discard, materialize, release, table

WINDOW, ANCHOR = 35, 8
#: Words of distinct segments in a shard, and of one anchor before it is split; windows of a segment.
SHARD_WORDS, HEAVY_WORDS, RUN = 400_000, 20_000, 512
P, Q, M1, M2 = (np.uint64(x) for x in (0x100000001B3, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and where each text's words end."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    if not len(starts):
        return np.zeros(0, np.uint64), ends
    widths = stops - starts
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(widths.max()), P))])
    first = np.cumsum(widths) - widths
    place = np.arange(int(widths.sum())) - np.repeat(first, widths)
    return mixed(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)), ends


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on; fewer than k words have none."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * Q + words[j : j + n]
    return mixed(h)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_starts(ends: np.ndarray, window: int) -> np.ndarray:
    """Whether a window inside one text starts at each word."""
    allowed = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        allowed[a : max(a, b - window + 1)] = True
    return allowed


def anchored_runs(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first window and the one after the last, anchor, how often the run has it."""
    words, ends = word_hashes(texts)
    if len(words) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    width = window - anchor + 1
    grams = sequence_hashes(words, anchor)
    key = least_of(grams, width)
    allowed = window_starts(ends, window)[: len(key)]
    at = np.flatnonzero(allowed)
    of = np.searchsorted(ends, at, "right")
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[at[1:]] != key[at[:-1]]) | (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
    serial = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    fresh |= serial % RUN == 0
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at))
    starts, stops = at[first], at[last - 1] + 1
    lengths = stops - starts + width - 1
    offset = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) + np.repeat(starts - offset, lengths)
    n = np.add.reduceat((grams[place] == np.repeat(key[starts], lengths)).astype(np.int64), offset) if len(first) else np.zeros(0, np.int64)
    before = np.concatenate([[0], ends[:-1]])[of[first]]
    return of[first], starts - before, stops - before, key[starts], n


def single_windows(texts: list[bytes], window: int, _anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every window as a run of its own, whose anchor is the hash of all its words."""
    words, ends = word_hashes(texts)
    at = np.flatnonzero(window_starts(ends, window))
    of = np.searchsorted(ends, at, "right")
    start = at - np.concatenate([[0], ends[:-1]])[of] if len(ends) else at
    return of, start, start + 1, sequence_hashes(words, window)[at], np.ones(len(at), np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence: for each bit a packed row, with the number of ones before each 64."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.rows, self.counts, self.zeros, n = [], [], [], len(symbols)
        for b in reversed(range(self.bits)):
            one = (symbols >> b) & 1 == 1
            packed = np.packbits(np.concatenate([one, np.zeros(64 - n % 64, bool)]), bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.rows.append(packed)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(n - int(ones.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def sink(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the occurrences of each symbol before each place end in the last row."""
        for k, b in enumerate(reversed(range(self.bits))):
            word, low = place >> 6, (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.rows[k][word] & low)
            place = np.where((symbol >> b) & 1 == 1, self.zeros[k] + ones, place - ones)
        return place


class FMIndex:
    """Backward search over segments of word numbers from 1 up; 0 ends each segment."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray) -> None:
        n = len(symbols)
        ends = symbols == 0
        rank = symbols + int(ends.sum())
        rank[ends] = np.arange(int(ends.sum()))  # no two ends are equal, so no match runs over one
        span = 1
        while True:
            order = np.argsort(rank)
            ordered = rank[order]
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
            if not n or dense[order[-1]] == n - 1:
                break
            rank = dense * (n + 1) + np.concatenate([dense[span:] + 1, np.zeros(min(span, n), np.int64)])
            span *= 2
        self.n = n
        self.tree = WaveletMatrix(symbols[order - 1])
        first = np.concatenate([[0], np.cumsum(np.bincount(symbols))[:-1]])
        every = np.arange(len(first))
        self.shift = first - self.tree.sink(every, np.zeros(len(first), np.int64))
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with the symbol and go on as those from ``low`` to before ``high``."""
        both = self.tree.sink(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(symbol)] + self.shift[symbol], both[len(symbol) :] + self.shift[symbol]

    def total(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_windows(segments: list[bytes], weights: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment the runs of window starts, [first, end), whose words weigh two or more in all segments.

    A lane goes through one segment: it asks for the match of a stretch, at first of the whole segment, from the right
    to the left. If it is found, its windows are repeated, and the next stretch may be twice as long; if not, a longer
    stretch is asked for by its first window alone, and of one window all windows with the mismatched part are skipped.
    """
    words = pc.split_pattern(pa.array(segments, pa.binary()).cast(pa.string()), " ")
    codes = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    lengths = np.diff(words.offsets.to_numpy())
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.zeros(int((lengths + 1).sum()), np.int64)
    symbols[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
    index = FMIndex(symbols, np.repeat(weights, lengths + 1))
    found = np.zeros(len(symbols) + 1, np.int64)  # +1 where a run of windows starts, -1 where it ends

    lane = np.flatnonzero(lengths >= window)
    at, end = begin[lane], begin[lane] + lengths[lane] - window + 1  # first open window, and the end of all
    step = end - at
    place = at + step + window - 2
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    while len(at):
        low, high = index.extend(symbols[place], low, high)
        matched = index.total(low, high) >= 2
        done = matched & (place == at)
        found[at[done]] += 1
        found[at[done] + step[done]] -= 1
        lost = ~matched
        at = np.where(done, at + step, np.where(lost & (step == 1), place + 1, at))
        turn = done | lost
        step = np.where(done, 2 * step, np.where(lost, 1, step))
        step = np.where(turn, np.minimum(step, end - at), step)
        place = np.where(turn, at + step + window - 2, place - 1)
        low, high = np.where(turn, 0, low), np.where(turn, index.n, high)
        open_ = at < end
        if not open_.all():
            at, end, step, place, low, high = (v[open_] for v in (at, end, step, place, low, high))
    inside = np.cumsum(found) > 0
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(begin, first, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for s, a, b in zip(of.tolist(), (first - begin[of]).tolist(), (last - begin[of]).tolist(), strict=True):
        out[s].append((a, b))
    return out


def segments_of(texts: DataFrame, runs_of: Callable, window: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """Segments of (id long, copies long, text) whose anchors occur more than once.

    Returns where they are, (segment binary, id, start, stop), and what they are, (segment, number, key, weight, n_words, words).
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            of, start, stop, key, n = runs_of([t or b"" for t in batch.column("text").to_pylist()], window, anchor)
            ids, copies = (batch.column(c).to_numpy(zero_copy_only=False)[of] for c in ("id", "copies"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array((start << 32) + stop), pa.array(n * copies)], ["key", "id", "span", "n"])

    raw = texts.select("id", "copies", F.col("text").cast("binary").alias("text"))
    runs = materialize(raw.mapInArrow(spans, "key long, id long, span long, n long"))
    # written, so that the join deals both sides anew and can split the rows of a hot anchor
    again = materialize(runs.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    wanted = materialize(runs.select("key", "id", "span").join(again, "key").groupBy("id").agg(F.collect_list(F.struct("span", "key")).alias("cuts")))  # at most a text's words
    discard(runs)
    discard(again)
    release(texts.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out, seen = [], set()
            for id_, copies, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("id", "copies", "text", "cuts")), strict=True):
                words = text.split()
                for c in cuts:
                    start, stop = c["span"] >> 32, c["span"] & 0xFFFFFFFF
                    segment = b" ".join(words[start : stop + window - 1])
                    name = hashlib.blake2b(segment, digest_size=16).digest()
                    out.append((name, c["key"], id_, start, stop, copies, stop - start + window - 1, None if name in seen else segment))
                    seen.add(name)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            names = ("segment", "key", "id", "start", "stop", "copies", "n_words", "words")
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names)

    schema = "segment binary, key long, id long, start int, stop int, copies long, n_words int, words binary"
    cuts = materialize(raw.join(wanted, "id").select("id", "copies", "text", "cuts").mapInArrow(cut, schema))
    discard(wanted)
    release(texts.sparkSession)
    whole = cuts.groupBy("segment").agg(
        F.first("key").alias("key"), F.sum("copies").alias("weight"), F.first("n_words").alias("n_words"), F.first("words", ignorenulls=True).alias("words")
    )
    what, where = materialize(whole.withColumn("number", F.monotonically_increasing_id())), materialize(cuts.select("segment", "id", "start"))
    discard(cuts)
    release(texts.sparkSession)
    return where, what


def searched(segments: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(segment, found array of window starts [first, end)) of the segments (segment, key, weight, n_words, words) that have any."""
    spark = segments.sparkSession
    total = segments.agg(F.sum("n_words")).first()[0] or 0
    shards = max(-(-total // shard_words), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def one(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), window)
        kept = [(r[0], [{"first": a, "end": b} for a, b in f]) for r, f in zip(rows, found, strict=True) if f]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.binary()), pa.array([f for _, f in kept], found_type)], ["segment", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "weight", "words")), strict=True):
                if s != shard and rows:
                    yield one(rows)
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield one(rows)

    dealt = segments.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "segment", "weight", "words")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "segment binary, found array<struct<first: int, end: int>>")


def repeated_spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """(id, spans array of words [first, end)) of the distinct texts (id long, copies long, text) that have repeated words.

    Spans may overlap and touch; copies tells how many rows have the text.
    """
    where, what = segments_of(texts, anchored_runs, window, min(anchor, window))
    heavy = materialize(what.groupBy("key").agg(F.sum("n_words").alias("n")).where(F.col("n") > heavy_words).select("key"))
    columns = ("segment", "key", "weight", "n_words", "words")
    found = searched(what.join(heavy, "key", "left_anti").select(*columns), window, shard_words)
    if not heavy.isEmpty():
        split = what.join(heavy, "key").select(F.col("number").alias("id"), F.col("weight").alias("copies"), F.col("words").alias("text"))
        inner, parts = segments_of(materialize(split), single_windows, window, anchor)
        hits = inner.join(searched(parts.select(*columns), window, shard_words), "segment")
        windows = hits.groupBy("id").agg(F.collect_list(F.struct(F.col("start").alias("first"), (F.col("start") + 1).alias("end"))).alias("found"))  # at most RUN
        found = found.unionByName(what.select("segment", F.col("number").alias("id")).join(windows, "id").select("segment", "found"))
    in_text = F.transform("found", lambda f: F.struct((F.col("start") + f["first"]).alias("first"), (F.col("start") + f["end"] + window - 1).alias("end")))
    lines = where.join(found, "segment").select("id", in_text.alias("spans"))
    return lines.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a text's words


def remove_repeats(docs: DataFrame, kept: Column | None = None, window: int = WINDOW, **how) -> DataFrame:
    """The rows of (doc_id, text) without words that a repeated window covers: doc_id, n_words, n_removed, and ``kept``,
    an expression over ``kept``, the remaining words joined by one space (by default these themselves, as text).

    Words are what stands between ASCII blanks. A window is repeated if its words also start anywhere else, in this text,
    another, or another row with the same text; windows are judged on the input. Null and empty texts have no words;
    doc_id, null or not, is carried along, and repeated rows are repeated windows; texts shorter than a window keep all.
    An empty table gives an empty table. Other columns, of any name, are ignored.
    """
    value = F.col("kept").alias("text") if kept is None else kept
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    distinct = bounded(rows).select(digest.alias("digest"), "text").groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = materialize(distinct.withColumn("id", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    spans = materialize(repeated_spans(texts.select("id", "copies", "text"), window, **how))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            counts, removed, left = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                keep = np.ones(len(words), bool)
                for s in found or ():
                    keep[s["first"] : s["end"]] = False
                counts.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                left.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], ["digest", "n_words", "n_removed", "kept"]
            )

    joined = texts.join(spans, "id", "left").select("digest", F.col("text").cast("binary").alias("text"), "spans")
    done = joined.mapInArrow(clean, "digest binary, n_words long, n_removed long, kept string").select("digest", "n_words", "n_removed", value)
    return rows.select("doc_id", digest.alias("digest")).join(done, "digest").drop("digest")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS MATERIALIZED (
  SELECT id, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM texts
), windows AS MATERIALIZED (
  SELECT id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS w FROM starts JOIN texts USING (id)
), again AS MATERIALIZED (
  SELECT id, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)
), covered AS (
  SELECT id, list_distinct(flatten(list(range(i, i + {WINDOW})))) AS gone FROM again GROUP BY id
), spread AS (
  SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
), lost AS (SELECT id, unnest(gone) AS i FROM covered
), kept AS (
  SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM spread ANTI JOIN lost USING (id, i) GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (id)
"""

QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLES = {"op11_substring_dedup": SQL}
