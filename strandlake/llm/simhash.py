"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into three segments. If two fingerprints differ in at most RADIUS = 4 bits, then a segment with
allowance 1 differs in at most one bit, or the last one, with allowance 0, in none (more would make 2 + 2 + 1 bits).
So each fingerprint is filed under its segments, and looked up under all segments in the small Hamming balls around
its own; what meets under a key is verified in full.

Equal fingerprints are one node from the start. Under a key, a task keeps a disjoint-set forest and emits only the
links that join two of its trees: as many as nodes at most, not as many as pairs. A key with more than BUCKET rows
isn't compared row by row: its fingerprints go to ``dense_links``, where two fingerprints within 2 * BALL bits meet
under a common point of the balls around them, so that the work stays linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, columns_of, connected_components, materialize, settle, table, whole_rows

WORDS, RADIUS, SEED = 4, 4, 42
#: (lowest bit, bits, allowance) of each segment: allowances sum to RADIUS - 2, one less than segments need to miss a pair.
SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))
#: The same for over MANY fingerprints, which would meet under the keys above by over 1400 a key: 564 rows a fingerprint for 48.
WIDE_SEGMENTS, MANY = ((32, 32, 2), (0, 32, 1)), 1 << 27
BUCKET, BALL = 4096, RADIUS // 2
#: For similarity: a sketch has SKETCH fingerprints; its first bits are PARTS segments of PART_BITS, looked up with up to FLIPS
#: of their WEAK least certain bits changed.
SKETCH, PARTS, PART_BITS, WEAK, FLIPS = 16, 12, 21, 6, 2
#: Two texts are similar from a Jaccard similarity of 4 / 5, by exact sets of shingles.
SIMILAR = (4, 5)
#: At 0.8, 15.15 % of a sketch's bits differ (the angle between the sets), 155 of 1024, standard deviation 11.5: the guard is 4
#: deviations above. Of sets of 4 and 5 shingles it is 18.75 %, for which sets of FEW or less have their own. In the 128 bits of
#: the sieve 19.4 differ, so 34 keep all but one in three thousand, of the smallest sets all but one in ninety.
SIEVE, GUARD, FEW, GUARD_FEW = 34, 201, 8, 242
#: Within so many of the sieve's first 64 bits, a text is compared at once with the first text that has a segment in common with
#: it, or its sketch with that one's and with the text's before.
STAR, CLOSE = 14, 19
#: Rows of a few numbers each that may be broadcast, at most about 16 MB.
FEW_ROWS = 1 << 18
#: A task compares two blocks of texts: of so many texts, or so many shingles on average.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int = WORDS) -> bytes:
    """The XXH64 of each shingle, as 8 big-endian bytes each."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return b""
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return digest(b" ".join(found), SEED)
    return b"".join([digest(b" ".join(s), SEED) for s in zip(*(found[k:] for k in range(words)), strict=False)])


def bit_counts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit: bits are counted in byte lanes, 255 hashes at a time."""
    out, ends = np.zeros((len(counts), 64), np.int64), np.cumsum(counts)
    blocks = [np.arange(end - n, end, 255) for n, end in zip(counts, ends, strict=True) if n]
    if not blocks:
        return out
    starts, first = np.concatenate(blocks), np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])
    filled = np.flatnonzero(counts)
    for bit in range(8):
        lanes = np.add.reduceat((values >> np.uint64(bit)) & LANES, starts)
        out[filled, bit::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def packed(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majorities as numbers, bit 0 lowest."""
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64)[:, 0]


def hashes_of(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles' hashes, and how many each text has."""
    each = [shingle_hashes(t, words) for t in texts]
    return np.frombuffer(b"".join(each), ">u8").astype(np.uint64), np.array([len(b) // 8 for b in each], np.int64)


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """Majority of the hashes in each bit."""
    values, counts = hashes_of(texts, words)
    return packed(bit_counts(values, counts), counts) if len(texts) else np.zeros(0, np.uint64)


def fingerprint_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row of (doc_id, text); a text without words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            fp = fingerprints([t or "" for t in batch.column("text").to_pylist()], words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Disjoint sets over positions of an array, with vectorised reading of roots."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Unite each a with b, or their labels; the pairs that joined two trees."""
        kept, root = [], self.root

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        ids = [v.tolist() for v in ((a, b) if label is None else (label[a], label[b]))]
        for x, y, i, j in zip(a.tolist(), b.tolist(), *ids, strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                kept.append((x, y))
        self.flatten()
        return kept


def forest_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int, label: np.ndarray | None = None, forest: Forest | None = None) -> list[tuple[int, int]]:
    """Positions of links that span what is within ``radius`` under equal keys (sorted), at least one side at home.

    Positions with one label, by default each its own, are one tree from the start; ``forest`` goes on with given trees.
    """
    n = len(key)
    label = np.arange(n) if label is None else label
    forest = forest or Forest(int(label.max()) + 1)
    links, active, shift = [], np.arange(n - 1), 1
    while len(active):
        active = active[active + shift < n]
        active = active[key[active] == key[active + shift]]
        other = active + shift
        near = (home[active] | home[other]) & (forest.root[label[active]] != forest.root[label[other]])
        a, b = active[near], other[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if close.any():
            links += forest.join(a[close], b[close], label)
        shift += 1
    return links


def by_bucket(batches: Iterator[pa.RecordBatch], bucket: int, compared, overfull) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, the first column: ``compared`` of the rows (columns) of whole keys, several at once, and
    ``overfull`` of rows of a key with more rows than ``bucket``."""

    def split(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, n = np.unique(rows[0], return_counts=True)
        if (n > bucket).any():
            over = np.repeat(n > bucket, n)
            yield overfull([c[over] for c in rows])
            rows = [c[~over] for c in rows]
        if len(rows[0]):
            yield compared(rows)

    held, hot = None, None
    for batch in filter(lambda b: b.num_rows, batches):
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if hot is not None:  # the rest of a key that has overflowed
            same = int(np.searchsorted(rows[0], hot, "right"))
            if same:
                yield overfull([c[:same] for c in rows])
            rows = [c[same:] for c in rows]
            if not len(rows[0]):
                continue
            hot = None
        held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
        if len(held[0]) - last > bucket:
            hot = held[0][-1]
            yield overfull([c[last:] for c in held])
        if last:
            yield from split([c[:last] for c in held])
        held = None if hot is not None else [c[last:] for c in held]
    if held is not None and len(held[0]):
        yield from split(held)


def bucket_links(batches: Iterator[pa.RecordBatch], bucket: int, pairs) -> Iterator[pa.RecordBatch]:
    """By ``pairs`` (columns -> positions), over rows (key, fp, node, home) sorted by key: links (a, b), and (a, null) for
    each row of a key with more rows than ``bucket``."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        found = pairs(rows[0], rows[1].view(np.uint64), rows[3].astype(bool))
        return pa.RecordBatch.from_arrays([pa.array(rows[2][np.array([x[k] for x in found], np.int64)]) for k in (0, 1)], ["a", "b"])

    yield from by_bucket(batches, bucket, links, lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.nulls(len(rows[2]), pa.int64())], ["a", "b"]))


def probes(nodes: DataFrame, segments: tuple = SEGMENTS) -> DataFrame:
    """(key, fp, node, home): a row for each segment of a fingerprint and each point of the ball around it."""
    points = [
        F.struct(F.lit(low).alias("low"), F.lit((1 << bits) - 1).cast("long").alias("ones"), F.lit(sum(1 << b for b in flips)).cast("long").alias("mask"), F.lit(number << 56).cast("long").alias("tag"))
        for number, (low, bits, allowance) in enumerate(segments) for k in range(allowance + 1) for flips in combinations(range(bits), k)
    ]
    part = F.expr("shiftrightunsigned(fp, p.low)").bitwiseAND(F.col("p.ones"))
    filed = nodes.select("fp", "node", F.explode(F.array(*points)).alias("p"))
    return filed.select(part.bitwiseXOR(F.col("p.mask")).bitwiseOR(F.col("p.tag")).alias("key"), "fp", "node", (F.col("p.mask") == 0).alias("home"))


def dense_links(nodes: DataFrame, ball: int = BALL) -> DataFrame:
    """(a, b): links that connect all fingerprints within 2 * ``ball`` bits, by keys that balls have in common.

    Each fingerprint is filed under every point of its ball; all under one point are within 2 * ``ball`` of each other
    and are linked to the first. A key holds no more fingerprints than a ball has points.
    """
    flips = [sum(1 << b for b in c) for k in range(ball + 1) for c in combinations(range(64), k)]

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(flips, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = part.column("fp").to_numpy().view(np.uint64)
                keys = (fp[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(), len(masks)))], ["key", "node"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, 0
        for batch in filter(lambda b: b.num_rows, batches):
            keys, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            run = np.cumsum(new) - 1
            heads = node[new]
            head = np.where(run >= 0, heads[run] if len(heads) else first, first)
            key, first = keys[-1], head[-1]
            if (other := node != head).any():
                pairs = np.unique(np.stack([node, head])[:, other], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    filed = nodes.select("fp", "node").mapInArrow(points, "key long, node long")
    return filed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(firsts, "a long, b long").distinct()


def hamming_components(prints: DataFrame, segments: tuple | None = None, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component): components of fingerprints linked at ``radius`` or fewer bits, named by their smallest id.

    ``prints`` is (doc_id, fp) with ids that aren't null. Without ``segments``, their number of fingerprints decides between
    three short ones and two long ones; both miss no pair.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    segments = segments or (WIDE_SEGMENTS if nodes.count() > MANY else SEGMENTS)
    if sum(s[2] + 1 for s in segments) <= radius or 2 * (radius // 2) < radius:
        raise ValueError("the segments' allowances would miss pairs within the radius, or the radius is odd")
    filed = probes(nodes, segments).repartition("key").sortWithinPartitions("key", "fp")
    links = materialize(filed.mapInArrow(lambda batches: bucket_links(batches, bucket, lambda key, fp, home: forest_links(key, fp, home, radius)), "a long, b long"))
    hot = links.where("b IS NULL").select(F.col("a").alias("node")).distinct()
    edges = links.where("b IS NOT NULL")
    if not hot.isEmpty():
        edges = edges.unionByName(dense_links(nodes.join(hot, "node"), radius // 2))
    parts = connected_components(edges)
    return nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row; nulls in doc_id keep a null component.

    Null and empty texts have fingerprint zero and are linked like any other.
    """
    prints = materialize(fingerprint_table(docs, words))
    parts = hamming_components(prints.where("doc_id IS NOT NULL"), **how)
    return prints.join(parts, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )


# ------------------------------------------------------------------- similarity rather than a few bits


def remixed(values: np.ndarray, number: int) -> np.ndarray:
    """Another hash of the same shingles; the first is the hash itself."""
    if not number:
        return values
    h = values + np.uint64(0x9E3779B97F4A7C15 * number % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_hashes(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's set of shingles."""
    return [np.unique(np.frombuffer(shingle_hashes(t, words), ">u8").astype(np.uint64)) for t in texts]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """SKETCH fingerprints of 64 bits for each set of hashes, and the WEAK least certain bits of each segment."""
    counts = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    prints = np.zeros((len(sets), SKETCH), np.uint64)
    doubt = []
    for k in range(SKETCH):
        ones = bit_counts(remixed(values, k), counts)
        prints[:, k] = packed(ones, counts)
        if 64 * k < PARTS * PART_BITS:
            doubt.append(np.abs(2 * ones - counts[:, None]))
    margin = np.concatenate(doubt, axis=1)[:, : PARTS * PART_BITS].reshape(len(sets), PARTS, PART_BITS)
    return prints, np.argsort(margin, axis=2, kind="stable")[:, :, :WEAK].astype(np.uint8)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text; with doc_id it names a row, and rows with one name are repeated rows. Null counts as an empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def sketch_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest binary, same binary, n int, fp long, sketch binary, weak binary): the digests of the text and of the set
    of n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = distinct_hashes([t or "" for t in batch.column("text").to_pylist()], words)
            prints, weak = sketches(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(prints[:, 0].view(np.int64)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (prints.astype("<u8"), weak)),
                ],
                ["doc_id", "digest", "same", "n", "fp", "sketch", "weak"],
            )

    rows = bounded(docs).select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, same binary, n int, fp long, sketch binary, weak binary")


def part_keys(prints: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """For each text and segment, the segment itself and its ball over the weak bits, as keys that tell segments apart."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, : PARTS * PART_BITS]
    own = bits.reshape(len(prints), PARTS, PART_BITS).astype(np.int64) @ (1 << np.arange(PART_BITS, dtype=np.int64))
    flips = np.int64(1) << weak.astype(np.int64)
    masks = [np.zeros_like(own)]
    for chosen in (c for k in range(1, FLIPS + 1) for c in combinations(range(WEAK), k)):
        masks.append(flips[:, :, list(chosen)].sum(axis=2))
    return (own[:, :, None] ^ np.stack(masks, axis=2)) | (np.arange(PARTS, dtype=np.int64) << 40)[None, :, None]


def meeting(key: np.ndarray, fp: np.ndarray, home: np.ndarray, component: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are, under equal keys (sorted), within SIEVE bits of a row of another component, one of the two at home; and
    which of one of another group. ``fp`` has a column for each 64 bits; a component is in one group."""
    n = len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    alone = (np.minimum.reduceat(group, first) == np.maximum.reduceat(group, first))[number]
    met, apart, active, shift = np.zeros(n, bool), np.zeros(n, bool), np.arange(n - 1), 1
    while len(active):
        active = active[active + shift < n]
        active = active[key[active] == key[active + shift]]
        other = active + shift
        told = group[active] != group[other]
        open_ = np.where(told, ~(apart[active] & apart[other]), (component[active] != component[other]) & ~(met[active] & met[other]))
        near = (home[active] | home[other]) & open_
        a, b, told = active[near], other[near], told[near]
        close = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1) <= SIEVE
        met[a[close]] = met[b[close]] = True
        apart[a[close & told]] = apart[b[close & told]] = True
        if shift % 64 == 0:
            active = active[~np.logical_and.reduceat(apart | (met & alone), first)[number[active]]]
        shift += 1
    return met, apart


def meetings(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """(meet, node, hot) over rows (key, fp, more, node, home, component, group) sorted by key: who meets another group, under
    a number for each set of nodes, so that keys with the same nodes are one; without a number, who meets but its own group;
    and all rows of a key with more than ``bucket``, by that key, as hot."""

    def rows_of(meet: np.ndarray, node: np.ndarray, hot: bool, own: np.ndarray) -> pa.RecordBatch:
        meets = pa.concat_arrays([pa.array(meet, pa.int64()), pa.nulls(len(own), pa.int64())])
        return pa.RecordBatch.from_arrays([meets, pa.array(np.concatenate([node, own])), pa.array(np.full(len(meets), hot))], ["meet", "node", "hot"])

    def compared(rows: list[np.ndarray]) -> pa.RecordBatch:
        met, apart = meeting(rows[0], np.stack(rows[1:3], axis=1).view(np.uint64), rows[4].astype(bool), rows[5], rows[6])
        key, node, own = rows[0][apart], rows[3][apart], np.unique(rows[3][met & ~apart])
        if not len(key):
            return rows_of(key, node, False, own)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(remixed(node.view(np.uint64), 1), first)
        return rows_of(np.repeat(sums, np.diff(np.append(first, len(key)))).view(np.int64), node, False, own)

    yield from by_bucket(batches, bucket, compared, lambda rows: rows_of(rows[0], rows[3], True, rows[3][:0]))


def within_guard(sketch: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of positions may be similar by their sizes and the distance of whole sketches."""
    least, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    fits = least * SIMILAR[1] >= most * SIMILAR[0]
    fits[fits] = np.bitwise_count(sketch[a[fits]] ^ sketch[b[fits]]).sum(axis=1) <= np.where(least[fits] <= FEW, GUARD_FEW, GUARD)
    return fits


def guard_links(key: np.ndarray, sketch: np.ndarray, n: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Positions of links that span what may be similar under equal keys (sorted), by the distance of whole sketches."""
    label = np.unique(group, return_inverse=True)[1]
    forest = Forest(int(label.max()) + 1)
    links, active, shift = [], np.arange(len(key) - 1), 1
    while len(active):
        active = active[active + shift < len(key)]
        active = active[key[active] == key[active + shift]]
        other = active + shift
        apart = forest.root[label[active]] != forest.root[label[other]]
        a, b = active[apart], other[apart]
        close = within_guard(sketch, n, a, b)
        if close.any():
            links += forest.join(a[close], b[close], label)
        shift += 1
    return links


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, center, star) over rows (key, fp, node) sorted: rows within CLOSE bits of the first row of their key, as a star if
    within STAR, and of the row before."""
    key, fp, first, last_fp, last = None, np.uint64(0), 0, np.uint64(0), 0
    for batch in filter(lambda b: b.num_rows, batches):
        keys, node, own = batch.column("key").to_numpy(), batch.column("node").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        run, heads = np.cumsum(new), np.flatnonzero(new)
        center, before = np.concatenate([[first], node[heads]])[run], np.concatenate([[last], node[:-1]])
        far = np.bitwise_count(own ^ np.concatenate([[fp], own[heads]])[run])
        near = (node != center) & (far <= CLOSE)
        beside = ~new & (before != center) & (np.bitwise_count(own ^ np.concatenate([[last_fp], own[:-1]])) <= CLOSE)
        key, fp, first, last_fp, last = keys[-1], (own[heads[-1]] if len(heads) else fp), center[-1], own[-1], node[-1]
        star = np.concatenate([far[near] <= STAR, np.zeros(beside.sum(), bool)])
        if len(star):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([node[near], node[beside]]), np.concatenate([center[near], before[beside]]), star)], ["node", "center", "star"])


def star_links(texts: Iterator[tuple[int, bool, str]], words: int) -> Iterator[tuple[int, int]]:
    """(center, node) of the texts of a group that are similar to the center's, which comes first."""
    center, held = None, None
    for node, is_center, text in texts:
        own = distinct_hashes([text], words)[0]
        if is_center:
            center, held = node, own
        elif len(own) and len(held):
            shared = len(np.intersect1d(own, held, assume_unique=True))
            if shared * SIMILAR[1] >= (len(own) + len(held) - shared) * SIMILAR[0]:
                yield center, node


def similar_links(texts: list[str], node: np.ndarray, side: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Links that span the texts whose sets of shingles have a Jaccard similarity of SIMILAR or more, by the sets
    themselves: of two texts of sides 0 and 1, or of any two of side 2. Texts of one ``node`` are linked from the start."""
    sets = distinct_hashes(texts, words)
    some = [k for k, s in enumerate(sets) if len(s)]
    sizes, side = np.array([len(sets[k]) for k in some], np.int64), side[some]
    if len(some) < 2:
        return []
    names, label = np.unique(node[some], return_inverse=True)
    values, code = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, held, forest, links = ends - sizes, np.zeros(len(values), bool), Forest(len(names)), []
    for i in range(len(some) - 1):
        j = np.arange(i + 1, len(some))
        least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        open_ = (forest.root[label[j]] != forest.root[label[i]]) & (least * SIMILAR[1] >= most * SIMILAR[0]) & ((side[j] == 2) | (side[j] != side[i]))
        if not open_.any():
            continue
        own = code[starts[i] : ends[i]]
        held[own] = True
        shared = np.add.reduceat(held[code[ends[i] :]].astype(np.int64), starts[i + 1 :] - ends[i])
        held[own] = False
        j = j[open_ & (shared * SIMILAR[1] >= (sizes[i] + sizes[j] - shared) * SIMILAR[0])]
        links += forest.join(np.full(len(j), i), j, label)
    return [(int(names[label[a]]), int(names[label[b]])) for a, b in links]


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows in which no key is cut, with the places where a key begins."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in filter(lambda b: b.num_rows, batches):
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            table = pa.Table.from_batches(held)
            first = begins(table)
            if first[-1]:
                yield table.slice(0, first[-1]), first[:-1]
                held = table.slice(first[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, begins(table)


def block_pairs(rows: DataFrame, group: str, k: str, *others: str) -> DataFrame:
    """Each row of a group of k blocks once for each pair of blocks (i <= j) that its own is in, with its side: 0, 1, or 2 if i = j."""
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("node"), F.col(k)).cast("int"))
    pairs = F.expr(f"transform(sequence(0, cast({k} as int) - 1), x -> named_struct('i', least(x, _b), 'j', greatest(x, _b), 'side', if(x = _b, 2, if(x > _b, 0, 1))))")
    return dealt.withColumn("_p", F.explode(pairs)).select(group, "node", *others, "_p.i", "_p.j", "_p.side")


def filed_parts(rows: DataFrame, balls: bool) -> DataFrame:
    """(key, fp, more, node, home, component, group): a row for each segment of a sketch and, with ``balls``, each point of the
    ball; fp and more are the sieve."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH)
                weak = np.frombuffer(b"".join(part.column("weak").to_pylist()), np.uint8).reshape(-1, PARTS, WEAK)
                keys = part_keys(sketch, weak)
                keys = keys if balls else keys[:, :, :1]
                each = keys.shape[1] * keys.shape[2]
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                sieve = [sketch[:, k].astype(np.uint64).view(np.int64) for k in (-1, -2)]
                fp, more, node, component, group = (np.repeat(x, each) for x in (*sieve, *(part.column(c).to_numpy() for c in ("node", "component", "group"))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel(), fp, more, node, home.ravel(), component, group)], ["key", "fp", "more", "node", "home", "component", "group"])

    return rows.select("node", "component", "group", "sketch", "weak").mapInArrow(filed, "key long, fp long, more long, node long, home boolean, component long, group long")


def with_texts(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the text of their node. Up to FEW_ROWS of them are counted and go to the texts; else both are shuffled."""
    named = rows.join(nodes.select("node", "doc_id", "digest"), "node")
    return texts.join(F.broadcast(named) if rows.count() <= FEW_ROWS else named, ["doc_id", "digest"])


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(node, center, star) of ``stars`` over the segments of all sketches: at most two a segment of a text."""
    homes = filed_parts(nodes.select("*", F.col("node").alias("component"), F.col("node").alias("group")), balls=False).select("key", "fp", "node")
    return homes.repartition("key").sortWithinPartitions("key", "node").mapInArrow(stars, "node long, center long, star boolean").distinct()


def guarded_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of those ``close_pairs`` that may be similar by their complete sketches."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join([*batch.column("sketch").to_pylist(), *batch.column("held").to_pylist()]), "<u8").reshape(-1, SKETCH)
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")]).astype(np.int64)
            a = np.arange(batch.num_rows)
            near = within_guard(sketch, n, a, a + batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[near]) for c in ("node", "center")], ["a", "b"])

    own = nodes.select("node", "n", "sketch")
    both = pairs.select("node", "center").distinct().join(own, "node").join(own.toDF("center", "m", "held"), "center")
    return both.select("node", "center", "n", "m", "sketch", "held").mapInArrow(within, "a long, b long")


def star_components(met: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, block: int) -> DataFrame:
    """(node, component) of texts that are similar, by their sets, to the first text with a segment in common, of (node, center).

    Each text is compared with one other, so that the work is linear however large a group is: this unites most of a large
    group before any search. A center with more than ``block`` texts has a copy for each part of them.
    """
    edges = materialize(met.groupBy("node").agg(F.min("center").alias("center")))
    parts = edges.groupBy("center").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    dealt = edges.join(parts, "center").select("center", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("part"), "node", F.lit(False).alias("first"))
    centers = parts.select("center", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("center").alias("node"), F.lit(True).alias("first"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("node")[i].as_py(), b.column("first")[i].as_py(), b.column("text")[i].as_py() or "") for b in batches for i in range(b.num_rows))
        links = star_links(rows, words)
        while found := list(islice(links, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    grouped = with_texts(dealt.unionByName(centers), nodes, texts).repartition("center", "part").sortWithinPartitions("center", "part", F.desc("first"))
    return connected_components(grouped.select("node", "first", "text").mapInArrow(verified, "a long, b long"))


def distinct_sets(prints: DataFrame) -> DataFrame:
    """One node for each distinct set of a sketch table: same, node, doc_id, digest, n, sketch, weak.

    Nodes are numbers in the order of the (doc_id, digest) that represents the set, its first, so the smallest node of a
    component has the smallest doc_id, and two texts under one doc_id are two nodes.
    """
    one = F.min(F.struct("doc_id", "digest", "n", "fp", "sketch", "weak")).alias("o")
    sets = prints.groupBy("same").agg(one).select("same", "o.doc_id", "o.digest", "o.n", "o.sketch", "o.weak")
    return sets.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("node", F.monotonically_increasing_id())


def near_groups(nodes: DataFrame, near: DataFrame, stars_: DataFrame) -> DataFrame:
    """(node, n, component, group, sketch, weak): each node's component of ``stars_``, and its group, which the pairs ``near``
    join to others. Every text has a few such pairs, so that most of a large group is one in linear work."""
    groups = settle(lambda: connected_components(near.unionByName(stars_.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    labels = groups.withColumnRenamed("component", "group").join(stars_, "node", "left")
    return nodes.join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("group", "node").alias("group"), "sketch", "weak")


def met_rows(united: DataFrame, bucket: int) -> DataFrame:
    """(meet, node, hot) of ``meetings`` over the segments and balls of all sketches."""
    dealt = filed_parts(united, balls=True).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lambda batches: meetings(batches, bucket), "meet long, node long, hot boolean").distinct()


def similar_components(nodes: DataFrame, texts: DataFrame, words: int = 5, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(node, component) of ``distinct_sets``: components of those whose sets of shingles have a Jaccard similarity of SIMILAR
    or more, by their smallest node. ``texts`` has (doc_id, digest, text), one row for each name of a row.

    First ``star_components`` unites most of what is similar. Nodes of different components then
    meet under a segment of the sketch, where one side is looked up in the small Hamming ball over the bits it is least
    sure of, and another 128 bits sieve them. Those within the guard by their complete sketches are candidates; only the
    groups that they form are kept, never all pairs, so nodes of a group that ``near_groups`` has formed before need not meet
    again to form it. In each of these the candidates that aren't linked yet are
    compared by the sets themselves, and only these links count. Keys and groups that are too large for a task are
    compared in pairs of blocks.
    """
    pairs = materialize(close_pairs(nodes))
    stars_ = settle(lambda: star_components(pairs.where("star"), nodes, texts, words, block))
    near = materialize(guarded_pairs(pairs, nodes))
    united = near_groups(nodes, near, stars_)
    met = materialize(met_rows(united, bucket))
    hot = met.where("hot")
    some = [met.where("NOT hot").select("meet", "node"), *(near.select(F.lit(None).cast("long").alias("meet"), F.col(c).alias("node")) for c in ("a", "b"))]
    if not hot.isEmpty():
        sizes = hot.join(united.select("node", "group"), "node").groupBy("meet").agg(F.ceil(F.count("*") / bucket).alias("k"), F.min("group").alias("low"), F.max("group").alias("high"))
        blocks = block_pairs(hot.join(sizes.where("low < high"), "meet"), "meet", "k").select(F.xxhash64("meet", "i", "j").alias("meet"), "node")
        some += [blocks, hot.select(F.lit(None).cast("long").alias("meet"), "node")]
    groups = reduce(DataFrame.unionByName, some)

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in whole_keys(batches, ["meet"]):
            sketch = np.frombuffer(b"".join(found.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH)
            meet, n, group = (found.column(c).to_numpy() for c in ("meet", "n", "group"))
            links = guard_links(meet, sketch, n.astype(np.int64), group)
            # of a batch's links between groups, those that join trees of it
            label = np.unique(group, return_inverse=True)[1]
            pairs = np.array(links, np.int64).reshape(-1, 2)
            kept = np.array(Forest(int(label.max()) + 1).join(pairs[:, 0], pairs[:, 1], label), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(group[kept[:, k]]) for k in (0, 1)], ["a", "b"])

    # a node's meetings, at most as many as its keys and their pairs of blocks, are one row while its sketch is joined
    listed = materialize(groups.groupBy("node").agg(F.collect_list("meet").alias("meets")).join(united.select("node", "n", "component", "group", "sketch"), "node"))
    sorted_groups = listed.select(F.explode("meets").alias("meet"), "n", "group", "sketch").repartition("meet").sortWithinPartitions("meet")
    maybe = connected_components(sorted_groups.mapInArrow(guarded, "a long, b long"))
    # of the groups that may be linked, the nodes that met any other component's; those that met none have no similar text there
    named = listed.select("node", "n", "component", F.col("group").alias("a")).join(maybe.select(F.col("node").alias("a"), F.col("component").alias("b")), "a", "left")
    members = materialize(named.select(F.coalesce("b", "a").alias("group"), "node", "n", "component"))
    sizes = members.groupBy("group").agg(
        F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES, F.lit(1))).alias("k"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high").select("group", "k")
    placed = block_pairs(members.join(sizes, "group"), "group", "k", "component")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, first in whole_keys(batches, ["group", "i", "j"], 256):
            component, side, links = found.column("component").to_numpy(), found.column("side").to_numpy(), []
            for at, end in zip(first, np.append(first[1:], found.num_rows), strict=True):
                links += similar_links([t or "" for t in found.column("text").slice(at, end - at).to_pylist()], component[at:end], side[at:end], words)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([e[k] for e in links], np.int64)) for k in (0, 1)], ["a", "b"])

    compared = with_texts(placed, nodes, texts).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    links = compared.select("group", "i", "j", "side", "component", "text").mapInArrow(verified, "a long, b long")
    parts = connected_components(links.unionByName(stars_.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def deduplicate(docs: DataFrame, words: int = 5, **how) -> DataFrame:
    """The documents, all columns as they are, that are the first of their group of near copies; one of repeated rows.

    Near copies are texts whose sets of shingles have a Jaccard similarity of 0.8 or more; of a group the row with the smallest
    doc_id stays. Texts under one doc_id that aren't near copies both stay; rows with one doc_id and one text are repeated
    rows, whatever their other columns, and one stays. Rows without a doc_id stay: there is no telling which of them to keep.
    Null and empty texts are copies of each other. Other columns may have any names; an empty table gives an empty table.
    Sketches are gathered to find candidates; the text of a candidate moves to meet the others of its group, and a text moves
    once to meet the names that stay.
    """
    prints = materialize(sketch_table(docs, words).where("doc_id IS NOT NULL"))
    nodes = materialize(distinct_sets(prints))
    again = materialize(prints.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"))
    repeats = not again.isEmpty()
    texts = bounded(docs).select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"), "text")
    once = texts.dropDuplicates(["doc_id", "digest"]) if repeats else texts
    parts = settle(lambda: similar_components(nodes.drop("same"), once, words, **how))
    # a set's other texts are copies of the one that represents it
    kept = parts.where("node = component").join(nodes, "node").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    # the document is one column, so that no name of its own can clash
    rows = whole_rows(docs)
    key, digest = F.col("row.doc_id").cast("long"), text_digest(F.col("row.text"))
    named = rows.join(kept, (key == F.col("_id")) & (digest == F.col("_digest")), "left_semi")
    if repeats:
        same = again.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        twice = named.withColumn("id", key).withColumn("digest", digest)
        both = (twice["id"] == same["_id"]) & (twice["digest"] == same["_digest"])
        named = twice.join(same, both, "left_anti").unionByName(twice.join(same, both, "left_semi").dropDuplicates(["id", "digest"])).select("row")
    return columns_of(named.unionByName(rows.where(F.col("row.doc_id").isNull())), docs)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLES: dict[str, str] = {}
