"""Sharding: best-fit-decreasing packing of indivisible groups into shards of fixed capacity.

A group (all rows with equal text) is never split. Groups sorted by size enter the bin with the tightest remaining
capacity that still holds them; a balanced tree over the bins' remaining capacities finds it. The packing only depends
on how many groups have each size, so the driver gets a histogram of sizes, not groups. Sizes count as they are, unless
there are more than HISTOGRAM different ones: then they are rounded up to as many significant bits as keep it at that, at
least 13, which bounds the histogram whatever the number of rows (8192 + 4096 entries for each further power of two).
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, number_rows, table

SHARDS = 24
#: Entries of the driver's histogram, and the significant bits of sizes that are tried in turn.
HISTOGRAM, BITS = 100_000, (63, 24, 20, 17, 15, 13)
#: Runs of a plan that may be broadcast; a run has 28 bytes.
BROADCAST_RUNS = 500_000


class CapacityTree:
    """A treap of (remaining capacity, bin): expected logarithmic insertion, removal and search of the tightest fit."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(7)

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return [node[0], node[1], node[2], left], right
        left, right = self._split(node[2], key)
        return left, [node[0], node[1], right, node[3]]

    def _merge(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] < right[1]:
            return [left[0], left[1], left[2], self._merge(left[3], right)]
        return [right[0], right[1], self._merge(left, right[2]), right[3]]

    def add(self, remaining: int, number: int) -> None:
        left, right = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(left, [(remaining, number), self.random.random(), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            return None
        first, rest = self._first(right)
        self.root = self._merge(left, rest)
        return first

    def _first(self, node):
        if node[2] is None:
            return node[0], node[3]
        first, rest = self._first(node[2])
        return first, [node[0], node[1], rest, node[3]]


Run = tuple[int, int, int, int]


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[Run] | None:
    """Runs (size, first, end, bin): groups ``first`` to ``end`` (excluded) of a size go to a bin.

    ``sizes`` are (size, number of groups). Equal groups go together: after one has entered the tightest bin, that
    bin is the tightest for the next while it fits. With ``bins``, None if they don't suffice; else bins are opened
    as needed. A group above ``capacity`` gets a bin of its own, or None with ``bins``.
    """
    tree, runs, opened = CapacityTree(), [], 0
    for number in range(bins or 0):
        tree.add(capacity, number)
        opened += 1
    for size, groups in sorted(sizes, reverse=True):
        first = 0
        while first < groups:
            found = tree.take_tightest(size)
            if found is None:
                if bins is not None:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            remaining, number = found
            end = min(groups, first + (remaining // size if size else groups))
            runs.append((size, first, end, number))
            tree.add(remaining - size * (end - first), number)
            first = end
    return runs


def equal_shards(sizes: Iterable[tuple[int, int]], shards: int) -> list[Run]:
    """Runs of the best-fit-decreasing packing into ``shards`` bins with the least capacity that it can keep to.

    A group larger than its fair share gets a bin of its own and the other bins share the rest.
    """
    left, runs, used, taken = dict(sizes), [], 0, {}
    while left and shards - used > 1 and (largest := max(left)) * (shards - used) > sum(s * n for s, n in left.items()):
        at = taken.get(largest, 0)
        runs.append((largest, at, at + 1, used))
        taken[largest], used = at + 1, used + 1
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
    if not left:
        return runs
    rest, total = shards - used, sum(s * n for s, n in left.items())
    low, step, found = max(-(-total // rest), max(left), 1), 1, None
    high = low
    while (found := best_fit_decreasing(left.items(), high, rest)) is None:
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        middle = (low + high) // 2
        packed = best_fit_decreasing(left.items(), middle, rest)
        low, high, found = (low, middle, packed) if packed is not None else (middle + 1, high, found)
    return runs + [(s, a + taken.get(s, 0), b + taken.get(s, 0), n + used) for s, a, b, n in found]


def size_class(size: Column, bits: int = 13) -> Column:
    """The size rounded up to so many significant bits."""
    drop = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return F.call_function("shiftleft", F.call_function("shiftright", size + unit - 1, drop), drop)


def size_histogram(groups: DataFrame, size: str, most: int = HISTOGRAM) -> tuple[int, list[tuple[int, int]]]:
    """(bits, [(class, groups)]) by ``size_class`` with the most bits that give at most ``most`` classes, or the fewest."""
    counts = materialize(groups.groupBy(F.col(size).alias("size")).agg(F.count("*").alias("n")))
    for bits in BITS:
        classes = counts.groupBy(size_class(F.col("size"), bits).alias("size")).agg(F.sum("n").alias("n"))
        if bits == BITS[-1] or classes.limit(most + 1).count() <= most:
            break
    return bits, [(r[0], r[1]) for r in classes.collect()]


def shard_groups(groups: DataFrame, key: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(key, shard) for a table of groups with unique ``key`` and a ``size`` of 0 or more.

    With ``shards``, that many shards of the least equal capacity; with ``capacity``, as few shards as
    best-fit-decreasing needs. An empty table gives an empty table; null sizes count as 0.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either the number of shards or their capacity")
    sized = groups.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    bits, histogram = size_histogram(sized, "_size")
    sized = sized.select("_key", size_class(F.col("_size"), bits).alias("_class"))
    runs = equal_shards(histogram, shards) if shards else best_fit_decreasing(histogram, capacity)
    plan = groups.sparkSession.createDataFrame(runs, "_class long, _first long, _end long, shard int")
    numbered = number_rows(sized, ["_class"], ["_key"], "_rank")
    return numbered.join(F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan, "_class").where("_rank >= _first AND _rank < _end").select(F.col("_key").alias(key), "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal (doc_id, text) into shards of nearly equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard. Texts are
    equal if their SHA-256 and length are; null texts are one group, apart from empty texts, with size 8 and
    checksum 0. doc_id names a row: of repeated (doc_id, text) rows each counts and gets a slot of its own.
    """
    rows = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("_text"),
        )
    )
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_size"))
    placed = rows.join(shard_groups(groups, "_text", "_size", shards=shards), "_text")
    # equal texts go by their identities; rows that repeat in full are told apart by any order
    numbered = number_rows(placed, ["shard"], ["doc_id", "_text"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
