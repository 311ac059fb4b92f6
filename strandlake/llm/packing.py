"""Best-fit packing by the linear grouping scheme.

Pieces as long as the window are sequences of their own. The other lengths above a share of the window are sorted and
cut into groups of equal cardinality; each is rounded up to the largest length of its group. For those few sizes the fractional configuration programme (one variable per way to fill
a sequence) is solved by column generation, its counts are rounded down, and the actual documents take the places of
the rounded ones, longest first. What rounding left over and the short pieces enter by best fit. A few numbers of
groups and limits of length are planned, and the plan with the fewest sequences is used.

Everything above depends only on how many pieces have each length, so the driver gets a histogram of at most
``window`` entries, however many documents there are, and gives back runs: pieces ``first`` to ``end`` of a length go
``each`` to a sequence from sequence ``base`` on, at ``offset``.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, materialize, number_rows, table, worker_cache

WINDOW, END_ID = 1024, 2
#: (groups, small): the scheme is planned with each; pieces of at most a ``small``-th of the window are short.
SETTINGS = ((24, 2), (48, 3), (64, 4), (64, 8))
#: The same vocabulary as ``byte_bpe_50k.json``, as ranks: tests hold that ids are equal.
VOCABULARY, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

# ---------------------------------------------------------------------------------------------- tokens


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Read once in each Python worker; ``path`` is a file of ranks that every executor has."""
    held = worker_cache().__dict__.setdefault("encoders", {})
    if path not in held:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        held[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return held[path]


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole windows, the first piece takes the remainder."""
    first = n % window or window
    return [(0, min(n, first)), *((at, window) for at in range(first, n, window))]


def token_pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids and then ``END_ID``, cut if longer than a window.

    A null text is empty: one piece of one id. The text of a special token is that token. Each row of a repeated
    doc_id gives pieces of its own.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = encoder(path, pattern)._core_bpe
        end = np.array([END_ID], "<u4").tobytes()
        for batch in chunks(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = bytes(core.encode_to_tiktoken_buffer(text or "", set(SPECIAL))) + end
                rows += [(doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, window))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------------------------------------- plan


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of equal cardinality; a length on a border is shared by two groups."""
    total = sum(counts.values())
    out: list[list[tuple[int, int]]] = [[]]
    room = quota = -(-total // groups) if total else 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = quota
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return [g for g in out if g]


def configurations(sizes: list[int], demand: list[int], window: int) -> list[tuple[list[int], float]]:
    """(copies of each size, times used): an optimum of the fractional programme that covers ``demand``.

    ``sizes`` are strictly decreasing. Revised simplex over a basis of one configuration per size; a knapsack over the window prices new ones.
    """
    m, widths, smallest = len(sizes), np.array(sizes), min(sizes)
    order = np.arange(m)
    basis = np.diag([float(window // s) for s in sizes])
    wanted = np.array(demand, float)
    for _ in range(40 * m):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)  # all costs are 1
        best, choice = np.zeros(window + 1), np.full(window + 1, -1)
        for room in range(smallest, window + 1):
            best[room] = best[room - 1]
            fits = order[np.searchsorted(-widths, -room) :]
            worth = best[room - widths[fits]] + price[fits]
            if worth[k := int(np.argmax(worth))] > best[room] + 1e-12:
                best[room], choice[room] = worth[k], fits[k]
        if best[window] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), window
        while room > 0:
            if choice[room] < 0:
                room -= 1
                continue
            column[choice[room]] += 1
            room -= sizes[choice[room]]
        step, level = inverse @ column, inverse @ wanted
        ratios = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = column
    used = np.linalg.inv(basis) @ wanted
    return [([int(a) for a in basis[:, j]], max(0.0, float(used[j]))) for j in range(m)]


class Sequences:
    """Runs of sequences with equal free room: consecutive numbers, found by room."""

    def __init__(self, window: int) -> None:
        self.window, self.opened = window, 0
        self.rooms: list[int] = []
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def put_back(self, room: int, base: int, n: int) -> None:
        if n and room:
            if room not in self.of:
                bisect.insort(self.rooms, room)
                self.of[room] = []
            self.of[room].append((base, n))

    def open(self, n: int) -> int:
        base, self.opened = self.opened, self.opened + n
        return base

    def place(self, length: int, first: int, n: int, each: int, base: int, room: int) -> int:
        """Pieces of one length into sequences from ``base`` on; the number of sequences that got ``each``."""
        self.runs.append((length, first, first + n, each, base, self.window - room))
        return n // each

    def best_fit(self, length: int, first: int, n: int) -> None:
        """One after the other each piece takes the tightest sequence; equal ones go together."""
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.window // length
                self.put_back(self.window, self.open(-(-n // each)), -(-n // each))
                continue
            room = self.rooms[at]
            base, count = self.of[room].pop()
            if not self.of[room]:
                del self.of[room], self.rooms[at]
            each = room // length
            took = min(n, count * each)
            full = self.place(length, first, took, each, base, room)
            self.put_back(room - each * length, base, full)
            if rest := took - full * each:
                self.put_back(room - rest * length, base + full, 1)
            used = full + bool(rest)
            self.put_back(room, base + used, count - used)
            first, n = first + took, n - took


def pack_lengths(histogram: dict[int, int], window: int = WINDOW, settings: tuple = SETTINGS) -> tuple[list[tuple], int]:
    """Runs (length, first, end, each, base, offset) and the number of sequences, by the best of the settings."""
    least, best = -(-sum(s * n for s, n in histogram.items()) // window), None
    for groups, small in settings:
        plan = planned(histogram, window, groups, small)
        if best is None or plan[1] < best[1]:
            best = plan
        if best[1] == least:
            break
    return best


def planned(histogram: dict[int, int], window: int, groups: int, small: int) -> tuple[list[tuple], int]:
    space, taken = Sequences(window), dict.fromkeys(histogram, 0)
    large = {s: n for s, n in histogram.items() if window // small < s < window}
    grouped = group_lengths(large, groups)
    if grouped:
        sizes, demand = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
        rows: dict[int, int] = {}
        for s, n in zip(sizes, demand, strict=True):  # groups of one size are one row of the programme
            rows[s] = rows.get(s, 0) + n
        where = sorted(rows, reverse=True)
        supply = {s: [list(x) for g in grouped if g[0][0] == s for x in g] for s in where}
        for copies, times in configurations(where, [rows[s] for s in where], window):
            open_runs = [(space.open(int(times)), int(times), window)] if times >= 1 else []
            for s, a in zip(where, copies, strict=True):
                for _ in range(a):  # one place in each of the sequences at a time, by actual lengths, longest first
                    after = []
                    for base, n, room in open_runs:
                        while n and supply[s]:
                            length, left = supply[s][0]
                            k = min(n, left)
                            space.place(length, taken[length], k, 1, base, room)
                            taken[length] += k
                            supply[s][0][1] -= k
                            if not supply[s][0][1]:
                                supply[s].pop(0)
                            after.append((base, k, room - length))
                            base, n = base + k, n - k
                        if n:
                            after.append((base, n, room))
                    open_runs = after
            for base, n, room in open_runs:
                space.put_back(room, base, n)
    for length in sorted(histogram, reverse=True):
        space.best_fit(length, taken[length], histogram[length] - taken[length])
    return space.runs, space.opened


def pack_documents(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; no sequence has more than ``window`` ids.

    The tokens themselves never move: pieces carry their lengths and checksums. An empty table gives an empty table.
    """
    pieces = materialize(token_pieces(docs, window, path))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``window`` rows
    runs, _ = pack_lengths(histogram, window)
    plan = docs.sparkSession.createDataFrame(runs, "length long, _first long, _end long, _each long, _base long, _at long")
    ranked = number_rows(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    # the plan is bounded by the window and the number of groups, not by the documents
    return (
        ranked.join(F.broadcast(plan), "length")
        .where("_rank >= _first AND _rank < _end")
        .selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "_base + (_rank - _first) div _each AS sequence_id", "_at + (_rank - _first) % _each * length AS offset")
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
