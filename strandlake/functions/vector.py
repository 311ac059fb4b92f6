"""Per-character work on whole Arrow batches with NumPy, where expressions over arrays of characters are too slow.

Everything works on the bytes of a batch at once, in chunks of bounded size; rows come back as rows or as partial sums.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that one NumPy step handles at once.
CHUNK = 4 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each ends; nulls are empty."""
    filled = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(filled.cast(pa.binary()).to_pylist()), np.uint8), np.cumsum(sizes)


def chunked(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def mean_score(quality: Column | str, offset: int = 33) -> Column:
    """Mean of the scores, 0 for an empty text; null for null."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        data, ends = flat(texts)
        sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        return pa.array(np.where(n > 0, (sums[ends] - sums[starts]) / np.maximum(n, 1) - offset, 0.0), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))

    return run(quality)


def trim_position(quality: Column | str, min_quality: float = 20, window: int = 5, offset: int = 33) -> Column:
    """Where the first window with a mean below the threshold starts; else the length. Shorter texts aren't trimmed.

    It is marked so that a plan that both filters by it and cuts with it evaluates it once.
    """
    if window < 1:
        raise ValueError("window must be at least 1")

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        data, ends = flat(texts)
        starts = np.concatenate([[0], ends[:-1]])
        n = ends - starts
        sums = np.concatenate([[0], np.cumsum(data.astype(np.int64) - offset)])
        low = np.flatnonzero(sums[window:] - sums[: len(sums) - window] < min_quality * window) if len(data) >= window else np.zeros(0, np.int64)
        low = np.append(low, 1 << 60)
        first = low[np.searchsorted(low, starts)]
        return pa.array(np.where(first + window <= ends, first - starts, n), mask=pc.is_null(texts).to_numpy(zero_copy_only=False))

    return run.asNondeterministic()(quality)


def motif_positions(seq: Column | str, motif: str) -> Column:
    """All 0-based places of a motif, overlapping ones too, ignoring case; null for null."""
    wanted = motif.upper()

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found, at = None if text is None else [], 0
            text = (text or "").upper()
            while (at := text.find(wanted, at)) >= 0:
                found.append(at)
                at += 1
            out.append(found)
        return pa.array(out, pa.list_(pa.int32()))

    return run(seq)


def position_sums(reads: DataFrame, max_position: int | None = None, offset: int = 33) -> DataFrame:
    """(position, total, above): sums of scores and numbers of scores above zero at each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "quality"):
            data, ends = flat(batch.column("quality"))
            sizes = np.diff(ends, prepend=0)
            place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
            score = data.astype(np.int64) - offset
            if max_position:
                place, score = place[kept := place < max_position], score[kept]
            total, above = np.bincount(place, weights=score).astype(np.int64), np.bincount(place, weights=score > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total), pa.array(above)], ["position", "total", "above"])

    parts = reads.select("quality").mapInArrow(run, "position long, total long, above long")
    return parts.groupBy("position").agg(F.sum("total").alias("total"), F.sum("above").alias("above"))


def trim_sums(quality: Column | str, min_quality: float = 20, window: int = 5, offset: int = 33) -> Column:
    """As ``trim_position``, with the sum of the scores before the cut: (cut, total)."""
    if window < 1:
        raise ValueError("window must be at least 1")

    @F.arrow_udf("struct<cut: bigint, total: bigint>")
    def run(texts: pa.Array) -> pa.Array:
        data, ends = flat(texts)
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.concatenate([[0], np.cumsum(data.astype(np.int64) - offset)])
        low = np.flatnonzero(sums[window:] - sums[: len(sums) - window] < min_quality * window) if len(data) >= window else np.zeros(0, np.int64)
        low = np.append(low, 1 << 60)
        first = low[np.searchsorted(low, starts)]
        cut = np.where(first + window <= ends, first - starts, ends - starts)
        return pa.StructArray.from_arrays([pa.array(cut), pa.array(sums[starts + cut] - sums[starts])], ["cut", "total"], mask=pc.is_null(texts))

    return run.asNondeterministic()(quality)


#: Letters that each code of the fixed nucleotide alphabet stands for, and its complement.
AMBIGUOUS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "N": "ACGT", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG",
}
COMPLEMENT = str.maketrans("ACGTNRYSWKMBDHV", "TGCANYRSWMKVHDB")
#: Plain motifs that one automaton may hold.
MOST_WORDS = 1 << 20


def plain_words(motif: str) -> list[str]:
    """Every text of A, C, G and T that a motif with ambiguous letters stands for; U counts as T."""
    letters = motif.upper().replace("U", "T")
    if not letters or set(letters) - set(AMBIGUOUS):
        raise ValueError(f"not a motif: {motif!r}")
    if math.prod(len(AMBIGUOUS[x]) for x in letters) > MOST_WORDS:
        raise ValueError(f"too ambiguous: {motif!r}")
    return ["".join(x) for x in itertools.product(*(AMBIGUOUS[x] for x in letters))]


def motif_words(motifs: dict[str, str], both_strands: bool) -> dict[str, list[tuple[str, str, int]]]:
    """For each plain text the (name, strand, letters) of the motifs it is one of; one that is its own reverse complement is
    on the + strand only."""
    words: dict[str, list[tuple[str, str, int]]] = {}
    for name, motif in motifs.items():
        turned = motif.upper().replace("U", "T")[::-1].translate(COMPLEMENT)
        for strand, text in (("+", motif), ("-", turned)):
            if strand == "+" or (both_strands and turned != motif.upper().replace("U", "T")):
                for word in plain_words(text):
                    words.setdefault(word, []).append((name, strand, len(word)))
        if len(words) > MOST_WORDS:
            raise ValueError("too many motifs for one pass")
    return words


def motif_hits(texts: DataFrame, key: str, motifs: dict[str, str], both_strands: bool = False) -> DataFrame:
    """(key, motif, strand, position): all places of all motifs, overlapping ones too, in one pass over each text.

    Sequences (key, sequence) go through one automaton of all the texts that the motifs stand for, so the time doesn't grow
    with their number. Ambiguous letters in a motif match what they stand for; in a sequence they match nothing. The key is
    handed on, null or not; null sequences have no hits.
    """
    kind = texts.schema[key].dataType.simpleString()
    words = motif_words(motifs, both_strands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, names in words.items():
            automaton.add_word(word, names)
        automaton.make_automaton()
        for whole in batches:
            for batch in chunked([whole], "sequence"):
                row, found = [], []
                for i, text in enumerate(batch.column("sequence").to_pylist()):
                    if text and words:
                        before = len(found)
                        found += [(name, strand, end - n + 1) for end, names in automaton.iter(text.upper().replace("U", "T")) for name, strand, n in names]
                        row += [i] * (len(found) - before)
                columns = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True))], ["key", "motif", "strand", "position"])

    return texts.select(F.col(key).alias("key"), "sequence").mapInArrow(run, f"key {kind}, motif string, strand string, position long").withColumnRenamed("key", key)


DIGITS = np.full(256, 4, np.uint8)
for _letters, _digit in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    for _letter in _letters:
        DIGITS[ord(_letter)] = _digit


def kmer_numbers(data: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """Base-4 numbers of all windows of k letters of A, C, G, T in a stretch of bytes."""
    return digit_numbers(DIGITS[data], k, canonical)


def digit_numbers(digit: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """The same of digits, where those above 3 are in no window."""
    n = len(digit) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(digit > 3)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    wide = digit.astype(np.int64)
    code, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        code = (code << 2) | wide[j : j + n]
        if canonical:
            other = (other << 2) | (3 - wide[k - 1 - j : k - 1 - j + n])
    return np.minimum(code[at], other[at]) if canonical else code[at]


def kmer_partials(pieces: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(code, n): counts within parts of the input, of pieces (tile binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "tile"):
            data = np.frombuffer(b"\n".join(x or b"" for x in batch.column("tile").to_pylist()), np.uint8)
            codes = kmer_numbers(data, k, canonical)
            if k <= 10:
                n = np.bincount(codes, minlength=1)
                found = np.flatnonzero(n)
                n = n[found]
            else:
                found, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    return pieces.mapInArrow(run, "code long, n long")


# ------------------------------------------------------------------------------ minimiser bins

#: Digits of each packed byte, and the most windows that one stretch has.
UNPACKED = np.stack([np.arange(256) >> s & 3 for s in (6, 4, 2, 0)], axis=1).astype(np.uint8)
STRETCH = 1 << 12


def scrambled(codes: np.ndarray) -> np.ndarray:
    """A one-to-one hash: the order of minimisers doesn't favour runs of one letter."""
    h = codes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def stretches(digit: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first base, bases): maximal runs of windows of k digits with one minimiser, the least scrambled number of
    the words of m digits in the window, on either strand. A window and its reverse complement have the same."""
    n = len(digit) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(digit > 3)])
    wide = np.minimum(digit, 3).astype(np.int64)
    words = len(digit) - m + 1
    code, other = np.zeros(words, np.int64), np.zeros(words, np.int64)
    for j in range(m):
        code, other = (code << 2) | wide[j : j + words], (other << 2) | (3 - wide[m - 1 - j : m - 1 - j + words])
    least = sliding_least(scrambled(np.minimum(code, other)), k - m + 1)
    at = np.flatnonzero(bad[k:] == bad[:-k])
    if not len(at):
        return least[:0], at, at
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    serial = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    first = np.flatnonzero(fresh | (serial % STRETCH == 0))
    last = np.append(first[1:], len(at)) - 1
    return least[at[first]], at[first], at[last] - at[first] + k


def packed_stretches(digit: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each stretch as two bytes of length and four digits a byte."""
    padded = -(-size // 4) * 4
    begin = np.cumsum(padded) - padded
    digits = np.zeros(int(padded.sum()), np.uint8)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    digits[np.repeat(begin, size) + offset] = digit[np.repeat(start, size) + offset]
    four = digits.reshape(-1, 4)
    body = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    width = padded // 4 + 2
    ends = np.cumsum(width)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    inside = np.ones(len(data), bool)
    head = ends - width
    inside[head] = inside[head + 1] = False
    data[head], data[head + 1], data[inside] = size >> 8, size & 255, body
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked_stretches(stretches_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all stretches with a 4 after each, and their sizes."""
    data = np.frombuffer(b"".join(stretches_), np.uint8)
    width = np.array([len(s) for s in stretches_], np.int64)
    head = np.cumsum(width) - width
    size = data[head].astype(np.int64) << 8 | data[head + 1]
    inside = np.ones(len(data), bool)
    inside[head] = inside[head + 1] = False
    digits = UNPACKED[data[inside]].ravel()
    padded = 4 * (width - 2)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(int((size + 1).sum()), 4, np.uint8)
    out[np.repeat(np.cumsum(size + 1) - (size + 1), size) + offset] = digits[np.repeat(np.cumsum(padded) - padded, size) + offset]
    return out, size


def minimiser_rows(pieces: DataFrame, k: int, m: int, bins: int) -> DataFrame:
    """(bin, stretch, n): packed stretches of pieces (tile binary) with how often each occurs in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "tile"):
            digit = DIGITS[np.frombuffer(b"\n".join(x or b"" for x in batch.column("tile").to_pylist()), np.uint8)]
            least, start, size = stretches(digit, k, m)
            found = packed_stretches(digit, start, size).dictionary_encode()
            which, first, n = np.unique(found.indices.to_numpy(), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((least[first] % np.uint64(bins)).astype(np.int32)), found.dictionary.take(pa.array(which)), pa.array(n.astype(np.int32))], ["bin", "stretch", "n"])

    return pieces.mapInArrow(run, "bin int, stretch binary, n int")


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of sorted codes with counts as one."""
    codes, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_bins(rows: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(code, count) of ``minimiser_rows``: a bin has all occurrences of its k-mers, so bins are counted one by one, by
    sorted runs that are merged as they grow; memory follows a bin's distinct k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, runs, size = None, [], 0

        def flushed() -> pa.RecordBatch:
            codes, counts = merged(runs)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "count"])

        for batch in batches:
            bins = batch.column("bin").to_numpy()
            edges = [0, *(np.flatnonzero(bins[1:] != bins[:-1]) + 1).tolist(), len(bins)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held is not None and bins[a] != held and runs:
                    yield flushed()
                    runs, size = [], 0
                held = bins[a]
                part = batch.slice(a, b - a)
                digit, sizes = unpacked_stretches(part.column("stretch").to_pylist())
                weight = np.repeat(part.column("n").to_numpy().astype(np.int64), np.maximum(sizes - k + 1, 0))
                runs.append(merged([(digit_numbers(digit, k, canonical), weight)]))
                size += len(runs[-1][0])
                if size > 1 << 22:
                    runs = [merged(runs)]
                    size = len(runs[0][0])
        if runs:
            yield flushed()

    return rows.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, "code long, count long")
