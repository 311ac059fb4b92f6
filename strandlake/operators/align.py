"""Local alignment of sequence pairs, and the mutations it shows.

Spark has no operator for a dynamic programme over two texts, so scores and aligned texts come from an Arrow-batched
UDF; all else (identity, CIGAR, variants, matches with known ones) are expressions and one join. The programme runs
along anti-diagonals of many pairs at once: pairs of a batch are sorted by size and stacked.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import seq as S

#: Default scores: match, mismatch, opening a gap, extending it.
SCORES = (2.0, -1.0, -2.0, -0.5)
ALIGNED = "struct<score:double,aligned_query:string,aligned_target:string>"
VARIANT = "array<struct<position:int,ref:string,alt:string,type:string>>"
#: Cells of one stack of pairs.
CELLS = 4 << 20


def local_alignments(pairs: list[tuple[str, str]], match: float, mismatch: float, gap_open: float, gap_extend: float | None) -> list[tuple[float, str, str]]:
    """Scores and aligned texts. With ``gap_extend`` a gap of k costs gap_open + gap_extend * (k - 1) and can't begin at
    the border; without, each gap letter costs gap_open.

    A cell's pointer is the first of stop, diagonal, up (a query letter against a gap) and left with the cell's score;
    a traceback starts at the first best cell in row order and moves one cell for each pointer it reads.
    """
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        to, m, n = at, 0, 0
        while to < len(order):
            q, t = pairs[order[to]]
            wide, high = max(m, len(q)), max(n, len(t))
            if to > at and (to - at + 1) * (wide + 1) * (high + 1) > CELLS:
                break
            m, n, to = wide, high, to + 1
        for i, found in zip(order[at:to], _stack([pairs[i] for i in order[at:to]], m, n, match, mismatch, gap_open, gap_extend), strict=True):
            out[i] = found
        at = to
    return out


def _stack(pairs, m, n, match, mismatch, gap_open, gap_extend):
    """Scores and aligned texts of pairs of at most m and n letters.

    Two diagonals of scores are held. Pointers are, a byte a cell, those of all diagonals if there are few; else the state
    is kept at every ``span`` diagonals and the pointers between two of these are found again for the traceback, so that
    memory grows with the text's length times its square root.
    """
    count, end = len(pairs), m + n + 1
    q, t = np.zeros((count, m), np.uint8), np.zeros((count, n), np.uint8)
    for k, (a, b) in enumerate(pairs):
        q[k, : len(a)], t[k, : len(b)] = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    widths = np.array([[len(b)] for _, b in pairs])
    affine, low = gap_extend is not None, np.float32(-np.inf)
    opened, extended = np.float32(gap_open), np.float32(gap_extend or 0)
    best, best_at = np.zeros((count, m + 1), np.float32), np.zeros((count, m + 1), np.int64)  # of each row, its first best cell

    def sweep(state, first, to, pointers=None, look=False):
        # scores of the last diagonal and the one before, and the best gaps that end in the last one's cells, by row
        one, two, up_run, left_run = state
        for s in range(first, to):
            i = np.arange(max(1, s - n), min(m, s - 1) + 1)
            j = s - i
            diagonal = two[:, i - 1] + np.where(q[:, i - 1] == t[:, j - 1], np.float32(match), np.float32(mismatch))
            up, left = one[:, i - 1] + opened, one[:, i] + opened
            if affine:  # gaps reach back to row and column 1 at most
                up = np.where(i > 1, np.maximum(up, up_run[:, i - 1] + extended), low)
                left = np.where(j > 1, np.maximum(left, left_run[:, i] + extended), low)
                up_run[:, i], left_run[:, i] = up, left
            choices = np.stack([np.zeros_like(diagonal), diagonal, up, left])
            here = choices.max(axis=0)
            if pointers is not None:
                pointers[:, s - first, i] = choices.argmax(axis=0)
            if look:
                better = (here > best[:, i]) & (j <= widths)
                best[:, i], best_at[:, i] = np.where(better, here, best[:, i]), np.where(better, j, best_at[:, i])
            two[:, i] = here
            one, two = two, one
        return one, two, up_run, left_run

    state = (*(np.zeros((count, m + 1), np.float32) for _ in range(2)), *(np.full((count, m + 1), low) for _ in range(2)))
    few = count * (m + 1) * end <= 4 * CELLS
    span = end if few else 4 * int(np.sqrt(end)) + 1
    blocks, pointers = [(first, min(first + span, end)) for first in range(2, end, span)], None
    kept = []
    for first, to in blocks:
        kept.append(None if few else [x.copy() for x in state])
        pointers = np.zeros((count, to - first, m + 1), np.uint8) if few else None
        state = sweep(state, first, to, pointers, look=True)
    rows = [int(best[k, : len(a) + 1].argmax()) for k, (a, _) in enumerate(pairs)]
    places = [[i, int(best_at[k, i])] for k, i in enumerate(rows)]
    texts = [([], []) for _ in pairs]
    for (first, to), was in zip(reversed(blocks), reversed(kept), strict=True):
        if was is not None:
            if not any(i > 0 and j > 0 and i + j >= first for i, j in places):
                continue
            pointers = np.zeros((count, to - first, m + 1), np.uint8)
            sweep(was, first, to, pointers)
        for k, (a, b) in enumerate(pairs):
            i, j = places[k]
            x, y = texts[k]
            while i > 0 and j > 0 and i + j >= first:
                move = pointers[k, i + j - first, i]
                if not move:
                    i = j = 0
                    break
                x.append(a[i - 1] if move != 3 else "-")
                y.append(b[j - 1] if move != 2 else "-")
                i, j = i - (move != 3), j - (move != 2)
            places[k] = [i, j]
    for k, (x, y) in enumerate(texts):
        yield float(best[k, rows[k]]), "".join(reversed(x)), "".join(reversed(y))


def aligner(match: float = 2.0, mismatch: float = -1.0, gap_open: float = -2.0, gap_extend: float | None = -0.5):
    """A column function (query, target) -> struct(score, aligned_query, aligned_target) of prepared letters."""

    @F.pandas_udf(ALIGNED)
    def run(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        found = local_alignments(list(zip(query.fillna(""), target.fillna(""), strict=True)), match, mismatch, gap_open, gap_extend)
        return pd.DataFrame(found, columns=["score", "aligned_query", "aligned_target"])

    return run


def columns_of(q: Column, t: Column) -> Column:
    """The alignment's columns as structs (q, t)."""
    return F.arrays_zip(S.letters(q).alias("q"), S.letters(t).alias("t"))


def cigar(q: Column, t: Column) -> Column:
    """Run lengths of M (equal), D (gap in the query), I (gap in the target) and X."""
    op = F.transform(columns_of(q, t), lambda c: F.when(c["q"] == c["t"], "M").when(c["q"] == "-", "D").when(c["t"] == "-", "I").otherwise("X"))
    text = F.array_join(op, "")
    runs = F.regexp_extract_all(text, F.lit("M+|D+|I+|X+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")


def variants(q: Column, t: Column) -> Column:
    """Differing columns: 1-based place among the target's letters in the alignment, letters ('' for a gap) and type."""
    kind = lambda c: F.when((c["q"] == "-") & (c["t"] != "-"), "DELETION").when((c["q"] != "-") & (c["t"] == "-"), "INSERTION").when((c["q"] != "-") & (c["t"] != "-"), "SNV").otherwise("UNKNOWN")
    numbered = F.aggregate(
        columns_of(q, t),
        F.struct(F.lit(0).alias("at"), F.array().cast(VARIANT).alias("found")),
        lambda a, c: F.struct(
            (a["at"] + F.when(c["t"] != "-", 1).otherwise(0)).alias("at"),
            F.when(
                c["q"] != c["t"],
                F.concat(a["found"], F.array(F.struct(
                    (a["at"] + F.when(c["t"] != "-", 1).otherwise(0)).alias("position"), F.when(c["t"] != "-", c["t"]).otherwise("").alias("ref"), F.when(c["q"] != "-", c["q"]).otherwise("").alias("alt"), kind(c).alias("type")
                ))),
            ).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return numbered


def align_pairs(pairs: DataFrame, query: str = "query", target: str = "target", **scores: float) -> DataFrame:
    """The pairs with score, aligned_query, aligned_target, alignment_length, identity_percent, gaps, mismatches, cigar.

    Letters other than A, C, G and T align as N. The work of a pair is the product of its lengths.
    """
    run = aligner(**scores)
    found = pairs.withColumn("_a", run(S.aligner_letters(F.coalesce(query, F.lit(""))), S.aligner_letters(F.coalesce(target, F.lit("")))))
    return describe(found.select(*pairs.columns, "_a.*"))


def describe(found: DataFrame) -> DataFrame:
    """Rows with aligned_query and aligned_target, with alignment_length, identity_percent, gaps, mismatches, cigar."""
    q, t = F.col("aligned_query"), F.col("aligned_target")
    same = lambda f: F.size(F.filter(columns_of(q, t), f))
    length = F.length(q)
    return (
        found.withColumn("alignment_length", length)
        .withColumn("identity_percent", F.when(length > 0, same(lambda c: (c["q"] == c["t"]) & (c["q"] != "-")) / length * 100).otherwise(0.0))
        .withColumn("gaps", (S.count_of(q, "-") + S.count_of(t, "-")).cast("int"))
        .withColumn("mismatches", same(lambda c: (c["q"] != c["t"]) & (c["q"] != "-") & (c["t"] != "-")))
        .withColumn("cigar", cigar(q, t))
    )


def align_lists(queries: DataFrame, targets: DataFrame, index: str = "idx", **scores: float) -> DataFrame:
    """Pairs by index of (idx, query) and (idx, target); both sides must have the same indexes."""
    both = queries.join(targets, index, "full_outer")
    whole = both.withColumn("query", F.when(F.col("query").isNull() | F.col("target").isNull(), F.raise_error(F.lit("queries and targets differ in number"))).otherwise(F.col("query")))
    return align_pairs(whole, **scores)


def find_variants(aligned: DataFrame, *keys: str) -> DataFrame:
    """(keys, position, ref, alt, type): a row for each differing column of ``align_pairs``."""
    return aligned.select(*keys, F.explode(variants(F.col("aligned_query"), F.col("aligned_target"))).alias("v")).select(*keys, "v.*")


def match_known(found: DataFrame, known: DataFrame) -> DataFrame:
    """Variants that are known: equal position, ref and alt, nulls too; a known one that repeats, repeats. Other columns of
    ``known`` come as known_data."""
    extra = [c for c in known.columns if c not in ("position", "ref", "alt")]
    named = known.select(*[F.col(c).alias(f"_{c}") for c in ("position", "ref", "alt")], (F.struct(*extra) if extra else F.lit(None).cast("string")).alias("known_data"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("position", "ref", "alt")]
    return found.join(named, same[0] & same[1] & same[2]).drop("_position", "_ref", "_alt")


def mutation_stats(aligned: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """For each pair (unique keys): total_variants, snvs, insertions, deletions, known_matches, alignment_score, identity_percent."""
    found = find_variants(aligned, *keys)
    kinds = found.groupBy(*keys).agg(F.count("*").alias("total_variants"), *[F.count_if(F.col("type") == k).alias(n) for k, n in (("SNV", "snvs"), ("INSERTION", "insertions"), ("DELETION", "deletions"))])
    matches = match_known(found, known).groupBy(*keys).agg(F.count("*").alias("known_matches"))
    joined = aligned.select(*keys, F.col("score").alias("alignment_score"), "identity_percent").join(kinds, list(keys), "left").join(matches, list(keys), "left")
    return joined.fillna(0, ["total_variants", "snvs", "insertions", "deletions", "known_matches"])


def align_simple(queries: DataFrame, targets: DataFrame, index: str = "idx", match: float = 2.0, mismatch: float = -1.0, gap: float = -1.0) -> DataFrame:
    """Linear-gap alignment of (idx, query) with (idx, target), with SNVs as mutations (position, ref, alt, alignment_pos).

    Queries beyond the last target take the last target ('' if there is none); targets beyond the last query are left out.
    """
    last = targets.agg(F.max_by("target", index).alias("_last"))
    pairs = queries.join(targets, index, "left").crossJoin(last).withColumn("target", F.coalesce("target", "_last", F.lit(""))).drop("_last")  # one row
    run = aligner(match, mismatch, gap, None)
    found = pairs.withColumn("_a", run(S.simple_aligner_letters(F.coalesce("query", F.lit(""))), S.simple_aligner_letters("target"))).select(*pairs.columns, "_a.*")
    step = lambda a, c: (a["at"] + F.when(c["t"] != "-", 1).otherwise(0)).alias("at")
    differs = lambda c: (c["q"] != c["t"]) & (c["q"] != "-") & (c["t"] != "-")
    changed = F.aggregate(
        columns_of(F.col("aligned_query"), F.col("aligned_target")),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<position:int,ref:string,alt:string,alignment_pos:int>>").alias("found")),
        lambda a, c: F.struct(
            step(a, c), (a["i"] + 1).alias("i"),
            F.when(differs(c), F.concat(a["found"], F.array(F.struct(step(a, c).alias("position"), c["t"].alias("ref"), c["q"].alias("alt"), a["i"].alias("alignment_pos"))))).otherwise(a["found"]).alias("found"),
        ),
        lambda a: a["found"],
    )
    return found.withColumn("mutations", changed).withColumn("mutation_count", F.size("mutations"))


def benchmark(spark: SparkSession, sequence_length: int = 100, num_pairs: int = 100, seed: int = 1) -> dict:
    """Seconds, and pairs a second, that aligning made-up sequences with themselves takes."""
    letter = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(4)) + 1).cast("int"), F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(sequence_length)), letter), "")
    pairs = spark.range(num_pairs).select(text.alias("query")).withColumn("target", F.col("query"))
    began = time.perf_counter()
    align_pairs(pairs).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - began
    return {"pairs": num_pairs, "length": sequence_length, "seconds": seconds, "pairs_per_second": num_pairs / seconds}
