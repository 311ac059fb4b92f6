"""Local alignment of pairs that are too long for one task.

The matrix of scores of a pair is cut into blocks. A block needs the last row of the one above and the last column of the
one to its left, so all blocks of an anti-diagonal, of all pairs, are one Spark job: a wave. What blocks hand on is written
to the shared folder, a few numbers for each letter of their sides; a lost executor costs the blocks it worked on. The
traceback goes back wave by wave and finds pointers again in the blocks that it passes through, one for each pair at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.operators import align
from strandlake.sources import uploads

#: Letters of a block's sides; its pointers take a byte a cell.
BLOCK = 4096
LOW = np.float32(-np.inf)
EDGES = ("top", "top_run", "left", "left_run")


def block_scores(q: np.ndarray, t: np.ndarray, edges: list[np.ndarray | None], scores: tuple, pointers: np.ndarray | None = None):
    """(bottom, its runs, right, its runs, (score, i, j) of the first best cell in row order) of a block.

    ``edges`` are the row above and the column to the left with the best gaps that end there, from the corner they have in
    common; None at the border of the matrix, where scores are 0 and gaps can't begin. Moves go to ``pointers``.
    """
    match, mismatch, opened = (np.float32(x) for x in scores[:3])
    affine, extended = scores[3] is not None, np.float32(scores[3] or 0)
    m, n = len(q), len(t)
    first_row, first_column = edges[0] is None, edges[2] is None
    top, left = (np.zeros(k + 1, np.float32) if e is None else e for e, k in ((edges[0], n), (edges[2], m)))
    top_run, left_run = (np.full(k + 1, LOW) if e is None else e for e, k in ((edges[1], n), (edges[3], m)))
    bottom, bottom_run, right, right_run = np.zeros(n + 1, np.float32), np.full(n + 1, LOW), np.zeros(m + 1, np.float32), np.full(m + 1, LOW)
    bottom[0], right[0] = left[m], top[n]
    two, one = np.zeros(m + 1, np.float32), np.zeros(m + 1, np.float32)
    ups, lefts = np.full(m + 1, LOW), np.full(m + 1, LOW)
    best, best_at = np.zeros(m + 1, np.float32), np.zeros(m + 1, np.int64)
    two[0], one[0], one[1] = top[0], top[1], left[1]
    backward = t[::-1]
    for s in range(2, m + n + 1):
        a, b = max(1, s - n), min(m, s - 1)
        if s - 1 <= n:
            ups[0] = top_run[s - 1]
        if s - 1 <= m:
            lefts[s - 1] = left_run[s - 1]
        diagonal = two[a - 1 : b] + np.where(q[a - 1 : b] == backward[n - s + a : n - s + b + 1], match, mismatch)
        up, across = one[a - 1 : b] + opened, one[a : b + 1] + opened
        if affine:
            np.maximum(up, ups[a - 1 : b] + extended, out=up)
            np.maximum(across, lefts[a : b + 1] + extended, out=across)
            if first_row and a == 1:
                up[0] = LOW
            if first_column and b == s - 1:
                across[-1] = LOW
            ups[a : b + 1], lefts[a : b + 1] = up, across
        here = np.maximum(np.maximum(diagonal, np.float32(0)), np.maximum(up, across))
        if pointers is not None:
            i = np.arange(a, b + 1)
            pointers[i - 1, s - i - 1] = np.where(here == 0, 0, np.where(diagonal == here, 1, np.where(up == here, 2, 3)))
        better = here > best[a : b + 1]
        if better.any():
            i = np.flatnonzero(better) + a
            best[i], best_at[i] = here[i - a], s - i
        if b == m:
            bottom[s - m], bottom_run[s - m] = here[-1], up[-1]
        if a == s - n:
            right[a], right_run[a] = here[0], across[0]
        two[a : b + 1] = here
        if s <= n:
            two[0] = top[s]
        if s <= m:
            two[s] = left[s]
        two, one = one, two
    row = int(best.argmax())
    return bottom, bottom_run, right, right_run, (float(best[row]), row, int(best_at[row]))


def _block_of(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    q, t = (np.frombuffer(row[c].encode(), np.uint8) for c in ("q", "t"))
    return q, t, [None if row[c] is None else np.frombuffer(row[c], np.float32) for c in EDGES]


def _sides(block: int, scores: tuple) -> Callable:
    """Blocks with their edges -> what they hand on, and their best cells' places in the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                values = row.to_pylist()[0]
                *sides, (score, i, j) = block_scores(*_block_of(values), scores)
                found = [pa.array([x.tobytes()], pa.binary()) for x in sides]
                place = [pa.array([score]), pa.array([values["br"] * block + i], pa.int64()), pa.array([values["bc"] * block + j], pa.int64())]
                yield pa.RecordBatch.from_arrays([row.column(c) for c in ("id", "br", "bc")] + found + place, ["id", "br", "bc", "bottom", "bottom_run", "right", "right_run", "score", "i", "j"])

    return run


def _walk(block: int, scores: tuple) -> Callable:
    """Blocks with their edges and a cell (i, j) of the matrix -> the aligned letters up to there, and the cell before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                values = row.to_pylist()[0]
                q, t, edges = _block_of(values)
                i, j = values["i"] - values["br"] * block, values["j"] - values["bc"] * block
                pointers, x, y = np.zeros((i, j), np.uint8), [], []
                block_scores(q[:i], t[:j], [None if e is None else e[: n + 1] for e, n in zip(edges, (j, j, i, i), strict=True)], scores, pointers)
                at, stopped = (i, j), False
                while at[0] and at[1]:
                    move = pointers[at[0] - 1, at[1] - 1]
                    if not move:
                        stopped = True
                        break
                    x.append(values["q"][at[0] - 1] if move != 3 else "-")
                    y.append(values["t"][at[1] - 1] if move != 2 else "-")
                    at = at[0] - (move != 3), at[1] - (move != 2)
                places = [0, 0] if stopped else [values["br"] * block + int(at[0]), values["bc"] * block + int(at[1])]
                yield pa.RecordBatch.from_arrays([row.column("id"), *(pa.array([p], pa.int64()) for p in places), pa.array(["".join(reversed(x))]), pa.array(["".join(reversed(y))])], ["id", "i", "j", "x", "y"])

    return run


def align_long(pairs: DataFrame, query: str = "query", target: str = "target", key: str = "pair", match: float = 2.0, mismatch: float = -1.0,
               gap_open: float = -2.0, gap_extend: float | None = -0.5, block: int = BLOCK) -> DataFrame:
    """The pairs with the columns of ``align.align_pairs``, and equal to it; ``key`` is unique and not null.

    Null and empty texts have score 0 and empty alignments; an empty table gives an empty table. Jobs run when this is
    called: two for each block on the way along a matrix's sides, whatever the number of pairs.
    """
    spark, scores = pairs.sparkSession, (match, mismatch, gap_open, gap_extend)
    path = uploads.new_path(spark)
    parts = 2 * spark.sparkContext.defaultParallelism

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    def pieces(column: str, number: str, text: str) -> DataFrame:
        letters = pairs.select(F.col(key).alias("id"), S.aligner_letters(F.coalesce(column, F.lit(""))).alias("_text")).where("_text <> ''")
        each = letters.select("id", "_text", F.explode(F.expr(f"sequence(0, cast((length(_text) - 1) div {block} as int))")).alias(number))
        return written(each.select("id", number, F.substring("_text", F.col(number) * block + 1, F.lit(block)).alias(text)), text)

    queries, targets = pieces(query, "br", "q"), pieces(target, "bc", "t")

    def edged(blocks: DataFrame, wave: int) -> DataFrame:
        """Blocks (id, br, bc, ...) of a wave with the sides of the wave before."""
        if not wave:
            rows = blocks.select("*", *(F.lit(None).cast("binary").alias(c) for c in EDGES))
        else:
            above = waves[wave - 1].select("id", (F.col("br") + 1).alias("br"), "bc", F.col("bottom").alias("top"), F.col("bottom_run").alias("top_run"))
            before = waves[wave - 1].select("id", "br", (F.col("bc") + 1).alias("bc"), F.col("right").alias("left"), F.col("right_run").alias("left_run"))
            rows = blocks.join(above, ["id", "br", "bc"], "left").join(before, ["id", "br", "bc"], "left")
        return rows.repartition(parts, "id", "br", "bc")

    kind = pairs.schema[key].dataType.simpleString()
    side = f"id {kind}, br int, bc int, bottom binary, bottom_run binary, right binary, right_run binary, score double, i long, j long"
    grid = queries.groupBy("id").agg(F.max("br").alias("r")).join(targets.groupBy("id").agg(F.max("bc").alias("c")), "id")
    last, waves = grid.agg(F.max(F.col("r") + F.col("c"))).first()[0], []
    for wave in range(-1 if last is None else last + 1):
        blocks = queries.join(targets.withColumn("br", F.lit(wave) - F.col("bc")), ["id", "br"])
        waves.append(written(edged(blocks, wave).mapInArrow(_sides(block, scores), side), f"wave{wave}"))

    ends = None
    for wave in waves:
        cells = wave.where("score > 0").select("id", F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j")).alias("cell"))
        ends = cells if ends is None else ends.unionByName(cells)
    named = pairs.withColumnRenamed(key, "id") if key != "id" else pairs
    if ends is None:
        return align.describe(named.select("*", F.lit(0.0).alias("score"), F.lit("").alias("aligned_query"), F.lit("").alias("aligned_target")).withColumnRenamed("id", key))
    best = written(ends.groupBy("id").agg(F.max("cell").alias("cell")).select("id", "cell.score", (-F.col("cell.i")).alias("i"), (-F.col("cell.j")).alias("j")), "best")
    walked, now = [], best.select("id", "i", "j")
    place = [F.expr(f"cast(({c} - 1) div {block} as int)").alias(n) for c, n in (("i", "br"), ("j", "bc"))]
    while (wave := now.where("i > 0 AND j > 0").agg(F.max(F.expr(f"(i - 1) div {block} + (j - 1) div {block}"))).first()[0]) is not None:
        placed = now.where("i > 0 AND j > 0").select("*", *place)
        here = F.col("br") + F.col("bc") == F.lit(wave)
        blocks = placed.where(here).join(queries, ["id", "br"]).join(targets, ["id", "bc"])
        texts = edged(blocks, wave).mapInArrow(_walk(block, scores), f"id {kind}, i long, j long, x string, y string")
        rest = placed.where(~here).select("id", "i", "j", F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"))
        step = written(texts.unionByName(rest), f"step{len(walked)}")
        walked.append(step.where("x IS NOT NULL").select("id", F.lit(-len(walked)).alias("n"), "x", "y"))
        now = step.select("id", "i", "j")
    whole = walked[0]
    for step in walked[1:]:
        whole = whole.unionByName(step)
    joined = whole.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "x", "y"))).alias("p"))
    found = best.select("id", "score").join(joined, "id").select("id", "score", F.array_join("p.x", "").alias("aligned_query"), F.array_join("p.y", "").alias("aligned_target"))
    rows = named.join(written(found, "found"), "id", "left").fillna({"score": 0.0, "aligned_query": "", "aligned_target": ""})
    return align.describe(rows.select(*named.columns, "score", "aligned_query", "aligned_target").withColumnRenamed("id", key))
