"""Pileup and variant calls.

References are rows (ref_id, sequence), reads rows (ref_id, sequence, start, strand, quality): start is 0-based and the
left-most place on either strand. The pileup keeps covered places only; gaps are found between neighbouring ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import seq as S
from strandlake.functions import vector

#: Places of a tile, whose counts are added as one vector: a letter's cell fits in 16 bits. Groups of tasks, and cells held in one.
TILE, DEALS, HELD = 1 << 14, 16, 1 << 22

#: Places of a reference are dealt out in spans of so many, so that no window holds a whole chromosome.
SPAN = 1 << 20
#: Bases of a reference's piece that places are joined to.
WINDOW = 1 << 16


def ascii_of(texts: pa.Array) -> pa.Array:
    """The same texts with a ? for each letter that isn't ASCII, so that a byte is a letter; null is empty."""
    filled = pc.fill_null(texts, "")
    return filled if pc.all(pc.string_is_ascii(filled)).as_py() is not False else pa.array([t.encode("ascii", "replace").decode() for t in filled.to_pylist()])


def cells_of(batch: pa.RecordBatch, min_base_quality: int | None, offset: int, reverse_qualities: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, place, letter) of every base that counts of reads (sequence, quality, strand, start, length)."""
    data, ends = vector.flat(ascii_of(batch.column("sequence")))
    sizes = np.diff(ends, prepend=0)
    read = np.repeat(np.arange(len(sizes)), sizes)
    i = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    minus = pc.fill_null(pc.equal(batch.column("strand"), "-"), False).to_numpy(zero_copy_only=False)
    turned = minus[read]
    digit = vector.DIGITS[data[np.where(turned, (ends - 1)[read] - i, np.arange(len(data)))]]
    digit = np.where(turned & (digit < 4), 3 - digit, digit)
    start, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length"))
    place = start.astype(np.int64)[read] + i
    good = (digit < 4) & (place >= 0) & (place < length[read])
    if min_base_quality is not None:
        scores, q_ends = vector.flat(ascii_of(batch.column("quality")))
        q_sizes = np.diff(q_ends, prepend=0)
        at = np.where(turned & reverse_qualities, q_sizes[read] - 1 - i, i)
        has = (i < q_sizes[read]) & (at >= 0)
        score = np.zeros(len(data), np.int64)
        score[has] = scores[(q_ends - q_sizes)[read[has]] + at[has]].astype(np.int64) - offset
        good &= score >= min_base_quality
    return read[good], place[good], digit[good]


def tile_counts(references: DataFrame, reads: DataFrame, min_base_quality: int | None = None, offset: int = 33, reverse_qualities: bool = False) -> DataFrame:
    """(ref_id, tile, cells binary, n binary): for each tile of TILE places how often each letter was read at each place.

    Only A, C, G and T on the reference, of sufficient quality, count. A missing quality counts as 0; qualities of minus
    reads stay in the order they are given in, unless asked otherwise. A task sends one row for each tile it has reads of,
    however deep the tile is, with the cells that aren't 0; rows of a tile are added within groups of tasks, then at all.
    """
    lengths = references.select("ref_id", F.length("sequence").cast("long").alias("length"))
    placed = reads.join(lengths, "ref_id").select("ref_id", "sequence", "quality" if min_base_quality is not None else F.lit(None).cast("string").alias("quality"), "strand", "start", "length")
    kind = reads.schema["ref_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, type_ = TaskContext.get().partitionId() % DEALS, {}, 0, None

        def rows() -> pa.RecordBatch:
            keys, added = list(held), [vector.merged(v) for v in held.values()]
            columns = [pa.array([k[0] for k in keys], type_), pa.array([k[1] for k in keys], pa.int64()), pa.array([part] * len(keys), pa.int32())]
            packed = [pa.array([a.astype(t).tobytes() for a in x], pa.binary()) for x, t in zip(zip(*added, strict=True), (np.uint16, np.int64), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *packed], ["ref_id", "tile", "deal", "cells", "n"])

        for whole in batches:
            for batch in vector.chunked([whole], "sequence", vector.CHUNK // 4):
                type_ = batch.column("ref_id").type
                read, place, digit = cells_of(batch, min_base_quality, offset, reverse_qualities)
                named = batch.column("ref_id").dictionary_encode()
                ref = named.indices.to_numpy()[read].astype(np.int64)
                tile, cell = place // TILE, place % TILE * 4 + digit
                key, which = np.unique(ref << 40 | tile, return_inverse=True)
                found, n = np.unique(which * (4 * TILE) + cell, return_counts=True)
                edges = np.searchsorted(found, np.arange(len(key) + 1) * (4 * TILE))
                for k, x in enumerate(key.tolist()):
                    here = slice(edges[k], edges[k + 1])
                    held.setdefault((named.dictionary[x >> 40].as_py(), x & (1 << 40) - 1), []).append((found[here] - k * (4 * TILE), n[here]))
                size += len(found)
                if size > HELD:
                    held = {k: [vector.merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield rows()
                        held, size = {}, 0
        if held:
            yield rows()

    def added(group: pa.Table) -> pa.Table:
        pairs = zip(*(group.column(c).to_pylist() for c in ("cells", "n")), strict=True)
        cells, n = vector.merged([(np.frombuffer(c, np.uint16).astype(np.int64), np.frombuffer(k, np.int64)) for c, k in pairs])
        first = group.slice(0, 1)
        return pa.table([first.column("ref_id"), first.column("tile"), first.column("deal"), pa.array([cells.astype(np.uint16).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], group.column_names)

    schema = f"ref_id {kind}, tile long, deal int, cells binary, n binary"
    some = placed.mapInArrow(run, schema).groupBy("ref_id", "tile", "deal").applyInArrow(added, schema)
    return some.withColumn("deal", F.lit(0)).groupBy("ref_id", "tile").applyInArrow(added, schema).drop("deal")


def covered(references: DataFrame, reads: DataFrame, min_base_quality: int | None = None, **how) -> DataFrame:
    """(ref_id, pos, a, c, g, t, depth, consensus) of the places with at least one base."""
    tiles = tile_counts(references, reads, min_base_quality, **how)
    kind = reads.schema["ref_id"].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells, n = np.frombuffer(batch.column("cells")[k].as_py(), np.uint16), np.frombuffer(batch.column("n")[k].as_py(), np.int64)
                counts = np.zeros((TILE, 4), np.int64)
                counts.ravel()[cells] = n
                at = np.flatnonzero(counts.any(axis=1))
                ref = pa.repeat(batch.column("ref_id")[k], len(at))
                yield pa.RecordBatch.from_arrays([ref, pa.array(at + batch.column("tile")[k].as_py() * TILE), *(pa.array(counts[at, j]) for j in range(4))], ["ref_id", "pos", *"acgt"])

    counts = tiles.mapInArrow(places, f"ref_id {kind}, pos long, a long, c long, g long, t long")
    depth = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    most = F.greatest("a", "c", "g", "t")
    consensus = F.when(F.col("a") == most, "A").when(F.col("c") == most, "C").when(F.col("g") == most, "G").otherwise("T")
    return counts.withColumn("depth", depth).withColumn("consensus", consensus)


def reference_tiles(references: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ref_id, _tile, _at, tile): references in numbered pieces of ``window`` bases, the first of each at ``_at``."""
    parts = references.select("ref_id", F.explode(S.tiles("sequence", window)).alias("w"))
    return parts.select("ref_id", F.expr(f"cast(w.start AS bigint) div {window}").alias("_tile"), F.col("w.start").cast("long").alias("_at"), F.col("w.tile").alias("tile"))


def reference_bases(references: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ref_id, pos, ref_base) of every place; long references are dealt out in windows."""
    return reference_tiles(references, window).select("ref_id", "_at", F.posexplode(S.letters(F.col("tile"))).alias("i", "ref_base")).select("ref_id", (F.col("_at") + F.col("i")).alias("pos"), "ref_base")


def pileup(references: DataFrame, reads: DataFrame, min_base_quality: int | None = None, **how) -> DataFrame:
    """(ref_id, pos, ref_base, a, c, g, t, depth, consensus) of every place; N where nothing covers it."""
    found = reference_bases(references).join(covered(references, reads, min_base_quality, **how), ["ref_id", "pos"], "left")
    return found.fillna(0, ["a", "c", "g", "t", "depth"]).fillna("N", ["consensus"])


def consensus_spans(piled: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ref_id, start, consensus): the text of each span of ``window`` places; no row holds more than a span."""
    spans = piled.groupBy("ref_id", F.expr(f"pos div {window} * {window}").alias("start"))
    return spans.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "consensus"))), lambda x: x["consensus"]), "").alias("consensus"))


def consensus_sequences(piled: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ref_id, consensus): one text for each reference, put together from the texts of its spans."""
    spans = consensus_spans(piled, window).groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("start", "consensus"))).alias("_s"))
    return spans.select("ref_id", F.array_join(F.transform("_s", lambda x: x["consensus"]), "").alias("consensus"))


def _call(position, ref, alt, kind, depth, alt_count, freq, counts) -> list:
    return [
        position.cast("long").alias("position"), ref.alias("ref"), alt.alias("alt"), F.lit(kind).alias("type"), depth.cast("long").alias("depth"),
        alt_count.cast("long").alias("alt_count"), freq.cast("double").alias("freq"), counts.alias("bases"),
    ]


def snvs(references: DataFrame, places: DataFrame, min_depth: int = 10, min_alt_freq: float = 0.2) -> DataFrame:
    """Places whose consensus is another letter than the reference's, which isn't N, with the depth and share asked for."""
    alt_count = F.greatest("a", "c", "g", "t")
    deep = places.where((F.col("depth") >= min_depth) & (alt_count / F.col("depth") >= min_alt_freq))
    tile = F.expr(f"pos div {WINDOW}")
    letter = deep.withColumn("_tile", tile).join(reference_tiles(references), ["ref_id", "_tile"]).withColumn("ref", F.upper(S.piece(F.col("tile"), (F.col("pos") - F.col("_at") + 1).cast("int"), 1)))
    counts = F.create_map(*[x for b in "ACGT" for x in (F.lit(b), F.col(b.lower()))])
    return letter.where((F.col("ref") != F.col("consensus")) & (F.col("ref") != "N")).select(
        "ref_id", *_call(F.col("pos") + 1, F.col("ref"), F.col("consensus"), "SNV", F.col("depth"), alt_count, alt_count / F.col("depth"), counts)
    )


def deletions(references: DataFrame, places: DataFrame, min_del_len: int = 2, min_flank_depth: int = 2, span: int = SPAN) -> DataFrame:
    """Runs of uncovered places between flanks of the depth asked for; a run at the start needs no left flank, one at the end is none.

    Neighbours are found within spans of the reference; only a span's first place looks at the last one of an earlier span.
    """
    dealt = places.select("ref_id", "pos", "depth", F.expr(f"pos div {span}").alias("_span"))
    inner = dealt.selectExpr("*", "lag(struct(pos, depth)) OVER (PARTITION BY ref_id, _span ORDER BY pos) AS _left")
    ends = dealt.groupBy("ref_id", "_span").agg(F.max(F.struct("pos", "depth")).alias("_end"))
    before = ends.selectExpr("ref_id", "_span", "lag(_end) OVER (PARTITION BY ref_id ORDER BY _span) AS _earlier")
    found = inner.join(before, ["ref_id", "_span"]).withColumn("_left", F.coalesce("_left", "_earlier"))
    start = F.coalesce(F.col("_left.pos"), F.lit(-1)) + 1
    length = F.col("pos") - start
    runs = found.where((length >= min_del_len) & (F.col("depth") >= min_flank_depth) & (F.col("_left").isNull() | (F.col("_left.depth") >= min_flank_depth)))
    runs = runs.select("ref_id", start.alias("_start"), length.alias("_length"))
    tiles = F.explode(F.expr(f"sequence(_start div {WINDOW}, (_start + _length - 1) div {WINDOW})")).alias("_tile")
    pieces = runs.select("*", tiles).join(reference_tiles(references), ["ref_id", "_tile"])
    begins = F.greatest(F.col("_start") - F.col("_at"), F.lit(0))
    ends = F.least(F.col("_start") + F.col("_length") - F.col("_at"), F.lit(WINDOW))
    part = F.substring(F.col("tile").cast("binary"), (begins + 1).cast("int"), (ends - begins).cast("int")).cast("string")
    texts = pieces.groupBy("ref_id", "_start", "_length").agg(F.array_sort(F.collect_list(F.struct("_tile", part.alias("t")))).alias("_t"))
    none = F.create_map().cast("map<string,bigint>")
    text = F.array_join(F.transform("_t", lambda x: x["t"]), "")
    return texts.select("ref_id", *_call(F.col("_start") + 1, text, F.lit("-"), "DEL", F.lit(0), F.lit(0), F.lit(1.0), none))


def call_variants(references: DataFrame, reads: DataFrame, min_depth: int = 10, min_alt_freq: float = 0.2, min_base_quality: int | None = None, **how) -> DataFrame:
    """SNVs and deletions of every reference. Order by ref_id and position. Without reads there are none."""
    places = covered(references, reads, min_base_quality, **how).persist()
    return snvs(references, places, min_depth, min_alt_freq).unionByName(deletions(references, places))


def summary(references: DataFrame, reads: DataFrame, min_depth: int = 10, min_alt_freq: float = 0.2) -> DataFrame:
    """For each reference: total_variants, snvs, deletions and mean depth, rounded to 2; base qualities don't count."""
    places = covered(references, reads).persist()
    calls = snvs(references, places, min_depth, min_alt_freq).unionByName(deletions(references, places))
    kinds = calls.groupBy("ref_id").agg(F.count("*").alias("total_variants"), F.count_if(F.col("type") == "SNV").alias("snvs"), F.count_if(F.col("type") == "DEL").alias("deletions"))
    depth = places.groupBy("ref_id").agg(F.sum("depth").alias("_depth"))
    found = references.select("ref_id", F.length("sequence").alias("_n")).join(depth, "ref_id", "left").join(kinds, "ref_id", "left")
    mean = F.bround(F.coalesce("_depth", F.lit(0)) / F.greatest("_n", F.lit(1)), 2)
    return found.select("ref_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_variants", "snvs", "deletions")], mean.alias("mean_depth"))
