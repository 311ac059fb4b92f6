"""Table functions for SQL, over Arrow batches: k-mers, pileup and alignment.

A function takes a table; ``PARTITION BY`` says which rows one instance sees together. None of them needs all rows of a key
at once: their counts are partial ones, to be summed by the query around them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlake.functions import vector
from strandlake.operators import align, pileup


def one(value: pa.Array | pa.Scalar | float | bool):
    """A constant argument, however it comes."""
    value = value[0] if isinstance(value, (pa.Array, pa.ChunkedArray)) else value
    return value.as_py() if isinstance(value, pa.Scalar) else value


class KmerTable:
    """(code, n) of the windows of k letters in the column ``sequence``: counts within batches."""

    def eval(self, batch: pa.RecordBatch, k, canonical):
        texts = [t or "" for t in batch.column("sequence").to_pylist()]
        codes = vector.kmer_numbers(np.frombuffer("\n".join(texts).encode("ascii", "replace"), np.uint8), int(one(k)), bool(one(canonical)))
        found, n = np.unique(codes, return_counts=True)
        yield pa.table({"code": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})


class PileupTable:
    """(ref_id, pos, a, c, g, t) of reads (ref_id long, sequence, quality, strand, start int, length long of the reference).

    A partition's counts are held by place; partitioned by reference and a tile of starts, it holds a tile's. Places that
    reads of two partitions cover come from both.
    """

    def __init__(self) -> None:
        self.counts: Counter = Counter()

    def eval(self, batch: pa.RecordBatch, least):
        batch = batch.set_column(batch.schema.get_field_index("sequence"), "sequence", pileup.ascii_of(batch.column("sequence")))
        wanted = one(least)
        read, place, digit = pileup.cells_of(batch, None if wanted is None or wanted < 0 else int(wanted), 33, False)
        ref = np.asarray(batch.column("ref_id").to_numpy(zero_copy_only=False))[read]
        keys, n = np.unique(np.stack([ref.astype(np.int64), place * 4 + digit], axis=1), axis=0, return_counts=True)
        for (r, cell), k in zip(keys.tolist(), n.tolist(), strict=True):
            self.counts[r, cell] += k
        return iter(())

    def terminate(self):
        places: dict[tuple[int, int], list[int]] = {}
        for (ref, cell), n in self.counts.items():
            places.setdefault((ref, cell // 4), [0, 0, 0, 0])[cell % 4] = n
        columns = [[k[0] for k in places], [k[1] for k in places], *([v[j] for v in places.values()] for j in range(4))]
        yield pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("ref_id", "pos", *"acgt"), columns, strict=True)})


class AlignTable:
    """(id, score, aligned_query, aligned_target) of the rows (id long, query, target), by the default scores."""

    def eval(self, batch: pa.RecordBatch):
        pairs = [tuple("".join(x if x in "ACGT" else "N" for x in (t or "").upper()) for t in pair) for pair in zip(batch.column("query").to_pylist(), batch.column("target").to_pylist(), strict=True)]
        found = align.local_alignments(pairs, *align.SCORES)
        yield pa.table({"id": batch.column("id").cast(pa.int64()), "score": pa.array([f[0] for f in found], pa.float64()), "aligned_query": pa.array([f[1] for f in found]), "aligned_target": pa.array([f[2] for f in found])})


FUNCTIONS = {
    "kmer_table": (KmerTable, "code long, n long"),
    "pileup_table": (PileupTable, "ref_id long, pos long, a long, c long, g long, t long"),
    "align_table": (AlignTable, "id long, score double, aligned_query string, aligned_target string"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the table functions for this session; their names."""
    for name, (handler, schema) in FUNCTIONS.items():
        spark.udtf.register(name, F.arrow_udtf(handler, returnType=schema))
    return list(FUNCTIONS)
