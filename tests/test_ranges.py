import os

import pyarrow as pa
from strandlake.plans import derive as D
from strandlake.plans import registry, services
from strandlake.sources import splits

SF = "/root/testdata/sf0.001"


def test_short_ranges_become_longer_as_files_grow():
    """A task for each 64 KB of 6 GB's reads was a quarter of a million tasks."""
    for size, many in ((1 << 20, 16), (16 << 30, splits.MOST_RANGES), (256 << 30, 4096)):
        parts = splits.ranges_of([("a.fq", size, 0)], 1 << 16)
        assert len(parts) == many
        assert parts[0].start == 0 and parts[-1].end == size and all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))
    assert len(splits.ranges_of([(f"{k}.fq", 4 << 30, 0) for k in range(4)], 1 << 16)) == splits.MOST_RANGES
    assert len(splits.ranges_of([("a.fq", 1 << 30, 0)])) == 16


def test_reads_are_written_by_all_tasks(spark, monkeypatch):
    """Two tasks wrote all."""
    paths, new = [], services.uploads.new_path
    monkeypatch.setattr(services.uploads, "new_path", lambda s: paths.append(new(s)) or paths[-1])
    found = registry.queries()["fastq_ranges"](spark, SF)
    assert found.count() == D.reads(spark, SF).where("length(sequence) > 0").count()
    assert len([f for f in os.listdir(paths[0].removeprefix("file://")) if f.startswith("part-")]) >= 4


def test_scores_are_those_of_plain_arithmetic(monkeypatch):
    monkeypatch.setattr(D.vector, "CHUNK", 3)
    monkeypatch.setattr(D.vector.chunked, "__defaults__", (3,))
    texts, ids = ["ACGTN", "", "T" * 90, None, "GG", "A"], [7, 8, 1 << 40, 3, -50, None]
    found = D._quality(pa.array(texts), pa.array(ids, pa.int64())).to_pylist()
    sign = lambda x: x % 41 if x >= 0 else -(-x % 41)
    assert found == ["" if n is None else "".join(chr(33 + sign(ord(c) * 7 + 3 * i + n)) for i, c in enumerate(t or "")) for t, n in zip(texts, ids, strict=True)]
