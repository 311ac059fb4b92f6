import random

import pytest
from strandlake.sources import intervals, splits


@pytest.fixture(scope="module")
def genome(tmp_path_factory):
    """Two files: lines of one length, of changing lengths, with blanks, and Windows line ends."""
    rng, folder, want = random.Random(1), tmp_path_factory.mktemp("genome"), {}
    for name, end in (("a.fa", "\n"), ("b.fa", "\r\n")):
        text = ""
        for i in range(12):
            record, bases = f"{name[0]}{i}", "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 59, 60, 61, 700, 3000])))
            widths = [60] if i % 3 else [rng.randrange(1, 80) for _ in range(9)]
            text += f">{record} about it{end}"
            at, k = 0, 0
            while at < len(bases):
                text += (" " if i % 4 == 1 and k == 2 else "") + bases[at : at + widths[k % len(widths)]] + end + (end if k % 7 == 6 and i % 2 else "")
                at, k = at + widths[k % len(widths)], k + 1
            want[record] = bases
        (folder / name).write_text(text, newline="")
    return folder, want


@pytest.mark.parametrize("split", [1, 37, 500, 1 << 20])
def test_runs_cover_every_record(genome, split):
    folder, want = genome
    rows = [r for p in splits.ranges_of(splits.files_of(str(folder)), split) for r in intervals.runs_of(p, 400)]
    names = [f.split()[0] for f in intervals.INDEX.split(", ")]
    got = {}
    for r in (dict(zip(names, row, strict=True)) for row in rows):
        assert r["start"] == len(got.get(r["record_id"], "")) and r["bases"] <= 400
        with open(r["source_file"], "rb") as file:
            got[r["record_id"]] = got.get(r["record_id"], "") + intervals.read_run(file, r, r["start"], r["start"] + r["bases"])[0]
    assert got == {k: v for k, v in want.items() if v}


def test_filters_read_only_their_bytes(spark, genome, tmp_path):
    folder, want = genome
    index = str(tmp_path / "index")
    intervals.build_index(spark, str(folder), index, tile=500, split_bytes=2000)
    lengths = {r.record_id: r.length for r in intervals.record_lengths(spark.read.parquet(index)).collect()}
    assert lengths == {k: len(v) for k, v in want.items() if v}
    long = max(want, key=lambda k: (len(want[k]), k))
    rows = intervals.read_bases(spark, index, 1000, 1100).where(f"record_id = '{long}'").collect()
    assert "".join(r.sequence for r in sorted(rows, key=lambda r: r.start)) == want[long][1000:1100]
    assert sum(r.read_bytes for r in rows) <= 100 + 2 * 60  # the bases and the line ends among them
    whole = intervals.read_bases(spark, index).where(f"record_id = '{long}'")
    assert "record_id" in whole._jdf.queryExecution().toString() and "".join(r.sequence for r in whole.orderBy("start").collect()) == want[long]
    some = intervals.read_bases(spark, index).where(f"record_id = '{long}' AND start < 1000 AND end > 600").orderBy("start").collect()
    assert "".join(r.sequence for r in some)[600 - some[0].start : 400 - some[0].start + 600] == want[long][600:1000]
    assert intervals.read_bases(spark, index).where("record_id = 'none'").rdd.getNumPartitions() <= 1
    everything = {}
    for r in intervals.read_bases(spark, index).orderBy("record_id", "start").collect():
        everything[r.record_id] = everything.get(r.record_id, "") + r.sequence
    assert everything == {k: v for k, v in want.items() if v}


def test_many_intervals(spark, genome, tmp_path):
    folder, want = genome
    rng, index = random.Random(2), str(tmp_path / "index")
    intervals.build_index(spark, str(folder), index, tile=300)
    asked = [(rng.choice([*want, "none"]), a := rng.randrange(-5, 3000), a + rng.randrange(-2, 900), k % 7) for k in range(300)]
    asked += asked[:5]
    df = spark.createDataFrame(asked, "record_id string, start long, end long, `a.b` int")
    got = sorted((r[0], r[1], r[2], r[3], r[4]) for r in intervals.read_intervals(spark, index, df, tile=300).collect())
    expected = sorted((n, a, b, k, want[n][max(a, 0) : max(b, 0)]) for n, a, b, k in asked if n in want and b > 0 and want[n][max(a, 0) : b])
    assert got == expected
