import random

import pytest
from strandlake.sources import grid


def expected(data):
    rows = [[c.strip() for c in r] for r in grid.text_rows(data)]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows))
    return [(k, r + [""] * (width - len(r))) for k, r in enumerate(rows)]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
@pytest.mark.parametrize("several", [False, True])
def test_splits_equal_the_whole_file(spark, tmp_path, small_splits, delimiter, several):
    rng = random.Random(delimiter)
    cells = ["1", " 2.5 ", "", "NA", f'"a{delimiter} b"', '"say ""so"""', 'x"y', "é"] + (['"two\nlines"'] if several else [])
    lines = ["head" + delimiter * 4 + "end"] + [delimiter.join(rng.choice(cells) for _ in range(rng.randrange(1, 6))) + ("\n" if rng.random() < 0.1 else "") for _ in range(400)]
    data = ("﻿" + "\r\n".join(lines) + "\n").encode()
    (tmp_path / "a.csv").write_bytes(data)
    found = grid.load_grid(spark, str(tmp_path / "a.csv"))
    assert [(r.row_idx, r.cells) for r in found.orderBy("row_idx").collect()] == expected(data)
    if not several:
        assert grid.line_cells(spark, str(tmp_path / "a.csv"), delimiter).select("split").distinct().count() > 5


def test_no_rows_and_blanks(spark, tmp_path):
    for name, text in (("e.csv", ""), ("b.csv", "\n \n"), ("c.csv", ",,\n,\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="no rows"):
            grid.load_grid(spark, str(tmp_path / name))
    (tmp_path / "one.tsv").write_text("\n\na\n")
    assert [tuple(r) for r in grid.load_grid(spark, str(tmp_path / "one.tsv")).collect()] == [(0, ["a"])]
