"""Rows that the pipeline's stages must carry whatever they look like: odd column names, repeated ids, nothing at all."""

import sys
import threading
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from pyspark.sql import functions as F
from strandlake.llm import common
from strandlake.llm.simhash import deduplicate

SF = "/root/testdata/sf0.001"
NAMES = ["a.b", "a b", "back`tick", "row", "_text", "k", "c0", "digest", "node"]


@pytest.mark.parametrize("at", range(5))
def test_odd_names_pass_every_stage(spark, at):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, SF)
    if at < 4:
        assert out.columns == odd.columns
        plain = stage(spark, docs, SF)
        assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(NAMES)))}
    else:
        assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert stage(spark, odd.limit(0), SF).collect() == []


def test_two_texts_under_one_id_both_stay(spark):
    text = lambda seed: " ".join(f"{seed}w{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("b")), (0, text("a") + " more"), (3, text("c")), (3, text("c")), (1, text("d")), (4, None), (4, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for order in (F.asc("text"), F.desc("text")):
        got = sorted((r.doc_id, r.text or "") for r in deduplicate(df.orderBy(order)).collect())
        assert got == [(0, text("a") + " more"), (1, text("b")), (1, text("d")), (3, text("c")), (4, "")]


def test_settle_leaves_other_threads_tables(spark):
    other, ready, go = [], threading.Event(), threading.Event()

    def elsewhere():
        ready.wait()
        other.append(common.materialize(spark.range(5)))
        go.set()

    thread = threading.Thread(target=elsewhere)
    thread.start()

    def make():
        on_the_way = common.materialize(spark.range(3))
        ready.set()
        go.wait()
        inner = common.settle(lambda: common.materialize(spark.range(4)))
        return on_the_way.unionByName(inner)

    assert common.settle(make).count() == 7
    thread.join()
    assert other[0].count() == 5
