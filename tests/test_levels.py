import os

import numpy as np
import pytest
from oracle import TABLES, agree
from pyspark.sql import functions as F
from strandlake.operators import quant
from strandlake.plans import registry

SF = "/root/testdata/sf0.001"


def made(n, levels, seed):
    """y, X, K, Z of individuals that share levels; the last level has none, one effect is fixed by the level."""
    rng = np.random.default_rng(seed)
    own = rng.integers(0, levels - 1, n)
    a = rng.standard_normal((levels, 2 * levels))
    k = a @ a.T / (2 * levels)
    x = np.column_stack([np.ones(n), 50 + 10 * rng.standard_normal(n), own % 3 * 0.1])
    y = x @ [2.0, 0.3, -1.0] + (np.linalg.cholesky(k) @ rng.standard_normal(levels))[own] + 0.7 * rng.standard_normal(n)
    return y, x, k, np.eye(levels)[own], own


def tables(spark, analyses):
    people = [(g, 1000 + i, 5 * int(own[i]), float(y[i]), x[i].tolist()) for g, (y, x, _, _, own) in analyses.items() for i in range(len(y))]
    pairs = [(g, 5 * i, 5 * j, float(v)) for g, (_, _, k, *_) in analyses.items() for (i, j), v in np.ndenumerate(k)]
    return spark.createDataFrame(people, "group string, individual long, level long, y double, x array<double>").repartition(5), spark.createDataFrame(pairs, "group string, i long, j long, value double")


@pytest.mark.parametrize(("kind", "method", "given"), [("gblup", "reml", {}), ("gblup", "reml", {"genetic_variance": 1.2, "residual_variance": 0.64}), ("lmm", "ml", {}), ("lmm", "reml", {})])
def test_levels_equal_the_solver_of_all_individuals(spark, monkeypatch, kind, method, given):
    monkeypatch.setattr(quant, "HELD", 4)
    analyses = {"a": made(90, 12, 1), "b": made(40, 30, 2), "c": made(12, 5, 6)}
    people, related = tables(spark, analyses)
    fits = quant.fit_groups(people, related, method, kind=kind, **given)
    said = {g: [] for g in analyses}
    for r in sorted(quant.fitted(people, fits).collect()):
        said[r.group].append(r.value)
    for r in fits.collect():
        y, x, k, z, _ = analyses[r.group]
        if kind == "lmm":
            want = quant.LinearMixedModel().fit(y, x, k, z, method).result
        else:
            want = quant.genomic_blup(y, x, k, z, **given)
            assert np.allclose([b.reliability for b in r.blup], want["reliability"], atol=1e-6)
        assert r.n_individuals == len(y) and [b.individual for b in r.blup] == [5 * i for i in range(len(k))]
        assert np.allclose([r.genetic_variance, r.residual_variance], [want["genetic_variance"], want["residual_variance"]], rtol=1e-5, atol=1e-7)
        if not given:
            assert r.log_likelihood == pytest.approx(want["log_likelihood"], abs=1e-6)
        assert np.allclose([b.value for b in r.blup], want["u"], atol=1e-6) and np.allclose(said[r.group], want["fitted"], atol=1e-6)


def test_many_individuals_of_few_levels(spark):
    """A covariance of all individuals would be 80 GB."""
    n = 100_000
    people = spark.range(n).select(F.lit("all").alias("group"), F.col("id").alias("individual"), (F.col("id") % 7).alias("level"), (F.col("id") % 7 * 0.5 + F.col("id") % 11).cast("double").alias("y"), F.array(F.lit(1.0)).alias("x"))
    related = spark.range(7).select(F.lit("all").alias("group"), F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("value"))
    fits = quant.fit_groups(people, related, genetic_variance=1.2, residual_variance=0.64)
    r = fits.first()
    i = np.arange(n)
    own = np.array([(i % 7 * 0.5 + i % 11)[i % 7 == k].mean() for k in range(7)])
    size = np.bincount(i % 7)
    w = size / (size * 1.2 + 0.64)
    beta = (w * own).sum() / w.sum()
    assert r.n_individuals == n and r.fixed_effects[0] == pytest.approx(beta, abs=1e-9) and np.allclose([b.value for b in r.blup], 1.2 * w * (own - beta), atol=1e-9)
    assert quant.blup_summary(fits).first().mean_accuracy == pytest.approx(np.sqrt(1.2 * (w - w * w / w.sum())).mean(), abs=1e-9)
    assert quant.fitted(people, fits).count() == n


def test_what_cannot_be_solved(spark):
    people, related = tables(spark, {"a": made(20, 6, 4)})
    with pytest.raises(Exception, match="no row in the relationship"):
        quant.fit_groups(people, related.where("i < 10 AND j < 10")).collect()
    with pytest.raises(Exception, match="without a level"):
        quant.fit_groups(people.withColumn("level", F.nullif("level", F.lit(5))), related).collect()
    with pytest.raises(Exception, match="fixed effects"):
        quant.fit_groups(people.limit(2), related).collect()


def embeddings_in(tmp_path, frame):
    for name in TABLES:
        if name != "embeddings":
            os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    frame.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    return str(tmp_path)


def test_oneway_of_many_individuals(spark, tmp_path):
    """A covariance of all individuals would be 20 GB."""
    rows = spark.range(50_000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 97 / 100).cast("float")).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    sf = embeddings_in(tmp_path, rows)
    agree(registry.queries()["gblup_oneway_fixed"](spark, sf), registry.oracle_sql()["gblup_oneway_fixed"], sf)


def test_best_levels_that_are_equal_when_rounded(spark, tmp_path):
    """Levels 3 and 20 differ by less than what rounding leaves."""
    first = F.when(F.col("id") % 40 == 3, 0.5).when(F.col("id") % 40 == 20, 0.5000001).otherwise(F.col("id") % 40 * 0.01)
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(first.cast("float"), F.lit(1).cast("float")).alias("embedding"), F.lit(3).alias("label"))
    sf = embeddings_in(tmp_path, rows)
    found = registry.queries()["blup_top15"](spark, sf)
    assert [r.level for r in found.orderBy("place").head(2)] == [3, 20]
    agree(found, registry.oracle_sql()["blup_top15"], sf)


def test_predictions_for_many_individuals(spark, tmp_path):
    rows = spark.range(50_000).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 89 / 100).cast("float")).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    sf = embeddings_in(tmp_path, rows)
    agree(registry.queries()["model_predictions"](spark, sf), registry.oracle_sql()["model_predictions"], sf)
