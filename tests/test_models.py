"""Surrogate fits on small frames: invariants rather than scores."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tunelake.catalog import Knob
from tunelake.operators import evaluate as ev
from tunelake.operators import history as hi
from tunelake.operators import splits as sp
from tunelake.operators import surrogate as su
from tunelake.operators.pipeline_stages import CostScale, surrogate_pipeline
from tunelake.plans import models as plans

CATALOG = [Knob("a", "real", 0.0, 1.0, 0.5), Knob("b", "integer", 0.0, 100.0, 1.0), Knob("c", "integer", 2.0, 2.0, 2.0)]


@pytest.fixture(scope="module")
def samples(spark):
    """Throughput is a clear function of knob a, the same in all workloads."""
    i = F.col("id")
    y = 100 + 50 * F.col("a")
    return (
        spark.range(600)
        .select(
            F.concat(F.lit("w"), (i % 20).cast("string")).alias("workload"),
            i.cast("string").alias("config_id"),
            ((i * 7919) % 101 / 100).alias("a"),
            ((i * 31) % 100).cast("double").alias("b"),
            F.lit(2.0).alias("c"),
            F.array(*[(i % 20).cast("double")] * 14).alias("inner_metrics"),
        )
        .withColumn("y", F.array(y, 1 / y))
    )


def test_features_follow_the_catalog(samples):
    row = su.assemble_features(samples, CATALOG).filter("config_id = '3'").first()
    assert row.features == pytest.approx([row.a, row.b / 100] + [3.0] * 14)


def test_incomplete_counters_are_left_out(samples):
    short = samples.withColumn("inner_metrics", F.slice("inner_metrics", 1, 13))
    assert su.assemble_features(short, CATALOG).count() == 0


def test_forest_learns_and_folds_are_disjoint(samples):
    rows = su.training_rows(samples, CATALOG)
    scores = su.cross_validate(rows, [su.random_forest(trees=10, depth=6)], n_folds=4)
    got = scores.collect()
    assert [r.fold for r in got] == [0, 1, 2, 3]
    assert sum(r.n for r in got) == 600
    assert ev.score_summary(scores).first().mean > 0.8


def test_holdout_scores(samples):
    rows = su.training_rows(samples, CATALOG)
    scaled = hi.scale_by_workload(rows, "throughput", ["config_id"])
    holdouts = [sp.holdout_workloads(rows, r, 5) for r in range(2)]
    got, models = su.repeated_holdout(scaled, holdouts, [su.random_forest(trees=10, depth=6), su.boosted_trees(rounds=5)])
    assert len(models) == 2
    assert {r.repeat: r.n for r in got.collect()} == {0: 150, 1: 150}
    assert su.repeated_holdout(scaled, holdouts[:1], [su.random_forest(trees=5)], positive_only=True)[0].count() == 1


def test_voting_is_the_mean(samples):
    rows = su.with_scale(su.training_rows(samples, CATALOG), 100.0, 150.0)
    models = su.fitted(rows, [su.random_forest(trees=5, depth=4), su.boosted_trees(rounds=3)])
    off = su.voted(rows, models).filter(F.abs(F.col("prediction") - (F.col("forest") + F.col("boosted")) / 2) > 1e-12)
    assert off.count() == 0


def test_saved_model_predicts_the_same(spark, samples, tmp_path):
    rows = su.with_scale(su.training_rows(samples, CATALOG), 100.0, 150.0)
    models = su.fitted(rows, [su.random_forest(trees=5, depth=4)])
    path = str(tmp_path / "model")
    su.save_surrogate(models, 100.0, 150.0, path, spark)
    loaded, lo, hi_ = su.load_surrogate(path, spark)
    assert (lo, hi_) == (100.0, 150.0)
    a = su.predict_cost(rows, models, 100.0, 150.0).select("config_id", "predicted_cost")
    b = su.predict_cost(rows, loaded, lo, hi_).select("config_id", "predicted_cost")
    assert a.exceptAll(b).count() == 0
    assert a.filter("predicted_cost > 0").count() == 0
    models[0].write().overwrite().save(str(tmp_path / "bare"))
    bare, no_lo, no_hi = su.load_surrogate(str(tmp_path / "bare"), spark)
    assert (no_lo, no_hi) == (None, None) and len(bare) == 1


def test_candidates_stay_in_range_and_best_is_picked(spark):
    metrics = spark.createDataFrame([("w1", [1.0] * 14), ("w2", [2.0] * 14)], "workload string, inner_metrics array<double>")
    drawn = su.candidates(metrics, CATALOG, n=50)
    assert drawn.count() == 100 and drawn.select("config_id").distinct().count() == 100
    assert drawn.filter("a < 0 OR a >= 1 OR b < 0 OR b > 100 OR b <> floor(b) OR c <> 2").count() == 0
    scored = drawn.withColumn("cost", -F.col("a"))
    best = {r.workload: r.cost for r in su.best_candidates(scored).collect()}
    assert best == {r.workload: r.m for r in scored.groupBy("workload").agg(F.min("cost").alias("m")).collect()}


def test_group_mean_folds(spark):
    rows = spark.createDataFrame(
        [("w1", "1", "g", 1.0), ("w1", "2", "g", 3.0), ("w2", "3", "g", 5.0), ("w2", "4", "g", 9.0)],
        "workload string, config_id string, g string, y double",
    )
    folds = spark.createDataFrame([("w1", 0), ("w2", 1)], "workload string, fold int")
    got = {r.fold: r for r in su.group_mean_folds(rows, folds, "g", "y", ["config_id"]).collect()}
    assert got[0].sse == pytest.approx(36 + 16) and got[0].r2 == pytest.approx(1 - 52 / 2)
    assert got[1].sse == pytest.approx(9 + 49)


def test_group_mean_folds_of_groups_in_one_fold(spark):
    rows = spark.createDataFrame(
        [("w1", "1", "g", 1e9), ("w1", "2", "new", 1e9 + 3), ("w2", "3", "g", 1e9 + 1), ("w2", "4", "g", 1e9 + 2)],
        "workload string, config_id string, g string, y double",
    )
    folds = spark.createDataFrame([("w1", 0), ("w2", 1)], "workload string, fold int")
    got = {r.fold: r for r in su.group_mean_folds(rows, folds, "g", "y", ["config_id"]).collect()}
    assert got[0].sse == pytest.approx(1.5**2 + 1.5**2) and got[0].r2 == pytest.approx(1 - 4.5 / 4.5)
    assert got[1].sse == pytest.approx(1 + 4) and got[1].r2 == pytest.approx(1 - 5 / 0.5)


def test_flat_throughput_has_no_scale(samples):
    rows = su.training_rows(samples, CATALOG)
    assert su.with_scale(rows, 5.0, 5.0).filter("scaled IS NOT NULL").count() == 0


def test_saved_pipeline_scores_raw_samples(spark, samples, tmp_path):
    rows = su.training_rows(samples, CATALOG)
    lo, top = hi.value_range(rows, "throughput").first()
    models = su.fitted(su.with_scale(rows, lo, top), [su.random_forest(trees=5, depth=5), su.boosted_trees(rounds=3)])
    surrogate_pipeline(CATALOG, models, lo, top).write().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert loaded.stages[0].knobs() == CATALOG and type(loaded.stages[-1]) is CostScale
    short = samples.limit(1).withColumn("inner_metrics", F.slice("inner_metrics", 1, 3)).withColumn("config_id", F.lit("short"))
    got = {r.config_id: r.predicted_cost for r in loaded.transform(samples.unionByName(short)).collect()}
    assert got == {r.config_id: r.predicted_cost for r in su.predict_cost(rows, models, lo, top).collect()}
    assert "short" not in got and all(v < 0 for v in got.values())


def test_a_constant_model_is_found_out(spark, samples, monkeypatch):
    monkeypatch.setattr(plans, "on_surface", lambda rows: rows.withColumn("throughput", (F.col("throughput") - 100) * 2))
    rows = su.training_rows(samples, CATALOG)
    assert plans.explained(rows, [su.random_forest(trees=5, depth=6)]) > plans.LEAST_R2
    assert plans.explained(rows, [su.random_forest(trees=1, depth=0)]) < 0.1
