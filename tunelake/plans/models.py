"""Queries of the throughput surrogate, its validation and scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.catalog import knob_records
from tunelake.functions import scaling as sc
from tunelake.operators import evaluate as ev
from tunelake.operators import history as hi
from tunelake.operators import splits as sp
from tunelake.operators import surrogate as su
from tunelake.operators.pipeline_stages import surrogate_pipeline
from tunelake.plans import standins as st
from tunelake.plans import telemetry as tl
from tunelake.plans.tables import table
from tunelake.session import scratch_path, written

# Labelled rows of each fit but those of m4_voting, which learns from all; predictions and scores are of all rows.
QUERY_ROWS = 300

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows, written once: every fit reads them many times."""
    rows = su.training_rows(tl.samples(spark, sf_dir), knob_records())
    return written(rows, "training")


def scaled_training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float, float]:
    rows = training(spark, sf_dir)
    lo, hi_ = hi.value_range(rows, "throughput").first()
    return su.with_scale(rows, lo, hi_), lo, hi_


# The known surface: knobs and their part of the throughput.
SURFACE = {"work_mem": 0.8, "geqo_seed": 0.2}
# What a model must explain of rows that it has not seen; a constant explains 0 or less.
LEAST_R2 = 0.5


def on_surface(rows: DataFrame) -> DataFrame:
    """Training rows whose throughput is a known function of two knobs, so that learning can be told from guessing."""
    places = [k.knob for k in knob_records() if k.max != k.min]
    value = sum((vector_to_array("features")[places.index(k)] * part for k, part in SURFACE.items()), F.lit(0.0))
    return rows.withColumn("throughput", value * 100)


def explained(rows: DataFrame, estimators: list) -> float:
    """R² of the models' vote over the rows that they did not learn from."""
    labelled = su.with_scale(on_surface(rows), 0.0, 100.0)
    sample = su.drawn_sample(labelled, QUERY_ROWS)
    rest = labelled.join(sample.select("workload", "config_id"), ["workload", "config_id"], "left_anti")
    return ev.r2(su.voted(rest, su.fitted(sample, estimators)), "scaled", "prediction").first()["r2"]


_SQL_KNOB_SUM = " + ".join(
    f"({k.knob} - {k.min:.1f}::DOUBLE) / {k.max - k.min:.1f}::DOUBLE" for k in knob_records()
)


@query("m1_features", st.with_views(["runs", "configs", "metrics"], f"""
SELECT workload, config_id, 58 AS n_features, round({_SQL_KNOB_SUM}, 6) AS knob_sum, list_sum(inner_metrics) AS metric_sum
FROM runs JOIN configs USING (config_id) JOIN metrics USING (workload)"""))
def m1_features(spark, sf_dir):
    rows = su.assemble_features(tl.samples(spark, sf_dir), knob_records())

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    return rows.select(
        "workload", "config_id", F.size("features").alias("n_features"),
        F.round(total(F.slice("features", 1, 44)), 6).alias("knob_sum"),
        total(F.slice("features", 45, 14)).alias("metric_sum"),
    )


_SQL_SAMPLED = st.with_views(["runs", "configs", "metrics"], """, sampled AS (SELECT workload, config_id FROM runs JOIN configs USING (config_id) JOIN metrics USING (workload))
""")


def _per_workload(rows, name, condition):
    """Predictions of each workload and whether a property holds for all of them."""
    return rows.groupBy("workload").agg(F.count(F.lit(1)).alias("n"), F.every(condition).alias(name))


@query("m2_forest", _SQL_SAMPLED + "SELECT workload, count(*) AS n, true AS in_range, true AS learned FROM sampled GROUP BY workload")
def m2_forest(spark, sf_dir):
    """100 trees; a forest predicts means of its labels, so nothing outside their range, and finds a known surface."""
    rows, _, _ = scaled_training(spark, sf_dir)
    model = su.random_forest().fit(su.drawn_sample(rows, QUERY_ROWS))
    learned = explained(rows, [su.random_forest()]) > LEAST_R2
    return _per_workload(su.predicted(rows, model), "in_range", F.col("forest").between(0, 1)).withColumn("learned", F.lit(learned))


@query("m3_boosted", _SQL_SAMPLED + "SELECT workload, count(*) AS n, true AS predicted, true AS learned FROM sampled GROUP BY workload")
def m3_boosted(spark, sf_dir):
    """100 rounds; every sample gets a number, and a known surface is found."""
    rows, _, _ = scaled_training(spark, sf_dir)
    model = su.boosted_trees().fit(su.drawn_sample(rows, QUERY_ROWS))
    learned = explained(rows, [su.boosted_trees()]) > LEAST_R2
    return _per_workload(su.predicted(rows, model), "predicted", F.col("boosted").isNotNull() & ~F.isnan("boosted")).withColumn("learned", F.lit(learned))


@query("m4_voting", _SQL_SAMPLED + "SELECT workload, count(*) AS n, true AS is_mean FROM sampled GROUP BY workload")
def m4_voting(spark, sf_dir):
    """500 trees and 100 rounds, both learned from all rows, vote with equal weight."""
    rows, _, _ = scaled_training(spark, sf_dir)
    models = su.fitted(rows, [su.grown_forest(trees=500), su.boosted_trees()])
    mean = (F.col("forest") + F.col("boosted")) / 2
    return _per_workload(su.voted(rows, models), "is_mean", F.abs(F.col("prediction") - mean) < 1e-12)


@query("m5_forest_cv", _SQL_SAMPLED + """, hashed AS (SELECT workload, md5(workload || ':42') AS h FROM (SELECT DISTINCT workload FROM sampled)),
folds AS (SELECT workload, CAST(ntile(10) OVER (ORDER BY h) - 1 AS INTEGER) AS fold FROM hashed)
SELECT fold, count(*) AS n, true AS learned FROM sampled JOIN folds USING (workload) GROUP BY fold""")
def m5_forest_cv(spark, sf_dir):
    """Whole workloads held out: each fold's forest must explain a known surface on workloads it has not seen."""
    scores = su.cross_validate(on_surface(training(spark, sf_dir)), [su.random_forest()], most=QUERY_ROWS)
    return scores.select("fold", "n", (F.col("r2") > LEAST_R2).alias("learned"))


_SQL_CV = f"""{tl._SQL_CAPPED},
r AS (SELECT workload, event_type, -capped AS y FROM events JOIN capped ON event_id = run_ord),
{tl._SQL_FOLDS},
f AS (SELECT event_type, fold, y FROM r JOIN folds USING (workload)),
cells AS (SELECT fold, event_type, count(*) AS n, sum(y) AS s FROM f GROUP BY ALL),
rest AS (SELECT c.fold, (t.s - sum(c.s)) / (t.n - sum(c.n)) AS m FROM cells c, (SELECT sum(n) AS n, sum(s) AS s FROM cells) t GROUP BY c.fold, t.n, t.s),
means AS (SELECT c.fold, c.event_type, coalesce((t.s - c.s) / nullif(t.n - c.n, 0), rest.m) AS p FROM cells c JOIN rest USING (fold)
  JOIN (SELECT event_type, sum(n) AS n, sum(s) AS s FROM cells GROUP BY event_type) t USING (event_type)),
scores AS (SELECT fold, count(*) AS n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM f JOIN means USING (fold, event_type) GROUP BY fold)"""


def _group_mean_scores(spark, sf_dir):
    capped = hi.crash_cap(st.runs(spark, sf_dir, "event_type"))
    rows = capped.select("workload", "config_id", "event_type", (-F.col("capped")).alias("y"))
    return su.group_mean_folds(rows, sp.workload_folds(st.runs(spark, sf_dir)), "event_type", "y", ["config_id"])


@query("m5_group_mean_cv", st.with_views(["runs"], f", {_SQL_CV} SELECT fold, n, round(r2, 6) AS r2 FROM scores"))
def m5_group_mean_cv(spark, sf_dir):
    return _group_mean_scores(spark, sf_dir).select("fold", "n", F.round("r2", 6).alias("r2"))


@query("a13_cv_summary", st.with_views(["runs"], f", {_SQL_CV} SELECT count(r2) AS n_folds, round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std FROM scores"))
def a13_cv_summary(spark, sf_dir):
    out = ev.score_summary(_group_mean_scores(spark, sf_dir))
    return out.select("n_folds", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


HOLDOUTS = 10


@query("m6_repeated_holdout", _SQL_SAMPLED + f""", names AS (SELECT DISTINCT workload FROM sampled), draws AS (SELECT unnest(range({HOLDOUTS})) AS repeat),
held AS (SELECT workload, repeat FROM names, draws QUALIFY row_number() OVER (PARTITION BY repeat ORDER BY md5(workload || ':42:' || repeat::VARCHAR)) <= 7),
sizes AS (SELECT workload, count(*) AS size FROM sampled GROUP BY workload HAVING count(*) > {hi.MIN_SAMPLES})
SELECT CAST(repeat AS INTEGER) AS repeat, CAST(sum(size) AS BIGINT) AS n, true AS learned FROM held JOIN sizes USING (workload) GROUP BY repeat""")
def m6_repeated_holdout(spark, sf_dir):
    """Ten hold-outs by the forest on a known surface, scaled per workload."""
    scores, _ = su.repeated_holdout(*_holdouts(spark, sf_dir, HOLDOUTS), [su.random_forest()], most=QUERY_ROWS)
    return scores.select("repeat", "n", (F.col("r2") > LEAST_R2).alias("learned"))


def _holdouts(spark, sf_dir, n):
    rows = on_surface(training(spark, sf_dir))
    scaled = hi.scale_by_workload(hi.well_sampled(rows, ["config_id"]), "throughput", ["config_id"])
    usable = scaled.filter(F.col("scaled").isNotNull())
    return usable, [sp.holdout_workloads(rows, r) for r in range(n)]


def _saved_surrogate(spark, sf_dir):
    rows, lo, top = scaled_training(spark, sf_dir)
    path = scratch_path(spark, "surrogate")
    fitted = su.fitted(su.drawn_sample(rows, QUERY_ROWS), [su.random_forest()])
    su.save_surrogate(fitted, lo, top, path, spark)
    return rows, fitted, su.load_surrogate(path, spark)


@query("m7_saved_predictions", _SQL_SAMPLED + "SELECT workload, count(*) AS n, true AS same FROM sampled GROUP BY workload")
def m7_saved_predictions(spark, sf_dir):
    """A model that was saved and loaded predicts what the fitted one does."""
    rows, fitted, (models, lo, top) = _saved_surrogate(spark, sf_dir)
    first = su.predict_cost(rows, fitted, lo, top).select("workload", "features", F.col("predicted_cost").alias("first")).drop("forest")
    both = su.predict_cost(first, models, lo, top)
    return _per_workload(both, "same", F.col("first") == F.col("predicted_cost"))


@query("m7_pipeline_scores", _SQL_SAMPLED + "SELECT workload, count(*) AS n, true AS same FROM sampled GROUP BY workload")
def m7_pipeline_scores(spark, sf_dir):
    """A pipeline that was saved and loaded scores raw samples as the fitted models score their rows."""
    samples = written(tl.samples(spark, sf_dir), "samples")
    rows = su.training_rows(samples, knob_records())
    lo, top = hi.value_range(rows, "throughput").first()
    models = su.fitted(su.drawn_sample(su.with_scale(rows, lo, top), QUERY_ROWS), [su.random_forest(), su.boosted_trees(rounds=10)])
    path = scratch_path(spark, "pipeline")
    surrogate_pipeline(knob_records(), models, lo, top).write().save(path)
    scored = PipelineModel.load(path).transform(samples).select("workload", "config_id", "predicted_cost")
    direct = su.predict_cost(rows, models, lo, top).select("workload", "config_id", F.col("predicted_cost").alias("first"))
    return _per_workload(scored.join(direct, ["workload", "config_id"], "full"), "same", F.col("first").eqNullSafe(F.col("predicted_cost")))


@query("m8_denormalize", """
WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), p AS (SELECT event_id, (value - 50) / 100 AS position FROM events)
SELECT event_id, CASE WHEN position * (hi - lo) + lo > 0 THEN -round(position * (hi - lo) + lo, 6) ELSE round(position * (hi - lo) + lo, 6) END AS cost FROM p, l""")
def m8_denormalize(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    limits = hi.value_range(events, "value")
    lo, top = limits.select("lo").scalar(), limits.select("hi").scalar()
    value = sc.denormalize((F.col("value") - 50) / 100, lo, top)
    return events.select("event_id", F.round(sc.negative_cost(value), 6).alias("cost"))


@query("m9_score_candidates", st.with_views(["all_metrics"], "SELECT workload, 100::BIGINT AS n_candidates, true AS best_is_least FROM metrics"))
def m9_score_candidates(spark, sf_dir):
    """The best of 100 drawn configurations per workload by the surrogate, against all of them."""
    _, _, (models, lo, top) = _saved_surrogate(spark, sf_dir)
    knobs = knob_records()
    drawn = su.candidates(st.metrics(spark, sf_dir, every=True), knobs)
    scored = written(su.score_candidates(drawn, knobs, models, lo, top).select("workload", "config_id", "run_ord", "cost"), "scored")
    best = su.best_candidates(scored).select("workload", F.col("cost").alias("best"))
    compared = scored.join(best, "workload").groupBy("workload")
    return compared.agg(F.count(F.lit(1)).alias("n_candidates"), F.every(F.col("best") <= F.col("cost")).alias("best_is_least"))


def _cost_terms():
    """A known cost surface over three knobs, so that the best pick can be checked."""
    return ["work_mem", "geqo_seed", "wal_buffers"]


@query("m9_best_candidates", st.with_views(["all_metrics"], f""", drawn AS (SELECT workload, i AS run_ord, md5('42:' || workload || ':' || i::VARCHAR) AS config_id FROM metrics, range(100) t(i)),
scored AS (SELECT workload, run_ord, config_id, -(""" + " + ".join(
    f"({st.sql_knob('config_id', i, k)} - {k.min:.1f}::DOUBLE) / {k.max - k.min:.1f}::DOUBLE"
    for i, k in enumerate(knob_records()) if k.knob in _cost_terms()
) + """) AS cost FROM drawn)
SELECT workload, config_id, round(cost, 9) AS cost FROM scored QUALIFY row_number() OVER (PARTITION BY workload ORDER BY cost, run_ord) = 1"""))
def m9_best_candidates(spark, sf_dir):
    knobs = knob_records()
    drawn = su.candidates(st.dealt(st.metrics(spark, sf_dir, every=True), "workload"), knobs)
    by_name = {k.knob: k for k in knobs}
    total = None
    for name in sorted(_cost_terms(), key=lambda n: [k.knob for k in knobs].index(n)):
        k = by_name[name]
        term = sc.normalize_raw(F.col(name), k.min, k.max)
        total = term if total is None else total + term
    scored = drawn.withColumn("cost", -total)
    return su.best_candidates(scored).withColumn("cost", F.round("cost", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
