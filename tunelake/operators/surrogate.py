"""Throughput surrogate on MLlib: features, forests, validation, persistence, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.catalog import Knob
from tunelake.constants import METRIC_NAMES, N_FOLDS, RUN_LIMIT, SEED
from tunelake.functions.scaling import denormalize, negative_cost, ratio
from tunelake.operators.evaluate import r2
from tunelake.operators.forest_batches import with_forest_votes
from tunelake.operators.forest_growth import ForestGrower
from tunelake.operators.history import best_of, value_range
from tunelake.operators.skew import hash_order, matched
from tunelake.operators.splits import with_folds, workload_folds
from tunelake.session import written

# Deepest trees MLlib grows; the usual default of forests elsewhere has no limit.
MAX_DEPTH = 30
# Labelled rows that a fit of a validation learns from at most.
FIT_ROWS = 100_000


def feature_array(catalog: Sequence[Knob]) -> Column:
    """Normalised knobs in catalog order followed by the 14 counters.

    Knobs without a range are left out, for training and prediction alike.
    """
    knobs = [
        F.expr(f"(cast(`{k.knob}` AS double) - {k.min!r}D) / {k.max - k.min!r}D")
        for k in catalog
        if k.max != k.min
    ]
    return F.concat(F.array(*knobs), F.col("inner_metrics"))


def assemble_features(samples: DataFrame, catalog: Sequence[Knob]) -> DataFrame:
    """Samples with complete counters and their `features` array."""
    ready = samples.filter(F.size("inner_metrics") == len(METRIC_NAMES))
    return ready.withColumn("features", feature_array(catalog))


def training_rows(samples: DataFrame, catalog: Sequence[Knob]) -> DataFrame:
    """(workload, config_id, throughput, features vector), the input of all fits."""
    rows = assemble_features(samples, catalog)
    return rows.select(
        "workload",
        "config_id",
        F.col("y")[0].alias("throughput"),
        array_to_vector(F.col("features")).alias("features"),
    )


def random_forest(trees: int = 100, depth: int = MAX_DEPTH, seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="scaled", predictionCol="forest",
        numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024,
    )


def grown_forest(trees: int = 100, depth: int = MAX_DEPTH, seed: int = SEED) -> ForestGrower:
    """The forest of `random_forest`, grown in tasks, for fits on more rows than MLlib's forest ends with."""
    return ForestGrower(random_forest(trees, depth, seed))


def boosted_trees(rounds: int = 100, depth: int = 3, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="scaled", predictionCol="boosted",
        maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, maxMemoryInMB=1024,
    )


def predicted(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` with the model's prediction; a forest takes them in batches, which gives the same values."""
    return with_forest_votes(rows, model) if isinstance(model, RandomForestRegressionModel) else model.transform(rows)


def voted(rows: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Adds `prediction`, the unweighted mean of the models' predictions."""
    out = rows
    for model in models:
        out = predicted(out, model)
    total = F.lit(0.0)
    for model in models:
        total = total + F.col(model.getPredictionCol())
    return out.withColumn("prediction", total / len(models))


def with_scale(rows: DataFrame, lo: float, hi: float) -> DataFrame:
    """Adds `scaled`, the position of the throughput between the limits; null on a flat scale."""
    return rows.withColumn("scaled", ratio(F.col("throughput") - lo, F.lit(hi) - lo))


def labelled_sample(rows: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """At most `most` rows for a fit, those with the smallest hashed keys; what is predicted is never cut."""
    order = hash_order(F.col("workload"), F.col("config_id"))
    return rows.withColumn("_draw", order).orderBy("_draw").limit(most).drop("_draw")


def drawn_sample(rows: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """`labelled_sample`, written: a fit reads its rows many times, and each time would look through all of `rows`."""
    return written(labelled_sample(rows, most), "labelled")


def fitted(rows: DataFrame, estimators: Sequence) -> list[Model]:
    return [e.fit(rows) for e in estimators]


def cross_validate(
    rows: DataFrame, estimators: Sequence, n_folds: int = N_FOLDS, train_scale: bool = True, most: int = FIT_ROWS
) -> DataFrame:
    """(fold, n, sse, r2) with whole workloads held out.

    The throughput scale comes from the training workloads of each fold; with
    `train_scale=False` from all of them, which lets held-out values leak into it.
    The folded rows are written once and read by every fit.
    """
    folded = written(with_folds(rows, workload_folds(rows, n_folds), ["config_id"]), "folds")
    scores = None
    for fold in range(n_folds):
        train = folded.filter(F.col("fold") != fold)
        test = folded.filter(F.col("fold") == fold)
        lo, hi = value_range(train if train_scale else folded, "throughput").first()
        models = fitted(drawn_sample(with_scale(train, lo, hi), most), estimators)
        score = r2(voted(with_scale(test, lo, hi), models), "scaled", "prediction").select(
            F.lit(fold).alias("fold"), "n", "sse", "r2"
        )
        scores = score if scores is None else scores.union(score)
    return scores


def repeated_holdout(
    samples: DataFrame,
    holdouts: Sequence[DataFrame],
    estimators: Sequence,
    positive_only: bool = False,
    most: int = FIT_ROWS,
) -> tuple[DataFrame, list[Model]]:
    """(repeat, n, sse, r2) over given sets of held-out workloads, and the models of the best repeat.

    `samples` carry `scaled` per workload. All scores are kept; `positive_only`
    drops scores that are not above 0, which biases the mean upwards. A hold-out is a
    top-k of a few workload names, which is why it may be broadcast.
    """
    rows = written(samples, "holdout")
    scores, best, models = None, None, []
    for held in holdouts:
        train = rows.join(F.broadcast(held), "workload", "left_anti")
        test = rows.join(F.broadcast(held), "workload")
        own = fitted(drawn_sample(train, most), estimators)
        score = r2(voted(test, own), "scaled", "prediction", ["repeat"])
        found = score.agg(F.max("r2")).first()[0]
        if not models or (found is not None and (best is None or found > best)):
            best, models = found, own
        scores = score if scores is None else scores.unionByName(score)
    return scores.filter(F.col("r2") > 0) if positive_only else scores, models


MODEL_KINDS = {"forest": RandomForestRegressionModel, "boosted": GBTRegressionModel}


def save_surrogate(models: Sequence[Model], lo: float, hi: float, path: str, spark: SparkSession) -> None:
    """Models below `path`, and one row with the throughput range next to them."""
    for model in models:
        model.write().overwrite().save(f"{path}/{model.getPredictionCol()}")
    names = [m.getPredictionCol() for m in models]
    spark.createDataFrame([(names, lo, hi)], "models array<string>, lo double, hi double").write.mode(
        "overwrite"
    ).json(f"{path}/params")


def load_surrogate(path: str, spark: SparkSession) -> tuple[list[Model], float | None, float | None]:
    """Saved models with their range; a lone saved forest without a range is accepted too."""
    try:
        row = spark.read.schema("models array<string>, lo double, hi double").json(f"{path}/params").first()
    except AnalysisException:  # there is no such folder
        return [RandomForestRegressionModel.load(path)], None, None
    return [MODEL_KINDS[n].load(f"{path}/{n}") for n in row.models], row.lo, row.hi


def predict_cost(rows: DataFrame, models: Sequence[Model], lo: float | None, hi: float | None) -> DataFrame:
    """Adds `predicted_cost`: prediction on the throughput scale, as a negative cost."""
    out = voted(rows, models)
    value = F.col("prediction")
    if lo is not None and hi is not None:
        value = denormalize(value, F.lit(lo), F.lit(hi))
    return out.withColumn("predicted_cost", negative_cost(value))


def uniform_draw(key: str, i: int) -> str:
    """SQL text of draw i in [0, 1) of a string column: 32 bits of an md5 text, four draws each."""
    digits = f"substring(md5(concat({key}, ':{i // 4}')), {1 + 8 * (i % 4)}, 8)"
    return f"cast(conv({digits}, 16, 10) AS double) / 4294967296.0D"


def drawn_knobs(key: str, catalog: Sequence[Knob]) -> list[Column]:
    """One value per knob, spread over its range by the draws of a string column.

    All of them in the one method that whole-stage code makes are more than the JVM compiles. The
    first goes through a higher-order function, which has no such code, so Spark splits the projection.
    """
    out = []
    for i, knob in enumerate(catalog):
        value = f"{uniform_draw(key, i)} * {knob.max - knob.min!r}D + {knob.min!r}D"
        if knob.type == "integer":
            value = f"cast(cast({value} AS bigint) AS double)"
        if i == 0:
            value = f"get(transform(array({value}), v -> v), 0)"
        out.append(F.expr(value).alias(knob.knob))
    return out


def candidates(metrics: DataFrame, catalog: Sequence[Knob], n: int = RUN_LIMIT, seed: int = SEED) -> DataFrame:
    """n candidate configurations for each workload row, drawn within the row."""
    numbered = metrics.withColumn("run_ord", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keyed = numbered.withColumn("config_id", hash_order(F.lit(seed), F.col("workload"), F.col("run_ord")))
    return keyed.select(
        "workload", "run_ord", "config_id", "inner_metrics", *drawn_knobs("config_id", catalog)
    )


def score_candidates(
    candidate_rows: DataFrame, catalog: Sequence[Knob], models: Sequence[Model], lo: float, hi: float
) -> DataFrame:
    """Candidates with their predicted cost."""
    rows = assemble_features(candidate_rows, catalog).withColumn(
        "features", array_to_vector(F.col("features"))
    )
    return predict_cost(rows, models, lo, hi).withColumnRenamed("predicted_cost", "cost")


def best_candidates(scored: DataFrame) -> DataFrame:
    """Best predicted candidate of every workload."""
    narrow = scored.select("workload", "config_id", "cost", "run_ord")
    return best_of(narrow, ["workload"], "cost", "run_ord").select("workload", "config_id", "cost")


def group_mean_folds(rows: DataFrame, folds: DataFrame, group: str, y: str, spread_by: list[str]) -> DataFrame:
    """(fold, n, sse, r2) of predicting the training mean of `group` with workloads held out.

    All folds come from one pass over the rows: number, mean and variance per (fold, group).
    The training sums of a fold are the totals minus its own, and a group that only the fold
    has is predicted by the mean of all training rows. Squares are taken of differences from
    means, so large values lose nothing.
    """
    folded = with_folds(rows, folds, spread_by)
    cells = folded.groupBy("fold", group).agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    ).filter("n > 0")
    cells = written(cells, "cells")  # a row per fold and group, which all that follows reads
    total = F.sum(F.col("n") * F.col("m"))
    groups = cells.groupBy(group).agg(F.sum("n").alias("n_group"), total.alias("s_group"))
    own = cells.groupBy("fold").agg(F.sum("n").alias("n_fold"), total.alias("s_fold"))
    everything = cells.agg(F.sum("n").alias("n_all"), total.alias("s_all"))
    own = own.join(F.broadcast(everything))  # one row
    rest = ratio(F.col("s_all") - F.col("s_fold"), F.col("n_all") - F.col("n_fold"))
    known = ratio(F.col("s_group") - F.col("n") * F.col("m"), F.col("n_group") - F.col("n"))
    scored = matched(cells, groups, [group], "inner").join(own, "fold").withColumn("p", F.coalesce(known, rest))
    centre = F.col("s_fold") / F.col("n_fold")
    sse = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("p")) * (F.col("m") - F.col("p"))))
    sst = F.sum(F.col("n") * (F.col("v") + (F.col("m") - centre) * (F.col("m") - centre)))
    return scored.groupBy("fold").agg(F.sum("n").alias("n"), sse.alias("sse"), sst.alias("_sst")).select(
        "fold", "n", "sse", (1 - ratio(F.col("sse"), F.col("_sst"))).alias("r2")
    )
