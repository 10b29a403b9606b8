"""Run histories: joins, filters, best runs, crash caps, scales and traces.

`runs` has the columns workload, run_ord, config_id, cost; cost is negative
throughput and a failed run has a cost >= 0. `configs` has workload, config_id and
the knobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.constants import MIN_SAMPLES
from tunelake.functions.scaling import capped_cost, cost_to_y, ratio
from tunelake.operators.skew import (
    ROWS_PER_SALT,
    checked_broadcast,
    matched,
    running_min,
    salted_join,
    with_group_stats,
)

RUN_KEY = ["workload", "config_id"]


def valid_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("cost") < 0)


def runs_with_config(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs joined with their configuration; runs of an unknown one are dropped.

    Configuration ids count up anew in every history, so the key is (workload,
    config_id). It is unique in `configs`; a configuration that very many runs share
    makes a large partition on the side of the runs only, which adaptive execution splits.
    Spark takes rows parsed from documents for no more than their documents, and would
    collect millions of them for a broadcast; so the join merges.
    """
    return runs.join(configs.hint("merge"), RUN_KEY, "inner")


def runs_with_known_config(runs: DataFrame, configs: DataFrame) -> DataFrame:
    return runs.join(configs.select(*RUN_KEY).hint("merge"), RUN_KEY, "left_semi")


def run_order() -> Column:
    """Sort key of the best run: lowest cost first, the earliest of equal costs."""
    return F.struct("cost", "run_ord")


def best_of(
    rows: DataFrame, keys: list[str], measure: str, order: str, largest: bool = False, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """The row of each key with the smallest (or largest) measure, of equal ones that first in `order`.

    A hash aggregate of fixed width finds the best measure; an aggregate of whole structs
    would sort all rows first. The rows meet it once, hot keys salted, and only those that
    share the best measure of their key are aggregated as structs. `order` is unique within a
    key and measure.
    """
    best = F.max(measure) if largest else F.min(measure)
    found = rows.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    ties = salted_join(rows, found.drop("_n"), keys, [order], "inner", found.drop("_best"), rows_per_salt, null_safe=True)
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), order).alias("_row")
    return ties.filter(F.col(measure).eqNullSafe(F.col("_best"))).groupBy(*keys).agg(first).select(*keys, "_row.*").select(*rows.columns)


def best_runs(runs: DataFrame) -> DataFrame:
    """One row per workload: its best run."""
    return best_of(runs.select("workload", "config_id", "cost", "run_ord"), ["workload"], "cost", "run_ord")


def crash_cap(
    runs: DataFrame, counts: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Adds `capped`: failed runs take the worst valid cost of their workload, or -1.0."""
    worst = F.max(F.when(F.col("cost") < 0, F.col("cost"))).alias("_worst")
    stats = with_group_stats(runs, ["workload"], [worst], ["config_id"], counts, rows_per_salt)
    return stats.withColumn("capped", capped_cost(F.col("cost"), F.col("_worst"))).drop("_worst")


def scale_by_workload(
    samples: DataFrame, value: str, spread_by: list[str], rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Adds `scaled`, the min-max position of `value` in its workload; flat workloads give null."""
    stats = [F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    out = with_group_stats(samples, ["workload"], stats, spread_by, rows_per_salt=rows_per_salt)
    scaled = ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return out.withColumn("scaled", scaled).drop("_lo", "_hi")


def value_range(samples: DataFrame, value: str) -> DataFrame:
    """One row (lo, hi): the global scale of a value."""
    return samples.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def scale_globally(samples: DataFrame, value: str, over: DataFrame | None = None) -> DataFrame:
    """Adds `scaled` on one scale for all workloads, taken from `over` (default: all samples).

    Pass the training rows as `over` to keep held-out values out of the scale.
    """
    limits = value_range(samples if over is None else over, value)
    lo, hi = limits.select("lo").scalar(), limits.select("hi").scalar()
    return samples.withColumn("scaled", ratio(F.col(value) - lo, hi - lo))


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("workload").agg(F.count(F.lit(1)).alias("n_samples"))


def well_sampled(
    samples: DataFrame, spread_by: list[str], min_samples: int = MIN_SAMPLES, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Samples of workloads that have more than `min_samples` of them."""
    size = F.count(F.lit(1)).alias("_size")
    out = with_group_stats(samples, ["workload"], [size], spread_by, rows_per_salt=rows_per_salt)
    return out.filter(F.col("_size") > min_samples).drop("_size")


def with_metrics(
    rows: DataFrame,
    metrics: DataFrame,
    how: str = "inner",
    counts: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Rows (with a config_id) and the counters of their workload, an empty array where absent.

    `metrics` has one row per workload; `rows` may hold a hot workload.
    """
    out = salted_join(rows, metrics, ["workload"], ["config_id"], how, counts, rows_per_salt)
    empty = F.array().cast("array<double>")
    return out.withColumn("inner_metrics", F.coalesce("inner_metrics", empty))


def best_with_metrics(best: DataFrame, metrics: DataFrame) -> DataFrame:
    """Best configurations with counters. Both sides hold one row per workload."""
    return best.join(metrics, "workload", "inner")


def with_limits(values: DataFrame, catalog: DataFrame, how: str) -> DataFrame:
    """Join with a knob catalog: broadcast if its size was checked, else as Spark plans it."""
    return values.join(checked_broadcast(catalog), "knob", how)


def with_catalog(values: DataFrame, catalog: DataFrame, keep_unknown: bool) -> DataFrame:
    """Knob values (…, knob, value) with their limits.

    Unknown knobs pass through with null limits or are dropped.
    """
    return with_limits(values, catalog, "left" if keep_unknown else "inner")


def known_knobs(values: DataFrame, catalog: DataFrame) -> DataFrame:
    return with_limits(values, catalog.select("knob"), "left_semi")


def incumbent_trace(runs: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """Every run with the best cost so far and whether the run improved on all before it."""
    out = running_min(runs, ["workload"], "run_ord", "cost", block_rows)
    first_or_better = F.col("_before").isNull() | (F.col("cost") < F.col("_before"))
    return (
        out.withColumn("best_so_far", F.least("cost", "_before"))
        .withColumn("improved", first_or_better)
        .drop("_before")
    )


def incumbent_changes(runs: DataFrame) -> DataFrame:
    """Per workload: how often a run beat all earlier ones, and the final best cost."""
    beat = F.coalesce(F.col("cost") < F.col("_before"), F.lit(False))
    return (
        running_min(runs, ["workload"], "run_ord", "cost")
        .groupBy("workload")
        .agg(F.sum(beat.cast("long")).alias("inc_changed"), F.min("cost").alias("best_cost"))
    )


def build_samples(runs: DataFrame, configs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One sample per run: configuration, y = [throughput, inverse], counters, workload.

    The cap is taken over runs whose configuration exists, as those are the only
    samples; the counters are optional. One aggregate of the runs with a known
    configuration gives the worst valid cost of each workload; it joins the counters, both
    a row per workload, and then the samples, which were joined with the wide
    configurations once.
    """
    joined = runs_with_config(runs, configs)
    known = runs_with_known_config(runs, configs)
    worst = known.groupBy("workload").agg(F.max(F.when(F.col("cost") < 0, F.col("cost"))).alias("_worst"), F.count(F.lit(1)).alias("_n"))
    about = matched(worst, metrics, ["workload"], "left")
    counts = about.select("workload", "_n")
    out = salted_join(joined, about.drop("_n"), ["workload"], ["config_id"], "inner", counts, null_safe=True)
    empty = F.array().cast("array<double>")
    capped = out.withColumn("y", cost_to_y(capped_cost(F.col("cost"), F.col("_worst")))).withColumn("inner_metrics", F.coalesce("inner_metrics", empty))
    return capped.drop("cost", "_worst")


def union_families(families: dict[str, DataFrame]) -> DataFrame:
    """Rows of all benchmark families, each marked with its family."""
    out = None
    for family, rows in families.items():
        marked = rows.withColumn("benchmark", F.lit(family))
        out = marked if out is None else out.unionByName(marked)
    return out


def with_family(rows: DataFrame, families: list[str]) -> DataFrame:
    """Rows of one table marked with the family whose folder their workload is in; others are dropped."""
    named = F.coalesce(*[F.when(F.contains("workload", F.lit(f"/{f}/")), F.lit(f)) for f in families])
    return rows.withColumn("benchmark", named).filter(F.col("benchmark").isNotNull())


def optimizer_rollup(stats: DataFrame) -> DataFrame:
    """Optimizer statistics per benchmark: runs, evaluations, times, incumbent changes."""
    return stats.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("finished_ta_runs").alias("evaluations"),
        F.avg("wallclock_time_used").alias("avg_wallclock"),
        F.avg("ta_time_used").alias("avg_evaluation"),
        F.sum("inc_changed").alias("inc_changed"),
    )
