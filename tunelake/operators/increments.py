"""Samples and records that grow by increments of run histories.

What a full build takes from all runs of a workload is a small state that merges: the worst
valid cost (the cap of crashed runs) and the best run. An increment appends its raw samples,
merges its own state into the one before, and renews the best records of the workloads whose
best run changed. Nothing of earlier increments is read but the state, one row per workload.
A sample gets its cap when it is read, so a cap that changes costs nothing before.

Every increment has an id and counts once: its tables are written to folders of their own,
then a record makes them count, as in `sinks.committed`. A repeated or broken-off increment
leaves the result as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.catalog import Knob
from tunelake.constants import BEST_INSTRUCTION
from tunelake.functions.scaling import capped_cost, cost_to_y
from tunelake.functions.text import metrics_json
from tunelake.operators.history import runs_with_config
from tunelake.operators.records import best_label_json, meta_columns
from tunelake.operators.skew import matched, salted_join
from tunelake.sources.sinks import commit, committed

STATE = "workload string, worst double, cost double, run_ord long, config_id string, n_runs long"


def fixed_best() -> Column:
    """The best run as a struct that orders by cost, then by time."""
    return F.struct("cost", "run_ord", "config_id")


def run_state(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """State of some runs: worst valid cost of those with a configuration, best of all, and their number."""
    known = runs.join(configs.select("workload", "config_id").withColumn("_known", F.lit(True)), ["workload", "config_id"], "left")
    valid = F.col("_known") & (F.col("cost") < 0)
    grouped = known.groupBy("workload").agg(F.max(F.when(valid, F.col("cost"))).alias("worst"), F.min(fixed_best()).alias("best"), F.count(F.lit(1)).alias("n_runs"))
    return grouped.select("workload", "worst", "best.*", "n_runs")


def merged_state(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all runs from the states of parts of them, in any order and grouping."""
    every = reduce(DataFrame.unionByName, states)
    grouped = every.groupBy("workload").agg(F.max("worst").alias("worst"), F.min(fixed_best()).alias("best"), F.sum("n_runs").alias("n_runs"))
    return grouped.select("workload", "worst", "best.*", "n_runs")


def changed_best(before: DataFrame, after: DataFrame) -> DataFrame:
    """Workloads of `after` that are new or have another best run."""
    old = before.select("workload", F.col("config_id").alias("_config"), F.col("run_ord").alias("_ord"))
    same = F.col("_config").eqNullSafe(F.col("config_id")) & F.col("_ord").eqNullSafe(F.col("run_ord"))
    return matched(after, old, ["workload"], "left").filter(~same | F.col("_ord").isNull()).drop("_config", "_ord")


class SampleStore:
    """A folder of increments: raw samples, configurations of best runs, states, best records."""

    def __init__(self, spark: SparkSession, path: str, catalog: Sequence[Knob]):
        self.spark, self.path, self.catalog = spark, path.rstrip("/"), list(catalog)
        self.knobs = [k.knob for k in self.catalog]

    def folders(self, table: str) -> list[str]:
        return [f"{self.path}/{table}/{i}" for i in committed(self.spark, self.path)]

    def table(self, name: str, schema: str) -> DataFrame:
        """All committed increments of a table, with their number in order."""
        folders = self.folders(name)
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("_nth", F.lit(0))
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f).withColumn("_nth", F.lit(i)) for i, f in enumerate(folders)])

    def state(self) -> DataFrame:
        """The state after the last increment."""
        folders = self.folders("state")[-1:]
        return self.spark.read.schema(STATE).parquet(*folders) if folders else self.spark.createDataFrame([], STATE)

    def sample_schema(self) -> str:
        return ", ".join(["workload string", "config_id string", "run_ord long", "cost double", *[f"`{k}` double" for k in self.knobs]])

    def add(self, commit_id: str, runs: DataFrame, configs: DataFrame, metrics: DataFrame) -> bool:
        """Adds the runs and configurations of new histories; ids sort in the order of increments. Says whether they were new.

        Configurations belong to runs of the same increment. `metrics` are the counters known
        so far, for the records of workloads whose best run changed.
        """
        done = committed(self.spark, self.path)
        if commit_id in done:
            return False
        if done and commit_id < done[-1]:
            raise ValueError(f"increment {commit_id} would come before {done[-1]}")
        before = self.state()
        runs_with_config(runs, configs).select("workload", "config_id", "run_ord", "cost", *[F.col(k).cast("double") for k in self.knobs]).write.mode("overwrite").parquet(f"{self.path}/samples/{commit_id}")
        merged_state([before, run_state(runs, configs)]).write.mode("overwrite").parquet(f"{self.path}/state/{commit_id}")
        after = self.spark.read.schema(STATE).parquet(f"{self.path}/state/{commit_id}")
        # A changed best run is one of this increment, and so is its configuration.
        best = changed_best(before, after).select("workload", "config_id", "cost", "run_ord")
        # Few configurations are those of changed best runs; they are chosen before their knobs are worked out.
        wanted = configs.join(best.select("workload", "config_id"), ["workload", "config_id"], "left_semi")
        renewed = best.join(wanted, ["workload", "config_id"], "left").join(metrics, "workload", "left")
        known = F.coalesce(*[F.col(k).cast("string") for k in self.knobs]).isNotNull() & F.col("inner_metrics").isNotNull()
        renewed.select(
            "workload",
            known.alias("complete"),
            metrics_json(F.col("inner_metrics")).alias("input"),
            best_label_json(self.knobs, {k.knob: k for k in self.catalog}).alias("output"),
        ).write.mode("overwrite").parquet(f"{self.path}/records/{commit_id}")
        commit(self.spark, self.path, commit_id)
        return True

    def samples(self, metrics: DataFrame) -> DataFrame:
        """What `history.build_samples` gives for all runs added so far."""
        raw = self.table("samples", self.sample_schema()).drop("_nth")
        about = matched(self.state().select("workload", "worst", "n_runs"), metrics, ["workload"], "left")
        counts = about.select("workload", F.col("n_runs").alias("_n"))
        joined = salted_join(raw, about.drop("n_runs"), ["workload"], ["config_id"], "inner", counts, null_safe=True)
        y = cost_to_y(capped_cost(F.col("cost"), F.col("worst")))
        empty = F.array().cast("array<double>")
        return joined.withColumn("y", y).withColumn("inner_metrics", F.coalesce("inner_metrics", empty)).drop("cost", "worst")

    def best_records(self) -> DataFrame:
        """What `records.build_best_records` gives for all runs added so far: the last record of each workload, if complete."""
        every = self.table("records", "workload string, complete boolean, input string, output string")
        # At most one row per workload and increment.
        newest = F.row_number().over(Window.partitionBy("workload").orderBy(F.col("_nth").desc()))
        last = every.withColumn("_n", newest).filter("_n = 1 AND complete")
        return last.select(F.lit(BEST_INSTRUCTION).alias("instruction"), "input", "output", meta_columns(F.col("workload")).alias("meta"))
