"""Best run of each workload kept in keyed state, with idle workloads and late runs.

The state store holds one small row per workload: its best run, how many runs it had, the
latest time any of them ended, and whether it is idle. A micro-batch touches the workloads that
have runs in it and no others; what it changes is appended, so nothing is merged again.

A run is late if another one of its workload ended more than `grace` after it. Late runs
count and may be the best run; they are only reported. A timer set for each batch of a
workload marks it idle when nothing came for `idle_ms` of processing time; a run wakes it.
Which runs were read and the state are restored together from the checkpoint, so a restart
counts no run twice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RUN_SCHEMA = "workload string, run_ord long, config_id string, cost double, ended timestamp"
STATE_SCHEMA = "cost double, run_ord long, config_id string, n_runs long, n_late long, newest_us long, idle boolean"
CHANGE_SCHEMA = "workload string, config_id string, cost double, run_ord long, n_runs long, n_late long, idle boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestRun(StatefulProcessor):
    """Merges the runs of a workload into its state and gives out the state when it changed."""

    def __init__(self, grace_us: int, idle_ms: int):
        self.grace_us, self.idle_ms = grace_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("best", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (None, None, None, 0, 0, -(1 << 62), False)
        cost, run_ord, config_id, n_runs, n_late, newest, _ = known
        for runs in rows:
            n_runs += len(runs)
            ended = runs["ended"].astype("datetime64[us]").astype("int64")[runs["ended"].notna()]
            if len(ended):
                newest = max(newest, int(ended.max()))
                n_late += int((ended < newest - self.grace_us).sum())
            valued = runs[runs["cost"].notna()]
            if len(valued):
                first = valued.sort_values(["cost", "run_ord"], kind="stable").iloc[0]
                if cost is None or (first["cost"], first["run_ord"]) < (cost, run_ord):
                    cost, run_ord, config_id = float(first["cost"]), int(first["run_ord"]), first["config_id"]
        self.state.update((cost, run_ord, config_id, n_runs, n_late, newest, False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.change(key, cost, run_ord, config_id, n_runs, n_late, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cost, run_ord, config_id, n_runs, n_late, newest, _ = self.state.get()
        self.state.update((cost, run_ord, config_id, n_runs, n_late, newest, True))
        yield self.change(key, cost, run_ord, config_id, n_runs, n_late, True)

    @staticmethod
    def change(key, cost, run_ord, config_id, n_runs, n_late, idle) -> pd.DataFrame:
        columns = {"workload": "object", "config_id": "object", "cost": "float64", "run_ord": "Int64", "n_runs": "int64", "n_late": "int64", "idle": "bool"}
        return pd.DataFrame([(key[0], config_id, cost, run_ord, n_runs, n_late, idle)], columns=list(columns)).astype(columns)

    def close(self) -> None:
        pass


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting inside the block only; a query keeps what it was started with."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def keep_best_by_key(
    stream: DataFrame, target: str, checkpoint: str, grace: str = "1 day", idle_ms: int = 3_600_000, available_now: bool = True
) -> StreamingQuery:
    """Keeps the best run of every workload of `stream` (RUN_SCHEMA); its changes are appended below `target`.

    A batch that is repeated after a restart overwrites what it wrote.
    """
    spark = stream.sparkSession
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package
    grace_us = int(pd.Timedelta(grace) // pd.Timedelta("1us"))
    changes = stream.groupBy("workload").transformWithStateInPandas(
        statefulProcessor=BestRun(grace_us, idle_ms), outputStructType=CHANGE_SCHEMA, outputMode="Update", timeMode="ProcessingTime"
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = changes.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(append)
    # Timers ask for batches without data for ever, and a run to the end of the input would not end; its timers wait for the next data.
    with setting(spark, STORE, ROCKS_DB), setting(spark, IDLE_BATCHES, str(not available_now).lower()):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_best(spark: SparkSession, target: str) -> DataFrame:
    """The newest state of each workload: its last change, combined map-side."""
    changes = spark.read.schema(CHANGE_SCHEMA + ", batch long").parquet(target)
    # A timer and runs of one batch cannot meet: a workload is idle or not after it.
    newest = F.max_by(F.struct("config_id", "cost", "run_ord", "n_runs", "n_late", "idle"), F.struct("batch", "n_runs", ~F.col("idle")))
    return changes.groupBy("workload").agg(newest.alias("s")).select("workload", "s.*")
