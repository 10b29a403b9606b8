"""Keyed state over restarts: the best run, late runs, idle workloads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tunelake.operators.history import best_runs
from tunelake.streaming.keyed_best import RUN_SCHEMA, STORE, current_best, keep_best_by_key
from tunelake.streaming.samples import run_stream


def test_restarts_late_runs_and_idle_workloads(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    draw = random.Random(3)
    day = dt.datetime(2025, 1, 10)
    rows = [(f"w{draw.randrange(5)}", i, str(i), -float(draw.randrange(20)), day + dt.timedelta(hours=i)) for i in range(60)]
    batches = [rows[20:40], rows[:20], rows[40:] + [("odd", 99, None, None, None), ("w0", 98, "98", -500.0, day - dt.timedelta(days=30))]]
    for batch in batches:
        spark.createDataFrame(batch, RUN_SCHEMA).coalesce(1).write.mode("append").json(source)
        keep_best_by_key(run_stream(spark, source, RUN_SCHEMA), target, state, idle_ms=1).awaitTermination(120)
    keep_best_by_key(run_stream(spark, source, RUN_SCHEMA), target, state).awaitTermination(60)  # nothing new
    got = {r.workload: r for r in current_best(spark, target).collect()}
    every = [r for b in batches for r in b]
    want = best_runs(spark.createDataFrame([r for r in every if r[3] is not None], RUN_SCHEMA)).collect()
    assert {(r.workload, r.config_id, r.cost, r.run_ord) for r in want} == {(r.workload, r.config_id, r.cost, r.run_ord) for r in got.values() if r.cost is not None}
    assert {w: r.n_runs for w, r in got.items()} == {w: sum(r[0] == w for r in every) for w in got}
    assert got["w0"].n_late >= 1 and got["odd"].cost is None and got["odd"].n_late == 0
    assert spark.conf.get(STORE, "").find("RocksDB") < 0

    spark.createDataFrame([("w0", 200, "200", -1.0, day)], RUN_SCHEMA).coalesce(1).write.mode("append").json(source)
    keep_best_by_key(run_stream(spark, source, RUN_SCHEMA), target, state, idle_ms=3_600_000).awaitTermination(120)
    now = {r.workload: r for r in current_best(spark, target).collect()}
    assert not now["w0"].idle and now["w0"].run_ord == 98 and all(now[w].idle for w in now if w != "w0")
    changed = spark.read.parquet(target).filter((F.col("batch") == 3) & ~F.col("idle"))
    assert [r.workload for r in changed.collect()] == ["w0"]  # other workloads were not touched
