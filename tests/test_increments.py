"""Increments against a full build after each of them."""

import random

import pytest

from tunelake.catalog import Knob
from tunelake.operators import history as hi
from tunelake.operators import records as rc
from tunelake.operators.increments import SampleStore, merged_state, run_state

CATALOG = [Knob("a", "integer", 0.0, 10.0, 5.0), Knob("b", "real", 0.0, 1.0, 0.5)]
RUNS, CONFIGS = "workload string, run_ord long, config_id string, cost double", "workload string, config_id string, a double, b double"


def made(n=3, per=60):
    draw = random.Random(12)
    out = []
    for nth in range(n):
        runs, configs = [], []
        for i in range(per):
            workload = draw.choice(["./oltp_workloads/x/late.xml"] if nth == 2 and i < 5 else [f"./oltp_workloads/x/w{k}.xml" for k in range(5)] + ["./oltp_workloads/x/crashing.xml"])
            cost = 7.0 if workload.endswith("crashing.xml") or draw.random() < 0.2 else -float(draw.randrange(1, 30))
            runs.append((workload, nth * per + i, f"{nth}-{i}", cost))
            if draw.random() < 0.85:
                configs.append((workload, f"{nth}-{i}", float(draw.randrange(11)), draw.random()))
        out.append((runs, configs))
    return out


def as_set(df):
    return {str(r.asDict(True)) for r in df.collect()}


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [(f"./oltp_workloads/x/w{k}.xml", [float(k)] * 14) for k in range(4)] + [("./oltp_workloads/x/late.xml", [9.0] * 14)]
    return spark.createDataFrame(rows, "workload string, inner_metrics array<double>")


def test_equals_full_build_after_each_increment(spark, metrics, tmp_path):
    store, all_runs, all_configs = SampleStore(spark, str(tmp_path), CATALOG), [], []
    for nth, (runs, configs) in enumerate(made()):
        new = spark.createDataFrame(runs, RUNS), spark.createDataFrame(configs, CONFIGS)
        assert store.add(f"{nth}", *new, metrics)
        assert not store.add(f"{nth}", *new, metrics)
        all_runs, all_configs = all_runs + runs, all_configs + configs
        every = spark.createDataFrame(all_runs, RUNS), spark.createDataFrame(all_configs, CONFIGS)
        columns = ["workload", "config_id", "run_ord", "y", "inner_metrics", "a", "b"]
        assert as_set(store.samples(metrics).select(columns)) == as_set(hi.build_samples(*every, metrics).select(columns))
        assert as_set(store.best_records()) == as_set(rc.build_best_records(*every, metrics, ["a", "b"], CATALOG))
        best = {r.workload: (r.cost, r.run_ord) for r in hi.best_runs(every[0]).collect()}
        assert {r.workload: (r.cost, r.run_ord) for r in store.state().collect()} == best


def test_broken_off_and_late_increments(spark, metrics, tmp_path):
    store = SampleStore(spark, str(tmp_path), CATALOG)
    (runs, configs), (more, others), _ = made()
    new = spark.createDataFrame(runs, RUNS), spark.createDataFrame(configs, CONFIGS)
    new[0].write.parquet(f"{tmp_path}/state/1")  # broke off before it counted
    assert store.state().count() == 0 and store.best_records().count() == 0
    assert store.add("1", *new, metrics)
    with pytest.raises(ValueError):
        store.add("0", spark.createDataFrame(more, RUNS), spark.createDataFrame(others, CONFIGS), metrics)
    with pytest.raises(ValueError):
        store.add("../x", *new, metrics)


def test_states_merge_in_any_order(spark):
    states = []
    for runs, configs in made():
        states.append(run_state(spark.createDataFrame(runs, RUNS), spark.createDataFrame(configs, CONFIGS)))
    a, b, c = states
    one = as_set(merged_state(states))
    assert as_set(merged_state([merged_state([c, a]), b])) == one and as_set(merged_state([merged_state([b, c]), a])) == one


def test_no_rows(spark, metrics, tmp_path):
    store = SampleStore(spark, str(tmp_path), CATALOG)
    assert store.add("1", spark.createDataFrame([], RUNS), spark.createDataFrame([], CONFIGS), metrics)
    assert store.samples(metrics).collect() == [] and store.best_records().collect() == []
