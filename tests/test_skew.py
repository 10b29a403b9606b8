"""Skew helpers against windows and brute force, with salts and blocks forced on small data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunelake.operators import history as hi
from tunelake.operators import skew


@pytest.fixture(scope="module")
def rows():
    """One key owns a third of the rows; costs tie often; some runs crash."""
    rng = random.Random(7)
    out = []
    for i in range(3000):
        workload = "hot" if i % 3 == 0 else f"w{rng.randrange(40)}"
        cost = 5.0 if rng.random() < 0.2 else -float(rng.randrange(1, 50))
        out.append((workload, i, str(i), cost))
    return out + [("crashed", 5000, "5000", 1.0), ("crashed", 5001, "5001", 0.0)]


@pytest.fixture(scope="module")
def runs(spark, rows):
    return spark.createDataFrame(rows, "workload string, run_ord long, config_id string, cost double").repartition(6)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_salted_join_equals_join(spark, runs):
    small = runs.select("workload").distinct().withColumn("tag", F.length("workload")).filter("workload <> 'w3'")
    for how in ("inner", "left"):
        plain = runs.join(small, ["workload"], how)
        salted = skew.salted_join(runs, small, ["workload"], ["config_id"], how, rows_per_salt=50)
        assert as_set(plain.select(*salted.columns)) == as_set(salted)
        assert plain.count() == salted.count()


def test_salted_join_spreads_the_hot_key(spark, runs):
    small = runs.select("workload").distinct()
    plan = skew.salted_join(runs, small, ["workload"], ["config_id"], rows_per_salt=50)
    assert "_salt" in plan._jdf.queryExecution().analyzed().toString()
    hot = skew.key_counts(runs, ["workload"]).filter("_n > 50")
    assert hot.count() > 0


def test_more_hot_keys_than_a_short_list(spark):
    big = spark.range(6000).selectExpr("concat('w', id % 700) AS workload", "id AS config_id")
    small = big.select("workload").distinct().withColumn("tag", F.length("workload"))
    salted = skew.salted_join(big, small, ["workload"], ["config_id"], rows_per_salt=2)
    assert as_set(salted) == as_set(big.join(small, "workload").select(*salted.columns))


@pytest.fixture(scope="module")
def null_runs(spark):
    rows = [("a", 1, "1", -5.0), (None, 2, "2", -3.0), (None, 3, "3", 9.0), ("a", 4, "4", 7.0), (None, 5, "5", -4.0)]
    return spark.createDataFrame(rows, "workload string, run_ord long, config_id string, cost double")


def test_null_workloads_are_a_group(null_runs):
    capped = {r.config_id: r.capped for r in hi.crash_cap(null_runs).collect()}
    assert capped == {"1": -5.0, "2": -3.0, "3": -3.0, "4": -5.0, "5": -4.0}
    trace = {r.run_ord: (r.best_so_far, r.improved) for r in hi.incumbent_trace(null_runs, block_rows=2).collect()}
    assert trace == {1: (-5.0, True), 2: (-3.0, True), 3: (-3.0, False), 4: (-5.0, False), 5: (-4.0, True)}
    assert {(r.workload, r.config_id) for r in hi.best_runs(null_runs).collect()} == {("a", "1"), (None, "5")}
    assert hi.well_sampled(null_runs, ["config_id"], min_samples=2).count() == 3
    scaled = hi.scale_by_workload(null_runs.filter("cost < 0"), "cost", ["config_id"]).filter("workload IS NULL")
    assert {r.config_id: r.scaled for r in scaled.collect()} == {"2": 1.0, "5": 0.0}


def test_foreign_counts_do_not_change_the_result(spark, runs):
    small = runs.select("workload").distinct()
    counts = spark.createDataFrame([("w1", 10**9), ("absent", 10**9)], "workload string, _n long")
    out = skew.salted_join(runs, small, ["workload"], ["config_id"], counts=counts, rows_per_salt=10**8)
    assert as_set(out) == as_set(runs.select(*out.columns))


def test_group_stats_equal_window(runs):
    w = Window.partitionBy("workload")
    want = runs.select("config_id", F.max("cost").over(w).alias("top"), F.count(F.lit(1)).over(w).alias("n"))
    got = skew.with_group_stats(
        runs, ["workload"], [F.max("cost").alias("top"), F.count(F.lit(1)).alias("n")], ["config_id"], rows_per_salt=30
    )
    assert as_set(got.select("config_id", "top", "n")) == as_set(want)


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_running_min_equals_window(runs, block):
    w = Window.partitionBy("workload").orderBy("run_ord").rowsBetween(Window.unboundedPreceding, -1)
    want = runs.select("config_id", F.min("cost").over(w).alias("b"))
    got = skew.running_min(runs, ["workload"], "run_ord", "cost", block)
    assert as_set(got.select("config_id", "_before")) == as_set(want)


def test_hash_rank_is_the_global_order(runs):
    hashed = runs.select("config_id").withColumn("h", F.md5("config_id"))
    want = {(r.config_id, i) for i, r in enumerate(sorted(hashed.collect(), key=lambda r: r.h))}
    assert as_set(skew.hash_rank(hashed, "h").select("config_id", "_rank")) == want


def test_band_join_equals_range_join(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.uniform(-50, 50)) for i in range(300)], "id long, x double")
    bands = [(i, lo := rng.uniform(-60, 50), lo + rng.uniform(0, 30)) for i in range(20)]
    got = skew.band_join(points, spark.createDataFrame(bands, "b long, lo double, hi double"), "x", "lo", "hi", 5.0, ["id"])
    want = {(r.id, b) for r in points.collect() for b, lo, hi_ in bands if lo <= r.x <= hi_}
    pairs = [(r.id, r.b) for r in got.select("id", "b").collect()]
    assert set(pairs) == want and len(pairs) == len(want)


def test_best_runs_take_the_earliest_of_ties(runs, rows):
    want = {}
    for w, o, c, cost in sorted(rows, key=lambda r: (r[3], r[1])):
        want.setdefault(w, (w, c, cost, o))
    assert as_set(hi.best_runs(runs).select("workload", "config_id", "cost", "run_ord")) == set(want.values())


def test_crash_cap(runs, rows):
    worst = {}
    for w, _, _, cost in rows:
        if cost < 0:
            worst[w] = max(cost, worst.get(w, cost))
    want = {(c, worst.get(w, -1.0) if cost >= 0 else cost) for w, _, c, cost in rows}
    got = hi.crash_cap(runs, rows_per_salt=40)
    assert as_set(got.select("config_id", "capped")) == want


def test_incumbent_trace_and_changes(runs, rows):
    best, changes, trace = {}, {}, set()
    for w, o, c, cost in sorted(rows, key=lambda r: r[1]):
        improved = w not in best or cost < best[w]
        changes[w] = changes.get(w, 0) + (w in best and cost < best[w])
        best[w] = min(best.get(w, cost), cost)
        trace.add((w, o, best[w], improved))
    got = hi.incumbent_trace(runs, block_rows=50).select("workload", "run_ord", "best_so_far", "improved")
    assert as_set(got) == trace
    assert as_set(hi.incumbent_changes(runs)) == {(w, n, best[w]) for w, n in changes.items()}


def test_flat_workload_has_no_scale(spark):
    rows = [("a", "1", 5.0), ("a", "2", 5.0), ("b", "3", 1.0), ("b", "4", 3.0)]
    df = spark.createDataFrame(rows, "workload string, config_id string, y double")
    got = hi.scale_by_workload(df, "y", ["config_id"])
    assert as_set(got.select("config_id", "scaled")) == {("1", None), ("2", None), ("3", 0.0), ("4", 1.0)}


def test_global_scale_can_leave_out_held_out_rows(spark):
    df = spark.createDataFrame([("1", 0.0), ("2", 10.0), ("3", 20.0)], "config_id string, y double")
    train = df.filter("y < 15")
    assert as_set(hi.scale_globally(df, "y", train).select("config_id", "scaled")) == {("1", 0.0), ("2", 1.0), ("3", 2.0)}


def test_well_sampled_needs_more_than_the_minimum(spark):
    rows = [("a", str(i)) for i in range(10)] + [("b", str(100 + i)) for i in range(11)]
    df = spark.createDataFrame(rows, "workload string, config_id string")
    got = hi.well_sampled(df, ["config_id"])
    assert {r.workload for r in got.collect()} == {"b"} and got.count() == 11


def test_build_samples(spark):
    runs = spark.createDataFrame(
        [("w", 0, "1", -10.0), ("w", 1, "2", 7.0), ("w", 2, "9", -1.0), ("v", 3, "1", -2.0)],
        "workload string, run_ord long, config_id string, cost double",
    )
    rows = [("w", "1", 1.0), ("w", "2", 2.0), ("v", "1", 3.0), ("v", "9", 4.0)]
    configs = spark.createDataFrame(rows, "workload string, config_id string, work_mem double")
    metrics = spark.createDataFrame([("w", [1.0] * 14)], "workload string, inner_metrics array<double>")
    got = {(r.workload, r.config_id): r for r in hi.build_samples(runs, configs, metrics).collect()}
    assert set(got) == {("w", "1"), ("w", "2"), ("v", "1")}
    assert got["w", "2"].y == [10.0, 0.1]
    assert (got["w", "1"].work_mem, got["v", "1"].work_mem) == (1.0, 3.0)
    assert got["v", "1"].inner_metrics == [] and got["w", "1"].inner_metrics == [1.0] * 14


def test_value_rank_equals_row_number(spark):
    """A million rows, a third of them with one value, and nulls; no window over all rows."""
    rows = spark.range(1_000_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 1000 = 1 THEN NULL ELSE pmod(xxhash64(id), 5000) END AS value")
    ranked = skew.value_rank(rows, [F.col("value"), F.col("id")], partitions=16)
    assert "SinglePartition" not in ranked.drop("_rank")._jdf.queryExecution().executedPlan().toString()
    want = rows.select("id", (F.row_number().over(Window.orderBy("value", "id")) - 1).alias("want"))
    assert ranked.join(want, "id").filter("_rank = want").count() == 1_000_000
    sizes = [r["n"] for r in skew.range_sorted(rows, [F.col("value"), F.col("id")], 16).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 150_000


def test_value_rank_of_no_rows(spark):
    assert skew.value_rank(spark.range(0), [F.col("id")]).collect() == []


@pytest.mark.parametrize("kind", ["double", "long"])
def test_interval_join_equals_brute_force(spark, kind):
    rng = random.Random(5)
    one = (lambda x: float(x)) if kind == "double" else int
    points = [(i, one(rng.choice([rng.uniform(-100, 100), rng.gauss(0, 1e6), 2.0**40, 0, 5]))) for i in range(400)] + [(400, None)]
    bands = []
    for i in range(300):
        low = rng.uniform(-100, 100) if i % 3 else rng.gauss(0, 1e6)
        bands.append((i, one(low), one(low + rng.choice([0, 0, 1e-9, 0.5, 1, 2, 3, 64, 1000, 2**20 + 1, 1e12, -1]))))
    bands += [(300, None, one(1)), (301, one(5), one(5)), (302, one(0), one(2**60))]
    if kind == "double":
        bands += [(303, float("-inf"), 3.0), (304, 4.0, float("inf")), (305, float("nan"), 1.0), (306, 0.0, float("nan")), (307, 2.0**40, 2.0**40 * (1 + 2**-52))]
        points += [(401, float("nan")), (402, float("inf")), (403, 1e300), (404, -1e300)]
    want = {(p, b) for p, x in points for b, lo, hi in bands if None not in (x, lo, hi) and x == x and lo == lo and hi == hi and lo <= x <= hi}
    left = spark.createDataFrame(points, f"p int, x {kind}").repartition(4)
    right = spark.createDataFrame(bands, f"b int, lo {kind}, hi {kind}")
    for rows_per_salt in (10**6, 20):
        got = [tuple(r) for r in skew.interval_join(left, right, "x", "lo", "hi", ["p"], rows_per_salt).select("p", "b").collect()]
        assert set(got) == want and len(got) == len(want)
    assert skew.interval_join(left, right.limit(0), "x", "lo", "hi", ["p"]).collect() == []
