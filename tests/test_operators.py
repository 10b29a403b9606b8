"""Splits, records, plan trees, evaluation and features on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from tunelake.catalog import Knob, knob_records
from tunelake.constants import INSTRUCTION_TEXT, SYSTEM_TEXT
from tunelake.operators import evaluate as ev
from tunelake.operators import features as ft
from tunelake.operators import plan_trees as pt
from tunelake.operators import records as rc
from tunelake.operators import splits as sp


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def workloads(spark):
    return spark.createDataFrame([(f"w{i % 23}", str(i)) for i in range(230)], "workload string, config_id string")


def test_hash_split_is_stable_under_repartition(workloads):
    a = as_set(sp.hash_split(workloads, ["config_id"]))
    assert a == as_set(sp.hash_split(workloads.repartition(7), ["config_id"]))
    train = sum(r[-1] == "train" for r in a)
    assert 180 <= train <= 230


def test_exact_split_has_exact_counts(workloads):
    out = sp.exact_split(workloads, ["config_id"])
    assert out.filter("split = 'train'").count() == 207
    assert as_set(out) == as_set(sp.exact_split(workloads.repartition(5), ["config_id"]))


def test_folds_hold_whole_workloads_evenly(workloads):
    folds = sp.workload_folds(workloads).collect()
    assert len({r.workload for r in folds}) == len(folds) == 23
    sizes = [sum(r.fold == f for r in folds) for f in range(10)]
    assert sizes == [3, 3, 3] + [2] * 7
    joined = sp.with_folds(workloads, sp.workload_folds(workloads), ["config_id"])
    assert joined.count() == 230
    assert joined.select("workload", "fold").distinct().count() == 23


def test_fewer_workloads_than_folds(spark):
    few = spark.createDataFrame([("a",), ("b",), ("c",)], "workload string")
    assert sorted(r.fold for r in sp.workload_folds(few).collect()) == [0, 1, 2]


def test_holdout_draws_differ(workloads):
    draws = [frozenset(r.workload for r in sp.holdout_workloads(workloads, i).collect()) for i in range(3)]
    assert all(len(d) == 7 for d in draws) and len(set(draws)) == 3


def test_workload_slice(workloads):
    names = sorted({f"w{i}" for i in range(23)})
    assert as_set(sp.workload_slice(workloads, 3, 6)) == {(names[i], i) for i in (3, 4, 5)}


FILE = "SELECT a, SUM(b) FROM t WHERE a = 1 AND b BETWEEN 2 AND 3 GROUP BY a ORDER BY a;\nwith x as (select 1) select * from x where c or d;\ninsert into t values (1);"


def test_workload_features(spark):
    files = spark.createDataFrame([("f", FILE), ("empty", " \n;; ")], "workload string, text string")
    got = {r.workload: r for r in ft.workload_features(files).collect()}
    f = got["f"]
    assert f.n_statements == 3
    assert f.read_ratio == pytest.approx(1 / 3)
    assert f.group_by_ratio == f.order_by_ratio == f.aggregation_ratio == pytest.approx(1 / 3)
    assert f.avg_predicates == pytest.approx(5 / 3)
    assert got["empty"].n_statements == 0 and got["empty"].read_ratio is None


def test_streams_and_limit(spark):
    files = spark.createDataFrame([("f", ";".join(f"S{i}" for i in range(10)))], "workload string, text string")
    stmts = ft.statements(files)
    assert [r.stream for r in ft.assign_streams(stmts, 3).orderBy("stmt_pos").collect()] == [i % 3 for i in range(10)]
    assert ft.first_statements(stmts, 4).count() == 4


def test_counter_rollup_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, 1, None), ("a", None, None, 2)], "k string, c int, r1 int, r2 int")
    got = ft.counter_rollup(rows, "k", ["c"], ["r1", "r2"], ["c"]).first()
    assert (got.c, got.disk_read_count, got.disk_write_count, got.disk_read_bytes) == (0.0, 3.0, 0.0, 24576.0)


def test_mix_features(spark):
    mixes = spark.createDataFrame([("w", [60, 40])], "workload string, weights array<int>")
    kinds = spark.createDataFrame([(0, [10.0, 1.0, 2.0]), (1, [20.0, 3.0, 4.0])], "pos int, features array<double>")
    got = ft.mix_features(mixes, kinds).first().features
    assert got == pytest.approx([1.8, 2.8, 60.0, 40.0])


def test_replay_throughput(spark):
    done = spark.createDataFrame([("w", float(i), float(i + 1)) for i in range(5)], "workload string, started double, ended double")
    got = ft.replay_throughput(done, 4).first()
    assert (got.qps, got.qps_len0, got.neg_avg_time) == (1.0, 8 / 5, -5 / 8)


PLAN = {
    "Node Type": "Aggregate", "Startup Cost": 0.0, "Total Cost": 2000000.0,
    "Plans": [
        {"Node Type": "Hash Join", "Startup Cost": 10.0, "Total Cost": 1010.0, "Plans": [
            {"Node Type": "Seq Scan", "Startup Cost": 0.0, "Total Cost": 5.0},
            {"Node Type": "Hash", "Startup Cost": 1.0, "Total Cost": 1000.9, "Plans": [
                {"Node Type": "Index Scan", "Startup Cost": 0.0, "Total Cost": 1.0}]},
        ]}
    ] + [{"Node Type": "Leaf", "Startup Cost": 0, "Total Cost": 1} for _ in range(11)],
}
PLAN_TEXT = "aggregate(hash join(seq scan, hash(index scan, 999.9), 1000.0), " + ", ".join(["leaf"] * 11) + ", 2 million)"


def plans(spark):
    rows = [(1, json.dumps(PLAN)), (2, '{"Node Type": "Seq Scan", "Startup Cost": 0, "Total Cost": 7}')]
    return spark.createDataFrame(rows, "plan_id long, text string")


def test_plan_texts_keep_child_order(spark):
    want = {(1, PLAN_TEXT), (2, "seq scan")}
    assert as_set(pt.plan_texts(plans(spark))) == want
    assert as_set(pt.plan_texts_from_nodes(pt.plan_nodes(plans(spark)).repartition(3))) == want


def test_plan_nodes(spark):
    nodes = pt.plan_nodes(plans(spark))
    assert nodes.count() == 17
    deepest = nodes.filter("plan_id = 1").orderBy(F.desc("depth")).first()
    assert (deepest.node_path, deepest.parent_path, deepest.depth, deepest.node_type) == ("0.0.1.0", "0.0.1", 3, "Index Scan")
    root = nodes.filter("plan_id = 2").first()
    assert root.parent_path is None and root.total_cost == 7.0


def test_deep_plan(spark):
    node = {"Node Type": "N", "Startup Cost": 0.0, "Total Cost": 1.0}
    for _ in range(40):
        node = {"Node Type": "N", "Startup Cost": 0.0, "Total Cost": 1.0, "Plans": [node]}
    df = spark.createDataFrame([(1, json.dumps(node))], "plan_id long, text string")
    assert pt.plan_nodes(df).count() == 41
    assert pt.plan_texts(df).first().plan_text == "n(" * 40 + "n" + ", 1.0)" * 40


def test_plans_without_costs_keep_their_children(spark):
    text = '{"Node Type":"Sort","Plans":[{"Node Type":"Seq Scan"},{"Node Type":"Hash","Startup Cost":0,"Total Cost":2,"Plans":[{"Node Type":"A"}]}]}'
    rows = [(1, text), (2, '{"Node Type":"A","Startup Cost":0,"Total Cost":1,"Plans":[]}'), (3, "no plan")]
    df = spark.createDataFrame(rows, "plan_id long, text string")
    got = {r.plan_id: r.plan_text for r in pt.plan_texts(df).collect()}
    assert got == {1: "sort(seq scan, hash(a, 2.0))", 2: "a", 3: None}
    assert pt.plan_nodes(df.withColumn("status", F.lit("F")), ["status"]).filter("status = 'F' AND plan_id = 1").count() == 4


def test_file_plans_skip_entries_without_plan(spark):
    text = json.dumps([{"Plan": {"Plan": PLAN}, "query": "q", "query_id": 1}, {"query": "x"}])
    files = spark.createDataFrame([("f", text)], "workload string, text string")
    assert pt.file_plans(files).first().plans == [PLAN_TEXT]


def test_plan_profile(spark):
    got = {r.node_type: r for r in pt.plan_profile(pt.plan_nodes(plans(spark)), ["plan_id"]).filter("plan_id = 1").collect()}
    assert got["Leaf"].n_nodes == 11
    assert sum(r.cost_share for r in got.values()) == pytest.approx(1.0)


CATALOG = [Knob("a", "integer", 0.0, 100.0, 5.0), Knob("b", "real", 0.0, 1.0, 0.5), Knob("c", "integer", 3.0, 3.0, 3.0)]


def samples(spark):
    rows = [
        (55.0, 0.95, 3.0, None, [float(i) for i in range(14)], "./oltp/ycsb/s1.xml", "1"),
        (None, 2.0, 3.0, 8.5, [1.0], "./oltp/ycsb/s2.xml", "2"),
    ]
    return spark.createDataFrame(rows, "a double, b double, c double, odd double, inner_metrics array<double>, workload string, config_id string")


def test_sample_records(spark):
    got = rc.build_sample_records(samples(spark), CATALOG).collect()
    assert len(got) == 1
    assert got[0].output == json.dumps({"a": "50-60%", "b": "90-100%", "c": "0-10%"}, indent=2)
    assert tuple(got[0].meta) == ("ycsb", "s1")
    assert rc.rejected_metrics(samples(spark)).first().config_id == "2"


def test_label_json_leaves_out_absent_knobs(spark):
    got = rc.with_label_json(samples(spark), CATALOG).filter("config_id = '2'").first()
    assert got.output == json.dumps({"b": "90-100%", "c": "0-10%"}, indent=2)


def test_unknown_knobs_keep_their_number(spark):
    by_name = {k.knob: k for k in CATALOG} | {"b": Knob("b", "real", None, None, None)}
    got = samples(spark).select(rc.best_label_json(["a", "b", "odd"], by_name).alias("x")).collect()
    assert got[1].x == '{\n  "b": 2.0,\n  "odd": 8.5\n}'
    assert got[0].x == '{\n  "a": "50-60%",\n  "b": 0.95\n}'


def test_best_records(spark):
    runs = spark.createDataFrame(
        [("x/y/w.xml", 0, "1", -1.0), ("x/y/w.xml", 1, "2", -3.0), ("x/y/w.xml", 2, "3", 9.0), ("x/y/v.xml", 3, "1", -1.0), ("x/y/u.xml", 4, "77", -1.0)],
        "workload string, run_ord long, config_id string, cost double",
    )
    rows = [("x/y/w.xml", "1", 1.0, 0.0, 3.0), ("x/y/w.xml", "2", 99.0, 1.0, 3.0), ("x/y/v.xml", "2", 1.0, 0.0, 3.0)]
    configs = spark.createDataFrame(rows, "workload string, config_id string, a double, b double, c double")
    metrics = spark.createDataFrame([("x/y/w.xml", [1.0] * 14), ("x/y/u.xml", [1.0] * 14)], "workload string, inner_metrics array<double>")
    got = rc.build_best_records(runs, configs, metrics, ["a", "b", "c"], CATALOG).collect()
    assert len(got) == 1
    assert json.loads(got[0].output) == {"a": "90-100%", "b": "90-100%", "c": "0-10%"}
    assert tuple(got[0].meta) == ("y", "w")


def test_merge_renews_older_records(spark):
    old = spark.createDataFrame([("i", "in", "out")], "instruction string, input string, output string")
    new = spark.createDataFrame([("s", "i2", "in2", "out2")], "system string, instruction string, input string, output string")
    got = {r.input: r for r in rc.merge_records(old, new).collect()}
    assert (got["in"].system, got["in"].instruction) == (SYSTEM_TEXT, INSTRUCTION_TEXT)
    assert got["in2"].instruction == "i2"
    both = rc.merge_and_split(old, new, ["input"], exact=True)
    assert both.filter("split = 'train'").count() == 1


TRUTH = '{"k1": "0-10%", "k2": "10-20%", "k3": "20-30%"}'
ANSWERS = [
    (1, TRUTH, 'ok {"k1": "0-10%", "k2": "20-30%", "k3": "middle"}'),
    (2, TRUTH, '{"k1": "10-20%"}'),
    (3, TRUTH, "{}"),
    (4, TRUTH, "no"),
    (5, "broken", '{"k1": "0-10%"}'),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return ev.parsed_answers(spark.createDataFrame(ANSWERS, "sample long, truth_text string, answer_text string"))


def test_answer_counters(parsed):
    assert tuple(ev.answer_counters(parsed).first()) == (2, 2)


def test_scores(parsed):
    scored = ev.comparable(ev.knob_labels(parsed))
    assert as_set(scored.select("y_true", "y_pred")) == {(0, 0), (1, 2), (0, 1)}
    acc = ev.accuracy(scored).first()
    assert (acc.compared, acc.correct) == (3, 1)
    assert [r.label for r in ev.label_set(scored).collect()] == [0, 1, 2]
    matrix = {r.label: r for r in ev.confusion_matrix(scored).collect()}
    assert set(matrix) == {0, 1, 2}
    assert (matrix[0].pred_0, matrix[0].pred_1, matrix[1].pred_2, matrix[2].pred_2) == (1, 1, 1, 0)
    assert sum(sum(r[1:]) for r in matrix.values()) == acc.compared
    report = {r.label: r for r in ev.label_report(scored).collect()}
    assert (report[0].precision, report[0].recall, report[0].support) == (1.0, 0.5, 2)
    assert (report[2].precision, report[2].recall, report[2].f1, report[2].support) == (0.0, 0.0, 0.0, 0)
    averages = ev.report_averages(ev.label_report(scored)).first()
    assert averages.weighted_recall == pytest.approx(1 / 3) and averages.support == 3


def test_no_pairs(parsed):
    none = ev.comparable(ev.knob_labels(parsed)).filter("sample < 0")
    assert ev.accuracy(none).first().accuracy is None
    assert ev.label_report(none).count() == 0


def test_coverage(spark):
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "knob string")
    cover = ev.key_coverage(keys("abcd"), keys(["b", "c", "x", "b"]), "knob")
    assert as_set(cover) == {("a", "missing"), ("b", "both"), ("c", "both"), ("d", "missing"), ("x", "extra")}
    assert tuple(ev.coverage_summary(cover).first()) == (4, 3, 2, 1, 50.0)


def test_decode_answers(spark):
    catalog = spark.createDataFrame([tuple(k) for k in knob_records()], "knob string, type string, min double, max double, default double")
    labels = spark.createDataFrame(
        [("1", "autovacuum_delay", "00% to 10%"), ("1", "geqo_seed", "90-100%"), ("1", "nope", "0-10%"), ("2", "temp_file_limit", "middle")],
        "response string, knob string, label string",
    )
    got = {r.knob: r for r in ev.decode_answers(labels, catalog).collect()}
    assert set(got) == {"autovacuum_vacuum_cost_delay", "geqo_seed", "temp_file_limit"}
    assert got["autovacuum_vacuum_cost_delay"].value == 4.0
    assert got["geqo_seed"].value == pytest.approx(0.95)
    assert got["temp_file_limit"].rejected and got["temp_file_limit"].value is None
    both = spark.createDataFrame(
        [("1", "autovacuum_vacuum_cost_delay", "50-60%"), ("1", "autovacuum_delay", "00% to 10%")],
        "response string, knob string, label string",
    )
    assert [r.value for r in ev.decode_answers(both, catalog).collect()] == [4.0]


def test_results(spark):
    rows = [("r", "default", -2.0), ("r", "b", -3.0), ("r", "a", 3.0), ("r", "c", -1.0), ("only", "default", -1.0)]
    results = spark.createDataFrame(rows, "run string, name string, qps double")
    best = {r.run: r for r in ev.best_against_default(results).collect()}
    assert (best["r"].best_name, best["r"].gap, best["r"].improvement_pct) == ("a", 1.0, 50.0)
    assert best["only"].best_name is None and best["only"].default_qps == 1.0
    got = {r.name: r.improvement_pct for r in ev.compare_runs(results).collect()}
    assert got == {"a": 50.0, "b": 50.0, "c": -50.0}
    ranks = {r.name: r["rank"] for r in ev.ranked_runs(ev.compare_runs(results)).collect()}
    assert ranks == {"a": 1, "b": 1, "c": 3}


def test_r2(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    assert ev.r2(rows, "y", "p").first().r2 == pytest.approx(0.5)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert ev.r2(flat, "y", "p").first().r2 is None
    scores = spark.createDataFrame([(0.1,), (0.3,)], "r2 double")
    got = ev.score_summary(scores).first()
    assert (got.n_folds, got.mean, got.std) == (2, pytest.approx(0.2), pytest.approx(0.1))
