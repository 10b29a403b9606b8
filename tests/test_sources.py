"""Readers and writers on files with the edge cases of each format."""

import json

import pytest
from pyspark.sql import functions as F

from tunelake.catalog import knob_records
from tunelake.constants import KNOB_CATALOG_TEXT, METRIC_NAMES, THROUGHPUT_KEY
from tunelake.operators import history as hi
from tunelake.sources import files as src
from tunelake.sources import sinks
from tunelake.streaming.samples import keep_best, latest_best, run_stream


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_knob_catalog(spark, tmp_path):
    doc = {"a": {"min": 1, "max": 10, "type": "integer", "default": 3}, "b": {"min": "0.5", "max": None, "type": "real", "default": "on"}}
    path = put(tmp_path / "k.json", json.dumps(doc, indent=2))
    got = src.read_knob_catalog(spark, path)
    assert as_set(got) == {("a", "integer", 1.0, 10.0, 3.0), ("b", "real", 0.5, None, None)}


def test_config_space_equals_catalog(spark, tmp_path):
    path = put(tmp_path / "configspace.pcs", KNOB_CATALOG_TEXT + "\nnot a knob\n")
    assert src.catalog_records(src.read_config_space(spark, path)) == knob_records()


def history(runs, configs):
    return json.dumps({"data": [[[c, None, 0], [cost, 0.5, "ok"]] for c, cost in runs], "configs": configs}, indent=1)


@pytest.fixture
def history_dir(tmp_path):
    base = tmp_path / "tpcc_data"
    one = {"1": {"work_mem": 5, "geqo_seed": 0.25}, "2": {"work_mem": 7}}
    put(base / "sample_tpcc_config0_smac_output/run_2/runhistory.json", history([(1, -1.0), (2, -2.0), (9, -9.0)], one))
    put(base / "sample_tpcc_config0_smac_output/run_3/runhistory.json", history([(1, -100.0)], one))
    put(base / "sample_tpcc_config0_smac_output/run_1.OLD/runhistory.json", history([(1, -50.0)], one))
    put(base / "sample_tpcc_config1_smac_output/run_1/runhistory.json", history([(1, 2147483647.0)], {"1": {"work_mem": 1}}))
    put(base / "other/run_1/runhistory.json", history([(1, -1.0)], one))
    put(base / "sample_tpcc_config2_smac_output/run_1/stats.json", "{}")
    return str(base)


def test_run_history(spark, history_dir):
    runs, configs = src.read_run_history(spark, history_dir)
    assert as_set(runs) == {
        ("sample_tpcc_config0", 0, "1", -1.0), ("sample_tpcc_config0", 1, "2", -2.0), ("sample_tpcc_config0", 2, "9", -9.0),
        ("sample_tpcc_config1", 0, "1", 2147483647.0),
    }
    wide = src.wide_configs(configs, ["work_mem", "geqo_seed"], ["workload", "config_id"])
    assert ("sample_tpcc_config0", "2", 7.0, None) in as_set(wide)
    metrics = spark.createDataFrame([("sample_tpcc_config0",), ("unused",)], "workload string")
    assert as_set(src.with_both_files(runs, metrics)) == {("sample_tpcc_config0",)}


def test_families(spark, tmp_path, history_dir):
    for folder in ("ycsb_data", "smallbank", "twitter", "wikipedia"):
        put(tmp_path / folder / f"sample_{folder}_config0_smac_output/run_1/runhistory.json", history([(1, -1.0)], {}))
    out = hi.union_families(src.read_families(spark, str(tmp_path)))
    assert {(r.benchmark, r.n) for r in out.groupBy("benchmark").agg(F.count("*").alias("n")).collect()} == {
        ("tpcc", 4), ("ycsb", 1), ("smallbank", 1), ("twitter", 1), ("wikipedia", 1)
    }


def test_internal_metrics_in_both_forms(spark, tmp_path):
    row = [float(i) for i in range(14)]
    put(tmp_path / "m/a_internal_metrics.json", json.dumps(dict(reversed(list(zip(METRIC_NAMES, row)))), indent=4))
    put(tmp_path / "m/b_internal_metrics.json", json.dumps(row, indent=4))
    put(tmp_path / "m/c_internal_metrics.json", json.dumps(row[:5]))
    got = {r.workload: r.inner_metrics for r in src.read_internal_metrics(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": row, "b": row, "c": row[:5]}


def test_samples_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(1.0, [2.0, 0.5], [1.0], "w", "1")], "work_mem double, y array<double>, inner_metrics array<double>, workload string, config_id string")
    sinks.write_samples(rows, path)
    sinks.write_samples(rows, path, append=True)
    back = src.read_samples(spark, path, ["work_mem", "geqo_seed"])
    assert back.count() == 2 and back.first().geqo_seed is None
    sinks.write_samples(rows, path)
    assert src.read_samples(spark, path, ["work_mem"]).count() == 1


def test_statements_by_file(spark, tmp_path):
    put(tmp_path / "wg/tpch_1.wg", "SELECT 1;\nSELECT 2;\n")
    put(tmp_path / "wg/note.txt", "SELECT 3;")
    assert as_set(src.read_statements(spark, str(tmp_path / "wg"))) == {("tpch_1", 0, "SELECT 1;"), ("tpch_1", 1, "SELECT 2;")}


def test_plan_files(spark, tmp_path):
    leaf = {"Node Type": "Seq Scan", "Startup Cost": 0.0, "Total Cost": 1.5}
    put(tmp_path / "p/tpch.json", json.dumps([{"Plan": {"Plan": leaf}, "query": "q1", "query_id": 1}, {"query": "q2"}]))
    got = src.read_plans(spark, str(tmp_path / "p")).collect()
    assert [(r.workload, r.plan_id, r.query) for r in got] == [("tpch", "tpch#0", "q1")]


XML = """<?xml version="1.0"?>
<parameters>

    <!-- Connection details -->
    <type>POSTGRES</type>
    <url>jdbc:postgresql://localhost:5432/db?sslmode=disable&amp;x=1</url>
    <scalefactor>1</scalefactor>
    <terminals>16</terminals>
    <works>
        <work><time>60</time><rate>unlimited</rate><weights>45, 43,4,4,4</weights></work>
    </works>
    <transactiontypes>
        <transactiontype><name>NewOrder</name></transactiontype>
        <transactiontype><name>Payment</name></transactiontype>
    </transactiontypes>
</parameters>
"""


def test_benchmark_xml(spark, tmp_path):
    put(tmp_path / "x/sample_tpcc_config1.xml", XML)
    got = src.read_benchmark_xml(spark, str(tmp_path / "x")).first()
    assert got.workload == "sample_tpcc_config1"
    assert got.url.endswith("sslmode=disable&x=1")
    assert (got.scalefactor, got.terminals, got.time, got.rate) == (1.0, 16, 60, "unlimited")
    assert got.weights == [45, 43, 4, 4, 4]
    assert got.transactions == ["NewOrder", "Payment"]
    second = "<work><time>30</time><rate>10</rate><weights>3,4</weights></work></works>"
    put(tmp_path / "y/sample_tpcc_config2.xml", XML.replace("</works>", second))
    phases = {r.phase: (r.time, r.weights) for r in src.read_benchmark_xml(spark, str(tmp_path / "y")).collect()}
    assert phases == {0: (60, [45, 43, 4, 4, 4]), 1: (30, [3, 4])}


def test_benchmark_summary(spark, tmp_path):
    put(tmp_path / "r/a.summary.json", json.dumps({THROUGHPUT_KEY: 12.5, "x": {"y": 1}}, indent=2))
    put(tmp_path / "r/b.summary.json", "{}")
    put(tmp_path / "r/c.summary.json", '{"cut')
    put(tmp_path / "r/d.json", json.dumps({THROUGHPUT_KEY: 99.0}))
    got = {r.path.split("/")[-1]: r.throughput for r in src.read_benchmark_summary(spark, str(tmp_path / "r")).collect()}
    assert got == {"a.summary.json": 12.5, "b.summary.json": 0.0, "c.summary.json": 0.0}


def test_result_lines(spark, tmp_path):
    path = put(tmp_path / "in.txt", "default:  -1.05\nresponse_1.json: -0.99\n\nno number\nx: y\n")
    got = src.read_result_lines(spark, path).select("name", "qps")
    assert as_set(got.filter("qps IS NULL")) == {("no number", None), ("x", None)}
    got = got.filter("qps IS NOT NULL")
    assert as_set(got) == {("default", -1.05), ("response_1.json", -0.99)}
    sinks.write_result_lines(got, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ["default: -1.05", "response_1.json: -0.99"]


def test_responses_skip_malformed(spark, tmp_path):
    put(tmp_path / "a/response_1.json", '{"work_mem": "30% to 40%",\n "geqo_seed": "middle"}')
    put(tmp_path / "a/response_2.json", '{"work_mem": ')
    put(tmp_path / "a/response_3.json", 'Sure: {"wal_buffers": "0% to 10%"} Done.')
    got = src.read_responses(spark, str(tmp_path / "a")).select("knob", "label")
    assert as_set(got) == {("work_mem", "30% to 40%"), ("geqo_seed", "middle")}


def test_optimizer_stats(spark, tmp_path):
    doc = {"submitted_ta_runs": 100, "finished_ta_runs": 99, "n_configs": 98, "wallclock_time_used": 7.5, "ta_time_used": 7.0, "inc_changed": 2, "_EMA_ALPHA": 0.2}
    for w in (0, 1):
        put(tmp_path / f"tpcc_data/sample_tpcc_config{w}_smac_output/run_1/stats.json", json.dumps(doc))
    got = src.read_optimizer_stats(spark, str(tmp_path))
    assert tuple(got.orderBy("workload").first()) == ("tpcc_data", "sample_tpcc_config0", "run_1", 100, 99, 98, 7.5, 7.0, 2)
    assert tuple(hi.optimizer_rollup(got).first()) == ("tpcc_data", 2, 198, 7.5, 7.0, 4)


def test_run_log_counts_repeated_lines_once(spark, tmp_path):
    line = "[2025-11-07 21:17:21,958:runner.py#L63:INFO]: load tpcc throughput: 1957.0136\n"
    other = "[2025-11-07 21:17:22,000:smbo.py#L172:INFO]: Running initial design\n"
    path = put(tmp_path / "log", line * 2 + other * 2 + "  continued text\n")
    got = {r.line_no: r for r in src.read_run_log(spark, path).collect()}
    assert set(got) == {63, 172}
    assert (got[63].time, got[63].file, got[63].level, got[63].throughput) == ("2025-11-07 21:17:21,958", "runner.py", "INFO", 1957.0136)
    assert got[172].throughput is None


def test_training_records_and_manifest(spark, tmp_path):
    rows = [(str(i), "sys", "ins", "in", "out", "train" if i % 10 else "test") for i in range(50)]
    records = spark.createDataFrame(rows, "key string, system string, instruction string, input string, output string, split string")
    sinks.write_training_records(records, str(tmp_path / "t"))
    back = spark.read.json(str(tmp_path / "t/records"))
    assert back.filter("split = 'test'").count() == 5 and back.count() == 50
    manifest = json.loads(spark.read.text(str(tmp_path / "t/manifest")).first().value)
    assert manifest["db_tuning_train"]["columns"]["response"] == "output"


def test_discover_workloads(spark, tmp_path):
    for name in ("sample_tpcc_config10.xml", "sample_tpcc_config2.xml", "sample_tpcc_config.xml", "sample_ycsb_config1.xml", "ssb_1.wg", "ssb_flat_tiny_1.wg", "tpch_1.wg"):
        put(tmp_path / "w" / name, "x")
    found = lambda kind, b: [r.name for r in src.discover_workloads(spark, str(tmp_path / "w"), kind, b).collect()]
    assert found("oltp", "tpcc") == ["sample_tpcc_config10.xml", "sample_tpcc_config2.xml"]
    assert found("olap", "ssb") == ["ssb_1.wg", "ssb_flat_tiny_1.wg"]


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(f"w{i % 5}", i, str(i), -float((i * 37) % 11)) for i in range(60)]
    runs = spark.createDataFrame(rows, "workload string, run_ord long, config_id string, cost double")
    runs.filter("run_ord < 30").repartition(3).write.json(source)
    for part in ("run_ord >= 30", "run_ord < 10"):
        keep_best(run_stream(spark, source, files_per_trigger=2), target, state).awaitTermination()
        runs.filter(part).coalesce(1).write.mode("append").json(source)
    keep_best(run_stream(spark, source), target, state).awaitTermination()
    want = hi.best_runs(runs).select("workload", "config_id", "cost", "run_ord")
    assert as_set(latest_best(spark, target)) == as_set(want)


def test_history_files_to_sample_records(spark, history_dir, tmp_path):
    """From files to records: ids repeat across workloads, one workload has crashed runs only."""
    from tunelake.operators.records import build_sample_records

    for i in (0, 1):
        put(tmp_path / f"m/sample_tpcc_config{i}_internal_metrics.json", json.dumps([float(i)] * 14))
    knobs = knob_records()
    runs, configs = src.read_run_history(spark, history_dir)
    wide = src.wide_configs(configs, [k.knob for k in knobs], ["workload", "config_id"])
    samples = hi.build_samples(runs, wide, src.read_internal_metrics(spark, str(tmp_path / "m")))
    got = {(r.workload, r.config_id): r.y for r in samples.collect()}
    assert got == {
        ("sample_tpcc_config0", "1"): [1.0, 1.0],
        ("sample_tpcc_config0", "2"): [2.0, 0.5],
        ("sample_tpcc_config1", "1"): [1.0, 1.0],
    }
    outputs = [json.loads(r.output) for r in build_sample_records(samples, knobs).collect()]
    assert {tuple(sorted(o)) for o in outputs} == {("geqo_seed", "work_mem"), ("work_mem",)}
