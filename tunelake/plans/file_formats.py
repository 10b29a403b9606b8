"""Queries through the file formats: documents made from the tables, written or parsed, read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.catalog import knob_records
from tunelake.constants import METRIC_NAMES, RUN_LIMIT, THROUGHPUT_KEY
from tunelake.functions.text import float_text, metrics_json
from tunelake.operators import features as ft
from tunelake.operators import history as hi
from tunelake.operators import plan_trees as pt
from tunelake.operators.log_events import distinct_records, pair_runs
from tunelake.operators.splits import hash_split
from tunelake.plans import standins as st
from tunelake.plans import telemetry as tl
from tunelake.plans.tables import table
from tunelake.session import scratch_path, written
from tunelake.sources import files as src
from tunelake.sources import sinks
from tunelake.sources.documents import append_documents, read_documents, read_log
from tunelake.streaming.keyed_best import RUN_SCHEMA as KEYED_SCHEMA
from tunelake.streaming.keyed_best import current_best, keep_best_by_key
from tunelake.streaming.samples import keep_best, latest_best, run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("s1_knob_catalog", " UNION ALL ".join(
    f"SELECT '{c}' AS knob, 'real' AS type, min({c}) + 0.0 AS min, max({c}) AS max, min({c}) + 0.0 AS default_value FROM lineitem" for c in ITEM_COLUMNS
))
def s1_knob_catalog(spark, sf_dir):
    """Catalog document of the item columns' ranges."""
    limits = [
        F.struct((F.min(c) + 0.0).alias("min"), F.max(c).alias("max"), F.lit("real").alias("type"), (F.min(c) + 0.0).alias("default")).alias(c)
        for c in ITEM_COLUMNS
    ]
    docs = table(spark, sf_dir, "lineitem").agg(*limits).select(F.to_json(F.struct(*ITEM_COLUMNS)).alias("text"))
    return src.parse_knob_catalog(docs).withColumnRenamed("default", "default_value")


@query("s2_config_space", """
SELECT lower(replace(p_brand, '#', '_')) AS knob, 'integer' AS type, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, count(*)::DOUBLE AS default_value FROM part GROUP BY p_brand""")
def s2_config_space(spark, sf_dir):
    name = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    per_brand = table(spark, sf_dir, "part").groupBy(name.alias("name")).agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("top"), F.count(F.lit(1)).alias("n")
    )
    line = F.format_string("%s integer [%d, %d] [%d]", "name", "lo", "top", "n")
    return src.parse_config_space(per_brand.select(line.alias("line"))).withColumnRenamed("default", "default_value")


def history_documents(spark, sf_dir):
    """History documents (workload, text) of at most RUN_LIMIT runs, one per user and id block."""
    runs = table(spark, sf_dir, "events").select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.floor(F.col("event_id") / RUN_LIMIT).cast("string")).alias("workload"),
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(2147483647.0)).otherwise(-F.col("value")).alias("cost"),
        st.prop_k(F.col("props")).alias("k"),
    )
    run = F.concat(F.lit("[["), F.col("event_id").cast("string"), F.lit(", null],["), F.col("cost").cast("string"), F.lit(", 0.5]]"))
    config = F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('": {"work_mem": '), F.col("k").cast("string"), F.lit("}"))
    entries = F.sort_array(F.collect_list(F.struct("event_id", run.alias("run"), config.alias("config"), "k")))
    grouped = runs.groupBy("workload").agg(entries.alias("e"))
    data = F.array_join(F.transform("e", lambda x: x["run"]), ",")
    known = F.filter("e", lambda x: x["k"] != 0)
    configs = F.array_join(F.transform(known, lambda x: x["config"]), ",")
    text = F.concat(F.lit('{"data": ['), data, F.lit('], "configs": {'), configs, F.lit("}}"))
    return grouped.select("workload", text.alias("text"))


@query("s3_run_history", """
WITH r AS (SELECT user_id::VARCHAR || '_' || (event_id // 100)::VARCHAR AS workload, event_id, CASE WHEN event_type = 'error' THEN 2147483647.0::DOUBLE ELSE -value END AS cost,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY event_id) - 1 AS run_ord FROM r)
SELECT workload, run_ord, event_id::VARCHAR AS config_id, cost, k AS work_mem FROM n WHERE k <> 0""")
def s3_run_history(spark, sf_dir):
    docs = history_documents(spark, sf_dir)
    runs, configs = src.parse_runs(docs), src.parse_configs(docs)
    wide = src.wide_configs(configs, ["work_mem"], ["workload", "config_id"])
    return hi.runs_with_config(runs, wide).select("workload", "run_ord", "config_id", "cost", "work_mem")


def stored(docs: DataFrame, name: str, **options) -> DataFrame:
    """Documents (path, text) written to bundles in two commits, the second one repeated, and read from them again."""
    path = scratch_path(docs.sparkSession, name)
    half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    for commit_id, part in (("1", half), ("2", ~half), ("2", ~half)):
        append_documents(docs.filter(part), path, commit_id)
    return read_documents(docs.sparkSession, path, **options)


@query("s3_history_files", """
WITH r AS (SELECT user_id::VARCHAR || '_' || (event_id // 100)::VARCHAR AS workload, event_id, CASE WHEN event_type = 'error' THEN 2147483647.0::DOUBLE ELSE -value END AS cost,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY event_id) - 1 AS run_ord FROM r)
SELECT workload, run_ord, event_id::VARCHAR AS config_id, cost, k AS work_mem FROM n WHERE k <> 0""")
def s3_history_files(spark, sf_dir):
    """Histories through the data source: the latest run folder of each counts, and backups do not."""
    docs = history_documents(spark, sf_dir)
    folders = F.explode(F.array(F.lit("run_2"), F.lit("run_1"), F.lit("run_0.OLD"))).alias("folder")
    files = docs.select("*", folders).select(
        F.concat(F.lit("data/"), "workload", F.lit("_smac_output/"), "folder", F.lit("/runhistory.json")).alias("path"),
        F.when(F.col("folder") == "run_1", F.col("text")).otherwise(F.lit('{"data": [[["0"],[-1.0]]], "configs": {"0": {"work_mem": 1}}}')).alias("text"),
    )
    found = stored(files, "history-files", pattern="runhistory.json").filter("folder IN ('run_1', 'run_2')")
    kept = written(found.join(src.first_run_folder(found), "path").select("workload", "text"), "history-documents")
    runs, configs = src.parse_runs(kept), src.parse_configs(kept)
    wide = src.wide_configs(configs, ["work_mem"], ["workload", "config_id"])
    return hi.runs_with_config(runs, wide).select("workload", "run_ord", "config_id", "cost", "work_mem")


@query("s4_internal_metrics", st.with_views(["all_metrics"], f"""
SELECT workload, {', '.join(f'inner_metrics[{i + 1}] AS {n}' for i, n in enumerate(METRIC_NAMES))} FROM metrics"""))
def s4_internal_metrics(spark, sf_dir):
    """Counter documents, half of them objects and half lists."""
    rows = st.metrics(spark, sf_dir, every=True)
    as_list = F.to_json("inner_metrics")
    docs = rows.select(
        "workload",
        F.when(F.length("workload") % 2 == 0, metrics_json(F.col("inner_metrics"))).otherwise(as_list).alias("text"),
    )
    parsed = src.parse_metrics(docs)
    return parsed.select("workload", *[F.get("inner_metrics", F.lit(i)).alias(n) for i, n in enumerate(METRIC_NAMES)])


@query("s4_metrics_files", st.with_views(["all_metrics"], f"""
SELECT workload, {', '.join(f'inner_metrics[{i + 1}] AS {n}' for i, n in enumerate(METRIC_NAMES))} FROM metrics WHERE workload LIKE '%/sample_tpcc%'"""))
def s4_metrics_files(spark, sf_dir):
    """Counter files of one family: the filter on the name chooses among them before they are read."""
    rows = st.metrics(spark, sf_dir, every=True)
    path = F.concat(F.replace("workload", F.lit("./"), F.lit("")), F.lit("_internal_metrics.json"))
    files = stored(rows.select(path.alias("path"), metrics_json(F.col("inner_metrics")).alias("text")), "metrics-files", pattern="*_internal_metrics.json", pushdown=True)
    family = files.filter(F.startswith("name", F.lit("sample_tpcc")))
    workload = F.concat(F.lit("./"), F.regexp_extract("path", r"(.*)_internal_metrics\.json$", 1))
    parsed = src.parse_metrics(family.withColumn("workload", workload))
    return parsed.select("workload", *[F.get("inner_metrics", F.lit(i)).alias(n) for i, n in enumerate(METRIC_NAMES)])


@query("f8_with_both_files", st.with_views(["runs", "metrics"], "SELECT DISTINCT workload FROM runs JOIN metrics USING (workload)"))
def f8_with_both_files(spark, sf_dir):
    return src.with_both_files(st.runs(spark, sf_dir), st.metrics(spark, sf_dir))


@query("s5_samples", tl.CHECKS["t1_build_samples"])
def s5_samples(spark, sf_dir):
    """Samples written as JSON lines in two appends and read back."""
    knobs = [k.knob for k in knob_records()]
    samples = tl.samples(spark, sf_dir).select(*knobs, "y", "inner_metrics", "workload", "config_id")
    path = scratch_path(spark, "samples")
    odd = F.pmod(F.col("config_id").cast("long"), F.lit(2)) == 1
    sinks.write_samples(samples.filter(odd), path)
    sinks.write_samples(samples.filter(~odd), path, append=True)
    back = src.read_samples(spark, path, knobs)
    return back.select(
        "workload", "config_id", F.col("y")[0].alias("throughput"), F.col("y")[1].alias("inverse"),
        "work_mem", "shared_buffers", F.size("inner_metrics").alias("n_metrics"),
    )


def _statement_digest(spark, sf_dir, rule):
    stmts = ft.statements(st.workload_files(spark, sf_dir), rule)
    return stmts.select("workload", "stmt_pos", F.md5("sql_text").alias("digest"))


@query("s7_replay_statements", st.with_views(["files"], f", {tl._SQL_REPLAY} SELECT workload, CAST(stmt_pos AS INTEGER) AS stmt_pos, md5(sql_text) AS digest FROM replay"))
def s7_replay_statements(spark, sf_dir):
    return _statement_digest(spark, sf_dir, "replay")


_SQL_PIECES = """SELECT workload, CAST(unnest(range(len(s))) AS INTEGER) AS stmt_pos, md5(unnest(s)) AS digest FROM pieces"""


@query("s7_semicolon_statements", st.with_views(["files"], f""", pieces AS (SELECT workload,
  list_filter(list_transform(string_split(text, ';'), lambda x: {tl._sql_strip('x')}), lambda x: x <> '') AS s FROM files) {_SQL_PIECES}"""))
def s7_semicolon_statements(spark, sf_dir):
    return _statement_digest(spark, sf_dir, "semicolon")


@query("s7_line_statements", st.with_views(["files"], f""", pieces AS (SELECT workload, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {tl._sql_strip('x')}),
  lambda x: x <> '' AND NOT starts_with(x, '--') AND NOT starts_with(x, '#')), lambda x: regexp_replace(x, ';$', '')) AS s FROM files) {_SQL_PIECES}"""))
def s7_line_statements(spark, sf_dir):
    return _statement_digest(spark, sf_dir, "line")


def plan_files(spark, sf_dir):
    """Plan files: one tree and one entry without a plan each."""
    text = F.concat(F.lit('[{"Plan":{"Plan":'), "text", F.lit('},"query":"q","query_id":1},{"query":"none"}]'))
    return st.plans(spark, sf_dir).select(F.col("plan_id").cast("string").alias("workload"), text.alias("text"))


@query("s8_plan_files", st.with_views(["nodes"], "SELECT plan_id::VARCHAR || '#0' AS plan_id, count(*) AS n_nodes, round(max(total_cost), 4) AS top_cost FROM nodes GROUP BY plan_id"))
def s8_plan_files(spark, sf_dir):
    nodes = pt.plan_nodes(src.read_plan_rows(plan_files(spark, sf_dir)))
    return nodes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.max("total_cost"), 4).alias("top_cost"))


@query("s8_stored_plans", st.with_views(["nodes"], "SELECT plan_id::VARCHAR || '#0' AS plan_id, count(*) AS n_nodes, round(max(total_cost), 4) AS top_cost FROM nodes GROUP BY plan_id"))
def s8_stored_plans(spark, sf_dir):
    """Plan files through the data source, many of them in a partition."""
    files = plan_files(spark, sf_dir).select(F.concat(F.lit("plans/"), "workload", F.lit(".json")).alias("path"), "text")
    found = stored(files, "plan-files", pattern="*.json")
    nodes = pt.plan_nodes(src.read_plan_rows(found.select(F.regexp_extract("name", r"(.*)\.json$", 1).alias("workload"), "text")))
    return nodes.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.max("total_cost"), 4).alias("top_cost"))


@query("s8_file_plan_texts", f"SELECT o_orderkey::VARCHAR AS workload, {tl._sql_shape()} AS plans FROM orders")
def s8_file_plan_texts(spark, sf_dir):
    texts = pt.file_plans(plan_files(spark, sf_dir))
    return texts.select("workload", F.array_join("plans", "; ").alias("plans"))


@query("s9_benchmark_xml", """
SELECT 'jdbc:postgresql://host:5432/' || lower(c_mktsegment) || '?id=' || c_custkey::VARCHAR AS url, c_nationkey::DOUBLE AS scalefactor, CAST(c_custkey AS INTEGER) AS terminals,
  unnest([0::INTEGER, 1]) AS phase, unnest([60::INTEGER, 30]) AS time, 'unlimited' AS rate, c_nationkey::VARCHAR || '/' || (100 - c_nationkey)::VARCHAR AS weights, 'Read' || c_nationkey::VARCHAR || '/Write' AS transactions FROM customer""")
def s9_benchmark_xml(spark, sf_dir):
    """Benchmark settings as XML documents of two phases, one per customer."""
    return _settings(_xml_documents(spark, sf_dir))


def _xml_documents(spark, sf_dir):
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("<parameters><type>POSTGRES</type><url>jdbc:postgresql://host:5432/"), F.lower("c_mktsegment"), F.lit("?id="), key,
        F.lit("</url><scalefactor>"), nation, F.lit("</scalefactor><terminals>"), key,
        F.lit("</terminals><works><work><time>60</time><rate>unlimited</rate><weights>"), nation, F.lit(","),
        (100 - F.col("c_nationkey")).cast("string"),
        F.lit("</weights></work><work><time>30</time><rate>unlimited</rate><weights>"), nation, F.lit(","),
        (100 - F.col("c_nationkey")).cast("string"),
        F.lit("</weights></work></works><transactiontypes><transactiontype><name>Read"), nation,
        F.lit("</name></transactiontype><transactiontype><name>Write</name></transactiontype></transactiontypes></parameters>"),
    )
    return table(spark, sf_dir, "customer").select(F.concat(key, F.lit(".xml")).alias("path"), text.alias("text"))


def _settings(docs):
    settings = src.parse_benchmark_xml(docs).drop("workload")
    return settings.withColumn("weights", F.array_join(F.col("weights").cast("array<string>"), "/")).withColumn(
        "transactions", F.array_join("transactions", "/")
    )


@query("s9_xml_files", """
SELECT 'jdbc:postgresql://host:5432/' || lower(c_mktsegment) || '?id=' || c_custkey::VARCHAR AS url, c_nationkey::DOUBLE AS scalefactor, CAST(c_custkey AS INTEGER) AS terminals,
  unnest([0::INTEGER, 1]) AS phase, unnest([60::INTEGER, 30]) AS time, 'unlimited' AS rate, c_nationkey::VARCHAR || '/' || (100 - c_nationkey)::VARCHAR AS weights, 'Read' || c_nationkey::VARCHAR || '/Write' AS transactions FROM customer""")
def s9_xml_files(spark, sf_dir):
    """The same settings from files, read through the data source."""
    return _settings(stored(_xml_documents(spark, sf_dir), "xml-files", pattern="*.xml"))


@query("s10_benchmark_summary", """
SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' THEN o_totalprice ELSE 0.0 END AS throughput FROM orders""")
def s10_benchmark_summary(spark, sf_dir):
    """Summaries, some of them without the value and some cut off."""
    whole = F.concat(F.lit(f'{{"scalefactor": 1, "{THROUGHPUT_KEY}": '), F.col("o_totalprice").cast("string"), F.lit("}"))
    text = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit('{"scalefactor": 1'))
        .when(F.col("o_orderstatus") == "O", whole)
        .otherwise(F.lit('{"scalefactor": 1}'))
    )
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), text.alias("text"))
    return src.parse_benchmark_summary(docs)


@query("s11_result_lines", st.with_views(["results"], "SELECT name, qps FROM results"))
def s11_result_lines(spark, sf_dir):
    path = scratch_path(spark, "result-lines")
    sinks.write_result_lines(st.results(spark, sf_dir), path)
    return src.read_result_lines(spark, path).select("name", "qps")


@query("s12_responses", st.with_views(["pairs"], "SELECT sample::VARCHAR AS path, knob, pred_label AS label FROM pairs JOIN events ON event_id = sample WHERE event_type = 'purchase'"))
def s12_responses(spark, sf_dir):
    docs = st.answers(spark, sf_dir).select(F.col("sample").cast("string").alias("path"), F.col("answer_text").alias("text"))
    return src.parse_responses(docs)


def _stats_documents(spark, sf_dir):
    """Optimizer statistics per customer, below the folder of its segment."""
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("submitted_ta_runs"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished_ta_runs"),
        F.count_distinct("o_orderpriority").alias("n_configs"),
        F.max("o_totalprice").alias("wallclock_time_used"),
        F.min("o_totalprice").alias("ta_time_used"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("inc_changed"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    path = F.concat(
        F.lit("data/"), F.lower("c_mktsegment"), F.lit("/sample_"), F.col("o_custkey").cast("string"),
        F.lit("_smac_output/run_1/stats.json"),
    )
    fields = ["submitted_ta_runs", "finished_ta_runs", "n_configs", "wallclock_time_used", "ta_time_used", "inc_changed"]
    return per_customer.join(customers, "o_custkey").select(path.alias("path"), F.to_json(F.struct(*fields)).alias("text"))


_SQL_STATS = """stats AS (SELECT lower(c_mktsegment) AS benchmark, 'sample_' || o_custkey::VARCHAR AS workload, 'run_1' AS run_folder, count(*) AS submitted_ta_runs,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS finished_ta_runs, count(DISTINCT o_orderpriority) AS n_configs, max(o_totalprice) AS wallclock_time_used,
  min(o_totalprice) AS ta_time_used, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS inc_changed FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, o_custkey)"""


@query("s13_optimizer_stats", f"WITH {_SQL_STATS} SELECT * FROM stats")
def s13_optimizer_stats(spark, sf_dir):
    return src.parse_optimizer_stats(_stats_documents(spark, sf_dir))


@query("a16_optimizer_rollup", f"""WITH {_SQL_STATS} SELECT benchmark, count(*) AS n_runs, CAST(sum(finished_ta_runs) AS BIGINT) AS evaluations, round(avg(wallclock_time_used), 4) AS avg_wallclock,
  round(avg(ta_time_used), 4) AS avg_evaluation, CAST(sum(inc_changed) AS BIGINT) AS inc_changed FROM stats GROUP BY benchmark""")
def a16_optimizer_rollup(spark, sf_dir):
    out = hi.optimizer_rollup(src.parse_optimizer_stats(_stats_documents(spark, sf_dir)))
    return out.withColumn("avg_wallclock", F.round("avg_wallclock", 4)).withColumn("avg_evaluation", F.round("avg_evaluation", 4))


@query("s14_run_log", """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad((event_id % 1000)::VARCHAR, 3, '0') AS time, event_type || '.py' AS file, CAST(event_id AS INTEGER) AS line_no,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_type = 'error' THEN 'run failed: ' || props ELSE 'load throughput: ' || value::VARCHAR END AS message,
  CASE WHEN event_type <> 'error' THEN value END AS throughput FROM events""")
def s14_run_log(spark, sf_dir):
    """Log lines, each written twice as stacked handlers do."""
    failed = F.col("event_type") == "error"
    text = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"),
        F.lit(":"), "event_type", F.lit(".py#L"), F.col("event_id").cast("string"), F.lit(":"),
        F.when(failed, F.lit("ERROR")).otherwise(F.lit("INFO")), F.lit("]: "),
        F.when(failed, F.concat(F.lit("run failed: "), "props")).otherwise(F.concat(F.lit("load throughput: "), float_text(F.col("value")))),
    )
    line = F.explode(F.array_repeat(text, 2)).alias("line")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    return src.parse_run_log(events.select(line))


def _log_files(spark, sf_dir, pushdown=False):
    """A rotated log in the order of time: starts, results, errors over several lines, all written twice."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    message = (
        F.when(kind == "view", F.concat(F.lit("Running BenchBase with benchmark: b"), (F.col("event_id") % 7).cast("string")))
        .when(kind == "purchase", F.concat(F.lit("BenchBase tpcc throughput: "), float_text(F.col("value"))))
        .when(kind == "error", F.concat(F.lit("run failed:\nTraceback\n\n  at ["), number, F.lit("]\n"), "props"))
        .otherwise(F.concat(F.lit("note "), number))
    )
    text = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(":"), kind, F.lit(".py#L"), number, F.lit(":"), F.when(kind == "error", F.lit("ERROR")).otherwise(F.lit("INFO")), F.lit("]: "), message)
    path = scratch_path(spark, "log-files")
    events.select("ts", "event_id", text.alias("text")).orderBy("ts", "event_id").select(F.explode(F.array_repeat("text", 2)).alias("value")).write.text(path)
    return read_log(spark, path, pushdown=pushdown, partition_bytes=str(1 << 20))


_SQL_LOG = """log AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE event_type WHEN 'view' THEN 'Running BenchBase with benchmark: b' || (event_id % 7)::VARCHAR WHEN 'purchase' THEN 'BenchBase tpcc throughput: ' || value::VARCHAR
    WHEN 'error' THEN 'run failed:' || chr(10) || 'Traceback' || chr(10) || chr(10) || '  at [' || event_id::VARCHAR || ']' || chr(10) || props ELSE 'note ' || event_id::VARCHAR END AS message, value FROM events)"""


@query("s14_log_records", f"WITH {_SQL_LOG} SELECT time, event_type || '.py' AS file, CAST(event_id AS INTEGER) AS line_no, level, message FROM log")
def s14_log_records(spark, sf_dir):
    """Records of one or several lines from byte ranges of log files, each counted once."""
    return distinct_records(_log_files(spark, sf_dir)).select("time", "file", "line_no", "level", "message")


@query("s14_log_errors", f"WITH {_SQL_LOG} SELECT time, message FROM log WHERE level = 'ERROR'")
def s14_log_errors(spark, sf_dir):
    """Errors only: the level is told before a record leaves the reader."""
    return distinct_records(_log_files(spark, sf_dir, pushdown=True).filter("level = 'ERROR'")).select("time", "message")


@query("s14_run_pairs", f"""WITH {_SQL_LOG},
n AS (SELECT *, count(*) FILTER (WHERE event_type = 'view') OVER (ORDER BY ts, event_id) AS run FROM log WHERE event_type IN ('view', 'purchase')),
r AS (SELECT *, row_number() OVER (PARTITION BY run, event_type ORDER BY ts, event_id) AS nth FROM n WHERE run > 0)
SELECT s.time AS started, 'b' || (s.event_id % 7)::VARCHAR AS benchmark, e.value AS throughput, e.time AS ended
FROM r s LEFT JOIN r e ON e.run = s.run AND e.event_type = 'purchase' AND e.nth = 1 WHERE s.event_type = 'view'""")
def s14_run_pairs(spark, sf_dir):
    """Starts of runs with their first result, over all files of the log."""
    return pair_runs(distinct_records(_log_files(spark, sf_dir))).select("started", "benchmark", "throughput", "ended")


@query("s6_committed_samples", """
SELECT l_returnflag AS workload, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1""")
def s6_committed_samples(spark, sf_dir):
    """Appends that are repeated, as after a lost answer, and one that breaks off; each row counts once."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("workload"), F.col("l_linenumber").cast("long").alias("number"), "l_linestatus")
    path, schema = scratch_path(spark, "committed"), "workload string, number long"
    for status in ("O", "F", "O"):
        sinks.append_samples_once(items.filter(F.col("l_linestatus") == status).drop("l_linestatus"), path, f"status-{status}")
    items.drop("l_linestatus").limit(10).write.json(f"{path}/data/broken-off")
    back = sinks.committed_samples(spark, path, schema)
    return back.groupBy("workload").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("total"))


@query("s15_training_records", """
SELECT CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 8))::BIGINT % 100 < 90 THEN 'train' ELSE 'test' END AS split, count(*) AS n_records,
  CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def s15_training_records(spark, sf_dir):
    """Records written per split and read back."""
    records = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("system"), F.col("source").alias("instruction"), F.col("text").alias("input"), F.lit("{}").alias("output")
    )
    path = scratch_path(spark, "records")
    sinks.write_training_records(hash_split(records, ["doc_id"]), path)
    schema = "doc_id long, system string, instruction string, input string, output string, split string"
    back = spark.read.schema(schema).json(f"{path}/records")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("input")).alias("n_chars"))


@query("s16_discover_workloads", """
SELECT 'sample_tpcc_config' || o_orderkey::VARCHAR || '.xml' AS name FROM orders WHERE o_orderstatus = 'F' ORDER BY name""")
def s16_discover_workloads(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    name = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("sample_tpcc_config"), key, F.lit(".xml")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("sample_ycsb_config"), key, F.lit(".xml")))
        .otherwise(F.lit("sample_tpcc_config.xml"))
    )
    return src.workload_files(table(spark, sf_dir, "orders").select(name.alias("name")), "oltp", "tpcc")


@query("st1_best_stream", tl.CHECKS["a1_best_config"])
def st1_best_stream(spark, sf_dir):
    """Runs as a growing folder, read as a stream to its end; equals the batch result."""
    source, target, state = (scratch_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    st.runs(spark, sf_dir).write.json(source)
    stream = run_stream(spark, source)
    keep_best(stream, target, state).awaitTermination()
    return latest_best(spark, target)


@query("st1_keyed_best", st.with_views(["runs"], """,
t AS (SELECT r.*, ts FROM runs r JOIN events ON event_id = run_ord),
b AS (SELECT workload, count(*) AS n_runs, min(cost) AS cost FROM t GROUP BY workload)
SELECT b.workload, r.config_id, b.cost, r.run_ord, b.n_runs FROM b JOIN t r ON r.workload = b.workload AND r.cost = b.cost
QUALIFY row_number() OVER (PARTITION BY b.workload ORDER BY r.run_ord) = 1"""))
def st1_keyed_best(spark, sf_dir):
    """Runs that arrive in three batches, the latest first and with a restart between them, kept in keyed state."""
    source, target, state = (scratch_path(spark, n) for n in ("keyed-in", "keyed-out", "keyed-state"))
    runs = st.runs(spark, sf_dir, F.col("ts").cast("timestamp").alias("ended"))
    for third in (2, 0, 1):
        runs.filter(F.col("run_ord") % 3 == third).write.mode("append").json(source)
        keep_best_by_key(run_stream(spark, source, KEYED_SCHEMA), target, state).awaitTermination()
    return current_best(spark, target).select("workload", "config_id", "cost", "run_ord", "n_runs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
