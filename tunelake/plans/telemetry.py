"""Queries on the telemetry views: scalars, joins, aggregates, splits, records, plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.catalog import knob_records, knob_table, renamed
from tunelake.constants import (
    CHAT_END,
    CHAT_START,
    FEATURE_NAMES,
    INSTRUCTION_TEXT,
    METRIC_NAMES,
    PROMPT_FEATURES,
    PROMPT_HEAD,
    PROMPT_METRICS,
    PROMPT_PLANS,
    SYSTEM_TEXT,
    BEST_INSTRUCTION,
)
from tunelake.functions import labels as lab
from tunelake.functions import scaling as sc
from tunelake.functions import text as tx
from tunelake.operators import evaluate as ev
from tunelake.operators import features as ft
from tunelake.operators import history as hi
from tunelake.operators import plan_trees as pt
from tunelake.operators import records as rc
from tunelake.operators import splits as sp
from tunelake.operators.increments import SampleStore
from tunelake.operators.node_trees import subtree_costs
from tunelake.operators.skew import checked_broadcast, value_rank, with_group_stats
from tunelake.plans import standins as st
from tunelake.plans.tables import table
from tunelake.session import scratch_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Registers a query and the SQL that checks it."""

    def register(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def _quoted(text: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


# ---------------------------------------------------------------- scalars

PRICE_LIMITS = "limits AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)"


def _price_position(spark, sf_dir, build):
    items = table(spark, sf_dir, "lineitem")
    limits = hi.value_range(items, "l_extendedprice")
    lo, top = limits.select("lo").scalar(), limits.select("hi").scalar()
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", build(F.col("l_extendedprice"), lo, top).alias("v"))


@query("p1_normalize_clip", f"""
WITH {PRICE_LIMITS}
SELECT l_orderkey, l_linenumber, round((least(greatest(l_extendedprice, lo + 1000), hi / 2) - lo - 1000) / (hi / 2 - lo - 1000), 9) AS position
FROM lineitem, limits""")
def p1_normalize_clip(spark, sf_dir):
    out = _price_position(spark, sf_dir, lambda v, lo, top: sc.normalize_clip(v, lo + 1000, top / 2))
    return out.select("l_orderkey", "l_linenumber", F.round("v", 9).alias("position"))


@query("p2_normalize_raw", f"""
WITH {PRICE_LIMITS}
SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo - 1000) / (hi / 2 - lo - 1000), 9) AS position FROM lineitem, limits""")
def p2_normalize_raw(spark, sf_dir):
    out = _price_position(spark, sf_dir, lambda v, lo, top: sc.normalize_raw(v, lo + 1000, top / 2))
    return out.filter(F.col("v").isNotNull()).select("l_orderkey", "l_linenumber", F.round("v", 9).alias("position"))


_SQL_PRICE_BUCKET = st.sql_bucket("((l_extendedprice - lo) / (hi - lo))")


@query("p3_bucket_label", f"""
WITH {PRICE_LIMITS}
SELECT {st.sql_range_label(_SQL_PRICE_BUCKET)} AS label, count(*) AS n,
  round(min(l_extendedprice), 2) AS lowest, round(max(l_extendedprice), 2) AS highest FROM lineitem, limits GROUP BY 1""")
def p3_bucket_label(spark, sf_dir):
    out = _price_position(spark, sf_dir, lambda v, lo, top: lab.bucket_label(sc.bucket(sc.normalize_clip(v, lo, top))))
    return out.groupBy(F.col("v").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("l_extendedprice"), 2).alias("lowest"),
        F.round(F.max("l_extendedprice"), 2).alias("highest"),
    )


@query("p4_label_dialects", f"""
WITH {PRICE_LIMITS}, b AS (SELECT l_orderkey, l_linenumber, {_SQL_PRICE_BUCKET} AS bucket FROM lineitem, limits)
SELECT l_orderkey, l_linenumber, {st.sql_range_label('bucket')} AS range_label,
  lpad((bucket * 10)::VARCHAR, 2, '0') || '% to ' || (bucket * 10 + 10)::VARCHAR || '%' AS padded_label,
  (['extremely low', 'very low', 'low', 'slightly low', 'middle', 'slightly high', 'high', 'very high', 'extremyly high'])[bucket + 1] AS word_label,
  bucket AS from_range, bucket AS from_padded FROM b""")
def p4_label_dialects(spark, sf_dir):
    rows = _price_position(spark, sf_dir, lambda v, lo, top: sc.bucket(sc.normalize_clip(v, lo, top)))
    labelled = rows.select(
        "l_orderkey",
        "l_linenumber",
        lab.bucket_label(F.col("v"), lab.RANGE).alias("range_label"),
        lab.bucket_label(F.col("v"), lab.PADDED).alias("padded_label"),
        lab.bucket_label(F.col("v"), lab.WORDS).alias("word_label"),
    )
    return labelled.withColumn("from_range", lab.label_bucket(F.col("range_label"))).withColumn(
        "from_padded", lab.label_bucket(F.col("padded_label"))
    )


_KNOB_ROWS = ", ".join(
    f"('{k.knob}', '{k.type}', {k.min:.1f}::DOUBLE, {k.max:.1f}::DOUBLE, {k.default:.1f}::DOUBLE)" for k in knob_records()
)
SQL_CATALOG = f"catalog AS (SELECT * FROM (VALUES {_KNOB_ROWS}) AS t(knob, type, min, max, default_value))"


@query("p5_decode_label", st.with_views(["pairs"], f""", {SQL_CATALOG},
labels_long AS (SELECT sample, knob, pred_label AS label FROM pairs WHERE pred_label IS NOT NULL),
placed AS (SELECT sample, knob, label, type, min, max, CASE WHEN label = 'middle' THEN NULL ELSE split_part(label, '-', 1)::INT // 10 END AS bucket
  FROM labels_long JOIN catalog USING (knob))
SELECT sample, knob, label, trunc((max - min) / 10 * bucket + (max - min) / 10 / 2 + min) AS value, bucket IS NULL AS rejected FROM placed"""))
def p5_decode_label(spark, sf_dir):
    return ev.decode_answers(_long_labels(spark, sf_dir)[1], knob_table(spark))


@query("p6_rename_knobs", """
SELECT CASE p_type WHEN 'ECONOMY' THEN 'autovacuum_vacuum_cost_delay' WHEN 'SMALL' THEN 'vacuum_cost_page_hit'
  WHEN 'LARGE' THEN 'max_wal_senders' ELSE lower(p_type) END AS knob, count(*) AS n FROM part GROUP BY 1""")
def p6_rename_knobs(spark, sf_dir):
    legacy = (
        F.when(F.col("p_type") == "ECONOMY", F.lit("autovacuum_delay"))
        .when(F.col("p_type") == "SMALL", F.lit("autovacuum_page_hit"))
        .when(F.col("p_type") == "LARGE", F.lit("autovacuum_max_wal_senders"))
        .otherwise(F.lower("p_type"))
    )
    named = table(spark, sf_dir, "part").select(legacy.alias("old"))
    return named.groupBy(renamed(F.col("old")).alias("knob")).agg(F.count(F.lit(1)).alias("n"))


def _sql_float_text(x: str) -> str:
    """Text of a double whose value has few digits."""
    return f"(CASE WHEN {x} = trunc({x}) THEN CAST({x} AS BIGINT)::VARCHAR || '.0' ELSE CAST({x} AS VARCHAR) END)"


def sql_humanize_metric(v: str) -> str:
    return f"""(CASE WHEN {v} > 0 AND {v} < 0.3333 THEN 'low' WHEN {v} > 0 AND {v} < 0.66667 THEN 'middle' WHEN {v} > 0 AND {v} < 1 THEN 'high'
  WHEN {v} > 0 AND {v} < 1000 THEN {_sql_float_text(f'(trunc({v} * 100) / 100.0::DOUBLE)')}
  WHEN {v} < 1000000 THEN CAST(trunc({v} / 1000) AS BIGINT)::VARCHAR || 'k'
  ELSE {_sql_float_text(f'(trunc({v} / 100000) / 10.0::DOUBLE)')} || ' million' END)"""


@query("p7_humanize_metric", f"""
WITH v AS (SELECT o_orderkey, unnest([o_totalprice / 1000000, o_totalprice / 1000, o_totalprice, o_totalprice * 100, -o_totalprice, 0.0::DOUBLE]) AS value,
  unnest([1, 2, 3, 4, 5, 6]) AS form FROM orders)
SELECT o_orderkey, form, {sql_humanize_metric('value')} AS text FROM v""")
def p7_humanize_metric(spark, sf_dir):
    p = F.col("o_totalprice")
    forms = F.array(p / 1000000, p / 1000, p, p * 100, -p, F.lit(0.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(forms).alias("pos", "value"))
    return rows.select("o_orderkey", (F.col("pos") + 1).alias("form"), tx.humanize_metric(F.col("value")).alias("text"))


def sql_humanize_cost(c: str) -> str:
    return f"""(CASE WHEN {c} < 1000 THEN format('{{:.1f}}', {c}) WHEN {c} > 1000 AND {c} < 1000000 THEN CAST(trunc({c} / 1000) AS BIGINT)::VARCHAR || 'k'
  WHEN {c} >= 1000000 THEN CAST(trunc({c} / 1000000) AS BIGINT)::VARCHAR || ' million' ELSE {_sql_float_text(c)} END)"""


@query("p8_humanize_cost", f"""
WITH v AS (SELECT o_orderkey, unnest([o_totalprice / 1000, o_totalprice, o_totalprice * 10, 1000.0::DOUBLE]) AS cost, unnest([1, 2, 3, 4]) AS form FROM orders)
SELECT o_orderkey, form, {sql_humanize_cost('cost')} AS text FROM v""")
def p8_humanize_cost(spark, sf_dir):
    p = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.posexplode(F.array(p / 1000, p, p * 10, F.lit(1000.0))).alias("pos", "cost")
    )
    return rows.select("o_orderkey", (F.col("pos") + 1).alias("form"), tx.humanize_cost(F.col("cost")).alias("text"))


@query("p9_blocks_to_bytes", "SELECT l_suppkey, CAST(sum(l_quantity) * 8192 AS BIGINT) AS bytes FROM lineitem GROUP BY l_suppkey")
def p9_blocks_to_bytes(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("blocks"))
    return sums.select("l_suppkey", sc.blocks_to_bytes(F.col("blocks")).cast("long").alias("bytes"))


@query("p10_cost_to_y", st.with_views(["runs"], """
SELECT config_id, -cost AS throughput, CASE WHEN cost <> 0 THEN 1.0::DOUBLE / -cost ELSE 0.0 END AS inverse FROM runs"""))
def p10_cost_to_y(spark, sf_dir):
    y = sc.cost_to_y(F.col("cost"))
    return st.runs(spark, sf_dir).select("config_id", y[0].alias("throughput"), y[1].alias("inverse"))


@query("p11_typed_value", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN trunc(l_extendedprice) ELSE l_extendedprice END AS value FROM lineitem""")
def p11_typed_value(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", F.lit("integer")).otherwise(F.lit("real"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", sc.typed_value(F.col("l_extendedprice"), kind).alias("value")
    )


@query("p12_workload_key", """
SELECT page_id, url_parts[-2] AS database, regexp_replace(url_parts[-1], '(\\.xml|\\.wg|_smac_output)$', '') AS workload_name
FROM (SELECT page_id, string_split(url || '.xml', '/') AS url_parts FROM pages)""")
def p12_workload_key(spark, sf_dir):
    path = F.concat("url", F.lit(".xml"))
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.workload_database(path).alias("database"), tx.workload_name(path).alias("workload_name")
    )


@query("p13_improvement_pct", """
WITH avg_price AS (SELECT o_orderpriority, avg(o_totalprice) AS base FROM orders GROUP BY 1)
SELECT o_orderkey, round((o_totalprice - base) / base * 100, 6) AS improvement FROM orders JOIN avg_price USING (o_orderpriority)""")
def p13_improvement_pct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = with_group_stats(orders, ["o_orderpriority"], [F.avg("o_totalprice").alias("base")], ["o_orderkey"])
    return rows.select("o_orderkey", F.round(sc.improvement_pct(F.col("o_totalprice"), F.col("base")), 6).alias("improvement"))


@query("p14_abs_qps", st.with_views(["results"], "SELECT run, name, abs(qps) AS qps FROM results"))
def p14_abs_qps(spark, sf_dir):
    return st.results(spark, sf_dir).select("run", "name", sc.abs_qps(F.col("qps")).alias("qps"))


def _sql_two(x: str) -> str:
    return f"CAST(format('{{:.2f}}', {x}) AS DOUBLE)"


_SQL_SPACE = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SQL_STRIP = f"^{_SQL_SPACE}+|{_SQL_SPACE}+$"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '{_SQL_STRIP}', '', 'g')"


SQL_FEATURES = f"""stmts AS (SELECT workload, upper(text) AS upper_text,
    list_filter(list_transform(string_split(upper(text), ';'), lambda s: {_sql_strip('s')}), lambda s: s <> '') AS s FROM files),
counted AS (SELECT workload, len(s) AS n_statements, len(s)::DOUBLE AS n, len(list_filter(s, lambda x: starts_with(x, 'SELECT'))) AS reads,
    len(string_split(upper_text, 'GROUP BY')) - 1 AS groups, len(string_split(upper_text, 'ORDER BY')) - 1 AS orders_by,
    len(list_filter(s, lambda x: contains(x, 'SUM(') OR contains(x, 'COUNT(') OR contains(x, 'AVG(') OR contains(x, 'MAX(') OR contains(x, 'MIN('))) AS aggs,
    list_sum(list_transform(s, lambda x: len(string_split(x, 'WHERE')) - 1 + len(string_split(x, ' AND ')) - 1 + len(string_split(x, ' OR ')) - 1)) AS preds
  FROM stmts),
features AS (SELECT workload, n_statements, reads / n AS read_ratio, groups / n AS group_by_ratio, orders_by / n AS order_by_ratio,
    aggs / n AS aggregation_ratio, preds / n AS avg_predicates FROM counted)"""

_RATIOS = ["read_ratio", "group_by_ratio", "order_by_ratio", "aggregation_ratio", "avg_predicates"]
_SQL_FEATURE_TEXT = " || ".join(
    [f"'{FEATURE_NAMES[0]}: ' || n_statements::VARCHAR || '; '"]
    + [f"'{n}: ' || {_sql_float_text(_sql_two(c))} || '; '" for n, c in zip(FEATURE_NAMES[1:], _RATIOS)]
)


@query("p15_feature_text", st.with_views(["files"], f", {SQL_FEATURES} SELECT workload, {_SQL_FEATURE_TEXT} AS text FROM features"))
def p15_feature_text(spark, sf_dir):
    rows = ft.workload_features(st.workload_files(spark, sf_dir))
    text = tx.feature_text(F.col("n_statements"), [F.col(c) for c in ft.FEATURE_COLUMNS])
    return rows.select("workload", text.alias("text"))


@query("p16_extract_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def p16_extract_json(spark, sf_dir):
    noisy = F.when(F.col("event_type") == "error", F.concat("props", F.lit(" and "), "props")).otherwise(
        F.concat(F.lit("The answer is\n"), "props", F.lit(" as asked."))
    )
    rows = table(spark, sf_dir, "events").select("event_id", tx.extract_json_object(noisy).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


@query("p17_metrics_map", st.with_views(["all_metrics"], f"""
SELECT workload, unnest([{', '.join(f"'{n}'" for n in METRIC_NAMES)}]) AS metric, unnest(inner_metrics) AS value FROM metrics"""))
def p17_metrics_map(spark, sf_dir):
    return st.metrics(spark, sf_dir, every=True).select(
        "workload", F.explode(tx.metrics_map(F.col("inner_metrics"))).alias("metric", "value")
    )


@query("p18_strip_prompt", f"""
SELECT conv_id, turn, {_sql_strip('text')} AS answer FROM conversations""")
def p18_strip_prompt(spark, sf_dir):
    prompt = F.concat(F.lit(f"{CHAT_START}"), "role", F.lit("\n"))
    echoed = F.when(F.col("turn") % 2 == 0, F.concat(prompt, F.lit("  "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_prompt(echoed, prompt).alias("answer"))


# ---------------------------------------------------------------- filters

@query("f1_valid_runs", st.with_views(["runs"], "SELECT workload, config_id, cost FROM runs WHERE cost < 0"))
def f1_valid_runs(spark, sf_dir):
    return hi.valid_runs(st.runs(spark, sf_dir)).select("workload", "config_id", "cost")


@query("f2_well_sampled", """
SELECT o_orderkey::VARCHAR AS config_id, o_custkey AS workload FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)""")
def f2_well_sampled(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("workload"), F.col("o_orderkey").cast("string").alias("config_id")
    )
    return hi.well_sampled(samples, ["config_id"])


@query("f3_known_configs", st.with_views(["runs", "configs"], "SELECT workload, config_id FROM runs WHERE config_id IN (SELECT config_id FROM configs)"))
def f3_known_configs(spark, sf_dir):
    known = hi.runs_with_known_config(st.runs(spark, sf_dir), st.configs(spark, sf_dir))
    return known.select("workload", "config_id")


def _ragged_metrics(spark, sf_dir):
    """Counter lists cut to 13 values for a third of the workloads."""
    rows = st.metrics(spark, sf_dir)
    third = F.length("workload") % 3 == 0
    return rows.select(
        "workload",
        F.when(third, F.slice("inner_metrics", 1, 13)).otherwise(F.col("inner_metrics")).alias("inner_metrics"),
    )


@query("f4_metrics_length", st.with_views(["metrics"], """
SELECT workload, length(workload) % 3 = 0 AS rejected FROM metrics"""))
def f4_metrics_length(spark, sf_dir):
    rows = _ragged_metrics(spark, sf_dir)
    kept = rc.complete_metrics(rows).select("workload", F.lit(False).alias("rejected"))
    return kept.union(rc.rejected_metrics(rows).select("workload", F.lit(True)))


@query("f5_known_knobs", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'work_mem' ELSE 'wal_buffers' END AS knob FROM part WHERE p_size % 5 <> 0""")
def f5_known_knobs(spark, sf_dir):
    knob = (
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("unknown_"), F.lower("p_type")))
        .when(F.col("p_size") % 2 == 0, F.lit("work_mem"))
        .otherwise(F.lit("wal_buffers"))
    )
    values = table(spark, sf_dir, "part").select("p_partkey", knob.alias("knob"))
    return hi.known_knobs(values, knob_table(spark)).select("p_partkey", "knob")


@query("f6_statement_lines", f"""
WITH lines AS (SELECT doc_id, {_sql_strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines
WHERE line <> '' AND NOT starts_with(line, '--') AND NOT starts_with(line, '#') GROUP BY doc_id""")
def f6_statement_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("raw"))
    stripped = lines.select("doc_id", tx.strip(F.col("raw")).alias("line")).filter(tx.is_statement(F.col("line")))
    return stripped.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


_SQL_REPLAY = """pieces AS (SELECT workload, regexp_split_to_array(text, '[;\\n]+') AS p FROM files),
replay AS (SELECT workload, unnest(range(len(q))) AS stmt_pos, unnest(q) || ';' AS sql_text
  FROM (SELECT workload, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS q FROM pieces))"""


@query("f7_first_statements", st.with_views(["files"], f", {_SQL_REPLAY} SELECT workload, count(*) AS n_statements FROM replay WHERE stmt_pos < 3000 GROUP BY workload"))
def f7_first_statements(spark, sf_dir):
    first = ft.first_statements(ft.statements(st.workload_files(spark, sf_dir)))
    return first.groupBy("workload").agg(F.count(F.lit(1)).alias("n_statements"))


# ---------------------------------------------------------------- joins

@query("j1_runs_configs", st.with_views(["runs", "configs"], """
SELECT workload, config_id, cost, work_mem, round(geqo_seed, 9) AS geqo_seed FROM runs JOIN configs USING (config_id)"""))
def j1_runs_configs(spark, sf_dir):
    joined = hi.runs_with_config(st.runs(spark, sf_dir), st.configs(spark, sf_dir))
    return joined.select("workload", "config_id", "cost", "work_mem", F.round("geqo_seed", 9).alias("geqo_seed"))


_SQL_BEST = """best AS (SELECT workload, config_id, cost, run_ord FROM runs
  QUALIFY row_number() OVER (PARTITION BY workload ORDER BY cost, run_ord) = 1)"""


@query("j2_best_metrics", st.with_views(["runs", "metrics"], f", {_SQL_BEST} SELECT workload, config_id, cost, inner_metrics FROM best JOIN metrics USING (workload)"))
def j2_best_metrics(spark, sf_dir):
    best = hi.best_runs(st.runs(spark, sf_dir)).drop("run_ord")
    return hi.best_with_metrics(best, st.metrics(spark, sf_dir))


@query("j2_samples_metrics", st.with_views(["runs", "metrics"], """
SELECT config_id, workload, coalesce(len(inner_metrics), 0) AS n_metrics, coalesce(list_sum(inner_metrics), 0.0) AS metric_sum FROM runs LEFT JOIN metrics USING (workload)"""))
def j2_samples_metrics(spark, sf_dir):
    out = hi.with_metrics(st.runs(spark, sf_dir), st.metrics(spark, sf_dir), "left")
    total = F.aggregate("inner_metrics", F.lit(0.0), lambda a, x: a + x)
    return out.select("config_id", "workload", F.size("inner_metrics").alias("n_metrics"), total.alias("metric_sum"))


@query("j3_knobs_catalog", f"""
WITH {SQL_CATALOG}, v AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_size % 2 = 0 THEN 'work_mem' ELSE 'geqo_effort' END AS knob, p_retailprice AS value FROM part)
SELECT p_partkey, v.knob, CASE WHEN min IS NULL THEN value::VARCHAR ELSE {st.sql_range_label(st.sql_bucket(st.sql_clip('value', 'min', 'max')))} END AS label FROM v LEFT JOIN catalog USING (knob)""")
def j3_knobs_catalog(spark, sf_dir):
    knob = (
        F.when(F.col("p_size") % 5 == 0, F.lit("unknown"))
        .when(F.col("p_size") % 2 == 0, F.lit("work_mem"))
        .otherwise(F.lit("geqo_effort"))
    )
    values = table(spark, sf_dir, "part").select("p_partkey", knob.alias("knob"), F.col("p_retailprice").alias("value"))
    joined = hi.with_catalog(values, knob_table(spark), keep_unknown=True)
    label = lab.bucket_label(sc.bucket(sc.normalize_clip(F.col("value"), F.col("min"), F.col("max"))))
    return joined.select("p_partkey", "knob", F.coalesce(label, F.col("value").cast("string")).alias("label"))


def _long_labels(spark, sf_dir):
    parsed = ev.parsed_answers(st.answers(spark, sf_dir))

    def labels(column):
        found = parsed.select("sample", F.explode_outer(column).alias("knob", "label"))
        return found.filter(F.col("knob").isNotNull())

    return labels("truth"), labels("pred")


@query("j4_truth_prediction", st.with_views(["pairs"], "SELECT sample, knob, truth_label, pred_label FROM pairs WHERE pred_label IS NOT NULL"))
def j4_truth_prediction(spark, sf_dir):
    return ev.paired_labels(*_long_labels(spark, sf_dir))


@query("j4_missing_predictions", """
SELECT 'shared_buffers' AS knob, count(*) AS n_missing FROM events WHERE event_type = 'view' HAVING count(*) > 0""")
def j4_missing_predictions(spark, sf_dir):
    missing = ev.missing_predictions(ev.parsed_answers(st.answers(spark, sf_dir)))
    return missing.groupBy("knob").agg(F.count(F.lit(1)).alias("n_missing"))


_SQL_COVERAGE = """coverage AS (SELECT coalesce(c.key, r.key) AS key, CASE WHEN c.key IS NOT NULL AND r.key IS NOT NULL THEN 'both' WHEN c.key IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
  FROM (SELECT DISTINCT c_custkey + 3 AS key FROM customer) c FULL OUTER JOIN (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') r ON c.key = r.key)"""


def _coverage(spark, sf_dir):
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    catalog = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 3).alias("key"))
    answer = table(spark, sf_dir, "orders").filter(urgent).select(F.col("o_custkey").alias("key"))
    return ev.key_coverage(catalog, answer, "key")


@query("j5_key_difference", f"WITH {_SQL_COVERAGE} SELECT key, status FROM coverage")
def j5_key_difference(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query("j5_coverage", f"""WITH {_SQL_COVERAGE} SELECT count(*) FILTER (WHERE status <> 'extra') AS n_catalog, count(*) FILTER (WHERE status <> 'missing') AS n_answer,
  count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'extra') AS n_extra,
  round(count(*) FILTER (WHERE status = 'both') * 100.0 / count(*) FILTER (WHERE status <> 'extra'), 6) AS coverage_pct FROM coverage""")
def j5_coverage(spark, sf_dir):
    out = ev.coverage_summary(_coverage(spark, sf_dir))
    return out.withColumn("coverage_pct", F.round("coverage_pct", 6))


# Fixed order of the transaction types a mix weighs.
MIX_TYPES = ["click", "error", "purchase", "signup", "view"]


def _mixes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shares = [
        (F.count_if(F.col("event_type") == t) * 100 / F.count(F.lit(1))).alias(t) for t in MIX_TYPES
    ]
    return events.groupBy(F.col("user_id").alias("workload")).agg(*shares).select(
        "workload", F.array(*MIX_TYPES).alias("weights")
    )


def _transactions(spark, sf_dir):
    place = F.array_position(F.array(*[F.lit(t) for t in MIX_TYPES]), F.col("event_type")) - 1
    per_type = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.min("value").alias("lo"), F.max("value").alias("top")
    )
    return per_type.select(place.cast("int").alias("pos"), F.array("n", "lo", "top").alias("features"))


_SQL_MIX = """mixes AS (SELECT user_id AS workload, [""" + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') * 100 / count(*)::DOUBLE" for t in MIX_TYPES
) + f"""] AS weights FROM events GROUP BY user_id),
long_mix AS (SELECT workload, weights, unnest({MIX_TYPES!r}) AS event_type, unnest(weights) AS w FROM mixes),
types AS (SELECT event_type, count(*)::DOUBLE AS n, min(value) AS lo, max(value) AS top FROM events GROUP BY event_type)"""


@query("j6_mix_positions", f"WITH {_SQL_MIX} SELECT workload, event_type, round(w, 9) AS weight, n FROM long_mix JOIN types USING (event_type)")
def j6_mix_positions(spark, sf_dir):
    weights = _mixes(spark, sf_dir).select("workload", F.posexplode("weights").alias("pos", "weight"))
    joined = weights.join(checked_broadcast(_transactions(spark, sf_dir)), "pos")
    kind = F.get(F.array(*[F.lit(t) for t in MIX_TYPES]), F.col("pos"))
    return joined.select("workload", kind.alias("event_type"), F.round("weight", 9).alias("weight"), F.col("features")[0].alias("n"))


# ---------------------------------------------------------------- aggregates

@query("a1_best_config", st.with_views(["runs"], f", {_SQL_BEST} SELECT workload, config_id, cost, run_ord FROM best"))
def a1_best_config(spark, sf_dir):
    return hi.best_runs(st.runs(spark, sf_dir))


_SQL_CAPPED = """capped AS (SELECT workload, config_id, run_ord, cost,
  CASE WHEN cost >= 0 THEN coalesce(max(CASE WHEN cost < 0 THEN cost END) OVER (PARTITION BY workload), -1.0) ELSE cost END AS capped FROM runs)"""


@query("a2_crash_cap", st.with_views(["runs"], f", {_SQL_CAPPED} SELECT config_id, workload, capped FROM capped"))
def a2_crash_cap(spark, sf_dir):
    return hi.crash_cap(st.runs(spark, sf_dir)).select("config_id", "workload", "capped")


@query("a3_scale_by_workload", st.with_views(["runs"], f""", {_SQL_CAPPED}
SELECT config_id, round((-capped - min(-capped) OVER w) / nullif(max(-capped) OVER w - min(-capped) OVER w, 0), 9) AS scaled FROM capped WINDOW w AS (PARTITION BY workload)"""))
def a3_scale_by_workload(spark, sf_dir):
    rows = hi.crash_cap(st.runs(spark, sf_dir)).select("workload", "config_id", (-F.col("capped")).alias("y"))
    return hi.scale_by_workload(rows, "y", ["config_id"]).select("config_id", F.round("scaled", 9).alias("scaled"))


@query("a4_scale_globally", st.with_views(["runs"], f""", {_SQL_CAPPED}, y AS (SELECT config_id, -capped AS y FROM capped), lim AS (SELECT min(y) AS lo, max(y) AS hi FROM y)
SELECT config_id, round((y - lo) / (hi - lo), 9) AS scaled FROM y, lim"""))
def a4_scale_globally(spark, sf_dir):
    rows = hi.crash_cap(st.runs(spark, sf_dir)).select("config_id", (-F.col("capped")).alias("y"))
    return hi.scale_globally(rows, "y").select("config_id", F.round("scaled", 9).alias("scaled"))


@query("a5_sample_counts", st.with_views(["runs"], "SELECT workload, count(*) AS n_samples FROM runs GROUP BY workload"))
def a5_sample_counts(spark, sf_dir):
    return hi.sample_counts(st.runs(spark, sf_dir))


@query("a6_workload_features", st.with_views(["files"], f", {SQL_FEATURES} SELECT workload, n_statements, "
       + ", ".join(f"round({c}, 9) AS {c}" for c in _RATIOS) + " FROM features"))
def a6_workload_features(spark, sf_dir):
    rows = ft.workload_features(st.workload_files(spark, sf_dir))
    return rows.select("workload", "n_statements", *[F.round(c, 9).alias(c) for c in ft.FEATURE_COLUMNS])


@query("a7_counter_rollup", """
SELECT l_suppkey, CAST(coalesce(sum(l_linenumber), 0) AS DOUBLE) AS l_linenumber, CAST(coalesce(sum(zero_tax), 0) AS DOUBLE) AS zero_tax,
  coalesce(sum(coalesce(l_quantity, 0) + coalesce(zero_tax, 0)), 0)::DOUBLE AS disk_read_count, coalesce(sum(coalesce(l_linenumber, 0)), 0)::DOUBLE AS disk_write_count,
  coalesce(sum(coalesce(l_quantity, 0) + coalesce(zero_tax, 0)), 0)::DOUBLE * 8192 AS disk_read_bytes, coalesce(sum(coalesce(l_linenumber, 0)), 0)::DOUBLE * 8192 AS disk_write_bytes
FROM (SELECT *, CASE WHEN l_tax = 0 THEN l_linenumber END AS zero_tax FROM lineitem) GROUP BY l_suppkey""")
def a7_counter_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "zero_tax", F.when(F.col("l_tax") == 0, F.col("l_linenumber"))
    )
    return ft.counter_rollup(rows, "l_suppkey", ["l_linenumber", "zero_tax"], ["l_quantity", "zero_tax"], ["l_linenumber"])


@query("a8_mix_features", f"""WITH {_SQL_MIX}, sums AS (SELECT workload, weights, sum(w / 100 * lo) AS lo, sum(w / 100 * top) AS top FROM long_mix JOIN types USING (event_type) GROUP BY workload, weights)
SELECT workload, list_transform([lo, top] || weights, lambda x: round(x, 6)) AS features FROM sums""")
def a8_mix_features(spark, sf_dir):
    out = ft.mix_features(_mixes(spark, sf_dir), _transactions(spark, sf_dir))
    return out.select("workload", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def _scored(spark, sf_dir):
    return ev.comparable(ev.knob_labels(ev.parsed_answers(st.answers(spark, sf_dir))))


@query("a9_answer_counters", """
SELECT count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS valid_samples, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS parse_errors FROM events""")
def a9_answer_counters(spark, sf_dir):
    return ev.answer_counters(ev.parsed_answers(st.answers(spark, sf_dir)))


@query("a9_accuracy", st.with_views(["pairs"], """
SELECT count(*) AS compared, count(*) FILTER (WHERE y_true = y_pred) AS correct, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM scored"""))
def a9_accuracy(spark, sf_dir):
    return ev.accuracy(_scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


_SQL_LABEL_SET = "label_set AS (SELECT y_true AS label FROM scored UNION SELECT y_pred FROM scored)"


@query("a10_confusion", st.with_views(["pairs"], f", {_SQL_LABEL_SET} SELECT label, "
       + ", ".join(f"count(*) FILTER (WHERE y_true = label AND y_pred = {i}) AS pred_{i}" for i in range(10))
       + " FROM label_set LEFT JOIN scored ON y_true = label GROUP BY label"))
def a10_confusion(spark, sf_dir):
    return ev.confusion_matrix(_scored(spark, sf_dir))


_SQL_REPORT = f"""{_SQL_LABEL_SET},
tallies AS (SELECT label, count(*) FILTER (WHERE y_true = label AND y_pred = label)::DOUBLE AS tp, count(*) FILTER (WHERE y_true = label) AS support, count(*) FILTER (WHERE y_pred = label) AS predicted
  FROM label_set, scored GROUP BY label),
rates AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM tallies),
report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates)"""


@query("a11_label_report", st.with_views(["pairs"], f", {_SQL_REPORT} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report"))
def a11_label_report(spark, sf_dir):
    out = ev.label_report(_scored(spark, sf_dir))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a11_report_averages", st.with_views(["pairs"], f", {_SQL_REPORT} SELECT "
       + ", ".join(f"round(avg({m}), 9) AS macro_{m}, round(sum({m} * support) / sum(support), 9) AS weighted_{m}" for m in ("precision", "recall", "f1"))
       + ", CAST(sum(support) AS BIGINT) AS support FROM report"))
def a11_report_averages(spark, sf_dir):
    out = ev.report_averages(ev.label_report(_scored(spark, sf_dir)))
    return out.select(*[c if c == "support" else F.round(c, 9).alias(c) for c in out.columns])


@query("a11_labels_report", """
WITH c AS (SELECT unnest([0, 1]) AS label), t AS (SELECT label, count(*) FILTER (WHERE toxic = label AND quality = label)::DOUBLE AS tp, count(*) FILTER (WHERE toxic = label) AS support, count(*) FILTER (WHERE quality = label) AS predicted FROM c, labels GROUP BY label),
r AS (SELECT label, support, tp / predicted AS p, tp / support AS r FROM t)
SELECT label, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, support FROM r""")
def a11_labels_report(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select(F.col("toxic").alias("y_true"), F.col("quality").alias("y_pred"))
    out = ev.label_report(scored)
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a12_r2_group_mean", """
WITH m AS (SELECT l_extendedprice AS y, avg(l_extendedprice) OVER (PARTITION BY l_quantity) AS p FROM lineitem)
SELECT count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) AS r2 FROM m""")
def a12_r2_group_mean(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("y"))
    predicted = with_group_stats(items, ["l_quantity"], [F.avg("y").alias("p")], ["l_orderkey", "l_linenumber"])
    return ev.r2(predicted, "y", "p").select("n", F.round("r2", 9).alias("r2"))


@query("a14_best_response", st.with_views(["results"], """,
top AS (SELECT run, name AS best_name, abs(qps) AS best_qps FROM results WHERE name <> 'default' QUALIFY row_number() OVER (PARTITION BY run ORDER BY abs(qps) DESC, name) = 1),
base AS (SELECT run, max(abs(qps)) AS default_qps FROM results WHERE name = 'default' GROUP BY run)
SELECT run, best_name, best_qps, default_qps, round(best_qps - default_qps, 6) AS gap, round((best_qps - default_qps) / default_qps * 100, 6) AS improvement_pct FROM top FULL JOIN base USING (run)"""))
def a14_best_response(spark, sf_dir):
    out = ev.best_against_default(st.results(spark, sf_dir))
    return out.withColumn("gap", F.round("gap", 6)).withColumn("improvement_pct", F.round("improvement_pct", 6))


@query("a15_replay_throughput", """
WITH g AS (SELECT user_id AS workload, count(*) AS n_statements, (max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE AS us, ceil(count(*) / 4.0::DOUBLE) * 4 AS len0 FROM events GROUP BY user_id)
SELECT workload, n_statements, us / 1000000 AS elapsed, n_statements / nullif(us, 0) * 1000000 AS qps, len0 / nullif(us, 0) * 1000000 AS qps_len0, -us / len0 / 1000000 AS neg_avg_time FROM g""")
def a15_replay_throughput(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    done = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("workload"), micros.alias("started"), micros.alias("ended")
    )
    second = 1000000
    return ft.replay_throughput(done, 4).select(
        "workload",
        "n_statements",
        (F.col("elapsed") / second).alias("elapsed"),
        (F.col("qps") * second).alias("qps"),
        (F.col("qps_len0") * second).alias("qps_len0"),
        (F.col("neg_avg_time") / second).alias("neg_avg_time"),
    )


@query("a17_label_set", st.with_views(["pairs"], f", {_SQL_LABEL_SET} SELECT label FROM label_set ORDER BY label"))
def a17_label_set(spark, sf_dir):
    return ev.label_set(_scored(spark, sf_dir))


# ---------------------------------------------------------------- windows, orders, unions

@query("w1_round_robin", st.with_views(["files"], f", {_SQL_REPLAY} SELECT workload, CAST(stmt_pos % 4 AS INTEGER) AS stream, count(*) AS n FROM replay GROUP BY ALL"))
def w1_round_robin(spark, sf_dir):
    streams = ft.assign_streams(ft.statements(st.workload_files(spark, sf_dir)), 4)
    return streams.groupBy("workload", "stream").agg(F.count(F.lit(1)).alias("n"))


@query("w3_incumbent_trace", st.with_views(["runs"], """
SELECT workload, run_ord, min(cost) OVER (PARTITION BY workload ORDER BY run_ord ROWS UNBOUNDED PRECEDING) AS best_so_far,
  coalesce(cost < min(cost) OVER (PARTITION BY workload ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM runs"""))
def w3_incumbent_trace(spark, sf_dir):
    return hi.incumbent_trace(st.runs(spark, sf_dir)).select("workload", "run_ord", "best_so_far", "improved")


@query("w3_incumbent_changes", st.with_views(["runs"], """,
t AS (SELECT workload, cost, min(cost) OVER (PARTITION BY workload ORDER BY run_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs)
SELECT workload, count(*) FILTER (WHERE cost < before) AS inc_changed, min(cost) AS best_cost FROM t GROUP BY workload"""))
def w3_incumbent_changes(spark, sf_dir):
    return hi.incumbent_changes(st.runs(spark, sf_dir))


_SQL_FOLDS = """hashed AS (SELECT workload, md5(workload || ':42') AS h FROM (SELECT DISTINCT workload FROM runs)),
folds AS (SELECT workload, CAST(ntile(10) OVER (ORDER BY h) - 1 AS INTEGER) AS fold FROM hashed)"""


@query("w4_workload_folds", st.with_views(["runs"], f", {_SQL_FOLDS} SELECT workload, fold FROM folds"))
def w4_workload_folds(spark, sf_dir):
    return sp.workload_folds(st.runs(spark, sf_dir))


@query("w5_holdout", st.with_views(["runs"], """, names AS (SELECT DISTINCT workload FROM runs), draws AS (SELECT unnest([0, 1, 2]) AS repeat)
SELECT workload, repeat FROM names, draws QUALIFY row_number() OVER (PARTITION BY repeat ORDER BY md5(workload || ':42:' || repeat::VARCHAR)) <= 7"""))
def w5_holdout(spark, sf_dir):
    runs = st.runs(spark, sf_dir)
    out = sp.holdout_workloads(runs, 0)
    for repeat in (1, 2):
        out = out.unionByName(sp.holdout_workloads(runs, repeat))
    return out


@query("w6_hash_split", """
SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 8))::BIGINT % 100 < 90 THEN 'train' ELSE 'test' END AS split FROM documents""")
def w6_hash_split(spark, sf_dir):
    return sp.hash_split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("w6_exact_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || ':42')) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS split FROM orders""")
def w6_exact_split(spark, sf_dir):
    return sp.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("w7_result_order", st.with_views(["results"], "SELECT run, name, qps FROM results ORDER BY name, run"))
def w7_result_order(spark, sf_dir):
    return st.results(spark, sf_dir).orderBy("name", "run")


@query("w7_order_by_qps", st.with_views(["results"], """
SELECT run, name, qps, CAST(rank() OVER (PARTITION BY run ORDER BY abs(qps) DESC) AS INTEGER) AS rank FROM results ORDER BY abs(qps) DESC, run, name"""))
def w7_order_by_qps(spark, sf_dir):
    """Results of all runs from the fastest on, with their rank in the run."""
    return ev.ranked_runs(st.results(spark, sf_dir)).orderBy(F.abs("qps").desc(), "run", "name")


@query("l3_workload_slice", st.with_views(["runs"], """
SELECT workload, CAST(row_number() OVER (ORDER BY workload) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT workload FROM runs) QUALIFY position BETWEEN 17 AND 99"""))
def l3_workload_slice(spark, sf_dir):
    return sp.workload_slice(st.runs(spark, sf_dir), 17, 100)


@query("u1_union_families", st.with_views(["runs"], """
SELECT split_part(workload, '/', 3) AS benchmark, count(*) AS n_runs, count(DISTINCT workload) AS n_workloads FROM runs GROUP BY 1"""))
def u1_union_families(spark, sf_dir):
    marked = hi.with_family(st.runs(spark, sf_dir), st.FAMILIES)
    return marked.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("workload").alias("n_workloads")
    )


# ---------------------------------------------------------------- records and prompts

_SQL_METRICS_JSON = "'{' || chr(10) || " + " || ',' || chr(10) || ".join(
    f"'  \"{n}\": ' || CAST(inner_metrics[{i + 1}] AS BIGINT)::VARCHAR || '.0'" for i, n in enumerate(METRIC_NAMES)
) + " || chr(10) || '}'"


def _sql_label_json() -> str:
    lines = []
    for k in knob_records():
        label = st.sql_range_label(st.sql_bucket(st.sql_clip(k.knob, f"{k.min:.1f}::DOUBLE", f"{k.max:.1f}::DOUBLE")))
        lines.append(f"'  \"{k.knob}\": \"' || {label} || '\"'")
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(lines) + " || chr(10) || '}'"


_SQL_META = "split_part(workload, '/', 3) AS database, replace(split_part(workload, '/', 4), '.xml', '') AS workload_name"


def _flat_meta(records: DataFrame) -> DataFrame:
    return records.select("*", "meta.*").drop("meta")


@query("t1_build_samples", st.with_views(["runs", "configs", "metrics"], """,
kept AS (SELECT * FROM runs WHERE config_id IN (SELECT config_id FROM configs)),
caps AS (SELECT workload, config_id, CASE WHEN cost >= 0 THEN coalesce(max(CASE WHEN cost < 0 THEN cost END) OVER (PARTITION BY workload), -1.0) ELSE cost END AS capped FROM kept)
SELECT workload, config_id, -capped AS throughput, CASE WHEN capped <> 0 THEN 1.0::DOUBLE / -capped ELSE 0.0 END AS inverse, work_mem, shared_buffers,
  coalesce(len(inner_metrics), 0) AS n_metrics FROM caps JOIN configs USING (config_id) LEFT JOIN metrics USING (workload)"""))
def t1_build_samples(spark, sf_dir):
    samples = hi.build_samples(st.runs(spark, sf_dir), st.configs(spark, sf_dir), st.metrics(spark, sf_dir))
    return samples.select(
        "workload", "config_id", F.col("y")[0].alias("throughput"), F.col("y")[1].alias("inverse"),
        "work_mem", "shared_buffers", F.size("inner_metrics").alias("n_metrics"),
    )


def best_records(spark, sf_dir):
    """The best runs are found first and written, a row per workload; only their configurations are drawn."""
    knobs, best = knob_records(), written(hi.best_runs(st.runs(spark, sf_dir)), "best-runs")
    configs = st.configs(spark, sf_dir, only=best)
    return rc.build_best_records(best, configs, st.metrics(spark, sf_dir), [k.knob for k in knobs], knobs)


@query("t2_best_records", st.with_views(["runs", "configs", "metrics"], f""", {_SQL_BEST}
SELECT {_quoted(BEST_INSTRUCTION)} AS instruction, {_SQL_METRICS_JSON} AS input, {_sql_label_json()} AS output, {_SQL_META}
FROM best JOIN configs USING (config_id) JOIN metrics USING (workload)"""))
def t2_best_records(spark, sf_dir):
    return _flat_meta(best_records(spark, sf_dir))


def samples(spark, sf_dir):
    return hi.build_samples(st.runs(spark, sf_dir), st.configs(spark, sf_dir), st.metrics(spark, sf_dir))


@query("t3_sample_records", st.with_views(["runs", "configs", "metrics"], f"""
SELECT {_quoted(SYSTEM_TEXT)} AS system, {_quoted(INSTRUCTION_TEXT)} AS instruction, {_SQL_METRICS_JSON} AS input, {_sql_label_json()} AS output, config_id, {_SQL_META}
FROM runs JOIN configs USING (config_id) JOIN metrics USING (workload)"""))
def t3_sample_records(spark, sf_dir):
    return _flat_meta(rc.build_sample_records(samples(spark, sf_dir), knob_records()))


def _three_increments(spark, sf_dir):
    """The runs in three increments of histories, the second one added twice."""
    store = SampleStore(spark, scratch_path(spark, "increments"), knob_records())
    runs, configs, counters = st.runs(spark, sf_dir), st.configs(spark, sf_dir), st.metrics(spark, sf_dir)
    for nth in (0, 1, 1, 2):
        part = F.floor(F.pmod(F.col("config_id").cast("long"), F.lit(9)) / 3) == nth
        store.add(f"increment-{nth}", runs.filter(part), configs.filter(part), counters)
    return store, counters


@query("t1_incremental_samples", CHECKS["t1_build_samples"])
def t1_incremental_samples(spark, sf_dir):
    store, counters = _three_increments(spark, sf_dir)
    return store.samples(counters).select(
        "workload", "config_id", F.col("y")[0].alias("throughput"), F.col("y")[1].alias("inverse"),
        "work_mem", "shared_buffers", F.size("inner_metrics").alias("n_metrics"),
    )


@query("t2_incremental_records", CHECKS["t2_best_records"])
def t2_incremental_records(spark, sf_dir):
    return _flat_meta(_three_increments(spark, sf_dir)[0].best_records())


@query("t3_incremental_records", CHECKS["t3_sample_records"])
def t3_incremental_records(spark, sf_dir):
    store, counters = _three_increments(spark, sf_dir)
    return _flat_meta(rc.build_sample_records(store.samples(counters).drop("run_ord"), knob_records()))


@query("u2_merge_records", st.with_views(["runs", "configs", "metrics"], f""", {_SQL_BEST}
SELECT {_quoted(SYSTEM_TEXT)} AS system, {_quoted(INSTRUCTION_TEXT)} AS instruction, older, count(*) AS n_records FROM (
  SELECT true AS older FROM best JOIN configs USING (config_id) JOIN metrics USING (workload)
  UNION ALL SELECT false FROM runs JOIN configs USING (config_id) JOIN metrics USING (workload)) GROUP BY older"""))
def u2_merge_records(spark, sf_dir):
    merged = rc.merge_records(best_records(spark, sf_dir), rc.build_sample_records(samples(spark, sf_dir), knob_records()))
    older = F.col("config_id").isNull().alias("older")
    return merged.groupBy("system", "instruction", older).agg(F.count(F.lit(1)).alias("n_records"))


@query("t4_merge_and_split", st.with_views(["runs", "configs", "metrics"], f""", {_SQL_BEST},
merged AS (SELECT 'best:' || workload AS record_key FROM best JOIN configs USING (config_id) JOIN metrics USING (workload)
  UNION ALL SELECT config_id FROM runs JOIN configs USING (config_id) JOIN metrics USING (workload))
SELECT record_key, {_quoted(SYSTEM_TEXT)} AS system, {_quoted(INSTRUCTION_TEXT)} AS instruction,
  CASE WHEN ('0x' || substr(md5(record_key || ':42'), 1, 8))::BIGINT % 100 < 90 THEN 'train' ELSE 'test' END AS split FROM merged"""))
def t4_merge_and_split(spark, sf_dir):
    def path(meta):
        return F.concat(F.lit("./oltp_workloads/"), meta["database"], F.lit("/"), meta["workload_name"], F.lit(".xml"))

    existing = best_records(spark, sf_dir).withColumn("record_key", F.concat(F.lit("best:"), path(F.col("meta"))))
    new = rc.build_sample_records(samples(spark, sf_dir), knob_records()).withColumnRenamed("config_id", "record_key")
    return rc.merge_and_split(existing, new, ["record_key"]).select("record_key", "system", "instruction", "split")


@query("t5_chat_template", f"""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{CHAT_START}system' || chr(10) || 'Be brief.' || '{CHAT_END}' || chr(10) ELSE '' END
  || '{CHAT_START}user' || chr(10) || role || chr(10) || text || '{CHAT_END}' || chr(10) || '{CHAT_START}assistant' || chr(10) AS prompt FROM conversations""")
def t5_chat_template(spark, sf_dir):
    records = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.lit("Be brief.")).alias("system"),
        F.col("role").alias("instruction"), F.col("text").alias("input"),
    )
    return rc.chat_prompts(records).select("conv_id", "turn", "prompt")


@query("t5_conversation_text", f"""
SELECT conv_id, count(*) AS n_turns, string_agg('{CHAT_START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CHAT_END}' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
  || CASE WHEN coalesce(last(role ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') = 'assistant' THEN '' ELSE '{CHAT_START}assistant' || chr(10) END AS prompt
FROM conversations GROUP BY conv_id""")
def t5_conversation_text(spark, sf_dir):
    return rc.conversation_prompts(table(spark, sf_dir, "conversations"))


@query("l1_global_order", st.with_views(["results"], """
SELECT run, name, qps, row_number() OVER (ORDER BY abs(qps) DESC, run, name) - 1 AS place FROM results"""))
def l1_global_order(spark, sf_dir):
    """The exact place of every result among those of all runs, the fastest first."""
    return value_rank(st.results(spark, sf_dir), [F.abs("qps").desc(), F.col("run"), F.col("name")], "place")


@query("l3_sample_slice", st.with_views(["runs"], """
SELECT workload, config_id, place FROM (SELECT workload, config_id, row_number() OVER (ORDER BY workload, cost, run_ord) - 1 AS place, count(*) OVER () AS n FROM runs) WHERE place BETWEEN n // 4 AND n // 2"""))
def l3_sample_slice(spark, sf_dir):
    """The second quarter of all runs in the order of workload and cost; a slice from the middle needs no head to be ranked."""
    ranked = value_rank(st.runs(spark, sf_dir), [F.col("workload"), F.col("cost"), F.col("run_ord")], "place")
    n = F.lit(table(spark, sf_dir, "events").count())
    return ranked.filter(F.col("place").between(F.floor(n / 4), F.floor(n / 2))).select("workload", "config_id", "place")


_SQL_METRICS_TEXT = " || ".join(
    f"'{n}: ' || {sql_humanize_metric(f'inner_metrics[{i + 1}]')} || '; '" for i, n in enumerate(METRIC_NAMES)
)


def _document_inputs(spark, sf_dir):
    """Features, plan texts and counters of every document: the plan and the counters come from its columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    plan = st.plan_text(F.col("n_chars").cast("double"), F.get(F.array(*[F.lit(p) for p in st.PRIORITIES]), (F.col("doc_id") % 5).cast("int")))
    texts = pt.plan_texts(docs.select(key.alias("plan_id"), plan.alias("text"))).select(
        F.col("plan_id").alias("workload"), F.array("plan_text", "plan_text").alias("plans")
    )
    steps = [F.col("n_chars") * (i + 1) for i in range(len(METRIC_NAMES))]
    counters = docs.select(key.alias("workload"), F.array(*steps).cast("array<double>").alias("inner_metrics"))
    return ft.workload_features(st.workload_files(spark, sf_dir)), texts, counters


def _sql_shape(indent: str = "") -> str:
    """Plan texts of the shapes of the `nodes` view, spelled out by priority."""
    p = "o_totalprice"

    def h(total, startup):
        return sql_humanize_cost(f"({total} - {startup})")

    hashed = f"'hash(index scan, ' || {h(f'{p} / 4', f'{p} / 8')} || ')'"
    join = f"'hash join(seq scan, ' || {hashed} || ', ' || {h(f'{p} * 2', f'{p} / 4')} || ')'"
    sort = f"'sort(seq scan, ' || {h(f'({p} / 2 + 500)', f'{p} / 2')} || ')'"
    inner = f"'sort(' || {join} || ', ' || {h(f'({p} * 2 + 1000)', f'{p} * 2')} || ')'"
    agg = f"'aggregate(' || {inner} || ', ' || {h(f'{p} * 16', p)} || ')'"
    return (
        f"CASE o_orderpriority WHEN '1-URGENT' THEN 'seq scan' WHEN '2-HIGH' THEN {sort} "
        f"WHEN '3-MEDIUM' THEN {join} ELSE {agg} END"
    )


@query("t6_analytic_prompt", st.with_views(["files"], f""", {SQL_FEATURES},
shaped AS (SELECT doc_id, n_chars::DOUBLE AS o_totalprice, {st.PRIORITIES!r}[doc_id % 5 + 1] AS o_orderpriority FROM documents),
texts AS (SELECT 'doc_' || doc_id::VARCHAR AS workload, {_sql_shape()} AS plan_text FROM shaped),
named AS (SELECT 'doc_' || doc_id::VARCHAR AS workload, [x * n_chars::DOUBLE FOR x IN range(1, {len(METRIC_NAMES) + 1})] AS inner_metrics FROM documents)
SELECT workload, {_quoted(PROMPT_HEAD)} || {_quoted(PROMPT_FEATURES)} || {_SQL_FEATURE_TEXT} || {_quoted(PROMPT_PLANS)} || plan_text || '; ' || plan_text
  || {_quoted(PROMPT_METRICS)} || {_SQL_METRICS_TEXT} AS prompt FROM features JOIN texts USING (workload) JOIN named USING (workload)"""))
def t6_analytic_prompt(spark, sf_dir):
    return rc.analytic_prompts(*_document_inputs(spark, sf_dir))


@query("t7_transactional_prompt", st.with_views(["runs", "all_metrics"], f""", q AS (SELECT workload, -min(cost) AS qps FROM runs GROUP BY workload)
SELECT workload, {_quoted(SYSTEM_TEXT)} AS system, {_quoted(INSTRUCTION_TEXT)} AS instruction, {_SQL_METRICS_TEXT} AS input, {_SQL_META}, qps FROM metrics JOIN q USING (workload)"""))
def t7_transactional_prompt(spark, sf_dir):
    best = hi.best_runs(st.runs(spark, sf_dir)).select("workload", (-F.col("cost")).alias("qps"))
    rows = hi.best_with_metrics(best, st.metrics(spark, sf_dir, every=True))
    return _flat_meta(rc.transactional_prompts(rows, tx.workload_database(F.col("workload")), F.col("qps")))


# ---------------------------------------------------------------- plans

@query("v1_plan_nodes", st.with_views(["nodes"], "SELECT plan_id, node_path, parent_path, ordinal, depth, node_type, startup_cost, total_cost FROM nodes"))
def v1_plan_nodes(spark, sf_dir):
    return pt.plan_nodes(st.plans(spark, sf_dir))


@query("v1_subtree_costs", st.with_views(["nodes"], """,
alone AS (SELECT n.plan_id, n.node_path, n.parent_path, n.total_cost::DECIMAL(18, 6) - coalesce(c.total, 0) AS own, c.total IS NULL AS leaf
  FROM nodes n LEFT JOIN (SELECT plan_id, parent_path, sum(total_cost::DECIMAL(18, 6)) AS total FROM nodes GROUP BY ALL) c ON c.plan_id = n.plan_id AND c.parent_path = n.node_path),
ways AS (
  SELECT plan_id, node_path, node_path AS above, parent_path AS next FROM alone
  UNION ALL
  SELECT w.plan_id, w.node_path, a.node_path, a.parent_path FROM ways w JOIN alone a ON a.plan_id = w.plan_id AND a.node_path = w.next),
up AS (SELECT w.plan_id, w.node_path, count(*) - 1 AS depth, sum(a.own) AS path_cost FROM ways w JOIN alone a ON a.plan_id = w.plan_id AND a.node_path = w.above GROUP BY ALL),
below AS (SELECT w.plan_id, w.above AS node_path, count(*) AS n_below, sum(a.own) AS cost_below FROM ways w JOIN alone a ON a.plan_id = w.plan_id AND a.node_path = w.node_path GROUP BY ALL),
ends AS (SELECT plan_id, node_path FROM up JOIN alone USING (plan_id, node_path) WHERE leaf
  QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY path_cost DESC, node_path) = 1),
way AS (SELECT w.plan_id, w.above AS node_path FROM ways w JOIN ends USING (plan_id, node_path))
SELECT plan_id, node_path, depth, own::DOUBLE AS own_cost, n_below, cost_below::DOUBLE AS cost_below, path_cost::DOUBLE AS path_cost, way.node_path IS NOT NULL AS critical
FROM alone JOIN up USING (plan_id, node_path) JOIN below USING (plan_id, node_path) LEFT JOIN way USING (plan_id, node_path)""").replace("WITH ", "WITH RECURSIVE ", 1))
def v1_subtree_costs(spark, sf_dir):
    """Nodes of all plans as one table: costs alone, below and on the way, and the critical path of each plan."""
    nodes = pt.plan_nodes(st.plans(spark, sf_dir)).select(F.col("plan_id").alias("tree"), F.col("node_path").alias("node"), F.col("parent_path").alias("parent"), F.round("total_cost", 6).alias("total_cost"))
    costs = subtree_costs(written(nodes, "plan-nodes"))
    own, below, way = (F.col(c).cast("double").alias(c) for c in ("own_cost", "cost_below", "path_cost"))
    return costs.select(F.col("tree").alias("plan_id"), F.col("node").alias("node_path"), "depth", own, "n_below", below, way, "critical")


@query("v2_plan_self_cost", st.with_views(["nodes"], "SELECT plan_id, round(sum(total_cost - startup_cost), 5) AS self_cost, CAST(max(depth) AS INTEGER) AS depth, count(*) AS n_nodes FROM nodes GROUP BY plan_id"))
def v2_plan_self_cost(spark, sf_dir):
    nodes = pt.plan_nodes(st.plans(spark, sf_dir))
    return nodes.groupBy("plan_id").agg(
        F.round(F.sum(pt.self_cost()), 5).alias("self_cost"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_nodes")
    )


@query("v3_plan_text", f"SELECT o_orderkey AS plan_id, {_sql_shape()} AS plan_text FROM orders")
def v3_plan_text(spark, sf_dir):
    return pt.plan_texts(st.plans(spark, sf_dir))


@query("v3_plan_text_from_nodes", f"SELECT o_orderkey AS plan_id, {_sql_shape()} AS plan_text FROM orders")
def v3_plan_text_from_nodes(spark, sf_dir):
    return pt.plan_texts_from_nodes(pt.plan_nodes(st.plans(spark, sf_dir)))


@query("v4_plan_profile", st.with_views(["nodes"], """, t AS (SELECT o_orderstatus, node_type, count(*) AS n_nodes, sum(total_cost - startup_cost) AS cost FROM nodes GROUP BY ALL)
SELECT o_orderstatus, node_type, n_nodes, round(cost, 0) AS cost, round(cost / sum(cost) OVER (PARTITION BY o_orderstatus), 9) AS cost_share FROM t"""))
def v4_plan_profile(spark, sf_dir):
    nodes = pt.plan_nodes(st.plans(spark, sf_dir), ["o_orderstatus"])
    out = pt.plan_profile(nodes, ["o_orderstatus"])
    return out.select("o_orderstatus", "node_type", "n_nodes", F.round("cost", 0).alias("cost"), F.round("cost_share", 9).alias("cost_share"))


# ---------------------------------------------------------------- evaluation of runs

@query("r2_compare_runs", st.with_views(["results"], """, base AS (SELECT run, max(abs(qps)) AS default_qps FROM results WHERE name = 'default' GROUP BY run)
SELECT run, name, abs(qps) AS qps, default_qps, round((abs(qps) - default_qps) / default_qps * 100, 6) AS improvement_pct,
  CAST(rank() OVER (PARTITION BY run ORDER BY abs(qps) DESC) AS INTEGER) AS rank FROM results JOIN base USING (run) WHERE name <> 'default'"""))
def r2_compare_runs(spark, sf_dir):
    compared = ev.ranked_runs(ev.compare_runs(st.results(spark, sf_dir)))
    return compared.withColumn("improvement_pct", F.round("improvement_pct", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
