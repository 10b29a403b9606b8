"""Telemetry views derived from the given tables, and the same views as SQL.

The telemetry files (histories, counters, plans, answers) are not among the given
tables. Each view below is computed from whole tables, so its size follows them.
`SQL` holds the matching common table expressions for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.catalog import Knob, knob_records
from tunelake.constants import BLOCK_BYTES, CRASH_COST, METRIC_NAMES
from tunelake.functions.labels import bucket_label
from tunelake.functions.scaling import bucket, normalize_clip
from tunelake.operators.surrogate import drawn_knobs
from tunelake.plans.tables import table

FAMILIES = ["ycsb", "tpcc", "smallbank", "twitter", "wikipedia"]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows by the key that later joins and groups use, before wide texts and values are made of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def prop_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def family_of(user: Column) -> Column:
    return F.get(F.array(*[F.lit(f) for f in FAMILIES]), (user % len(FAMILIES)).cast("int"))


def workload_of(user: Column) -> Column:
    family = family_of(user)
    return F.concat(
        F.lit("./oltp_workloads/"), family, F.lit("/sample_"), family, F.lit("_config"),
        user.cast("string"), F.lit(".xml"),
    )


def runs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """One run per event, with the kept columns of the event; an error event is a crashed run."""
    cost = F.when(F.col("event_type") == "error", F.lit(CRASH_COST)).otherwise(-F.col("value"))
    events = table(spark, sf_dir, "events")
    return events.select(
        workload_of(F.col("user_id")).alias("workload"),
        F.col("event_id").alias("run_ord"),
        F.col("event_id").cast("string").alias("config_id"),
        cost.alias("cost"),
        *keep,
    )


def configs(spark: SparkSession, sf_dir: str, catalog: list[Knob] | None = None, only: DataFrame | None = None) -> DataFrame:
    """One configuration per event, drawn from its id; events with k = 0 have none. With `only`, those of its (workload, config_id)."""
    keyed = (
        table(spark, sf_dir, "events")
        .filter(prop_k(F.col("props")) != 0)
        .select(workload_of(F.col("user_id")).alias("workload"), F.col("event_id").cast("string").alias("config_id"))
    )
    if only is not None:
        keyed = keyed.join(only, ["workload", "config_id"], "left_semi")
    return dealt(keyed, "workload", "config_id").select("workload", "config_id", *drawn_knobs("config_id", catalog or knob_records()))


def metrics(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Counters per workload; unless `every` is set, users divisible by 10 have no counter file."""
    k, value, kind = F.col("k"), F.col("value"), F.col("event_type")
    events = table(spark, sf_dir, "events").withColumn("k", prop_k(F.col("props")))
    sums = [
        F.count_if(kind != "error"),
        F.count_if(kind == "error"),
        F.sum(k) * 1000,
        F.sum(k * k) * 10000,
        F.sum("event_id"),
        F.sum(F.floor(value)),
        F.count_if(kind == "signup"),
        F.lit(0),
        F.count_if(kind == "purchase"),
        F.count_if(kind == "view"),
        F.sum(k),
        F.sum(F.floor(value * 10)),
        F.sum(k) * BLOCK_BYTES,
        F.sum(F.floor(value * 10)) * BLOCK_BYTES,
    ]
    per_user = (events if every else events.filter(F.col("user_id") % 10 != 0)).groupBy("user_id").agg(
        *[s.cast("double").alias(n) for s, n in zip(sums, METRIC_NAMES)]
    )
    return per_user.select(
        workload_of(F.col("user_id")).alias("workload"),
        F.array(*METRIC_NAMES).alias("inner_metrics"),
    )


def workload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement file per document: two statements made of its columns, then its text."""
    head = F.concat(
        F.lit("SELECT COUNT(*) FROM docs WHERE lang = '"), F.col("lang"),
        F.lit("' AND n_chars > "), F.col("n_chars").cast("string"), F.lit(";\n"),
    )
    even = F.lit("-- note\nSELECT source, SUM(n_chars) FROM docs GROUP BY source ORDER BY source;\n")
    odd = F.lit("WITH d AS (SELECT 1) SELECT MAX(n_chars) FROM d WHERE a = 1 OR b BETWEEN 2 AND 3;\n")
    middle = F.when(F.col("n_chars") % 2 == 0, even).otherwise(odd)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("workload"),
        F.concat(head, middle, F.col("text")).alias("text"),
    )


def _node(kind: str, startup: Column, total: Column, *children: Column) -> Column:
    def number(c):
        return c.cast("string")

    parts = [F.lit(f'{{"Node Type":"{kind}","Startup Cost":'), number(startup), F.lit(',"Total Cost":'), number(total)]
    if children:
        parts.append(F.lit(',"Plans":['))
        for i, child in enumerate(children):
            parts += ([F.lit(",")] if i else []) + [child]
        parts.append(F.lit("]"))
    return F.concat(*parts, F.lit("}"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def plan_text(p: Column, priority: Column) -> Column:
    """A plan whose shape follows a priority and whose costs follow a price."""
    zero = F.lit(0.0)
    leaf = _node("Seq Scan", zero, p)
    hashed = _node("Hash", p / 8, p / 4, _node("Index Scan", zero, p / 8))
    join = _node("Hash Join", p / 4, p * 2, leaf, hashed)
    return (
        F.when(priority == "1-URGENT", leaf)
        .when(priority == "2-HIGH", _node("Sort", p / 2, p / 2 + 500, leaf))
        .when(priority == "3-MEDIUM", join)
        .otherwise(_node("Aggregate", p, p * 16, _node("Sort", p * 2, p * 2 + 1000, join)))
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan per order."""
    text = plan_text(F.col("o_totalprice"), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return dealt(orders, "plan_id").select("plan_id", "o_orderstatus", text.alias("text"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model answer per event, with noise, gaps and unreadable texts by event type."""
    k, event, kind = F.col("k").cast("double"), F.col("sample"), F.col("event_type")

    def label(position):
        return bucket_label(bucket(position))

    true_mem = label(normalize_clip(k, 0.0, 100.0))
    true_buf = label(normalize_clip(F.col("value"), 0.0, 200.0))
    pred_mem = label(normalize_clip(k + event % 10, 0.0, 110.0))
    pred_buf = label(normalize_clip(F.col("value") + event % 7, 0.0, 200.0))

    def both(mem, buf):
        return F.concat(F.lit('{"work_mem": "'), mem, F.lit('", "shared_buffers": "'), buf, F.lit('"}'))

    text = (
        F.when(kind == "error", F.lit("I cannot tell."))
        .when(kind == "signup", F.lit("Settings: {}"))
        .when(kind == "view", F.concat(F.lit('Sure. {"work_mem": "'), pred_mem, F.lit('"} Done.')))
        .when(kind == "purchase", both(F.lit("middle"), pred_buf))
        .otherwise(F.concat(F.lit("Here it is:\n"), both(pred_mem, pred_buf), F.lit("\nGood luck")))
    )
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample"), "event_type", "value", prop_k(F.col("props")).alias("k"))
    return dealt(events, "sample").select(
        "sample", both(true_mem, true_buf).alias("truth_text"), text.alias("answer_text")
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lists per customer: its oldest kind of order is the default, the others answers."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"),
        F.when(F.col("o_orderstatus") == "F", F.lit("default"))
        .otherwise(F.concat(F.lit("response_"), F.col("o_orderkey").cast("string"), F.lit(".json")))
        .alias("name"),
        (-F.col("o_totalprice")).alias("qps"),
    )


def _sql_uniform(key: str, i: int) -> str:
    return (
        f"(('0x' || substr(md5({key} || ':{i // 4}'), {1 + 8 * (i % 4)}, 8))::BIGINT::DOUBLE / 4294967296.0)"
    )


def _number(x: float) -> str:
    return f"{x:.1f}::DOUBLE"


def sql_knob(key: str, i: int, knob: Knob) -> str:
    value = f"({_sql_uniform(key, i)} * {_number(knob.max - knob.min)} + {_number(knob.min)})"
    return f"trunc({value})" if knob.type == "integer" else value


def sql_bucket(position: str) -> str:
    return f"CAST(least(floor({position} * 100 / 10), 9) AS INTEGER)"


def sql_clip(value: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN {hi} = {lo} THEN 0.0 ELSE (least(greatest({value}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) END)"


def sql_range_label(decile: str) -> str:
    return f"(({decile}) * 10)::VARCHAR || '-' || (({decile}) * 10 + 10)::VARCHAR || '%'"


_SQL_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_SQL_FAMILY = "(['ycsb','tpcc','smallbank','twitter','wikipedia'])[(user_id % 5 + 1)::INT]"
_SQL_WORKLOAD = (
    f"'./oltp_workloads/' || {_SQL_FAMILY} || '/sample_' || {_SQL_FAMILY} || '_config' || user_id::VARCHAR || '.xml'"
)


def _sql_label(position: str) -> str:
    return sql_range_label(sql_bucket(position))


SQL = {
    "runs": f"""runs AS (
  SELECT {_SQL_WORKLOAD} AS workload, event_id AS run_ord, event_id::VARCHAR AS config_id,
         CASE WHEN event_type = 'error' THEN 2147483647.0::DOUBLE ELSE -value END AS cost
  FROM events)""",
    "configs": "configs AS (\n  SELECT event_id::VARCHAR AS config_id,\n    "
    + ",\n    ".join(
        f"{sql_knob('event_id::VARCHAR', i, k)} AS {k.knob}" for i, k in enumerate(knob_records())
    )
    + f"\n  FROM events WHERE {_SQL_K} <> 0)",
    "metrics": f"""metrics AS (
  SELECT {_SQL_WORKLOAD} AS workload, [c1::DOUBLE, c2, c3, c4, c5, c6, c7, 0, c9, c10, c11, c12, c11 * 8192, c12 * 8192] AS inner_metrics
  FROM (SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS c1,
      count(*) FILTER (WHERE event_type = 'error') AS c2, sum(k) * 1000 AS c3, sum(k * k) * 10000 AS c4,
      sum(event_id) AS c5, sum(floor(value)) AS c6, count(*) FILTER (WHERE event_type = 'signup') AS c7,
      count(*) FILTER (WHERE event_type = 'purchase') AS c9, count(*) FILTER (WHERE event_type = 'view') AS c10,
      sum(k) AS c11, sum(floor(value * 10)) AS c12
    FROM (SELECT *, {_SQL_K} AS k FROM events) WHERE user_id % 10 <> 0 GROUP BY user_id))""",
    "files": """files AS (
  SELECT 'doc_' || doc_id::VARCHAR AS workload,
    'SELECT COUNT(*) FROM docs WHERE lang = ''' || lang || ''' AND n_chars > ' || n_chars::VARCHAR || ';' || chr(10)
    || CASE WHEN n_chars % 2 = 0
      THEN '-- note' || chr(10) || 'SELECT source, SUM(n_chars) FROM docs GROUP BY source ORDER BY source;' || chr(10)
      ELSE 'WITH d AS (SELECT 1) SELECT MAX(n_chars) FROM d WHERE a = 1 OR b BETWEEN 2 AND 3;' || chr(10) END
    || text AS text
  FROM documents)""",
    "nodes": """shapes AS (
  SELECT * FROM (VALUES
    ('1', '0', NULL, 0, 0, 'Seq Scan', 0.0, 0.0, 1.0, 0.0),
    ('2', '0', NULL, 0, 0, 'Sort', 0.5, 0.0, 0.5, 500.0), ('2', '0.0', '0', 0, 1, 'Seq Scan', 0.0, 0.0, 1.0, 0.0),
    ('3', '0', NULL, 0, 0, 'Hash Join', 0.25, 0.0, 2.0, 0.0), ('3', '0.0', '0', 0, 1, 'Seq Scan', 0.0, 0.0, 1.0, 0.0),
    ('3', '0.1', '0', 1, 1, 'Hash', 0.125, 0.0, 0.25, 0.0), ('3', '0.1.0', '0.1', 0, 2, 'Index Scan', 0.0, 0.0, 0.125, 0.0),
    ('x', '0', NULL, 0, 0, 'Aggregate', 1.0, 0.0, 16.0, 0.0), ('x', '0.0', '0', 0, 1, 'Sort', 2.0, 0.0, 2.0, 1000.0),
    ('x', '0.0.0', '0.0', 0, 2, 'Hash Join', 0.25, 0.0, 2.0, 0.0), ('x', '0.0.0.0', '0.0.0', 0, 3, 'Seq Scan', 0.0, 0.0, 1.0, 0.0),
    ('x', '0.0.0.1', '0.0.0', 1, 3, 'Hash', 0.125, 0.0, 0.25, 0.0), ('x', '0.0.0.1.0', '0.0.0.1', 0, 4, 'Index Scan', 0.0, 0.0, 0.125, 0.0)
  ) AS s(shape, node_path, parent_path, ordinal, depth, node_type, sf, sa, tf, ta)),
nodes AS (
  SELECT o_orderkey AS plan_id, o_orderstatus, node_path, parent_path, ordinal, depth, node_type,
    o_totalprice * sf::DOUBLE + sa::DOUBLE AS startup_cost, o_totalprice * tf::DOUBLE + ta::DOUBLE AS total_cost
  FROM orders JOIN shapes ON shape = CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN substr(o_orderpriority, 1, 1) ELSE 'x' END)""",
    "pairs": f"""answered AS (
  SELECT event_id AS sample, event_type, value, {_SQL_K}::DOUBLE AS k FROM events),
labelled AS (
  SELECT sample, event_type, {_sql_label(sql_clip('k', '0.0::DOUBLE', '100.0::DOUBLE'))} AS true_mem,
    {_sql_label(sql_clip('value', '0.0::DOUBLE', '200.0::DOUBLE'))} AS true_buf,
    {_sql_label(sql_clip('(k + sample % 10)', '0.0::DOUBLE', '110.0::DOUBLE'))} AS pred_mem,
    {_sql_label(sql_clip('(value + sample % 7)', '0.0::DOUBLE', '200.0::DOUBLE'))} AS pred_buf
  FROM answered),
pairs AS (
  SELECT sample, 'work_mem' AS knob, true_mem AS truth_label, CASE WHEN event_type = 'purchase' THEN 'middle' ELSE pred_mem END AS pred_label
  FROM labelled WHERE event_type IN ('view', 'purchase', 'click')
  UNION ALL
  SELECT sample, 'shared_buffers', true_buf, CASE WHEN event_type = 'view' THEN NULL ELSE pred_buf END
  FROM labelled WHERE event_type IN ('view', 'purchase', 'click')),
scored AS (
  SELECT sample, knob, split_part(truth_label, '-', 1)::INT // 10 AS y_true, split_part(pred_label, '-', 1)::INT // 10 AS y_pred
  FROM pairs WHERE pred_label IS NOT NULL AND pred_label <> 'middle')""",
    "results": """results AS (
  SELECT o_custkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'default' ELSE 'response_' || o_orderkey::VARCHAR || '.json' END AS name,
    -o_totalprice AS qps FROM orders)""",
}


SQL["all_metrics"] = SQL["metrics"].replace(" WHERE user_id % 10 <> 0", "")


def with_views(names: list[str], query: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + query
