"""Instruction records and prompts.

Samples are wide: one column per knob, next to workload, config_id, y and
inner_metrics. Labels and JSON texts are built inside a row, so these operators
add no shuffle to the joins that produced the samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.catalog import Knob
from tunelake.constants import (
    BEST_INSTRUCTION,
    CHAT_START,
    INSTRUCTION_TEXT,
    METRIC_NAMES,
    PROMPT_FEATURES,
    PROMPT_HEAD,
    PROMPT_METRICS,
    PROMPT_PLANS,
    SYSTEM_TEXT,
)
from tunelake.functions.labels import RANGE, bucket_label, labels_of
from tunelake.functions.scaling import bucket, clip_text, threshold_case
from tunelake.functions.text import (
    chat_prompt,
    chat_turn,
    feature_text,
    float_text,
    json_line,
    json_object_text,
    json_string,
    metrics_json,
    metrics_text,
    workload_database,
    workload_name,
)
from tunelake.operators.history import best_runs, best_with_metrics, runs_with_config
from tunelake.operators.splits import exact_split, hash_split


def best_label_json(knobs: Sequence[str], catalog: dict[str, Knob]) -> Column:
    """JSON object of bucket labels by percent; knobs without limits keep their number."""
    lines, labels = [], ", ".join(f"'{label}'" for label in labels_of(RANGE))
    for name in knobs:
        knob = catalog.get(name)
        if knob is None or knob.min is None or knob.max is None:
            lines.append(json_line(name, float_text(F.col(name).cast("double"))))
        else:
            decile = f"if(`{name}` IS NULL, NULL, cast(least(floor(({clip_text(f'`{name}`', knob.min, knob.max)}) * 100 / 10), 9) AS int))"
            lines.append(F.expr(f"""concat('"{name}": "', get(array({labels}), {decile}), '"')"""))
    return json_object_text(*lines)


def with_label_json(samples: DataFrame, catalog: Sequence[Knob], name: str = "output") -> DataFrame:
    """Replaces the knob columns by a JSON object of their bucket labels, in catalog order.

    The positions become columns first, so that the comparisons with the nine edges of a
    knob share one computed position.
    """
    present = [k for k in catalog if k.knob in samples.columns]
    knobs = {k.knob for k in present}
    rest = [c for c in samples.columns if c not in knobs]
    positions = [F.expr(clip_text(f"`{k.knob}`", k.min, k.max)).alias(k.knob) for k in present]
    lines = [
        F.expr(threshold_case(f"`{k.knob}`", [f"""'"{k.knob}": "{label}"'""" for label in labels_of(RANGE)]))
        for k in present
    ]
    return samples.select(*rest, *positions).select(*rest, json_object_text(*lines).alias(name))


def meta_columns(path: Column) -> Column:
    name = F.when(workload_database(path).isNotNull(), workload_name(path))
    return F.struct(workload_database(path).alias("database"), name.alias("workload_name"))


def build_best_records(
    runs: DataFrame,
    configs: DataFrame,
    metrics: DataFrame,
    knobs: Sequence[str],
    catalog: Sequence[Knob],
) -> DataFrame:
    """One record per workload: its counters as input, labels of its best run as output.

    Workloads whose best run has no configuration, or that have no counters, drop out.
    The best run is found before the configurations are joined, so only one row per
    workload takes part in the joins.
    """
    best = runs_with_config(best_runs(runs), configs)
    by_name = {k.knob: k for k in catalog}
    path = F.col("workload")
    return best_with_metrics(best, metrics).select(
        F.lit(BEST_INSTRUCTION).alias("instruction"),
        metrics_json(F.col("inner_metrics")).alias("input"),
        best_label_json(knobs, by_name).alias("output"),
        meta_columns(path).alias("meta"),
    )


def complete_metrics(samples: DataFrame) -> DataFrame:
    """Samples whose counter list has all 14 values."""
    return samples.filter(F.size("inner_metrics") == len(METRIC_NAMES))


def rejected_metrics(samples: DataFrame) -> DataFrame:
    """Samples without counters or with a wrong number of them."""
    return samples.filter(
        F.col("inner_metrics").isNull() | (F.size("inner_metrics") != len(METRIC_NAMES))
    )


def build_sample_records(samples: DataFrame, catalog: Sequence[Knob]) -> DataFrame:
    """One record per sample with complete counters."""
    return with_label_json(complete_metrics(samples), catalog).select(
        F.lit(SYSTEM_TEXT).alias("system"),
        F.lit(INSTRUCTION_TEXT).alias("instruction"),
        metrics_json(F.col("inner_metrics")).alias("input"),
        F.col("output"),
        meta_columns(F.col("workload")).alias("meta"),
        F.col("config_id"),
    )


def merge_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Older and new records together; system and instruction of the older ones are renewed."""
    renewed = existing.withColumn("system", F.lit(SYSTEM_TEXT)).withColumn(
        "instruction", F.lit(INSTRUCTION_TEXT)
    )
    return renewed.unionByName(new, allowMissingColumns=True)


def merge_and_split(existing: DataFrame, new: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """Merged records marked train or test, by hash threshold or with exact counts."""
    merged = merge_records(existing, new)
    return exact_split(merged, keys) if exact else hash_split(merged, keys)


def chat_prompts(records: DataFrame) -> DataFrame:
    """Records with the chat text sent to a model."""
    system = F.col("system") if "system" in records.columns else F.lit(None).cast("string")
    return records.withColumn("prompt", chat_prompt(system, F.col("instruction"), F.col("input")))


def conversation_prompts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, prompt): all turns of a conversation in order as one chat text, with the assistant's turn opened.

    A conversation that ends with an assistant is a whole example and stays closed. The text
    of a conversation is one value, so its turns meet in one row; turns of one number come in
    the order of role and text, those without a number first.
    """
    blocks = F.sort_array(F.collect_list(F.struct("turn", "role", "text", chat_turn(F.col("role"), F.col("text")).alias("block"))))
    grouped = turns.groupBy(key).agg(blocks.alias("_turns"))
    last = F.element_at("_turns", -1)["role"]
    opener = F.when(last.eqNullSafe(F.lit("assistant")), F.lit("")).otherwise(F.lit(f"{CHAT_START}assistant\n"))
    prompt = F.concat(F.array_join(F.transform("_turns", lambda t: t["block"]), ""), opener)
    return grouped.select(key, F.size("_turns").cast("long").alias("n_turns"), prompt.alias("prompt"))


def analytic_prompts(features: DataFrame, plan_texts: DataFrame, metrics: DataFrame) -> DataFrame:
    """One prompt per workload: features, all plans of its file, counters.

    `plan_texts` has (workload, plans array), one row per plan file; every side has
    one row per workload.
    """
    described = feature_text(
        F.col("n_statements"),
        [F.col(c) for c in ("read_ratio", "group_by_ratio", "order_by_ratio", "aggregation_ratio", "avg_predicates")],
    )
    prompt = F.concat(
        F.lit(PROMPT_HEAD + PROMPT_FEATURES),
        described,
        F.lit(PROMPT_PLANS),
        F.array_join("plans", "; "),
        F.lit(PROMPT_METRICS),
        metrics_text(F.col("inner_metrics")),
    )
    return (
        features.join(plan_texts, "workload")
        .join(metrics, "workload")
        .select("workload", prompt.alias("prompt"))
    )


def transactional_prompts(metrics: DataFrame, database: Column, qps: Column) -> DataFrame:
    """One structured prompt record per workload with counters as text and its throughput."""
    meta = F.struct(
        database.alias("database"),
        workload_name(F.col("workload")).alias("workload_name"),
        qps.alias("qps"),
    )
    return metrics.select(
        "workload",
        F.lit(SYSTEM_TEXT).alias("system"),
        F.lit(INSTRUCTION_TEXT).alias("instruction"),
        metrics_text(F.col("inner_metrics")).alias("input"),
        meta.alias("meta"),
    )
