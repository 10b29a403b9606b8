"""Query-plan trees: nodes, costs, texts and profiles.

A plan is one JSON text in one row. Its nodes are reached inside the row, level
by level, through variant values; no loop on the driver and no shuffle is needed
and depth is not limited.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.text import humanize_cost

NODE_FIELDS = "path array<int>, type string, startup double, total double"


def _children(node: Column) -> Column:
    inner = F.coalesce(F.try_variant_get(node["v"], "$.Plans", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(
        inner,
        lambda child, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), child.alias("v")),
    )


def tree_nodes(text: Column) -> Column:
    """Array of the nodes (path, type, startup, total) of a plan's JSON text, parents first.

    The root has the path [0]; a child adds its position among its siblings. Every
    inner node brings one `"Plans"` key, so their number bounds the depth; levels below the
    deepest one pass the found nodes on as they are.
    """
    root = F.array(
        F.struct(F.array(F.lit(0)).alias("path"), F.try_parse_json(text).alias("v"))
    )
    levels = F.sequence(F.lit(0), F.regexp_count(text, F.lit('"Plans"')))

    def step(acc, _):
        below = F.flatten(F.transform(acc["front"], _children))
        more = F.struct(below.alias("front"), F.concat(acc["seen"], acc["front"]).alias("seen"))
        return F.when(F.size(acc["front"]) > 0, more).otherwise(acc)

    start = F.struct(root.alias("front"), F.filter(root, lambda _: F.lit(False)).alias("seen"))
    found = F.aggregate(levels, start, step, lambda acc: acc["seen"])
    return F.transform(
        found,
        lambda n: F.struct(
            n["path"].alias("path"),
            F.try_variant_get(n["v"], '$["Node Type"]', "string").alias("type"),
            F.try_variant_get(n["v"], '$["Startup Cost"]', "double").alias("startup"),
            F.try_variant_get(n["v"], '$["Total Cost"]', "double").alias("total"),
        ),
    )


def plan_nodes(plans: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Node table (plan_id, node_path, parent_path, ordinal, depth, node_type, costs) with the kept columns of the plan.

    An outer generator, because for an inner one the array would be computed a second
    time in an inferred filter.
    """
    node = F.col("node")
    path = node["path"]
    exploded = plans.select("plan_id", *keep, F.explode_outer(tree_nodes(F.col("text"))).alias("node"))
    return exploded.filter(node.isNotNull()).select(
        "plan_id",
        *keep,
        F.array_join(path.cast("array<string>"), ".").alias("node_path"),
        F.when(F.size(path) > 1, F.array_join(F.slice(path, 1, F.size(path) - 1).cast("array<string>"), ".")).alias("parent_path"),
        F.element_at(path, -1).alias("ordinal"),
        (F.size(path) - 1).alias("depth"),
        node["type"].alias("node_type"),
        node["startup"].alias("startup_cost"),
        node["total"].alias("total_cost"),
    )


def self_cost() -> Column:
    return F.col("total_cost") - F.col("startup_cost")


def render_tree(nodes: Column) -> Column:
    """Text `type(child, child, cost)` of a node array; leaves print their type only.

    The nodes are folded once, in the reverse order of their paths, which is children
    before parents and later siblings first. `open` holds the finished texts of nodes whose
    parents are still to come, with their depths, the next one first: a parent takes those
    one level below it. A node without costs prints its children only.
    """
    ordered = F.reverse(
        F.array_sort(
            F.transform(
                nodes,
                lambda n: F.struct(
                    n["path"].alias("path"),
                    F.size(n["path"]).alias("depth"),
                    F.lower(n["type"]).alias("type"),
                    (n["total"] - n["startup"]).alias("cost"),
                ),
            )
        )
    )

    def step(ready, n):
        below = F.filter(ready, lambda r: r["depth"] > n["depth"])
        rest = F.filter(ready, lambda r: r["depth"] <= n["depth"])
        parts = F.concat(F.transform(below, lambda r: r["text"]), F.array(humanize_cost(n["cost"])))
        inside = F.concat(F.lit("("), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "), F.lit(")"))
        text = F.concat(n["type"], F.when(F.size(below) > 0, inside).otherwise(F.lit("")))
        return F.concat(F.array(F.struct(n["depth"].alias("depth"), text.alias("text"))), rest)

    none = F.array().cast("array<struct<depth:int,text:string>>")
    return F.aggregate(ordered, none, step, lambda ready: F.try_element_at(ready, F.lit(1))["text"])


def plan_texts(plans: DataFrame) -> DataFrame:
    """(plan_id, plan_text) straight from the JSON rows."""
    return plans.select("plan_id", render_tree(tree_nodes(F.col("text"))).alias("plan_text"))


def plan_texts_from_nodes(nodes: DataFrame) -> DataFrame:
    """(plan_id, plan_text) from a node table; a group is one plan, whose text is one row anyway."""
    path = F.transform(F.split("node_path", r"\."), lambda p: p.cast("int"))
    node = F.struct(
        path.alias("path"),
        F.col("node_type").alias("type"),
        F.col("startup_cost").alias("startup"),
        F.col("total_cost").alias("total"),
    )
    return (
        nodes.groupBy("plan_id")
        .agg(F.collect_list(node).alias("_nodes"))
        .select("plan_id", render_tree(F.col("_nodes")).alias("plan_text"))
    )


def plan_profile(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Node-type frequency and share of the total self cost within each group."""
    by_type = nodes.groupBy(*group, "node_type").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum(self_cost()).alias("cost")
    )
    totals = by_type.groupBy(*group).agg(F.sum("cost").alias("_all"))
    share = F.when(F.col("_all") != 0, F.col("cost") / F.col("_all"))
    return by_type.join(totals, group).withColumn("cost_share", share).drop("_all")


def file_plans(files: DataFrame) -> DataFrame:
    """(workload, plans array of texts) from whole plan files; entries without `Plan` are skipped.

    A file is a JSON array of `{"Plan": {"Plan": {...}}, "query", "query_id"}`.
    """
    entries = F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>")
    trees = F.transform(entries, lambda e: F.to_json(F.try_variant_get(e, "$.Plan.Plan", "variant")))
    kept = F.filter(trees, lambda t: t.isNotNull())
    return files.select("workload", F.transform(kept, lambda t: render_tree(tree_nodes(t))).alias("plans"))


def read_plan_rows(files: DataFrame) -> DataFrame:
    """(workload, plan_id, text) from whole plan files, one row per plan with a tree."""
    entries = F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>")
    plan = F.col("_entry")
    return (
        files.select("workload", F.posexplode_outer(entries).alias("_pos", "_entry"))
        .filter(F.col("_pos").isNotNull())
        .select(
            "workload",
            F.concat_ws("#", "workload", F.col("_pos").cast("string")).alias("plan_id"),
            F.to_json(F.try_variant_get(plan, "$.Plan.Plan", "variant")).alias("text"),
            F.try_variant_get(plan, "$.query", "string").alias("query"),
        )
        .filter(F.col("text").isNotNull())
    )
