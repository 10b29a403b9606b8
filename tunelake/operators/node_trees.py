"""Trees as tables of nodes: totals of subtrees, costs of paths, critical paths.

A tree of at most IN_ROW nodes is gathered into a row and folded there, so its nodes are
shuffled once. A larger tree need not fit a row or a task. Every node holds a jump to an ancestor; in each round the
jump doubles its length and what the node knows about its way up and its descendants grows with
it, so a tree of depth d takes log2(d) rounds, each a join and an aggregate over one row per
node. Rounds are written, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.operators.skew import ROWS_PER_SALT, key_counts, salted_join
from tunelake.session import written

# A tree of 2 ** 60 levels is a cycle.
MOST_ROUNDS = 60
AMOUNT = "decimal(38,10)"
# Nodes of a tree that is folded in one row, where the work grows with their square.
IN_ROW = 64


def folded(nodes: DataFrame, up: list[str], down: dict[str, Callable[[Column], Column]], plus: dict[str, Callable[[Column, Column], Column]], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """`nodes` (tree, node, parent and values) with each value folded over the node's way or its descendants.

    `up` are values that are added over the node and all its ancestors; `down` are folded over
    the node and all its descendants by an aggregate, and two results put together by `plus`.
    A node whose parent is not among the nodes is a root. Nodes are unique in a tree.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    linked = salted_join(nodes, known, ["tree", "parent"], ["node"], "left", rows_per_salt=rows_per_salt)
    now = written(linked.withColumn("_jump", F.when(F.col("_known"), F.col("parent"))).drop("_known"), "tree-jumps")
    for _ in range(MOST_ROUNDS):
        if now.filter("_jump IS NOT NULL").isEmpty():
            return now.drop("_jump")
        ahead = now.select("tree", F.col("node").alias("_jump"), F.col("_jump").alias("_next"), *[F.col(c).alias(f"_up_{c}") for c in up])
        far = salted_join(now, ahead, ["tree", "_jump"], ["node"], "left", rows_per_salt=rows_per_salt)
        below = now.filter("_jump IS NOT NULL").groupBy("tree", F.col("_jump").alias("node")).agg(*[how(F.col(c)).alias(f"_down_{c}") for c, how in down.items()])
        grown = far.join(below, ["tree", "node"], "left")
        sums = [(F.col(c) + F.coalesce(F.col(f"_up_{c}"), F.lit(0))).cast(now.schema[c].dataType).alias(c) for c in up]
        more = [F.coalesce(plus[c](F.col(c), F.col(f"_down_{c}")), c).cast(now.schema[c].dataType).alias(c) for c in down]
        rest = [c for c in now.columns if c not in (*up, *down, "_jump")]
        now = written(grown.select(*rest, *sums, *more, F.col("_next").alias("_jump")), "tree-jumps")
    raise ValueError("the parents of some nodes form a cycle")


def added(a: Column, b: Column) -> Column:
    return a + b


def costs_in_rows(nodes: DataFrame) -> DataFrame:
    """`subtree_costs` of trees that fit a row: each node's way to its root, as places in the row, tells all else."""
    nothing = F.lit(0).cast(AMOUNT)

    def total(places: Column) -> Column:
        return F.aggregate(places, nothing, lambda so_far, i: (so_far + F.element_at("own", i)).cast(AMOUNT))

    def way(i: Column) -> Column:
        start = F.struct(i.alias("at"), F.array().cast("array<int>").alias("way"))
        up = lambda now: F.struct(F.element_at("up", now["at"]).alias("at"), F.concat(now["way"], F.array(now["at"])).alias("way"))
        return F.aggregate("n", start, lambda now, _: F.when(now["at"] > 0, up(now)).otherwise(now))

    def below(x: Column) -> Column:
        return F.filter("n", lambda y: y["parent"] == x["node"])

    names = F.transform("n", lambda x: x["node"])
    place = F.transform("n", lambda x: F.coalesce(F.array_position(names, x["parent"]).cast("int"), F.lit(0)))
    children = lambda x: F.aggregate(below(x), nothing, lambda so_far, y: (so_far + y["amount"]).cast(AMOUNT))
    node = F.struct("node", "parent", F.col("total_cost").cast(AMOUNT).alias("amount"))
    trees = nodes.groupBy("tree").agg(F.collect_list(node).alias("n")).select("tree", "n", F.sequence(F.lit(1), F.size("n")).alias("places"), place.alias("up"))
    known = trees.select(
        "tree", "n", "places", F.transform("places", way).alias("ways"),
        F.transform("n", lambda x: (x["amount"] - children(x)).cast(AMOUNT)).alias("own"), F.transform("n", lambda x: F.size(below(x)) == 0).alias("leaf"),
    )
    ways = known.select("*", F.exists("ways", lambda w: w["at"] > 0).alias("cycle"), F.transform("ways", lambda w: total(w["way"])).alias("path"))
    ends = F.transform(F.filter("places", lambda i: F.element_at("leaf", i)), lambda i: F.struct((-F.element_at("path", i)).alias("path"), F.element_at("n", i)["node"].alias("node"), i.alias("i")))
    chosen = ways.select("*", F.element_at("ways", F.array_min(ends)["i"])["way"].alias("most"))

    def costs(i: Column) -> Column:
        under = F.filter("places", lambda j: F.array_contains(F.element_at("ways", j)["way"], i))
        return F.struct(
            F.element_at("n", i)["node"].alias("node"), F.element_at("n", i)["parent"].alias("parent"),
            (F.size(F.element_at("ways", i)["way"]) - 1).cast("long").alias("depth"), F.element_at("own", i).alias("own_cost"),
            F.size(under).cast("long").alias("n_below"), total(under).alias("cost_below"), F.element_at("path", i).alias("path_cost"),
            F.array_contains("most", i).alias("critical"),
        )

    found = chosen.select("tree", "cycle", F.explode_outer(F.transform("places", costs)).alias("c")).select("tree", "cycle", "c.*")
    table = written(found.filter("tree IS NOT NULL AND node IS NOT NULL"), "tree-costs")
    if not table.filter("cycle").isEmpty():
        raise ValueError("the parents of some nodes form a cycle")
    return table.drop("cycle")


def subtree_costs(nodes: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Per node of (tree, node, parent, total_cost), the cost including children: what it costs alone and in its place.

    own_cost is the cost without the children's; depth counts from 0 at the root; n_below and
    cost_below are number and own costs of the subtree; path_cost are the own costs from the
    root to the node. The critical path of a tree leads to the leaf with the largest path_cost,
    of equal ones the first by name; `critical` says whether a node is on it. `nodes` is read several times.
    """
    sizes = key_counts(nodes, ["tree"])
    least, most = sizes.agg(F.min("_n"), F.max("_n")).first()
    if most is None or most <= IN_ROW:
        return costs_in_rows(nodes)
    if least > IN_ROW:
        return costs_by_doubling(nodes, rows_per_salt)
    large = sizes.filter(F.col("_n") > IN_ROW).select("tree", F.lit(True).alias("_large"))
    told = written(salted_join(nodes, large, ["tree"], ["node"], "left", sizes, rows_per_salt), "tree-nodes")
    small, rest = told.filter("_large IS NULL").drop("_large"), told.filter("_large").drop("_large")
    return costs_in_rows(small).unionByName(costs_by_doubling(rest, rows_per_salt))


def costs_by_doubling(nodes: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """`subtree_costs` of trees of any size."""
    amount = F.col("total_cost").cast(AMOUNT)
    children = nodes.filter("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.sum(amount).cast(AMOUNT).alias("_children"))
    alone = nodes.join(children, ["tree", "node"], "left").select(
        "tree", "node", "parent", (amount - F.coalesce("_children", F.lit(0))).cast(AMOUNT).alias("own_cost"), F.col("_children").isNull().alias("leaf")
    )
    started = alone.select("*", F.lit(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("n_below"), F.col("own_cost").alias("cost_below"), F.col("own_cost").alias("path_cost"))
    sums = folded(started, ["depth", "path_cost"], {"n_below": F.sum, "cost_below": F.sum}, {"n_below": added, "cost_below": added}, rows_per_salt)
    leaves = sums.filter("leaf").select("tree", F.col("node").alias("_leaf"), "path_cost")
    most = leaves.groupBy("tree").agg(F.max("path_cost").alias("path_cost"))
    chosen = leaves.join(most, ["tree", "path_cost"], "left_semi").groupBy("tree").agg(F.min("_leaf").alias("_leaf"))
    marked = salted_join(sums.select("tree", "node", "parent"), chosen, ["tree"], ["node"], rows_per_salt=rows_per_salt)
    on_way = folded(marked.select("tree", "node", "parent", (F.col("node") == F.col("_leaf")).cast("int").alias("critical")), [], {"critical": F.max}, {"critical": F.greatest}, rows_per_salt)
    out = sums.join(on_way.select("tree", "node", (F.col("critical") == 1).alias("critical")), ["tree", "node"])
    return out.select("tree", "node", "parent", (F.col("depth") - 1).alias("depth"), "own_cost", "n_below", "cost_below", "path_cost", "critical")
