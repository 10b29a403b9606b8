"""Totals over trees of nodes against recursion."""

import random
from decimal import Decimal

import pytest

from tunelake.operators import node_trees


def expected(nodes):
    value = {n: Decimal(str(c)) for n, _, c in nodes}
    parent = {n: p if p in value else None for n, p, _ in nodes}
    children = {n: [m for m in value if parent[m] == n] for n in value}
    own = {n: value[n] - sum((value[m] for m in children[n]), Decimal(0)) for n in value}

    def way(n):
        found = []
        while n is not None:
            found.append(n)
            n = parent[n]
        return found

    below = {n: [m for m in value if n in way(m)] for n in value}
    path = {n: sum((own[m] for m in way(n)), Decimal(0)) for n in value}
    end = min((n for n in value if not children[n]), key=lambda n: (-path[n], n))
    return {(n, len(way(n)) - 1, own[n], len(below[n]), sum((own[m] for m in below[n]), Decimal(0)), path[n], n in way(end)) for n in value}


def random_tree(draw, n, kind):
    nodes = []
    for i in range(n):
        up = None if i == 0 else {"chain": i - 1, "star": 0, "any": draw.randrange(i)}[kind]
        nodes.append((f"n{i:03d}", None if up is None else f"n{up:03d}", float(draw.randint(0, 40)) / 4))
    return nodes


@pytest.mark.parametrize("rows_per_salt", [10**6, 10])
def test_equals_recursion(spark, rows_per_salt):
    draw = random.Random(6)
    trees = {t: random_tree(draw, draw.choice([1, 2, 9, 33, 60]), kind) for t, kind in enumerate(["chain", "star", "any"] * 4)}
    trees[99] = [("a", "gone", 3.0), ("b", "a", 1.0), ("c", "also gone", 4.0)]  # parents that are not there make roots
    rows = [(t, *n) for t, nodes in trees.items() for n in nodes]
    frame = spark.createDataFrame(rows, "tree long, node string, parent string, total_cost double").repartition(5)
    got = node_trees.subtree_costs(frame, rows_per_salt).collect()
    for t, nodes in trees.items():
        mine = {(r.node, r.depth, r.own_cost, r.n_below, r.cost_below, r.path_cost, r.critical) for r in got if r.tree == t}
        assert mine == expected(nodes), t


def test_deep_tree_in_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(node_trees, "written", lambda df, name, w=node_trees.written: calls.append(name) or w(df, name))
    nodes = spark.range(300).selectExpr("1 AS tree", "id AS node", "nullif(id, 0) - 1 AS parent", "CAST(300 - id AS DOUBLE) AS total_cost")
    got = {r.node: r for r in node_trees.subtree_costs(nodes).collect()}
    assert got[299].depth == 299 and got[0].n_below == 300 and got[0].cost_below == 300 and all(r.critical for r in got.values())
    assert len(calls) <= 2 * 10


def test_cycle_and_no_rows(spark, monkeypatch):
    schema = "tree long, node long, parent long, total_cost double"
    assert node_trees.subtree_costs(spark.createDataFrame([], schema)).collect() == []
    monkeypatch.setattr(node_trees, "MOST_ROUNDS", 4)
    with pytest.raises(ValueError):
        node_trees.subtree_costs(spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], schema))
