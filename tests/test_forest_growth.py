"""Forests grown from all rows: what they learn from, their cuts and the bounds that change no tree."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tunelake.operators import evaluate as ev
from tunelake.operators import forest_growth as fg
from tunelake.operators import surrogate as su
from tunelake.plans import models as plans


class Enough(Exception):
    pass


def test_voting_learns_from_all_rows(spark, sf_dir, monkeypatch):
    """The rows that both models of m4_voting are fitted on; they were 300 of a sample."""
    given = []

    def fitted(rows, estimators):
        given.append((rows.count(), rows.select("workload", "config_id").distinct().count(), len(estimators)))
        raise Enough

    every = plans.training(spark, sf_dir).count()
    monkeypatch.setattr(plans.su, "fitted", fitted)
    with pytest.raises(Enough):
        plans.m4_voting(spark, sf_dir)
    assert every > 300 and given == [(every, every, 2)]


@pytest.fixture(scope="module")
def rows(spark):
    """Labels are quarters with mean 0, so sums do not depend on their order; features have many values, few and one."""
    i, sign = F.col("id") % 3000, F.when(F.col("id") < 3000, 1.0).otherwise(-1.0)
    a, b = i * 7919 % 1009 / 1009.0, i * 31 % 64 / 1.0
    label = sign * (F.floor(a * 8) + F.when(b < 32, 0.25).otherwise(-0.25))
    features = F.array(sign, a, b, F.lit(2.0), i % 3 * 1.0, F.sin(i), F.cos(i * 5))
    return spark.range(0, 6000, 1, 3).select("id", array_to_vector(features).alias("features"), label.alias("scaled"))


def votes(rows, **settings):
    model = su.grown_forest(**{"trees": 8, **settings}).fit(rows)
    return {r.id: r.forest for r in su.predicted(rows, model).select("id", "forest").collect()}, model


def test_bounds_change_no_tree(spark, rows, monkeypatch):
    """Nodes cut by histograms over all blocks, and trees grown in several groups, give the same forest."""
    plain, model = votes(rows)
    assert len(plain) == 6000 and len(model.parts) == 1
    monkeypatch.setattr(fg, "MOST_ROWS", 200)
    monkeypatch.setattr(fg, "PAIRS", 18_000)
    sizes = []
    dealt = fg.dealt

    def seen(blocks, law, tops, learning):
        out = dealt(blocks, law, tops, learning)
        if learning:
            sizes.extend(r.n for r in out.groupBy("tree", "path").agg(F.sum(F.length("weights")).alias("n")).collect())
        return out

    monkeypatch.setattr(fg, "dealt", seen)
    cut, parts = votes(rows)
    assert cut == pytest.approx(plain, rel=1e-12, abs=1e-12) and len(parts.parts) == 3
    assert max(sizes) <= 200 < len(sizes) <= parts.nodes().count()


def test_final_nodes_above_the_bound_vote_too(rows, monkeypatch):
    plain, _ = votes(rows, depth=2)
    monkeypatch.setattr(fg, "MOST_ROWS", 50)
    assert votes(rows, depth=2)[0] == pytest.approx(plain, rel=1e-12, abs=1e-12) and len(set(plain.values())) > 4


def test_forest_explains_what_it_has_not_seen_as_mllib_does(rows):
    learned, rest = rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0")
    own, mllib = (
        ev.r2(su.predicted(rest, e.fit(learned)), "scaled", "forest").first().r2
        for e in (su.grown_forest(trees=20), su.random_forest(trees=20))
    )
    assert own > 0.9 and abs(own - mllib) < 0.03


def test_a_tree_without_draws_fits_every_row(rows):
    """One tree is drawn without weights and tries all features, so it ends with one label in each leaf."""
    exact, _ = votes(rows.filter("id < 30 OR id >= 5970"), trees=1)
    labels = {r.id: r.scaled for r in rows.collect()}
    assert len(exact) == 60 and all(math.isclose(v, labels[k], abs_tol=1e-12) for k, v in exact.items())


def test_best_cut_equals_trying_all(spark):
    draw = np.random.default_rng(4)
    law = fg.Law(1, 1, 8, 0, 3)
    for _ in range(40):
        n = int(draw.integers(2, 30))
        bins, w, y = draw.integers(0, 8, (n, 3)).astype(np.uint8), draw.integers(1, 4, n), draw.integers(-4, 5, n) / 4
        root = fg.subtree(bins, w, y, law, 0, 1)[0]

        def left_over(f, p):
            sides = [bins[:, f] <= p, bins[:, f] > p]
            return sum(float(w[s] @ (y[s] - np.average(y[s], weights=w[s])) ** 2) for s in sides if s.any())

        tried = [left_over(f, p) for f in range(3) for p in range(7) if 0 < (bins[:, f] <= p).sum() < n]
        if root["left"] >= 0:
            assert left_over(root["feature"], root["place"]) == pytest.approx(min(tried))
        else:
            assert len(set(y)) == 1 or not tried or min(tried) == pytest.approx(float(w @ (y - np.average(y, weights=w)) ** 2))


def test_cuts_of_few_and_many_values(spark):
    i = F.col("id")
    odd = F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 5 == 1, F.lit(float("inf"))).when(i % 5 == 2, F.lit(-0.0)).otherwise(F.lit(0.0))
    rare = F.when(i == 77, 9.0).otherwise(1.0)
    made = spark.range(4000).select(array_to_vector(F.array(i * 1.0, rare, odd, F.lit(3.0))).alias("features"))
    many, few, strange, one = fg.find_cuts(made, "features", 4, 32)
    assert len(many) == 31 and np.abs(many - np.arange(1, 32) * 125).max() <= 2
    assert few.tolist() == [5.0] and strange.tolist() == [0.0] and len(one) == 0


def test_odd_tables(spark):
    schema = "features array<double>, scaled double"

    def frame(rows):
        return spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("features"))

    single = su.grown_forest(trees=5).fit(frame([([1.0, 2.0], 7.0)]))
    odd = frame([([float("nan"), 2.0], None), ([1.0, float("inf")], 1.0), ([1.0, 2.0], 7.0)])
    assert [r.forest for r in su.predicted(odd, single).collect()] == [7.0] * 3
    assert su.predicted(odd.limit(0), single).count() == 0
    same = su.grown_forest(trees=3).fit(frame([([float(i), 0.0], 0.1) for i in range(20)]))
    assert same.nodes().count() == 3 and {r.forest for r in su.predicted(odd, same).collect()} == {0.1}
    for bad in ([], [([1.0, 2.0], None), ([1.0, 2.0], 1.0)]):
        with pytest.raises(ValueError):
            su.grown_forest(trees=2).fit(frame(bad))
    large = frame([([float(i)], 1e9 + i % 4) for i in range(400)])
    found = su.predicted(large, su.grown_forest(trees=30).fit(large)).collect()
    assert all(1e9 <= r.forest <= 1e9 + 3 for r in found) and len({r.forest for r in found}) > 10
