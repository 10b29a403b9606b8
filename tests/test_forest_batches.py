"""Forests that predict batch by batch, next to MLlib's own predictions."""

import contextlib
import hashlib
import io

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tunelake.catalog import knob_records
from tunelake.operators import forest_batches as fb
from tunelake.operators import surrogate as su


@pytest.fixture(scope="module")
def rows(spark):
    """Values that meet thresholds, zeros of both signs and very large values."""
    i = F.col("id")
    odd = F.when(i % 11 == 0, F.lit(-0.0)).when(i % 13 == 0, F.lit(1e300)).otherwise(i * 31 % 17 - 8.0)
    made = spark.range(900).select("id", F.array((i * 7919 % 101 / 100.0), odd, F.lit(2.0), (i % 5).cast("double")).alias("v"))
    y = F.sin(F.col("v")[0] * 9) + F.col("v")[3]
    return made.select("id", y.alias("scaled"), array_to_vector("v").alias("features"))


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.fixture(scope="module")
def model(rows):
    return su.random_forest(trees=20).fit(su.drawn_sample(rows.select("*", F.lit("w").alias("workload"), F.col("id").alias("config_id")), 300))


def test_batches_predict_what_mllib_does(spark, rows, model):
    odd = F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    unknown = rows.limit(40).withColumn("features", array_to_vector(F.array(*[odd] * 4)))
    every = rows.unionByName(unknown).repartition(3)
    found = su.predicted(every, model)
    assert "ArrowEvalPython" in plan(found) and found.columns == model.transform(every).columns
    both = model.transform(every).withColumnRenamed("forest", "want").select("want", "features")
    got = su.predicted(both, model).select("want", "forest").collect()
    assert len(got) == 940 and all(r.want == r.forest for r in got) and len({r.want for r in got}) > 100
    assert su.predicted(every.limit(0), model).count() == 0


def test_votes_take_batches(rows, model):
    assert "ArrowEvalPython" in plan(su.voted(rows, [model]))


def test_batches_are_cut_by_rows(spark, rows, model):
    """Arrow batches of 7 rows are put together and come out one by one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = dict(su.predicted(rows.repartition(2), model).select("id", "forest").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == dict(model.transform(rows).select("id", "forest").collect())


def test_large_forests_are_left_to_mllib(rows, model, monkeypatch):
    monkeypatch.setattr(fb, "MOST_NODES", 10)
    assert "ArrowEvalPython" not in plan(su.predicted(rows, model))


def test_the_rows_of_a_fit_are_looked_for_once(rows):
    keyed = rows.select("*", F.lit("w").alias("workload"), F.col("id").alias("config_id"))
    drawn = su.drawn_sample(keyed, 50)
    assert "TakeOrdered" not in plan(drawn) and "Range" not in plan(drawn)
    assert drawn.exceptAll(su.labelled_sample(keyed, 50)).count() == 0 and drawn.count() == 50


def test_knobs_are_not_drawn_in_one_large_method(spark):
    knobs = knob_records()
    ids = spark.range(3).select(F.col("id").cast("string").alias("c"))
    drawn = ids.select("c", *su.drawn_knobs("c", knobs))
    line = next(x for x in plan(drawn).splitlines() if "AS " + knobs[0].knob in x)
    assert "Project" in line and "*(" not in line
    row = drawn.filter("c = '2'").first()
    first = int(hashlib.md5(b"2:0").hexdigest()[:8], 16) / 2**32 * (knobs[0].max - knobs[0].min) + knobs[0].min
    assert row[1] == (int(first) if knobs[0].type == "integer" else first)
