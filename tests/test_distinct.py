"""Distinct counts by bitmaps against sets, and their merges over increments."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tunelake.operators import distinct


def made_rows(n=6000, groups=5):
    draw = random.Random(9)
    rows = []
    for i in range(n):
        group = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"g{draw.randrange(groups)}"
        rows.append((i, group, draw.choice([None, "a", "b", "é", "", f"v{draw.randrange(300)}"]), draw.choice([None, math.nan, 0.0, -0.0, 1.5, float(draw.randrange(40))]), i * 7 if i % 11 else None))
    return rows


def expected(rows, key=1):
    sets = defaultdict(lambda: (set(), set(), set()))
    for row in rows:
        for found, value in zip(sets[row[key]], row[2:]):
            if value is not None:
                found.add("nan" if value != value else value)
    return {(k, *map(len, v)) for k, v in sets.items()}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(made_rows(), "id long, grp string, word string, num double, key long").repartition(5)


COUNTS = {"n_words": "word", "n_nums": "num", "n_keys": "key"}


def test_counts_equal_sets(frame):
    got = distinct.distinct_counts(frame, ["grp"], COUNTS)
    assert {tuple(r) for r in got.collect()} == expected(made_rows())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "bitmap_construct_agg" in plan


def test_small_groups_are_counted_by_pairs(frame):
    rows = frame.withColumn("grp", (F.col("id") % 3000).cast("string"))
    got = distinct.distinct_counts(rows, ["grp"], COUNTS, [F.count(F.lit(1)).alias("n_rows")])
    assert "bitmap" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = expected([(r[0], str(r[0] % 3000), *r[2:]) for r in made_rows()])
    assert {(r.grp, r.n_words, r.n_nums, r.n_keys) for r in got.collect()} == want
    assert {r.n_rows for r in got.collect()} == {2}


def test_codes_beyond_one_bitmap(spark, monkeypatch):
    rows = spark.range(200_000).selectExpr("id", "id % 2 AS grp", "CASE WHEN id % 5 = 0 THEN 7 ELSE id * 31 % 100003 END AS value")
    for limit in (distinct.BROADCAST_ROWS, 10**6):
        monkeypatch.setattr(distinct, "BROADCAST_ROWS", limit)
        dictionary = distinct.value_dictionary(rows, "value")
        bitmaps = distinct.distinct_bitmaps(rows, ["grp"], "value", dictionary, ["id"])
        assert bitmaps.select("bucket").distinct().count() > 2
        got = {tuple(r) for r in distinct.bitmap_counts(bitmaps, ["grp"], "n").collect()}
        assert got == {tuple(r) for r in rows.groupBy("grp").agg(F.count_distinct("value").alias("n")).collect()}


def test_increments_merge(spark):
    rows = made_rows()
    parts = [rows[i::3] for i in range(3)]
    known, bitmaps = None, None
    for part in parts:
        frame = spark.createDataFrame(part, "id long, grp string, word string, num double, key long").withColumn("day", F.col("id") % 4)
        before = known
        known = distinct.value_dictionary(frame, "word", known)
        if before is not None:
            assert before.exceptAll(known).count() == 0
        new = distinct.distinct_bitmaps(frame, ["grp", "day"], "word", known, ["id"])
        bitmaps = new if bitmaps is None else bitmaps.unionByName(new)
    codes = sorted(r.code for r in known.collect())
    assert codes == list(range(len(codes)))
    got = distinct.bitmap_counts(distinct.merge_bitmaps(bitmaps, ["grp"]), ["grp"], "n")
    assert {tuple(r) for r in got.collect()} == {(g, n) for g, n, _, _ in expected(rows)}


def test_no_rows(frame):
    assert distinct.distinct_counts(frame.limit(0), ["grp"], COUNTS).collect() == []
    nulls = frame.withColumn("word", F.lit(None).cast("string"))
    assert {r.n_words for r in distinct.distinct_counts(nulls, ["grp"], COUNTS).collect()} == {0}
