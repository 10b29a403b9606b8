"""How the places of repeated strings are reduced and dealt out."""

import random

import numpy as np
from pyspark.sql import functions as F

from tunelake.llm import suffix_dedup


def test_copies_of_a_text_have_each_place_once(spark):
    letters = random.Random(4)
    text = "".join(letters.choice("abcdefgh ") for _ in range(3000))
    docs = spark.createDataFrame([(i, text) for i in range(60)] + [(99, "other " * 3)], "doc_id long, text string").repartition(4)
    places = suffix_dedup.repeated_suffixes(docs.select("text")).collect()
    assert places and len(places) == len(set(places))
    found = suffix_dedup.removal_report(docs).collect()
    assert all((r.n_removed, r.n_spans) == ((3000, 1) if r.doc_id < 99 else (0, 0)) for r in found)


def test_settled_rows_leave_the_bucket(spark):
    n = 4000
    text = np.arange(n, dtype=np.uint64) // np.uint64(2)  # two copies of each text
    zeros = np.zeros(n, dtype=np.uint64)
    rows = suffix_dedup.combined(zeros, zeros, text, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)).to_pandas()
    assert len(rows) == n // 2 and (~rows.settled).sum() == 1 and rows.many.sum() == 1
    dealt = suffix_dedup.dealt_out(spark.createDataFrame(rows, suffix_dedup.ROWS), 8)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < n // 4
