"""The registered queries as a whole."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from tunelake.plans.tables import TABLES

QUICK = ["q02_inner_join", "q05_band_join", "q36_window_average", "a2_crash_cap", "a10_confusion", "w3_incumbent_trace", "t2_best_records", "v3_plan_text", "s3_run_history", "q05_interval_join", "q19_merged_distinct", "s4_metrics_files", "s6_committed_samples", "s14_run_pairs", "l3_sample_slice", "t5_conversation_text", "t2_incremental_records"]


def test_names_and_checks_fit():
    queries, checks = entry_points.queries(), entry_points.oracle_sql()
    assert set(checks) <= set(queries)
    assert len(queries) > 120
    assert all(re.fullmatch(r"[a-z]+\d+_[a-z0-9_]+|pipeline", n) for n in queries)


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["instruction", "input", "output", "meta"]
    assert out.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_check(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry_points.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(str(tuple(r[i] for i in order)) for r in cursor.fetchall())
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == want
