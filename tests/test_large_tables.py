"""What keeps queries whole on large tables: their plans, and results next to plainer ways."""

import contextlib
import io
import random
import tarfile
from pathlib import Path

import duckdb
from pyarrow import fs
from pyspark.sql import functions as F

import __spark_entry__
from tunelake.operators import node_trees
from tunelake.operators.skew import interval_join, interval_totals
from tunelake.sources import documents as docs
from tunelake.sources import sinks


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_parsed_histories_are_not_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin" not in plan(__spark_entry__.queries()["s3_run_history"](spark, sf_dir))


def test_histories_from_files_are_not_broadcast(spark, sf_dir):
    assert "BroadcastHashJoin" not in plan(__spark_entry__.queries()["s3_history_files"](spark, sf_dir))


def test_interval_totals_equal_pairs_without_making_them(spark, sf_dir):
    draw = random.Random(3)
    points = [(draw.choice("ab"), draw.choice([-0.0, 0.0, 1.5, 2.0, draw.uniform(-9, 9)]), draw.randint(0, 9)) for _ in range(300)]
    bands = [(i, draw.choice("abc"), low, low + draw.choice([-1.0, 0.0, 0.5, 3.0, float("inf")]), draw.random() < 0.5) for i, low in enumerate(draw.choice([-0.0, 1.5, draw.uniform(-9, 9)]) for _ in range(60))]
    p = spark.createDataFrame(points + [("a", None, 1), ("b", float("nan"), 1), (None, 1.5, 1)], "k string, x double, q long").repartition(3)
    b = spark.createDataFrame(bands + [(98, "a", None, 1.0, True), (99, "b", 0.0, float("nan"), True)], "id long, k string, lo double, hi double, shut boolean").repartition(3)
    for is_open in (False, True):
        got = interval_totals(p, b, "x", "lo", "hi", {"n": F.count(F.lit(1)), "s": F.sum("q")}, ["k"], is_open, "shut", "first", 5).collect()
        found = {r.id: (r.n, r.s, r.first) for r in got if r.n}
        want = {}
        for i, k, lo, hi, shut in bands:
            held = [(x, q) for pk, x, q in points if pk == k and (lo < x or lo == x and not is_open) and (x < hi or x == hi and shut)]
            if held:
                want[i] = (len(held), sum(q for _, q in held), min(x for x, _ in held))
        assert found == want
    joined = interval_join(p, b, "x", "lo", "hi", ["q"], totals={"n": F.count("q")})
    assert "Join Inner" not in plan(joined)
    pairs = {r.id: r.n for r in interval_join(p, b.drop("k"), "x", "lo", "hi", ["q"]).groupBy("id").agg(F.count("q").alias("n")).collect()}
    assert {r.id: r.n for r in joined.collect() if r.n} == pairs


def test_residual_join_counts_borders_as_the_difference_does(spark, tmp_path):
    """Balances within a few steps of the borders; the pairs themselves are not made."""
    draw = random.Random(8)
    customers = [(i, i % 3, draw.choice([-5000.0, 0.1, 17.37, draw.uniform(-1000, 5000)]), draw.choice(["A", "B"])) for i in range(80)]
    near = [c * 2 for _, _, c, _ in customers] + [c + 6000 for _, _, c, _ in customers]
    steps = [v + k * 2.0 ** draw.choice([-44, -42, -40, -39]) for v in near for k in (-2, -1, 0, 1, 2)]
    suppliers = [(i, i % 3, v) for i, v in enumerate([*steps, float("nan"), float("inf"), None])]
    spark.createDataFrame(customers + [(98, 1, float("nan"), "A"), (99, 2, None, "B")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    query, sql = (f()["q06_residual_join"] for f in (__spark_entry__.queries, __spark_entry__.oracle_sql))
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = query(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == set(con.execute(sql).fetchall())
    assert "s_nationkey#" not in plan(found)


def test_small_trees_take_no_rounds_and_equal_doubling(spark, monkeypatch):
    draw = random.Random(5)
    rows = []
    for tree in range(40):
        n = draw.choice([1, 2, 5, 20])
        rows += [(tree, f"n{i}", None if i == 0 else draw.choice(["gone", f"n{draw.randrange(i)}"]), draw.randint(0, 8) / 4) for i in range(n)]
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, total_cost double").repartition(5)
    calls = []
    monkeypatch.setattr(node_trees, "written", lambda df, name, w=node_trees.written: calls.append(name) or w(df, name))
    in_rows = node_trees.subtree_costs(nodes)
    assert calls == ["tree-costs"]  # rounds are written as tree-jumps
    doubled = node_trees.costs_by_doubling(nodes)
    assert in_rows.dtypes == doubled.dtypes and len(rows) == in_rows.count()
    assert set(map(tuple, in_rows.collect())) == set(map(tuple, doubled.collect()))
    monkeypatch.setattr(node_trees, "IN_ROW", 5)
    assert set(map(tuple, node_trees.subtree_costs(nodes).collect())) == set(map(tuple, doubled.collect()))


def test_bundles_are_tar_and_plain_members_need_no_tarfile(spark, tmp_path, monkeypatch):
    rows = [("a/b.json", "x"), ("a/c.json", ""), ("a/" + "n" * 98, "t" * 512), ("a/" + "n" * 120, "long name"), ("é.json", "ü" * 700), ("z.json", "after")]
    target = str(tmp_path / "d")
    docs.append_documents(spark.createDataFrame(rows, "path string, text string").coalesce(1), target, "1")
    (bundle,) = [f.path for f in docs.listed(target)]
    with tarfile.open(bundle) as tar:
        assert [(m.name, tar.extractfile(m).read().decode()) for m in tar] == rows
    assert {(r.path, r.text) for r in docs.read_documents(spark, target).collect()} == set(rows)
    for path, text in rows:
        member = tarfile.TarInfo(path)
        member.size = len(text.encode())
        assert docs.member_header(path, member.size) == member.tobuf(tarfile.PAX_FORMAT)
    plain = tmp_path / "p.bundle.tar"
    plain.write_bytes(docs.member_header("q.txt", 2) + b"hi".ljust(512, b"\0") + docs.BUNDLE_END)
    monkeypatch.setattr(tarfile, "open", None)
    assert list(docs.members(fs.LocalFileSystem(), str(plain), lambda _: True)) == [("q.txt", b"hi")]


def test_repeated_append_does_not_make_its_rows_again(spark, tmp_path):
    target = str(tmp_path / "d")
    docs.append_documents(spark.createDataFrame([("a", "x")], "path string, text string"), target, "1")
    failing = spark.range(1).select(F.lit("b").alias("path"), F.raise_error(F.lit("made again")).cast("string").alias("text"))
    docs.append_documents(failing, target, "1")
    assert docs.read_documents(spark, target).count() == 1


def test_samples_are_written_compressed(spark, tmp_path):
    samples = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("config_id"), *[(F.col("id") * i / 7).alias(f"a_long_name_{i}") for i in range(20)])
    plain, target = str(tmp_path / "plain"), str(tmp_path / "samples")
    samples.coalesce(1).write.json(plain)
    for part in (F.col("a_long_name_1") < 9, F.col("a_long_name_1") >= 9):
        sinks.write_samples(samples.filter(part).coalesce(1), target, append=True)
    size = lambda p: sum(f.stat().st_size for f in Path(p).glob("part-*"))
    assert 2 * size(target) < size(plain)
    back = spark.read.schema(samples.schema).json(target)
    assert sorted(back.collect()) == sorted(samples.collect())
