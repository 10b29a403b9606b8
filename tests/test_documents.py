"""The data sources for documents and logs: splits, pushdown, commits; and what is built on them."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from tunelake.operators.log_events import distinct_records, pair_runs
from tunelake.operators.skew import carried_forward
from tunelake.sources import sinks
from tunelake.sources.documents import ByteRange, FilteringDocumentReader, LogReader, append_documents, read_documents, read_log


def files_of(n=40):
    return [(f"data/w{i % 4}_smac_output/run_{i % 3}/h é{i}.json", "" if i == 3 else json.dumps({"i": i}) + "\n" * (i % 5)) for i in range(n)]


@pytest.fixture
def bundled(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame = spark.createDataFrame(files_of(), "path string, text string")
    append_documents(frame.repartition(3), path, "first", bundle_bytes="5000")
    return path


def rows(df):
    return sorted((r.path, r.text) for r in df.collect())


def test_documents_come_back(spark, bundled):
    got = read_documents(spark, bundled).collect()
    assert sorted((r.path, r.text) for r in got) == sorted(files_of())
    assert {(r.name, r.folder) for r in got} == {(p.split("/")[-1], p.split("/")[-2]) for p, _ in files_of()}


def test_repeated_commit_adds_nothing(spark, bundled):
    frame = spark.createDataFrame(files_of(), "path string, text string")
    append_documents(frame, bundled, "first")
    assert read_documents(spark, bundled).count() == 40
    append_documents(spark.createDataFrame([("later.json", None)], "path string, text string"), bundled, "second")
    append_documents(frame.limit(2), bundled)
    append_documents(frame.limit(0), bundled, "empty")
    assert read_documents(spark, bundled).count() == 43


def test_what_no_commit_lists_is_not_read(spark, bundled, tmp_path):
    known = next((tmp_path / "docs").glob("*.bundle.tar"))
    (tmp_path / "docs" / "000000-left-behind.bundle.tar").write_bytes(known.read_bytes()[:700])
    (tmp_path / "docs" / "plain.json").write_text("[]")
    got = read_documents(spark, "file://" + bundled)
    assert got.count() == 41 and rows(got.filter("name = 'plain.json'"))[0][1] == "[]"


def test_small_files_share_partitions(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02d}.txt").write_text("x" * 100)
    (tmp_path / "_hidden.txt").write_text("no")
    assert read_documents(spark, str(tmp_path), partition_bytes="1000").rdd.getNumPartitions() == 3
    assert read_documents(spark, str(tmp_path), "f0*").count() == 10


def test_filters_choose_files(spark, bundled):
    found = read_documents(spark, bundled, pushdown=True)
    chosen = found.filter("folder IN ('run_1', 'run_2') AND name LIKE 'h %' AND endswith(path, '1.json') AND length(text) > 0")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "run_1" not in plan and "length(text" in plan
    want = [(p, t) for p, t in files_of() if "/run_0/" not in p and p.endswith("1.json") and t]
    assert rows(chosen) == sorted(want)
    found = read_documents(spark, bundled)
    assert found.filter("folder = 'run_0'").union(found.filter("folder = 'run_1'")).groupBy("folder").count().count() == 2
    assert rows(found.filter("folder = 'run_0' OR name = 'x'")) == sorted((p, t) for p, t in files_of() if "/run_0/" in p)


def test_filtered_files_are_not_opened(tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_bytes(b"\xff\xfe not text")
    reader = FilteringDocumentReader({"path": str(tmp_path)})
    other = GreaterThan(("name",), "a")
    assert reader.pushFilters([EqualTo(("name",), "a.json"), other]) == [other]
    assert [p.paths for p in reader.partitions()] == [[str(tmp_path / "a.json")]]


def test_a_folder_without_documents(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read_documents(spark, str(tmp_path / "none")).collect() == []
    assert read_log(spark, str(tmp_path / "none")).collect() == []


def log_text(n, seed=1):
    draw = random.Random(seed)
    records = []
    for i in range(n):
        message = draw.choice([f"m{i}", "", f"[not a head {i}", "é" * draw.randint(1, 30), "a\nb\n\n  c", "[x:y#L1:INFO]:no blank", "\n\n"])
        records.append((f"2025-01-01 {i:02d}:00,1", f"f{i % 3}.py", i, draw.choice(["INFO", "ERROR"]), message))
    return records, "".join(f"[{t}:{f}#L{n}:{level}]: {m}\n" for t, f, n, level, m in records)


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_records_over_any_split(tmp_path, size):
    records, text = log_text(60)
    preamble = "before the first\nrecord\n"
    (tmp_path / "log").write_text(preamble + text)
    reader = LogReader({"path": str(tmp_path), "partition_bytes": str(size)})
    got = [r for part in reader.partitions() for r in reader.rows(part)]
    assert got[0][2:] == (None, None, None, None, "before the first\nrecord")
    assert [r[2:] for r in got[1:]] == records
    data = (preamble + text).encode()
    assert all(data[r[1] :].startswith(f"[{r[2]}".encode()) for r in got[1:])


def test_log_without_a_last_line_end_and_without_heads(tmp_path):
    (tmp_path / "a").write_text("[t:f#L1:INFO]: x\nlast")
    (tmp_path / "b").write_text("only\nlines")
    reader = LogReader({"path": str(tmp_path), "partition_bytes": "5"})
    assert [(r[1], r[-1]) for part in reader.partitions() for r in reader.rows(part)] == [(0, "x\nlast"), (0, "only\nlines")]
    assert list(reader.rows(ByteRange(str(tmp_path / "b"), 5, 10))) == []


def test_log_filters(spark, tmp_path):
    records, text = log_text(100)
    (tmp_path / "log").write_text("pre\n" + text)
    found = read_log(spark, str(tmp_path), pushdown=True, partition_bytes="500")
    errors = found.filter("level = 'ERROR' AND file IN ('f0.py', 'f1.py')")
    assert "ERROR" not in errors._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.line_no for r in errors.collect()) == [r[2] for r in records if r[3] == "ERROR" and r[1] != "f2.py"]
    assert read_log(spark, str(tmp_path)).filter("level IS NULL").count() == 1


def test_runs_are_paired(spark, tmp_path):
    lines = [
        "BenchBase tpcc throughput: 1.0", "Running BenchBase with benchmark: a", "note", "BenchBase tpcc throughput: 2.5", "BenchBase tpcc throughput: 9.0",
        "Running BenchBase with benchmark: b", "failed\n  at x", "Running BenchBase with benchmark: c",
    ]
    def text(found, base):
        return "".join(f"[t{base + i}:f.py#L{i}:INFO]: {m}\n" * 2 for i, m in enumerate(found))
    (tmp_path / "log.1").write_text(text(lines, 0))
    (tmp_path / "log.2").write_text(text(["more", "BenchBase ycsb throughput: 4.0"], 100))
    got = pair_runs(distinct_records(read_log(spark, str(tmp_path), partition_bytes="90"))).collect()
    assert sorted((r.started, r.benchmark, r.throughput, r.ended) for r in got) == [("t1", "a", 2.5, "t3"), ("t5", "b", None, None), ("t7", "c", 4.0, "t101")]


def test_carried_forward_equals_a_window(spark):
    frame = spark.range(5000).selectExpr("id", "CASE WHEN hash(id) % 700 = 0 THEN id END AS value")
    got = carried_forward(frame, [F.col("id")], "value", "last", 8).orderBy("id").collect()
    last = None
    for r in got:
        last = r.value if r.value is not None else last
        assert r["last"] == last
    assert carried_forward(frame.limit(0), [F.col("id")], "value", "last").collect() == []


def test_samples_once(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "a long, b string"
    frame = spark.createDataFrame([(1, "x"), (2, None)], schema)
    assert sinks.committed_samples(spark, path, schema).collect() == []
    assert sinks.append_samples_once(frame, path, "run-1")
    assert not sinks.append_samples_once(frame, path, "run-1")
    frame.write.json(f"{path}/data/run-2")  # broke off before its record
    assert sinks.committed_samples(spark, path, schema).count() == 2
    assert sinks.append_samples_once(frame.limit(1), path, "run-2")
    assert sinks.committed(spark, path) == ["run-1", "run-2"] and sinks.committed_samples(spark, path, schema).count() == 3
    with pytest.raises(ValueError):
        sinks.append_samples_once(frame, path, "../up")
