"""Column builders on literal rows, edge cases included."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tunelake.catalog import knob_records, knob_table, renamed
from tunelake.constants import KNOB_RENAMES, METRIC_NAMES, SCALE_WORDS
from tunelake.functions import labels as lab
from tunelake.functions import scaling as sc
from tunelake.functions import text as tx


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, rows, kind, build):
    return [r[0] for r in values(spark, [(x,) for x in rows], f"x {kind}", build(F.col("x")).alias("y"))]


def test_catalog_has_44_sorted_knobs(spark):
    knobs = knob_records()
    assert len(knobs) == 44
    assert [k.knob for k in knobs] == sorted(k.knob for k in knobs)
    assert sum(k.type == "real" for k in knobs) == 5
    assert [tuple(r) for r in knob_table(spark).orderBy("knob").collect()] == [tuple(k) for k in knobs]


def test_normalize_clip(spark):
    got = one(spark, [-5.0, 0.0, 2.5, 10.0, 99.0], "double", lambda x: sc.normalize_clip(x, 0.0, 10.0))
    assert got == [0.0, 0.0, 0.25, 1.0, 1.0]
    assert one(spark, [7.0], "double", lambda x: sc.normalize_clip(x, 3.0, 3.0)) == [0.0]
    assert one(spark, [None, 1.0], "double", lambda x: sc.bucket(sc.normalize_clip(x, 0.0, 1.0))) == [None, 9]


def test_normalize_raw_drops_flat_ranges(spark):
    assert one(spark, [20.0], "double", lambda x: sc.normalize_raw(x, 0.0, 10.0)) == [2.0]
    assert one(spark, [20.0], "double", lambda x: sc.normalize_raw(x, 5.0, 5.0)) == [None]


def test_clip_text_equals_builder(spark):
    rows = [(x,) for x in (None, -1.0, 0.0, 3.3, 7.0, 11.0)]
    got = values(spark, rows, "x double", sc.normalize_clip(F.col("x"), 0.5, 9.5), F.expr(sc.clip_text("x", 0.5, 9.5)))
    assert all(a == b for a, b in got)
    assert got[0] == (None, None)


def edge_positions():
    out = [0.0, 1.0]
    for i in range(1, 10):
        edge = i / 10
        out += [math.nextafter(edge, 0), edge, math.nextafter(edge, 1)]
    return out


def test_both_decile_rules_at_the_edges(spark):
    points = edge_positions()
    by_percent = [min(int(p * 100 // 10), 9) for p in points]
    by_edge = [sum(p >= i / 10 for i in range(1, 10)) for p in points]
    assert one(spark, points, "double", sc.bucket) == by_percent
    assert one(spark, points, "double", lambda _: sc.bucket_by_threshold("x")) == by_edge
    assert by_percent != by_edge


@pytest.mark.parametrize("style", [lab.RANGE, lab.PADDED])
def test_labels_round_trip(spark, style):
    texts = one(spark, list(range(10)), "int", lambda x: lab.bucket_label(x, style))
    assert texts[0] == ("0-10%" if style == lab.RANGE else "00% to 10%")
    assert texts[9] == ("90-100%" if style == lab.RANGE else "90% to 100%")
    assert one(spark, texts, "string", lab.label_bucket) == list(range(10))


def test_foreign_labels_have_no_bucket(spark):
    assert one(spark, ["middle", "5-15%", "0% to 10%", "", None], "string", lab.label_bucket) == [None] * 5
    assert one(spark, ["00% to 10%", "0-10%"], "string", lab.range_bucket) == [None, 0]
    assert one(spark, [-1, 10], "int", lab.bucket_label) == [None, None]


def test_word_scale(spark):
    assert one(spark, list(range(9)), "int", lambda x: lab.bucket_label(x, lab.WORDS)) == SCALE_WORDS
    assert one(spark, SCALE_WORDS + ["none"], "string", lab.word_bucket) == list(range(9)) + [None]


def test_decode_stays_in_its_bucket(spark):
    rows = [(k.knob, k.type, k.min, k.max, k.default, b) for k in knob_records() for b in range(10)]
    df = spark.createDataFrame(rows, "knob string, type string, min double, max double, default double, b int")
    value = sc.decode_bucket(F.col("b"), F.col("min"), F.col("max"), F.col("default"), F.col("type"))
    out = df.select("*", value.alias("v"), sc.bucket(sc.normalize_clip(value, F.col("min"), F.col("max"))).alias("back"))
    wide = out.filter((F.col("type") == "real") | (F.col("max") - F.col("min") >= 100))
    assert wide.filter(F.col("b") != F.col("back")).count() == 0
    whole = out.filter((F.col("type") == "integer") & (F.col("v") != F.floor("v")))
    assert whole.count() == 0


def test_decode_flat_range_gives_default(spark):
    rows = [(3, 5.0, 5.0, 7.0, "integer")]
    build = sc.decode_bucket(F.col("b"), F.col("lo"), F.col("hi"), F.col("d"), F.col("t"))
    assert values(spark, rows, "b int, lo double, hi double, d double, t string", build) == [(7.0,)]


def test_signs_and_ratios(spark):
    assert one(spark, [-4.0, 0.0], "double", lambda c: sc.cost_to_y(c)) == [[4.0, 0.25], [0.0, 0.0]]
    assert one(spark, [5.0, -5.0, 0.0], "double", sc.negative_cost) == [-5.0, -5.0, 0.0]
    assert one(spark, [110.0], "double", lambda x: sc.improvement_pct(x, F.lit(100.0))) == [10.0]
    assert one(spark, [110.0], "double", lambda x: sc.improvement_pct(x, F.lit(0.0))) == [None]
    assert one(spark, [3.0], "double", sc.blocks_to_bytes) == [24576.0]


def test_crash_cap_without_valid_runs(spark):
    rows = [(0.0, None), (2147483647.0, -3.0), (-2.0, -1.0)]
    assert values(spark, rows, "c double, w double", sc.capped_cost(F.col("c"), F.col("w"))) == [(-1.0,), (-3.0,), (-2.0,)]


def test_float_text_matches_json(spark):
    xs = [0.0, 1.0, -2.5, 0.1, 12.3, 891595.0, 15084363776.0, 15084363776.25, 1e15, 1e16, 1.5e22, 0.0001, 0.00001, 2.5e-7]
    assert one(spark, xs, "double", tx.float_text) == [json.dumps(x) for x in xs]


def test_humanize_metric(spark):
    want = {
        0.0: "0k", 0.2: "low", 0.3333: "middle", 0.5: "middle", 0.66667: "high", 0.9: "high", 1.0: "1.0",
        12.345: "12.34", 999.999: "999.99", 1000.0: "1k", 1999.0: "1k", 999999.9: "999k", 1e6: "1.0 million",
        15084363776.0: "15084.3 million", -5000.0: "-5k",
    }
    assert one(spark, list(want), "double", tx.humanize_metric) == list(want.values())


def test_humanize_cost(spark):
    xs = [0.25, 0.35, 0.05, 999.9, 999.95, 1000.0, 1000.1, 999999.0, 1e6, 2.7e6, -1234.56]
    want = ["0.2", "0.3", "0.1", "999.9", "1000.0", "1000.0", "1k", "999k", "1 million", "2 million", "-1234.6"]
    assert one(spark, xs, "double", tx.humanize_cost) == want


def test_metrics_json_is_indented_json(spark):
    row = [float(i) for i in range(14)]
    got = one(spark, [row], "array<double>", tx.metrics_json)[0]
    assert got == json.dumps(dict(zip(METRIC_NAMES, row)), indent=2)


def test_metrics_map_needs_14_values(spark):
    good, short = one(spark, [[1.0] * 14, [1.0] * 13], "array<double>", tx.metrics_map)
    assert good == dict.fromkeys(METRIC_NAMES, 1.0) and short is None


def test_json_object_leaves_out_nulls(spark):
    rows = [("1", None), (None, None)]
    build = tx.json_object_text(tx.json_line("a", F.col("a")), tx.json_line("b", F.col("b")))
    assert values(spark, rows, "a string, b string", build) == [('{\n  "a": 1\n}',), ("{}",)]


def test_extract_json_object(spark):
    texts = [
        'Answer: {"a": "x", "b": 2} done', "{}", "none", "{broken", '{"a": 1} and {"b": 2}', '{"a": 1}, {"b": 2}',
        '{"a": "1", "a": "2"}', "{'a': 'b'}", '} {', '{"a": {"b": 1}}',
    ]
    got = one(spark, texts, "string", tx.extract_json_object)
    assert got[0] == {"a": "x", "b": "2"}
    assert got[1] == {}
    assert got[2:6] == [None, None, None, None]
    assert got[6] == {"a": "2"}
    assert got[7:9] == [None, None]
    assert got[9] == {"a": '{"b":1}'}


def test_workload_key(spark):
    paths = ["./oltp_workloads/ycsb/sample_ycsb_config104.xml", "tpch_1.wg", "a/b/tpch_2.wg"]
    assert one(spark, paths, "string", tx.workload_database) == ["ycsb", None, "b"]
    assert one(spark, paths, "string", tx.workload_name) == ["sample_ycsb_config104", "tpch_1", "tpch_2"]


def test_strip_prompt(spark):
    rows = [("ask me\n the answer ", "ask me"), ("other answer", "ask me")]
    assert values(spark, rows, "t string, p string", tx.strip_prompt(F.col("t"), F.col("p"))) == [("the answer",), ("other answer",)]


def test_chat_prompt_with_and_without_system(spark):
    rows = [("S", "I", "X"), ("", "I", "X"), (None, "I", None)]
    got = values(spark, rows, "s string, i string, x string", tx.chat_prompt(F.col("s"), F.col("i"), F.col("x")))
    tail = "<|im_start|>user\nI\nX<|im_end|>\n<|im_start|>assistant\n"
    assert got[0][0] == "<|im_start|>system\nS<|im_end|>\n" + tail
    assert got[1][0] == tail
    assert got[2][0] == "<|im_start|>user\nI\n<|im_end|>\n<|im_start|>assistant\n"


TEXT = ";SELECT 1;\n\n-- note\n# other\nSELECT 2 ;;\n  SELECT 3\n"


def test_three_statement_rules(spark):
    got = values(
        spark, [(TEXT,)], "x string",
        tx.replay_statements(F.col("x")), tx.semicolon_statements(F.col("x")), tx.line_statements(F.col("x")),
    )[0]
    assert got[0] == [";", "SELECT 1;", "-- note;", "# other;", "SELECT 2 ;", "  SELECT 3;"]
    assert got[1] == ["SELECT 1", "-- note\n# other\nSELECT 2", "SELECT 3"]
    assert got[2] == [";SELECT 1", "SELECT 2 ;", "SELECT 3"]
    assert one(spark, [""], "string", tx.replay_statements) == [[]]


def test_renames(spark):
    names = list(KNOB_RENAMES) + ["work_mem"]
    assert one(spark, names, "string", renamed) == list(KNOB_RENAMES.values()) + ["work_mem"]


def test_feature_text_rounds_like_text_formatting(spark):
    rows = [(3, 0.125, 2.675, 1.0, 0.0, 1.005)]
    build = tx.feature_text(F.col("n"), [F.col(c) for c in "abcde"])
    got = values(spark, rows, "n int, a double, b double, c double, d double, e double", build)[0][0]
    want = [3] + [round(v, 2) for v in rows[0][1:]]
    assert [p.split(": ")[1] for p in got.strip().rstrip(";").split("; ")] == [str(v) for v in want]
