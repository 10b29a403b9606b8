"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest

import corpus_pipeline
from tunelake.llm import (
    best_fit_packing,
    byte_bpe,
    crf_language_id,
    exact_dedup,
    hilbert_sharding,
    line_dedup,
    ngram_jaccard_join,
    parsing_fingerprint,
    pitman_yor_lm,
    suffix_dedup,
)

LONG = "ein sehr langer text über alles und nichts " * 4000
ROWS = [
    (1, "The cat sat on the mat.\nIt was black.", "en", "s0", 38),
    (2, "The cat sat on the mat.\nIt was black.", "en", "s1", 38),
    (2, "The cat sat on the mat.\nIt was black.", "en", "s1", 38),
    (3, None, None, None, None),
    (4, "", "de", "s0", 0),
    (5, " \n\t ", "de", None, 4),
    (6, LONG, "de", "s0", len(LONG)),
    (7, "x" * 5000, "en", "s2", 5000),
    (8, "12345 !!! 678", None, "s2", 13),
    (None, "a row without an id \x00 é 漢字 <|endoftext|>", "fr", "s3", 9),
    (10, "THE CAT SAT ON THE MAT.\nIT WAS BLACK.", "en", "s0", 38),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["n", "keys", "set_id", "rep", "shard", "component_id", "lang_pred", "score", "fingerprint", "bucket", "size", "_pos", "_lang", "_name", "c1"]


def operators():
    fold = {"learn": "doc_id % 10 <> 0", "held_out": "doc_id % 10 = 0"}
    return {
        "jaccard": (ngram_jaccard_join.linked_documents, 1),
        "lines": (line_dedup.without_repeated_chunks, 1),
        "fingerprint": (parsing_fingerprint.compare_edited, 1),
        "packing": (best_fit_packing.pack, None),
        "exact": (exact_dedup.exact_groups, 1),
        "language": (lambda d: crf_language_id.with_language(d.select("doc_id", "text", "lang"), d), 1),
        "model": (lambda d: pitman_yor_lm.scored(d.selectExpr("doc_id", "text", *[f"coalesce({e}, false) AS {n}" for n, e in fold.items()])), 1),
        "bpe": (byte_bpe.encode_documents, 1),
        "suffixes": (suffix_dedup.removal_report, 1),
        "shards": (hilbert_sharding.hilbert_shards, 1),
    }


@pytest.fixture(scope="module")
def edge(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'other' AS {name}")
    return frame


@pytest.mark.parametrize("name", list(operators()))
def test_edge_rows(edge, name):
    operator, per_row = operators()[name]
    found = operator(edge).collect()
    if per_row:
        assert len(found) == len(ROWS)
    assert {r["doc_id"] for r in found} == {r[0] for r in ROWS}


@pytest.mark.parametrize("name", list(operators()))
def test_empty_table(spark, name):
    assert operators()[name][0](spark.createDataFrame([], SCHEMA)).collect() == []


def test_edge_results(edge):
    groups = {(r.doc_id, r.kept): r for r in exact_dedup.exact_groups(edge).collect()}
    assert groups[10, True].group_size == 4 and groups[1, False].keep_id == 10
    assert groups[4, True].group_size == 2 and groups[3, False].keep_id == 4
    linked = {r.doc_id: r for r in ngram_jaccard_join.linked_documents(edge).collect()}
    assert linked[10].component_id == 1 and linked[3].n_shingles == 0 and linked[5].component_id == 5 and linked[None].component_id is None
    told = {r.doc_id: r for r in crf_language_id.with_language(edge.select("doc_id", "text"), edge).collect()}
    assert [told[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4 and told[3].score == 0
    assert told[6].lang_pred == "de" and told[1].lang_pred == "en"
    prints = {r.doc_id: r for r in parsing_fingerprint.compare_edited(edge).collect()}
    assert prints[3].fingerprint == prints[4].fingerprint and prints[1].fingerprint == prints[2].fingerprint
    assert prints[3].n_chars == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_edges(spark, edge, stage):
    step = dict(corpus_pipeline.STAGES)[stage]
    found = step(spark, edge, "")
    if stage != "best_fit_packing":
        assert found.columns == edge.columns
    assert found.collect()
    assert step(spark, edge.limit(0), "").collect() == []


def test_edge_stages(spark, edge):
    steps = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in steps["language_id"](spark, edge, "").collect()} == {1, 2, 6, 7, None, 10}
    assert sorted(r.doc_id or 0 for r in steps["exact_dedup"](spark, edge, "").collect()) == [0, 4, 5, 6, 7, 8, 10]
