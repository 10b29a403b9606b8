"""Groups from runs of the content sort, with groups that splitters cut; lines of long texts."""

import hashlib
import random
from collections import defaultdict

import pytest

from tunelake.llm import exact_dedup, line_dedup

SCHEMA = "doc_id long, text string"


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for nth, doc_id in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            out.append((doc_id, keep, len(ids), nth == 0, hashlib.sha256(norm).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("shape", ["one group", "a third", "mixed", "distinct"])
def test_equals_groups(spark, shape):
    draw = random.Random(2)
    texts = {
        "one group": lambda i: "SAME text",
        "a third": lambda i: "Hot" if i % 3 == 0 else f"t{i % 50}",
        "mixed": lambda i: draw.choice([None, "", "a", "A", "é", "É", f"x{i}"]) if i % 2 else "common head " * 20 + str(i % 9),
        "distinct": lambda i: f"text {i}",
    }[shape]
    rows = [(i, texts(i)) for i in range(1500)] + [(None, "Hot"), (None, "hot"), (7, "hot"), (7, "HOT")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_texts_under_one_hash_are_told_apart(spark, monkeypatch):
    rows = [(i, f"t{i % 5}") for i in range(60)]
    monkeypatch.setattr(exact_dedup, "with_sort_key", lambda r, k=exact_dedup.with_sort_key: k(r).selectExpr("doc_id", "text", "CAST('' AS BINARY) AS _head", "0L AS _name"))
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)


def test_lines_of_a_long_text(spark):
    """Two copies of 100,000 lines: the second one keeps its short chunks only, as the lines before a change do."""
    lines = [f"line {i}" for i in range(100_000)]
    text = "\n".join(lines)
    moved = "\n".join(["new first line", *lines])
    got = {r.doc_id: r for r in line_dedup.without_repeated_chunks(spark.createDataFrame([(1, text), (2, moved), (3, text + "\n" + text)], SCHEMA)).collect()}
    assert got[1].n_removed_lines == 0 and got[1].text == text
    assert got[2].n_lines == 100_001 and got[2].n_removed_lines > 90_000
    assert got[3].n_removed_lines > 180_000 and "line 99999" in (got[1].text or "")
