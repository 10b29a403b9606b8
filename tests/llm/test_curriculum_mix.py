"""Mixing by a curriculum: targets by fractions, words and order against a plain simulation."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tunelake.llm.curriculum_mix import EPOCHS, SCHEDULES, WEIGHTS, mixed_documents, sized, source_targets, time_of, training_copies, training_order

SCHEMA = "doc_id long, text string, source string"


def shares(sizes, weights):
    """The rule as it is stated: share out, stop what is above its bound, share the excess again."""
    total, target = sum(sizes), [Fraction(0)] * len(sizes)
    open_, rest = set(range(len(sizes))), Fraction(total)
    while open_ and rest > 0:
        units, excess = sum(weights[i] for i in open_), Fraction(0)
        for i in list(open_):
            target[i] += rest * weights[i] / units
        for i in list(open_):
            if target[i] >= EPOCHS * sizes[i]:
                excess += target[i] - EPOCHS * sizes[i]
                target[i] = Fraction(EPOCHS * sizes[i])
                open_.discard(i)
        rest = excess
    return target


def made_rows():
    draw = random.Random(4)
    rows = []
    for i in range(500):
        source = draw.choice(["web"] * 6 + ["é", "Z", "a", "aa", "", None, "b", "c", "\U0001f600", "￮"])
        n = draw.choice([0, 1, 3, 40, 200]) if source in ("web", "a") else draw.choice([0, 1, 2, 5])
        rows.append((i, draw.choice([" ", "\n", " \t"]).join(["w"] * n) if n else draw.choice(["", None, " \n"]), source))
    return rows + [(9003, "one two", "web")] * 200 + [(None, "no id", "web"), (None, None, None)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).selectExpr("*", "1 AS size", "'x' AS _source", "2 AS step")


def test_targets_and_words(frame):
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in made_rows()]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = collections.Counter()
    for _, n, s in rows:
        size[s] += n
    target = dict(zip(sources, shares([size[s] for s in sources], [WEIGHTS[i % 3] for i in range(len(sources))])))
    assert any(target[s] == 3 * size[s] > 0 for s in sources) and any(0 < target[s] < size[s] for s in sources)

    source_of = {i: s for i, _, s in rows if i is not None}
    got = mixed_documents(frame).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for i, n, _ in rows)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= EPOCHS * r.size and (r.taken > 0) == (r.first_step is not None) == (r.epochs > 0)
        if r.doc_id is not None:
            source = source_of[r.doc_id]
            assert r.source_size == size[source] and r.target == pytest.approx(float(target[source]), rel=1e-12)
            taken[source] += r.taken
    taken["web"] += sum(r.taken for r in got if r.doc_id is None and r.size)
    for s in sources:
        assert taken[s] == int(target[s])


def test_order_follows_the_demand(frame):
    rows = sized(frame)
    copies = training_order(training_copies(rows, source_targets(rows))).collect()
    by_step = sorted(copies, key=lambda r: r.step)
    assert [r.step for r in by_step] == list(range(len(copies)))
    assert all(a.position <= b.position for a, b in zip(by_step, by_step[1:]))
    assert all(0 < r.position < 1 for r in copies)
    for r in copies:  # the integral of the schedule up to the position is the share of words before its middle
        points, done, whole = SCHEDULES[r.place % 3], 0.0, 0.0
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            whole += (w0 + w1) / 2 * (t1 - t0)
            end = min(max(r.position, t0), t1)
            done += (end - t0) * (w0 + (w1 - w0) * (end - t0) / (t1 - t0) / 2)
        assert done / whole == pytest.approx((r.start + r.words / 2) / r.quota, abs=1e-9)
    # Words of a source lie in a row without gaps or overlaps, in the order of the hash of the ids.
    for source in {r._source for r in copies}:
        mine = sorted((r for r in copies if r._source == source), key=lambda r: r.start)
        assert mine[0].start == 0 and mine[-1].start + mine[-1].words == mine[0].quota
        assert all(a.start + a.words == b.start for a, b in zip(mine, mine[1:]))
        first = [hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest() for r in mine if r.epoch == 0]
        assert first == sorted(first)


def test_reruns_agree_in_any_layout(spark, frame):
    def run(f):
        return sorted(tuple(-1 if v is None else v for v in r) for r in mixed_documents(f).collect())

    assert run(frame) == run(frame.repartition(7, F.rand(3)))


def test_no_words(spark):
    assert mixed_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixed_documents(spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)).collect()
    assert all((r.size, r.taken, r.target, r.first_step) == (0, 0, 0.0, None) for r in got) and len(got) == 2


def test_one_document_per_source(spark):
    rows = [(i, "w " * (i + 1), f"s{i:02d}") for i in range(40)]
    got = {r.doc_id: r for r in mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = shares([i + 1 for i in range(40)], [WEIGHTS[i % 3] for i in range(40)])
    assert all(got[i].target == pytest.approx(float(want[i])) and got[i].taken == int(want[i]) for i in range(40))


def test_long_text(spark):
    got = mixed_documents(spark.createDataFrame([(1, "word " * 400_000, "a")], SCHEMA)).first()
    assert (got.size, got.taken, got.target) == (400_000, 400_000, 400_000.0)


def test_time_of_is_the_ends(spark):
    for schedule in SCHEDULES:
        lo, hi = spark.range(1).select(time_of(F.lit(0.0), schedule), time_of(F.lit(1.0), schedule)).first()
        assert lo == pytest.approx(schedule[0][0]) and hi == pytest.approx(schedule[-1][0])
