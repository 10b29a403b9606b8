"""Conversation repair against a search over whole audits, in one piece and in blocks."""

import hashlib
import random
import re
import zlib

import pytest

from tunelake.llm.conversation_repair import TRANSFERS, crossings, damaged, forward, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def expected(rows):
    """Every state keeps its cheapest whole audit and the whole text; no halves, no ranks."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r[2], r[3])))
    seen, counts, marks = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        mark = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marks.append(mark)
        if mark:
            counts[mark] += 1
    role_of = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}
    for (_, _, role, text), mark in zip(rows, marks):
        after = {}

        def put(ends, cost, audit, lines):
            if re.fullmatch("s?|s?(ua)+|s?(ua)*u", ends):
                ends = ends if len(ends) < 4 else ends[-2:]  # "ua" and "uaua" go on alike
                ends = {"sua": "ua", "uau": "u", "su": "u", "au": "u"}.get(ends, ends)
                after[ends] = min(after.get(ends, (cost, audit, lines)), (cost, audit, lines))

        starts = list(ways.items()) + [
            (ends + new, (cost + 5, audit + "I", (*lines, role_of[new] + ":"))) for ends, (cost, audit, lines) in ways.items() for new in "ua" if re.fullmatch("s?(ua)*u?", (ends + new))
            or (ends == "ua" and new == "u")
        ]
        for ends, (cost, audit, lines) in starts:
            ends = {"uau": "u"}.get(ends, ends)
            put(ends, cost + 2, audit + "D", lines)
            if mark not in ("blank", "duplicate"):
                left = 5 * (mark == "truncated")
                if role[:1] in ("s", "u", "a"):
                    put(ends + role[0], cost + left, audit + "K", (*lines, f"{role}:{text}"))
                for new in "ua":
                    put(ends + new, cost + left + 1, audit + "R", (*lines, f"{role_of[new]}:{text}"))
        ways = after
    ended = [w for ends, w in ways.items() if ends in ("", "ua")]
    ended += [(c + 5, a + "I", (*li, "assistant:")) for ends, (c, a, li) in ways.items() if ends == "u"]
    cost, audit, lines = min(ended)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **counts,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def made_rows():
    draw = random.Random(11)
    rows = []
    for conv_id in [*range(60), None]:
        for _ in range(draw.choice([1, 2, 3, 5, 8, 30])):
            turn = draw.choice([None, *range(12)])
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = draw.choice(["Yes.", "No", "  ", "", None, "Why?\n", "Well! ", "é:漢", "user:x.", "a\x00b."]) 
            rows.append((conv_id, turn, role, text))
    return rows + rows[:5] + [(7, 3, "user", "Same.")] * 6


@pytest.fixture(scope="module")
def cases():
    rows = made_rows()
    kept = damage(rows)
    return rows, {c: expected([r for r in kept if r[0] == c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_equals_search(spark, cases, block_rows):
    rows, want = cases
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS part", "1 AS gone", "2 AS pos")
    got = {r.conv_id: r.asDict() for r in repair_conversations(damaged(frame), block_rows).collect()}
    assert set(got) == set(want)
    for conv_id, row in got.items():
        assert {k: v for k, v in row.items() if k != "conv_id"} == want[conv_id], conv_id


def test_one_conversation_over_many_partitions(spark):
    draw = random.Random(3)
    rows = [(5, t, draw.choice(["user", "assistant", "system"]), draw.choice(["Yes.", "No", f"Turn {t % 40}."])) for t in range(900)]
    got = repair_conversations(damaged(spark.createDataFrame(rows, SCHEMA).repartition(6)), 16).collect()
    assert len(got) == 1
    assert {k: v for k, v in got[0].asDict().items() if k != "conv_id"} == expected(damage(rows))


def test_no_rows(spark):
    assert repair_conversations(damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    lost = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = repair_conversations(damaged(spark.createDataFrame([(1, lost, "user", "Gone.")], SCHEMA))).first()
    assert (got.cost, got.audit, got.gaps, got.repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())


def test_extreme_turns_and_long_texts(spark):
    big = (1 << 63) - 1
    rows = [(1, -big, "user", "x " * 300_000 + "."), (1, big, "assistant", "y" * 500_000 + "!")]
    got = repair_conversations(damaged(spark.createDataFrame(rows, SCHEMA)), block_bytes=1000).first()
    assert {k: v for k, v in got.asDict().items() if k not in ("conv_id", "gaps")} == {k: v for k, v in expected(damage(rows)).items() if k != "gaps"}
    assert got.gaps in (0, big)


def test_halves_meet_on_the_forward_way():
    draw = random.Random(2)
    kinds = list(TRANSFERS)
    for _ in range(200):
        parts = [TRANSFERS[draw.choice(kinds)] for _ in range(draw.randint(1, 12))]
        for end, (cost, _) in forward(parts, 0).items():
            ways = crossings(parts, 0, end)
            assert ways[0][0] == 0 and ways[-1][1] == end
            assert all(a[1] == b[0] for a, b in zip(ways, ways[1:]))
            assert sum(min(c for a, b, c, _ in part if (a, b) == way) for part, way in zip(parts, ways)) == cost
