"""Repair of conversations by Hirschberg's divide and conquer over four states.

A conversation is well formed when its role initials give `(s?(ua)+)?`. While one is read it is
in one of four states: nothing yet, after the system row, after a user row, after an assistant
row. Rows are kept, given another role, deleted, or preceded by an inserted row without text.
The cheapest edits that end well formed are the result, of equal ones the ASCII-least audit.

Everything is one rule for sequences of transfers, each a table of the least cost from state to
state. `crossings` takes the forward cost vector of the first half and the backward vector of
the second half, meets at the state with the least sum, and does the same in both halves, so it
holds two vectors of four and never a matrix of the sequence. A row is a transfer; so are a
block of rows, and all blocks of a conversation in one range partition. Ties need no texts:
audits of equally many rows never begin with one another, so a vector carries the rank of each
state's audit beside its cost, and the least rank of the optimal crossings is the audit-least.

Rows are dealt by sampled splitters over (conversation, turn), so a conversation of any size is
cut into blocks of bounded size. What lies inside one partition is repaired there. For what is
open at a border or longer than a block, the transfers of blocks are combined, crossings are
chosen from the top down, and each block finds its own edits. Only the digest of a repaired
text is one stream per conversation, as SHA-256 is sequential; its memory is bounded.

Null ids, turns, roles and texts are one space when damaged; a null id is a conversation of its
own, null turns come first. Rows of one turn are ordered by a digest of role and text, so that
repeated rows lie side by side. A role that is no known initial can be changed or deleted, not
kept. A conversation without rows after damage is well formed. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tunelake.llm.common import shuffle_partitions, slices_by_bytes
from tunelake.session import written

BLANK = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER_INSERT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
AFTER_KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# A block ends at the first of these two.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20

# A transfer lists (from, to, cost, rank); ranks order the audits that leave one state.
Transfer = list[tuple[int, int, int, int]]
EDITS = ["D", "ID", "IK", "IR", "K", "R"]
AT_END: Transfer = [(NOTHING, NOTHING, 0, 0), (ASSISTANT, NOTHING, 0, 0), (USER, NOTHING, INSERT, 1)]


def row_transfer(initial: str, gone: bool, truncated: bool) -> Transfer:
    """What one row may become; of equal costs the ASCII-least edits."""
    left = TRUNCATED * truncated
    found = []
    for start in range(4):
        best: dict[int, tuple[int, int]] = {}
        for rank, edits in enumerate(EDITS):
            state, cost = (AFTER_INSERT[start], INSERT) if edits[0] == "I" else (start, 0)
            if edits[-1] == "D":
                cost += DELETE
            elif gone:
                continue
            elif edits[-1] == "R":
                state, cost = AFTER_INSERT[state], cost + REROLE + left
            elif (state, initial) in AFTER_KEEP:
                state, cost = AFTER_KEEP[state, initial], cost + left
            else:
                continue
            best[state] = min(best.get(state, (cost, rank)), (cost, rank))
        found += [(start, state, cost, rank) for state, (cost, rank) in best.items()]
    return found


TRANSFERS = {(i, g, t): row_transfer(i, g, t) for i in ("s", "u", "a", "") for g in (False, True) for t in (False, True)}
ROW_EDITS = {key: {(a, b): EDITS[rank] for a, b, _, rank in found} for key, found in TRANSFERS.items()}


def forward(parts: Sequence[Transfer], start: int) -> dict[int, tuple[int, int]]:
    """State -> (least cost, rank of the least audit) after `parts`."""
    now = {start: (0, 0)}
    for part in parts:
        best: dict[int, tuple[int, int, int]] = {}
        for a, b, cost, rank in part:
            if a in now:
                way = (now[a][0] + cost, now[a][1], rank)
                if b not in best or way < best[b]:
                    best[b] = way
        order = sorted(best, key=lambda b: best[b][1:])
        now = {b: (best[b][0], rank) for rank, b in enumerate(order)}
    return now


def backward(parts: Sequence[Transfer], end: int) -> dict[int, int]:
    """State before `parts` -> least cost to get to `end`."""
    now = {end: 0}
    for part in reversed(parts):
        best: dict[int, int] = {}
        for a, b, cost, _ in part:
            if b in now and (a not in best or now[b] + cost < best[a]):
                best[a] = now[b] + cost
        now = best
    return now


def crossings(parts: Sequence[Transfer], start: int, end: int) -> list[tuple[int, int]]:
    """(state before, state after) of each part on the audit-least cheapest way."""
    if len(parts) <= 1:
        return [(start, end)] * len(parts)
    half = len(parts) // 2
    first, second = parts[:half], parts[half:]
    ahead, behind = forward(first, start), backward(second, end)
    meet = min((cost + behind[state], rank, state) for state, (cost, rank) in ahead.items() if state in behind)[2]
    return crossings(first, start, meet) + crossings(second, meet, end)


def combined(parts: Sequence[Transfer]) -> Transfer:
    return [(a, b, cost, rank) for a in range(4) for b, (cost, rank) in forward(parts, a).items()]


class Tally:
    """Counts of consecutive rows; two tallies that follow one another add up."""

    FIELDS = ["first_turn", "last_turn", "turns", "first_initial", "last_initial", "blank", "duplicate", "truncated", "illegal"]

    def __init__(self, values: dict | None = None):
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        for field in self.FIELDS if values else ():
            setattr(self, field, values[field])

    def add(self, other: Tally) -> None:
        if other.first_turn is not None:
            self.turns += other.turns - (self.last_turn == other.first_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        if other.first_initial is not None:
            met = self.last_initial is not None and self.last_initial + other.first_initial not in LEGAL
            self.illegal += other.illegal + met
            self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
            self.last_initial = other.last_initial
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated

    def values(self) -> dict:
        return {field: getattr(self, field) for field in self.FIELDS}

    def report(self) -> dict:
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def examined(rows: list[dict], again: Callable[[dict], bool]) -> tuple[list[tuple], Tally]:
    """The kind of each row (a key of TRANSFERS) and the counts of all."""
    kinds, tally = [], Tally()
    for row in rows:
        one = Tally()
        if row["turn"] is not None:
            one.first_turn = one.last_turn = row["turn"]
            one.turns = 1
        initial = row["role"][:1]
        one.first_initial = one.last_initial = initial
        bare = row["text"].rstrip(BLANK)
        gone = truncated = False
        if not bare:
            one.blank, gone = 1, True
        elif again(row):
            one.duplicate, gone = 1, True
        elif bare[-1] not in ".!?":
            one.truncated, truncated = 1, True
        tally.add(one)
        kinds.append((initial if initial in ("s", "u", "a") else "", gone, truncated))
    return kinds, tally


def repaired(rows: list[dict], kinds: list[tuple], ways: list[tuple[int, int]]) -> tuple[str, list[str]]:
    """The audit and the lines of rows whose states before and after are known."""
    audit, lines = [], []
    for row, kind, (state, after) in zip(rows, kinds, ways, strict=True):
        edits = ROW_EDITS[kind][state, after]
        audit.append(edits)
        if edits[0] == "I":
            state = AFTER_INSERT[state]
            lines.append(f"{NAMES[state]}:")
        if edits[-1] == "K":
            lines.append(f"{row['role']}:{row['text']}")
        elif edits[-1] == "R":
            lines.append(f"{NAMES[AFTER_INSERT[state]]}:{row['text']}")
    return "".join(audit), lines


def cheapest(parts: list[Transfer]) -> tuple[list[tuple[int, int]], str, int]:
    """For whole conversations: crossings of the parts, edits at the end, cost."""
    *ways, (last, _) = crossings([*parts, AT_END], NOTHING, NOTHING)
    return ways, "I" if last == USER else "", forward([*parts, AT_END], NOTHING)[NOTHING][0]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_NAMES = [field.split()[0] for field in RESULT.split(", ")]


def whole(conv_id: int | None, rows: list[dict]) -> dict:
    """The result for a conversation whose rows are all here."""
    seen: set[bytes] = set()

    def again(row: dict) -> bool:
        known = row["digest"] in seen
        seen.add(row["digest"])
        return known

    kinds, tally = examined(rows, again)
    ways, tail, cost = cheapest([TRANSFERS[kind] for kind in kinds])
    audit, lines = repaired(rows, kinds, ways)
    lines += ["assistant:"] * len(tail)
    text = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return {"conv_id": conv_id, **tally.report(), "cost": cost, "audit": audit + tail, "repaired_sha256": text}


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices_by_bytes(batches, BLOCK_BYTES):
        yield from batch.to_pylist()


def in_batches(df: DataFrame, step: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = 1000, size: int = BLOCK_BYTES) -> DataFrame:
    """`step` over the rows of each partition as records, out again in batches of bounded size."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        kept, held = [], 0
        for record in step(records(batches)):
            kept.append(record)
            held += sum(len(v) for v in record.values() if isinstance(v, (str, bytes)))
            if len(kept) >= rows or held >= size:
                yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                kept, held = [], 0
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    return df.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage, and `gone` rows so that no conversation is lost."""

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")).alias("text"),
        fault.alias("fault"),
    )
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fault") == 0).alias("gone"), twice.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by sampled splitters and sorted by conversation and turn; equal rows may be cut apart."""
    named = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    keyed = rows.withColumn("digest", named).withColumn("_uid", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "digest", "_uid"]
    return keyed.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order).drop("_uid")


OPEN = "part int, run int, block int, pos int, turn long, role string, text string, digest binary, fresh boolean"


def repair_inside(rows: Iterator[dict], block_rows: int, block_bytes: int) -> Iterator[dict]:
    """Results of conversations that lie inside the partition; the rows of all others in blocks.

    The first and the last conversation of a partition may go on in another one.
    """
    part, block = TaskContext.get().partitionId(), 0
    first, held, run = True, [], None

    def laid_open(conv_id):
        seen = set()
        for pos, row in enumerate(held):
            yield {"conv_id": conv_id, "part": part, "run": run, "block": block, "pos": pos, **{c: row[c] for c in ("turn", "role", "text", "digest")}, "fresh": row["digest"] not in seen}
            seen.add(row["digest"])
        if not held:  # keeps a conversation that lost all its rows
            yield {"conv_id": conv_id, "part": part, "run": run, "block": block, "pos": -1, "fresh": False}

    pending = None
    for conv_id, group in groupby(rows, key=lambda r: r["conv_id"]):
        if pending:
            if first or run is not None:
                run = block if run is None else run
                yield from laid_open(pending[0])
                block += 1
            else:
                yield whole(pending[0], held)
            first = False
        pending, held, run, size = (conv_id,), [], None, 0
        for row in group:
            if row["gone"]:
                continue
            if len(held) >= block_rows or size >= block_bytes:
                run = block if run is None else run
                yield from laid_open(conv_id)
                block += 1
                held, size = [], 0
            held.append(row)
            size += len(row["text"])
    if pending:
        run = block if run is None else run
        yield from laid_open(pending[0])


TALLY = "first_turn long, last_turn long, turns long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long"
TRANSFER = "transfer array<struct<a: int, b: int, cost: long, rank: int>>"


def packed(transfer: Transfer) -> list[dict]:
    return [dict(zip(("a", "b", "cost", "rank"), way, strict=True)) for way in transfer]


def unpacked(transfer: list[dict]) -> Transfer:
    return [(w["a"], w["b"], w["cost"], w["rank"]) for w in transfer]


def known_rows(group: Iterator[dict]) -> tuple[list[dict], list[tuple], Tally]:
    rows = [r for r in group if r["pos"] >= 0]
    return rows, *examined(rows, lambda r: not r["new"])


def sum_blocks(rows: Iterator[dict]) -> Iterator[dict]:
    for (part, run, block), group in groupby(rows, key=lambda r: (r["part"], r["run"], r["block"])):
        found = list(group)
        _, kinds, tally = known_rows(iter(found))
        yield {"conv_id": found[0]["conv_id"], "part": part, "run": run, "block": block, "transfer": packed(combined([TRANSFERS[k] for k in kinds])), **tally.values()}


def sum_runs(blocks: Iterator[dict]) -> Iterator[dict]:
    """The blocks of one conversation in one range partition as one transfer."""
    for (part, run), group in groupby(blocks, key=lambda r: (r["part"], r["run"])):
        transfer, tally, conv_id = None, Tally(), None
        for row in group:
            conv_id = row["conv_id"]
            own = unpacked(row["transfer"])
            transfer = own if transfer is None else combined([transfer, own])
            tally.add(Tally(row))
        yield {"conv_id": conv_id, "part": part, "run": run, "transfer": packed(transfer), **tally.values()}


def settle_conversations(runs: Iterator[dict]) -> Iterator[dict]:
    """States at the borders of range partitions, and in a row with part -1 what concerns the whole conversation."""
    for conv_id, group in groupby(runs, key=lambda r: r["conv_id"]):
        found, tally = list(group), Tally()
        for row in found:
            tally.add(Tally(row))
        ways, tail, cost = cheapest([unpacked(r["transfer"]) for r in found])
        yield {"conv_id": conv_id, "part": -1, "block": -1, **tally.report(), "cost": cost, "audit": tail}
        for row, (before, after) in zip(found, ways, strict=True):
            yield {"conv_id": conv_id, "part": row["part"], "run": row["run"], "before": before, "after": after}


def settle_runs(blocks: Iterator[dict]) -> Iterator[dict]:
    for _, group in groupby(blocks, key=lambda r: (r["part"], r["run"])):
        found = list(group)
        ways = crossings([unpacked(r["transfer"]) for r in found], found[0]["before"], found[0]["after"])
        for row, (before, after) in zip(found, ways, strict=True):
            yield {"part": row["part"], "run": row["run"], "block": row["block"], "before": before, "after": after}


def settle_blocks(rows: Iterator[dict]) -> Iterator[dict]:
    """The audit and the lines of each block."""
    for (part, _, block), group in groupby(rows, key=lambda r: (r["part"], r["run"], r["block"])):
        found = list(group)
        kept, kinds, _ = known_rows(iter(found))
        ways = crossings([TRANSFERS[k] for k in kinds], found[0]["before"], found[0]["after"])
        audit, lines = repaired(kept, kinds, ways)
        yield {"conv_id": found[0]["conv_id"], "part": part, "block": block, "audit": audit, "lines": "\n".join(lines), "n_lines": len(lines)}


def put_together(pieces: Iterator[dict]) -> Iterator[dict]:
    """Totals come first, then the blocks of a conversation in order; the digest is a stream."""
    for conv_id, group in groupby(pieces, key=lambda r: r["conv_id"]):
        total = next(group)
        digest, audit, any_line = hashlib.sha256(), [], False
        for piece in chain(group, [{"audit": total["audit"], "lines": "assistant:", "n_lines": len(total["audit"])}]):
            audit.append(piece["audit"])
            if piece["n_lines"]:
                digest.update((("\n" if any_line else "") + piece["lines"]).encode())
                any_line = True
        yield {"conv_id": conv_id, **{c: total[c] for c in RESULT_NAMES[:6]}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def by_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(shuffle_partitions(df), *keys).sortWithinPartitions(*order)


def repair_open(rows: DataFrame) -> DataFrame:
    """Results of the conversations whose rows lie in several blocks or partitions."""
    place = ["part", "run", "block"]
    # A row is new if no earlier one has its digest; blocks have sent each digest once.
    first = rows.filter("fresh").groupBy("conv_id", "digest").agg(F.min(F.struct(*place, "pos")).alias("at")).select("at.*", F.lit(True).alias("new"))
    known = rows.join(first, [*place, "pos"], "left").withColumn("new", F.coalesce("new", F.lit(False)))
    blocks = in_batches(by_order(known, place, [*place, "pos"]), sum_blocks, f"conv_id long, part int, run int, block int, {TRANSFER}, {TALLY}")
    blocks = written(blocks, "repair-blocks")
    runs = in_batches(by_order(blocks, ["part", "run"], place), sum_runs, f"conv_id long, part int, run int, {TRANSFER}, {TALLY}")
    found = in_batches(by_order(runs, ["conv_id"], ["conv_id", "part"]), settle_conversations, f"conv_id long, part int, run int, block int, before int, after int, {RESULT}")
    found = written(found, "repair-borders")
    borders = found.filter("part >= 0").select("part", "run", "before", "after")
    states = in_batches(by_order(blocks.select(*place, "transfer").join(borders, ["part", "run"]), ["part", "run"], place), settle_runs, "part int, run int, block int, before int, after int")
    pieces = in_batches(by_order(known.join(states, place), place, [*place, "pos"]), settle_blocks, "conv_id long, part int, block int, audit string, lines string, n_lines long", rows=1)
    totals = found.filter("part < 0").select("conv_id", "part", "block", *RESULT_NAMES[:7])
    return in_batches(by_order(totals.unionByName(pieces, allowMissingColumns=True), ["conv_id"], ["conv_id", "part", "block"]), put_together, f"conv_id long, {RESULT}")


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, gone): faults, cheapest edits and the repaired text's digest."""
    inside = partial(repair_inside, block_rows=block_rows, block_bytes=block_bytes)
    looked = written(in_batches(in_order(rows), inside, f"conv_id long, {RESULT}, {OPEN}"), "repair")
    closed = looked.filter("part IS NULL").select("conv_id", *RESULT_NAMES)
    return closed.unionByName(repair_open(looked.filter("part IS NOT NULL").drop(*RESULT_NAMES)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op13_conversation_repair": op13_conversation_repair}


def _sql() -> str:
    """The damage and the rule of faults again; the states run row by row, with the audit and the lines of each."""
    ways = []
    for (initial, gone, truncated), found in TRANSFERS.items():
        for a, b, cost, rank in found:
            edits = EDITS[rank]
            put = NAMES[AFTER_INSERT[a]] if edits[0] == "I" else ""
            ways.append(f"('{initial}', {gone}, {truncated}, {a}, {b}, {cost}, '{edits}', '{put}', '{NAMES[b] if edits[-1] == 'R' else ''}')")
    return rf"""
WITH RECURSIVE ways(initial, gone, truncated, a, b, cost, edits, put, renamed) AS (VALUES {", ".join(ways)}),
bits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INTEGER) & 1))) AS b
  FROM conversations
), faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END, 4294967295::BIGINT), 4294967295) % 20 AS fault
  FROM bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM faults WHERE fault <> 0
), named AS (
  SELECT *, sha256(length(role)::VARCHAR || ':' || role || ':' || text) AS digest FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM named
), seen AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, digest ORDER BY pos) > 1 AS known, left(role, 1) AS first FROM placed
), told AS (
  SELECT *, NOT blank AND known AS duplicate, NOT blank AND NOT known AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS truncated,
    coalesce(lag(first) OVER (PARTITION BY conv_id ORDER BY pos) || first NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM seen
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS way FROM conversations
  UNION ALL
  SELECT t.conv_id, t.pos, w.b, min({{'cost': best.way.cost + w.cost, 'audit': best.way.audit || w.edits, 'lines': best.way.lines
    || CASE WHEN put <> '' THEN chr(10) || put || ':' ELSE '' END
    || CASE WHEN renamed <> '' THEN chr(10) || renamed || ':' || t.text WHEN w.edits[-1] = 'K' THEN chr(10) || t.role || ':' || t.text ELSE '' END}})
  FROM best
  JOIN told t ON t.conv_id IS NOT DISTINCT FROM best.conv_id AND t.pos = best.pos + 1
  JOIN ways w ON w.initial = CASE WHEN t.first IN ('s', 'u', 'a') THEN t.first ELSE '' END AND w.gone = (t.blank OR t.duplicate) AND w.truncated = t.truncated AND w.a = best.state
  GROUP BY t.conv_id, t.pos, w.b
), n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum(illegal::INT) AS illegal
  FROM told GROUP BY conv_id
), ended AS (
  SELECT best.conv_id, min({{'cost': way.cost + CASE WHEN state = 2 THEN 5 ELSE 0 END, 'audit': way.audit || CASE WHEN state = 2 THEN 'I' ELSE '' END,
    'lines': way.lines || CASE WHEN state = 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS way
  FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id WHERE best.pos = coalesce(n.n, 0) AND state <> 1 GROUP BY best.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, way.cost AS cost, way.audit AS audit, sha256(substr(way.lines, 2)) AS repaired_sha256
FROM ended e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_conversation_repair": _sql()}
