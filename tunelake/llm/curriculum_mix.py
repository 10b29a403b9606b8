"""Mixing sources to target weights by a curriculum that changes over time.

Targets. Sources in code-point order, null last, share all words by the weights 5, 2, 1, again
and again. No source gives more than EPOCHS times its words; what it cannot give is shared out
by weight until no target is above its bound. The common price of a weight unit is an exact
fraction: each round takes the sources that are at their bound out of it, and rounds end when
no more are.

Positions. A source has a weight schedule over the training time 0 to 1, straight between given
points. Its integral, scaled to the target, is the source's cumulative demand. The words of a
source are laid in a row, its documents in the order of the md5 of their id, all of them again
for each epoch. A document is trained on when the demand reaches the middle of its words, so
its position is the inverse of the integral there; what lies beyond the target is not taken,
and the document at the target is cut. A range sort by position is the training order.

Running sums and ranks come from range-partitioned tables with one offset per range, so no
source, however large, lies in one task. Ids that very many rows share are told apart by size
and a row number.

A null text has no words; a document without words is never taken and has no place. Repeated
rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.llm.common import documents
from tunelake.operators.skew import checked_broadcast, range_sorted, value_rank
from tunelake.session import written

WEIGHTS = (5, 2, 1)
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
# Points (time, weight) of the schedules that sources take in turn: fading, even, growing, the last one from the middle on.
SCHEDULES = (
    ((0.0, 2.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 3.0)),
)
Schedule = Sequence[tuple[float, float]]


def turn_of(place: Column, values: Sequence[Column]) -> Column:
    """The value whose turn it is at a place, when values take turns."""
    return F.get(F.array(*values), (place % len(values)).cast("int"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, `_source` (a sort key, null last), size in words. The only look at the texts; written, with a number per row."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("_source"), words.alias("size"))
    return written(rows, "sizes").withColumn("_uid", F.monotonically_increasing_id())


def whole(value: str) -> str:
    return f"CAST({value} AS DECIMAL(38,0))"


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """_source, place, source_size, target (exact as a double) and quota, its whole words, of each source."""
    per_source = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = value_rank(per_source, [F.col("_source")], "place").withColumn("bound", F.col("source_size") * epochs)
    sources = written(ranked.withColumn("weight", turn_of(F.col("place"), [F.lit(w).cast("long") for w in weights])), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    above, closed = F.lit(False), -1
    while True:
        found = sources.agg(
            F.sum(F.when(above, F.col("bound"))).alias("bound"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.count_if(above).alias("closed"),
        ).first()
        over, under = words - (found["bound"] or 0), found["weight"] or 1
        if found["closed"] == closed:
            break
        closed = found["closed"]
        above = F.expr(f"{whole('bound')} * {under} <= {whole('weight')} * {over}")
    share = F.expr(f"CAST({whole('weight')} * {over} AS DOUBLE) / CAST({under} AS DOUBLE)")
    return sources.select(
        "_source",
        "place",
        "source_size",
        F.when(above, F.col("bound").cast("double")).otherwise(share).alias("target"),
        F.when(above, F.col("bound")).otherwise(F.expr(f"{whole('weight')} * {over} div {under}")).alias("quota"),
    )


def words_before(rows: DataFrame) -> DataFrame:
    """Adds `before`: the words of the source in the documents before this one."""
    order = [F.col("_source"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.col("doc_id"), F.col("size"), F.col("_uid")]
    placed = range_sorted(rows, order)
    sums = placed.groupBy("_range", "_source").agg(F.sum("size").alias("_words"))
    # One row per range and source in it: a source has at most as many as there are ranges.
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", "_source", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range", "_source").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(offsets, ["_range", "_source"]).withColumn("before", F.col("_offset") + F.col("_inside")).drop("_range", "_local", "_offset", "_inside")


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which the integral of a schedule reaches a share of its whole: the inverse of a quadratic in each piece."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) / 2 * (t1 - t0)
    found = None
    for t0, w0, slope, done in reversed(pieces):
        rest = share * total - done
        time = t0 + (rest / w0 if slope == 0 else (F.sqrt(w0 * w0 + 2 * slope * rest) - w0) / slope)
        found = time if found is None else F.when(share * total < after, time).otherwise(found)
        after = done
    return found


def training_copies(rows: DataFrame, targets: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, epochs: int = EPOCHS) -> DataFrame:
    """One row per document and epoch that the mix takes: words taken, position in training time."""
    known = words_before(rows).join(checked_broadcast(targets), "_source")
    copies = known.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    taken = copies.withColumn("start", start).withColumn("words", F.least("size", F.greatest(F.col("quota") - F.col("start"), F.lit(0).cast("long"))))
    share = (F.col("start") + F.col("words") / 2) / F.col("quota")
    return taken.filter("words > 0").withColumn("position", turn_of(F.col("place"), [time_of(share, s) for s in schedules]))


def training_order(copies: DataFrame) -> DataFrame:
    """Adds `step`, the place of each copy in the order of training."""
    return value_rank(copies, [F.col("position"), F.col("_source"), F.col("start")], "step")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """One row per document: size, its source's size and target, words taken, epochs it is in, step and position of its first copy."""
    rows = sized(docs)
    targets = written(source_targets(rows, weights, epochs), "targets")
    ordered = training_order(training_copies(rows, targets, schedules, epochs).select("_uid", "_source", "epoch", "start", "words", "position"))
    # The first epoch comes first in the words of a source and the demand only grows, so its copy is the first one trained on.
    per_row = ordered.groupBy("_uid").agg(
        F.sum("words").alias("taken"), F.count(F.lit(1)).alias("epochs"), F.min("step").alias("first_step"), F.min("position").alias("first_position")
    )
    known = rows.join(per_row, "_uid", "left").join(checked_broadcast(targets), "_source")
    return known.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("epochs", F.lit(0)).alias("epochs"), "first_step", "first_position")


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(documents(spark, sf_dir))


def _sql_time(schedule: Schedule) -> str:
    """The inverse of the integral, piece by piece."""

    def real(x: float) -> str:
        return f"{x!r}::DOUBLE"

    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total, total + (w0 + w1) / 2 * (t1 - t0)))
        total = pieces[-1][-1]
    cases = []
    for t0, w0, slope, done, end in pieces:
        rest = f"(share * {real(total)} - {real(done)})"
        inverse = f"{rest} / {real(w0)}" if slope == 0 else f"(sqrt({real(w0 * w0)} + {real(2 * slope)} * {rest}) - {real(w0)}) / {real(slope)}"
        cases.append(f"WHEN share * {real(total)} < {real(end)} OR {end == total} THEN {real(t0)} + ({inverse})")
    return f"CASE {' '.join(cases)} END"


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce('0' || source, '1') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src
), p AS (
  SELECT *, row_number() OVER (ORDER BY src) - 1 AS place, {EPOCHS} * source_size AS bound FROM s
), w AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, bound * (10 // [5, 2, 1][place % 3 + 1]) AS dear FROM p
), o AS (
  SELECT *, row_number() OVER w AS n, (sum(source_size) OVER () - coalesce(sum(bound) OVER b, 0))::HUGEINT AS over, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::HUGEINT AS under
  FROM w WINDOW w AS (ORDER BY dear, src), b AS (ORDER BY dear, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), price AS (
  SELECT arg_min(over, n) AS over, arg_min(under, n) AS under FROM o WHERE bound * under > weight * over
), t AS (
  SELECT src, place, source_size, CASE WHEN bound * price.under > weight * price.over THEN (weight * price.over)::DOUBLE / price.under::DOUBLE ELSE bound::DOUBLE END AS target,
    CASE WHEN bound * price.under > weight * price.over THEN (weight * price.over // price.under)::BIGINT ELSE bound END AS quota
  FROM w CROSS JOIN price
), b AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY src ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d
), c AS (
  SELECT b.*, t.place, t.quota, epoch * t.source_size + before AS start FROM b JOIN t USING (src) CROSS JOIN (SELECT unnest(range({EPOCHS})) AS epoch)
), k AS (
  SELECT *, least(size, quota - start) AS words, (start + least(size, quota - start) / 2) / quota AS share FROM c WHERE least(size, quota - start) > 0
), m AS (
  SELECT *, CASE place % 3 {" ".join(f"WHEN {i} THEN {_sql_time(schedule)}" for i, schedule in enumerate(SCHEDULES))} END AS position FROM k
), r AS (
  SELECT *, row_number() OVER (ORDER BY position, src, start) - 1 AS step FROM m
), g AS (
  SELECT uid, sum(words)::BIGINT AS taken, count(*) AS epochs, min(step) AS first_step, min(position) AS first_position FROM r GROUP BY uid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(epochs, 0) AS epochs, first_step, first_position FROM d JOIN t USING (src) LEFT JOIN g USING (uid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op12_curriculum_mix": op12_curriculum_mix}


def oracle_sql() -> dict[str, str]:
    return {"op12_curriculum_mix": SQL}
