"""Joins, ranks and running values that hold when one key owns much of the data.

A window over a whole group puts the group into one task. The helpers here get
the same results from partial aggregates, small per-key tables and bounded
blocks, so that the largest unit of work does not grow with the largest key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.session import written

# Rows of one key a single task takes before the key is spread over more tasks. It places rows
# and changes no result; every caller can pass another value.
ROWS_PER_SALT = 2_000_000
# Hex digits of the hash prefix that cuts a global order into blocks (16 ** 4 blocks). A block
# holds n / 16 ** digits rows, and there are as many offsets as blocks: choose it by n.
RANK_DIGITS = 4


# A table of more rows than this is joined like any other.
BROADCAST_ROWS = 10_000


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`small` marked for broadcast if a count shows that it has at most `most` rows, else as it is."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key in `_n`, combined map-side."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_safe: bool = True) -> DataFrame:
    """Equi join with one copy of the keys; with `null_safe` a null key equals a null key."""
    keys = list(keys)
    if not null_safe:
        return left.join(right, keys, how)
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    null_safe: bool = False,
) -> DataFrame:
    """Equi join (inner or left) whose hot keys are spread over several tasks.

    Keys with more than `rows_per_salt` rows get more than one salt, and their rows of
    `small` are repeated once per salt. Of n rows at most n / rows_per_salt keys can be so
    large, which bounds the broadcast list. `spread_by` are columns of `big` that differ
    within a key; the salt depends on nothing else, so a recomputed task agrees with the
    lost one. As in any join a null key matches nothing, unless `null_safe` is set.

    `counts` are the `key_counts` to find the hot keys with, by default those of `big`.
    Salts change where rows go and never the result, so the counts of an earlier
    stage of `big`, such as a plain scan, do as well and spare its evaluation.
    """
    keys = list(keys)
    counts = key_counts(big, keys) if counts is None else counts
    hot = counts.filter(F.col("_n") > rows_per_salt).select(
        *keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")
    )
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    left = matched(big, F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    right = (
        matched(small, F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_salts")
    )
    return matched(left, right, keys + ["_salt"], how, null_safe).drop("_salt")


def with_group_stats(
    rows: DataFrame,
    keys: Sequence[str],
    stats: Sequence[Column],
    spread_by: Sequence[str],
    counts: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Every row with aggregates of its group: an unordered window without its group buffer.

    The aggregates are combined map-side to one row per key and joined back. Rows with a
    null key are a group, as in a window.
    """
    per_key = rows.groupBy(*keys).agg(*stats)
    return salted_join(rows, per_key, keys, spread_by, "inner", counts, rows_per_salt, null_safe=True)


def running_min(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, block_rows: int = 100_000, levels: int = 2
) -> DataFrame:
    """Adds `_before`, the minimum of `value` over the earlier rows of the same key.

    `order` is an integer unique within a key, so a block of `block_rows` consecutive
    orders has a bounded size. Minima run inside blocks; the minima of whole blocks are
    rows of the same kind, one for each block that has any, and run the same way `levels`
    times. A key of `block_rows ** (levels + 1)` orders has bounded windows only.
    """
    keys = list(keys)
    if not levels:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_before", F.min(value).over(before))
    block, least, local = f"_block{levels}", f"_least{levels}", f"_local{levels}"
    blocks = keys + [block]
    blocked = rows.withColumn(block, F.floor(F.col(order) / block_rows))
    inside = Window.partitionBy(*blocks).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    minima = blocked.groupBy(*blocks).agg(F.min(value).alias(least))
    earlier = running_min(minima, keys, block, least, block_rows, levels - 1)
    earlier = earlier.select(*blocks, F.col("_before").alias(f"_earlier{levels}"))
    return (
        matched(blocked.withColumn(local, F.min(value).over(inside)), earlier, blocks, "inner")
        .withColumn("_before", F.least(local, f"_earlier{levels}"))
        .drop(block, local, f"_earlier{levels}")
    )


def hash_order(*columns: Column) -> Column:
    """Engine-neutral pseudo-random order of rows: the md5 text of their key."""
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def hash_rank(rows: DataFrame, key_hash: str, name: str = "_rank", digits: int = RANK_DIGITS) -> DataFrame:
    """Exact 0-based position of each row in the global order of a unique md5 column.

    The first `digits` hex digits cut the order into 16 ** digits even blocks. Ranks are
    local to a block; the offsets come from the block counts, a table of at most that many
    rows, which is what makes the single-partition running sum and the broadcast safe.
    """
    blocked = rows.withColumn("_block", F.substring(key_hash, 1, digits))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("_block").orderBy(key_hash)) - 1
    return (
        blocked.withColumn("_local", local)
        .join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_block", "_local", "_offset")
    )


def range_sorted(rows: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """`rows` as a written table in the global order of `order`, cut into ranges by sampled splitters.

    Adds `_range`, the number of the range, and `_local`, the 0-based place in it. Both are read
    off the sorted partitions, so no window runs, and the written table fixes them for every
    later plan. Rows that are equal in `order` share a range: end it with a key that tells
    the rows of a frequent value apart.
    """
    ranges = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return written(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_local", place), "ranges")


def value_rank(rows: DataFrame, order: Sequence[Column], name: str = "_rank", partitions: int | None = None) -> DataFrame:
    """Exact 0-based position of each row in the order of values, however they are distributed.

    The offset of a range is the number of rows in the ranges before it. There are as many
    offsets as ranges, which bounds the window over them and their broadcast.
    """
    placed = range_sorted(rows, order, partitions)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = key_counts(placed, ["_range"]).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.join(F.broadcast(offsets), "_range")
    return ranked.withColumn(name, F.col("_offset") + F.col("_local")).drop("_range", "_local", "_offset")


def carried_forward(rows: DataFrame, order: Sequence[Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`: the last non-null `value` at or before each row in the order of all rows.

    A window runs inside each range; what comes from earlier ranges is the last value of the
    nearest one that has any, found over one row per range.
    """
    placed = range_sorted(rows, order, partitions)
    inside = Window.partitionBy("_range").orderBy("_local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col(value).isNotNull(), F.col("_local"))
    lasts = placed.groupBy("_range").agg(F.max_by(value, known).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lasts.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    local = placed.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    return local.join(F.broadcast(earlier), "_range").withColumn(name, F.coalesce(name, "_earlier")).drop("_range", "_local", "_earlier")


def band_join(
    points: DataFrame,
    bands: DataFrame,
    point: str,
    lower: str,
    upper: str,
    width: float,
    spread_by: Sequence[str],
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Points with every band that holds them (`lower <= point <= upper`).

    Both sides are cut into cells of `width`; a band enters each cell it touches,
    which turns the range condition into an equi join plus a check.
    """
    cells = F.sequence(F.floor(F.col(lower) / width), F.floor(F.col(upper) / width))
    left = points.withColumn("_cell", F.floor(F.col(point) / width))
    right = bands.withColumn("_cell", F.explode(cells))
    joined = salted_join(left, right, ["_cell"], spread_by, rows_per_salt=rows_per_salt)
    return joined.filter(F.col(point).between(F.col(lower), F.col(upper))).drop("_cell")


def interval_totals(
    points: DataFrame,
    bands: DataFrame,
    point: str,
    lower: str,
    upper: str,
    totals: dict[str, Column],
    keys: Sequence[str] = (),
    lower_open: bool = False,
    upper_closed: str | None = None,
    least: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Per band the totals over the points that it holds (of equal `keys`), without a row for each pair.

    `totals` are counts or sums of exact numbers (long, decimal). Points are added up by value, and
    points and both ends of the bands are sorted once; a band's totals are what has run up to its
    upper end less what had run up to its lower one, so work follows points and bands and not
    the pairs. `lower_open` leaves out points on the lower end; the column `upper_closed` says which
    bands hold points on the upper one (default: all). `least` names a column for the smallest
    point of the band. Equal bands are one row with their totals added up; bands without
    points have totals of 0, and null, not-a-number, reversed and empty ones are left out.
    """
    keys, names = list(keys), [*totals, "_points"]
    value, high = F.col(point).cast("double"), F.col(upper).cast("double")
    about = F.struct(*[F.col(c) for c in bands.columns])
    present = [F.col(k).isNotNull() for k in keys]
    met = points.filter(reduce(Column.__and__, present, value.isNotNull() & ~F.isnan(value)))
    sums = met.groupBy(*keys, value.alias("_value")).agg(*[c.alias(n) for n, c in totals.items()], F.count(F.lit(1)).alias("_points"))
    closed = F.col(upper_closed) if upper_closed else F.lit(True)
    # At one value: lower ends that hold it, points, then ends that come after them.
    ends = F.array(
        F.struct(F.col(lower).cast("double").alias("_value"), F.lit(2 if lower_open else 0).alias("_kind"), F.lit(-1).alias("_sign")),
        F.struct(high.alias("_value"), F.when(closed, 2).otherwise(0).alias("_kind"), F.lit(1).alias("_sign")),
    )
    single = F.lit(False) if lower_open else (F.col(lower) == F.col(upper)) & closed
    known = bands.filter(reduce(Column.__and__, present, ((F.col(lower) < F.col(upper)) | single) & ~F.isnan(high)))
    cut = known.select(*keys, about.alias("_band"), F.explode(ends).alias("_end")).select(*keys, "_band", "_end.*")
    rows = sums.withColumn("_kind", F.lit(1)).unionByName(cut, allowMissingColumns=True)
    order = [*map(F.col, keys), F.col("_value") + 0.0, F.col("_kind"), F.xxhash64("_band"), F.col("_sign")]  # 0.0 for -0.0
    placed = range_sorted(rows, order, partitions)
    so_far = Window.partitionBy("_range").orderBy("_local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names]
    ranges = placed.groupBy("_range").agg(*[F.sum(n).alias(n) for n in names], F.min_by(F.struct(*keys, "_value"), F.when(F.col("_kind") == 1, F.col("_local"))).alias("_first"))
    after = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    borders = ranges.select("_range", *offset, F.last("_first", ignorenulls=True).over(after).alias("_later"))
    run = placed
    if least:
        to_come = Window.partitionBy("_range").orderBy(F.desc("_local")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = run.withColumn("_next", F.last(F.when(F.col("_kind") == 1, F.struct(*keys, "_value")), ignorenulls=True).over(to_come))
    run = run.select(*run.columns, *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(f"_sum_{n}") for n in names])
    marked = run.filter("_band IS NOT NULL").join(F.broadcast(borders), "_range")
    lows = F.when(F.col("_sign") < 0, F.coalesce("_next", "_later")["_value"]) if least else F.lit(None)
    signed = [F.sum(F.col("_sign") * (F.col(f"_sum_{n}") + F.col(f"_off_{n}"))).alias(n) for n in names]
    found = marked.groupBy("_band").agg(*signed, F.min(lows).alias("_least"))
    kinds = sums.schema
    out = found.select("_band.*", *[F.col(n).cast(kinds[n].dataType).alias(n) for n in totals], F.when(F.col("_points") > 0, F.col("_least")).alias(least or "_least"))
    return out if least else out.drop("_least")


# The level of bands without an end, which is one cell.
ENDLESS = 2000


def interval_join(
    points: DataFrame,
    bands: DataFrame,
    point: str,
    lower: str,
    upper: str,
    spread_by: Sequence[str],
    rows_per_salt: int = ROWS_PER_SALT,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Points with every band that holds them (`lower <= point <= upper`), for numeric bands of any widths.

    With `totals` the result is a row per band with aggregates of its points (`interval_totals`); it makes no pairs.

    A band lives on the level of the power of two next above its width, where it touches two
    cells or a third by rounding; so no band makes many rows, however wide, and a cell holds no
    band that is much narrower than it. A point looks into one cell of each level that bands
    are on, of which there are as many as the widths have binary orders, whatever their number.
    Cells come from a function that never falls, so they lose no match to rounding. Hot cells are
    salted like any other key. Bands without a width are on the level of the narrowest of the
    others; null, not-a-number and reversed bands hold nothing.
    """
    if totals:
        return interval_totals(points, bands, point, lower, upper, totals)
    ends = bands.withColumn("_low", F.col(lower).cast("double")).withColumn("_high", F.col(upper).cast("double"))
    known = ends.filter((F.col(lower) <= F.col(upper)) & ~F.isnan("_high"))
    width = F.col("_high") - F.col("_low")
    order = F.when(width == float("inf"), ENDLESS).when(width > 0, F.ceil(F.log2(width)).cast("int"))
    finest = known.agg(F.min(order)).first()[0]
    placed = known.withColumn("_level", F.coalesce(order, F.lit(finest or 0)))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # one for each binary order at most

    def cell(value: Column, level: int | Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), F.lit(level).cast("double")))

    spanned = F.when(F.col("_level") == ENDLESS, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(cell(F.col("_low"), F.col("_level")), cell(F.col("_high"), F.col("_level"))))
    right = placed.withColumn("_cell", F.explode(spanned)).drop("_low", "_high")
    place = F.col(point).cast("double")
    looks = [F.struct(F.lit(i).alias("_level"), (F.lit(0).cast("long") if i == ENDLESS else cell(place, i)).alias("_cell")) for i in levels]
    if not looks:
        return points.join(bands, F.lit(False))
    left = points.filter(F.col(point).isNotNull() & ~F.isnan(place)).withColumn("_at", F.explode(F.array(*looks))).select("*", "_at.*").drop("_at")
    joined = salted_join(left, right, ["_level", "_cell"], spread_by, rows_per_salt=rows_per_salt)
    return joined.filter(F.col(point).between(F.col(lower), F.col(upper))).drop("_level", "_cell")
