"""Exact distinct counts that merge: dictionary codes in bitmaps.

The values of a column get dense codes. A group's values are then the set bits of bitmaps,
one for each 32,768 codes, and the count is the number of bits. Bitmaps of finer groups, of
other days or of other files merge by OR into those of coarser groups, exactly, without a look
at the rows; a dictionary can be extended by the values of an increment and keeps its codes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.operators.skew import BROADCAST_ROWS, matched, salted_join, value_rank

# Bits and bytes of one bitmap of the built-in functions.
BITS, BYTES = 32_768, 4_096
# About what a row of (group, value) costs in a shuffle.
PAIR_BYTES = 32


def value_dictionary(rows: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(value, code): codes from 0 on without gaps, in the order of the values; nulls have none.

    With the dictionary `known` of earlier rows, its codes stay and new values follow.
    """
    values = rows.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    if known is None:
        return value_rank(values, [F.col("value")], "code").select("value", "code")
    size = known.agg(F.count(F.lit(1))).scalar()
    added = value_rank(values.join(known, "value", "left_anti"), [F.col("value")], "code")
    return known.unionByName(added.select("value", (F.col("code") + size).alias("code")))


def coded(rows: DataFrame, column: str, dictionary: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Rows that have a value, with its `code`. A short dictionary is broadcast, a frequent value of a long one salted."""
    named = dictionary.withColumnRenamed("value", column)
    if dictionary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named), column)
    return salted_join(rows, named, [column], spread_by)


def distinct_bitmaps(rows: DataFrame, keys: Sequence[str], column: str, dictionary: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """(keys, bucket, bitmap): the codes of each group's values. Bits are set map-side, at most one bitmap per group and bucket moves."""
    code = F.col("code") + 1
    with_code = coded(rows, column, dictionary, spread_by).withColumn("bucket", F.bitmap_bucket_number(code))
    return with_code.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups, or of the groups of several increments with one dictionary."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_counts(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct values per group of merged bitmaps."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))


def pair_counts(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values per group from the different pairs, each of which moves once per task."""
    pairs = rows.filter(F.col(column).isNotNull()).select(*keys, column).distinct()
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(rows: DataFrame, keys: Sequence[str], counts: Mapping[str, str], others: Sequence[Column] = ()) -> DataFrame:
    """One row per group with the number of distinct values of several columns, {name: column}, next to other aggregates.

    A plan with several distinct counts would send every row once per column. Here columns of
    few values are coded and counted together in one aggregate of bitmaps. A column of many
    values, or groups so small that a bitmap is larger than their pairs, is counted by its
    pairs; both ways give the same numbers. Which one is cheaper is told by one scan.
    """
    keys = list(keys)
    sizes = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.approx_count_distinct(F.struct(*keys)).alias("_groups"),
        *[F.approx_count_distinct(c).alias(n) for n, c in counts.items()],
    ).first()
    bitmaps_pay = sizes["_groups"] * BYTES <= sizes["_rows"] * PAIR_BYTES
    coded_rows, small = rows, []
    for name, column in counts.items():
        if bitmaps_pay and sizes[name] <= BITS // 2:
            values = rows.select(F.col(column).alias(f"_value_{name}")).distinct().filter(f"_value_{name} IS NOT NULL")
            found = values.limit(BITS + 1).collect()  # never more than one bitmap's values
            if len(found) <= BITS:
                code = rows.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(found)], T.StructType([*values.schema.fields, T.StructField(f"_code_{name}", T.LongType())]))
                coded_rows = coded_rows.join(F.broadcast(code), F.col(column) == F.col(f"_value_{name}"), "left")
                small.append(name)
    bits = [F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(f"_code_{n}") + 1))).alias(n) for n in small]
    base = coded_rows.groupBy(*keys).agg(*[*others, *bits] or [F.count(F.lit(1)).alias("_n")])
    large = [pair_counts(rows, keys, c, n) for n, c in counts.items() if n not in small]
    joined = reduce(lambda left, right: matched(left, right, keys, "left"), large, base)
    kept = [c for c in base.columns if c not in (*keys, *counts, "_n")]
    return joined.select(*keys, *kept, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in counts])
