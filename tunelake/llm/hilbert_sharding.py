"""Shards along a Hilbert curve, for files that several metadata columns can prune.

Each dimension is quantised by splitters (taken from a bounded sample of its values), the
cells give a position on the curve, and the order by position is cut into runs of equal row
counts: shards differ by one row at most. Equal texts are one group that takes the smallest
cells among its rows, so its rows lie side by side; a cut may still go through a group,
because counts come first.

Ranks come from a range-partitioned sort: places inside partitions, shifted by the counts of
the partitions before. Null texts count as empty but have their own size rule (none), null
metadata sorts first, repeated rows are placed each, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.llm.common import documents, shuffle_partitions
from tunelake.session import written

SHARDS = 40
CELL_BITS = 6
SAMPLED_VALUES = 4096  # distinct values from which the splitters of a dimension are taken
ROW_BYTES = 16


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points (dimensions x points, `bits` bits a coordinate).

    Skilling's transform (AIP Conference Proceedings 707, 2004), over all points at once.
    """
    x = coords.astype(np.int64, copy=True)
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            flip = (x[i] >> level) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> bit) & 1
    return index


def splitters(docs: DataFrame, value: Column, cells: int) -> list:
    """At most `cells - 1` values that cut the distinct values of a column into even cells."""
    values = docs.select(value.alias("v")).filter("v IS NOT NULL").distinct()
    sample = sorted(r["v"] for r in values.orderBy(F.xxhash64("v"), "v").limit(SAMPLED_VALUES).collect())
    if len(sample) <= cells:
        return sample[1:]
    return [sample[i * len(sample) // cells] for i in range(1, cells)]


def cell(value: Column, cuts: list) -> Column:
    """Number of splitters that are not above the value; null is in the first cell."""
    reached = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value) if cuts else F.array()
    return F.coalesce(F.size(reached), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = ("lang", "source", "_size"), bits: int = CELL_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    `dimensions` are columns of `docs`, or `_size` for the logarithm of the text's size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    columns = {d: F.floor(F.log2(size + 1) * 4).cast("int") if d == "_size" else F.col(d) for d in dimensions}
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (size + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
            *[c.alias(f"_d{i}") for i, c in enumerate(columns.values())],
        ),
        "shard-rows",
    )
    dims = [f"_d{i}" for i in range(len(columns))]
    group = ["_text", "size", "text_crc32"]
    cut = {d: splitters(rows, F.col(d), 1 << bits) for d in dims}
    celled = rows.select("doc_id", *group, *[cell(F.col(d), cut[d]).alias(d) for d in dims])

    @F.pandas_udf("long")
    def position(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells]), bits))

    groups = celled.groupBy(*group).agg(*[F.min(d).alias(d) for d in dims]).select(*group, position(*dims).alias("curve"))
    order = ["curve", "_text", "text_crc32", "size", "doc_id"]
    placed = celled.select("doc_id", *group).join(groups, group).repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    inside = (1 << 33) - 1
    ranked = written(
        placed.withColumn("_part", F.spark_partition_id()).withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(inside)), "shard-order"
    )
    # One row per partition of the sort, whatever the number of documents.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    total = ranked.count()
    each, more = divmod(total, shards)
    rank = F.col("_start") + F.col("_idx")
    edge = more * (each + 1)  # the first `more` shards have one row more
    shard = F.when(rank < edge, F.floor(rank / (each + 1))).otherwise(more + F.floor((rank - edge) / max(each, 1))).cast("int")
    begin = F.when(F.col("shard") < more, F.col("shard") * (each + 1)).otherwise(edge + (F.col("shard") - more) * each)
    return (
        ranked.join(F.broadcast(starts.drop("_n")), "_part")
        .withColumn("shard", shard)
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (rank - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
        )
    )


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op10_hilbert_sharding": op10_hilbert_sharding}


def oracle_sql() -> dict[str, str]:
    return {}
