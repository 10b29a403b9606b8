"""Train/test splits, folds and hold-outs, stable under any repartitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelake.constants import HOLDOUT_WORKLOADS, N_FOLDS, SEED, TRAIN_SHARE
from tunelake.operators.skew import RANK_DIGITS, ROWS_PER_SALT, hash_order, hash_rank, salted_join


def hash_split(rows: DataFrame, keys: list[str], seed: int = SEED, percent: int = 90) -> DataFrame:
    """Adds `split` by a threshold on the hash of the row key: near 90/10, no shuffle."""
    hashed = hash_order(*[F.col(k) for k in keys], F.lit(seed))
    draw = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % 100
    return rows.withColumn("split", F.when(draw < percent, "train").otherwise("test"))


def exact_split(
    rows: DataFrame, keys: list[str], seed: int = SEED, share: float = TRAIN_SHARE, digits: int = RANK_DIGITS
) -> DataFrame:
    """Adds `split` with exactly int(share * n) training rows in hash order of a unique key.

    `digits` sets the number of blocks that are ranked on their own (see `hash_rank`).
    """
    hashed = rows.withColumn("_hash", hash_order(*[F.col(k) for k in keys], F.lit(seed)))
    total = rows.agg(F.count(F.lit(1))).scalar()
    first_test = F.floor(total * share)
    ranked = hash_rank(hashed, "_hash", digits=digits)
    return ranked.withColumn(
        "split", F.when(F.col("_rank") < first_test, "train").otherwise("test")
    ).drop("_hash", "_rank")


def workload_folds(rows: DataFrame, n_folds: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """(workload, fold): whole workloads in hash order cut into folds that differ by one at most.

    The first `n % n_folds` folds take the extra workloads.
    """
    workloads = rows.select("workload").distinct()
    hashed = workloads.withColumn("_hash", hash_order(F.col("workload"), F.lit(seed)))
    total = workloads.agg(F.count(F.lit(1))).scalar()
    small = F.floor(total / n_folds)
    longer = total % n_folds
    rank = F.col("_rank")
    in_longer = rank < longer * (small + 1)
    fold = F.when(in_longer, F.floor(rank / (small + 1))).otherwise(
        longer + F.floor((rank - longer * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return hash_rank(hashed, "_hash").select("workload", fold.cast("int").alias("fold"))


def with_folds(
    rows: DataFrame, folds: DataFrame, spread_by: list[str], rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    return salted_join(rows, folds, ["workload"], spread_by, rows_per_salt=rows_per_salt, null_safe=True)


def holdout_workloads(
    rows: DataFrame, repeat: int, n_workloads: int = HOLDOUT_WORKLOADS, seed: int = SEED
) -> DataFrame:
    """The workloads held out in one repeat: the first few in a seeded hash order (a top-k)."""
    return (
        rows.select("workload")
        .distinct()
        .withColumn("_hash", hash_order(F.col("workload"), F.lit(seed), F.lit(repeat)))
        .orderBy("_hash")
        .limit(n_workloads)
        .select("workload", F.lit(repeat).alias("repeat"))
    )


def workload_slice(names: DataFrame, first: int, last: int) -> DataFrame:
    """Workloads at positions first..last-1 of the name order.

    Only the first `last` names are ranked, so the single-partition window is bounded.
    """
    head = names.select("workload").distinct().orderBy("workload").limit(last)
    position = F.row_number().over(Window.orderBy("workload")) - 1
    return head.withColumn("position", position).filter(F.col("position") >= first)
