"""Workload features, statement streams, counter roll-ups and mix features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.constants import BLOCK_BYTES, REPLAY_LIMIT
from tunelake.functions.scaling import ratio
from tunelake.functions.text import (
    has_aggregate,
    line_statements,
    predicate_count,
    replay_statements,
    semicolon_statements,
)
from tunelake.operators.skew import checked_broadcast

SPLITTERS = {
    "replay": replay_statements,
    "semicolon": semicolon_statements,
    "line": line_statements,
}


def statements(files: DataFrame, rule: str = "replay") -> DataFrame:
    """(workload, stmt_pos, sql_text) from whole workload files (workload, text).

    The outer generator splits every text once; an inner one would infer a filter on the
    split array and split twice.
    """
    pieces = SPLITTERS[rule](F.col("text"))
    out = files.select("workload", F.posexplode_outer(pieces).alias("stmt_pos", "sql_text"))
    return out.filter(F.col("stmt_pos").isNotNull())


def first_statements(stmts: DataFrame, limit: int = REPLAY_LIMIT) -> DataFrame:
    """The first statements of every workload; positions count from 0 within a file."""
    return stmts.filter(F.col("stmt_pos") < limit)


def assign_streams(stmts: DataFrame, n_streams: int) -> DataFrame:
    """Round-robin stream of each statement by its position in the file."""
    return stmts.withColumn("stream", F.col("stmt_pos") % n_streams)


def workload_features(files: DataFrame) -> DataFrame:
    """Six features of each workload file, computed within its row.

    Matching is by substring on the upper-cased text. A file without statements
    has null ratios.
    """
    text = F.upper("text")
    stmts = semicolon_statements(text)
    with_parts = files.withColumn("_upper", text).withColumn("_stmts", stmts)
    size = F.size("_stmts")

    def share(count):
        return ratio(count.cast("double"), size)

    reads = F.size(F.filter("_stmts", lambda s: F.startswith(s, F.lit("SELECT"))))
    aggregates = F.size(F.filter("_stmts", has_aggregate))
    predicates = F.aggregate("_stmts", F.lit(0), lambda n, s: n + predicate_count(s))
    return with_parts.select(
        "workload",
        size.alias("n_statements"),
        share(reads).alias("read_ratio"),
        share(F.regexp_count("_upper", F.lit("GROUP BY"))).alias("group_by_ratio"),
        share(F.regexp_count("_upper", F.lit("ORDER BY"))).alias("order_by_ratio"),
        share(aggregates).alias("aggregation_ratio"),
        share(predicates).alias("avg_predicates"),
    )


FEATURE_COLUMNS = [
    "read_ratio", "group_by_ratio", "order_by_ratio", "aggregation_ratio", "avg_predicates",
]


def counter_rollup(rows: DataFrame, key: str, counters: list[str], reads: list[str], writes: list[str]) -> DataFrame:
    """Counter sums per key with empty sums as 0; block counters add up to disk counts and bytes."""

    def row_sum(columns):
        total = F.lit(0.0)
        for c in columns:
            total = total + F.coalesce(F.col(c), F.lit(0)).cast("double")
        return total

    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in counters]
    out = rows.groupBy(key).agg(
        *sums,
        F.coalesce(F.sum(row_sum(reads)), F.lit(0.0)).alias("disk_read_count"),
        F.coalesce(F.sum(row_sum(writes)), F.lit(0.0)).alias("disk_write_count"),
    )
    return out.withColumn("disk_read_bytes", F.col("disk_read_count") * BLOCK_BYTES).withColumn(
        "disk_write_bytes", F.col("disk_write_count") * BLOCK_BYTES
    )


def mix_features(mixes: DataFrame, transactions: DataFrame) -> DataFrame:
    """Weighted transaction features per workload, followed by the weights, first value dropped.

    `mixes` holds (workload, weights array); `transactions` holds (pos, features
    array), pos counting from 0. Positions are few and all workloads share them, so a
    shuffle by position would meet in a few tasks: the vectors are broadcast if their number
    was checked. What is collected per workload is bounded by the length of one weight list.
    """
    weighted = mixes.select("workload", F.posexplode("weights").alias("pos", "weight")).join(
        checked_broadcast(transactions), "pos"
    )
    values = weighted.select(
        "workload",
        "pos",
        "weight",
        F.posexplode("features").alias("dim", "feature"),
    )
    sums = values.groupBy("workload", "dim").agg(
        F.sum(F.col("feature") * F.col("weight") / 100).alias("value")
    )
    ordered = F.sort_array(F.collect_list(F.struct("dim", "value")))
    vectors = sums.groupBy("workload").agg(F.transform(ordered, lambda x: x["value"]).alias("mixed"))
    tail = F.transform("weights", lambda w: w.cast("double"))
    full = F.concat(F.col("mixed"), tail)
    return mixes.join(vectors, "workload").select(
        "workload", F.slice(full, 2, F.size(full)).alias("features")
    )


def replay_throughput(done: DataFrame, n_streams: int) -> DataFrame:
    """Queries per second per workload from finished statements (workload, started, ended).

    `qps` uses the true number of statements; `qps_len0` multiplies the share of the
    first stream by the number of streams, which overstates uneven workloads.
    """
    n, seconds = F.col("n_statements"), F.col("elapsed")
    len0 = F.ceil(n / n_streams) * n_streams
    return (
        done.groupBy("workload")
        .agg(
            F.count(F.lit(1)).alias("n_statements"),
            (F.max("ended") - F.min("started")).alias("elapsed"),
        )
        .select(
            "workload",
            "n_statements",
            "elapsed",
            ratio(n, seconds).alias("qps"),
            ratio(len0, seconds).alias("qps_len0"),
            ratio(-seconds, len0).alias("neg_avg_time"),
        )
    )
