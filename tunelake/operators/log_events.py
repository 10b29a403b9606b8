"""Events of run logs: each record once, and the runs that starts and results make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.operators.skew import carried_forward

RECORD = ["path", "time", "file", "line_no", "level", "message"]
# The messages that begin a run and that give its result.
RUN_START = r"^Running BenchBase with benchmark: (.*)$"
RUN_RESULT = r"^BenchBase \S+ throughput: ([-+0-9.eE]+)$"


def distinct_records(records: DataFrame) -> DataFrame:
    """Stacked handlers repeat every record; equal records of a file are one event, at the first offset."""
    return records.groupBy(*RECORD).agg(F.min("offset").alias("offset"))


def first_group(message: Column, pattern: str) -> Column:
    """The pattern's first group, null where the text does not match."""
    return F.when(message.rlike(pattern), F.regexp_extract(message, pattern, 1))


def pair_runs(events: DataFrame) -> DataFrame:
    """One row per run: where and when it started, its benchmark, and the first result before the next start.

    The order is that of files by name and of offsets in a file, so a run may go on in the next
    file of a rotated log. A run without a result has a null throughput; a result without a
    start is no run.
    """
    benchmark = first_group(F.col("message"), RUN_START)
    throughput = first_group(F.col("message"), RUN_RESULT).try_cast("double")
    place = F.struct("path", "offset")
    marked = events.select(place.alias("at"), "time", benchmark.alias("benchmark"), throughput.alias("throughput")).filter("benchmark IS NOT NULL OR throughput IS NOT NULL")
    started = marked.withColumn("own", F.when(F.col("benchmark").isNotNull(), F.struct("at", "time", "benchmark")))
    known = carried_forward(started, [F.col("at.path"), F.col("at.offset")], "own", "start").filter("start IS NOT NULL")
    first = F.min_by(F.struct("throughput", F.col("time").alias("ended")), F.when(F.col("throughput").isNotNull(), F.col("at")))
    return known.groupBy("start").agg(first.alias("result")).select(
        "start.at.path", "start.at.offset", F.col("start.time").alias("started"), "start.benchmark", "result.throughput", "result.ended"
    )
