"""Running best of each workload over an append-only folder of sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunelake.operators.history import best_runs

RUN_SCHEMA = "workload string, run_ord long, config_id string, cost double"
BEST_SCHEMA = "workload string, config_id string, cost double, run_ord long, batch long"


def run_stream(spark: SparkSession, path: str, schema: str = RUN_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """Run records from a growing folder of JSON lines."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def keep_best(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the best run of every workload below `target`, merged batch by batch.

    Two folders take turns: a batch reads what the batch before left and overwrites the other
    one, so nothing piles up, and a batch that is repeated after a restart finds its input as
    it was. A minimum does not change when a record comes twice or late, so neither a
    deduplication state nor a watermark is needed.
    """

    def merge_batch(runs: DataFrame, batch_id: int) -> None:
        best = best_runs(runs)
        if batch_id:
            before = runs.sparkSession.read.schema(BEST_SCHEMA).parquet(f"{target}/slot={(batch_id - 1) % 2}")
            best = best_runs(best.unionByName(before.drop("batch")))
        single = best.dropDuplicates(["workload"]).withColumn("batch", F.lit(batch_id).cast("long"))
        single.write.mode("overwrite").parquet(f"{target}/slot={batch_id % 2}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_best(spark: SparkSession, target: str) -> DataFrame:
    """Current best per workload: what the newest batch left."""
    history = spark.read.schema(BEST_SCHEMA).parquet(f"{target}/slot=*")
    newest = history.agg(F.max("batch")).scalar()
    return history.filter(F.col("batch") == newest).drop("batch")
