"""Writers: samples, training records with their manifest, result lines."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.constants import RECORD_COLUMNS
from tunelake.functions.text import float_text


def write_samples(samples: DataFrame, path: str, append: bool = False) -> None:
    """Samples as compressed JSON lines, one file per task; the names of the knobs are in every line."""
    samples.write.mode("append" if append else "overwrite").json(path, compression="gzip")


def committed(spark: SparkSession, path: str) -> list[str]:
    """Ids of the commits of a folder, in name order: those whose record was written to its end."""
    try:
        records = spark.read.schema("id string").json(f"{path}/commits", recursiveFileLookup=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r.id for r in records.distinct().collect())


def checked_id(commit_id: str) -> str:
    if not re.fullmatch(r"[\w.-]+", commit_id):
        raise ValueError(f"not a commit id: {commit_id!r}")
    return commit_id


def commit(spark: SparkSession, path: str, commit_id: str) -> None:
    """Writes the record that makes an id count, one row in one file, which appears as a whole."""
    record = json.dumps({"id": checked_id(commit_id)})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/commits/{commit_id}")


def append_samples_once(samples: DataFrame, path: str, commit_id: str) -> bool:
    """Appends samples under an id of the caller (letters, digits, `-`, `_`, `.`); says whether they were new.

    The rows go into a folder of their own, then one small record makes them count. Whatever
    breaks off before that is overwritten by the next attempt; an id that counts is not
    written again.
    """
    spark = samples.sparkSession
    checked_id(commit_id)
    if commit_id in committed(spark, path):
        return False
    samples.write.mode("overwrite").json(f"{path}/data/{commit_id}")
    commit(spark, path, commit_id)
    return True


def committed_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The samples of all commits of a folder; rows of unfinished appends are not among them."""
    ids = committed(spark, path)
    if not ids:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/data/{i}" for i in ids])


def write_training_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines in one folder per split, with a manifest of their columns.

    The split is a per-row hash, so both folders fill evenly and nothing is shuffled.
    """
    records.write.mode("overwrite").partitionBy("split").json(f"{path}/records")
    manifest = {
        f"db_tuning_{split}": {"file_name": f"records/split={split}", "columns": RECORD_COLUMNS}
        for split in ("train", "test")
    }
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(
        f"{path}/manifest"
    )


def write_result_lines(results: DataFrame, path: str) -> None:
    """`name: qps` lines in name order; the sort is a range partition, so files follow it too."""
    line = F.concat(F.col("name"), F.lit(": "), float_text(F.col("qps")))
    results.orderBy("name").select(line.alias("value")).write.mode("overwrite").text(path)
