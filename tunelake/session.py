"""Session defaults, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "tunelake", master: str | None = None, **conf: str) -> SparkSession:
    """Session for jobs of this package; the cluster's own settings win over ours."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's `spark.checkpoint.dir`.

    Only a local session without that setting falls back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), "tunelake-shared")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tunelake/{name}-{uuid.uuid4().hex}"


_tracked: list[list[tuple[str, StructType]]] = []


@contextmanager
def tracked() -> Iterator[list[tuple[str, StructType]]]:
    """Collects the tables that `written` makes inside the block, for `emptied`."""
    tables: list[tuple[str, StructType]] = []
    _tracked.append(tables)
    try:
        yield tables
    finally:
        _tracked.remove(tables)


def emptied(spark: SparkSession, tables: list[tuple[str, StructType]]) -> None:
    """Frees the space of written tables that nothing reads any more: empty ones take their place."""
    for path, schema in tables:
        spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back.

    Cuts the lineage for plans that are used several times; the files survive
    the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for tables in _tracked:
        tables.append((path, df.schema))
    return spark.read.schema(df.schema).parquet(path)
