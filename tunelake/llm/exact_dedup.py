"""Exact duplicates by a content sort.

Sampled splitters range-partition the normalised bytes (their first bytes, a hash of all of
them, then the id, so that a splitter has a bounded size and a group of copies may span
partitions). The sort of each partition, which spills to disk, places equal texts side by
side, and every row is compared in full with its neighbour. Equal neighbours are a run; a run
inside its partition is a group, its first row, the one with the largest id, stays, and its
length is the group's size. Only the first and the last run of a partition may go on behind a
splitter; those, at most two for each partition, are put together by digest.

Null and empty texts are equal; a null id is smaller than any other; of repeated rows with
the same id and text one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.llm.common import documents, id_and_text, shuffle_partitions, slices_by_bytes, text_bytes, trimmed
from tunelake.operators.skew import salted_join
from tunelake.session import written

HEAD_BYTES = 64
# Bytes of a batch whose texts are copied at once; a batch of Spark's may be a whole partition.
BATCH_BYTES = 1 << 20


def with_sort_key(rows: DataFrame) -> DataFrame:
    """Adds `_head`, the first normalised bytes, and `_name`, a hash of all of them."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_head", T.BinaryType()), T.StructField("_name", T.LongType())])

    def keys(batches):
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            norm = [t.lower() for t in text_bytes(batch)]
            heads = pa.array([t[:HEAD_BYTES] for t in norm], pa.binary())
            names = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in norm], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, heads, names], [*batch.schema.names, "_head", "_name"])

    return rows.mapInArrow(trimmed(keys), schema)


def sorted_copies(rows: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Rows (`doc_id`, `text` and any payload) in content order.

    Adds `_pos`, unique and growing along the order, `_digest` of the normalised text and
    `_repeat`, whether the row before it in its partition has the same text. With
    `keep_rows` the repeats are left out and the payload stays; else only the ids stay.
    """
    order = [F.col("_head"), F.col("_name"), F.col("doc_id").desc()]
    sorted_rows = with_sort_key(rows).repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    fields = rows.schema.fields if keep_rows else [rows.schema["doc_id"]]
    schema = T.StructType([
        *fields,
        T.StructField("_pos", T.LongType()),
        T.StructField("_digest", T.StringType()),
        T.StructField("_repeat", T.BooleanType()),
    ])
    names = [f.name for f in fields]

    def compare(batches):
        pos = TaskContext.get().partitionId() << 40
        key, seen = None, {}
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            digests, repeats = [], []
            for name, text in zip(batch.column("_name").to_pylist(), text_bytes(batch), strict=True):
                norm = text.lower()
                if name != key:  # texts that differ under one hash are told apart by the comparison
                    key, seen = name, {}
                repeats.append(norm in seen)
                if norm not in seen:
                    seen[norm] = hashlib.sha256(norm).hexdigest()
                digests.append(seen[norm])
            n = batch.num_rows
            out = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(range(pos, pos + n), pa.int64()), pa.array(digests, pa.string()), pa.array(repeats, pa.bool_())],
                [*names, "_pos", "_digest", "_repeat"],
            )
            pos += n
            yield out.filter(pc.invert(out.column("_repeat"))) if keep_rows else out

    return sorted_rows.mapInArrow(trimmed(compare), schema)


RUN = "doc_id long, digest string, run long, first boolean, single boolean, n long, border boolean"


def content_runs(rows: DataFrame) -> DataFrame:
    """Rows of (`doc_id`, `text`) in content order with the number of their run, and one row (`n` set) at the end of each run.

    A run of one row that no border touches is told at once (`single`) and has no other row. A
    run holds one row in memory, however long it is; texts that differ under one hash alternate
    in it and are told apart by the comparison, so runs of a hash end together.
    """
    order = [F.col("_head"), F.col("_name"), F.col("doc_id").desc()]
    dealt = with_sort_key(rows).repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    arrow = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("run", pa.int64()), ("first", pa.bool_()), ("single", pa.bool_()), ("n", pa.int64()), ("border", pa.bool_())])

    def runs(batches):
        number, key, out = TaskContext.get().partitionId() << 40, None, []
        # Text -> [run, digest, rows so far, its first id, the first row if it is not given out yet], of one hash.
        seen: dict[bytes, list] = {}
        begun = False

        def ended(border: bool):
            for run, digest, n, first, waiting in seen.values():
                if waiting and not border:
                    yield (first, digest, run, True, True, None, None)
                else:
                    if waiting:
                        yield (first, digest, run, True, False, None, None)
                    yield (first, digest, run, None, None, n, border)

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
            out.clear()
            return batch

        for batch in slices_by_bytes(batches, BATCH_BYTES):
            for doc_id, name, text in zip(batch.column("doc_id").to_pylist(), batch.column("_name").to_pylist(), text_bytes(batch), strict=True):
                norm = text.lower()
                if name != key:
                    out.extend(ended(border=not begun))
                    begun = begun or key is not None
                    key, seen = name, {}
                if norm in seen:
                    run = seen[norm]
                    if run[4]:
                        out.append((run[3], run[1], run[0], True, False, None, None))
                        run[4] = False
                    run[2] += 1
                    out.append((doc_id, run[1], run[0], False, False, None, None))
                else:
                    seen[norm] = [number, hashlib.sha256(norm).hexdigest(), 1, doc_id, True]
                    number += 1
            if out:
                yield flushed()
        out.extend(ended(border=True))
        if out:
            yield flushed()

    return dealt.mapInArrow(trimmed(runs), RUN)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = written(content_runs(id_and_text(docs, id_col, text_col)), "content-runs")
    alone = found.filter("single").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    ends = found.filter("n IS NOT NULL").select("run", "digest", "n", F.col("doc_id").alias("head"), "border")
    inside = ends.filter("NOT border").select("run", F.col("head").alias("keep_id"), F.col("n").alias("group_size"))
    # At most a few rows for each partition; of equal texts in different partitions the largest id stays.
    cut = ends.filter("border")
    joined = cut.groupBy("digest").agg(F.max("head").alias("keep_id"), F.sum("n").alias("group_size"))
    whole = inside.unionByName(cut.join(F.broadcast(joined), "digest").select("run", "keep_id", "group_size"))
    members = found.filter("n IS NULL AND NOT single").select("doc_id", "digest", "run", "first")
    sized = salted_join(members, whole, ["run"], ["doc_id"])
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return alone.unionByName(sized.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    The second look at groups that a splitter cut reads the same sorted partitions. Rows with
    equal text and id are never cut apart, as the id is part of the order.
    """
    plain = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    local = sorted_copies(docs.toDF(*plain), keep_rows=True)
    # More than one row of a text is left only where a splitter cut its group: at most one group for each splitter.
    groups = local.groupBy(F.col("_digest").alias("_cut")).agg(F.count(F.lit(1)).alias("_n"), F.max("doc_id").alias("_keep"))
    cut = groups.filter("_n > 1").drop("_n")
    stays = F.col("_cut").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))
    return local.join(F.broadcast(cut), F.col("_digest") == F.col("_cut"), "left").filter(stays).select(*plain).toDF(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op5_exact_dedup": op5_exact_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": SQL}
