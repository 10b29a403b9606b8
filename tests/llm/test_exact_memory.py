"""What a worker of the exact dedup holds at once: a piece of Spark's batch, not all of it."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T

from tunelake.llm import exact_dedup


class Rows:
    """Stands for a table: gives back the function that would run in the tasks."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def mapInArrow(self, step, schema):
        self.step = step
        return self

    def repartitionByRange(self, *_):
        return self

    sortWithinPartitions = repartitionByRange


def batch():
    texts = [f"{i:05d} " + "Word " * 800 for i in range(2000)]
    return pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def test_keys_come_in_pieces():
    out = list(exact_dedup.with_sort_key(Rows()).step(iter([batch()])))
    assert sum(b.num_rows for b in out) == 2000 and max(b.nbytes for b in out) < 2 * exact_dedup.BATCH_BYTES
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == list(range(2000))


def test_runs_read_pieces(spark, monkeypatch):
    held = []
    plain = exact_dedup.text_bytes

    def seen(some):
        held.append(some.nbytes)
        return plain(some)

    monkeypatch.setattr(exact_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(exact_dedup, "text_bytes", seen)
    monkeypatch.setattr(exact_dedup, "shuffle_partitions", lambda rows: 4)
    keyed = pa.Table.from_batches(exact_dedup.with_sort_key(Rows()).step(iter([batch()]))).combine_chunks().to_batches()
    held.clear()
    out = pa.Table.from_batches(exact_dedup.content_runs(Rows()).step(iter(keyed)))
    assert len(held) > 4 and max(held) < 2 * exact_dedup.BATCH_BYTES
    assert sorted(set(out.column("doc_id").to_pylist())) == list(range(2000)) and len(set(out.column("digest").to_pylist())) == 2000
