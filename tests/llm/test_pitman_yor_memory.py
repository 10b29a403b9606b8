"""Memory of the language model's steps: large batches are taken apart before their rows are copied."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tunelake.llm import pitman_yor_lm as lm


def test_buckets_of_a_large_batch_are_copied_a_few_at_a_time():
    rows, pairs = 48, 1 << 18
    blobs = [(i, np.array([i], "<u8").tobytes(), np.array([pairs], "<u4").tobytes(), bytes(2 * pairs), bytes(4 * pairs)) for i in range(rows)]
    names = ["bucket", "words", "entries", "contexts", "counts"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blobs)], names)
    del blobs
    tracemalloc.start()
    found = 0
    for bucket in lm.buckets_of(batch):
        found += len(bucket.counts)
        del bucket
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == rows * pairs
    assert peak < 40 << 20, peak
