"""What the operators of this subpackage share: reading, batches of bytes, word names."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries a worker keeps in a word cache before it starts anew; bounds its memory, never a result.
CACHE_WORDS = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; all others stay in the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def id_remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo `divisor`: a fold that any engine can compute."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def trimmed(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`step` in a worker that gives back, before and after it, the memory that is free in the process.

    Workers serve one task after the other, and what a heap has once grown to stays with them.
    """

    def release() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from step(batches)
        release()

    return run


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    column = batch.column(name)
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b or b"" for b in column.to_pylist()]


def slices_by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, so that arrays built from them stay small."""
    for batch in batches:
        if batch.num_rows:
            rows = max(1, math.ceil(batch.num_rows * most / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordNames(dict):
    """64-bit names of words, remembered while they fit."""

    def __missing__(self, word: bytes) -> int:
        name = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = name
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
