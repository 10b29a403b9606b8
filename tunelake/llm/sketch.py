"""A table of fixed size that tells which 64-bit names can occur only once.

Names fall into `2 ** bits` cells and every cell counts its names up to a limit. A cell
that counted one name proves that the name is unique. Other names may share a cell,
so the table is used only to leave out what is unique or to choose an order; whatever
remains is decided exactly. Its size depends on `bits` alone, which bounds the broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import shuffle_partitions

BITS = 27
SLICES = 256


def packed(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as gaps of one byte; 255 adds to the gap that follows."""
    gaps = np.diff(cells, prepend=0)
    more = gaps // 255
    ends = np.cumsum(more + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, dtype=np.uint8)
    out[ends] = gaps - more * 255
    return out.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, dtype=np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def blobs(names: np.ndarray, bits: int) -> pa.RecordBatch:
    """The cells of `names`, one packed row per slice of the table."""
    cells = np.sort((names >> np.uint64(64 - bits)).astype(np.int64))
    width = 1 << max(bits - SLICES.bit_length() + 1, 0)
    cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, width))
    rows = [(i, packed(cells[a:b] - i * width)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "cells"]
    )


class Counts:
    """Cell counts: 0 or 1, a few, at least `many`; two bits a cell."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def __reduce__(self):
        """Sent compressed: the table of a small input is almost empty."""
        return _unpacked_counts, (self.bits, zlib.compress(self.table, 1))

    def of(self, names: np.ndarray) -> np.ndarray:
        """0: fewer than `few` names in the cell (for 2: the name is unique); 1: at least `few`; 2: at least `many`."""
        cells = names >> np.uint64(64 - self.bits)
        return (self.table[(cells >> np.uint64(2)).astype(np.int64)] >> ((cells & np.uint64(3)) << np.uint64(1)).astype(np.uint8)) & 3


def _unpacked_counts(bits: int, table: bytes) -> Counts:
    return Counts(bits, np.frombuffer(zlib.decompress(table), dtype=np.uint8))


def count_names(
    docs: DataFrame, names_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], many: int, bits: int = BITS, few: int = 2
) -> Counts:
    """Counts the names that `names_of` yields per batch: code 1 from `few`, 2 from `many` on.

    What comes to the driver has `2 ** bits / 4` bytes.
    """
    width = 1 << max(bits - SLICES.bit_length() + 1, 0)

    def send(batches):
        for names in names_of(batches):
            if len(names):
                yield blobs(names, bits)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if i not in held:
                    held[i] = np.zeros(width, dtype=np.uint8)
                cells, times = np.unique(unpacked(blob), return_counts=True)
                held[i][cells] = np.minimum(held[i][cells].astype(np.int64) + times, many)
        for i, counts in held.items():
            code = (counts >= few).astype(np.uint8) + (counts >= many)
            code = np.pad(code, (0, -len(code) % 4)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([(code << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()], pa.binary())],
                ["slice", "codes"],
            )

    sent = docs.mapInArrow(send, "slice int, cells binary")
    rows = sent.repartition(shuffle_partitions(docs), F.col("slice")).mapInArrow(add, "slice int, codes binary").collect()
    per = width // 4
    table = np.zeros((1 << bits) // 4, dtype=np.uint8)
    for row in rows:
        table[row["slice"] * per : (row["slice"] + 1) * per] = np.frombuffer(row["codes"], dtype=np.uint8)
    return Counts(bits, table)
