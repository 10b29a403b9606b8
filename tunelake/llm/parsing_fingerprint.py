"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by deterministic coin tossing: each symbol is labelled with the
lowest bit in which it differs from its left neighbour, a few rounds bring the labels down to
six values, and the local maxima of the last labels begin the phrases. A phrase is named by
a hash of its symbols, and the names are parsed again, level by level. A border depends on a
bounded neighbourhood only, so equal substrings have the same names inside, at any offset.

The fingerprint keeps, for each of SLOTS classes of phrase names of level LEVEL, the smallest
name. The likeness of two fingerprints estimates the share of common phrases (Dice).

Null and empty texts have the same fingerprint, in which all slots are empty, and likeness 1
to each other. Of repeated ids the texts' hashes give the order. A null id comes last. The
document after the last is the first; a single document is its own successor. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.common import documents, id_and_text, mixed, shuffle_partitions, slices_by_bytes, text_bytes

LEVEL = 3
SLOTS = 128
EMPTY = 0xFFF
TOSSES = 3  # rounds that bring labels of 7 or 8 bits below 6
BATCH_BYTES = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


_LOW = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], dtype=np.uint8)  # lowest set bit of a byte
_BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64))
_BYTE_LABELS = np.random.default_rng(3).permutation(256).astype(np.uint8)


def first_toss(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below 128 of 64-bit names that differ from their left neighbours."""
    differ = np.ones_like(names)
    np.bitwise_xor(names[1:], names[:-1], out=differ[1:])
    bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    label = bit * np.uint8(2) + (names >> bit & np.uint64(1)).astype(np.uint8)
    label[starts] = names[starts].astype(np.uint8) & 1
    return label


def toss(label: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The next, smaller labels; neighbours go on to differ."""
    differ = np.zeros_like(label)
    np.bitwise_xor(label[1:], label[:-1], out=differ[1:])
    bit = _LOW[differ]
    out = bit * np.uint8(2) + (label >> bit & np.uint8(1))
    out[starts] = label[starts] & 1
    return out


def without_runs(symbols: np.ndarray, names: np.ndarray | None, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours become one symbol, named by symbol and number: symbols, names, starts of documents."""
    first = np.ones(len(symbols), dtype=bool)
    np.not_equal(symbols[1:], symbols[:-1], out=first[1:])
    first[starts] = True
    at = np.flatnonzero(first)
    kept = symbols[at]
    own = _BYTE_NAMES[kept] if names is None else kept.copy()
    length = np.diff(at, append=len(symbols))
    long = np.flatnonzero(length > 1)
    own[long] = mixed(own[long] + length[long].astype(np.uint64) * _MULTIPLIER)
    return kept, own, np.searchsorted(at, starts)


def phrases(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the parse: names of the phrases and where documents start among them.

    `symbols` are the bytes of the texts or the names of the level below.
    """
    raw = symbols.dtype == np.uint8
    kept, names, starts = without_runs(symbols, None if raw else symbols, starts)
    label = _BYTE_LABELS[kept] if raw else first_toss(names, starts)
    for _ in range(TOSSES):
        label = toss(label, starts)
    begin = np.zeros(len(names), dtype=bool)
    np.logical_and(label[1:-1] > label[:-2], label[1:-1] > label[2:], out=begin[1:-1])
    begin[starts[1:] - 1] = False  # the last symbol of a document begins no phrase
    begin[starts] = True
    at = np.flatnonzero(begin)
    sizes = np.diff(at, append=len(names))
    place = np.arange(len(names)) - np.repeat(at, sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), _MULTIPLIER))
        return mixed(np.add.reduceat(names * powers[place], at)), np.searchsorted(at, starts)


def fingerprints(texts: list[bytes], level: int = LEVEL) -> np.ndarray:
    """One row of SLOTS values per text."""
    out = np.full((len(texts), SLOTS), EMPTY, dtype=np.uint16)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        names = np.frombuffer(b"".join(texts), dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[filled]
        for _ in range(level):
            names, starts = phrases(names, starts)
        docs = np.repeat(filled, np.diff(starts, append=len(names)))
        width = SLOTS.bit_length() - 1
        slot = docs.astype(np.uint64) * np.uint64(SLOTS) + (names >> np.uint64(64 - width))
        keys = np.sort(slot << np.uint64(24) | (names & np.uint64(0xFFFFFF)))
        place = keys >> np.uint64(24)
        least = np.concatenate([[True], place[1:] != place[:-1]])
        out.reshape(-1)[place[least].astype(np.int64)] = (keys[least] & np.uint64(0xFFFFFF)) % np.uint64(EMPTY)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common phrases, row by row: 0 to 1, and 1 for equal fingerprints."""
    used = (a != EMPTY) | (b != EMPTY)
    total = used.sum(axis=1)
    jaccard = np.where(total > 0, ((a == b) & used).sum(axis=1) / np.maximum(total, 1), 1.0)
    return 2 * jaccard / (1 + jaccard)


def as_text(prints: np.ndarray) -> list[str]:
    """Three hexadecimal digits a slot."""
    return ["".join(map(_HEX.__getitem__, row)) for row in prints.tolist()]


_HEX = [f"{i:03x}" for i in range(EMPTY + 1)]


def with_fingerprint(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches):
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(as_text(fingerprints(text_bytes(batch), level)))], ["doc_id", "fingerprint"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows by descending id in partitions cut at known ids; a partition ends with a guest, the row after its last.

    The cuts are ids that occur, so the first row of a partition is known before any text
    moves, and each text moves once.
    """
    parts = shuffle_partitions(docs)
    lowest = -(1 << 63)
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(lowest)))
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts + 1)])
    found = keyed.agg(F.percentile_approx("_key", steps, F.lit(100_000)).alias("cuts"), F.max("_key").alias("most")).first()
    cuts = np.array(sorted({*(found["cuts"] or []), *([found["most"]] if found["most"] is not None else [])}), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, key.to_numpy())  # the smallest cut that is not below
        first = cuts[np.minimum(at, len(cuts) - 1)] == key.to_numpy()
        return pd.Series([[int(i), int((i + 1) % len(cuts))] if f else [int(i)] for i, f in zip(at, first, strict=True)])

    placed = keyed.select("doc_id", "text", "_key", F.posexplode(places("_key")).alias("_guest", "_part"))
    order = [F.col("_guest"), F.col("_key").desc(), F.xxhash64("text")]
    return placed.repartitionById(max(len(cuts), 1), F.col("_part")).sortWithinPartitions(*order).select("doc_id", "text", "_guest")


def compare_edited(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and what they are like."""

    def rows_of(ids, texts, prints):
        """Output for all texts but the last, which is only the successor."""
        plain = [t.decode() for t in texts]
        edited = []
        for text, after in zip(plain, plain[1:]):
            k = len(text) // 3
            edited.append((text[: len(text) - k] + after[:k]).encode())
        changed = fingerprints(edited, level)
        own = prints[:-1]
        columns = [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in plain[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            pa.array(as_text(own), pa.string()),
            pa.array(as_text(changed), pa.string()),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, prints[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def run(batches):
        ids, texts, prints = [], [], np.zeros((0, SLOTS), dtype=np.uint16)
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            guest = batch.column("_guest").to_numpy()
            new = text_bytes(batch)
            if guest.any():  # one guest is enough: the first of equal ids
                new = new[: int(guest.argmax()) + 1]
            ids += batch.column("doc_id").to_pylist()[: len(new)]
            texts += new
            prints = np.concatenate([prints, fingerprints(new, level)])
            if len(texts) > 1:
                yield rows_of(ids, texts, prints)
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
            if guest.any():
                return

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(id_and_text(docs)).mapInArrow(run, schema)


def op3_parsing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op3_parsing_fingerprint": op3_parsing_fingerprint}


def oracle_sql() -> dict[str, str]:
    return {}
