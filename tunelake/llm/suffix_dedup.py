"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A suffix is repeated when its first LENGTH bytes also start anywhere else. Suffixes are put
into buckets and the buckets refined until each holds equal strings of that length:

* Initial buckets. Every suffix hangs on an anchor, the smallest hashed q-gram in its first
  WINDOW places. Anchors depend on content only, so equal suffixes have equal anchors at equal
  distances. The bucket of an anchor is the string that all its suffixes contain from it on.
  Buckets with one member hold nothing repeated and are left out at once.
* Refinement by later offsets. The suffixes of one anchor are a run. Sorting the members of
  a bucket by the name of the run's whole string puts equal runs side by side, which settles
  all their suffixes together: what a run learns is used for each of them.
* Again, one suffix at a time, for runs that differ inside a bucket. Of equal runs one takes
  part, so this touches only the borders of what is repeated.

Buckets are named by 64-bit hashes of their strings, so names agree on all executors. Of equal
keys of one batch one goes to its bucket; the others are settled, lose what copies of a text
repeat and are dealt out by themselves. A sorted stream then compares neighbours and keeps one
row in memory. Texts are named as well, and what is found for a text holds for all its copies;
places are reduced to distinct ones before the texts are brought to them.

Null and empty texts, and texts shorter than LENGTH, lose nothing. Repeated rows count as
occurrences elsewhere. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.common import documents, mixed, shuffle_partitions, slices_by_bytes, text_bytes, trimmed
from tunelake.llm.sketch import count_names
from tunelake.session import emptied, tracked, written

LENGTH = 200
WINDOW = 64
GRAM = 16
CORE = LENGTH - WINDOW + 1
BLOCK = 1 << 20  # places that one block of arrays covers

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, once per worker process."""
    if not _powers:
        n = BLOCK + 2 * LENGTH
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


class Block:
    """Pieces of texts in one array, with names of any substring in constant time."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
        self.up, down = powers()
        self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.data] * down[: len(self.data)], out=self.sums[1:])
        sizes = np.array([len(p[2]) for p in pieces])
        self.start = np.cumsum(sizes) - sizes
        self.last = self.start + sizes - LENGTH  # last place where a whole string starts
        self.text = np.array([p[0] for p in pieces])
        self.offset = np.array([p[1] for p in pieces])

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First place, last place, anchor and piece of each run of suffixes with one anchor."""
        n = len(self.data) - GRAM + 1
        key = (self.sums[GRAM:] - self.sums[:-GRAM]) * self.up[:n]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key &= ~_PLACE
        key |= np.arange(n, dtype=np.uint64)
        step = 1
        while step < WINDOW:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        anchor = (key & _PLACE).astype(np.int64)
        change = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(change, self.start, 1)
        np.add.at(change, self.last + 1, -1)
        inside = np.cumsum(change[: len(anchor)], dtype=np.int8) > 0
        same = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
        first = np.flatnonzero(inside & ~np.concatenate([[False], same]))
        last = np.flatnonzero(inside & ~np.concatenate([same, [False]]))
        return first, last, anchor[first], np.searchsorted(self.start, first, side="right") - 1


def blocks(texts: list[bytes]) -> Iterator[Block]:
    """The texts that are long enough, in blocks; a long text takes several that overlap."""
    pieces, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, len(text) - LENGTH + 1, BLOCK):
            piece = text[offset : offset + BLOCK + LENGTH - 1]
            if pieces and size + len(piece) > BLOCK:
                yield Block(pieces)
                pieces, size = [], 0
            pieces.append((i, offset, piece))
            size += len(piece)
    if pieces:
        yield Block(pieces)


def text_names(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64)


def suffix_ids(texts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Names of suffixes: of a text and a place in it."""
    return mixed(texts + places.astype(np.uint64) * np.uint64(_BASE))


def table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


ROWS = "settled boolean, bucket long, name long, text long, first int, last int, many boolean"


def combined(bucket: np.ndarray, name: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows of ROWS in which equal (bucket, name) of the batch are settled, but for one that goes on for all.

    Copies of a text have their places once.
    """
    order = np.lexsort((first, text, name, bucket))
    bucket, name, text, first, last = bucket[order], name[order], text[order], first[order], last[order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (bucket[1:] == bucket[:-1]) & (name[1:] == name[:-1])
    many = np.append(again[1:], False) & ~again
    copy = again.copy()
    copy[1:] &= (text[1:] == text[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
    columns = {"settled": again, "bucket": bucket, "name": name, "text": text, "first": first.astype(np.int32), "last": last.astype(np.int32), "many": many}
    return table({c: v[~copy] for c, v in columns.items()})


def dealt_out(rows: DataFrame, partitions: int) -> DataFrame:
    """ROWS by bucket; settled rows need no comparison and are spread by their places."""
    return rows.repartition(partitions, F.when(F.col("settled"), F.xxhash64("text", "first")).otherwise(F.col("bucket")))


def initial_runs(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The runs whose anchor's bucket may have another member, and the counts they read."""

    def names_of(batches):
        for batch in slices_by_bytes(batches, BLOCK):
            for block in blocks(text_bytes(batch)):
                anchor = block.runs()[2]
                yield mixed(block.names(anchor, anchor + CORE))

    counts = docs.sparkSession.sparkContext.broadcast(count_names(docs, names_of, 3))

    def run(batches):
        for batch in slices_by_bytes(batches, BLOCK):
            texts = text_bytes(batch)
            names = text_names(texts)
            for block in blocks(texts):
                first, last, anchor, piece = block.runs()
                bucket = mixed(block.names(anchor, anchor + CORE))
                use = counts.value.of(bucket) > 0
                first, last, anchor, piece, bucket = first[use], last[use], anchor[use], piece[use], bucket[use]
                shape = ((anchor - first) * WINDOW + last - first).astype(np.uint64)
                whole = mixed(block.names(first, last + LENGTH) + mixed(shape))
                shift = block.offset[piece] - block.start[piece]
                yield combined(bucket, whole, names[block.text[piece]], first + shift, last + shift)

    return docs.mapInArrow(trimmed(run), ROWS), counts


def refined(rows: DataFrame, partitions: int) -> DataFrame:
    """Sorts ROWS within buckets and compares neighbours: (open, text, first, last).

    Rows that are not open are repeated suffixes. An open row stands for all rows of its name
    and has another name in its bucket.
    """

    def out(opened, text, first, last):
        return table({"open": np.full(len(text), opened), "text": text, "first": first, "last": last})

    def run(batches):
        held = None  # the last row so far: its equality with the row before, and the row
        start = None  # the last first row of a name: whether its bucket had a name before, and the row
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            done = columns["settled"]
            if done.any():
                yield out(False, *(columns[c][done] for c in ("text", "first", "last")))
                columns = {c: v[~done] for c, v in columns.items()}
                if not len(columns["bucket"]):
                    continue
            if held:
                columns = {c: np.concatenate([held[1][c], v]) for c, v in columns.items()}
            bucket, name = columns["bucket"], columns["name"]
            same = np.zeros(len(bucket) + 1, dtype=bool)
            same[1:-1] = (bucket[1:] == bucket[:-1]) & (name[1:] == name[:-1])
            same[0] = bool(held) and held[0]
            repeated = (same[:-1] | same[1:] | columns["many"])[:-1]
            yield out(False, *(columns[c][:-1][repeated] for c in ("text", "first", "last")))
            begins = np.flatnonzero(~same[:-1])
            begins = begins[begins > 0] if held else begins
            firsts = {c: columns[c][begins] for c in ("bucket", "text", "first", "last")}
            if start:
                firsts = {c: np.concatenate([start[1][c], v]) for c, v in firsts.items()}
            near = np.zeros(len(firsts["bucket"]) + 1, dtype=bool)
            near[1:-1] = firsts["bucket"][1:] == firsts["bucket"][:-1]
            near[0] = bool(start) and start[0]
            opened = (near[:-1] | near[1:])[:-1]
            yield out(True, *(firsts[c][:-1][opened] for c in ("text", "first", "last")))
            held = (bool(same[-2]), {c: v[-1:] for c, v in columns.items()})
            start = (bool(near[-2]), {c: v[-1:] for c, v in firsts.items()})
        if held and (held[0] or held[1]["many"][0]):
            yield out(False, *(held[1][c] for c in ("text", "first", "last")))
        if start and start[0]:
            yield out(True, *(start[1][c] for c in ("text", "first", "last")))

    dealt = dealt_out(rows, partitions).sortWithinPartitions("bucket", "name")
    return dealt.mapInArrow(trimmed(run), "open boolean, text long, first int, last int")


def single_suffixes(docs: DataFrame, opened: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The suffixes of open runs, each named by its whole string, and the choice that they read."""

    def names_of(batches):
        for batch in batches:
            yield suffix_ids(batch.column("text").to_numpy().view(np.uint64), batch.column("first").to_numpy())

    # Other runs that share a cell take part as well; they are suffixes of the texts like any.
    chosen = docs.sparkSession.sparkContext.broadcast(count_names(opened, names_of, 2, few=1))

    def run(batches):
        for batch in slices_by_bytes(batches, BLOCK):
            texts = text_bytes(batch)
            names = text_names(texts)
            for block in blocks(texts):
                first, last, _, piece = block.runs()
                text = names[block.text[piece]]
                shift = block.offset[piece] - block.start[piece]
                use = chosen.value.of(suffix_ids(text, first + shift)) > 0
                first, last, text, shift = first[use], last[use], text[use], shift[use]
                size = last - first + 1
                place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                own = place + np.repeat(shift, size)
                yield combined(mixed(block.names(place, place + LENGTH)), np.zeros(len(place), dtype=np.uint64), np.repeat(text, size), own, own)

    return docs.mapInArrow(trimmed(run), ROWS), chosen


def repeated_suffixes(docs: DataFrame) -> DataFrame:
    """(text, first, last): places of named texts whose suffixes are repeated, each once.

    They are written; the tables and counts that led to them are freed.
    """
    partitions = shuffle_partitions(docs)
    with tracked() as used:
        initial, counts = initial_runs(docs)
        runs = written(refined(initial, partitions), "runs")
    counts.destroy()
    single, chosen = single_suffixes(docs, runs.filter("open"))
    found = runs.union(refined(single, partitions)).filter("NOT open").drop("open").distinct()
    places = written(found, "places")
    chosen.destroy()
    emptied(docs.sparkSession, used)
    return places


def without_repeats(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes go, in how many runs."""
    change = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def touched_texts(docs: DataFrame, places: DataFrame, keep_text: bool) -> tuple[Callable[[np.ndarray], np.ndarray], DataFrame]:
    """A test for texts that may lose something, and for each one that does: text, n_removed, n_spans, kept or its digest."""

    def names_of(batches):
        for batch in batches:
            yield np.unique(batch.column("text").to_numpy()).view(np.uint64)

    found = docs.sparkSession.sparkContext.broadcast(count_names(places, names_of, 2, few=1))

    def maybe(names: np.ndarray) -> np.ndarray:
        return found.value.of(names) > 0

    def send(batches):
        for batch in slices_by_bytes(batches, BLOCK):
            texts = text_bytes(batch)
            names = text_names(texts)
            use = np.intersect1d(np.unique(names, return_index=True)[1], np.flatnonzero(maybe(names)))
            none = pa.nulls(len(use), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[use].view(np.int64)), none, none, pa.array([texts[i] for i in use], pa.binary())], ["text", "first", "last", "bytes"]
            )

    def cut(batches):
        now, first, last, solved = None, [], [], True
        for batch in batches:
            out = []
            at = batch.column("text").to_numpy()
            begin, end = (batch.column(c).fill_null(-1).to_numpy() for c in ("first", "last"))
            borders = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                if at[a] != now:
                    now, first, last, solved = at[a], [], [], False
                n = int((begin[a:b] >= 0).sum())  # the places of a text come before its bytes
                first.append(begin[a : a + n].copy())
                last.append(end[a : a + n].copy())
                if n < b - a and not solved:
                    solved = True
                    if sum(map(len, first)):
                        kept, removed, spans = without_repeats(batch.column("bytes")[a + n].as_py(), np.concatenate(first), np.concatenate(last))
                        out.append((int(now), removed, spans, kept.decode(errors="ignore").encode() if keep_text else hashlib.sha256(kept).hexdigest().encode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["text", "n_removed", "n_spans", "kept"])

    rows = places.withColumn("bytes", F.lit(None).cast("binary")).union(docs.mapInArrow(trimmed(send), "text long, first int, last int, bytes binary"))
    dealt = rows.repartition(shuffle_partitions(docs), "text").sortWithinPartitions("text", F.col("first").asc_nulls_last())
    return maybe, dealt.mapInArrow(trimmed(cut), "text long, n_removed long, n_spans long, kept binary")


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = repeated_suffixes(rows.select("text"))
    _, texts = touched_texts(rows.select("text"), places, keep_text=False)

    def name(batches):
        for batch in slices_by_bytes(batches, BLOCK):
            own = text_bytes(batch)
            names = text_names(own)
            whole = [hashlib.sha256(t).hexdigest() for t in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in own], pa.int64()), pa.array(names.view(np.int64)), pa.array(whole, pa.string())],
                ["doc_id", "n_bytes", "text", "whole"],
            )

    named = rows.mapInArrow(trimmed(name), "doc_id long, n_bytes long, text long, whole string")
    return named.join(texts, "text", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce(F.col("kept").cast("string"), "whole").alias("kept_sha256"),
    )


def strip_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with `text` reduced (and `n_chars` with it); documents that lose all their text are left out.

    Bytes of a character that was cut through go as well. Only texts that may lose something are shuffled.
    """
    plain = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*plain)
    places = repeated_suffixes(rows.select("text"))
    maybe, texts = touched_texts(rows.select("text"), places, keep_text=True)

    def name(batches):
        for batch in slices_by_bytes(batches, BLOCK):
            names = text_names(text_bytes(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names.view(np.int64)), pa.array(maybe(names))], [*plain, "_name", "_maybe"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _name long, _maybe boolean"
    named = rows.mapInArrow(trimmed(name), schema)
    left = named.filter("_maybe").join(texts.select(F.col("text").alias("_name"), F.col("kept").cast("string").alias("_kept")), "_name", "left")
    reduced = left.withColumn("text", F.coalesce("_kept", "text")).filter("_kept IS NULL OR _kept <> ''")
    if "n_chars" in docs.columns:
        n_chars = plain[docs.columns.index("n_chars")]
        reduced = reduced.withColumn(n_chars, F.when(F.col("_kept").isNotNull(), F.length("text")).otherwise(F.col(n_chars)).cast(rows.schema[n_chars].dataType))
    return named.filter("NOT _maybe").select(*plain).union(reduced.select(*plain)).toDF(*docs.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op9_suffix_dedup": op9_suffix_dedup}


def oracle_sql() -> dict[str, str]:
    return {}
