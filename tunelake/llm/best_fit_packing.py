"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its word-BPE ids and one end id; only a longer one is cut. The plan needs
nothing but the number of pieces of each length, a table of at most `capacity` rows:

* pieces above one third of the capacity are matched greedily, the largest with the largest
  that still fits, so a bin holds at most two of them;
* smaller pieces, in decreasing length, go to the tightest gap that takes them.

Equal lengths are interchangeable, so the plan says which ranks of a length go where, and
every piece finds its place by its rank. Ranks are counted inside tasks and shifted by the
counts of the tasks before; no task sees all pieces of a length.

Null and empty texts are one piece with the end id only. Repeated rows are packed each.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tunelake.llm.common import CACHE_WORDS, documents, id_and_text, slices_by_bytes, text_bytes
from tunelake.session import written

CAPACITY = 2048
END_ID = 0
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BATCH_BYTES = 4 << 20

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\u024f]+")  # no mark combines with these and NFC leaves them alone
_END = b"\xff"  # never part of UTF-8; stands for the end of a word


def byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Token ids of white-space separated words, as packed little-endian 32-bit numbers.

    White space never joins two words of this vocabulary, so a text is the sequence of its
    words. The merges run in tiktoken, whose rule (merge the adjacent pair with the lowest
    rank) is the same for a vocabulary in which every entry encodes to itself; words outside
    the Latin letters and texts with the strings of special tokens go to tokenizers whole.
    """

    def __init__(self, path: str = VOCABULARY):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        byte = {letter: b for b, letter in byte_letters().items()}
        suffix = spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ended = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if ended else token)) + (_END if ended else b"")

        ranks = {bytes([b]) + _END: b for b in range(255)} | {bytes([b]): 255 + b for b in range(256)}
        for pair in spec["model"]["merges"]:
            ranks[raw("".join(pair if isinstance(pair, list) else pair.split(" ")))] = len(ranks)
        self.merger = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        special = {t["content"] for t in spec["added_tokens"]}
        self.ids = np.zeros(len(ranks), dtype="<u4")
        for token, i in spec["model"]["vocab"].items():
            if token not in special and (known := raw(token)) in ranks:  # all but byte 255 at a word's end
                self.ids[ranks[known]] = i
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            ids = self.parts[part] = self.ids[self.merger._encode_single_piece(part.encode() + _END)].tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if not _PLAIN.fullmatch(text):
            ids = self.by_library(text, ordinary=True)
        elif (lower := text.lower()).isalpha():
            ids = self.part(lower)
        else:
            ids = b"".join(map(self.part, _WORD.findall(lower)))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def by_library(self, text: str, ordinary: bool) -> bytes:
        """Ids of a text; `ordinary` takes the strings of special tokens as plain text, as inside a lower-cased word."""
        self.library.encode_special_tokens = ordinary
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self.by_library(text.decode(), ordinary=False)
        return b"".join(map(self.__getitem__, text.lower().split()))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of words per worker process."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """One row per piece; `_part` is its task and `_idx` its place among the task's pieces of equal length."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        words, part = word_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                ids = words.of(text) + end
                for i, start in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[start : start + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc_id, i, start // 4, n, zlib.crc32(piece), part, int(seen[n])))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_idx"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _idx long"
    return id_and_text(docs).mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, first sequence, pieces per bin, offset).

    The pieces of a length from the first rank on (up to the next row's) fill the sequences
    from the first one on, so many in each, from the offset on.
    """
    left = dict(sorted(((n, c) for n, c in counts.items() if c), reverse=True))
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first sequence, number)
    sizes: list[int] = []  # gaps with bins, ascending
    bins = 0

    def place(length: int, number: int, sequence: int, each: int, offset: int) -> None:
        plan.append((length, used[length], sequence, each, offset))
        used[length] += number
        left[length] -= number

    def leave(gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((sequence, number))

    large = [n for n in left if 3 * n > capacity]
    for a in large:
        while left[a]:
            b = next((n for n in large if n <= a and n + a <= capacity and left[n] > (n == a)), None)
            if b is None:
                number = left[a]
                place(a, number, bins, 1, 0)
                leave(capacity - a, bins, number)
            elif b == a:
                number = left[a] // 2
                place(a, 2 * number, bins, 2, 0)
                leave(capacity - 2 * a, bins, number)
            else:
                number = min(left[a], left[b])
                place(a, number, bins, 1, 0)
                place(b, number, bins, 1, a)
                leave(capacity - a - b, bins, number)
            bins += number

    for n in (n for n in left if 3 * n <= capacity):
        while left[n]:
            at = bisect.bisect_left(sizes, n)
            gap = sizes[at] if at < len(sizes) else capacity
            if gap == capacity and at == len(sizes):
                sequence, number = bins, -(-left[n] // (capacity // n))
                bins += number
            else:
                sequence, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            each = gap // n
            full = min(number, left[n] // each)
            if full:
                place(n, full * each, sequence, each, capacity - gap)
                leave(gap - each * n, sequence, full)
            if full < number and left[n]:  # the last few share one bin
                some = left[n]
                place(n, some, sequence + full, some, capacity - gap)
                leave(gap - some * n, sequence + full, 1)
                full += 1
            leave(gap, sequence + full, number - full) if gap < capacity else None
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Pieces of `docs` with sequence_id and offset."""
    cut = written(pieces(docs, capacity, path), "pieces")
    tasks = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # At most `capacity` rows: one for each length.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    shift = np.int64(40)
    keys = (plan[:, 0] << shift) + plan[:, 1]

    def find(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = plan[np.searchsorted(keys, (length << shift) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = cut.join(starts, ["length", "_part"]).select(*names, (F.col("_start") + F.col("_idx")).alias("_rank"))
    return ranked.mapInArrow(find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op4_best_fit_packing": op4_best_fit_packing}


def oracle_sql() -> dict[str, str]:
    return {}
