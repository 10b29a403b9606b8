"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every context (the hashed word before, in 2 ** CONTEXT_BITS classes) is a restaurant whose
customers are the tokens that follow it and whose dishes are words. All share one parent, the
restaurant of single words, which gets a customer for each table below it and has the uniform
distribution over the V known words and the unknown one above it. Seatings are sampled by
blocked Gibbs: in a sweep all customers of a dish leave and are seated anew, drawn from the
distribution of its tables given those of all other dishes (`table_counts`), whatever its
count. Scores use predictive probabilities averaged over the sweeps after the burn-in.

Words are dealt into buckets, so all customers of a word, in whatever context, are in one
place, and a word has at most 2 ** CONTEXT_BITS rows. The only shared state is the number of
customers and tables of each context (fixed size), taken from the sweep before. A bucket
replays earlier sweeps from it with its own seeded generator, so there is nothing else to keep.

Counts cover all training documents. Null and empty texts are one end token. Repeated rows
are learned from and scored each; a null id is scored but not learned from. Without training
tokens every token has the base probability. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.common import WordNames, documents, id_remainder, shuffle_partitions, slices_by_bytes, text_bytes, trimmed
from tunelake.llm.table_counts import drawn_tables
from tunelake.session import written

CONTEXT_BITS = 16
CONTEXTS = 1 << CONTEXT_BITS
SWEEPS = 3
BURN_IN = 1
STRENGTH = 1.0
SEED = 11
UNIT_BYTES = 4 << 20
UNIT_ROWS = 1 << 16
SLICES = 16

END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word has white space in it
START = np.uint64(xxhash.xxh3_64_intdigest(b"  "))


@dataclass
class Unit:
    """The tokens of a few documents: word names, contexts and documents of each."""

    words: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    tokens: np.ndarray  # of each document

    @staticmethod
    def of(texts: list[bytes], names: WordNames) -> Unit:
        split = [t.lower().split() for t in texts]
        sizes = np.array([len(s) + 1 for s in split], dtype=np.int64)
        words = np.empty(int(sizes.sum()), dtype=np.uint64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(words), dtype=bool)
        inner[ends] = False
        words[inner] = names.of([w for s in split for w in s])
        words[ends] = END
        before = np.concatenate([[START], words[:-1]])
        before[ends[:-1] + 1] = START
        return Unit(words, (before >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64), np.repeat(np.arange(len(texts)), sizes), sizes)


def dealt(words: np.ndarray, rest: np.ndarray, buckets: int):
    """Distinct (word, rest) with counts by bucket: bucket, words, entries of each, rest, counts."""
    distinct, local = np.unique(words, return_inverse=True)
    place = np.argsort(distinct % np.uint64(buckets), kind="stable")  # words by bucket
    rank = np.empty_like(place)
    rank[place] = np.arange(len(place))
    key, count = np.unique(rank[local].astype(np.int64) << 32 | rest, return_counts=True)
    distinct = distinct[place]
    word = key >> 32
    entries = np.bincount(word, minlength=len(distinct))
    cuts = np.searchsorted((distinct % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
    ends = np.concatenate([[0], np.cumsum(entries)])
    for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            yield bucket, distinct[a:b], entries[a:b], key[ends[a] : ends[b]] & 0xFFFFFFFF, count[ends[a] : ends[b]]


def blob(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its words, and for each the contexts it follows with counts, over all training documents."""

    def send(batches):
        names = WordNames()
        for batch in slices_by_bytes(batches, UNIT_BYTES):
            learn = np.array(batch.column("learn").to_pylist(), dtype=bool)
            unit = Unit.of(text_bytes(batch), names)
            use = learn[unit.doc]
            rows = [(b, blob(w, "<u8"), blob(n, "<u4"), blob(r, "<u2"), blob(c, "<u4")) for b, w, n, r, c in dealt(unit.words[use], unit.context[use], buckets)]
            yield batch_of(rows)

    def batch_of(rows):
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["bucket", "words", "entries", "contexts", "counts"])

    def merge(parts):
        words = np.concatenate([np.frombuffer(p[0], "<u8") for p in parts])
        entries = np.concatenate([np.frombuffer(p[1], "<u4") for p in parts])
        contexts = np.concatenate([np.frombuffer(p[2], "<u2") for p in parts]).astype(np.int64)
        counts = np.concatenate([np.frombuffer(p[3], "<u4") for p in parts])
        distinct, local = np.unique(words, return_inverse=True)
        key, inverse = np.unique(np.repeat(local, entries) << CONTEXT_BITS | contexts, return_inverse=True)
        total = np.bincount(inverse, counts, minlength=len(key))
        return blob(distinct, "<u8"), blob(np.bincount(key >> CONTEXT_BITS, minlength=len(distinct)), "<u4"), blob(key & (CONTEXTS - 1), "<u2"), blob(total, "<u4")

    def add(batches):
        # parts are merged as they come in, so a bucket is held once however many units there are
        now, parts, size = None, [], 0
        for batch in slices_by_bytes(batches, UNIT_BYTES):
            out = []
            for bucket, *part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "entries", "contexts", "counts")), strict=True):
                if bucket != now:
                    if parts:
                        out.append((now, *merge(parts)))
                    now, parts, size = bucket, [], 0
                parts.append(part)
                size += len(part[3])
                if len(parts) > 1 and size > 4 * len(parts[0][3]) + (8 << 20):
                    parts = [merge(parts)]
                    size = len(parts[0][3])
            yield batch_of(out)
        yield batch_of([(now, *merge(parts))] if parts else [])

    schema = "bucket int, words binary, entries binary, contexts binary, counts binary"
    sent = docs.mapInArrow(trimmed(send), schema)
    return sent.repartition(shuffle_partitions(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(add), schema)


@dataclass
class Shared:
    """What all buckets know of each other: fixed in size, one entry per finished sweep."""

    tokens: int = 0
    words: int = 0
    discount: float = 0.5
    parent_discount: float = 0.5
    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS))
    tables: list[np.ndarray] = field(default_factory=list)
    parent_customers: list[float] = field(default_factory=list)
    parent_tables: list[float] = field(default_factory=list)


class Bucket:
    """The restaurants' tables for the words of one bucket."""

    def __init__(self, bucket: int, words: bytes, entries: bytes, contexts: bytes, counts: bytes):
        self.bucket = bucket
        self.words = np.frombuffer(words, "<u8")
        self.contexts = np.frombuffer(contexts, "<u2").astype(np.int64)
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.word = np.repeat(np.arange(len(self.words)), np.frombuffer(entries, "<u4"))
        self.total = np.bincount(self.word, self.counts, minlength=len(self.words))

    def states(self, shared: Shared, sweeps: int):
        """Tables of each (context, word), and customers and tables of each word in the parent, after every sweep."""
        rng = np.random.default_rng([SEED, self.bucket])
        several = np.flatnonzero(self.counts > 1)
        tables = np.ones(len(self.counts), dtype=np.int64)
        customers = np.bincount(self.word, minlength=len(self.words))
        parents = np.ones(len(self.words), dtype=np.int64)
        for sweep in range(sweeps):
            others = shared.tables[sweep][self.contexts[several]] - tables[several]
            above = parent_probability(shared, sweep, customers, parents)[self.word[several]]
            tables[several] = drawn_tables(self.counts[several], STRENGTH + shared.discount * others, above, shared.discount, rng)
            customers = np.bincount(self.word, tables, minlength=len(self.words)).astype(np.int64)
            strength = STRENGTH + shared.parent_discount * (shared.parent_tables[sweep] - parents)
            parents = drawn_tables(customers, strength, np.full(len(customers), 1 / (shared.words + 1)), shared.parent_discount, rng)
            yield tables.copy(), customers, parents


def parent_probability(shared: Shared, sweep: int, customers: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Predictive probability of words in the parent restaurant; zeros give that of an unknown word."""
    spread = (STRENGTH + shared.parent_discount * shared.parent_tables[sweep]) / (shared.words + 1)
    return (customers - shared.parent_discount * parents + spread) / (STRENGTH + shared.parent_customers[sweep])


def buckets_of(batch: pa.RecordBatch):
    """Buckets one after the other; Spark's batches hold many rows, whatever their bytes, so few are copied at a time."""
    for some in slices_by_bytes([batch], UNIT_BYTES):
        for row in zip(*(some.column(c).to_pylist() for c in ("bucket", "words", "entries", "contexts", "counts")), strict=True):
            yield Bucket(*row)


def summed(table: DataFrame, what: Callable[[Bucket], tuple[list[float], list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over all buckets of a few numbers and of arrays by context; only the sums come to the driver."""
    width = CONTEXTS // SLICES

    def part(batches):
        numbers, arrays = None, None
        for batch in batches:
            for bucket in buckets_of(batch):
                own, by_context = what(bucket)
                numbers = np.array(own, dtype=float) + (0 if numbers is None else numbers)
                arrays = np.array(by_context, dtype=float) + (0 if arrays is None else arrays)
        if numbers is not None:
            yield rows_of([(-1, numbers)] + [(i, arrays[:, i * width : (i + 1) * width]) for i in range(SLICES)])

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                found[i] = np.frombuffer(values, "<f8") + found.get(i, 0)
        yield rows_of(list(found.items()))

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([blob(r[1], "<f8") for r in rows], pa.binary())], ["slice", "sums"])

    schema = "slice int, sums binary"
    rows = table.mapInArrow(trimmed(part), schema).repartition(shuffle_partitions(table), "slice").mapInArrow(trimmed(add), schema).collect()
    sums = {r["slice"]: np.frombuffer(r["sums"], "<f8") for r in rows}
    if not sums:
        return np.zeros(0), []
    parts = [sums[i].reshape(-1, width) for i in range(SLICES)]
    return sums[-1], list(np.concatenate(parts, axis=1))


def fitted(table: DataFrame, sweeps: int = SWEEPS) -> Shared:
    """Runs the sweeps; after each one the contexts' tables and the parent's totals are summed up."""

    def first(bucket: Bucket):
        contexts = np.bincount(bucket.word, minlength=len(bucket.words))
        numbers = [bucket.counts.sum(), len(bucket.words), len(bucket.counts)]
        numbers += [(bucket.counts == 1).sum(), (bucket.counts == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum()]
        return numbers, [np.bincount(bucket.contexts, bucket.counts, minlength=CONTEXTS), np.bincount(bucket.contexts, minlength=CONTEXTS)]

    numbers, arrays = summed(table, first)
    if not len(numbers):
        return Shared(tables=[np.zeros(CONTEXTS)] * (sweeps + 1), parent_customers=[0.0] * (sweeps + 1), parent_tables=[0.0] * (sweeps + 1))
    tokens, words, pairs, once, twice, single, double = numbers
    shared = Shared(
        tokens=int(tokens), words=int(words), discount=discount_of(once, twice), parent_discount=discount_of(single, double),
        customers=arrays[0], tables=[arrays[1]], parent_customers=[float(pairs)], parent_tables=[float(words)],
    )
    for sweep in range(1, sweeps + 1):

        def after(bucket: Bucket, sweep=sweep, shared=shared):
            *_, (tables, customers, parents) = bucket.states(shared, sweep)
            return [customers.sum(), parents.sum()], [np.bincount(bucket.contexts, tables, minlength=CONTEXTS)]

        numbers, arrays = summed(table, after)
        shared.tables.append(arrays[0])
        shared.parent_customers.append(float(numbers[0]))
        shared.parent_tables.append(float(numbers[1]))
    return shared


def discount_of(once: float, twice: float) -> float:
    """The usual estimate from how many counts are one and two, kept inside (0, 1)."""
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.05, 0.95))


class Scorer:
    """Log probabilities of entries of one bucket."""

    def __init__(self, bucket: Bucket | None, shared: Shared, sweeps: int, burn_in: int):
        self.bucket, self.shared = bucket, shared
        self.samples = []
        if bucket:
            self.key = bucket.word << CONTEXT_BITS | bucket.contexts
            for sweep, (tables, customers, parents) in enumerate(bucket.states(shared, sweeps), 1):
                if sweep > burn_in:
                    self.samples.append((sweep, bucket.counts - shared.discount * tables, parent_probability(shared, sweep, customers, parents)))
        none = np.zeros(1)
        self.unknown = {sweep: parent_probability(shared, sweep, none, none)[0] for sweep in range(burn_in + 1, sweeps + 1)}

    def of(self, words: np.ndarray, entries: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry: count of its word, log10 of its base probability, log10 of its averaged probability."""
        shared, n = self.shared, len(contexts)
        own = np.repeat(np.arange(len(words)), entries)
        count, at = np.zeros(len(words)), np.full(len(words), -1)
        pair = np.full(n, -1)
        if self.bucket:
            place = np.minimum(np.searchsorted(self.bucket.words, words), len(self.bucket.words) - 1)
            known = self.bucket.words[place] == words
            at[known] = place[known]
            count[known] = self.bucket.total[place[known]]
            key = at[own] << CONTEXT_BITS | contexts
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            pair = np.where((at[own] >= 0) & (self.key[spot] == key), spot, -1)
        seen, known = pair >= 0, at[own] >= 0
        probability = np.zeros(n)
        samples = self.samples or [(sweep, None, None) for sweep in self.unknown]
        for sweep, direct, parent in samples:
            above = np.full(n, self.unknown[sweep])
            if parent is not None:
                above[known] = parent[at[own[known]]]
            mass = (STRENGTH + shared.discount * shared.tables[sweep][contexts]) * above
            if direct is not None:
                mass[seen] += direct[pair[seen]]
            probability += mass / (STRENGTH + shared.customers[contexts])
        base = np.log10((count + 0.1) / (shared.tokens + 0.1 * (shared.words + 1)))
        return count[own], base[own], np.log10(probability / len(samples))


def scored(docs: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    `docs` has doc_id, text, learn (whether the model learns from the row) and held_out.
    """
    buckets = shuffle_partitions(docs)
    table = written(counted(docs, buckets), "word-contexts")
    shared = fitted(table, sweeps)
    model = docs.sparkSession.sparkContext.broadcast(shared)
    names = ["bucket", "unit", "words", "entries", "contexts", "counts", "docs", "ids", "held_out", "tokens"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    schema = "bucket int, unit long, words binary, entries binary, contexts binary, counts binary, docs binary, ids array<long>, held_out binary, tokens binary"

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def send(batches):
        word_names = WordNames()
        number = TaskContext.get().partitionId() << 32
        for batch in slices_by_bytes(batches, UNIT_BYTES):
            for start in range(0, batch.num_rows, UNIT_ROWS):
                some = batch.slice(start, UNIT_ROWS)
                unit = Unit.of(text_bytes(some), word_names)
                held = np.array(some.column("held_out").to_pylist(), dtype=bool)
                rows = [
                    (b, number, blob(w, "<u8"), blob(n, "<u4"), blob(r >> 16, "<u2"), blob(c, "<u4"), blob(r & 0xFFFF, "<u2"), None, None, None)
                    for b, w, n, r, c in dealt(unit.words, unit.context << 16 | unit.doc, buckets)
                ]
                about = (some.column("doc_id").to_pylist(), blob(held, "?"), blob(unit.tokens, "<i8"))
                yield rows_of([*rows, (number % buckets, number, None, None, None, None, None, *about)])
                number += 1

    def score(batches):
        now, scorer = None, None
        for batch in slices_by_bytes(batches, UNIT_BYTES):
            out = []
            for bucket, unit, words, entries, contexts, counts, own, ids, held, tokens in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if unit is None:  # the bucket itself comes before the units
                    now, scorer = bucket, Scorer(Bucket(bucket, words, entries, contexts, counts), model.value, sweeps, burn_in)
                elif words is None:
                    out.append((unit, ids, held, tokens, None, None, None))
                else:
                    if bucket != now:
                        now, scorer = bucket, Scorer(None, model.value, sweeps, burn_in)
                    times = np.frombuffer(counts, "<u4")
                    found = scorer.of(np.frombuffer(words, "<u8"), np.frombuffer(entries, "<u4"), np.frombuffer(contexts, "<u2").astype(np.int64))
                    doc = np.frombuffer(own, "<u2")
                    sums = (np.bincount(doc, times * x) for x in (found[0] > 0, found[1], found[2]))
                    out.append((unit, None, None, None, *(blob(x, "<f8") for x in sums)))
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["unit", "ids", "held_out", "tokens", "known", "base", "score"])

    def gather(batches):
        now = None
        for batch in slices_by_bytes(batches, UNIT_BYTES):
            for unit, ids, held, tokens, *sums in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if ids is not None:  # the list of documents comes first
                    if now:
                        yield documents_of(*now)
                    now = (ids, held, tokens, np.zeros((3, len(ids))))
                else:
                    for i, x in enumerate(sums):
                        part = np.frombuffer(x, "<f8")
                        now[3][i, : len(part)] += part
        if now:
            yield documents_of(*now)

    def documents_of(ids, held, tokens, sums):
        n = len(ids)
        columns = [
            pa.array(ids, pa.int64()), pa.array(np.frombuffer(held, "?")), pa.array(np.frombuffer(tokens, "<i8")),
            pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(np.full(n, shared.tokens, dtype=np.int64)), pa.array(sums[1]), pa.array(sums[2]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    absent = {"unit": "long", "docs": "binary", "ids": "array<long>", "held_out": "binary", "tokens": "binary"}
    first = table.select(*[F.lit(None).cast(absent[c]).alias(c) if c in absent else F.col(c) for c in names])
    order = ["bucket", F.col("unit").asc_nulls_first()]
    dealt_out = first.union(docs.mapInArrow(trimmed(send), schema)).repartition(buckets, "bucket").sortWithinPartitions(*order)
    parts = dealt_out.mapInArrow(trimmed(score), "unit long, ids array<long>, held_out binary, tokens binary, known binary, base binary, score binary")
    by_unit = parts.repartition(shuffle_partitions(docs), "unit").sortWithinPartitions("unit", F.col("ids").isNull())
    return by_unit.mapInArrow(trimmed(gather), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = id_remainder(10)
    return scored(
        documents(spark, sf_dir).select(
            F.col("doc_id").cast("long").alias("doc_id"), "text",
            F.coalesce(fold != 0, F.lit(False)).alias("learn"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        )
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op7_pitman_yor_lm": op7_pitman_yor_lm}


def oracle_sql() -> dict[str, str]:
    return {}
