"""N-gram Jaccard join: a size-aware heavy-light join of word-shingle sets.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold.
Equal sets are one class. Two sets of sizes n and m link when they share at least
c(n, m) = ceil(s (n + m) / (1 + s)) shingles, so

* light sets (few shingles) enumerate their subsets of those fixed sizes; two light sets
  link when a subset is the same;
* heavy sets scan inverted lists. Under an order that is the same for all sets (what is
  rare first) linked sets meet in the list of one of their first n - ceil(s n) + 1
  shingles, and the rest of the lists need no scan. Shingles that the fixed table of
  `sketch` proves unique have lists of one and are left out.

The border between light and heavy is the size with the least cost: subsets to enumerate
against entries to scan, both measured on the data.

The sets of one list go to the cell of its smallest member. All pairs of a cell are decided
exactly by a matrix product of shingle incidences, and only a spanning forest of their links
leaves the task. A cell is cut into blocks of bounded size, and each pair of blocks is a
task of its own. Components of the links come from `components`.

Documents without words (null, empty or blank) have no shingles and link with nothing;
shorter texts than a shingle are one shingle. Repeated rows give repeated rows, a null id
has a null component, and an empty table gives an empty result. Shingles are named by
64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.common import WordNames, documents, id_and_text, mixed, shuffle_partitions, slices_by_bytes, text_bytes
from tunelake.llm.components import connected_components
from tunelake.llm.sketch import count_names
from tunelake.session import written

WORDS = 3
SIMILARITY = (90, 100)
LIGHT_MOST = 30  # sizes beyond have too many subsets to be weighed at all
MERGES = 2  # rounds in which overlapping cells are merged
MANY = 16  # a shingle of so many documents comes last in the order
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1_000_000
COLUMNS = 4096  # of an incidence matrix at a time
BATCH_BYTES = 4 << 20

_MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int, names: WordNames) -> Iterator[np.ndarray]:
    """The sorted shingle names of each text; empty without words."""
    split = [t.lower().split() for t in texts]
    lengths = [len(s) for s in split]
    flat = names.of([w for s in split for w in s])
    rolled = np.zeros(max(len(flat) - words + 1, 0), dtype=np.uint64)
    for i in range(words):
        rolled += flat[i : i + len(rolled)] * _MULTIPLIERS[i]
    rolled = mixed(rolled)
    start = 0
    for n in lengths:
        if n >= words:
            yield np.unique(rolled[start : start + n - words + 1])
        elif n:
            yield mixed((flat[start : start + n] * _MULTIPLIERS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield rolled[:0]
        start += n


def needed(n: int, m: int, similarity: tuple[int, int]) -> int:
    """Common shingles that sets of these sizes need to link."""
    over, under = similarity
    return -(-over * (n + m) // (over + under))


def prefix_length(n: int, similarity: tuple[int, int]) -> int:
    over, under = similarity
    return n + 1 - -(-over * n // under)


def subset_sizes(n: int, light: int, similarity: tuple[int, int]) -> list[int]:
    """Sizes of the subsets that a light set of n shingles shares with the light sets it links with."""
    over, under = similarity
    others = range(-(-over * n // under), min(light, under * n // over) + 1)
    return sorted({c for m in others if (c := needed(n, m, similarity)) <= min(n, m)})


def subset_count(n: int, similarity: tuple[int, int]) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, LIGHT_MOST, similarity))


def subset_keys(tokens: np.ndarray, light: int, similarity: tuple[int, int]) -> np.ndarray:
    """Names of all those subsets: sums without the left-out shingles."""
    values, n, found = mixed(tokens), len(tokens), []
    whole = values.sum(dtype=np.uint64)
    for c in subset_sizes(n, light, similarity):
        left_out = np.array(list(itertools.combinations(range(n), n - c)), dtype=np.int64).reshape(math.comb(n, c), n - c)
        found.append(mixed(whole - values[left_out].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
    return np.concatenate(found) if found else tokens[:0]


def shingle_rows(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, n, set_id, and for sets that may have a partner: keys (their lists) and tokens (all shingles)."""

    def names_of(batches):
        names = WordNames()
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            yield np.concatenate([*shingle_sets(text_bytes(batch), words, names), np.zeros(0, dtype=np.uint64)])

    counts = docs.sparkSession.sparkContext.broadcast(count_names(docs, names_of, MANY))

    def run(batches):
        names = WordNames()
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            sizes, ids, keys, tokens = [], [], [], []
            for found in shingle_sets(text_bytes(batch), words, names):
                n = len(found)
                code = counts.value.of(found)
                p = prefix_length(n, similarity) if n else 0
                # the names ascend, so a stable sort by class orders by (class, name)
                first = np.argsort(code, kind="stable")[:p]
                shared = found[first[code[first] > 0]]
                sizes.append(n)
                ids.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                keys.append(shared.view(np.int64))
                tokens.append(found.view(np.int64) if len(shared) else shared.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), lists(keys), lists(tokens)],
                ["doc_id", "n", "set_id", "keys", "tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, keys array<long>, tokens array<long>")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def light_border(sets: DataFrame, similarity: tuple[int, int]) -> int:
    """Largest light size: where subsets cost less than scanning lists. One row per size comes to the driver."""
    entries = sets.select("n", F.explode("keys").alias("key"))
    length = entries.groupBy("key").agg(F.count(F.lit(1)).alias("scanned"))
    small = entries.filter(F.col("n") <= LIGHT_MOST)
    scans = {r["n"]: r["cost"] for r in small.join(length, "key").groupBy("n").agg(F.sum("scanned").alias("cost")).collect()}
    number = {r["n"]: r["count"] for r in sets.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    cost = {b: sum(number.get(n, 0) * subset_count(n, similarity) if n <= b else scans.get(n, 0) for n in range(1, LIGHT_MOST + 1)) for b in range(LIGHT_MOST + 1)}
    return min(cost, key=lambda b: (cost[b], b))


def postings(sets: DataFrame, light: int, similarity: tuple[int, int]) -> DataFrame:
    """(key, rep): a row for each list or subset that a set is in.

    A list is cut by size: linked sets are in the same or in neighbouring classes of sizes,
    so each entry goes to the part of its class and to the next one.
    """
    over, under = similarity
    width = math.log(under / over) * 1.0001 or 1.0
    scanned = -(-over * (light + 1) // under)  # the smallest set that a heavy one can link with

    def run(batches):
        for batch in batches:
            keys, reps = [], []
            columns = (batch.column("rep").to_pylist(), batch.column("n").to_pylist(), views(batch.column("keys")), views(batch.column("tokens")))
            for rep, n, own, tokens in zip(*columns, strict=True):
                size_class = int(math.log(n) / width)
                parts = (own.view(np.uint64) + _MULTIPLIERS[:1] * np.uint64(c) for c in (size_class, size_class + 1))
                found = [mixed(p).view(np.int64) for p in parts] if n >= scanned else []
                if n <= light:
                    found.append(subset_keys(tokens.view(np.uint64), light, similarity).view(np.int64))
                keys += found
                reps += [np.full(len(k), rep) for k in found]
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, none])), pa.array(np.concatenate([*reps, none]))], ["key", "rep"])

    return sets.mapInArrow(run, "key long, rep long")


def merged_cells(cells: DataFrame) -> DataFrame:
    """Gives the members of a cell to the cell of the smallest leader that its own leader is with.

    The sets of a group of near copies are in lists with different smallest members; after
    this most of them are in one cell, once. A pair that was in one cell still is.
    """
    top = cells.groupBy(F.col("rep").alias("leader")).agg(F.min("leader").alias("_top"))
    return cells.join(top, "leader").select(F.col("_top").alias("leader"), "rep").distinct()


def views(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls, as slices of one array."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def linked_in(sets: list[np.ndarray], sides: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """For each set the smallest set it reaches by links; with two sides only links between them count."""
    over, under = similarity
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(values)) > 1
    rank = np.cumsum(often) - 1
    use = often[column]
    row, column = row[use], rank[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    total = int(often.sum())
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, total - start)), dtype=np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += part @ part.T
    links = common.astype(np.int64) * (over + under) >= over * (sizes[:, None] + sizes[None, :])
    if sides.any() and not sides.all():
        links &= sides[:, None] != sides[None, :]
    np.fill_diagonal(links, True)
    label = np.arange(len(sets))
    while True:
        lower = np.where(links, label[None, :], len(sets)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def forest(tiles: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that connect what is linked within each tile; rows come sorted by tile."""

    def solve(rows):
        rows.sort(key=lambda r: r[1])
        label = linked_in([r[2] for r in rows], np.array([r[0] for r in rows], dtype=bool), similarity)
        return [(rows[i][1], rows[k][1]) for i, k in enumerate(label.tolist()) if i != k]

    def run(batches):
        now, rows = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("leader", "low", "high", "side", "rep")]
            for leader, low, high, side, rep, tokens in zip(*columns, views(batch.column("tokens")), strict=True):
                if (leader, low, high) != now:
                    out += solve(rows) if len(rows) > 1 else []
                    now, rows = (leader, low, high), []
                rows.append((side, rep, tokens))
            rows = [(s, r, t.copy()) for s, r, t in rows]
            yield edges(out)
        yield edges(solve(rows) if len(rows) > 1 else [])

    def edges(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def tokens_of(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the wanted documents, and few others that share a cell of the table with one."""

    def names_of(batches):
        for batch in batches:
            yield mixed(batch.column("rep").to_numpy().view(np.uint64))

    counts = sets.sparkSession.sparkContext.broadcast(count_names(wanted, names_of, 2, few=1))

    def run(batches):
        for batch in batches:
            rep = batch.column("rep").fill_null(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(counts.value.of(mixed(rep)) > 0))

    return sets.mapInArrow(run, sets.schema)


def linked_documents(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id with an equal set) of every document."""
    rows = written(shingle_rows(id_and_text(docs), words, similarity), "shingle-rows")
    classes = rows.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    small = F.when(F.col("n") <= LIGHT_MOST, F.col("tokens")).otherwise(F.array().cast("array<long>")).alias("tokens")
    first = rows.filter(F.size("keys") > 0).select("doc_id", "set_id", "n", "keys", small).join(classes, "set_id").filter("doc_id = rep")
    sets = written(first.dropDuplicates(["set_id"]).select("rep", "n", "keys", "tokens"), "sets")

    light = light_border(sets, similarity)
    entries = written(postings(sets, light, similarity), "postings")
    leaders = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members_of = entries.join(leaders, "key").select("leader", "rep").distinct()
    for step in range(MERGES):
        members_of = merged_cells(written(members_of, f"cells-{step}"))
    cells = written(members_of.join(sets.select("rep", "n"), "rep"), "cells")

    size = cells.groupBy("leader").agg(F.count(F.lit(1)).alias("_sets"), F.sum("n").alias("_shingles")).filter("_sets > 1")
    blocks = F.greatest(F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_shingles") / BLOCK_SHINGLES)).cast("int")
    placed = cells.join(size, "leader").select("leader", "rep", blocks.alias("_blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("_block"))
    # A block meets every block, itself only in a cell of one: else its own pairs are decided in each of its tiles.
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    tiles = placed.withColumn("_other", other).select(
        "leader", "rep",
        F.least("_block", "_other").alias("low"), F.greatest("_block", "_other").alias("high"),
        (F.col("_block") > F.col("_other")).alias("side"),
    )
    tokens = tokens_of(rows.filter(F.size("keys") > 0).select(F.col("doc_id").alias("rep"), "tokens"), tiles.select("rep").distinct())
    # A merge join at every size: sets are dealt by document, and skewed ones can be split.
    filled = tiles.join(tokens.hint("merge"), "rep")
    key = ["leader", "low", "high"]
    dealt = filled.repartition(shuffle_partitions(docs), *key).sortWithinPartitions(*key)
    found = connected_components(forest(dealt, similarity))
    members = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "n", "set_id").join(members, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}


def oracle_sql() -> dict[str, str]:
    return {}
