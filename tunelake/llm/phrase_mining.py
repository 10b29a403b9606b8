"""Phrase collocations by relational mining of set after set (SETM).

The relation of length k holds every occurrence of a frequent k-word phrase: a place and the
phrase's id, sorted by place. Each word of a text has the next place and each end of a piece
uses up one, so that adjacent places are adjacent words of one piece. A length follows from the
one before in three steps:

* merge-join: occurrences at adjacent places make the occurrences of one more word, named by the
  ids of its first and its last k words;
* group-count: counts of each block are shuffled by phrase and added up;
* semi-join: occurrences of phrases that are frequent enough go into the next relation. No
  phrase is frequent whose parts are not, so all others can be left out.

Relations are written tables of blocks: a block is a few megabytes of text of one language, its
relation packed as arrays. What is shuffled is one row per block and different phrase, not per
occurrence, and a phrase is in a block once, however frequent it is. Words are counted as
strings and phrases by ids that are unique by construction, so counts are exact.

Of longer phrases, those that contain a candidate in one step more decide whether it is dropped:
a phrase between two others is at least as frequent as the longer one.

Null texts have no words, a null language is `und`; repeated rows count again. A piece is not
cut, however long it is; longer texts are cut between pieces. An empty table gives no phrases.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.llm.common import documents, slices_by_bytes, text_bytes
from tunelake.operators.skew import salted_join
from tunelake.session import emptied, tracked, written

LEAST, MOST_WORDS, SHARE, TOP = 10, 3, 50, 2000
# Bytes of text in a block; a task fills several, of different languages, up to OPEN times as much.
# The larger a block, the fewer rows its repeated phrases make in a shuffle.
BLOCK, OPEN = 16 << 20, 2
# A block number is the number of its partition and a count; the id of a phrase is the smallest
# block that has it and its number there, so no two phrases of a length share one.
BLOCKS_EACH, GROUP_BITS = 1 << 15, 27

ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
# Lower case, ends of pieces as line feeds, tabs as spaces.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 10 if ENDS.match(bytes([c])) else 32 if c == 9 else c for c in range(256))
RELATION = "block long, lang string, places binary, groups binary, ids binary"


def packed(values: np.ndarray) -> bytes:
    """An array by byte planes, compressed: the high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pieces_of(text: bytes, most: int) -> Iterator[bytes]:
    """The folded text, in parts of about `most` bytes that end with a piece."""
    folded, start = text.translate(FOLDED), 0
    while len(folded) - start > most:
        end = folded.rfind(b"\n", start, start + most)
        if end < 0:
            end = folded.find(b"\n", start + most)
        if end < 0:
            break
        yield folded[start : end + 1]
        start = end + 1
    yield folded[start:]


class Numbers(dict):
    """Numbers of words from 2 on, in the order they come; 0 ends a piece and 1 is what lies between two spaces."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def word_block(parts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of a block: a number or -1 at each place, the words by number, their counts."""
    numbers = Numbers()
    tokens = b"\n".join(parts).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    found = found[found != 1] - 2
    words = list(numbers)[2:]
    return np.maximum(found, -1), words, np.bincount(found[found >= 0], minlength=len(words))


def word_blocks(docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """The relation of all words as blocks: block, lang, places, words, counts, n."""
    schema = "block long, lang string, places binary, words array<binary>, counts array<long>, n long"
    arrow = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("places", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * BLOCKS_EACH
        parts: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal block
            del held[lang]
            places, words, counts = word_block(parts.pop(lang))
            block += 1
            return pa.RecordBatch.from_pylist([{"block": block - 1, "lang": lang, "places": packed(places), "words": words, "counts": counts, "n": int(counts.sum())}], schema=arrow)

        for batch in slices_by_bytes(batches, most):
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch), strict=True):
                for part in pieces_of(text, most):
                    parts.setdefault(lang, []).append(part)
                    held[lang] = held.get(lang, 0) + len(part) + 1
                    if held[lang] >= most:
                        yield closed(lang)
                    elif sum(held.values()) >= OPEN * most:
                        yield closed(max(held, key=held.__getitem__))
        for lang in list(held):
            yield closed(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def frequent(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(block, number, id) of groups with at least `least` occurrences; where a group has its first block also the keys and the total `f`.

    The blocks of a group meet once, in the order of a shuffle that both the sum and the id use.
    """
    group = Window.partitionBy(*keys)
    summed = counted.withColumn("f", F.sum("n").over(group)).withColumn("id", F.min("name").over(group)).filter(F.col("f") >= least)
    block, number = F.shiftright("name", GROUP_BITS), F.col("name").bitwiseAND(F.lit((1 << GROUP_BITS) - 1))
    about = [F.when(F.col("id") == F.col("name"), F.col(c)).alias(c) for c in (*keys, "f")]
    return summed.select(block.alias("block"), number.cast("int").alias("number"), "id", *about)


def groups_of(found: DataFrame) -> DataFrame:
    """One row per group: the one of its first block."""
    return found.filter(F.col("f").isNotNull()).drop("block", "number")


def kept_groups(found: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """New numbers (-1: not frequent) of the `n` groups of a block, and the ids by new number."""
    numbers = found.column("number").to_numpy().astype(np.int64)
    order = np.argsort(numbers)
    renamed = np.full(n, -1, dtype=np.int32)
    renamed[numbers[order]] = np.arange(len(order), dtype=np.int32)
    return renamed, found.column("id").to_numpy().astype(np.int64)[order]


def relation_row(block: int, lang: str, places: np.ndarray, groups: np.ndarray, ids: np.ndarray) -> pa.Table:
    steps = np.diff(places, prepend=0).astype(np.int32)
    row = {"block": block, "lang": lang, "places": packed(steps), "groups": packed(groups.astype(np.int32)), "ids": packed(ids)}
    return pa.Table.from_pylist([row], schema=pa.schema([("block", pa.int64()), ("lang", pa.string()), ("places", pa.binary()), ("groups", pa.binary()), ("ids", pa.binary())]))


def frequent_words(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """Semi-join of one block: the relation of its frequent words."""
    block = blocks.to_pylist()[0]
    words = unpacked(block["places"], np.int32)
    renamed, ids = kept_groups(found, int(words.max(initial=-1)) + 1)
    groups = np.where(words >= 0, renamed[words] if len(renamed) else -1, -1)
    places = np.flatnonzero(groups >= 0)
    return relation_row(block["block"], block["lang"], places, groups[places], ids)


def joined_places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a relation with itself at the next place: places, number of the pair at each, pairs as codes, ids.

    Pairs are numbered by their codes, which every later look at the relation repeats.
    """
    places = np.cumsum(unpacked(row["places"], np.int32).astype(np.int64))
    groups, ids = unpacked(row["groups"], np.int32).astype(np.int64), unpacked(row["ids"], np.int64)
    meet = np.flatnonzero(np.diff(places) == 1)
    pairs, numbers = np.unique(groups[meet] * len(ids) + groups[meet + 1], return_inverse=True)
    return places[meet], numbers, pairs, ids


def counted_pairs(relation: DataFrame) -> DataFrame:
    """Group-count of each block: (name, left, right, n); the name holds the block and the number in it, left and right are ids."""
    arrow = pa.schema([("name", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, numbers, pairs, ids = joined_places(row)
                counts = np.bincount(numbers, minlength=len(pairs))
                left, right = np.divmod(pairs, max(len(ids), 1))
                for start in range(0, len(pairs), 100_000):
                    cut = slice(start, start + 100_000)
                    names = (row["block"] << GROUP_BITS) + np.arange(start, start + len(pairs[cut]))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids[left[cut]]), pa.array(ids[right[cut]]), pa.array(counts[cut])], schema=arrow)

    return relation.select("block", "places", "groups", "ids").mapInArrow(run, "name long, left long, right long, n long")


def frequent_pairs(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """Semi-join of one block: the relation of one more word."""
    block = blocks.to_pylist()[0]
    places, numbers, pairs, _ = joined_places(block)
    renamed, ids = kept_groups(found, len(pairs))
    groups = renamed[numbers] if len(pairs) else np.empty(0, dtype=np.int32)
    return relation_row(block["block"], block["lang"], places[groups >= 0], groups[groups >= 0], ids)


def semi_joined(blocks: DataFrame, found: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], name: str) -> DataFrame:
    """The relation that `step` leaves of each block, given the block's frequent groups."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return step(left, right)

    wanted = found.select("block", "number", "id").groupBy("block")
    return written(blocks.groupBy("block").cogroup(wanted).applyInArrow(run, RELATION), name)


def scored(phrases: DataFrame, words: int) -> DataFrame:
    """Adds the lowest-scoring cut: l, r and score, in exact arithmetic."""

    def cut(k: int) -> Column:
        first, rest = f"heads[{k - 1}]", f"tails[{words - k - 1}]"
        score = F.expr(f"CAST(1000000 AS DECIMAL(38,0)) * a * a div (CAST({first} AS DECIMAL(38,0)) * {rest})")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(first).alias("l"), F.expr(rest).alias("r"))

    least = F.array_min(F.array(*[cut(k) for k in range(1, words)]))
    return phrases.withColumn("cut", least).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def longer_phrases(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases of the next length with their text and the counts of all their heads and tails.

    A part may begin very many phrases; its rows are spread over salts.
    """
    left = parts.select(F.col("id").alias("left"), "lang", "phrase", F.concat("heads", F.array("a")).alias("heads"))
    right = parts.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("a")).alias("tails"))
    joined = salted_join(groups.withColumnRenamed("f", "a"), left, ["left"], ["right"])
    joined = salted_join(joined, right, ["right"], ["left"])
    return joined.select("id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", "heads", "tails")


def with_more(rows: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if rows is None else rows.unionByName(more)


def not_inside(phrases: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Phrases that no phrase of one word more contains in at least `share` percent of their occurrences. Ids are those of one length."""
    around = longer.select(F.col("left").alias("id"), "a").unionByName(longer.select(F.col("right").alias("id"), "a"))
    most = around.groupBy("id").agg(F.max("a").alias("longer"))
    return phrases.join(most, "id", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")


def phrase_collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, share: int = SHARE, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The best phrases of 2 to `most_words` words of each language: lang, rank, phrase, a, l, r, n, score.

    Tables that the next length does not need are emptied as soon as what follows is written.
    """
    spark = docs.sparkSession
    no_counts = F.array().cast("array<long>")
    with tracked() as used:
        blocks = written(word_blocks(docs, block), "phrase-words")
        name = F.shiftleft("block", GROUP_BITS) + F.col("number")
        each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w")).select(name.alias("name"), "lang", "w.words", F.col("w.counts").alias("n"))
        found = written(frequent(each, ["lang", "words"], least), "phrase-groups")
    word = F.decode("words", "UTF-8")
    parts = written(groups_of(found).select("id", "lang", word.alias("phrase"), word.alias("last"), F.col("f").alias("a"), no_counts.alias("heads"), no_counts.alias("tails")), "phrases")
    sizes = written(blocks.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    with tracked() as relations:
        relation = semi_joined(blocks.select("block", "lang", "places"), found, frequent_words, "phrase-relation")
    emptied(spark, used)
    candidates = None
    for words in range(2, most_words + 1):
        with tracked() as used:
            found = written(frequent(counted_pairs(relation), ["left", "right"], least), "phrase-groups")
        longer = written(longer_phrases(groups_of(found), parts), "phrases")
        if words > 2:
            candidates = with_more(candidates, not_inside(scored(parts, words - 1), longer, share))
        parts, used = longer, used + relations
        if words < most_words:
            with tracked() as relations:
                relation = semi_joined(relation, found, frequent_pairs, "phrase-relation")
        emptied(spark, used)
    kept = with_more(candidates, scored(parts, most_words))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(documents(spark, sf_dir))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, body FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents)
), w AS (
  SELECT piece, lang, unnest(regexp_extract_all(body, '[^\x20\x09]+')) AS w1, generate_subscripts(regexp_extract_all(body, '[^\x20\x09]+'), 1) AS pos FROM pieces
), g AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY piece ORDER BY pos)
), c1 AS (
  SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL
), c2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL
), c3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY ALL
), cuts AS (
  SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, c2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM c2 JOIN c1 x ON x.lang = c2.lang AND x.w1 = c2.w1 JOIN c1 y ON y.lang = c2.lang AND y.w1 = c2.w2
  LEFT JOIN longer o ON o.lang = c2.lang AND o.w1 = c2.w1 AND o.w2 = c2.w2
  WHERE c2.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * c2.f)
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, 1, x.f, y.f
  FROM c3 JOIN c1 x ON x.lang = c3.lang AND x.w1 = c3.w1 JOIN c2 y ON y.lang = c3.lang AND y.w1 = c3.w2 AND y.w2 = c3.w3
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, 2, x.f, y.f
  FROM c3 JOIN c2 x ON x.lang = c3.lang AND x.w1 = c3.w1 AND x.w2 = c3.w2 JOIN c1 y ON y.lang = c3.lang AND y.w1 = c3.w3
), lowest AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest QUALIFY rank <= 2000
)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(f) FROM c1 WHERE c1.lang = ranked.lang)::BIGINT AS n, score FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op11_phrase_collocations": op11_phrase_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocations": SQL}
