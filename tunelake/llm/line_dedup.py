"""Line deduplication in content-defined chunks, with DataFrame functions only.

A rolling hash over the hashes of the last two lines ends a chunk after about every fourth
line. Ends depend on those lines only, so a passage that moves within a text is cut at the
same places. Chunks of at least two lines whose bytes also occur elsewhere are removed, but
for the first occurrence: in the document with the smallest id, there the first one.

Hashes only find candidates; groups are made of equal bytes. What moves between tasks is the
hash of each chunk, then the bytes of chunks whose hash occurs again. A chunk that very many
documents share is counted before the shuffle. Within a text chunks are sorted and compared
with the one before, so a text of n chunks takes n log n steps.

Null texts count as empty, one empty line. A null id comes after all others. Repeated rows are
one document for the rule, so all copies of the row keep what the first one keeps. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.common import documents
from tunelake.session import written

LEAST_LINES = 2


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(text: Column) -> Column:
    """All chunks of a text in order: pos (first line, from 0), lines, body."""

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, lambda line: F.md5(line.cast("binary")))
        before = F.concat(F.array(F.lit("")), F.slice(hashes, 1, F.size(hashes) - 1))
        closes = F.zip_with(before, hashes, lambda a, b: F.substring(F.md5(F.concat(a, b).cast("binary")), 1, 1) < "4")
        last = F.size(lines) - 1
        marked = F.transform(closes, lambda close, i: F.when(close | (i == last), i))
        return bound(F.filter(marked, lambda i: i.isNotNull()), lambda ends: between(lines, ends))

    def between(lines: Column, ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("pos"), (e - s + 1).alias("lines"), F.array_join(F.slice(lines, s + 1, e - s + 1), "\n").alias("body")))

    return bound(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def chosen(values: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """The sorted elements for which `keep` holds of the element and the one before it (null for the first)."""

    def use(found: Column) -> Column:
        nothing = F.array(F.when(F.lit(False), F.get(found, F.lit(0))))
        before = F.concat(nothing, F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))
        return F.filter(F.zip_with(found, before, lambda x, b: F.when(keep(x, b), x)), lambda x: x.isNotNull())

    return bound(F.sort_array(values), use)


def by_body(found: Column) -> Column:
    """The chunks of several lines as (body, pos), to be sorted: of equal bodies the first one comes first."""
    several = F.filter(found, lambda c: c["lines"] >= LEAST_LINES)
    return F.transform(several, lambda c: F.struct(c["body"].alias("body"), c["pos"].alias("pos")))


def long_chunks(found: Column) -> Column:
    """(body, pos) of chunks of several lines, each body once, where it comes first."""
    return chosen(by_body(found), lambda c, b: b.isNull() | (c["body"] != b["body"]))


def marked(found: Column, key: Callable[[Column], Column], marks: Column) -> Column:
    """Elements and marks as (key, kind, element), to be sorted: a mark, of kind 0, comes right before the elements with its key."""
    elements = F.transform(found, lambda c: F.struct(key(c).alias("key"), F.lit(1).alias("kind"), c.alias("c")))
    none = F.when(F.lit(False), F.get(found, F.lit(0)))
    return F.concat(F.transform(marks, lambda m: F.struct(m.alias("key"), F.lit(0).alias("kind"), none.alias("c"))), elements)


def removed_places(docs: DataFrame) -> DataFrame:
    """(_doc, places): first lines of the chunks, named where they come first, that another document keeps."""
    named = docs.select("doc_id", F.explode(long_chunks(chunks(F.col("text")))).alias("c")).select("doc_id", F.xxhash64("c.body").alias("name"))
    # Two rows may be one document twice, which the comparison of bytes sorts out.
    again = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    hits = named.join(again, "name", "left_semi").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("name").alias("names"))
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")))
    # Of chunks that share a name the second one is looked at without a mark as well; bodies decide later.
    wanted = bound(
        long_chunks(chunks(F.col("text"))),
        lambda cs: chosen(marked(cs, lambda c: F.xxhash64(c["body"]), F.col("names")), lambda x, b: (x["kind"] == 1) & b["key"].eqNullSafe(x["key"])),
    )
    shared = written(joined.select("doc_id", F.explode(wanted).alias("w")).select("doc_id", "w.c.pos", "w.c.body"), "shared-chunks")
    first = shared.groupBy("body").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    gone = shared.join(first, "body").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("pos").alias("places"))


def without_repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines and the text that is left (null where nothing is)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = removed_places(rows)
    joined = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))

    def keep(found: Column) -> Column:
        """Short chunks stay; a long one stays where its body comes first, unless that place is on the list."""
        again = F.transform(chosen(by_body(found), lambda c, b: b["body"].eqNullSafe(c["body"])), lambda c: c["pos"])
        stays = chosen(
            marked(found, lambda c: c["pos"], F.array_union(again, F.col("places"))),
            lambda x, b: (x["kind"] == 1) & ~(b["kind"].eqNullSafe(F.lit(0)) & b["key"].eqNullSafe(x["key"])),
        )
        return F.transform(stays, lambda x: x["c"])

    found = joined.select("doc_id", bound(chunks(F.col("text")), lambda cs: F.struct(cs.alias("all"), keep(cs).alias("kept"))).alias("c"))

    def count(cs: Column) -> Column:
        return F.aggregate(cs, F.lit(0), lambda n, c: n + c["lines"])

    rest = F.when(F.size("c.kept") > 0, F.array_join(F.transform(F.col("c.kept"), lambda c: c["body"]), "\n"))
    n_lines = count(F.col("c.all"))
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), (n_lines - count(F.col("c.kept"))).cast("long").alias("n_removed_lines"), rest.alias("text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeated_chunks(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM documents
), h AS (
  SELECT *, substr(md5(lag(md5(line), 1, '') OVER w || md5(line)), 1, 1) < '4' AS closes FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), n AS (
  SELECT *, coalesce(sum(closes::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM h
), c AS (
  SELECT doc_id, chunk, min(pos) AS pos, count(*) AS lines, string_agg(line, chr(10) ORDER BY pos) AS body FROM n GROUP BY doc_id, chunk
), k AS (
  SELECT *, lines < 2 OR row_number() OVER (PARTITION BY body ORDER BY lines < 2, doc_id, pos) = 1 AS kept FROM c
)
SELECT doc_id, sum(lines)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (NOT kept), 0)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op2_line_dedup": op2_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": SQL}
