"""From raw documents to packed sequences: the stages of the corpus pipeline.

All stages but the last take and return the columns of `documents`, in any number of further
columns. A null text counts as empty; an empty table runs through all stages. A stage frees its
own tables before it returns, but for the narrow ones that its result reads; it touches nothing
of another stage or run, so results may be read late and more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.best_fit_packing import pack
from tunelake.llm.common import documents
from tunelake.llm.crf_language_id import UNDETERMINED, with_language
from tunelake.llm.exact_dedup import drop_exact_copies
from tunelake.llm.ngram_jaccard_join import linked_documents
from tunelake.llm.suffix_dedup import strip_repeats
from tunelake.session import emptied, tracked, written

# A document needs one language with this share of its words; text without letters has none.
LEAST_SHARE = 0.4
NEAR_WORDS, NEAR_SIMILARITY = 5, (80, 100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go."""
    found = with_language(docs, docs).toDF(*docs.columns, "_pred", "_share")
    return found.filter((F.col("_pred") != UNDETERMINED) & (F.col("_share") >= LEAST_SHARE)).drop("_pred", "_share")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_exact_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    The ids that go are written, and what the join has written is freed before the stage returns.
    """
    with tracked() as used:
        groups = linked_documents(docs, NEAR_WORDS, NEAR_SIMILARITY)
    gone = written(groups.filter("component_id <> doc_id").select("doc_id"), "near-duplicates")
    emptied(spark, used)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out; what has nothing left goes."""
    return strip_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as pieces of training sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

# The first stage trains a model and the last one reads a tokenizer, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again before the next stage."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
