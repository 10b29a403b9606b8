"""Stages and runs leave alone what others read."""

import corpus_pipeline
from tunelake.llm.common import documents


def as_set(df):
    return sorted(map(str, df.collect()))


def test_results_are_read_late_and_again(spark, sf_dir):
    first = corpus_pipeline.run(spark, sf_dir)
    early = as_set(first)
    steps = dict(corpus_pipeline.STAGES)
    docs = documents(spark, sf_dir)
    lazy = [steps[n](spark, docs, sf_dir) for n in ("suffix_array_dedup", "ngram_jaccard_join", "exact_dedup", "language_id")]
    second = corpus_pipeline.run(spark, sf_dir)
    assert early and as_set(first) == early == as_set(second)
    again = [as_set(steps[n](spark, docs, sf_dir)) for n in ("suffix_array_dedup", "ngram_jaccard_join", "exact_dedup", "language_id")]
    assert [as_set(df) for df in lazy] == again
