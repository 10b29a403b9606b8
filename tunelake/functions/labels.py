"""Bucket labels in their three spellings, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake.constants import N_BUCKETS, SCALE_WORDS

RANGE = "range"      # 0-10% ... 90-100%
PADDED = "padded"    # 00% to 10% ... 90% to 100%
WORDS = "words"      # extremely low ... extremyly high

def labels_of(style: str) -> list[str]:
    """The labels of a spelling, in scale order."""
    lows = [i * 100 // N_BUCKETS for i in range(N_BUCKETS)]
    step = 100 // N_BUCKETS
    if style == RANGE:
        return [f"{low}-{low + step}%" for low in lows]
    if style == PADDED:
        return [f"{low:02d}% to {low + step}%" for low in lows]
    if style == WORDS:
        return SCALE_WORDS
    raise ValueError(f"unknown label style {style!r}")


def _scale(style: str) -> Column:
    return F.array(*[F.lit(text) for text in labels_of(style)])


def bucket_label(decile: Column, style: str = RANGE) -> Column:
    """Text of a decile; a decile outside the scale has no label."""
    return F.get(_scale(style), decile)


def _place(scale: Column, label: Column) -> Column:
    return F.nullif(F.array_position(scale, label), F.lit(0)) - 1


def range_bucket(label: Column) -> Column:
    """Decile of a plain range label, or null."""
    return _place(_scale(RANGE), label).cast("int")


def label_bucket(label: Column) -> Column:
    """Decile of a label in either range spelling; null for anything else."""
    return F.coalesce(range_bucket(label), _place(_scale(PADDED), label).cast("int"))


def word_bucket(label: Column) -> Column:
    """Position of a label on the nine-word scale, or null."""
    return _place(_scale(WORDS), label).cast("int")
