"""The knob catalog as plain records, as a table and as column literals."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.constants import KNOB_CATALOG_TEXT, KNOB_RENAMES

CONFIG_SPACE_LINE = r"^(\S+)\s+(integer|real)\s+\[([^,]+),\s*([^\]]+)\]\s+\[([^\]]+)\]$"


class Knob(NamedTuple):
    knob: str
    type: str
    min: float
    max: float
    default: float


def knob_records() -> list[Knob]:
    """The built-in catalog in name order, the order used for feature vectors."""
    rows = [re.match(CONFIG_SPACE_LINE, line).groups() for line in KNOB_CATALOG_TEXT.splitlines()]
    return [Knob(n, t, float(lo), float(hi), float(d)) for n, t, lo, hi, d in rows]


def knob_table(spark: SparkSession) -> DataFrame:
    """The built-in catalog as a constant table of 44 rows."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in k._asdict().items()]) for k in knob_records()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def is_legacy(knob: Column) -> Column:
    return knob.isin(list(KNOB_RENAMES))


def renamed(knob: Column) -> Column:
    """Current name of a knob, mapping the legacy spellings."""
    out = knob
    for old, new in KNOB_RENAMES.items():
        out = F.when(knob == old, F.lit(new)).otherwise(out)
    return out
