"""Numeric column builders: scaling, buckets, unit changes and signs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake.constants import BLOCK_BYTES, N_BUCKETS, NO_VALID_COST


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def normalize_clip(value: Column, lo, hi) -> Column:
    """Min-max position clipped to [0, 1]; a flat range gives 0.0, an absent value or limit null."""
    lo, hi = _col(lo), _col(hi)
    clipped = F.least(F.greatest(value, lo), hi)
    position = F.when(hi == lo, F.lit(0.0)).otherwise((clipped - lo) / (hi - lo))
    return F.when(value.isNotNull() & lo.isNotNull() & hi.isNotNull(), position)


def normalize_raw(value: Column, lo, hi) -> Column:
    """Unclipped min-max position; a flat range gives null (the knob is dropped)."""
    lo, hi = _col(lo), _col(hi)
    return F.when(hi != lo, (value - lo) / (hi - lo))


def bucket(position: Column) -> Column:
    """Decile 0..9 of a position in [0, 1] by its percent; the upper edge belongs to the last."""
    decile = F.floor(position * 100 / 10).cast("int")
    return F.when(position.isNotNull(), F.least(decile, F.lit(N_BUCKETS - 1)))


def bucket_by_threshold(position: str) -> Column:
    """Decile 0..9 of a position column by comparing with the edges 0.1, 0.2, ..., 0.9.

    Differs from `bucket` for the doubles right below some edges, whose percent rounds
    up to the edge. Takes a column name: a computed position is compared nine times.
    """
    return F.expr(threshold_case(position, [str(i) for i in range(N_BUCKETS)]))


def threshold_case(position: str, results: Sequence[str]) -> str:
    """SQL text of the decile comparison of a column with one result per decile; null stays null."""
    edges = [i / N_BUCKETS for i in range(1, N_BUCKETS)]
    whens = " ".join(f"WHEN {position} < {e!r}D THEN {r}" for e, r in zip(edges, results))
    return f"CASE {whens} WHEN {position} IS NOT NULL THEN {results[-1]} END"


def clip_text(value: str, lo: float, hi: float) -> str:
    """SQL text of `normalize_clip` for a column with constant limits."""
    if hi == lo:
        return f"if({value} IS NULL, NULL, 0.0D)"
    clipped = f"least(greatest(cast({value} AS double), {lo!r}D), {hi!r}D)"
    return f"if({value} IS NULL, NULL, ({clipped} - {lo!r}D) / {hi - lo!r}D)"


def decode_bucket(decile: Column, lo: Column, hi: Column, default: Column, kind: Column) -> Column:
    """Middle of a decile on the knob's range; flat ranges give the default."""
    width = (hi - lo) / N_BUCKETS
    middle = width * decile + width / 2 + lo
    return F.when(width == 0, default).otherwise(typed_value(middle, kind))


def typed_value(value: Column, kind: Column) -> Column:
    """Integer knobs truncate toward zero, real knobs keep their value."""
    return F.when(kind == "integer", value.cast("long").cast("double")).otherwise(value)


def blocks_to_bytes(blocks: Column) -> Column:
    return blocks * F.lit(BLOCK_BYTES)


def capped_cost(cost: Column, worst_valid: Column) -> Column:
    """Cost of a failed run (>= 0) replaced by the worst valid cost of its workload."""
    return F.when(cost >= 0, F.coalesce(worst_valid, F.lit(NO_VALID_COST))).otherwise(cost)


def throughput(cost: Column) -> Column:
    return -cost


def inverse_or_zero(value: Column) -> Column:
    return F.when(value != 0, F.lit(1.0) / value).otherwise(F.lit(0.0))


def cost_to_y(cost: Column) -> Column:
    """[throughput, 1 / throughput]."""
    t = throughput(cost)
    return F.array(t, inverse_or_zero(t))


def negative_cost(predicted: Column) -> Column:
    """Costs are negative throughputs; a positive prediction changes sign."""
    return F.when(predicted > 0, -predicted).otherwise(predicted)


def denormalize(position: Column, lo: Column, hi: Column) -> Column:
    return position * (hi - lo) + lo


def improvement_pct(new: Column, base: Column) -> Column:
    """Percent change against a base; no base, no answer."""
    return F.when(base != 0, (new - base) / base * 100)


def abs_qps(qps: Column) -> Column:
    return F.abs(qps)


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is null, not an error, for an empty denominator."""
    return F.when(den != 0, num / den)
