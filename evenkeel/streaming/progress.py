"""Remaining-time formulas as column expressions. Times are in seconds unless named _ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PROGRESS = 1e-5


def generic(elapsed: Column, progress: Column) -> Column:
    return elapsed / F.greatest(F.lit(LEAST_PROGRESS), progress) - elapsed


def time_per_byte(elapsed_ms: Column, processed: Column) -> Column:
    """Seconds a byte; nothing before anything is processed."""
    return F.coalesce(F.nanvl(F.try_divide(elapsed_ms.cast("double"), processed.cast("double")), F.lit(0.0)) * 0.001, F.lit(0.0))


def sort_estimate(spills: Column, factor: int, spill_seconds: Column, output_bytes: Column, per_byte: Column) -> Column:
    """Final merge of a map: what the spills took, once more for each pass that the merge factor needs; by rate without spills."""
    passes = F.when(spills > factor, 2.0).otherwise(1.0)
    return F.when(spills > 0, spill_seconds * passes).otherwise(output_bytes * per_byte)


def map_phase(per_byte: Column, remaining_bytes: Column, sort_seconds: Column) -> Column:
    return per_byte * remaining_bytes + sort_seconds


def shuffle_phase(elapsed: Column, progress: Column) -> Column:
    """Sort and reduce are taken to last as long as the shuffle each."""
    left = generic(elapsed, progress)
    return left + 2 * (elapsed + left)


def sort_phase(elapsed: Column, progress: Column) -> Column:
    left = generic(elapsed, progress)
    return left + (elapsed + left)


def reduce_phase(elapsed: Column, total: Column, read: Column, processed: Column) -> Column:
    return F.coalesce(F.try_divide((total - read).cast("double"), processed.cast("double")) * elapsed, F.lit(0.0))


def remaining_now(remain_ms: Column, reported_at_ms: Column, now_ms: Column) -> Column:
    """What a report's estimate is worth by now; nothing if it was nothing."""
    return F.when(remain_ms == 0, 0.0).otherwise((remain_ms - (now_ms - reported_at_ms)) * 0.001)


def by_phase(phase: Column, elapsed: Column, progress: Column) -> Column:
    return F.when(phase == "SHUFFLE", shuffle_phase(elapsed, progress)).when(phase == "SORT", sort_phase(elapsed, progress)).otherwise(generic(elapsed, progress))


def cost_deltas(df: DataFrame, task: list[str], order: list[str], counters: list[str], groups: str) -> DataFrame:
    """Differences since a task's last report; none for reports without a new key group."""
    w = Window.partitionBy(*task).orderBy(*order)
    diff = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    return df.select("*", *[diff(c).alias(f"d_{c}") for c in [*counters, groups]]).where(F.col(f"d_{groups}") > 0)


def phase_weighted(progress: Column, elapsed: Column, phases_left: Column) -> Column:
    """A phase's remaining seconds at its rate so far, and for each later phase as long as this one will have taken."""
    rate = progress / F.greatest(elapsed, F.lit(0.001))
    left = F.greatest(1 - progress, F.lit(1e-4)) / F.greatest(rate, F.lit(1e-9))
    return left + (elapsed + left) * phases_left
