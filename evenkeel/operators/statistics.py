"""Exact key statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import materialized


def key_histogram(df: DataFrame, keys: list[str], rec_bytes: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.sum(rec_bytes).cast("long").alias("bytes"))


def less_than_key(histogram: DataFrame, key: str, slices: int | None = None) -> DataFrame:
    """For each key the keys, records and bytes below it.

    Keys are cut into ranges; running sums within a range take the sums of the
    ranges before it, of which there is one row each. No task sees all keys.
    """
    n = slices or int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both uses must see the same ranges, and these are drawn from a sample
    ranged = materialized(histogram.repartitionByRange(n, key).withColumn("_slice", F.spark_partition_id()))
    sums = ranged.groupBy("_slice").agg(F.count(F.lit(1)).alias("k"), F.sum("records").alias("r"), F.sum("bytes").alias("b"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = sums.select("_slice", zero("k").alias("_k"), zero("r").alias("_r"), zero("b").alias("_b"))
    w = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    joined = ranged.join(F.broadcast(bases), "_slice")
    return joined.select(key, "records", "bytes", (F.col("_k") + inner(F.lit(1))).cast("long").alias("lt_keys"), (F.col("_r") + inner("records")).cast("long").alias("lt_records"), (F.col("_b") + inner("bytes")).cast("long").alias("lt_bytes"))


def byte_buckets(histogram: DataFrame, key: str, target: int) -> DataFrame:
    """Keys in order, cut where the running bytes pass each multiple of target."""
    below = less_than_key(histogram, key)
    bucket = F.floor((F.col("lt_bytes") + F.col("bytes") - 1) / F.lit(target)).cast("long")
    return below.groupBy(bucket.alias("bucket")).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("num_keys"), F.sum("records").cast("long").alias("num_recs"), F.sum("bytes").cast("long").alias("tot_bytes"))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Equal (begin, end) from several runs: records and bytes add up, distinct middle keys are the largest count."""
    return intervals.groupBy("begin", "end").agg(*[F.sum(c).cast("long").alias(c) for c in ("begin_recs", "begin_bytes", "mid_recs", "mid_bytes", "end_recs", "end_bytes")], F.max("mid_keys").cast("long").alias("mid_keys"))


def merge_less_than(summaries: DataFrame, key: str, lt_keys: str = "max") -> DataFrame:
    """Less-than-key summaries of several runs as one: what lies below a key adds up.

    Distinct keys below can't be told from the runs' counts: the largest is a lower bound, the sum an upper one.
    """
    distinct = {"max": F.max, "sum": F.sum}[lt_keys]("lt_keys")
    return summaries.groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in ("records", "bytes", "lt_records", "lt_bytes")], distinct.cast("long").alias("lt_keys"))


def sampled_key_counts(df: DataFrame, key: str, kept: Column) -> DataFrame:
    """Rows that pass a Bernoulli test, counted by key; the test decides before the shuffle."""
    return df.where(kept).groupBy(key).agg(F.count(F.lit(1)).alias("sampled"))


def bernoulli(column: Column, seed: int, per_mille: int) -> Column:
    """A repeatable test of a whole number that some per mille of the numbers pass: a linear congruence of the number and the seed."""
    return F.pmod(F.pmod(column, F.lit(1_000_003)) * F.lit(48_271) + F.lit(seed), F.lit(1_000_003)) % 1000 < per_mille
