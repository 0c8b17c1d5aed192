"""Samplers and split points. A total order must be given for a sample to be repeatable."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import materialized


def split_sample(df: DataFrame, split: Column, order: list[str], samples: int, splits: int) -> DataFrame:
    """The first samples / taken rows of evenly spaced splits, of at most `splits` of them."""
    rows = df.withColumn("_split", split)
    w = Window.partitionBy("_split").orderBy(*order)
    count = rows.select("_split").distinct().count()
    taken = min(max(1, splits), count) if count else 1
    every = max(1, count // taken)
    places = rows.select("_split").distinct().withColumn("_at", F.row_number().over(Window.orderBy("_split")) - 1)
    chosen = places.where((F.col("_at") % every == 0) & (F.col("_at") < taken * every)).select("_split")
    return rows.join(chosen, "_split").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, samples // taken)).drop("_split", "_n")


class Reservoir:
    """A sample of at most n items by a falling rate.

    An item is chosen while its random number is at most the rate. Beyond n items a chosen one replaces a random one,
    and the rate falls by (n - 1) / n, since those in the sample may be pushed out.
    """

    def __init__(self, rate: float, n: int):
        self.rate, self.n, self.items = rate, n, []

    def offer(self, item, chance: float, place: int) -> None:
        """chance in [0, 1); place is a random number below n."""
        if chance > self.rate:
            return
        if len(self.items) < self.n:
            self.items.append(item)
        else:
            self.items[place] = item
            self.rate *= (self.n - 1) / self.n


def random_sample(df: DataFrame, key: str, split: Column, chance: Column, place: Column, order: list[str], rate: float, n: int, splits: int) -> DataFrame:
    """A reservoir over shuffled splits: (split, key) of the sampled rows.

    Splits are taken in the order of a hash, `splits` of them, and further ones only until n rows would be chosen. Rows
    that the first rate leaves out never leave their tasks; the reservoir sees the others in order, in one task, as its
    rate depends on all that came before. chance in [0, 1) and place below n are the rows' random numbers.
    """
    rows = df.select(split.alias("split"), F.col(key), chance.cast("double").alias("chance"), place.cast("int").alias("place"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]).where(F.col("chance") <= rate)
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("chosen")).withColumn("turn", F.row_number().over(Window.orderBy(F.pmod(F.col("split") * 7_919, F.lit(104_729)), "split")))
    before = F.coalesce(F.sum("chosen").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = counts.withColumn("before", before).where((F.col("turn") <= splits) | (F.col("before") < n)).select("split", "turn")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        held = Reservoir(rate, n)
        for pdf in batches:
            for s, k, c, p in zip(pdf["split"], pdf[key], pdf["chance"], pdf["place"]):
                held.offer((s, k), c, p)
        yield pd.DataFrame(held.items, columns=["split", key])

    dealt = rows.join(F.broadcast(taken), "split").repartition(1).sortWithinPartitions("turn", *[f"_o{i}" for i in range(len(order))])
    return dealt.select("split", key, "chance", "place").mapInPandas(run, f"split long, {key} {kind}")


def interval_kept(i: Column, numerator: int, denominator: int) -> Column:
    """Whether the i-th row (from 1) is kept at the rational rate numerator / denominator."""
    up = lambda x: F.floor((x * numerator + denominator - 1) / F.lit(denominator))
    return up(i) > up(i - 1)


def interval_sample(df: DataFrame, split: list[str], order: list[str], numerator: int, denominator: int) -> DataFrame:
    """Rows of each split at even distances: kept / seen never falls below the rate."""
    w = Window.partitionBy(*split).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w).cast("long")).where(interval_kept(F.col("_i"), numerator, denominator)).drop("_i")


def split_points(samples: list, n: int) -> list:
    """n - 1 ascending points that cut sorted samples evenly, stepping past repeats of the point before."""
    if len(samples) < n:
        raise ValueError("fewer samples than partitions")
    ordered, points, last = sorted(samples), [], -1
    step = len(ordered) / n
    for i in range(1, n):
        at = max(math.floor(step * i + 0.5), last + 1)
        while last >= 0 and at < len(ordered) and ordered[at] == ordered[last]:
            at += 1
        if at >= len(ordered):
            break
        points.append(ordered[at])
        last = at
    return points


def split_points_of(df: DataFrame, column: str, n: int) -> list:
    """`split_points` over all rows of `column` that aren't null: no task sees all values, the driver at most n * n."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    slices = materialized(values.repartitionByRange("value").withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = slices.groupBy("slice").agg(F.sum("count").alias("rows"), F.count(F.lit(1)).alias("values"))
    base = sums.select("slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "values")])
    w = Window.partitionBy("slice").orderBy("value")
    ranked = slices.join(F.broadcast(base), "slice").select("value", (F.col("rows_before") + F.sum("count").over(w)).alias("end"), "count", (F.col("values_before") + F.row_number().over(w)).alias("nth"))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    if total < n:
        raise ValueError("fewer samples than partitions")
    targets = [min(math.floor(total / n * i + 0.5), total) for i in range(1, n)]
    holds = lambda at: (F.col("end") - F.col("count") <= at) & (F.col("end") > at)
    places = {at: None for at in targets}
    for r in ranked.where(F.exists(F.array(*[F.lit(at).cast("long") for at in targets]), holds)).collect():
        places |= {at: r["nth"] for at in places if r["end"] - r["count"] <= at < r["end"]}
    # a point that would repeat the one before is the next value; at most n - 1 steps from a target's own value
    wanted = sorted({k + i for k in places.values() if k is not None for i in range(n)})
    by_place = {r["nth"]: r["value"] for r in ranked.where(F.col("nth").isin(wanted)).select("nth", "value").collect()}
    points, last = [], 0
    for at in targets:
        last = max(places[at] or last + 1, last + 1)
        if last not in by_place:
            break
        points.append(by_place[last])
    return points
