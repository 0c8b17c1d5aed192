"""Statistics, plan, placement and aggregation as one query, and resumption at a key.

A running Spark task can't be stopped and handed over. What the engine does
instead: it measures how bytes are spread over keys before the heavy stage, plans
ranges for the free slots, places each range in its own partition and aggregates
there; and a stage that was cut off at a key is resumed behind that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import key_range
from ..operators.intervals import Interval, KeyPartition, align, sample_keys
from ..operators.partitioners import inverse, place, range_id
from ..operators.statistics import key_histogram
from ..sources import output_name
from .cost import LinearCost
from .planner import Part, Plan, plan

SAMPLES_PER_SLOT = 10


def key_partitions(df: DataFrame, key: str, rec_bytes: Column, slots: int) -> list[KeyPartition]:
    """Disjoint key partitions in key order: some for each slot and task, however many keys there are."""
    histogram = key_histogram(df.where(F.col(key).isNotNull()), [key], rec_bytes)
    total = histogram.agg(F.sum("bytes")).first()[0] or 0
    target = max(1, -(-int(total) // (slots * SAMPLES_PER_SLOT)))
    rows = sample_keys(histogram, key, target, start=max(1, min(8192, target // 4))).collect()
    return align([Interval(*row) for row in rows])


def bounds_of(parts: list[KeyPartition], made: Plan) -> tuple[list, set[int]]:
    """The first key of every range but the first; excluded where the key belongs to the range before."""
    starts = [parts[r.start] for r in made.ranges[1:]]
    return [p.min_key for p in starts], {i for i, p in enumerate(starts) if p.min_excl}


def placed(df: DataFrame, key: str, rec_bytes: Column, available: list[float], strategy: str = "LINEAR", per_byte: float | None = None, model: LinearCost | None = None) -> tuple[DataFrame, Plan]:
    """df with a `pid` column, each range of the plan in a partition of its own, longest first."""
    parts = key_partitions(df, key, rec_bytes, len(available))
    made = plan([Part(p.tot_bytes, p.num_recs) for p in parts], available, strategy, per_byte, model)
    if made.prime is not None:
        raise ValueError(f"{strategy} places by hash; use operators.partitioners")
    n = max(1, len(made.ranges))
    bounds, exclude = bounds_of(parts, made) if made.ranges else ([], set())
    pid = F.coalesce(range_id(F.col(key), bounds, exclude, inverse(made.order) or [0]), F.lit(n - 1))
    return place(df, pid, n), made


def aggregate(df: DataFrame, key: str, aggregates: list[Column], rec_bytes: Column, available: list[float], strategy: str = "LINEAR") -> DataFrame:
    """groupBy(key).agg(...) under a plan. Grouping by pid and key keeps the placement, so the rows move once."""
    rows, _ = placed(df, key, rec_bytes, available, strategy)
    return rows.groupBy("pid", key).agg(*aggregates).drop("pid")


SKEWED = 2.0


def is_skewed(df: DataFrame, key: str, rec_bytes: Column, slots: int, factor: float = SKEWED) -> bool:
    """Whether plain hashing of the key would give one of `slots` tasks over `factor` times its share of the bytes: one partial aggregation."""
    sums = df.where(F.col(key).isNotNull()).groupBy(F.pmod(F.hash(key), F.lit(slots)).alias("pid")).agg(F.sum(rec_bytes).alias("b"))
    row = sums.agg(F.max("b").alias("most"), F.sum("b").alias("all")).first()
    return bool(row["all"]) and row["most"] * slots > factor * row["all"]


def aggregate_if_skewed(df: DataFrame, key: str, aggregates: list[Column], rec_bytes: Column, available: list[float], strategy: str = "LINEAR") -> DataFrame:
    """The same, but planned only where hashing would be uneven; else the plain aggregation, which costs no statistics pass."""
    if is_skewed(df, key, rec_bytes, len(available)):
        return aggregate(df, key, aggregates, rec_bytes, available, strategy)
    return df.groupBy(key).agg(*aggregates)


def split_again(parts: list[Part], available: list[float], per_byte: float, longest: float, strategy: str = "LONGEST2", depth: int = 3) -> list[tuple[str, int, int]]:
    """Name, first and last partition of each range of a plan; a range over `longest` seconds is planned again, as a reactive job of its own."""

    def down(low: int, high: int, name: tuple[int, ...], left: int) -> list[tuple[str, int, int]]:
        made = plan(parts[low:high], available, strategy, per_byte)
        out = []
        for i, r in enumerate(made.ranges):
            own = (*name, i)
            if left and r.time > longest and 1 < r.end - r.start and len(made.ranges) > 1:
                out += down(low + r.start, low + r.end, own, left - 1)
            else:
                out.append((output_name("reduce", *own), low + r.start, low + r.end))
        return out

    return down(0, len(parts), (), depth)


def aggregate_split_again(df: DataFrame, key: str, aggregates: list[Column], rec_bytes: Column, available: list[float], longest_bytes: int) -> DataFrame:
    """groupBy(key).agg(...) where ranges over `longest_bytes` are split again, with the `output` that each key's range is named by."""
    parts = key_partitions(df, key, rec_bytes, 4 * len(available))
    named = split_again([Part(p.tot_bytes, p.num_recs) for p in parts], available, 1.0, float(longest_bytes)) or [(output_name("reduce", 0), 0, 0)]
    bounds, exclude = [parts[low].min_key for _, low, _ in named[1:]], {i for i, (_, low, _) in enumerate(named[1:]) if parts[low].min_excl}
    rows = place(df, F.coalesce(range_id(F.col(key), bounds, exclude), F.lit(0)), len(named))
    output = F.element_at(F.array(*[F.lit(n) for n, _, _ in named]), F.col("pid") + 1)
    return rows.groupBy("pid", key).agg(*aggregates).withColumn("output", output).drop("pid")


def resumed_or_redone(done: DataFrame, df: DataFrame, key: str, last_key, aggregates: list[Column]) -> DataFrame:
    """`resumed`, or, where a task stopped without saying how far it came, the whole task again; what it wrote is left out."""
    return df.groupBy(key).agg(*aggregates) if last_key is None else resumed(done, df, key, last_key, aggregates)


def resumed(done: DataFrame, df: DataFrame, key: str, last_key, aggregates: list[Column]) -> DataFrame:
    """Results up to and with last_key, joined by the aggregation of what lies behind it."""
    return done.unionByName(df.where(key_range(F.col(key), last_key)).groupBy(key).agg(*aggregates))
