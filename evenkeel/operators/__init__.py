"""Map, combine, partition, sort, group and reduce as DataFrame operations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_range(key: Column, low=None, high=None) -> Column:
    """low < key <= high; a bound that is None is open. Null keys lie in no range."""
    test = key.isNotNull()
    if low is not None:
        test = test & (key > F.lit(low))
    if high is not None:
        test = test & (key <= F.lit(high))
    return test


def kept_and_skipped(df: DataFrame, test: Column) -> DataFrame:
    return df.agg(F.count_if(test).alias("kept"), F.count_if(~F.coalesce(test, F.lit(False))).alias("skipped"))


@dataclass(frozen=True)
class Options:
    """How a job may be handled: whether maps and reduces are planned by skew, in how many parts, and by which strategy."""

    map_skew: bool = True
    reduce_skew: bool = True
    strategy: str = "LINEAR"
    parts: int = 4
    split_all: bool = False


class Submitted:
    """A job that runs beside the caller; it can be waited for and killed."""

    def __init__(self, future: Future, spark, tag: str):
        self.future, self.spark, self.tag = future, spark, tag

    def result(self, timeout: float | None = None):
        return self.future.result(timeout)

    def kill(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


@dataclass
class Job:
    """A map / combine / partition / sort / group / reduce job, declared.

    mapper: columns or a DataFrame function. group: columns that make a group.
    sort: finer order within a group. combine and reduce: algebraic aggregates,
    which Catalyst computes partially before the shuffle. reducer: an arbitrary
    function of a sorted group as a pandas frame, for what aggregates can't say;
    a group must then fit into a task's memory.
    """

    group: list[str]
    mapper: Callable[[DataFrame], DataFrame] = lambda df: df
    sort: list[str] = field(default_factory=list)
    reduce: list[Column] = field(default_factory=list)
    reducer: Callable | None = None
    reducer_schema: str = ""
    partition: Column | None = None
    partitions: int | None = None
    options: Options = Options()

    def submit(self, df: DataFrame, action: Callable[[DataFrame], object]) -> Submitted:
        """Run the job in a thread of its own; `action` says what becomes of its result."""
        spark, tag = df.sparkSession, f"evenkeel-{uuid.uuid4().hex}"

        def work():
            spark.sparkContext.addJobTag(tag)
            return action(self.run(df))

        pool = ThreadPoolExecutor(1)
        future = pool.submit(work)
        pool.shutdown(wait=False)
        return Submitted(future, spark, tag)

    def split(self, df: DataFrame, rec_bytes: Column, parts: int | None = None) -> DataFrame:
        """Run a job with one group column in `parts` planned ranges, whether it is skewed or not."""
        from ..plans.reactive import aggregate

        (key,) = self.group
        return aggregate(self.mapper(df), key, self.reduce, rec_bytes, [0.0] * (parts or self.options.parts), self.options.strategy)

    def run(self, df: DataFrame) -> DataFrame:
        rows = self.mapper(df)
        if self.partition is not None:
            from .partitioners import place

            rows = place(rows, self.partition, self.partitions)
            # the id is a function of the key: grouping by both keeps the placement and the groups
            group = ["pid", *self.group]
        else:
            group = self.group
        if self.reducer is not None:
            sort, reducer = self.sort, self.reducer

            def each(pdf):
                return reducer(pdf.sort_values(sort, kind="stable") if sort else pdf)

            return rows.groupBy(*self.group).applyInPandas(each, self.reducer_schema)
        return rows.groupBy(*group).agg(*self.reduce).drop("pid")


def combined(df: DataFrame, group: list[str], salts: int, salt_by: Column, partial: list[Column], final: list[Column]) -> DataFrame:
    """Aggregate in two shuffles, first by group and salt: a hot group's rows meet in `salts` tasks, not one."""
    first = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts))).groupBy(*group, "_salt").agg(*partial)
    return first.groupBy(*group).agg(*final)


def secondary_sorted(df: DataFrame, group: list[str], order: list[Column], columns: list[str], n: int | None = None) -> DataFrame:
    """Rows placed by group and sorted within it, ready to stream in the finer order."""
    dealt = df.repartition(n, *group) if n else df.repartition(*group)
    return dealt.sortWithinPartitions(*group, *order).select(*columns)


def first_and_last(df: DataFrame, group: list[str], order: Column, value: str) -> DataFrame:
    """First and last value of each group in a total order; no group is gathered."""
    return df.groupBy(*group).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count(F.lit(1)).alias("n"))


def consecutive_groups(df: DataFrame, stream: list[str], order: list[str], key: str) -> DataFrame:
    """Runs of equal consecutive keys in a sorted stream: a key that comes back makes a new group."""
    w = Window.partitionBy(*stream).orderBy(*order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w))) | (F.row_number().over(w) == 1)
    return df.withColumn("run", F.sum(changed.cast("long")).over(w))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Spark filters each task's rows by rank before the shuffle (window group limit), so a hot group sends k rows a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sorted_by_partition(df: DataFrame, pid: Column, order: list[Column | str]) -> DataFrame:
    """What a map task hands over: rows by the partition that `pid` names, sorted within it, with their `place` there, from 0.

    A partition may go through several tasks, in ranges that follow each other, so that none sorts all of it. Of a part of
    the rows too: with the same `pid` the parts fit together.
    """
    from ..sources import materialized
    from .partitioners import ranged

    # both uses must see the same ranges, and these are drawn from a sample
    rows = materialized(ranged(df.withColumn("pid", pid.cast("int")), ["pid", *order]))
    rows = rows.withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    runs = rows.groupBy("_slice", "pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("pid").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition and range it goes through; null is a partition too
    bases = runs.select(F.col("_slice").alias("_s"), F.col("pid").alias("_p"), (before - F.col("_first")).alias("_base"))
    joined = rows.join(F.broadcast(bases), (F.col("_slice") == F.col("_s")) & F.col("pid").eqNullSafe(F.col("_p")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != "pid"], "pid", (F.col("_base") + F.col("_at")).cast("long").alias("place"))


def cogrouped(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A reduce-side join's input: both sides in one stream with a tag, sorted by key and tag (an extension)."""
    tagged = left.withColumn("tag", F.lit(0)).unionByName(right.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    return tagged.repartition(*key).sortWithinPartitions(*key, "tag")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, salt_by: Column, how: str = "inner") -> DataFrame:
    """An equi-join that spreads each key of the left side over `salts` tasks (an extension). The right side is repeated `salts` times."""
    many = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    few = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(few, [key, "_salt"], how).drop("_salt")
