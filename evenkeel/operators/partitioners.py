"""Partition ids as column expressions, and exact placement by them."""

from __future__ import annotations

import base64
import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inverse(order: list[int]) -> list[int]:
    """A schedule lists partitions in the order of their start; a partition's task id is its place in it."""
    out = [0] * len(order)
    for place_, partition in enumerate(order):
        out[partition] = place_
    return out


def _mapped(index: Column, mapping: list[int] | None) -> Column:
    return index if mapping is None else F.element_at(F.array(*[F.lit(int(m)) for m in mapping]), index + 1)


#: More bounds than this are looked up by halves.
SCANNED = 12


def range_id(key: Column, bounds: list, exclude: set[int] | frozenset[int] = frozenset(), mapping: list[int] | None = None) -> Column:
    """The place of key among ascending bounds; an equal key goes right of its bound unless the bound is excluded."""
    right = lambda i: key > F.lit(bounds[i]) if i in exclude else key >= F.lit(bounds[i])

    def among(low: int, high: int) -> Column:
        """The place of a key that lies right of bound low - 1 and left of bound high."""
        if high - low <= SCANNED:
            out = F.lit(low)
            for i in range(low, high):
                out = out + right(i).cast("int")
            return out
        middle = (low + high) // 2
        return F.when(right(middle), among(middle + 1, high)).otherwise(among(low, middle))

    index = F.when(key.isNull(), 0).otherwise(among(0, len(bounds)))
    return _mapped(index.cast("int"), mapping)


def encoded_buckets(bounds: list[bytes], exclude: set[int], mapping: list[int]) -> str:
    """Range buckets as text for a job's configuration."""
    held = {"bounds": [base64.b64encode(b).decode() for b in bounds], "exclude": sorted(exclude), "mapping": mapping}
    return base64.b64encode(json.dumps(held).encode()).decode()


def decoded_buckets(text: str) -> tuple[list[bytes], set[int], list[int]]:
    held = json.loads(base64.b64decode(text))
    return [base64.b64decode(b) for b in held["bounds"]], set(held["exclude"]), held["mapping"]


def range_index(key, bounds: list, exclude: set[int] | frozenset[int] = frozenset()) -> int:
    """The same on the driver."""
    place_ = bisect_right(bounds, key)
    return place_ - 1 if place_ and bounds[place_ - 1] == key and place_ - 1 in exclude else place_


def default_id(n: int, *keys: Column) -> Column:
    return F.pmod(F.hash(*keys), F.lit(n))


def double_hash_id(original: Column, prime: int, n: int) -> Column:
    return F.pmod(F.pmod(original, F.lit(prime)), F.lit(n)).cast("int")


def delegate_id(original: Column, virtual: int, n: int) -> Column:
    """The original partitioner over `virtual` partitions, folded to n."""
    return double_hash_id(original, virtual, n)


def rehash_id(original: Column, prime: int, cumulative: list[int], mapping: list[int] | None = None) -> Column:
    """Weighted: the first i whose cumulative share of the prime is above the hash."""
    p = F.pmod(original, F.lit(prime))
    shares = F.array(*[F.lit(int(c)) for c in cumulative])
    return _mapped(F.size(F.filter(shares, lambda c: c <= p)).cast("int"), mapping)


def single_id(n: int) -> Column:
    return F.lit(n - 1)


def place(df: DataFrame, pid: Column, n: int) -> DataFrame:
    """Rows in the partition that `pid` names. Group and sort by pid first, or Spark shuffles again."""
    return df.withColumn("pid", pid.cast("int")).repartitionById(n, "pid")


def ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows in ranges of `order` that follow each other, sorted within. Rows that are equal in it but not in all columns may lie in several.

    There are spark.sql.shuffle.partitions ranges. Their number is given, as adaptive execution would gather ranges by their
    compressed bytes, and a hot key's rows shrink to so few that most of them would come back to one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # maps can't be hashed
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()])
    return df.repartitionByRange(n, *order, rest).sortWithinPartitions(*order)


def load(df: DataFrame, pid: Column, rec_bytes: Column) -> DataFrame:
    return df.groupBy(pid.cast("int").alias("pid")).agg(F.count(F.lit(1)).alias("records"), F.sum(rec_bytes).cast("long").alias("bytes"))
