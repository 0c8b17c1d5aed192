"""Scalar functions, record sizes and primes."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_bytes(*columns: str) -> Column:
    """Bytes of a record by its columns' text forms; null counts as nothing."""
    parts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns]
    return reduce(lambda a, b: a + b, parts)


def to_hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def from_hex(column: Column) -> Column:
    return F.unhex(column)


#: Suffixes of sizes and the powers of two that they stand for.
SIZE_SHIFTS = {"K": 10, "M": 20, "G": 30, "T": 40, "P": 50}


def parse_size(column: Column) -> Column:
    """Bytes from text such as 64, 8K or 2g; null where it isn't a size."""
    text = F.upper(F.trim(column))
    number = F.expr("try_cast(null as bigint)")
    digits = F.regexp_extract(text, "^([0-9]{1,18})([KMGTP]?)$", 1)
    suffix = F.regexp_extract(text, "^([0-9]{1,18})([KMGTP]?)$", 2)
    shift = reduce(lambda acc, kv: acc.when(suffix == kv[0], F.lit(1 << kv[1])), SIZE_SHIFTS.items(), F.when(suffix == "", F.lit(1).cast("long")))
    return F.when(digits != "", digits.try_cast("long") * shift).otherwise(number)


def gaussian_pdf(x: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * math.sqrt(2 * math.pi))


def gaussian_cdf(x: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """By the error function's rational approximation 7.1.26 of Abramowitz and Stegun (absolute error under 1.5e-7)."""
    z = (x - mean) / (deviation * math.sqrt(2))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = (1 - series * F.exp(-z * z)) * F.signum(z)
    return (1 + erf) / 2


def gaussian_quantile(p: float, mean: float = 0.0, deviation: float = 1.0) -> float:
    """The point below which a share p of the mass lies, by bisection on the driver."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        if 0.5 * math.erfc(-middle / math.sqrt(2)) < p:
            low = middle
        else:
            high = middle
    return mean + deviation * (low + high) / 2


def normalized(values: list[float]) -> list[float]:
    total = math.fsum(values)
    if not total:
        raise ValueError("values sum to zero")
    return [v / total for v in values]


def arg_max(values: list[float]) -> int:
    return max(range(len(values)), key=lambda i: (values[i], -i))


def probabilities_from_logs(logs: list[float]) -> list[float]:
    top = max(logs)
    return normalized([math.exp(v - top) for v in logs])


def normalized_array(values: Column) -> Column:
    """Shares of an array's numbers; null where they sum to nothing."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.try_divide(x.cast("double"), total))


def arg_max_array(values: Column) -> Column:
    """The place (from 0) of an array's largest number, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def probabilities_from_logs_array(logs: Column) -> Column:
    return normalized_array(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))))


def exact_mean(column: Column, digits: int = 9) -> Column:
    """The mean of exact decimal sums: what compensated summation comes near to, in any order of the rows; 0 when empty."""
    total = F.sum(column.cast(f"decimal(28,{digits})")).cast("double")
    return F.coalesce(F.try_divide(total, F.count(column)), F.lit(0.0))


def mean_or_zero(column: Column) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def compensated_mean(values: list[float]) -> float:
    return math.fsum(values) / len(values) if values else 0.0


def last_rows(df: DataFrame, partition: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group: what a circular buffer of size n would hold."""
    w = Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def weighted_last_rows(df: DataFrame, partition: list[str], order: list[str], n: int, value: str, weight: str) -> DataFrame:
    """What a circular buffer of weighted items holds: items, their weights' sum, and their weighted mean."""
    held = last_rows(df, partition, order, n)
    total = F.sum(weight)
    return held.groupBy(*partition).agg(F.count(F.lit(1)).alias("items"), total.alias("weight"), F.try_divide(F.sum(F.col(value) * F.col(weight)), total).alias("mean"))


class DrainingQueue:
    """A priority queue that may be added to while it is read; reading takes its items away."""

    def __init__(self, items: Iterable = ()):
        self.heap = list(items)
        heapq.heapify(self.heap)

    def add(self, *items) -> None:
        for x in items:
            heapq.heappush(self.heap, x)

    def __iter__(self) -> Iterator:
        while self.heap:
            yield heapq.heappop(self.heap)

    def take(self, n: int) -> list:
        return [heapq.heappop(self.heap) for _ in range(min(n, len(self.heap)))]

    def take_while(self, test: Callable) -> list:
        """Items from the head on as long as the head passes: a prefix, not a filter."""
        out = []
        while self.heap and test(self.heap[0]):
            out.append(heapq.heappop(self.heap))
        return out


def head_while(df: DataFrame, stream: list[str], order: list[Column], test: Column) -> DataFrame:
    """The same over sorted streams: the rows of each stream before the first that fails the test."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_failed", F.max((~F.coalesce(test, F.lit(False))).cast("int")).over(w)).where("_failed = 0").drop("_failed")


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3.3e24."""
    if n < 2:
        return False
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    for p in bases:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in bases:
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def next_prime(n: int) -> int:
    """The smallest prime above n."""
    n += 1
    while not _is_prime(n):
        n += 1
    return n
