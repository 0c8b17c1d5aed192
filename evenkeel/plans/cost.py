"""Cost models in seconds, as columns and on the driver, and their least-squares fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearCost:
    """intercept + per_record * records + per_byte * bytes + per_key * keys; the intercept counts once a range."""

    per_byte: float
    per_record: float = 0.0
    per_key: float = 0.0
    intercept: float = 0.0

    def marginal(self, records: float, size: float, keys: float = 0) -> float:
        return max(0.0, self.per_record * records + self.per_byte * size + self.per_key * keys)

    def of(self, records: float, size: float, keys: float = 0) -> float:
        return self.intercept + self.marginal(records, size, keys)

    def column(self, records: Column, size: Column, keys: Column | None = None) -> Column:
        out = F.lit(self.intercept) + F.lit(self.per_record) * records + F.lit(self.per_byte) * size
        return out if keys is None else out + F.lit(self.per_key) * keys


class RunningCost:
    """The cost of a range while partitions are added to it."""

    def __init__(self, model: LinearCost):
        self.model, self.total = model, 0.0

    def with_next(self, records: float, size: float) -> float:
        return (self.total or self.model.intercept) + self.model.marginal(records, size)

    def add(self, records: float, size: float) -> float:
        self.total = self.with_next(records, size)
        return self.total


#: Fitted presets of three application classes, in seconds (key coefficients are not used in planning).
PRESETS = {
    "alignment-map": LinearCost(intercept=8.1152477, per_record=1.3161168e-3, per_byte=4.5103178e-6),
    "alignment-reduce": LinearCost(intercept=2.6624235, per_record=1.6431948e-4, per_byte=2.6694213e-6, per_key=-0.12333674),
    "pagerank-map": LinearCost(intercept=4.5988849, per_record=-4.4619401e-5, per_byte=2.1597263e-6),
    "pagerank-reduce": LinearCost(intercept=2.7861694, per_record=2.4023880e-6, per_byte=9.1139572e-8, per_key=1.6168926e-7),
    "index-map": LinearCost(intercept=10.3846953, per_record=9.9748682e-5, per_byte=7.5473683e-7),
    "index-reduce": LinearCost(intercept=4.2897559, per_record=1.3643075e-6, per_byte=1.4207748e-7, per_key=9.9136395e-3),
}


def moments(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """One row of the sums that the normal equations need."""
    names = ["1", *xs]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    pairs = [F.sum(col(a) * col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return df.where(" and ".join(f"{c} is not null" for c in [y, *xs])).agg(*pairs, *[F.sum(col(a) * F.col(y)).alias(f"t_{i}") for i, a in enumerate(names)])


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with the largest pivot; singular systems raise."""
    rows = [[*m, r] for m, r in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        if abs(rows[pivot][i]) < 1e-12:
            raise ValueError("regressors depend on each other")
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(n):
            if k != i:
                f = rows[k][i] / rows[i][i]
                rows[k] = [a - f * b for a, b in zip(rows[k], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def fit(df: DataFrame, y: str, xs: list[str]) -> list[float]:
    """Intercept and slopes by least squares; only the sums reach the driver."""
    row = moments(df, y, xs).first()
    n = len(xs) + 1
    matrix = [[row[f"s_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]
    return solve(matrix, [row[f"t_{i}"] or 0.0 for i in range(n)])


COST_LOG = "tracker string, job string, type string, task string, seconds double, bytes long, records long, key_groups long, class string"


def parse_cost_log(lines: DataFrame) -> DataFrame:
    """The fields of a cost log's lines (`value`), beside the lines' other columns."""
    fields = [x.split() for x in COST_LOG.split(", ")]
    cells = F.split("value", ",", -1)
    return lines.select(*[c for c in lines.columns if c != "value"], *[F.get(cells, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])


def observations(log: DataFrame) -> DataFrame:
    """Those with something processed; reduce rows need groups too."""
    return log.where("bytes > 0 and records > 0 and (type <> 'r' or key_groups > 0)")


def read_cost_log(spark, path: str) -> DataFrame:
    return observations(spark.read.schema(COST_LOG).csv(path))


def two_slopes(y: Column, a: Column, b: Column) -> list[Column]:
    """Intercept and both slopes of y over two regressors as aggregates, in one pass; null where the regressors depend on each other."""
    aa, bb, ab = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    ay, by = F.covar_pop(a, y), F.covar_pop(b, y)
    whole = aa * bb - ab * ab
    first, second = F.try_divide(ay * bb - by * ab, whole), F.try_divide(by * aa - ay * ab, whole)
    return [F.avg(y) - first * F.avg(a) - second * F.avg(b), first, second]


#: A cost log's stretches are told apart in slices of this many bytes.
SLICE = 1 << 20


def log_runs(log: DataFrame, file: str, place: str, slice_bytes: int = SLICE) -> DataFrame:
    """A cost log with a `run` for each stretch of one class: a model is fitted to a stretch, as a class that comes back is new.

    Lines are ordered by file and by `place` in it, each tracker's by themselves. Files are cut into slices: a line's run
    follows from the changes before it in its slice and in the slices before, of which there is one row a tracker each. No
    task sees all of a tracker's lines.
    """
    cut = log.withColumn("_slice", F.floor(F.col(place) / F.lit(slice_bytes)))
    keys = ["tracker", file, "_slice"]
    w = Window.partitionBy(*keys).orderBy(place)
    changed = ~F.col("class").eqNullSafe(F.lag("class").over(w)) & (F.row_number().over(w) > 1)
    rows = cut.withColumn("_changes", F.sum(changed.cast("long")).over(w))
    slices = rows.groupBy(*keys).agg(F.min_by("class", place).alias("_first"), F.max_by("class", place).alias("_last"), F.max("_changes").alias("_within"))
    order = Window.partitionBy("tracker").orderBy(file, "_slice")
    begins = ~F.col("_first").eqNullSafe(F.lag("_last").over(order)) | (F.row_number().over(order) == 1)
    within = F.coalesce(F.sum("_within").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = slices.select(*keys, (F.sum(begins.cast("long")).over(order) + within).alias("_start"))
    return rows.join(starts, keys).withColumn("run", F.col("_start") + F.col("_changes")).drop("_slice", "_changes", "_start")


def map_models(runs: DataFrame) -> DataFrame:
    """tracker, run, class, observations, intercept, per_record, per_byte of each stretch's map tasks."""
    b = two_slopes(F.col("seconds"), F.col("records").cast("double"), F.col("bytes").cast("double"))
    maps = runs.where("type = 'm'").groupBy("tracker", "run", "class")
    return maps.agg(F.count(F.lit(1)).alias("observations"), *[x.alias(n) for n, x in zip(("intercept", "per_record", "per_byte"), b)])
