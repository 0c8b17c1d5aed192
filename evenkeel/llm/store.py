"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost executor
costs only the tasks it was running, never a stage that is already written.
Tables that nothing will read again are deleted: by `discard`, and by `settled`,
which writes a result and deletes all that was written on the way to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_dir

BATCH_ROWS = 2_000
BROADCAST_IDS = 250_000


#: Texts are long, so Arrow batches are short; a written table needs the shuffle files behind it no longer.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession):
    """SETTINGS hold inside, unless the session says otherwise; afterwards it is as before."""
    own = [k for k in SETTINGS if spark.conf.get(k, None) is None]
    for key in own:
        spark.conf.set(key, SETTINGS[key])
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/evenkeel-{uuid.uuid4().hex}/{label}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """`df`, computed once, as a table in the shared folder."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    writer = df.write.mode("overwrite")
    for key, value in options.items():
        writer = writer.option(key, value)
    with settings(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() returns, as a written table; every other table that was written inside is deleted."""
    made: list[str] = []
    token = _made.set(made)
    try:
        out = make()
        if getattr(out, "_stored_at", None) not in made:
            out = written(out, label)
    finally:
        _made.reset(token)
    discard(*(path for path in made if path != out._stored_at))
    if (outer := _made.get()) is not None:
        outer.append(out._stored_at)
    return out


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast while it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(*tables: DataFrame | str) -> None:
    """Delete the files behind `written` tables, or under paths, that nothing will read again."""
    for table in tables:
        path = table if isinstance(table, str) else getattr(table, "_stored_at", None)
        if path and "/evenkeel-" in path:
            spark = SparkSession.active()
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"{name}_{uuid.uuid4().hex}"


def row_key(*columns: Column) -> list[Column]:
    """128 bits that stand for these columns of a row, in two numbers; equal rows have equal keys."""
    return [F.xxhash64(F.lit(seed), *[x for c in columns for x in (c, c.isNull())]) for seed in (1, 2)]


def without(docs: DataFrame, dropped: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of docs whose keys aren't among the rows of `dropped` (a written table, a column for each key)."""
    names = [fresh("key") for _ in keys]
    marked = small(dropped.toDF(*names))
    test = [k.eqNullSafe(marked[n]) for k, n in zip(keys, names)]
    return docs.join(marked, test, "left_anti")
