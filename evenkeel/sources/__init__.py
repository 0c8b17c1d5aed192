"""Sources, sinks and input splits.

Spark plans file splits itself; the functions here make splits explicit where a
plan needs to name a part of an input, and read or write what plans consist of.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


#: A text file's lines are numbered in chunks of 2^CHUNK.
CHUNK = 14


def text_lines(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """file, offset (in bytes) and value of each line that ends with a line feed; lines over `longest` bytes are skipped.

    Spark cuts files into ranges and gives each line to the range that it starts in. Lines' places follow from the bytes
    of the lines before: in a chunk of the range, by the order of reading, and in the chunks before, of which there is one
    row each. No task sorts a whole range.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    size = F.octet_length("value") + 1
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    lines = lines.withColumn("chunk", F.shiftright("line", CHUNK))
    of_chunks = lines.groupBy("file", "block", "chunk").agg(F.sum(size).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = of_chunks.select("file", "block", "chunk", before.alias("base"))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("file", "block", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # lines lie by chunk already, so the join moves a row a chunk
    placed = lines.withColumn("inner", inner).join(base, ["file", "block", "chunk"]).select("file", (F.col("base") + F.col("inner")).cast("long").alias("offset"), "value")
    return placed if longest is None else placed.where(F.octet_length("value") <= longest)


def stopped_at(positioned: DataFrame, position: str, length: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows that a reader has processed when it is stopped at `limit`, and one row that says where it stands.

    A record that starts before the limit is processed to its end; of the rest only places and lengths are scanned.
    """
    done = F.col(position) < limit
    end = F.max(F.when(done, F.col(position) + F.col(length)))
    counts = positioned.agg(
        F.count_if(done).alias("processed_records"), F.coalesce(F.sum(F.when(done, F.col(length))), F.lit(0)).cast("long").alias("processed_bytes"), F.coalesce(end, F.lit(0)).cast("long").alias("stopped_at"),
        F.count_if(~done).alias("rest_records"), F.coalesce(F.sum(F.when(~done, F.col(length))), F.lit(0)).cast("long").alias("rest_bytes"),
    )
    return positioned.where(done), counts


def parsed(df: DataFrame, raw: str, kind: str) -> DataFrame:
    """`raw` read as a type: `value`, and `bad` where it is there but can't be read; nothing stops at a bad record."""
    value = F.col(raw).try_cast(kind)
    return df.withColumn("value", value).withColumn("bad", F.col(raw).isNotNull() & value.isNull())


def bad_ranges(rows: DataFrame, stream: list[str], position: str) -> DataFrame:
    """(stream, start, length) of each run of bad records at consecutive positions: what a skipping reader leaves out."""
    w = Window.partitionBy(*stream).orderBy(position)
    bad = rows.where("bad").withColumn("_island", F.col(position) - F.row_number().over(w))
    return bad.groupBy(*stream, "_island").agg(F.min(position).alias("start"), F.count(F.lit(1)).alias("length")).drop("_island")


def line_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.octet_length("value").cast("long").alias("length"))


def sequence_records(spark: SparkSession, path: str) -> DataFrame:
    """Key and value of Hadoop sequence files of text or byte records, as binary columns; the files' own format needs their reader."""
    def raw(x):
        return bytearray(x) if isinstance(x, (bytes, bytearray)) else bytearray(str(x).encode())

    pairs = spark.sparkContext.sequenceFile(path).map(lambda kv: (raw(kv[0]), raw(kv[1])))
    return spark.createDataFrame(pairs, "key binary, value binary")


def write_sequence(df: DataFrame, path: str, key: str, value: str) -> None:
    """Text columns become text records, binary columns byte records."""
    kept = [F.col(c) if df.schema[c].dataType.simpleString() == "binary" else F.col(c).cast("string") for c in (key, value)]
    df.select(*kept).rdd.map(lambda r: tuple(bytearray(x) if isinstance(x, (bytes, bytearray)) else x for x in r)).saveAsSequenceFile(path)


def concatenated(spark: SparkSession, paths: list[str], path: str) -> None:
    """The records of several sequence files as one set of files."""
    write_sequence(sequence_records(spark, ",".join(paths)), path, "key", "value")


def dumped(records: DataFrame) -> DataFrame:
    """A line of hexadecimal key and value for each record."""
    return records.select(F.concat_ws("\t", F.lower(F.hex("key")), F.lower(F.hex("value"))).alias("line"))


def record_scan(positioned: DataFrame, position: str, key: str, value: str, order: Window | None = None) -> DataFrame:
    """offset, lengths and `splitable` of records without their contents: a record can be split from its follower if the follower starts where it ends."""
    sized = positioned.select(F.col(position).alias("offset"), F.octet_length(key).cast("long").alias("key_len"), F.octet_length(value).cast("long").alias("val_len"))
    sized = sized.withColumn("rec_len", F.col("key_len") + F.col("val_len"))
    following = F.lead("offset").over(order) if order is not None else F.col("offset") + F.col("rec_len")
    return sized.withColumn("splitable", F.coalesce(following == F.col("offset") + F.col("rec_len"), F.lit(True)))


def record_lengths(df: DataFrame, key: str, value: str, splitable: Column | None = None) -> DataFrame:
    """key_len, val_len, rec_len and splitable of each record, without reading anything else."""
    size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long")
    return df.select(size(key).alias("key_len"), size(value).alias("val_len"), (size(key) + size(value)).alias("rec_len"), (F.lit(True) if splitable is None else splitable).alias("splitable"))


def key_sizes(df: DataFrame, keys: list[str], rec_bytes: Column) -> DataFrame:
    """Only keys and record sizes: column pruning leaves the values unread."""
    return df.select(*keys, rec_bytes.cast("long").alias("rec_bytes"))


@dataclass(frozen=True)
class Split:
    start: int
    length: int

    @property
    def end(self) -> int:
        return self.start + self.length


def equal_splits(length: int, n: int = 2, start: int = 0) -> list[Split]:
    """n parts that differ by a byte at most and cover everything; empty parts are left out."""
    if n < 1:
        raise ValueError("n must be positive")
    sizes = [length // n + (i < length % n) for i in range(n)]
    out = []
    for size in sizes:
        if size:
            out.append(Split(start, size))
        start += size
    return out


def chunked(sizes: list[tuple[str, int]], limit: int = 128 << 20) -> list[list[str]]:
    """Names in order, gathered into chunks of at most `limit` bytes (a larger one is a chunk by itself)."""
    out: list[list[str]] = []
    held = limit + 1
    for name, size in sizes:
        if held + size > limit:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


def chunks_by_host(sizes: list[tuple[str, str, int]], limit: int = 128 << 20) -> dict[str, list[list[str]]]:
    """`chunked` for (host, name, bytes), each host by itself."""
    hosts: dict[str, list[tuple[str, int]]] = {}
    for host, name, size in sizes:
        hosts.setdefault(host, []).append((name, size))
    return {h: chunked(v, limit) for h, v in sorted(hosts.items())}


def splits_frame(spark: SparkSession, splits: list[Split]) -> DataFrame:
    rows = [(i, s.start, s.end) for i, s in enumerate(splits)]
    return spark.createDataFrame(rows, "index int, offset long, last_offset long")


def in_split(position: Column, split: Split) -> Column:
    """Rows of an explicit split of a positioned input: the original reader under a range filter."""
    return (position >= split.start) & (position < split.end)


def write_map_output(df: DataFrame, path: str, pid: Column, key: list[str]) -> None:
    """Rows of each reduce partition in a directory of its own, sorted by key so that files and row groups hold ranges of keys.

    A partition's ranges are written by several tasks, so that none sorts all of it.
    """
    from ..operators.partitioners import ranged

    ranged(df.withColumn("pid", pid.cast("int")), ["pid", *key]).write.mode("overwrite").partitionBy("pid").parquet(path)


def read_map_output(spark: SparkSession, path: str, pid: int, key: str, low=None, high=None, columns: list[str] | None = None) -> DataFrame:
    """One reduce partition's rows with low < key <= high: other partitions' files aren't opened, and the bounds reach the row groups."""
    rows = spark.read.parquet(path).where(F.col("pid") == pid)
    rows = rows if low is None else rows.where(F.col(key) > F.lit(low))
    rows = rows if high is None else rows.where(F.col(key) <= F.lit(high))
    return rows.drop("pid") if columns is None else rows.select(*columns)


def map_output(spark: SparkSession, tracker: DataFrame, path: str, source: str, pid: int, key: str, low=None, high=None) -> DataFrame:
    """The input of a reduce that is run again: kept by the first run (`tracker`, with a pid column) or written by one that took over."""
    if source == "reactive":
        return read_map_output(spark, path, pid, key, low, high)
    from ..operators import key_range

    return tracker.where((F.col("pid") == pid) & key_range(F.col(key), low, high)).drop("pid")


def merged_outputs(tracker: DataFrame, reactive: DataFrame) -> DataFrame:
    """Map output from the first run and from runs that took over, as one input."""
    return tracker.unionByName(reactive)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all tasks run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="evenkeel-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/evenkeel-{uuid.uuid4().hex}/{label}"


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once, in the cluster's checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def write_statistics(partitions: DataFrame, path: str) -> None:
    """Statistics of partitions for a planner that runs later; bounded by the plan's samples, so in one file."""
    partitions.coalesce(1).write.mode("overwrite").parquet(path)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """df with named counters that its first action fills as a by-product."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_output(df: DataFrame, path: str, compression: str = "zstd", partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def output_name(kind: str, index: int, *parts: int) -> str:
    """m-00001 or r-00002, with .n for each time that the task was split again."""
    return f"{kind[0]}-{index:05d}" + "".join(f".{p}" for p in parts)
