"""Token ids as Parquet list columns that can be read selectively.

A token file holds documents in ascending order of doc_id with the columns
doc_id, part, local_start, n_tokens and ids. `ids` is dictionary encoded (two
bytes or fewer an id before compression) and falls back to delta encoding; the
scalar columns are delta encoded. Row groups and pages have set sizes and the
writer stores page indexes, so a filter on doc_id reads the pages that hold it,
and a projection without `ids` reads none of the tokens.

`start` of a document is the number of ids before it. It isn't stored: each part
knows the running count inside it, and the counts of whole parts (a row a part)
are summed when the files are read, so writing needs one pass.

Defined results: a null text is empty and gives the end id alone. Rows without a
doc_id come first. Rows with the same doc_id are all kept, in order of the first
LEAD characters of their texts and then of the texts' hashes, so that they can be
dealt to many tasks. A text of any length is one row; tasks encode a few of them
at a time. Other columns are ignored. An empty table gives an empty file set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import caches, store
from .tokenizing import encoder

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
BATCH_BYTES = 4 << 20
LEAD = 16


def _blocks(batch: pa.RecordBatch, limit: int = BATCH_BYTES):
    """Runs of rows with at most `limit` bytes of text, or one row."""
    sizes = np.diff(np.frombuffer(batch.column("text").cast(pa.large_string()).buffers()[1], np.int64)[batch.column("text").offset :][: len(batch) + 1]) if len(batch) else []
    low, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(low, row - low)
            low, held = row, 0
        held += int(size)
    if low < len(batch):
        yield batch.slice(low)


def _encode(vocabulary: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    @caches.worker("tokens")
    def run(batches):
        enc, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in _blocks(whole):
                ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(before + bounds[:-1]),
                        pa.array(sizes.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encode every text and write the token files to `path`, parts in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.substring("text", 1, LEAD), F.xxhash64("text")]
    # equal rows may lie anywhere among themselves: their numbers as read keep even those from one task
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    store.written(ranged.mapInArrow(_encode(vocabulary, end_id), FILE_SCHEMA), "tokens", path, **FILE_OPTIONS)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, ids."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    kept = ["doc_id", "part", "local_start", "n_tokens", *(["ids"] if with_ids else [])]
    joined = rows.select(*kept).join(F.broadcast(starts), "part")
    return joined.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *(["ids"] if with_ids else []))


def select_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; the filter reaches the page indexes."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


@caches.worker()
def _crc(batches):
    for batch in batches:
        ids = batch.column("ids")
        bounds = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])), np.int64, len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids, from what `read` returns."""
    rows = tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return store.written(rows, "digests")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write all of `docs`, read the files back and return their digests."""
    path = store.new_path(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, end_id)
    found = digests(read(docs.sparkSession, path))
    store.discard(path)
    return found
