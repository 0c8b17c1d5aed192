"""Sum-of-squares packing of documents into sequences of bounded length.

A document's ids are cut into pieces only where it is longer than a sequence.
Full pieces are sequences by themselves. The others are dealt at random into
groups of bounded size, longest first within a group, and each piece goes where
the sum of the squared numbers of open sequences per remaining gap becomes
smallest. A sequence is opened only when no open one has room: with the longest
pieces first this keeps the number of sequences next to the lower bound.

A group's state is one counter and one stack per gap, however many pieces it
has. At any size of the input a group holds at most about 2 * GROUP pieces.

Defined results: a null text is empty (one piece with the end id). Rows with a
null or repeated doc_id are packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches, store
from .token_files import _blocks
from .tokenizing import encoder

GROUP = 60_000
#: Smaller than token files take them: packing comes last in a pipeline, in executors that are full of what was before.
STEMS, BLOCK_BYTES = 200_000, 2 << 20
PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Every piece of every document; row_key is distinct for each piece."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["row_key", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    @caches.worker("tokens")
    def run(batches):
        enc, key = encoder(vocabulary, most_stems=STEMS), TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in _blocks(whole, BLOCK_BYTES):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                    ids += end
                    for piece, low in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[low : low + 4 * capacity]
                        rows.append((key, doc_id, piece, low // 4, len(cut) // 4, zlib.crc32(cut), *([np.frombuffer(cut, "<i4")] if with_ids else [])))
                        key += 1
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the order given."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences per gap
    stacks: dict[int, list[int]] = {}
    sequence, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    barred = np.int64(1) << 60
    for i, size in enumerate(map(int, lengths)):
        source, target = counts[size:capacity], counts[: capacity - size]
        change = np.where(source > 0, 2 * (target - source) + 2, barred)  # by gap, from `size` on
        if len(change) and source[0] > 0:
            change[0] = 1 - 2 * source[0]  # a full sequence is no longer counted
        best = int(change.argmin()) if len(change) else -1
        if best < 0 or change[best] == barred:
            gap, number = capacity, opened
            opened += 1
        else:
            gap = best + size
            number = stacks[gap].pop()
            counts[gap] -= 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            stacks.setdefault(gap - size, []).append(number)
    return sequence, offset


def place(cut: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to a table of pieces that is written already."""
    n = cut.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group))
    full = cut.where(F.col("length") >= capacity).select("*", (F.col("row_key") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < capacity).withColumn("bundle", F.pmod(F.xxhash64("row_key"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_key"], ascending=[False, True], kind="stable")
        number, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        base = int(rows["bundle"].iloc[0]) << 32
        return rows.drop(columns="bundle").assign(sequence_id=2 * (base + number), offset=offset)

    return full.unionByName(rest.groupBy("bundle").applyInPandas(pack, schema))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    cut = store.written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    return place(cut, capacity, group).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, at most `capacity` of them a row."""
    cut = store.written(pieces(docs, vocabulary, capacity, end_id, with_ids=True), "pieces")
    parts = place(cut, capacity, group).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
