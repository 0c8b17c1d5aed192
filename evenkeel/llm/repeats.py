"""Removal of byte strings of WINDOW (100) bytes or more that occur earlier in the corpus, by a run-length index.

The corpus is parsed into content-defined segments (`anchors`), as in prefix-free
parsing: a dictionary of distinct segments, and for each document the run of
segments it is made of. A window of 100 bytes lies in exactly one segment, and
equal windows lie in segments with equal anchors at equal distance, so repeats
are found anchor by anchor and never need one index of the whole corpus.

1. Segments whose anchor occurs once can hold no repeat; they are dropped.
2. Of equal segments all but the first are repeated in full.
3. The first occurrences of different segments with one anchor (the edges of
   repeated passages) may share some windows. They are dealt by anchor; some
   whole anchors at a time are put into a run-length index (`runindex`): the
   run-compressed Burrows-Wheeler transform with sampled run ends. Matching
   statistics stream from it; places that match over WINDOW bytes or more form
   chains, the smallest place of a chain stays and the others are marked.
   Segments that share too little around their anchor are left out first.
4. An anchor with over HOT different segments isn't given to one task: its
   windows are dealt by their 128-bit hashes and first places are aggregated.

Places are compared as (doc_id, row, start), where rows are numbered once, in a
table that every later step reads. The marked windows of a row are merged into
spans.

Defined results: null text is empty. Every row is a document of its own: rows
that repeat a doc_id follow each other in the order of their numbers, rows
without a doc_id come before all others, and of equal texts the first stays
whole. Only bytes of a row's own repeated strings are cut. A text of any length
is parsed in pieces. Other columns are ignored. Texts under WINDOW bytes, and an
empty table, have nothing to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches, store
from .anchors import K, WINDOW, segments
from .runindex import Strings, repeated
from .shingles import mixed
from .token_files import _blocks

HOT = 4_000
BUCKET = 2 << 20
BLOCK = 2 << 20
NO_ID = -(1 << 63)
PLACE = "doc", "row", "at"


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, doc, text: a written table, so that every step sees the same numbers."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return store.written(rows, "rows", compression="zstd")


@caches.worker()
def _parse(batches):
    names = ["doc", "row", "at", "n", "mark", "anchor", "whole"]
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64]
    for whole in batches:
        for batch in _blocks(whole, BLOCK):
            found = [segments(text.as_buffer().to_pybytes()) for text in batch.column("text").cast(pa.binary())]
            sizes = [len(f[0]) for f in found]
            parts = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc", "row")]
            parts += [np.concatenate([f[i] for f in found]) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(k, copy=False)) for x, k in zip(parts, kinds)], names=names)


def _spans(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive window starts of an owner as byte spans."""
    if not len(owner):
        return owner, start, start
    first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.concatenate([first[1:], [True]])
    return owner[first], start[first], start[last] + WINDOW


STEP = 21
CONTEXT = WINDOW - STEP


def partners(strings: Strings, anchor: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which segments may share a window with another one.

    Two segments that do share l bytes before and r bytes after their anchor with
    l + K + r >= WINDOW, so for a multiple of STEP they share the CONTEXT bytes
    that begin that many before the anchor.
    """
    keys, owner = [], []
    for before in range(0, WINDOW - K, STEP):
        some = np.flatnonzero((mark >= before) & (strings.sizes - mark + before >= CONTEXT))
        low = strings.low[some] + mark[some] - before
        key = mixed(anchor[some].view(np.uint64) + np.uint64(before))
        for k in [*range(0, CONTEXT - 8, 8), CONTEXT - 8]:
            key = mixed(key + strings.words[low + k])
        keys.append(key)
        owner.append(some)
    all_keys, owners = np.concatenate(keys), np.concatenate(owner)
    _, inverse, counts = np.unique(all_keys, return_inverse=True, return_counts=True)
    out = np.zeros(len(anchor), bool)
    out[owners[counts[inverse] > 1]] = True
    return out


def repeated_windows(raw: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that hold a string that starts earlier, over whole anchors in ascending order of place: (segment, place in it)."""
    strings = Strings(raw, sizes)
    kept = partners(strings, anchor, mark)
    chosen = np.flatnonzero(kept)
    if not len(chosen):
        return chosen, chosen
    strings = strings.some(kept)
    at = repeated(strings, WINDOW)
    owner = np.searchsorted(strings.low, at, side="right") - 1
    return chosen[owner], at - strings.low[owner]


@caches.worker()
def _index(batches):
    """Rows sorted by anchor and place: marks repeated windows, some whole anchors at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def marked(rows: pa.Table):
        column = lambda c: rows.column(c).to_numpy()
        texts = rows.column("bytes").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        owner, place = repeated_windows(raw, np.diff(bounds), column("anchor"), column("mark"))
        owner, low, high = _spans(owner, column("at")[owner] + place)
        return pa.RecordBatch.from_arrays([pa.array(column("row")[owner]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["row", "low", "high"])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += batch.column("bytes").nbytes
        if size > BUCKET:
            rows = pa.Table.from_batches(held).combine_chunks()
            cuts = np.flatnonzero(np.diff(rows.column("anchor").to_numpy())) + 1
            if len(cuts):
                yield marked(rows.slice(0, cuts[-1]))
                held = rows.slice(cuts[-1]).to_batches()
                size = sum(b.column("bytes").nbytes for b in held)
    if held:
        yield marked(pa.Table.from_batches(held).combine_chunks())


@caches.worker()
def _cut(batches):
    """Segment texts for the wanted places of each row."""
    names = ["anchor", "at", "n", "mark", "hot"]
    for whole in batches:
        for batch in _blocks(whole, BLOCK):
            wanted = batch.column("wanted")
            sizes = np.diff(wanted.offsets.to_numpy())
            items = dict(zip(names, wanted.flatten().flatten()))
            low, high = items["at"].to_numpy(), (items["at"].to_numpy() + items["n"].to_numpy() + WINDOW - 1)
            texts = batch.column("text").cast(pa.binary())
            cut, k = [], 0
            for text, size in zip(texts, sizes.tolist()):
                view = memoryview(text.as_buffer())
                cut += [view[a:b] for a, b in zip(low[k : k + size].tolist(), high[k : k + size].tolist())]
                k += size
            bounds = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
            joined = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(cut))])
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([items["anchor"], repeat("doc"), repeat("row"), items["at"], items["mark"], joined, items["hot"]], names=["anchor", "doc", "row", "at", "mark", "bytes", "hot"])


CUT = "anchor long, doc long, row long, at int, mark int, bytes binary, hot boolean"


@caches.worker()
def _hashed(batches):
    """(window hash, doc, row, at) of every window of the segments of hot anchors."""
    for batch in batches:
        out = []
        for doc, row, at, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "at", "bytes"))):
            out += [(xxhash.xxh3_128_digest(raw[i : i + WINDOW]), doc, row, at + i) for i in range(len(raw) - WINDOW + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32()))], names=["window", "doc", "row", "at"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, low, high): byte spans of `numbered` rows to remove, overlapping or not."""
    parsed = store.written(rows.select("doc", "row", "text").mapInArrow(_parse, "doc long, row long, at int, n int, mark int, anchor long, whole long"), "segments")
    met = store.written(parsed.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("c > 1").select("anchor", (F.col("a") != F.col("b")).alias("several")), "anchors")
    again = store.written(parsed.join(met, "anchor"), "again")
    store.discard(parsed, met)
    place = F.struct(*PLACE)
    firsts = again.groupBy("anchor", "whole").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("mark").alias("mark"), F.first("several").alias("several"), F.count(F.lit(1)).alias("c"))
    firsts = store.written(firsts.where("several or c > 1"), "firsts")
    twice = firsts.where("c > 1").select("anchor", "whole", "first")
    later = again.join(twice, ["anchor", "whole"]).where(place != F.col("first")).select("row", F.col("at").alias("low"), (F.col("at") + F.col("n") + WINDOW - 1).alias("high"))
    later = store.written(later, "later")
    store.discard(again)
    hot = store.written(firsts.where("several").groupBy("anchor").agg(F.count(F.lit(1)).alias("v")).where(F.col("v") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    edges = firsts.where("several").join(store.small(hot), "anchor", "left").select(F.col("first.row").alias("edge"), F.struct("anchor", F.col("first.at").alias("at"), "n", "mark", F.coalesce("hot", F.lit(False)).alias("hot")).alias("x"))
    wanted = edges.groupBy("edge").agg(F.collect_list("x").alias("wanted"))  # at most the segments of one text
    cut = store.written(rows.join(wanted, F.col("row") == F.col("edge")).select("doc", "row", "text", "wanted").mapInArrow(_cut, CUT), "edges")
    store.discard(firsts)
    dealt = cut.where("not hot").select("anchor", *PLACE, "mark", "bytes").repartition("anchor").sortWithinPartitions("anchor", *PLACE)
    spans = later.unionByName(dealt.mapInArrow(_index, "row long, low int, high int"))
    windows = None
    if hot.limit(1).count():
        windows = store.written(cut.where("hot").mapInArrow(_hashed, "window binary, doc long, row long, at int"), "hot-windows")
        first = windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
        marked = windows.join(first, "window").where(place != F.col("first")).select("row", F.col("at").alias("low"), (F.col("at") + WINDOW).alias("high"))
        spans = spans.unionByName(marked)
    spans = store.written(spans, "spans")
    store.discard(later, hot, cut, *([windows] if windows is not None else []))
    return spans


def _merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Spans that neither overlap nor touch, ascending."""
    if not len(low):
        return []
    by = np.argsort(low)
    low, reach = low[by], np.maximum.accumulate(high[by])
    first = np.concatenate([[True], low[1:] > reach[:-1]])
    return list(zip(low[first].tolist(), reach[np.append(first[1:], True)].tolist()))


def _apply(keep_text: bool):
    @caches.worker()
    def run(batches):
        for whole in batches:
            for batch in _blocks(whole, BLOCK):
                spans = batch.column("spans")
                items = dict(zip(("low", "high"), spans.flatten().flatten()))
                low, high, k = items["low"].to_numpy(), items["high"].to_numpy(), 0
                rows = []
                for text, size in zip(batch.column("text").cast(pa.binary()), spans.value_lengths().fill_null(0).to_pylist()):
                    raw = memoryview(text.as_buffer())
                    cut = _merged(low[k : k + size], high[k : k + size])
                    k += size
                    left = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(raw)]))
                    rows.append((len(raw), len(raw) - len(left), len(cut), hashlib.sha256(left).hexdigest(), *([left] if keep_text else [])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], types[i]) for i in range(len(names)))], names=["doc_id", *names])

    return run


def remove(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and with keep_text the remaining bytes."""
    rows = numbered(docs)
    spans = repeated_spans(rows)
    listed = spans.groupBy(F.col("row").alias("cut")).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    found = rows.join(listed, F.col("row") == F.col("cut"), "left").select("doc_id", "text", "spans")
    out = store.written(found.mapInArrow(_apply(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")), "removed")
    store.discard(rows, spans)
    return out
