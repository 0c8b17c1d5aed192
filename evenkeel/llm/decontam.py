"""Benchmark decontamination by winnowing. DataFrame operations only.

Words are hashed, runs of K words are hashed from those, and of each WINDOW
consecutive runs the smallest hash is kept with its place (the leftmost of
equals). Any span of K + WINDOW - 1 = 10 words that a document and an item share
gives both the same kept hash, so a join of kept hashes finds every document that
shares a span, and where. The hits are then extended: a kept run at word p is
part of the windows that start at p-WINDOW+1 .. p; each of them is compared,
words and all, with the windows of the items.

An item of fewer than SPAN words (but not none) is one window; its own length
gets a K and WINDOW that add up to it. A benchmark seldom has such items; a
length that none has costs nothing.

Work per document is linear in its words and hits: documents meet distinct runs
and distinct windows of the items, never pairs of occurrences.

Defined results: every row is judged by itself. Null text has no words, so a
document with it isn't hit and an item with it has no windows. Rows with a null
or repeated doc_id each have the hits of their own texts (equal rows have equal
ones). Rows that repeat an item_id are versions of one item. A null item_id is
left out of the list of ids but counts. Texts of any length are taken whole.
Other columns are ignored (and kept by `filter_clean`). Empty tables give no
rows, or rows without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .spans import bound

SPAN, K = 10, 5
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a kept number that hold a run's place; the others hold its hash.
PLACE_BITS = 24
#: A table of the benchmark's side is broadcast up to so many rows and bytes of text, and joined by shuffle beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; null and wordless texts have none."""
    parts = F.split(F.translate(text, UPPER, LOWER), WORD_GAP, -1)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def _beside(a: Column, b: Column, by: int, join) -> Column:
    """join(a[i], b[i + by]) for every i up to the last entry of b."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), join)).otherwise(F.array().cast("array<bigint>"))


def _minima(source: Column, length: int, have: int = 1) -> Column:
    """The minimum of each `length` consecutive entries, by doubling; overlaps do no harm."""
    if have == length:
        return source
    step = min(have, length - have)
    return bound(_beside(source, source, step, lambda a, b: F.least(a, b)), lambda x: _minima(x, length, have + step))


def _runs(hashes: Column, length: int) -> Column:
    """A hash of each `length` consecutive entries, by doubling; the rest follows entry by entry."""

    def longer(run: Column, have: int) -> Column:
        if have == length:
            return run
        if have * 2 <= length:
            return bound(_beside(run, run, have, lambda a, b: F.xxhash64(a, b)), lambda x: longer(x, have * 2))
        return bound(_beside(run, hashes, have, lambda a, b: F.xxhash64(a, b)), lambda x: longer(x, have + 1))

    return longer(hashes, 1)


def runs_of(words_: Column, span: int) -> Column:
    """A hash of each run of k words."""
    return bound(F.transform(words_, lambda w: F.xxhash64(w)), lambda h: _runs(h, min(K, span)))


def kept_of(words_: Column, span: int) -> Column:
    """The distinct minima of the windows of runs, each a hash with its place below it."""
    low = (1 << PLACE_BITS) - 1
    with_place = lambda r, i: r.bitwiseAND(F.lit(-1 - low).cast("long")).bitwiseOR((i.bitwiseAND(F.lit(low))).cast("long"))
    placed = bound(runs_of(words_, span), lambda r: F.transform(r, with_place))
    return bound(placed, lambda r: F.array_distinct(_minima(r, span - min(K, span) + 1)))


def _bounded(df: DataFrame, label: str, text: str | None = None) -> DataFrame:
    """A written table, marked for broadcast where its counted rows and bytes allow."""
    df = store.written(df, label)
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def item_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id, size, window: the distinct windows of each item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(span))
    starts = F.sequence(F.lit(0), F.size("words") - size)
    texts = F.transform(starts, lambda p: F.array_join(F.slice("words", p + 1, size), " "))
    return items.select("item_id", size.alias("size"), F.explode(texts).alias("window")).distinct()


def _tried(w: Column, places: Column, size: int) -> Column:
    """Start and words of each window of `size` words around a kept run at one of `places` (which come back every 2^PLACE_BITS words)."""
    rounds = F.sequence(F.lit(0), F.shiftright(F.size(w), PLACE_BITS))
    at = F.flatten(F.transform(places, lambda p: F.transform(rounds, lambda n: p + F.shiftleft(n, PLACE_BITS))))
    reach = F.sequence(F.lit(0), F.lit(size - min(K, size)))
    starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.transform(reach, lambda back: p - back))))
    starts = F.filter(starts, lambda p: (p >= 0) & (p + size <= F.size(w)))
    return F.transform(starts, lambda p: F.struct(p.alias("start"), F.array_join(F.slice(w, p + 1, size), " ").alias("window")))


KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, words, and the key of doc_id and text: rows with equal keys are equal here."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    k1, k2 = store.row_key(doc_id, text)
    return docs.select(doc_id.alias("doc_id"), words(text).alias("words"), k1.alias("k1"), k2.alias("k2"))


def hits(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, key) of every row, and (key, start, size, window) of every window that an item has."""
    rows = _keyed(docs)
    distinct = windows.select("size", "window").distinct()
    hash_of = lambda c: F.shiftright(c, PLACE_BITS)
    counted, found = None, None
    for size in sizes:
        own = distinct.where(F.col("size") == size).select("window", F.split("window", " ", -1).alias("words"))
        marks = _bounded(own.select(F.explode(kept_of(F.col("words"), size)).alias("x")).select(hash_of("x").alias("mark")).distinct(), "marks")
        marked = rows.select("doc_id", *KEY, bound(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), kept_of(w, size).alias("kept"))).alias("x")).select("doc_id", *KEY, "x.n_words", "x.kept")
        # the kept hashes of all documents are written once; the join reads them, and the result their counts
        marked = store.written(marked, "kept")
        counted = marked.select("doc_id", "n_words", *KEY) if counted is None else counted
        placed = marked.select(*KEY, F.explode("kept").alias("x")).select(*KEY, hash_of("x").alias("mark"), F.col("x").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"))
        shared = store.written(placed.join(marks, "mark").groupBy(*KEY).agg(F.collect_set("place").alias("places")), "shared")
        near = rows.join(shared, KEY).select(*KEY, F.explode(bound(F.col("words"), lambda w: _tried(w, F.col("places"), size))).alias("x"))
        tried = near.select(*KEY, "x.start", "x.window")
        exact = tried.join(_bounded(own.select("window"), "windows", "window"), "window").select(*KEY, "start", F.lit(size).alias("size"), "window").distinct()
        found = exact if found is None else found.unionByName(exact)
    if counted is None:
        counted = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *KEY)
        found = rows.where("false").select(*KEY, F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("window"))
    return counted, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and items (array of item_id) for every row of docs, with the key of the row."""
    windows = store.written(item_windows(benchmark, span), "item-windows")
    sizes = sorted((r[0] for r in windows.select("size").distinct().collect()), reverse=True)  # at most `span` of them
    counted, found = hits(docs, windows, sizes)
    found = store.written(found, "hits")
    # union of the hit windows of a document, in order of their starts
    runs = found.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("runs"))
    hit = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")), lambda acc: acc["n"])
    pairs = found.select(*KEY, "window").distinct().join(_bounded(windows.select("item_id", "window"), "items", "window"), "window").select(*KEY, F.struct("item_id").alias("item")).distinct()
    items = pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_items"), F.collect_list("item.item_id").alias("items"))
    both = store.small(store.written(runs.select(*KEY, hit.alias("n_hit")).join(items, KEY), "contaminated"), BROADCAST_ROWS // 10)
    store.discard(found, windows)
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    return counted.join(both, KEY, "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", none).alias("items"), *KEY)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def filter_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no window with any item, all columns kept; each row is judged by its own text."""
    hit = store.written(decontaminate(docs, benchmark).where("n_hit > 0").select(*KEY).distinct(), "hit-rows")
    return store.without(docs, hit, store.row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
