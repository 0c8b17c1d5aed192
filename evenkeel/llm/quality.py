"""Quality rules: text statistics and the held-out perplexity of a modified Kneser-Ney model.

The model is over runs of ORDER characters of the lower-cased words of a text,
joined by single blanks. Words of an open vocabulary are mostly new; their
characters aren't, so every probability rests on many documents. Texts are dealt
to two folds by their hashes; each language (`lang`) and fold has a model of its
own, and a text is scored with the model of the other fold, so that no text
explains itself. A model is of plain text: texts in which over one character in
PLAIN is a symbol (of SYMBOLS) are scored, but teach it nothing, or symbols that
come in runs would look like the most predictable language of all. Counting is
one pass over all documents: tasks count runs in sorted arrays and
Spark sums them over all documents. Lower orders count distinct left
continuations; discounts come from the counts of counts for each model and order;
each run's probability is interpolated with that of its suffix. What is stored is
the log probability and the back-off weight of every run of every order, as
arrays sorted by model and hash, in files of about SHARD entries. Scoring looks
up the distinct runs of a block of texts, the longest first, then with the
back-off weight of its context the next shorter one. A task reads only files of
the models that it meets and holds at most HELD_ENTRIES of their entries, so
memory is bounded whatever the model's size, and nothing is broadcast.

A document is rejected if it breaks the base rules, or if its log perplexity
lies outside its language's band: median - LOWER and median + UPPER times the
spread (the scaled median absolute deviation, at least FLOOR) of all distinct
texts of the language that pass the base rules. A language with under LEAST_TEXTS
of those has no band. Runs are counted over distinct texts as well, so that a
group of copies weighs as one document; every row is judged.

Defined results: null text has no words and fails the base rules. A null lang is
a language of its own. Where the other fold has no text of the language every
character has the same probability. Every row is judged by itself, so null or
repeated doc_ids do no harm. A log perplexity on the edge of its band is inside.
A text of any length is one row. Other columns are ignored (and kept by
`filter_quality`). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import caches, shingles, store
from .token_files import _blocks

ORDER = 4
SHARD = 2_000_000
HELD_ENTRIES = 6_000_000
HELD = 600_000
UNSEEN = -11.0
BLOCK_BYTES = 1 << 20
LEAST_WORDS, MOST_REPEATED = 50, 50
LOWER, UPPER, FLOOR, LEAST_TEXTS = 5.0, 5.0, 0.05, 20
#: Tells the runs of one order from those of another.
TAGS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(ORDER + 1)], np.uint64)
SYMBOLS, PLAIN = "#*$%&|<>", 50
STATISTICS = "row_doc long, lang string, k1 long, k2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double"


def model_id(lang: str | None, fold: int) -> int:
    """The number of a language's model over the texts of a fold."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(f"{fold}" if lang is None else f"{fold}={lang}")).view(np.int64))


def character_runs(words: list[str]) -> np.ndarray:
    """The run of ORDER characters that ends at each character, as 16 bits a character; blanks stand before the text."""
    text = " ".join(words).lower()
    points = np.frombuffer((" " * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = ((points ^ (points >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint64)
    n = len(points) - ORDER + 1
    out = points[:n].copy()
    for i in range(1, ORDER):
        out = (out << np.uint64(16)) | points[i : i + n]
    return out


def _words(text: str | None) -> list[str]:
    # bytes.split() cuts at exactly \x20 and \x09-\x0D
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if text else []


def plain(text: str) -> bool:
    """Whether a text teaches the model: at most one character in PLAIN is a symbol."""
    return PLAIN * sum(map(text.count, SYMBOLS)) <= len(text)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    return all_keys[first], np.add.reduceat(all_counts, first)


@caches.worker()
def _count(batches):
    held: dict[int, tuple[list, list]] = {}  # by model

    def emit():
        for model_, (keys, counts) in held.items():
            k, c = _merged(keys, counts)
            for low in range(0, len(k), 500_000):
                part = slice(low, low + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), model_)), pa.array(k[part].view(np.int64)), pa.array(c[part])], names=["model", "gram", "n"])

    size = 0
    for whole in batches:
        for batch in _blocks(whole, BLOCK_BYTES):
            by_model: dict[int, list[np.ndarray]] = {}
            for lang, fold, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "fold", "text"))):
                words = _words(text)
                if words and plain(text):
                    by_model.setdefault(model_id(lang, fold), []).append(character_runs(words))
            for model_, runs in by_model.items():
                keys, counts = np.unique(np.concatenate(runs), return_counts=True)
                own = held.setdefault(model_, ([], []))
                own[0].append(keys)
                own[1].append(counts.astype(np.int64))
                size += len(keys)
            if size > HELD:
                held = {m: tuple([x] for x in _merged(*v)) for m, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from emit()
                    held, size = {}, 0
    yield from emit()


def _rows(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, text, the key of lang and text, the text's fold, and with `carry` the whole row as one column."""
    rows = docs.select(F.col("doc_id").cast("long").alias("row_doc"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    k1, k2 = store.row_key(F.col("lang"), F.col("text"))
    return rows.withColumns({"k1": k1, "k2": k2, "fold": F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")})


def distinct_texts(docs: DataFrame) -> DataFrame:
    """lang, fold and text, each pair of lang and text once. Only texts whose key occurs again are grouped, so the others are not moved."""
    rows = _rows(docs)
    again = store.small(store.written(rows.groupBy("k1").count().where("count > 1").select("k1"), "repeated"))
    once = rows.join(again, "k1", "left_anti").select("lang", "fold", "text")
    return once.unionByName(rows.join(again, "k1", "left_semi").select("lang", "fold", "text").distinct())


def count_runs(docs: DataFrame) -> DataFrame:
    """model, gram, n: every run of ORDER characters with its count over all distinct texts of a language and fold."""
    counted = distinct_texts(docs).mapInArrow(_count, "model long, gram long, n long")
    return store.written(counted.groupBy("model", "gram").agg(F.sum("n").alias("n")), "runs")


def _low(order: int) -> Column:
    """The last `order` characters of a run."""
    return F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1).cast("long")) if order < ORDER else F.col("gram")


def model(counts: DataFrame) -> DataFrame:
    """model, hash, log_p, log_left of every run of every order: a written table, sorted within files.

    log_p is null for what is only a context, log_left for what is none.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = store.written(tables[order + 1].select("model", _low(order).alias("gram")).groupBy("model", "gram").agg(F.count(F.lit(1)).alias("n")), f"order-{order}")
    entries, weights, lower = None, None, None
    for order in range(1, ORDER + 1):
        table = tables[order]
        seen = lambda k: F.count_if(F.col("n") == k).cast("double")
        n = table.groupBy("model").agg(*[seen(k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("symbols"))
        y = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))).otherwise(0.0)
        # where counts of counts are missing, the discount is kept between nothing and the count
        discount = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5))))
        rates = store.written(n.select("model", "symbols", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)]), "discounts")
        if order == 1:
            # the lowest order meets the uniform distribution over its symbols and one unknown
            lower = rates.select("model", F.lit(0).cast("long").alias("suffix"), (1.0 / (F.col("symbols") + 1)).alias("below"))
            grams = lower.select("model", F.col("suffix").alias("gram"), F.col("below").alias("p"))
        context = F.shiftrightunsigned(F.col("gram"), 16)
        used = table.join(rates, "model").select("model", "gram", "n", context.alias("context"), F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = store.written(used.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left")), f"contexts-{order}")
        weights = contexts.select("model", F.col("context").alias("gram"), "left")
        known = _entries(grams, weights, order - 1)
        entries = known if entries is None else entries.unionByName(known)
        joined = used.join(contexts, ["model", "context"]).withColumn("suffix", _low(order - 1)).join(lower, ["model", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")
        grams = store.written(joined.select("model", "gram", p.alias("p")), f"p-{order}")
        lower = grams.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below"))
    entries = store.written(entries.unionByName(_entries(grams, None, ORDER)), "entries")
    shards = max(1, -(-entries.count() // SHARD))
    found = store.written(entries.repartitionByRange(shards, "model", "hash").sortWithinPartitions("model", "hash"), "model")
    store.discard(entries)
    return found


def _entries(grams: DataFrame, weights: DataFrame | None, order: int) -> DataFrame:
    """model, hash, log_p, log_left of the runs of one order."""
    rows = grams.withColumn("left", F.lit(None).cast("double")) if weights is None else grams.join(weights, ["model", "gram"], "full")
    tag = F.lit(int(TAGS[order].view(np.int64))).cast("long")
    return rows.select("model", F.col("gram").bitwiseXOR(tag).alias("hash"), F.log("p").cast("float").alias("log_p"), F.log("left").cast("float").alias("log_left"))


def file_ranges(arrays: DataFrame) -> list[tuple[str, int, int, int]]:
    """Which hashes of which model each file holds: a row for each file and model."""
    rows = arrays.groupBy(F.input_file_name().alias("path"), "model").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    return sorted(tuple(r) for r in rows.collect())


class Arrays:
    """The model's sorted hash arrays; the files read last stay in memory, up to HELD_ENTRIES."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.files: dict[int, list[tuple[str, int, int]]] = {}
        for path, model_, low, high in ranges:
            self.files.setdefault(model_, []).append((path, low, high))
        self.held: dict[str, tuple[np.ndarray, ...]] = {}

    def _load(self, path: str) -> tuple[np.ndarray, ...]:
        if path not in self.held:
            import pyarrow.parquet as pq

            from .warc import _open

            files, name = _open(path)
            found = pq.read_table(name, filesystem=files)
            while self.held and sum(len(x[0]) for x in self.held.values()) + len(found) > HELD_ENTRIES:
                del self.held[next(iter(self.held))]
            self.held[path] = tuple(found.column(c).to_numpy() for c in ("model", "hash", "log_p", "log_left"))
        self.held[path] = self.held.pop(path)  # the last one used is let go last
        return self.held[path]

    def find(self, model_: int, grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """log_p and log_left of runs of one order; NaN where there is none."""
        hashes = (grams ^ TAGS[order]).view(np.int64)
        log_p, log_left = np.full(len(grams), np.nan, np.float32), np.full(len(grams), np.nan, np.float32)
        for path, low, high in self.files.get(model_, ()):
            some = np.flatnonzero((hashes >= low) & (hashes <= high))
            if not len(some):
                continue
            models, keys, ps, lefts = self._load(path)
            first, last = np.searchsorted(models, model_), np.searchsorted(models, model_, side="right")
            at = first + np.searchsorted(keys[first:last], hashes[some])
            at[at == last] = first
            hit = keys[at] == hashes[some]
            log_p[some[hit]], log_left[some[hit]] = ps[at[hit]], lefts[at[hit]]
        return log_p, log_left

    def log_p(self, model_: int, grams: np.ndarray) -> np.ndarray:
        """The log probability of the last character of each run after those before it."""
        total, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            own = grams[open_] & np.uint64((1 << (16 * order)) - 1)
            found, _ = self.find(model_, own, order)
            known = ~np.isnan(found)
            total[open_[known]] += found[known]
            open_, own = open_[~known], own[~known]
            if not len(open_):
                return total
            if order:
                _, left = self.find(model_, own >> np.uint64(16), order - 1)
                total[open_] += np.nan_to_num(left)
        total[open_] = UNSEEN
        return total


def text_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeated = 0
    if n > 3:
        runs = shingles.runs(shingles.word_hashes(words), 3)
        _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeated = int(covered.sum())
    return n, len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def _score(ranges: list[tuple[str, int, int, int]]):
    @caches.worker("words")
    def run(batches):
        arrays = Arrays(ranges)
        for whole in batches:
            for batch in _blocks(whole, BLOCK_BYTES):
                texts = batch.column("text").to_pylist()
                carried = [batch.column("row")] if "row" in batch.schema.names else []
                mean = np.full(len(texts), np.nan)
                by_model: dict[int, list[tuple[int, np.ndarray]]] = {}
                for i, (lang, fold, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), texts)):
                    words = _words(text)
                    if words:
                        by_model.setdefault(model_id(lang, 1 - fold), []).append((i, character_runs(words)))
                for model_, some in by_model.items():
                    keys, inverse = np.unique(np.concatenate([r for _, r in some]), return_inverse=True)
                    logs = arrays.log_p(model_, keys)[inverse]
                    sizes = np.array([len(r) for _, r in some])
                    mean[[i for i, _ in some]] = -np.add.reduceat(logs, np.cumsum(sizes) - sizes) / sizes
                stats = np.array([text_statistics(t) for t in texts], np.int64).reshape(-1, 5)
                failed = (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > MOST_REPEATED * stats[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row_doc", "lang", "k1", "k2")), *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(mean, from_pandas=True), *carried],
                    names=[*(x.split()[0] for x in STATISTICS.split(", ")), *(["row"] if carried else [])],
                )

    return run


def judged(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The statistics of each row with log_perplexity, lower, upper and kept, and with `carry` the row itself as one column."""
    counts = count_runs(docs)
    arrays = model(counts)
    rows, schema = _rows(docs, carry), T._parse_datatype_string(STATISTICS)
    if carry:
        schema = schema.add("row", rows.schema["row"].dataType)
    scored = store.written(rows.mapInArrow(_score(file_ranges(arrays)), schema), "scored")
    store.discard(counts, arrays)
    with_key = scored.withColumn("key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    passed = with_key.where(~F.col("base_failed"))
    usual = store.written(passed.groupBy("key", "k1", "k2").agg(F.min("log_perplexity").alias("log_perplexity")).drop("k1", "k2"), "usual")
    middle = store.written(usual.groupBy("key").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= LEAST_TEXTS), "medians")
    off = usual.join(middle, "key").withColumn("off", F.abs(F.col("log_perplexity") - F.col("middle")))
    spread = off.groupBy("key").agg(F.first("middle").alias("middle"), F.percentile_approx("off", 0.5, 10_000).alias("mad"))
    wide = F.greatest(F.lit(FLOOR), 1.4826 * F.col("mad"))
    bands = store.written(spread.select("key", (F.col("middle") - LOWER * wide).alias("lower"), (F.col("middle") + UPPER * wide).alias("upper")), "bands")
    store.discard(usual, middle)
    inside = F.col("lower").isNull() | F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return with_key.join(bands, "key", "left").withColumn("kept", ~F.col("base_failed") & inside)


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).select(F.col("row_doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower", "upper")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; each row is judged by its own lang and text, and moved nowhere."""
    return judged(docs, carry=True).where("kept").select("row.*")
