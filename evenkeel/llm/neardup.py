"""Near-duplicate documents by b-bit MinHash.

1. Signatures. PERMUTATIONS minima of each document's shingle set; the low BITS
   bits of each are packed, and the full minima give BANDS band hashes of ROWS
   each. A pair at the threshold of 0.75 shares no band with probability
   (1 - 0.75^4)^32 < 6e-6.
2. Classes. Documents with equal sets are one class, represented by the smallest
   doc_id; only representatives go on.
3. Candidates and estimates. In each bucket (band hash) the bit counts of the
   packed signatures estimate similarities, corrected for chance collisions of
   BITS bits. Pairs over MARGIN (five standard errors) below the threshold are
   dropped; of the others a spanning forest is kept, so a bucket of n members
   makes under n pairs, and the connected groups of these pairs hold every link.
4. Verification on full sets, within each group: the exact intersections of all
   members come from one product of bit rows, and a spanning forest of the links
   is kept, which has the same components as all links.
5. Components of the verified links.

Groups and buckets of any size are whole: beyond BLOCK members they are cut into
blocks (`linked`). Every block also holds PIVOTS members of the whole group, so
what is like one of them hangs together at once; then only members outside the
group's largest part (which a link could still join) meet the other blocks. A
group of n copies with u members unlike its pivots makes n + u * n / BLOCK rows.

Defined results: null or wordless text has no shingles and no links. doc_id is
the key: rows that repeat it are versions of one document and share its
component, each with its own n_shingles. Rows without doc_id are kept and have
no component. Other columns are ignored (and kept by `deduplicate`). An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches, shingles, store
from .components import components
from .token_files import _blocks

PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
NEED, OF = 75, 100
MARGIN = 0.2
BLOCK = 300
PIVOTS = 6
BLOCK_SHINGLES = 2_000

_random = np.random.RandomState(20_240)
FACTORS = (_random.randint(0, 2**31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SHIFTS = _random.randint(0, 2**31, PERMUTATIONS).astype(np.uint32)[:, None] * np.uint32(2)
SIGNATURES = "doc_id long, n_shingles long, set_key binary, packed array<long>, bands array<long>"


def minima(shingle_set: np.ndarray) -> np.ndarray:
    x = (shingle_set >> np.uint64(17)).astype(np.uint32)
    least = np.full(PERMUTATIONS, np.uint32(2**32 - 1), np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[None, at : at + 2048] * FACTORS + SHIFTS).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima (after a mix, for they hang together), 64 / BITS to an integer."""
    low = (((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)).reshape(-1, 64 // BITS)
    return (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_hashes(least: np.ndarray) -> np.ndarray:
    rows = shingles.mixed(least.reshape(BANDS, ROWS).astype(np.uint64) + shingles.PLACES[:ROWS])
    return shingles.mixed((rows * shingles.PLACES[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


@caches.worker("words")
def _sign(batches):
    for whole in batches:
        for batch in _blocks(whole):
            sizes, keys, packs, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles.shingle_set(text)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if len(found):
                    least = minima(found)
                    packs.append(packed(least))
                    bands.append(band_hashes(least))
                else:
                    packs.append(np.empty(0, np.int64))
                    bands.append(np.empty(0, np.int64))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *x])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(packs), lists(bands)], names=["doc_id", "n_shingles", "set_key", "packed", "bands"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _groups(batches, columns: tuple[str, ...]):
    """Whole groups of rows with equal `key` from batches sorted by it: dicts of arrays."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {"key": batch.column("key").to_numpy()}
        for name in columns:
            column = batch.column(name)
            if pa.types.is_list(column.type):
                now[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            elif pa.types.is_string(column.type):
                now[name] = np.array(column.to_pylist(), object)
            else:
                now[name] = column.to_numpy(zero_copy_only=False)
        if not len(batch):
            continue
        if rest is not None:
            now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
        cuts = np.flatnonzero(np.diff(now["key"])) + 1
        for low, high in zip([0, *cuts[:-1]], cuts):
            yield {k: v[low:high] for k, v in now.items()}
        last = cuts[-1] if len(cuts) else 0
        rest = {k: v[last:] for k, v in now.items()}
    if rest is not None:
        yield rest


class Forest:
    """A spanning forest of links between the members of a block."""

    def __init__(self, n: int):
        self.label, self.pairs = np.arange(n), []

    def add(self, k: int, near: np.ndarray) -> None:
        """Members `near` are linked with member k."""
        while len(near):
            near = near[self.label[near] != self.label[k]]
            if len(near):
                self.pairs.append((k, int(near[0])))
                self.label[self.label == self.label[near[0]]] = self.label[k]


ONES = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
LEAST_SAME = (NEED / OF - MARGIN) * (1 - 2.0**-BITS) + 2.0**-BITS  # of the bit groups, for an estimate over NEED / OF - MARGIN


def same_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal BITS-bit minima in packed signatures."""
    d = a ^ b
    d |= d >> np.uint64(2)  # BITS is 4: any set bit of a cell reaches its lowest
    d |= d >> np.uint64(1)
    return 1 - np.bitwise_count(d & ONES).sum(axis=-1, dtype=np.int64) / PERMUTATIONS


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that packed signatures show, corrected for chance collisions."""
    return (same_share(a, b) - 2.0**-BITS) / (1 - 2.0**-BITS)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


@caches.worker()
def _estimate(batches):
    """Spanning forests of the pairs of each bucket that may be similar enough."""
    out: list[tuple[int, int]] = []
    for group in _groups(batches, ("rep", "packed")):
        ids, packs = group["rep"], group["packed"].view(np.uint64)
        forest = Forest(len(ids))
        for k in range(len(ids) - 1):
            forest.add(k, k + 1 + np.flatnonzero(same_share(packs[k], packs[k + 1 :]) >= LEAST_SAME))
        out += [(int(ids[x]), int(ids[y])) for x, y in forest.pairs]
        if len(out) > 100_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def linked_rows(sets: list[np.ndarray]):
    """For each set the later ones that are similar enough: pairs of a place and an array of places."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yield 0, np.arange(1, 2)[OF * shared >= NEED * (sizes[1:] + sizes[0] - shared)]
        return
    # a bit row for each member over the shingles that two or more of them have
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    width = -(-int((counts > 1).sum()) // 64)
    rows = np.zeros((len(sets), max(1, width)), np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    used = counts[inverse] > 1
    at = place[inverse[used]]
    np.bitwise_or.at(rows, (owner[used], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    for k in range(len(sets) - 1):
        # sizes that can't reach the threshold are left out first
        later = k + 1 + np.flatnonzero((OF * np.minimum(sizes[k + 1 :], sizes[k]) >= NEED * np.maximum(sizes[k + 1 :], sizes[k])) & (sizes[k + 1 :] > 0))
        own = np.flatnonzero(rows[k])
        shared = np.bitwise_count(rows[later][:, own] & rows[k, own]).sum(axis=1, dtype=np.int64) if len(later) else later
        yield k, later[OF * shared >= NEED * (sizes[later] + sizes[k] - shared)]


@caches.worker("words")
def _verify(batches):
    """Spanning forests of the verified links of each block."""
    out: list[tuple[int, int]] = []
    for group in _groups(batches, ("doc_id", "text")):
        sets = [shingles.shingle_set(x) for x in group["text"]]
        forest = Forest(len(sets))
        for k, near in linked_rows(sets) if len(sets) > 1 else ():
            forest.add(k, near)
        out += [(int(group["doc_id"][x]), int(group["doc_id"][y])) for x, y in forest.pairs]
        if len(out) > 100_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def linked(rows: DataFrame, check) -> DataFrame:
    """Links (a, b) that join all members of each group that are linked in it, as a written table.

    rows: group, id and weight (1 for a usual member). check(rows of key and id) gives a written table of the links
    between members with equal keys, or of a spanning forest of them.
    """
    pivots = [F.min(F.struct(F.xxhash64(F.lit(k), "id"), "id")).getField("id").alias(f"pivot{k}") for k in range(PIVOTS)]
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks"), *pivots).where("n > 1")
    sizes = store.written(sizes, "group-sizes")
    placed = store.written(rows.join(sizes.select("group", "blocks"), "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "blocks")
    key = lambda *parts: F.xxhash64("group", *parts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = sizes.where("blocks > 1")
    shared = large.withColumn("own", every("blocks")).select(key("own", F.lit(-1)).alias("key"), F.explode(F.array_distinct(F.array(*[f"pivot{k}" for k in range(PIVOTS)]))).alias("id"))
    within = placed.select(key("own", F.lit(-1)).alias("key"), "id")
    if not large.limit(1).count():
        return check(within)
    links = check(within.unionByName(shared).distinct())
    open_ = placed.where("blocks > 1")
    ids = store.written(open_.select("id").distinct(), "open-ids")
    inner = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    parts = open_.join(components(inner).withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    counts = parts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("group").agg(F.max(F.struct("n", "part")).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("group", F.col("x.part").alias("largest"))
    rest = store.written(parts.join(largest, "group").withColumn("minor", F.col("part") != F.col("largest")), "rest")
    minors = rest.where("minor").groupBy("group").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("minors"))
    both = rest.join(minors, "group")
    # every block of minor members meets every block of the group
    theirs = both.withColumn("m", every("minors")).select(key("own", "m").alias("key"), "id")
    own_minor = F.pmod(F.xxhash64("id", F.lit(1)), F.col("minors")).cast("int")
    spread = both.where("minor").withColumn("to", every("blocks")).where("to <> own").select(key("to", own_minor).alias("key"), "id")
    out = store.written(links.unionByName(check(theirs.unionByName(spread))), "links")
    store.discard(links, placed, sizes, ids, rest)
    return out


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(id, component): the groups of representatives that may be linked."""
    members = reps.select("rep", F.explode("bands").alias("hash"))
    shared = members.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    rows = store.written(members.join(shared, "hash").select(F.col("hash").alias("group"), F.col("rep").alias("id"), F.lit(1.0).alias("weight")), "buckets")

    def estimated(keyed: DataFrame) -> DataFrame:
        packs = keyed.join(reps.select(F.col("rep").alias("id"), "packed"), "id")
        dealt = packs.repartition("key").sortWithinPartitions("key").select("key", F.col("id").alias("rep"), "packed")
        return store.written(dealt.mapInArrow(_estimate, "a long, b long").distinct(), "estimated")

    return components(linked(rows, estimated))


def verified(docs: DataFrame):
    """check(rows of key and id): links (a, b) within each key, by the full sets of the documents."""

    def check(keyed: DataFrame) -> DataFrame:
        # while the members are few, the other texts stay where they are
        keyed = store.small(store.written(keyed, "members"))
        texts = _texts(docs).join(keyed, F.col("doc_id") == F.col("id")).select("key", "doc_id", "text")
        dealt = texts.repartition("key").sortWithinPartitions("key")
        return store.written(dealt.mapInArrow(_verify, "a long, b long").distinct(), "verified")

    return check


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the classes (set_key, rep, ...), and a spanning forest of the links (a, b) of representatives."""
    signed = store.written(_texts(docs).mapInArrow(_sign, SIGNATURES), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    first = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "packed", "bands")).alias("x"))
    reps = store.written(first.select("set_key", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("size"), F.col("x.packed").alias("packed"), F.col("x.bands").alias("bands")), "classes")
    weight = F.greatest(F.lit(1.0), F.max("size") / BLOCK_SHINGLES)  # a block is bounded in members and in shingles
    groups = candidate_groups(reps).join(reps.select(F.col("rep").alias("id"), "size"), "id").groupBy("id", F.col("component").alias("group")).agg(weight.alias("weight"))
    return signed, reps, linked(store.written(groups, "groups"), verified(docs))


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    signed, reps, links = link(docs)
    # rows that repeat a doc_id with other texts join their classes
    versions = signed.where("n_shingles > 0 and doc_id is not null").join(reps.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    found = components(links.unionByName(versions))
    rows = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, with all columns: a row with the smallest doc_id; rows without doc_id stay."""
    dropped = store.written(clusters(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return store.without(docs, dropped, [docs["doc_id"].cast("long")])
