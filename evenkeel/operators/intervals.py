"""Byte-interval samples of sorted runs, and their alignment into disjoint partitions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = "begin {key}, begin_recs long, begin_bytes long, mid_keys long, mid_recs long, mid_bytes long, end {key}, end_recs long, end_bytes long"


@dataclass(frozen=True)
class Interval:
    """Statistics of the first key, of the keys between, and of the last key (none if there is one key)."""

    begin: object
    begin_recs: int
    begin_bytes: int
    mid_keys: int = 0
    mid_recs: int = 0
    mid_bytes: int = 0
    end: object = None
    end_recs: int = 0
    end_bytes: int = 0

    @property
    def length(self) -> int:
        return self.begin_bytes + self.mid_bytes + self.end_bytes

    def then(self, other: "Interval") -> "Interval":
        """This interval and the one that follows it as one."""
        keys, recs, size = self.mid_keys, self.mid_recs, self.mid_bytes
        if self.end is not None:
            keys, recs, size = keys + 1, recs + self.end_recs, size + self.end_bytes
        if other.end is None:
            return replace(self, mid_keys=keys, mid_recs=recs, mid_bytes=size, end=other.begin, end_recs=other.begin_recs, end_bytes=other.begin_bytes)
        return replace(self, mid_keys=keys + 1 + other.mid_keys, mid_recs=recs + other.begin_recs + other.mid_recs, mid_bytes=size + other.begin_bytes + other.mid_bytes, end=other.end, end_recs=other.end_recs, end_bytes=other.end_bytes)


def compacted(items: list, target: int, size, join) -> list:
    """Followers are joined while they fit; one that doesn't is joined if it overshoots by no more than the room left."""
    out: list = []
    for item in items:
        room = target - size(out[-1]) if out else 0
        if out and room > 0 and size(item) <= 2 * room:
            out[-1] = join(out[-1], item)
        else:
            out.append(item)
    return out


class KeyPool:
    """Intervals of about `target` bytes from a run sorted by key.

    While the interval size is below the target, closed intervals are buffered;
    twice `least` of them double the size and are joined. So a short run still
    gives enough samples and a long one no more than it needs.
    """

    def __init__(self, target: int, least: int = 10, start: int = 8192):
        self.target, self.least, self.start = max(1, target), least, start
        self.size = min(start, self.target)
        self.buffer: list[Interval] = []
        self.now: Interval | None = None

    def add(self, key, records: int, size: int) -> Iterator[Interval]:
        """A whole key group; yields the intervals that are final."""
        group = Interval(key, records, size)
        if self.now is not None and (size >= self.size or self.now.length >= self.size):
            yield from self._close()
        self.now = group if self.now is None else self.now.then(group)

    def _close(self) -> Iterator[Interval]:
        done, self.now = self.now, None
        if self.size >= self.target:
            yield done
            return
        self.buffer.append(done)
        if len(self.buffer) >= 2 * self.least:
            self.size = min(2 * self.size, self.target)
            self.buffer = compacted(self.buffer, self.size, lambda x: x.length, Interval.then)
            if self.size >= self.target:
                yield from self.buffer
                self.buffer = []

    def finish(self) -> Iterator[Interval]:
        """The rest of a run, with its last interval; the pool then begins anew."""
        rest = [*self.buffer, *([self.now] if self.now is not None else [])]
        self.size, self.buffer, self.now = min(self.start, self.target), [], None
        yield from rest


@dataclass(frozen=True)
class Slice:
    offset: int
    last_offset: int
    num_recs: int

    @property
    def length(self) -> int:
        return self.last_offset - self.offset


class RecordPool:
    """The same over records at offsets; a slice may end only after a record that can be split from its follower."""

    def __init__(self, target: int, least: int = 10, start: int = 4096):
        self.target, self.least, self.start = max(1, target), least, start

    def slices(self, records: Iterable[tuple[int, int, bool]]) -> list[Slice]:
        """records: offset, length, splitable."""
        size, done, now, may_end = min(self.start, self.target), [], None, True
        buffer: list[Slice] = []
        for offset, length, splitable in records:
            if now is not None and may_end and (length >= size or now.length >= size):
                buffer.append(now)
                now = None
                if size >= self.target:
                    done, buffer = done + buffer, []
                elif len(buffer) >= 2 * self.least:
                    size = min(2 * size, self.target)
                    buffer = compacted(buffer, size, lambda s: s.length, lambda a, b: Slice(a.offset, b.last_offset, a.num_recs + b.num_recs))
            now = Slice(offset, offset + length, 1) if now is None else Slice(now.offset, offset + length, now.num_recs + 1)
            may_end = splitable
        return [*done, *buffer, *([now] if now is not None else [])]


def sample_keys(histogram: DataFrame, key: str, target: int, least: int = 10, start: int = 8192) -> DataFrame:
    """Intervals of a key histogram (key, records, bytes): ranges of keys are sorted runs, a task each."""
    kind = histogram.schema[key].dataType.simpleString()

    def run(batches):
        pool, out = KeyPool(target, least, start), []
        for pdf in batches:
            for k, r, b in zip(pdf[key], pdf["records"], pdf["bytes"]):
                out += pool.add(k, int(r), int(b))
            if len(out) > 10_000:
                yield pd.DataFrame([vars(x) for x in out])
                out = []
        out += pool.finish()
        if out:
            yield pd.DataFrame([vars(x) for x in out])

    runs = histogram.select(key, "records", "bytes").repartitionByRange(key).sortWithinPartitions(key)
    return runs.mapInPandas(run, INTERVALS.format(key=kind))


def sample_runs(df: DataFrame, run: str, key: str, target: int, least: int = 10, start: int = 8192) -> DataFrame:
    """The same for runs that exist already, such as map outputs: rows (run, key, records, bytes), a run in one task, any number of runs in it."""
    kind, run_kind = (df.schema[c].dataType.simpleString() for c in (key, run))

    def each(batches):
        pool, now, out = KeyPool(target, least, start), None, []
        for pdf in batches:
            for r, k, n, b in zip(pdf[run], pdf[key], pdf["records"], pdf["bytes"]):
                if now is not None and r != now:
                    out += [(now, x) for x in pool.finish()]
                now = r
                out += [(r, x) for x in pool.add(k, int(n), int(b))]
            if len(out) > 10_000:
                yield pd.DataFrame([{run: r} | vars(x) for r, x in out])
                out = []
        if now is not None:
            out += [(now, x) for x in pool.finish()]
        if out:
            yield pd.DataFrame([{run: r} | vars(x) for r, x in out])

    dealt = df.select(run, key, "records", "bytes").repartition(run).sortWithinPartitions(run, key)
    return dealt.mapInPandas(each, f"{run} {run_kind}, " + INTERVALS.format(key=kind))


def closed_ranges(intervals: DataFrame) -> DataFrame:
    """A local scan's output: each interval as a range that holds both its ends, with all its keys, records and bytes."""
    one = F.col("end").isNull()
    total = lambda c: (F.col(f"begin_{c}") + F.col(f"mid_{c}") + F.coalesce(F.col(f"end_{c}"), F.lit(0))).cast("long")
    keys = (1 + F.col("mid_keys") + F.when(one, 0).otherwise(1)).cast("long")
    kept = [c for c in intervals.columns if c not in INTERVALS.replace(" {key}", " long").replace(",", " ").split()]
    return intervals.select(*kept, F.col("begin").alias("min_key"), F.coalesce("end", "begin").alias("max_key"), keys.alias("num_keys"), total("recs").alias("num_recs"), total("bytes").alias("tot_bytes"))


@dataclass(frozen=True)
class KeyPartition:
    min_key: object
    max_key: object
    min_excl: bool
    max_excl: bool
    num_keys: int
    num_recs: int
    tot_bytes: int


def _half_up(x: float) -> int:
    return max(0, math.floor(x + 0.5))


def align(intervals: list[Interval]) -> list[KeyPartition]:
    """Disjoint partitions in key order from overlapping intervals of several runs.

    Each end that was sighted becomes a point; what lies between two neighbouring
    points is an open partition. An interval's middle records are spread evenly
    over its keys: those it shares with points inside it go to the points, the
    rest evenly to the gaps.
    """
    points = sorted({k for i in intervals for k in (i.begin, i.end) if k is not None})
    place = {k: n for n, k in enumerate(points)}
    gaps = len(points)
    # changes of the running sums at each point: of the gaps' shares, and of the points' shares
    open_recs, open_bytes, per_recs, per_bytes = ([0.0] * (gaps + 1) for _ in range(4))
    at_recs, at_bytes, density = [0.0] * gaps, [0.0] * gaps, [[] for _ in range(gaps)]
    for i in intervals:
        low = place[i.begin]
        at_recs[low] += i.begin_recs
        at_bytes[low] += i.begin_bytes
        if i.end is None:
            continue
        high = place[i.end]
        at_recs[high] += i.end_recs
        at_bytes[high] += i.end_bytes
        inside = high - low - 1
        per_key = (i.mid_recs / i.mid_keys, i.mid_bytes / i.mid_keys) if i.mid_keys else (0.0, 0.0)
        for sums, total, share, points_sums in ((open_recs, i.mid_recs, per_key[0], per_recs), (open_bytes, i.mid_bytes, per_key[1], per_bytes)):
            each = (total - share * inside) / (inside + 1)
            sums[low] += each
            sums[high] -= each
            points_sums[low + 1] += share
            points_sums[high] -= share
        if 2 * inside < i.mid_keys:
            density[low].append((high, (i.mid_keys - inside) / (inside + 1)))
    out, live = [], []
    sums = [0.0] * 4
    for n, key in enumerate(points):
        sums[2] += per_recs[n]
        sums[3] += per_bytes[n]
        out.append(KeyPartition(key, key, False, False, 1, _half_up(at_recs[n] + sums[2]), _half_up(at_bytes[n] + sums[3])))
        sums[0] += open_recs[n]
        sums[1] += open_bytes[n]
        live = [x for x in live if x[0] > n] + density[n]
        if n + 1 < gaps:
            keys = math.ceil(max((d for _, d in live), default=0.0) - 1e-9)
            out.append(KeyPartition(key, points[n + 1], True, True, keys, _half_up(sums[0]), _half_up(sums[1])))
    return [p for p in out if p.tot_bytes > 0]
