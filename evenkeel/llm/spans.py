"""Spans of regular expressions in whole texts, as column expressions.

`matches` gives the leftmost non-overlapping matches of a pattern with their
places in code points: the matched strings and the strings between them are
taken by JVM passes over the text, and running sums of their lengths give the
places. Sums run over blocks of BLOCK matches, so that a text with a million
matches costs no square of that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,what:string,before:string>"
BLOCK = 256
BEFORE = 40


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, at: Column, step, kind: str, make) -> Column:
    """make(place, item) for each item, where the place is stepped from `at` on over the items before."""
    return F.aggregate(
        items,
        F.struct(at.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out")),
        lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(make(acc["at"], x))).alias("out")),
        lambda acc: acc["out"],
    )


def running(items: Column, at: Column, step, kind: str, make) -> Column:
    """The same for any number of items: steps must add up or be maxima, so that blocks can be stepped over whole."""

    def long(all_items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_items, b * BLOCK + 1, BLOCK))
        placed = F.aggregate(
            blocks,
            F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda acc, b: F.struct(F.aggregate(b, acc["at"], step).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(blocks, placed, lambda b, low: _running(b, low, step, kind, make)))

    return F.when(F.size(items) <= BLOCK, _running(items, at, step, kind, make)).otherwise(long(items))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def pieces(text: Column):
    """piece(blocks, low, high): the code points [low, high) of the text, in time linear in their number and BLOCK."""

    def piece(blocks: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        within = F.substring(block(first), (low % BLOCK + 1).cast("int"), (high - low).cast("int"))
        middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        across = F.concat(F.substring(block(first), (low % BLOCK + 1).cast("int"), F.lit(BLOCK)), middle, F.substring(block(last), F.lit(1), (high % BLOCK).cast("int")))
        return F.when(high <= low, F.lit("")).when(first == last, within).otherwise(across)

    return piece


def matches(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """array<struct<start, end, what, before>> of the matches of `pattern` (Java syntax, never empty).

    `needs` is a cheap condition without which a text has no match; null text has none.
    `before` holds up to BEFORE characters between the match and the one before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    items = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        found,
        lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("what"), F.when(F.char_length(g) <= BEFORE, g).otherwise(F.right(g, F.lit(BEFORE))).alias("before")),
    )
    step = lambda at, x: at + x["gap"] + x["size"]
    place = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["what"].alias("what"), x["before"].alias("before"))
    spans = bound(items, lambda x: running(x, F.lit(0), step, SPAN, place))
    some = text.rlike(pattern) if needs is None else needs
    return F.when(some & text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined by start, then rank, of array<struct<start, rank, kind, end>>."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
