"""Connected components of a link table, by rounds of DataFrame joins.

Each round every vertex points to its smallest neighbour, the pointers are
followed to their roots by pointer jumping, and the links are rewritten between
roots. A round at least halves the vertices that still have links. Rows that
share a vertex meet in aggregations and joins only, so a star of any size is no
harm, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _roots(parent: DataFrame) -> DataFrame:
    """(u, p) with p followed to its root; p <= u, and a root points to itself."""
    while True:
        up = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
        higher = parent.join(up, F.col("p") == F.col("v"), "left").select("u", F.coalesce("q", "p").alias("q"), "p")
        higher = store.written(higher, "roots")
        moved = higher.where("q <> p").limit(1).count()
        parent = higher.select("u", F.col("q").alias("p"))
        if not moved:
            return parent


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in the two columns a and b of `links`; component is the smallest id."""
    links = store.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while links.limit(1).count():
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        roots = _roots(store.written(parent, "parents"))
        rounds.append(roots)
        left = roots.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = roots.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = links.join(left, "a").join(right, "b").where("pa <> pb")
        links = store.written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component"))
    found = rounds[-1]
    for roots in reversed(rounds[:-1]):
        later = found.select(F.col("u").alias("v"), F.col("p").alias("q"))
        found = roots.join(later, F.col("p") == F.col("v"), "left").select("u", F.coalesce("q", "p").alias("p"))
    return store.written(found.select(F.col("u").alias("id"), F.col("p").alias("component")), "components")
