"""Connected components of a graph given by its edges, as many rounds of grouped aggregation and joins as the graph needs.

Each partition first reduces its own edges by union-find to a forest of stars; then large-star and small-star steps alternate
until nothing changes. No step holds a node's neighbours together: the least neighbour is a partial aggregate, and the edges of
a node with very many of them are split by the planner's skew joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.scratch import Scratch


class UnionFind:
    """Sets of any orderable keys; a root is the least key of its set."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, root = self.up, x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x] = root
            x = above
        return root

    def union(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


#: Edges that a partition's union-find takes at once.
LOCAL_EDGES = 1_000_000


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets, n = UnionFind(), 0
    for b in batches:
        for x, y in zip(b["u"], b["v"], strict=True):
            sets.union(x, y)
        n += len(b)
        if n > LOCAL_EDGES:
            yield pd.DataFrame(sets.stars(), columns=["u", "v"])
            sets, n = UnionFind(), 0
    yield pd.DataFrame(sets.stars(), columns=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller node here."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v) -> node, root: every node that has an edge to another, except the roots themselves; root is the least node."""
    kind = edges.schema["u"].dataType.simpleString()
    e = scratch.cut(edges.where("u <> v").select("u", "v").mapInPandas(_local, f"u {kind}, v {kind}").distinct())
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    now = sign(e)
    while now[0]:
        big = _large_star(e)
        after = scratch.cut(_small_star(big))
        scratch.drop(e)
        e, last = after, now
        now = sign(e)
        if now == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
