"""Connected components by alternating large-star and small-star rounds, all in DataFrames.

Every round is written to the shared folder, so lineage stays short and lost executors cost one
round; nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import forget, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller end."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    ``edges`` has long columns u and v in any direction; loops and repeats are harmless.
    """
    state = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        after = written(_small(_large(state).distinct()).distinct(), "edges")
        forget(state.sparkSession, state)
        state = after
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


class Forest:
    """Union-find over the integers 0..n-1; ``edges`` gives one edge to the root per non-root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in range(len(self.parent)) if (r := self.find(x)) != x]
