"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node of
    its component. Null ends and loops are ignored. Each round is written to the shared
    folder; only a count and a checksum come to the driver. Minima are pre-aggregated, and
    the joins on a hub's key can be split by the engine."""
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(first.select("a", F.col("m").alias("b"))).distinct())
        new = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def spanning_links(a, b) -> dict[int, int]:
    """Smallest member of its component for each node of the links a[i] - b[i], in one task."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(up)}
