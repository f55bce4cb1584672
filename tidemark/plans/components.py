"""Connected components by alternating star contractions (Kiveris et al. 2014).

Each step is a minimum per node and a join on the node: no neighbour list is ever
collected, so a hub with a third of the edges is one aggregation state. Rounds
grow with the logarithm of the graph, and each round is written to the shared
folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    lowest = lowest.select("u", F.least("u", "m").alias("m"))
    joined = both.join(lowest, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def shortened(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst): edges that connect the same nodes, those of long ways that lie in one batch of rows replaced by one step to its lowest node."""

    def run(batches):
        for pdf in batches:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
                low, high = sorted((find(a), find(b)))
                root[high] = low
            yield pd.DataFrame({"src": list(root), "dst": [find(x) for x in list(root)]}, dtype="int64")

    return edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).mapInPandas(run, "src long, dst long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes with an edge appear. ``edges`` is computed once."""
    edges = settle(edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct(), "edges")
    current = edges.filter("a <> b")
    before = None
    while True:
        current = settle(_star(_star(current, True), False), "stars")
        state = current.agg(F.count(F.lit(1)).alias("n"),
                            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    known = members.unionByName(roots)
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)
