"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every step is an aggregate and an equi-join on the node, so a
hub is a skewed join key that adaptive execution splits, never a group held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.storage import drop, written

#: So many edges (two ids each) are worked out by one task.
SMALL_EDGES = 100_000


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """neighbours: (u, v). Link each v to the least node among u and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = neighbours.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def _local(edges: DataFrame) -> DataFrame:
    """All edges in one task, which joins their ends: for tables that are counted to be small."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:  # paths grow short
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        plain = "int64" if kind == "bigint" else object  # strings as they are, whatever pandas has for them
        yield pd.DataFrame({"node": pd.Series(nodes, dtype=plain), "component": pd.Series([root(n) for n in nodes], dtype=plain)})

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) of one ordered type, longs or strings, to (node, component): component is its least node.

    Nodes without an edge to another node are absent from the result, so are null ends.
    Self links and repeated edges are harmless. A graph of at most ``SMALL_EDGES`` different edges, which
    are counted, is worked out in one task; larger ones in rounds. Raises RuntimeError when ``max_rounds``
    pass without a fixed point (the method needs O(log^2 n) rounds).
    """
    now = written(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct(),
        "edges",
    )
    if now.count() <= SMALL_EDGES:
        out = written(_local(now), "components")
        drop(now)
        return out
    mark = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both, True).where("a <> b").distinct()
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        after = written(small.where("a <> b").distinct(), "edges")
        drop(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        # edges that stay as they are, one to a node, are stars
        if mark == (seen["n"], seen["h"]) and seen["n"] == now.select("a").distinct().count():
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
