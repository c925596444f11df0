"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.runtime import materialize

#: Edges that one task unites without rounds.
ONE_TASK = 10_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges of one task's rows united by pointers to smaller nodes."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while root.setdefault(node, node) != node:
            root[node] = node = root[root[node]]
        return node

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    if root:
        yield pd.DataFrame({"node": list(root), "component": [find(n) for n in root]})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for each node of an edge, the component being its
    smallest node. Each round halves the depth of the trees; a round's edges are
    written to the shared folder, so that none is lost with an executor. Up to
    ONE_TASK edges, by count, are united in one task instead, to the same result.
    Nodes are longs; self-loops and repeated edges do no harm, null ends are ignored.
    """
    pairs = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(pairs, "cc")
    if now.count() <= ONE_TASK:
        return materialize(now.repartition(1).mapInPandas(_united, "node long, component long"), "cc")
    state = _state(now)
    while state[0]:  # trees of depth one, however many, end after one round
        now = materialize(_small_star(_large_star(now)).distinct(), "cc")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
