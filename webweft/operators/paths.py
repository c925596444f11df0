"""Breadth-first search on the edge table."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webweft.runtime import discard, scratch_path

#: Rounds of a search; each takes one level from either end.
MAX_ROUNDS = 10


class _Search:
    """The nodes seen from one end, by level, each with its smallest predecessor.

    A level is one file in the shared folder, so no plan grows with the depth.
    """

    def __init__(self, edge: DataFrame, start: int, reverse: bool):
        self.spark, self.level = edge.sparkSession, 0
        self.step = edge.select(*(F.col(c).alias(n) for c, n in zip(("dst", "src") if reverse else ("src", "dst"), ("_from", "_to"))))
        self.base = scratch_path(self.spark, "bfs")
        self.spark.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(None).cast("long").alias("pred")).write.parquet(f"{self.base}/level=0")

    def frontier(self) -> DataFrame:
        return self.spark.read.schema("id long, pred long").parquet(f"{self.base}/level={self.level}")

    def seen(self) -> DataFrame:
        return self.spark.read.schema("id long, pred long, level int").parquet(self.base)

    def expand(self, other: _Search | None = None) -> tuple[int, int | None]:
        """Go one level on: the number of nodes found, and the node at which the
        search from the other end is met, nearest to its start."""
        reached = self.frontier().select(F.col("id").alias("_from")).join(self.step, "_from").groupBy(F.col("_to").alias("id")).agg(F.min("_from").alias("pred"))
        new = reached.join(self.seen().select("id"), "id", "left_anti")
        self.level += 1
        met = F.lit(None).cast("struct<at:int,id:long>")
        if other is not None:
            there = other.seen().select(F.col("id").alias("_met"), F.col("level").alias("_at"))
            new = new.join(there, F.col("id") == F.col("_met"), "left")
            met = F.when(F.col("_met").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_met").alias("id")))
        # The level is written, counted and searched for a meeting in one job.
        seen = Observation()
        new.observe(seen, F.count(F.lit(1)).alias("found"), F.min(met).alias("met")).select("id", "pred").write.parquet(f"{self.base}/level={self.level}")
        return seen.get["found"], None if seen.get["met"] is None else seen.get["met"]["id"]

    def chain(self, node: int) -> list[int]:
        """Nodes from ``node`` back to the start, one row of each level, in one job."""
        last = self.seen().where(F.col("id") == node).select("level", F.col("pred").alias("pred_0"))
        top = last.first()["level"]
        for hop, level in enumerate(range(top - 1, 0, -1), 1):
            step = self.seen().where(F.col("level") == level).select(F.col("id").alias("_id"), F.col("pred").alias(f"pred_{hop}"))
            last = step.join(F.broadcast(last), F.col("_id") == F.col(f"pred_{hop - 1}")).drop("_id")  # one row
        row = last.first()
        return [node, *(row[f"pred_{hop}"] for hop in range(top))]


@dataclass(frozen=True)
class Path:
    """A search result: status ok, no_such_path or terminated."""

    src: int
    dst: int
    status: str
    path: list[int] | None

    @property
    def hops(self) -> int | None:
        return None if self.path is None else len(self.path) - 1

    def is_empty(self) -> bool:
        return self.path is not None and len(self.path) <= 1

    def titles(self, vertex: DataFrame) -> DataFrame:
        """``position, id, title`` of each node on the path."""
        rows = vertex.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in self.path or []]).cast("array<long>")).alias("position", "id"))
        return rows.join(vertex, "id").select("position", "id", "title").orderBy("position")


def shortest_path(vertex: DataFrame, edge: DataFrame, src: int, dst: int, max_rounds: int = MAX_ROUNDS) -> Path:
    """A shortest path by search from both ends, canonical among equals.

    Each round takes a level forward and a level back, up to 2 * ``max_rounds``
    edges; ``terminated`` says that longer paths were not looked for. Of several
    meeting nodes the one with the shortest path and then the smallest id counts,
    and every node keeps its smallest predecessor. Unknown ids raise KeyError.
    """
    known = {r[0] for r in vertex.where(F.col("id").isin(src, dst)).select("id").collect()}
    for end in (src, dst):
        if end not in known:
            raise KeyError(f"no page {end}")
    if src == dst:
        return Path(src, dst, "ok", [src])
    down, up = _Search(edge, src, False), _Search(edge, dst, True)
    try:
        for _ in range(max_rounds):
            for side, other in ((down, up), (up, down)):
                found, met = side.expand(other)
                if met is not None:
                    return Path(src, dst, "ok", down.chain(met)[::-1] + up.chain(met)[1:])
                if not found:
                    return Path(src, dst, "no_such_path", None)
        return Path(src, dst, "terminated", None)
    finally:
        discard(vertex.sparkSession, down.base)
        discard(vertex.sparkSession, up.base)


def levels(vertex: DataFrame, edge: DataFrame, start: int, reverse: bool = False, max_level: int | None = None) -> DataFrame:
    """``id, level`` of every node reachable from ``start``, itself at level 0;
    ``reverse`` follows links backwards."""
    if vertex.where(F.col("id") == start).isEmpty():
        raise KeyError(f"no page {start}")
    search = _Search(edge, start, reverse)
    while (max_level is None or search.level < max_level) and search.expand()[0]:
        pass
    return search.seen().select("id", "level")


def paths_table(spark, found: list[Path]) -> DataFrame:
    """Results as rows ``src, dst, status, path, hops``."""
    rows = [(p.src, p.dst, p.status, p.path, p.hops) for p in found]
    return spark.createDataFrame(rows, "src long, dst long, status string, path array<long>, hops int")


def cached_paths(graph, pairs: list[tuple[int, int]], cache: DataFrame | None = None, worth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Answers for ``pairs`` from ``cache`` where it has them and by search where not,
    and the cache with the new answers of at least ``worth`` hops."""
    spark = graph.vertex.sparkSession
    asked = spark.createDataFrame(pairs, "src long, dst long")
    cache = paths_table(spark, []) if cache is None else cache
    hits = cache.join(asked, ["src", "dst"], "left_semi")
    misses = [(r["src"], r["dst"]) for r in asked.distinct().join(cache, ["src", "dst"], "left_anti").collect()]
    new = paths_table(spark, [shortest_path(graph.vertex, graph.edge, *m) for m in misses])
    return hits.unionByName(new), cache.unionByName(new.where(F.col("hops") >= worth))


def recent_paths(history: list[Path], limit: int = 10) -> list[Path]:
    """The last searches that found a path, each pair once, newest first."""
    latest = {(p.src, p.dst): p for p in reversed(history) if p.path is not None}
    newest = dict.fromkeys((p.src, p.dst) for p in reversed(history) if p.path is not None)
    return [latest[k] for k in newest][:limit]


def survey(graph, pairs: list[tuple[int, int]]) -> DataFrame:
    """``src, dst, status, path, hops, millis`` of a search for each pair, the fastest first."""
    rows = []
    for src, dst in pairs:
        begun = time.perf_counter()
        found = shortest_path(graph.vertex, graph.edge, src, dst)
        rows.append((src, dst, found.status, found.path, found.hops, 1000 * (time.perf_counter() - begun)))
    schema = "src long, dst long, status string, path array<long>, hops int, millis double"
    return graph.vertex.sparkSession.createDataFrame(rows, schema).orderBy("millis", "src", "dst")


def longest_paths(cache: DataFrame, limit: int = 10) -> DataFrame:
    """The longest cached searches."""
    return cache.orderBy(F.desc("hops"), "src", "dst").limit(limit)
