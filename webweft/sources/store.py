"""Graphs on disk: Parquet snapshots, JSON-lines interchange and the rank report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft import schema
from webweft.plans.graph import LinkGraph
from webweft.runtime import _filesystem

VERSION = 1


def _manifest(spark: SparkSession, path: str, content: dict | None = None) -> dict:
    fs, _ = _filesystem(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json")
    if content is None:
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    return content


def save(graph: LinkGraph, path: str) -> None:
    """Write a snapshot: edges by source and, for reverse expansion, by destination;
    titles in order, so that a look-up skips most row groups. The counts written are
    those of the files."""
    spark, parts = graph.vertex.sparkSession, int(graph.vertex.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph.vertex.write.mode("overwrite").parquet(f"{path}/vertex")
    graph.edge.repartition(parts, "src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edge")
    graph.title.repartitionByRange(parts, "title").sortWithinPartitions("title").write.mode("overwrite").parquet(f"{path}/title")
    counts = {n: spark.read.parquet(f"{path}/{n}").count() for n in ("vertex", "edge", "title")}
    _manifest(spark, path, {"version": VERSION, **counts})


def load(spark: SparkSession, path: str) -> LinkGraph:
    """Open a snapshot; tables whose counts differ from the manifest are refused."""
    manifest = _manifest(spark, path)
    if manifest["version"] != VERSION:
        raise ValueError(f"snapshot version {manifest['version']}")
    tables = {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("vertex", schema.VERTEX), ("edge", schema.EDGE), ("title", schema.TITLE))}
    for name, rows in tables.items():
        if (found := rows.count()) != manifest[name]:
            raise ValueError(f"{name}: {found} rows, the manifest has {manifest[name]}")
    return LinkGraph(**tables)


def adjacency(graph: LinkGraph) -> DataFrame:
    """One row of ``schema.ADJACENCY`` per vertex: parents only, then both, then children only."""
    children = graph.edge.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("_c"))
    parents = graph.edge.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("_p"))
    none = F.array().cast("array<bigint>")
    rows = graph.vertex.join(children, "id", "left").join(parents, "id", "left").withColumns({"_c": F.coalesce("_c", none), "_p": F.coalesce("_p", none)})
    return rows.select(
        "id", "title",
        F.concat(F.array_except("_p", "_c"), F.array_intersect("_p", "_c"), F.array_except("_c", "_p")).alias("neighbors"),
        F.size("_p").cast("long").alias("last_parent"),
        F.size(F.array_except("_p", "_c")).cast("long").alias("first_child"),
    )


def write_json(graph: LinkGraph, path: str) -> None:
    """JSON lines of ``adjacency`` and, beside them, the titles."""
    adjacency(graph).write.mode("overwrite").json(f"{path}/entries")
    graph.title.write.mode("overwrite").json(f"{path}/titles")


def read_json(spark: SparkSession, path: str) -> LinkGraph:
    rows = spark.read.schema(schema.ADJACENCY).json(f"{path}/entries")
    edge = rows.select(F.col("id").alias("src"), F.explode(F.expr("slice(neighbors, cast(first_child as int) + 1, size(neighbors))")).alias("dst"))
    return LinkGraph(vertex=rows.select("id", "title"), edge=edge, title=spark.read.schema(schema.TITLE).json(f"{path}/titles"))


def write_ranks(ranked: DataFrame, path: str) -> None:
    """The rank report: rank, id and title, best first, without a header."""
    ranked.select("rank", "id", "title").orderBy(F.desc("rank"), "id").write.mode("overwrite").csv(path, header=False)
