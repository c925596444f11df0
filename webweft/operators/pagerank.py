"""PageRank with dangling pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webweft.runtime import discard, materialize, scratch_path

DAMPING = 0.85
EPSILON = 1e-8
MAX_TURNS = 500


def pagerank(vertex: DataFrame, edge: DataFrame, turns: int | None = None, damping: float = DAMPING, epsilon: float = EPSILON, max_turns: int = MAX_TURNS) -> tuple[DataFrame, int]:
    """``id, rank`` and the number of turns taken.

    Ranks start at 1/N. A page without links passes its rank to all pages alike.
    Turns go on until no rank changes by more than ``epsilon``, or for exactly
    ``turns`` turns; needing more than ``max_turns`` raises RuntimeError. Links are
    written once, in buckets by source, so that a turn shuffles ranks and their
    partial sums but never the links; it is one job, which writes the ranks to the
    shared folder and observes their change and the rank of dangling pages on the way.
    """
    spark = vertex.sparkSession
    degree = edge.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = materialize(vertex.select("id").join(degree, "id", "left"), "nodes")
    count = nodes.count()
    shape, turn, path = "id long, degree long, rank double", 0, scratch_path(spark, "rank")
    if count == 0:
        return nodes.select("id", F.lit(0.0).alias("rank")), 0
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"webweft_links_{uuid.uuid4().hex}"
    edge.select("src", "dst").repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").option("path", scratch_path(spark, "links")).saveAsTable(name)
    links, dangling = spark.table(name), F.sum(F.when(F.col("degree").isNull(), F.col("rank")))
    seen = Observation()
    nodes.select("id", "degree", F.lit(1.0 / count).alias("rank")).observe(seen, dangling.alias("lost")).write.parquet(path)
    try:
        while turns is None or turn < turns:
            now = spark.read.schema(shape).parquet(path)
            base = (1 - damping) / count + damping * (seen.get["lost"] or 0.0) / count
            given = now.where("degree IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("_part"))
            sent = links.join(given, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("_part").alias("_sum"))
            new = now.join(sent, "id", "left").select("id", "degree", (F.lit(base) + F.lit(damping) * F.coalesce("_sum", F.lit(0.0))).alias("rank"), F.col("rank").alias("_was"))
            seen, path, old = Observation(), scratch_path(spark, "rank"), path
            new.observe(seen, dangling.alias("lost"), F.max(F.abs(F.col("rank") - F.col("_was"))).alias("change")).drop("_was").write.parquet(path)
            discard(spark, old)
            turn += 1
            if turns is None:
                if seen.get["change"] <= epsilon:
                    break
                if turn >= max_turns:
                    raise RuntimeError(f"not settled after {max_turns} turns")
    finally:
        spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(shape).parquet(path).select("id", "rank"), turn


def rank_total(rank: DataFrame) -> DataFrame:
    """``total`` of all ranks, which is one but for rounding."""
    return rank.agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("total"))


def rank_report(rank: DataFrame, vertex: DataFrame) -> DataFrame:
    """``rank, id, title``, best first."""
    return rank.join(vertex, "id").select("rank", "id", "title").orderBy(F.desc("rank"), "id")
