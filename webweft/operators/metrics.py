"""Counts and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_counts(page: DataFrame, redirect: DataFrame, pagelink: DataFrame) -> DataFrame:
    """``pages, redirects, redirect_rows, pagelink_rows``."""
    counted = page.agg(F.count_if(~F.col("is_redirect")).alias("pages"), F.count_if("is_redirect").alias("redirects"))
    return counted.crossJoin(redirect.agg(F.count(F.lit(1)).alias("redirect_rows"))).crossJoin(pagelink.agg(F.count(F.lit(1)).alias("pagelink_rows")))  # one row each


def degree(vertex: DataFrame, edge: DataFrame, side: str) -> DataFrame:
    """``id, degree`` of every vertex: links out of it (side ``src``) or into it (``dst``)."""
    counts = edge.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return vertex.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_top(vertex: DataFrame, edge: DataFrame, side: str, limit: int = 10) -> DataFrame:
    """``id, title, degree`` of the pages with most links; the first is the fattest."""
    top = edge.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(limit)
    return top.join(vertex, "id").select("id", "title", "degree")


def without(vertex: DataFrame, edge: DataFrame, side: str) -> DataFrame:
    """``id, title`` of vertices without links out (``src``: dangling) or in (``dst``: orphans)."""
    return vertex.join(edge.select(F.col(side).alias("id")), "id", "left_anti").select("id", "title")


def self_loops(edge: DataFrame) -> DataFrame:
    return edge.where("src = dst").select(F.col("src").alias("id"))


def neighbor_redundancy(edge: DataFrame) -> DataFrame:
    """``redundancy``: over all pages, neighbours that are parent and child. A mutual
    pair counts twice, a self-loop once. Pairs in one order meet in one group, so
    the edges are shuffled once."""
    groups = edge.groupBy(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), 1).when(F.col("_n") == 2, 2).otherwise(0)), F.lit(0)).cast("long").alias("redundancy"))


def random_vertices(vertex: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """``count`` vertices, the same for the same seed."""
    return vertex.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(count)
