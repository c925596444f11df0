"""What must hold of a graph, as tables of violations: empty tables pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_edges(edge: DataFrame) -> DataFrame:
    return edge.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src", "dst")


def loose_ends(vertex: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges of which an end is no vertex, redirects among them."""
    ends = edge.select("src", "dst", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(vertex.select("id"), "id", "left_anti").select("src", "dst").distinct()


def repeated_titles(title: DataFrame) -> DataFrame:
    return title.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title")


def stray_titles(vertex: DataFrame, title: DataFrame) -> DataFrame:
    """Titles that lead to no vertex."""
    return title.join(vertex.select("id"), "id", "left_anti").select("title")


def unnamed_vertices(vertex: DataFrame, title: DataFrame) -> DataFrame:
    """Vertices whose own title is not in the title table; of vertices that share a
    title it leads to one."""
    return vertex.join(title.where("kind <> 'caps'").select("title"), "title", "left_anti").select("id")


def asymmetric(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Links that one of two edge tables has and the other has not."""
    here, there = children.select("src", "dst"), parents.select("src", "dst")
    return here.exceptAll(there).unionByName(there.exceptAll(here))


def violations(vertex: DataFrame, edge: DataFrame, title: DataFrame) -> DataFrame:
    """``rule, violations``: one row per rule."""
    rules = {
        "duplicate_edges": duplicate_edges(edge),
        "loose_ends": loose_ends(vertex, edge),
        "repeated_titles": repeated_titles(title),
        "stray_titles": stray_titles(vertex, title),
        "unnamed_vertices": unnamed_vertices(vertex, title),
    }
    out = None
    for name, rows in rules.items():
        part = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
