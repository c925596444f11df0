"""A link graph as three tables, and the questions it answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.operators import checks, metrics
from webweft.operators.ancestors import Ancestors, ancestors
from webweft.operators.pagerank import pagerank, rank_report
from webweft.operators.paths import Path, levels, shortest_path
from webweft.operators.resolve import resolved
from webweft.operators.titles import look_up, title_table


@dataclass(frozen=True)
class LinkGraph:
    vertex: DataFrame  # id, title
    edge: DataFrame  # src, dst; distinct
    title: DataFrame  # title, id, kind; titles unique

    @classmethod
    def build(cls, page: DataFrame, redirect: DataFrame, pagelink: DataFrame) -> LinkGraph:
        """From the three tables of a dump. Empty redirects or links make a graph without them."""
        vertex, edge, address = resolved(page, redirect, pagelink)
        return cls(vertex, edge, title_table(address))

    def cache(self) -> LinkGraph:
        return LinkGraph(self.vertex.cache(), self.edge.cache(), self.title.cache())

    def size(self) -> int:
        return self.vertex.count()

    def children(self, id: int) -> DataFrame:
        return self.edge.where(F.col("src") == id).select(F.col("dst").alias("id"))

    def parents(self, id: int) -> DataFrame:
        return self.edge.where(F.col("dst") == id).select(F.col("src").alias("id"))

    def contains(self, id: int) -> bool:
        return not self.vertex.where(F.col("id") == id).isEmpty()

    def title_of(self, id: int) -> str:
        row = self.vertex.where(F.col("id") == id).first()
        if row is None:
            raise KeyError(f"no page {id}")
        return row["title"]

    def resolve(self, title: str) -> int | None:
        asked = self.title.sparkSession.range(1).select(F.lit(title).alias("query"))
        return look_up(self.title, asked).first()["id"]

    def shortest_path(self, src: int, dst: int, **options) -> Path:
        return shortest_path(self.vertex, self.edge, src, dst, **options)

    def levels(self, start: int, **options) -> DataFrame:
        return levels(self.vertex, self.edge, start, **options)

    def ancestors(self, dst: int) -> Ancestors:
        return ancestors(self.vertex, self.edge, dst)

    def ranks(self, **options) -> DataFrame:
        return rank_report(pagerank(self.vertex, self.edge, **options)[0], self.vertex)

    def redundancy(self) -> int:
        return metrics.neighbor_redundancy(self.edge).first()[0]

    def violations(self) -> DataFrame:
        return checks.violations(self.vertex, self.edge, self.title)
