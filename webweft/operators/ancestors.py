"""How far pages are from a page, against the direction of links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.operators.paths import levels


@dataclass(frozen=True)
class Ancestors:
    """Ancestors of a page by distance."""

    level: DataFrame  # id, level

    def histogram(self) -> DataFrame:
        """``level, pages``."""
        return self.level.groupBy("level").agg(F.count(F.lit(1)).alias("pages"))

    def summary(self) -> DataFrame:
        """``max_distance, steps, reachable``: steps counts levels, the page's own included."""
        top = F.max("level")
        return self.level.agg(top.alias("max_distance"), (top + 1).alias("steps"), F.count(F.lit(1)).alias("reachable"))

    def farthest(self, below: int | None = 20) -> DataFrame:
        """``id, level`` of the last level, if it has fewer than ``below`` pages (None: any)."""
        top = self.level.agg(F.max("level").alias("level"))
        last = self.level.join(F.broadcast(top), "level")  # one row
        if below is not None:
            last = last.join(F.broadcast(last.agg(F.count(F.lit(1)).alias("_n"))), F.col("_n") < below).drop("_n")
        return last.select("id", "level")


def ancestors(vertex: DataFrame, edge: DataFrame, dst: int) -> Ancestors:
    return Ancestors(levels(vertex, edge, dst, reverse=True))
