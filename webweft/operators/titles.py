"""The title table and look-ups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.functions.titles import capitals, normalized


def caps_groups(addresses: DataFrame) -> DataFrame:
    """``title, id, pages``: upper-cased titles that are no titles themselves, with
    the number of pages that share them and the smallest of those."""
    upper = addresses.select(capitals(F.col("title")).alias("title"), "id")
    fresh = upper.join(addresses.select("title").distinct(), "title", "left_anti")
    return fresh.groupBy("title").agg(F.min("id").alias("id"), F.countDistinct("id").alias("pages"))


def caps_aliases(addresses: DataFrame) -> DataFrame:
    """``title, id`` of the upper-cased titles that lead to one page only."""
    return caps_groups(addresses).where("pages = 1").select("title", "id")


def caps_collisions(addresses: DataFrame) -> DataFrame:
    """``title, pages`` of the upper-cased titles that several pages share."""
    return caps_groups(addresses).where("pages > 1").select("title", "pages")


def title_table(addresses: DataFrame) -> DataFrame:
    """``title, id, kind``: pages, redirects and upper-case aliases. Titles are unique."""
    return addresses.select("title", "id", "kind").unionByName(caps_aliases(addresses).withColumn("kind", F.lit("caps")))


def look_up(title: DataFrame, asked: DataFrame, column: str = "query") -> DataFrame:
    """``query, status, id``: for each asked title the page it names.

    The normalized title is tried as it stands, then in capitals; ``status`` is
    exact, caps or unknown.
    """
    asked = asked.select(F.col(column).alias("query")).withColumn("_n", normalized(F.col("query")))
    exact = title.select(F.col("title").alias("_n"), F.col("id").alias("_exact"))
    caps = title.select(F.col("title").alias("_u"), F.col("id").alias("_caps"))
    found = asked.join(exact, "_n", "left").withColumn("_u", capitals(F.col("_n"))).join(caps, "_u", "left")
    status = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_caps").isNotNull(), "caps").otherwise("unknown")
    return found.select("query", status.alias("status"), F.coalesce("_exact", "_caps").alias("id"))


def suggest(title: DataFrame, rank: DataFrame, text: str, distance: int = 2, limit: int = 10) -> DataFrame:
    """``title, id, distance, rank`` of titles within an edit distance of ``text``,
    nearest and best ranked first."""
    near = title.withColumn("distance", F.levenshtein(F.lower("title"), F.lower(normalized(F.lit(text))), distance)).where("distance >= 0")
    return near.join(rank, "id", "left").select("title", "id", "distance", "rank").orderBy("distance", F.desc_nulls_last("rank"), "title").limit(limit)
