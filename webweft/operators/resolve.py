"""From titles to page ids: redirects, links and the clean graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from webweft.runtime import discard, materialize, scratch_path


def clean_pages(page: DataFrame) -> DataFrame:
    """One row per id; the smallest title wins where the input repeats an id (dump
    order is no property of a distributed scan). Pages may share a title."""
    return page.groupBy("page_id").agg(F.min(F.struct("title", "is_redirect")).alias("p")).select("page_id", "p.*")


def named_pages(page: DataFrame) -> DataFrame:
    """One row per title: the page that the title means, which is the smallest id of those that share it."""
    return page.groupBy("title").agg(F.min(F.struct("page_id", "is_redirect")).alias("p")).select("p.page_id", "title", "p.is_redirect")


def redirect_targets(page: DataFrame, redirect: DataFrame) -> DataFrame:
    """``id, target``: what each redirect points at, resolvable or not (null).

    Rows about unknown pages or about pages that are no redirects are ignored; of
    several resolvable rows for one redirect the smallest target wins.
    """
    flagged = page.where("is_redirect").select(F.col("page_id").alias("id"))
    named = redirect.join(named_pages(page).select(F.col("title").alias("rd_title"), F.col("page_id").alias("target")), "rd_title").select(F.col("rd_from").alias("id"), "target")
    return flagged.join(named.groupBy("id").agg(F.min("target").alias("target")), "id", "left")


def redirect_closure(page: DataFrame, redirect: DataFrame) -> DataFrame:
    """``id, target``: redirects that end at a page, with that page.

    Pointer doubling: every round replaces a pointer by its pointer's pointer, so
    a chain of length n takes log2(n) rounds. A redirect that has not reached a
    page when a round settles nothing new is on a cycle or leads nowhere.
    """
    spark = page.sparkSession
    articles = page.where("NOT is_redirect").select(F.col("page_id").alias("_id"))
    steps = redirect_targets(page, redirect).where("target IS NOT NULL")
    path, seen = scratch_path(spark, "closure"), Observation()
    count = F.count_if("done").alias("done")  # observed while a round's pointers are written
    steps.join(articles, F.col("target") == F.col("_id"), "left").select("id", "target", F.col("_id").isNotNull().alias("done")).observe(seen, count).write.parquet(path)
    settled = -1
    while True:
        now = spark.read.schema("id long, target long, done boolean").parquet(path)
        if (seen.get["done"] or 0) == settled:
            return now.where("done").select("id", "target")
        settled = seen.get["done"] or 0
        ahead = now.select(F.col("id").alias("_at"), F.col("target").alias("_next"), F.col("done").alias("_done"))
        jumped = now.join(ahead, ~F.col("done") & (F.col("target") == F.col("_at")), "left").select("id", F.coalesce("_next", "target").alias("target"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done"))
        path, old, seen = scratch_path(spark, "closure"), path, Observation()
        jumped.observe(seen, count).write.parquet(path)
        discard(spark, old)


def vertices(page: DataFrame) -> DataFrame:
    """``id, title`` of the pages that are no redirects."""
    return page.where("NOT is_redirect").select(F.col("page_id").alias("id"), "title")


def addresses(page: DataFrame, closure: DataFrame) -> DataFrame:
    """``title, id, kind``: each title that leads to a page, redirects resolved to
    the end of their chain. Titles are unique."""
    page = named_pages(page)
    direct = page.where("NOT is_redirect").select("title", F.col("page_id").alias("id"), F.lit("page").alias("kind"))
    through = page.where("is_redirect").join(closure, F.col("page_id") == F.col("id")).select("title", F.col("target").alias("id"), F.lit("redirect").alias("kind"))
    return direct.unionByName(through)


def known_links(page: DataFrame, closure: DataFrame, pagelink: DataFrame) -> DataFrame:
    """``src, dst`` of each link of which both ends are known. Links on a redirect
    count as its target's; links from unknown pages or to unknown titles are dropped."""
    sources = page.where("NOT is_redirect").select(F.col("page_id").alias("pl_from"), F.col("page_id").alias("src")).unionByName(closure.select(F.col("id").alias("pl_from"), F.col("target").alias("src")))
    named = addresses(page, closure).select(F.col("title").alias("pl_title"), F.col("id").alias("dst"))
    return pagelink.join(named, "pl_title").join(sources, "pl_from").select("src", "dst")


def edges(page: DataFrame, closure: DataFrame, pagelink: DataFrame) -> DataFrame:
    """``src, dst``, distinct; self-loops stay."""
    return known_links(page, closure, pagelink).distinct()


def scan_counts(page: DataFrame, redirect: DataFrame, pagelink: DataFrame) -> DataFrame:
    """``source, attempts, accepted`` of the tables of a dump: a page is accepted
    unless its id is taken, a redirect if its source is a redirect and its title is
    known, a link if both its ends are known."""
    own = materialize(clean_pages(page), "page")
    titled = redirect.join(own.where("is_redirect").select(F.col("page_id").alias("rd_from")), "rd_from").join(own.select(F.col("title").alias("rd_title")).distinct(), "rd_title")
    accepted = {"page": (page, own), "redirect": (redirect, titled), "pagelink": (pagelink, known_links(own, redirect_closure(own, redirect), pagelink))}
    count, out = F.count(F.lit(1)), None
    for name, (rows, kept) in accepted.items():
        part = rows.agg(count.alias("attempts")).crossJoin(kept.agg(count.alias("accepted"))).select(F.lit(name).alias("source"), "attempts", "accepted")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


def resolved(page: DataFrame, redirect: DataFrame, pagelink: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and addresses, written to the shared folder."""
    page = materialize(clean_pages(page), "page")
    closure = redirect_closure(page, redirect)
    return vertices(page), materialize(edges(page, closure, pagelink), "edge"), addresses(page, closure)

