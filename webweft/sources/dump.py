"""SQL dumps of a wiki as typed tables, plain or compressed (``.gz``, ``.bz2``) by the file's ending.

A dump is lines of INSERT statements with many tuples each. One regular
expression a table finds whole tuples of namespace 0; a second pass over the
tuple's text takes its fields. Quoted strings are matched strictly, escapes
included, so a tuple that does not fit never swallows its neighbour. Escapes in
titles are kept as they stand in the dump.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTED = r"'(?:[^'\\]|\\.)*'"
_TITLE = r"'((?:[^'\\]|\\.)*)'"
_OR_NULL = rf"(?:{_QUOTED}|NULL)"
_INT = r"\d+"
_REAL = r"[\d.eE+-]+"

#: Tuple layouts by name; groups are the fields taken. Newer layouts are added here.
PAGE_LAYOUTS = {
    "standard": rf"\(({_INT}),0,{_TITLE},{_OR_NULL},{_INT},([01]),[01],{_REAL},{_QUOTED},{_OR_NULL},{_INT},{_INT},{_OR_NULL},{_OR_NULL}\)",
    "simple": rf"\(({_INT}),0,{_TITLE},{_OR_NULL},{_INT},([01]),[01],{_REAL},{_QUOTED},{_OR_NULL},{_INT},{_INT},[01],{_OR_NULL},{_OR_NULL}\)",
}
REDIRECT_TUPLE = rf"\(({_INT}),0,{_TITLE},{_OR_NULL},{_OR_NULL}\)"
PAGELINK_TUPLE = rf"\(({_INT}),0,{_TITLE},0\)"


def _tuples(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """One row of column ``t`` for each tuple of the pattern. Lines end at \\n only, and
    invalid UTF-8 becomes replacement characters."""
    lines = spark.read.format("text").option("lineSep", "\n").load(path)
    whole = f"(?s){pattern}"
    text = F.make_valid_utf8(F.col("value"))
    return lines.select(F.explode(F.regexp_extract_all(text, F.lit(whole), F.lit(0))).alias("t"))


def _field(pattern: str, group: int):
    return F.regexp_extract("t", f"(?s)^{pattern}$", group)


def read_pages(spark: SparkSession, path: str | list[str], layout: str = "standard") -> DataFrame:
    """``page_id, title, is_redirect`` of the articles and redirects of a page dump."""
    p = PAGE_LAYOUTS[layout]
    return _tuples(spark, path, p).select(_field(p, 1).cast("bigint").alias("page_id"), _field(p, 2).alias("title"), (_field(p, 3) == "1").alias("is_redirect"))


def read_redirects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``rd_from, rd_title`` of a redirect dump."""
    p = REDIRECT_TUPLE
    return _tuples(spark, path, p).select(_field(p, 1).cast("bigint").alias("rd_from"), _field(p, 2).alias("rd_title"))


def read_pagelinks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``pl_from, pl_title`` of a pagelinks dump: links from and to namespace 0."""
    p = PAGELINK_TUPLE
    return _tuples(spark, path, p).select(_field(p, 1).cast("bigint").alias("pl_from"), _field(p, 2).alias("pl_title"))


def write_dump(page: DataFrame, redirect: DataFrame, pagelink: DataFrame, path: str, per_line: int = 200) -> dict[str, str]:
    """Render tables as dump lines of about ``per_line`` tuples under ``path``; the
    folders by table. Titles are taken to be escaped already."""
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    tuples = {
        "page": page.select(
            F.col("page_id").alias("k"),
            F.concat(F.lit("("), "page_id", F.lit(",0,"), quoted("title"), F.lit(",'',0,"), F.col("is_redirect").cast("int"), F.lit(",0,0.5,'20170201000000',NULL,1,1,'wikitext',NULL)")).alias("t"),
        ),
        "redirect": redirect.select(F.col("rd_from").alias("k"), F.concat(F.lit("("), "rd_from", F.lit(",0,"), quoted("rd_title"), F.lit(",'',NULL)")).alias("t")),
        "pagelinks": pagelink.select(F.col("pl_from").alias("k"), F.concat(F.lit("("), "pl_from", F.lit(",0,"), quoted("pl_title"), F.lit(",0)")).alias("t")),
    }
    for name, rows in tuples.items():
        lines = rows.groupBy(F.expr(f"k div {per_line}")).agg(F.concat_ws(",", F.collect_list("t")).alias("t"))
        lines.select(F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), "t", F.lit(";")).alias("value")).write.text(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tuples}
