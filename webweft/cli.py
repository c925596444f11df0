"""Command line: build, path, rank, ancestors, redundancy, lookup, search."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webweft.operators.titles import look_up
from webweft.plans.graph import LinkGraph
from webweft.runtime import local_session
from webweft.sources import dump, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webweft", description="Questions to the link graph of a wiki.")
    p.add_argument("--snapshot", help="a snapshot to open; or give the three dumps")
    p.add_argument("-p", "--pages", help="page dump")
    p.add_argument("-r", "--redirects", help="redirect dump")
    p.add_argument("-l", "--pagelinks", help="pagelinks dump")
    p.add_argument("--layout", default="standard", choices=sorted(dump.PAGE_LAYOUTS))
    p.add_argument("--master", help="Spark master; local[*] if not given")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("build", help="write a snapshot").add_argument("target")
    path = sub.add_parser("path", help="a shortest path between two titles")
    path.add_argument("src")
    path.add_argument("dst")
    rank = sub.add_parser("rank", help="write the rank report")
    rank.add_argument("target")
    rank.add_argument("--turns", type=int)
    sub.add_parser("ancestors", help="pages by distance to a title").add_argument("title")
    sub.add_parser("redundancy", help="neighbours that are parent and child")
    sub.add_parser("lookup", help="the pages that titles name").add_argument("titles", nargs="+")
    sub.add_parser("search", help="read pairs of titles from standard input and print paths")
    return p


def open_graph(spark: SparkSession, args: argparse.Namespace) -> LinkGraph:
    if args.pages and args.redirects and args.pagelinks:
        return LinkGraph.build(dump.read_pages(spark, args.pages, args.layout), dump.read_redirects(spark, args.redirects), dump.read_pagelinks(spark, args.pagelinks))
    if args.snapshot:
        return store.load(spark, args.snapshot)
    raise SystemExit("give --snapshot, or --pages, --redirects and --pagelinks")


def print_path(graph: LinkGraph, src: str, dst: str) -> None:
    ends = [graph.resolve(t) for t in (src, dst)]
    for title, id in zip((src, dst), ends):
        if id is None:
            print(f"unknown title: {title.strip()}")
            return
    found = graph.shortest_path(*ends)
    if found.path is None:
        print(found.status)
        return
    for row in found.titles(graph.vertex).collect():
        print(row["title"])
    print(f"{found.hops} links")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or (SparkSession.builder.master(args.master).getOrCreate() if args.master else local_session())
    graph = open_graph(spark, args)
    if args.command == "build":
        store.save(graph, args.target)
    elif args.command == "path":
        print_path(graph, args.src, args.dst)
    elif args.command == "rank":
        store.write_ranks(graph.ranks(turns=args.turns), args.target)
    elif args.command == "ancestors":
        id = graph.resolve(args.title)
        if id is None:
            print(f"unknown title: {args.title}")
            return 1
        found = graph.ancestors(id)
        for row in found.histogram().orderBy("level").collect():
            print(row["level"], row["pages"])
        for row in found.farthest().join(graph.vertex, "id").orderBy("id").collect():
            print(row["title"])
    elif args.command == "redundancy":
        print(graph.redundancy())
    elif args.command == "lookup":
        asked = spark.range(1).select(F.explode(F.array(*map(F.lit, args.titles))).alias("query"))
        for row in look_up(graph.title, asked).collect():
            print(row["query"], row["status"], row["id"])
    else:
        lines = iter(sys.stdin)
        for src in lines:
            print_path(graph, src, next(lines, ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())
