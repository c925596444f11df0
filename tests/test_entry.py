"""Registered queries against their SQL on the smallest tables, and golden counts."""

import duckdb
import pytest

import __spark_entry__ as entry
from webweft.plans import queries as graph_queries
from webweft.plans.fixtures import graph

SF = "/root/testdata/sf0.001"
QUICK = ["page_counts", "redirect_resolution", "resolved_edges", "title_table", "caps_collisions", "degrees", "orphan_pages", "title_lookup", "ancestor_levels", "canonical_path", "pagerank_fixed_10", "pagerank_converged", "scan_counts", "shared_title_edges", "shared_title_table", "shared_title_pages", "shared_title_counts", "random_pages", "title_suggestions", "cached_paths", "search_survey", "recent_searches", "rank_sum", "snapshot_round_trip", "symmetry_violations"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    assert got == sorted(repr(tuple(r[at.index(c)] for c in cols)) for r in cur.fetchall())


def test_every_query_is_registered():
    assert set(graph_queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sf, want", [("0.001", (161, 774, 6, 46, 282)), ("0.01", (1598, 7851, 5, 35, 2706))])
def test_golden_counts(spark, sf, want):
    g = graph(spark, f"/root/testdata/sf{sf}")
    assert (g.size(), g.edge.count(), g.edge.where("src = dst").count(), g.redundancy(), g.title.count()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 10
