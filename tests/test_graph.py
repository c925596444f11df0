"""The graph's micro-cases and a comparison with plain Python on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from webweft.operators import checks, metrics, paths, resolve, titles
from webweft.operators.pagerank import pagerank
from webweft.plans.graph import LinkGraph


def graph_of(spark, edges, nodes=None):
    nodes = sorted(set(nodes or ()) | {x for e in edges for x in e})
    vertex = spark.createDataFrame([(i, f"n{i}") for i in nodes], "id long, title string")
    edge = spark.createDataFrame(edges, "src long, dst long")
    return LinkGraph(vertex, edge, vertex.withColumn("kind", F.lit("page")))


def wiki(spark, pages, redirects=(), links=()):
    return LinkGraph.build(
        spark.createDataFrame(list(pages), "page_id long, title string, is_redirect boolean"),
        spark.createDataFrame(list(redirects), "rd_from long, rd_title string"),
        spark.createDataFrame(list(links), "pl_from long, pl_title string"),
    )


def edges_of(g):
    return sorted((r["src"], r["dst"]) for r in g.edge.collect())


def names(g):
    return {r["title"]: (r["id"], r["kind"]) for r in g.title.collect()}


def test_direct_edge_beats_detour(spark):
    g = graph_of(spark, [(1, 2), (1, 3), (3, 2)])
    assert g.shortest_path(1, 2).path == [1, 2]


def test_same_node_unreachable_and_unknown(spark):
    g = graph_of(spark, [(1, 2), (3, 4)])
    same = g.shortest_path(1, 1)
    assert (same.hops, same.is_empty()) == (0, True)
    assert g.shortest_path(1, 4).status == "no_such_path"
    for pair in ((1, 99), (99, 99)):
        with pytest.raises(KeyError):
            g.shortest_path(*pair)


def test_round_limit(spark):
    g = graph_of(spark, [(i, i + 1) for i in range(-3, 9)])
    assert g.shortest_path(0, 4, max_rounds=2).hops == 4
    assert g.shortest_path(0, 5, max_rounds=2).status == "terminated"


def test_redirect_link_becomes_self_loop(spark):
    g = wiki(spark, [(1, "P", False), (2, "R", True)], [(2, "P")], [(2, "P")])
    assert edges_of(g) == [(1, 1)]


def test_redirect_chain_resolves_to_its_end(spark):
    g = wiki(spark, [(1, "A", True), (2, "B", True), (3, "C", False), (4, "X", False)], [(1, "B"), (2, "C")], [(4, "A")])
    assert edges_of(g) == [(4, 3)]
    assert names(g)["A"] == (3, "redirect")


def test_redirect_cycles_and_dead_ends_are_dropped(spark):
    g = wiki(spark, [(1, "A", True), (2, "B", True), (3, "S", True), (4, "M", True), (5, "X", False)], [(1, "B"), (2, "A"), (3, "S"), (4, "missing"), (5, "A")], [(5, "A"), (5, "S"), (5, "M"), (9, "X"), (5, "nowhere")])
    assert edges_of(g) == []
    assert set(names(g)) == {"X"}


def test_long_redirect_chain(spark):
    pages = [(i, f"R{i}", i < 20) for i in range(21)]
    page = spark.createDataFrame(pages, "page_id long, title string, is_redirect boolean")
    redirect = spark.createDataFrame([(i, f"R{i + 1}") for i in range(20)], "rd_from long, rd_title string")
    assert {(r["id"], r["target"]) for r in resolve.redirect_closure(page, redirect).collect()} == {(i, 20) for i in range(20)}


def test_repeated_ids_and_titles(spark):
    g = wiki(spark, [(1, "B", False), (1, "A", False), (2, "A", False), (3, "C", False), (4, "C", True), (5, "D", True)], [(5, "C")], [(1, "A"), (1, "A"), (2, "C"), (3, "D")])
    assert sorted(r["id"] for r in g.vertex.collect()) == [1, 2, 3]
    assert edges_of(g) == [(1, 1), (2, 3), (3, 3)]
    assert names(g) == {"A": (1, "page"), "C": (3, "page"), "D": (3, "redirect")}
    assert all(r["violations"] == 0 for r in g.violations().collect())


def test_scan_counts(spark):
    page = spark.createDataFrame([(1, "A", False), (1, "X", False), (2, "B", True), (3, "C", False)], "page_id long, title string, is_redirect boolean")
    redirect = spark.createDataFrame([(2, "A"), (2, "gone"), (3, "A"), (9, "A")], "rd_from long, rd_title string")
    link = spark.createDataFrame([(1, "B"), (2, "C"), (1, "gone"), (9, "A"), (1, "B")], "pl_from long, pl_title string")
    counts = resolve.scan_counts(page, redirect, link)
    assert {r["source"]: (r["attempts"], r["accepted"]) for r in counts.collect()} == {"page": (4, 3), "redirect": (4, 1), "pagelink": (5, 3)}


def test_recent_searches_and_survey(spark):
    g = graph_of(spark, [(1, 2), (2, 3), (5, 6)])
    found = [paths.Path(1, 2, "ok", [1, 2]), paths.Path(2, 3, "ok", [2, 3]), paths.Path(1, 6, "no_such_path", None), paths.Path(1, 2, "ok", [1, 2])]
    assert [(p.src, p.dst) for p in paths.recent_paths(found)] == [(1, 2), (2, 3)]
    rows = paths.survey(g, [(1, 3), (1, 6)]).collect()
    assert {(r["src"], r["dst"]): (r["status"], r["hops"]) for r in rows} == {(1, 3): ("ok", 2), (1, 6): ("no_such_path", None)}
    assert [r["millis"] for r in rows] == sorted(r["millis"] for r in rows)


def test_caps_aliases(spark):
    g = wiki(spark, [(1, "Foo", False), (2, "foo", False), (3, "Bar", False), (4, "straße", False), (5, "BAZ", False), (6, "Baz", False)])
    assert "FOO" not in names(g)
    assert names(g)["BAR"] == (3, "caps")
    assert names(g)["STRASSE"] == (4, "caps")
    assert names(g)["BAZ"] == (5, "page")
    address = g.title.where("kind <> 'caps'")
    assert titles.caps_collisions(address).collect()[0].asDict() == {"title": "FOO", "pages": 2}
    assert (g.resolve(" Bar\n"), g.resolve("bAr"), g.resolve("x")) == (3, 3, None)


def test_suggestions(spark):
    g = graph_of(spark, [(1, 2)])
    rank, _ = pagerank(g.vertex, g.edge)
    assert [r["title"] for r in titles.suggest(g.title, rank, "n1", distance=1).collect()] == ["n1", "n2"]


def test_pagerank_small_cases(spark):
    two, _ = pagerank(*(lambda g: (g.vertex, g.edge))(graph_of(spark, [(1, 2), (2, 1)])))
    assert {r["id"]: round(r["rank"], 9) for r in two.collect()} == {1: 0.5, 2: 0.5}
    g = graph_of(spark, [(1, 2), (2, 2)])
    ranks, _ = pagerank(g.vertex, g.edge)
    assert {r["id"]: round(r["rank"], 6) for r in ranks.collect()} == {1: 0.075, 2: 0.925}
    with pytest.raises(RuntimeError):
        pagerank(g.vertex, g.edge, max_turns=1)
    empty = graph_of(spark, [])
    assert pagerank(empty.vertex, empty.edge)[0].count() == 0


def test_redundancy_degrees_and_violations(spark):
    g = graph_of(spark, [(1, 2), (2, 1), (3, 3), (1, 3)])
    assert g.redundancy() == 3
    assert {r["id"]: r["degree"] for r in metrics.degree(g.vertex, g.edge, "src").collect()} == {1: 2, 2: 1, 3: 1}
    assert all(r["violations"] == 0 for r in g.violations().collect())
    bad = graph_of(spark, [(1, 2), (1, 2)])
    assert checks.duplicate_edges(bad.edge).count() == 1
    assert checks.loose_ends(bad.vertex.where("id = 1"), bad.edge).count() == 1
    assert checks.asymmetric(bad.edge, bad.edge.distinct()).count() == 1
    assert metrics.random_vertices(g.vertex, 2).collect() == metrics.random_vertices(g.vertex, 2).collect()


def test_ancestors_of_an_orphan(spark):
    found = graph_of(spark, [(1, 2)]).ancestors(1)
    assert found.summary().first().asDict() == {"max_distance": 0, "steps": 1, "reachable": 1}
    with pytest.raises(KeyError):
        graph_of(spark, [(1, 2)]).ancestors(7)


def test_path_cache(spark):
    g = graph_of(spark, [(1, 2), (2, 3), (3, 4)])
    answers, cache = paths.cached_paths(g, [(1, 4), (1, 2)])
    assert {(r["src"], r["dst"]): r["hops"] for r in answers.collect()} == {(1, 4): 3, (1, 2): 1}
    assert [r["hops"] for r in paths.longest_paths(cache).collect()] == [3]
    again, _ = paths.cached_paths(graph_of(spark, [], [1, 4]), [(1, 4)], cache)
    assert again.first()["path"] == [1, 2, 3, 4]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    rng = random.Random(seed)
    nodes = range(30)
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(55)})
    g = graph_of(spark, edges, nodes)
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    far, todo = {0: 0}, deque([0])
    while todo:
        here = todo.popleft()
        for there in out[here]:
            if there not in far:
                far[there] = far[here] + 1
                todo.append(there)
    assert {r["id"]: r["level"] for r in g.levels(0).collect()} == far
    for dst in rng.sample(nodes, 2):
        found = g.shortest_path(0, dst)
        assert found.hops == far.get(dst)
        assert all((a, b) in edges for a, b in zip(found.path or [], (found.path or [])[1:]))
    ranks = {r["id"]: r["rank"] for r in pagerank(g.vertex, g.edge, turns=5)[0].collect()}
    want = {n: 1 / 30 for n in nodes}
    for _ in range(5):
        lost = sum(want[n] for n in nodes if not out[n])
        want = {n: 0.15 / 30 + 0.85 * lost / 30 + 0.85 * sum(want[a] / len(out[a]) for a, b in edges if b == n) for n in nodes}
    assert ranks == pytest.approx(want, abs=1e-12)
    assert sum(ranks.values()) == pytest.approx(1)
    assert g.redundancy() == sum((b, a) in edges for a, b in edges)
