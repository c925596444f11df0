"""Registered queries on the derived link graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.operators import metrics, paths, resolve, titles
from webweft.operators.pagerank import pagerank, rank_report, rank_total
from webweft.plans.fixtures import DUMP_SQL, SHARED_SQL, dump_tables, graph
from webweft.plans.graph import LinkGraph
from webweft.runtime import materialize, scratch_path
from webweft.sources import dump, store

TURNS = 10
#: Turns that the SQL of the converged ranks unrolls, of which it takes the first that settles.
SETTLED = 90

Query = Callable[[SparkSession, str], DataFrame]


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, redirect, _ = dump_tables(spark, sf_dir)
    page = resolve.clean_pages(page)
    return resolve.addresses(page, resolve.redirect_closure(page, redirect))


def _ends(g: LinkGraph) -> tuple[int, int]:
    row = g.vertex.agg(F.min("id"), F.max("id")).first()
    return row[0], row[1]


def page_counts(spark, sf_dir):
    return metrics.page_counts(*dump_tables(spark, sf_dir))


def redirect_resolution(spark, sf_dir):
    page, redirect, _ = dump_tables(spark, sf_dir)
    return resolve.redirect_closure(resolve.clean_pages(page), redirect)


def resolved_edges(spark, sf_dir):
    return graph(spark, sf_dir).edge


def title_table(spark, sf_dir):
    return titles.title_table(_addresses(spark, sf_dir))


def caps_aliases(spark, sf_dir):
    return titles.caps_aliases(_addresses(spark, sf_dir))


def caps_collisions(spark, sf_dir):
    return titles.caps_collisions(_addresses(spark, sf_dir))


def out_degree_top(spark, sf_dir):
    g = graph(spark, sf_dir)
    return metrics.degree_top(g.vertex, g.edge, "src")


def in_degree_top(spark, sf_dir):
    g = graph(spark, sf_dir)
    return metrics.degree_top(g.vertex, g.edge, "dst")


def degrees(spark, sf_dir):
    g = graph(spark, sf_dir)
    out, into = metrics.degree(g.vertex, g.edge, "src"), metrics.degree(g.vertex, g.edge, "dst")
    return out.withColumnRenamed("degree", "children").join(into.withColumnRenamed("degree", "parents"), "id")


def neighbor_redundancy(spark, sf_dir):
    return metrics.neighbor_redundancy(graph(spark, sf_dir).edge)


def self_loops(spark, sf_dir):
    return metrics.self_loops(graph(spark, sf_dir).edge)


def dangling_pages(spark, sf_dir):
    g = graph(spark, sf_dir)
    return metrics.without(g.vertex, g.edge, "src")


def orphan_pages(spark, sf_dir):
    g = graph(spark, sf_dir)
    return metrics.without(g.vertex, g.edge, "dst")


def children_of(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.children(_ends(g)[0])


def parents_of(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.parents(_ends(g)[0])


def title_lookup(spark, sf_dir):
    g = graph(spark, sf_dir)
    typed = dump_tables(spark, sf_dir)[0].select(F.explode(F.array(F.concat(F.lit(" "), F.replace("title", F.lit("_"), F.lit(" ")), F.lit("\n")), F.initcap("title"))).alias("query")).distinct()
    return titles.look_up(g.title, typed)


def bfs_levels_down(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.levels(_ends(g)[0])


def ancestor_levels(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.ancestors(_ends(g)[0]).histogram()


def ancestor_summary(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.ancestors(_ends(g)[0]).summary()


def farthest_ancestors(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.ancestors(_ends(g)[0]).farthest(below=None)


def shortest_path_hops(spark, sf_dir):
    g = graph(spark, sf_dir)
    low, high = _ends(g)
    found = [g.shortest_path(*pair) for pair in ((low, high), (high, low), (low, low))]
    return paths.paths_table(spark, found).select("src", "dst", "status", "hops")


def canonical_path(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.shortest_path(*_ends(g)).titles(g.vertex)


def pagerank_fixed_10(spark, sf_dir):
    g = graph(spark, sf_dir)
    return pagerank(g.vertex, g.edge, turns=TURNS)[0].select("id", F.round("rank", 10).alias("rank"))


def pagerank_top(spark, sf_dir):
    g = graph(spark, sf_dir)
    return rank_report(pagerank(g.vertex, g.edge, turns=TURNS)[0], g.vertex).limit(10).select(F.round("rank", 10).alias("rank"), "id", "title")


def rank_sum(spark, sf_dir):
    g = graph(spark, sf_dir)
    return rank_total(pagerank(g.vertex, g.edge, turns=TURNS)[0]).select(F.round("total", 9).alias("total"))


def scan_counts(spark, sf_dir):
    return resolve.scan_counts(*dump_tables(spark, sf_dir))


def shared_title_edges(spark, sf_dir):
    return graph(spark, sf_dir, SHARED_SQL).edge


def shared_title_table(spark, sf_dir):
    return graph(spark, sf_dir, SHARED_SQL).title


def shared_title_pages(spark, sf_dir):
    return graph(spark, sf_dir, SHARED_SQL).vertex


def shared_title_counts(spark, sf_dir):
    return resolve.scan_counts(*dump_tables(spark, sf_dir, SHARED_SQL))


def random_pages(spark, sf_dir):
    return metrics.random_vertices(graph(spark, sf_dir).vertex, 5, seed=7)


def title_suggestions(spark, sf_dir):
    g = graph(spark, sf_dir)
    rank = pagerank(g.vertex, g.edge, turns=TURNS)[0].select("id", F.round("rank", 10).alias("rank"))
    return titles.suggest(g.title, rank, " Item 12", distance=1)


def cached_paths(spark, sf_dir):
    g = graph(spark, sf_dir)
    low, high = _ends(g)
    _, cache = paths.cached_paths(g, [(low, high), (high, low)], worth=2)
    cache = materialize(cache, "path-cache")
    answers, cache = paths.cached_paths(g, [(low, high), (low, low)], cache, worth=2)
    longest = paths.longest_paths(cache).select(F.lit("longest").alias("list"), "src", "dst", "hops")
    return answers.select(F.lit("answers").alias("list"), "src", "dst", "hops").unionByName(longest)


def search_survey(spark, sf_dir):
    g = graph(spark, sf_dir)
    ids = [r[0] for r in metrics.random_vertices(g.vertex, 4, seed=3).select("id").collect()]
    return paths.survey(g, list(zip(ids[:2], ids[2:]))).select("src", "dst", "status", "hops")


def recent_searches(spark, sf_dir):
    g = graph(spark, sf_dir)
    low, high = _ends(g)
    first, second = g.shortest_path(low, high), g.shortest_path(low, low)
    return paths.paths_table(spark, paths.recent_paths([first, second, first], 2)).select("src", "dst", "hops")


def pagerank_converged(spark, sf_dir):
    g = graph(spark, sf_dir)
    return pagerank(g.vertex, g.edge)[0].select("id", F.round("rank", 6).alias("rank"))


def rank_report_csv(spark, sf_dir):
    g = graph(spark, sf_dir)
    path = scratch_path(spark, "report")
    store.write_ranks(rank_report(pagerank(g.vertex, g.edge, turns=TURNS)[0], g.vertex), path)
    return spark.read.schema("rank double, id long, title string").csv(path).select(F.round("rank", 10).alias("rank"), "id", "title")


def symmetry_violations(spark, sf_dir):
    return graph(spark, sf_dir).violations()


def snapshot_round_trip(spark, sf_dir):
    path = scratch_path(spark, "snapshot")
    store.save(graph(spark, sf_dir), path)
    g = store.load(spark, path)
    text = lambda c: F.col(c).cast("string")
    rows = g.title.select(F.lit("title").alias("part"), F.col("title").alias("a"), text("id").alias("b"), F.col("kind").alias("c"))
    rows = rows.unionByName(g.vertex.select(F.lit("vertex").alias("part"), F.col("title").alias("a"), text("id").alias("b"), F.lit("").alias("c")))
    return rows.unionByName(g.edge.select(F.lit("edge").alias("part"), text("src").alias("a"), text("dst").alias("b"), F.lit("").alias("c")))


def json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "json")
    store.write_json(graph(spark, sf_dir), path)
    return store.read_json(spark, path).edge


def dump_round_trip(spark, sf_dir):
    at = dump.write_dump(*dump_tables(spark, sf_dir), scratch_path(spark, "dump"))
    return LinkGraph.build(dump.read_pages(spark, at["page"]), dump.read_redirects(spark, at["redirect"]), dump.read_pagelinks(spark, at["pagelinks"])).edge


_NAMES = """page_counts redirect_resolution resolved_edges title_table caps_aliases caps_collisions out_degree_top in_degree_top
degrees neighbor_redundancy self_loops dangling_pages orphan_pages children_of parents_of title_lookup bfs_levels_down
ancestor_levels ancestor_summary farthest_ancestors shortest_path_hops canonical_path pagerank_fixed_10 pagerank_top
pagerank_converged rank_sum rank_report_csv scan_counts shared_title_edges shared_title_table shared_title_pages shared_title_counts random_pages title_suggestions cached_paths search_survey recent_searches symmetry_violations snapshot_round_trip json_round_trip dump_round_trip"""
QUERIES: dict[str, Query] = {name: globals()[name] for name in _NAMES.split()}

_RULES_SQL = """,
named AS (SELECT title, min(page_id) AS page_id FROM page GROUP BY title),
target AS (
  SELECT r.rd_from AS id, min(p.page_id) AS target FROM redirect r JOIN named p ON p.title = r.rd_title
  JOIN page s ON s.page_id = r.rd_from AND s.is_redirect GROUP BY 1),
walk AS (SELECT id, target FROM target UNION SELECT w.id, g.target FROM walk w JOIN target g ON g.id = w.target),
closure AS (SELECT w.id, w.target FROM walk w JOIN page p ON p.page_id = w.target AND NOT p.is_redirect),
vertex AS (SELECT page_id AS id, title FROM page WHERE NOT is_redirect),
address AS (
  SELECT n.title, n.page_id AS id, 'page' AS kind FROM named n JOIN vertex v ON v.id = n.page_id
  UNION ALL SELECT n.title, c.target, 'redirect' FROM named n JOIN closure c ON c.id = n.page_id),
known AS (
  SELECT coalesce(c.target, l.pl_from) AS src, a.id AS dst
  FROM pagelink l JOIN address a ON a.title = l.pl_title LEFT JOIN closure c ON c.id = l.pl_from
  WHERE coalesce(c.target, l.pl_from) IN (SELECT id FROM vertex)),
edge AS (SELECT DISTINCT src, dst FROM known),
caps AS (
  SELECT upper(title) AS title, min(id) AS id, count(DISTINCT id) AS pages FROM address
  WHERE upper(title) NOT IN (SELECT title FROM address) GROUP BY 1),
titles AS (SELECT title, id, kind FROM address UNION ALL SELECT title, id, 'caps' FROM caps WHERE pages = 1),
ends AS (SELECT min(id) AS low, max(id) AS high FROM vertex)"""


def _graph_sql(tables: str) -> str:
    return "WITH RECURSIVE " + tables.format(part="part", lineitem="lineitem") + _RULES_SQL


_GRAPH_SQL = _graph_sql(DUMP_SQL)
_COUNTS = """SELECT 'page' AS source, (SELECT count(*) FROM page) AS attempts, (SELECT count(DISTINCT page_id) FROM page) AS accepted
UNION ALL SELECT 'redirect', (SELECT count(*) FROM redirect), (SELECT count(*) FROM redirect WHERE rd_from IN (SELECT page_id FROM page WHERE is_redirect) AND rd_title IN (SELECT title FROM page))
UNION ALL SELECT 'pagelink', (SELECT count(*) FROM pagelink), (SELECT count(*) FROM known)"""


def _levels(name: str, start: str, reverse: bool = False) -> str:
    here, there = ("dst", "src") if reverse else ("src", "dst")
    return f""",
{name}_walk AS (
  SELECT {start} AS id, 0 AS level FROM ends
  UNION SELECT e.{there}, w.level + 1 FROM {name}_walk w JOIN edge e ON e.{here} = w.id WHERE w.level < 40),
{name} AS (SELECT id, min(level) AS level FROM {name}_walk GROUP BY id)"""


def _rank_sql(turns: int) -> str:
    parts = [""",
outdeg AS MATERIALIZED (SELECT src, count(*) AS n FROM edge GROUP BY src),
n AS (SELECT count(*) AS n FROM vertex),
r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM vertex, n)"""]  # fmt: skip
    for i in range(turns):
        parts.append(f""",
s{i} AS MATERIALIZED (SELECT e.dst AS id, sum(r.rank / d.n) AS got FROM edge e JOIN r{i} r ON r.id = e.src JOIN outdeg d ON d.src = e.src GROUP BY e.dst),
r{i + 1} AS MATERIALIZED (
  SELECT r.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM outdeg)) / n + 0.85 * coalesce(got, 0) AS rank
  FROM n, r{i} r LEFT JOIN s{i} s ON s.id = r.id)""")
    return "".join(parts)


def _sql(body: str, more: str = "") -> str:
    return f"{_GRAPH_SQL}{more}\n{body}"


def _top(side: str) -> str:
    return _sql(f"SELECT v.id, v.title, d.n AS degree FROM (SELECT {side} AS id, count(*) AS n FROM edge GROUP BY 1 ORDER BY n DESC, id LIMIT 10) d JOIN vertex v ON v.id = d.id")


_BOTH = _levels("down", "low") + _levels("up", "high", reverse=True)

ORACLE_SQL: dict[str, str] = {
    "page_counts": _sql("""SELECT (SELECT count(*) FROM vertex) AS pages, (SELECT count(*) FROM page WHERE is_redirect) AS redirects,
 (SELECT count(*) FROM redirect) AS redirect_rows, (SELECT count(*) FROM pagelink) AS pagelink_rows"""),
    "redirect_resolution": _sql("SELECT id, target FROM closure"),
    "resolved_edges": _sql("SELECT src, dst FROM edge"),
    "title_table": _sql("SELECT title, id, kind FROM titles"),
    "caps_aliases": _sql("SELECT title, id FROM caps WHERE pages = 1"),
    "caps_collisions": _sql("SELECT title, pages FROM caps WHERE pages > 1"),
    "out_degree_top": _top("src"),
    "in_degree_top": _top("dst"),
    "degrees": _sql("""SELECT v.id, (SELECT count(*) FROM edge WHERE src = v.id) AS children, (SELECT count(*) FROM edge WHERE dst = v.id) AS parents FROM vertex v"""),
    "neighbor_redundancy": _sql("SELECT count(*) AS redundancy FROM edge a JOIN edge b ON a.src = b.dst AND a.dst = b.src"),
    "self_loops": _sql("SELECT src AS id FROM edge WHERE src = dst"),
    "dangling_pages": _sql("SELECT id, title FROM vertex WHERE id NOT IN (SELECT src FROM edge)"),
    "orphan_pages": _sql("SELECT id, title FROM vertex WHERE id NOT IN (SELECT dst FROM edge)"),
    "children_of": _sql("SELECT dst AS id FROM edge, ends WHERE src = low"),
    "parents_of": _sql("SELECT src AS id FROM edge, ends WHERE dst = low"),
    "title_lookup": _sql("""SELECT q.query, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN c.id IS NOT NULL THEN 'caps' ELSE 'unknown' END AS status,
 coalesce(e.id, c.id) AS id FROM (
  SELECT DISTINCT query FROM (
    SELECT ' ' || replace(title, '_', ' ') || chr(10) AS query FROM page
    UNION ALL SELECT upper(title[1]) || lower(title[2:]) FROM page)) q
 LEFT JOIN titles e ON e.title = replace(trim(q.query, ' ' || chr(10)), ' ', '_')
 LEFT JOIN titles c ON c.title = upper(replace(trim(q.query, ' ' || chr(10)), ' ', '_'))"""),
    "bfs_levels_down": _sql("SELECT id, CAST(level AS INTEGER) AS level FROM down", _levels("down", "low")),
    "ancestor_levels": _sql("SELECT CAST(level AS INTEGER) AS level, count(*) AS pages FROM up GROUP BY level", _levels("up", "low", True)),
    "ancestor_summary": _sql("SELECT CAST(max(level) AS INTEGER) AS max_distance, CAST(max(level) + 1 AS INTEGER) AS steps, count(*) AS reachable FROM up", _levels("up", "low", True)),
    "farthest_ancestors": _sql("SELECT id, CAST(level AS INTEGER) AS level FROM up WHERE level = (SELECT max(level) FROM up)", _levels("up", "low", True)),
    "shortest_path_hops": _sql(
        """SELECT s.src, s.dst, CASE WHEN l.level IS NULL THEN 'no_such_path' ELSE 'ok' END AS status, CAST(l.level AS INTEGER) AS hops
FROM (SELECT low AS src, high AS dst, 0 AS k FROM ends UNION ALL SELECT high, low, 1 FROM ends UNION ALL SELECT low, low, 0 FROM ends) s
LEFT JOIN (SELECT 0 AS k, id, level FROM down UNION ALL SELECT 1, id, level FROM back) l ON l.k = s.k AND l.id = s.dst""",
        _levels("down", "low") + _levels("back", "high"),
    ),
    "canonical_path": _sql(
        "SELECT CAST(position AS INTEGER) AS position, v.id, v.title FROM chain JOIN vertex v ON v.id = chain.id",
        _BOTH
        + """,
total AS (SELECT min(d.level + u.level) AS hops FROM down d JOIN up u ON u.id = d.id),
middle AS (SELECT min(d.id) AS id FROM down d JOIN up u ON u.id = d.id, total WHERE d.level = (hops + 1) // 2 AND u.level = hops // 2),
before AS (
  SELECT id, (hops + 1) // 2 AS position FROM middle, total
  UNION SELECT (SELECT min(e.src) FROM edge e JOIN down d ON d.id = e.src WHERE e.dst = b.id AND d.level = b.position - 1), b.position - 1 FROM before b WHERE b.position > 0),
after AS (
  SELECT id, (hops + 1) // 2 AS position, hops // 2 AS left_over FROM middle, total
  UNION SELECT (SELECT min(e.dst) FROM edge e JOIN up u ON u.id = e.dst WHERE e.src = a.id AND u.level = a.left_over - 1), a.position + 1, a.left_over - 1 FROM after a WHERE a.left_over > 0),
chain AS (SELECT id, position FROM before UNION SELECT id, position FROM after)""",
    ),
    "pagerank_fixed_10": _sql(f"SELECT id, round(rank, 10) AS rank FROM r{TURNS}", _rank_sql(TURNS)),
    "pagerank_top": _sql(f"SELECT round(rank, 10) AS rank, v.id, v.title FROM r{TURNS} r JOIN vertex v ON v.id = r.id ORDER BY r.rank DESC, v.id LIMIT 10", _rank_sql(TURNS)),
    "rank_report_csv": _sql(f"SELECT round(rank, 10) AS rank, v.id, v.title FROM r{TURNS} r JOIN vertex v ON v.id = r.id", _rank_sql(TURNS)),
    "symmetry_violations": _sql("""SELECT 'duplicate_edges' AS rule, (SELECT count(*) FROM (SELECT src FROM edge GROUP BY src, dst HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'loose_ends', (SELECT count(*) FROM edge WHERE src NOT IN (SELECT id FROM vertex) OR dst NOT IN (SELECT id FROM vertex))
UNION ALL SELECT 'repeated_titles', (SELECT count(*) FROM (SELECT title FROM titles GROUP BY title HAVING count(*) > 1))
UNION ALL SELECT 'stray_titles', (SELECT count(*) FROM titles WHERE id NOT IN (SELECT id FROM vertex))
UNION ALL SELECT 'unnamed_vertices', (SELECT count(*) FROM vertex WHERE title NOT IN (SELECT title FROM titles WHERE kind <> 'caps'))"""),
    "snapshot_round_trip": _sql("""SELECT 'title' AS part, title AS a, CAST(id AS VARCHAR) AS b, kind AS c FROM titles
UNION ALL SELECT 'vertex', title, CAST(id AS VARCHAR), '' FROM vertex UNION ALL SELECT 'edge', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), '' FROM edge"""),
    "rank_sum": _sql(f"SELECT round(sum(rank), 9) AS total FROM r{TURNS}", _rank_sql(TURNS)),
    "pagerank_converged": _sql(
        "SELECT id, round(rank, 6) AS rank FROM turns WHERE turn = (SELECT min(turn) FROM (SELECT turn, max(abs(rank - was)) AS change FROM turns GROUP BY turn) WHERE change <= 1e-8)",
        _rank_sql(SETTLED) + ",\nturns AS (" + " UNION ALL ".join(f"SELECT {i} AS turn, n.id, n.rank, o.rank AS was FROM r{i} n JOIN r{i - 1} o ON o.id = n.id" for i in range(1, SETTLED + 1)) + ")",
    ),
    "scan_counts": _sql(_COUNTS),
    "shared_title_edges": f"{_graph_sql(SHARED_SQL)} SELECT src, dst FROM edge",
    "shared_title_table": f"{_graph_sql(SHARED_SQL)} SELECT title, id, kind FROM titles",
    "shared_title_pages": f"{_graph_sql(SHARED_SQL)} SELECT id, title FROM vertex",
    "shared_title_counts": f"{_graph_sql(SHARED_SQL)} {_COUNTS}",
    "random_pages": _sql("SELECT id, title FROM vertex ORDER BY md5('7:' || CAST(id AS VARCHAR)), id LIMIT 5"),
    "title_suggestions": _sql(
        """SELECT title, t.id, CAST(levenshtein(lower(title), 'item_12') AS INTEGER) AS distance, round(rank, 10) AS rank FROM titles t JOIN r10 r ON r.id = t.id
WHERE levenshtein(lower(title), 'item_12') <= 1 ORDER BY distance, round(rank, 10) DESC, title LIMIT 10""",
        _rank_sql(TURNS),
    ),
    "cached_paths": _sql(
        """SELECT 'answers' AS list, low AS src, high AS dst, CAST((SELECT level FROM down WHERE id = high) AS INTEGER) AS hops FROM ends
UNION ALL SELECT 'answers', low, low, 0 FROM ends
UNION ALL SELECT 'longest', low, high, CAST((SELECT level FROM down WHERE id = high) AS INTEGER) FROM ends WHERE (SELECT level FROM down WHERE id = high) >= 2
UNION ALL SELECT 'longest', high, low, CAST((SELECT level FROM back WHERE id = low) AS INTEGER) FROM ends WHERE (SELECT level FROM back WHERE id = low) >= 2""",
        _levels("down", "low") + _levels("back", "high"),
    ),
    "recent_searches": _sql(
        """SELECT low AS src, high AS dst, CAST((SELECT level FROM down WHERE id = high) AS INTEGER) AS hops FROM ends WHERE high IN (SELECT id FROM down)
UNION ALL SELECT low, low, 0 FROM ends""",
        _levels("down", "low"),
    ),
    "search_survey": _sql(
        """SELECT p.src, p.dst, CASE WHEN l.level IS NULL THEN 'no_such_path' ELSE 'ok' END AS status, CAST(l.level AS INTEGER) AS hops
FROM pairs p LEFT JOIN (SELECT start, id, min(level) AS level FROM far GROUP BY start, id) l ON l.start = p.src AND l.id = p.dst""",
        """,
drawn AS (SELECT id, row_number() OVER (ORDER BY md5('3:' || CAST(id AS VARCHAR)), id) AS k FROM vertex),
pairs AS (SELECT a.id AS src, b.id AS dst FROM drawn a JOIN drawn b ON b.k = a.k + 2 WHERE a.k <= 2),
far AS (
  SELECT src AS start, src AS id, 0 AS level FROM pairs
  UNION SELECT w.start, e.dst, w.level + 1 FROM far w JOIN edge e ON e.src = w.id WHERE w.level < 40)""",
    ),
    "json_round_trip": _sql("SELECT src, dst FROM edge"),
    "dump_round_trip": _sql("SELECT src, dst FROM edge"),
}
