import gzip

from webweft import cli
from webweft.plans.fixtures import dump_tables
from webweft.plans.graph import LinkGraph
from webweft.sources import dump, store

PAGES = rb"""INSERT INTO `page` VALUES (1,0,'A','',0,0,0,0.5,'20170201000000','20170201000000',5,100,'wikitext',NULL),(2,0,'B','',0,1,0,0.5,'20170201000000',NULL,6,90,'wikitext',NULL);
(4,0,'O\'Hare','',0,0,0,0.5,'20170201000000','20170201000000',5,100,'wikitext','de'),(3,1,'Talk','',0,0,0,0.5,'20170201000000','20170201000000',5,100,'wikitext',NULL)
(6,0,'(x),\'(7,0,','',0,0,0,0.5,'20170201000000',NULL,5,100,NULL,NULL),(8,0,'""" + "é".encode() + b"\xff\r" + rb"""','',0,0,0,1.5e-05,'20170201000000',NULL,5,100,NULL,NULL)
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_page_tuples(spark, tmp_path):
    (tmp_path / "p.sql").write_bytes(PAGES)
    found = {r["page_id"]: (r["title"], r["is_redirect"]) for r in dump.read_pages(spark, str(tmp_path / "p.sql")).collect()}
    assert found == {1: ("A", False), 2: ("B", True), 4: (r"O\'Hare", False), 6: (r"(x),\'(7,0,", False), 8: ("é�\r", False)}


def test_page_layouts(spark, tmp_path):
    (tmp_path / "p.sql").write_text("(1,0,'A','',0,0,0,0.5,'20170201000000',NULL,5,100,1,'wikitext',NULL)")
    assert dump.read_pages(spark, str(tmp_path / "p.sql"), "simple").count() == 1
    assert dump.read_pages(spark, str(tmp_path / "p.sql")).count() == 0


def test_redirect_and_link_tuples(spark, tmp_path):
    (tmp_path / "r.sql").write_text("x (2,0,'A','',''),(5,0,'C',NULL,NULL),(6,4,'P','','')\n")
    (tmp_path / "l.sql").write_text("(1,0,'O\\'Hare',0),(1,1,'Talk',0),(1,0,'A',1)\n")
    assert rows(dump.read_redirects(spark, str(tmp_path / "r.sql"))) == [(2, "A"), (5, "C")]
    assert rows(dump.read_pagelinks(spark, str(tmp_path / "l.sql"))) == [(1, r"O\'Hare")]


def test_compressed_dumps(spark, tmp_path):
    (tmp_path / "l.sql.gz").write_bytes(gzip.compress(b"(1,0,'A',0),(2,0,'B',0)"))
    assert rows(dump.read_pagelinks(spark, str(tmp_path / "l.sql.gz"))) == [(1, "A"), (2, "B")]


def test_snapshot_json_and_cli(spark, tmp_path, capsys, monkeypatch):
    tables = dump_tables(spark, "/root/testdata/sf0.001")
    at = dump.write_dump(*tables, str(tmp_path / "dump"))
    args = ["-p", at["page"], "-r", at["redirect"], "-l", at["pagelinks"]]
    assert cli.main([*args, "build", str(tmp_path / "snap")], spark) == 0
    g = store.load(spark, str(tmp_path / "snap"))
    assert (g.size(), g.edge.count(), g.title.count(), g.redundancy()) == (161, 774, 282, 46)
    store.write_json(g, str(tmp_path / "json"))
    again = store.read_json(spark, str(tmp_path / "json"))
    assert rows(again.edge) == rows(g.edge) and rows(again.title) == rows(g.title) and rows(again.vertex) == rows(g.vertex)
    parents = store.adjacency(g).selectExpr("id", "explode(slice(neighbors, 1, cast(last_parent as int))) as src")
    assert sorted((r["src"], r["id"]) for r in parents.collect()) == rows(g.edge)

    snap = ["--snapshot", str(tmp_path / "snap")]
    title = {r["id"]: r["title"] for r in g.vertex.collect()}
    capsys.readouterr()
    cli.main([*snap, "path", title[0], title[2]], spark)
    assert capsys.readouterr().out.splitlines()[-1] == "4 links"
    cli.main([*snap, "redundancy"], spark)
    cli.main([*snap, "lookup", title[0].upper(), "nothing"], spark)
    cli.main([*snap, "ancestors", title[0]], spark)
    cli.main([*snap, "rank", str(tmp_path / "ranks"), "--turns", "3"], spark)
    monkeypatch.setattr("sys.stdin", iter([title[164] + "\n", title[0] + "\n", "none\n", "none\n"]))
    cli.main([*snap, "search"], spark)
    out = capsys.readouterr().out
    assert "46" in out.split() and "nothing unknown None" in out and "no_such_path" in out and "unknown title: none" in out
    assert spark.read.csv(str(tmp_path / "ranks")).count() == 161

    (tmp_path / "snap" / "edge").rename(tmp_path / "snap" / "edge_")
    g.edge.limit(0).write.parquet(str(tmp_path / "snap" / "edge"))
    try:
        store.load(spark, str(tmp_path / "snap"))
        raise AssertionError("a snapshot with missing rows was opened")
    except ValueError as e:
        assert "edge" in str(e)


def test_empty_tables_make_an_edgeless_graph(spark):
    page, redirect, link = dump_tables(spark, "/root/testdata/sf0.001")
    g = LinkGraph.build(page, redirect.limit(0), link.limit(0))
    assert (g.size(), g.edge.count()) == (161, 0)
