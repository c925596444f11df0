import base64
import gzip
import hashlib
import io

import numpy as np
import pytest

from webweft.llm import ann, embedding_dedup, warc

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, node long, size int, id long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)


def clusters(seed=0, n=400, dim=16):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        if i % 4 and rows:
            base = np.array(rows[int(rng.integers(max(0, len(rows) - 12), len(rows)))][1])
            v = base + rng.standard_normal(dim) * rng.choice([0.0, 0.02, 0.06]) * np.linalg.norm(base) / 4
        else:
            v = rng.standard_normal(dim) * 3
        rows.append((i, [float(np.float32(x)) for x in v], int(i // 12) % 3))
    return rows


ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [1.0, None] + [0.0] * 14, 1), (1004, [NAN] * 16, 1), (1005, [INF] * 16, 1), (1006, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [1.0] * 16, None), (None, [1.0, 2.0], 1), (1008, [3e38] * 16, 2), (1009, [1e-38] * 16, 2)]


def brute_links(rows, threshold=0.98):
    def ok(v, label):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and label is not None

    unit = [np.array(v, float) / np.abs(v).max() if ok(v, label) else None for _, v, label in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted((str(r[0]), links[i], str(min((x for x in groups[find(i)] if x is not None), default=None))) for i, r in enumerate(rows))


@pytest.mark.parametrize("window, block", [(1024, 1024), (16, 8)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, window, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = clusters() + ODD
    got = embedding_dedup.near_duplicates(vectors_of(spark, rows), window=window).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("lean", [0.0, 1.5])
def test_passes_find_lone_pairs_far_apart_in_small_windows(spark, lean):
    """Thousands of vectors of one label, also leaning one way, and windows of 64: no link is lost."""
    rng = np.random.default_rng(9)
    own = rng.standard_normal((4000, 24)) + lean
    near = own[:200] + rng.standard_normal((200, 24)) * 0.19 * np.linalg.norm(own[:200], axis=1, keepdims=True) / np.sqrt(24) * rng.uniform(0.5, 1.1, (200, 1))
    rows = np.concatenate([own, near]).astype(np.float32).astype(float)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table, window=64).collect()}
    assert linked.sum() > 150
    assert [got[i]["n_links"] for i in range(len(rows))] == linked.sum(axis=1).tolist()


def test_doubtful_cosines_are_decided_in_one_order():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((300, 64))
    cosine = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    threshold = cosine(rows[0], rows[1])
    for size in (2, 7, 300):
        here = embedding_dedup.linked(rows[:size], threshold)
        assert here[0, 1] == here[1, 0] == embedding_dedup.linked(rows[:2], threshold)[0, 1]


@pytest.mark.parametrize("spread", [0.02, 0.25, 2.0])
@pytest.mark.parametrize("own", [0, 150])
def test_pairs_of_a_block_and_the_one_before(spread, own):
    """Few pairs, many, and nearly all: those with a place from ``own`` on, each once, and what they unite."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((20, 24))[rng.integers(0, 20, 400) if spread > 0.1 else np.zeros(400, int)]
    rows = (rows + rng.standard_normal(rows.shape) * 0.5 * spread) * 10.0 ** rng.integers(-30, 30, (400, 1))
    i, j = embedding_dedup.linked_pairs(rows, 0.98, own)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    wanted = {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1))) if b >= own}
    assert len(i) == len(wanted) and set(zip(i.tolist(), j.tolist())) == wanted
    assert spread > 0.1 or len(i) > embedding_dedup.PAIRS  # cosines of all at once
    least = list(range(400))
    for _ in least:
        for a, b in wanted:
            least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a, b in wanted):
            break
    assert embedding_dedup._local_roots(400, i, j).tolist() == least


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).count() == 0


def brute_nearest(rows, own, query, k):
    best = {}
    for i, v, _ in rows:
        if i is None or i == own or not v or len(v) != len(query) or not all(x is not None and np.isfinite(x) for x in v) or not any(v):
            continue
        a, b = np.array(v, float), np.array(query, float)
        score = float((a / np.abs(a).max()) @ (b / np.abs(b).max()) / np.linalg.norm(a / np.abs(a).max()) / np.linalg.norm(b / np.abs(b).max()))
        best[i] = max(score, best.get(i, -2))
    return sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]


def test_search_recall_and_scores(spark):
    rows = clusters(1, 600) + ODD[:8] + [(None, [1.0] * 16, 1)]
    table = vectors_of(spark, rows)
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0 and r[1] and len(r[1]) == 16 and r[0] < 1000]
    got = {}
    for r in ann.search(table, table.where("vec_id % 50 = 0 and vec_id < 1000")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for own, vector, _ in queries:
        want = brute_nearest(rows, own, vector, 5)
        found = sorted(got[own])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:]))
        exact = dict(brute_nearest(rows, own, vector, 10**6))
        assert all(exact[f[1]] == pytest.approx(f[2], abs=1e-12) for f in found)
        hits += len({f[1] for f in found} & {w[0] for w in want})
    assert hits >= 0.9 * 5 * len(queries)


def test_share_of_rows_visited_falls_as_rows_grow():
    """Unstructured vectors, the hardest case: recall of 0.9 and more, and the share of rows reranked."""
    rng, shares = np.random.default_rng(1), []
    for n in (2000, 50_000):
        rows = ann.unit(rng.standard_normal((n, 64)))
        asked = rng.choice(n, 30, replace=False)
        cosines = rows[asked] @ rows.T
        cosines[np.arange(30), asked] = -2
        best = np.sort(cosines, axis=1)[:, -5:].ravel()
        buckets = ann.Buckets(rows, ann.TABLES, ann.projections_for(n))
        hits, seen = 0, 0
        for q, own in zip(asked, cosines):
            visited = buckets.visited(rows[q], rng.choice(best, ann.DRAWS), ann.TARGET)
            hits, seen = hits + np.isin(np.argsort(-own)[:5], visited).sum(), seen + len(visited)
        assert hits >= 0.9 * 150
        shares.append(seen / n / 30)
    assert shares[1] < 0.2 < shares[0]


def test_zones_cover_near_neighbours(spark):
    rows = clusters(1, 600)
    table = vectors_of(spark, rows)
    found = {}
    for r in ann.search(table, table.where("vec_id % 50 = 0"), zone_rows=64).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[own] & {w[0] for w in brute_nearest(rows, own, v, 5)}) for own, v, _ in rows if own % 50 == 0)
    assert hits >= 0.9 * 5 * 12


def test_queries_with_too_few_found_are_searched_against_all(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)], 1) for i in range(200)]
    table, got = vectors_of(spark, rows), {}
    for r in ann.search(table, table.where("vec_id % 50 = 0"), target=1e-12, zone_rows=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 50, 100, 150}
    for own, found in got.items():
        assert [v for _, v in sorted(found)] == [w[0] for w in brute_nearest(rows, own, rows[own][1], 5)]


def test_search_with_few_candidates_and_ties(spark):
    table = vectors_of(spark, [(0, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (3, [4.0, 0.0], 1), (9, [-1.0, 0.0], 1), (9, [-1.0, 0.0], 1)])
    got = ann.search(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 1.0), (7, 1.0), (9, -1.0)]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


PAGES = [(5, "http://a/", "<p>é</p>", 1), (2, "http://b/", "<p>é</p>", 1), (9, None, None, 1), (8, "", "", 1), (11, "http://c/\r\nX: y", "x" * 3_000_000, 1), (None, "http://d/", "<p>é</p>", 1), (3, "u", "own", 1), (3, "u", "own", 1), (5, "http://a/", "<p>é</p>", 1)]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, keeper int, revisit string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in warc.archive_round_trip(pages).collect())
    want = []
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        keeper = min(p[0] for p in PAGES if p[0] is not None and (p[2] or "") == (html or ""))
        again = i is not None and i > keeper
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", str(keeper if again else None)))
    assert got == sorted(want)

    warc.write_pages(pages, str(tmp_path / "w"), min_revisit_bytes=5)
    df = spark.read.format("warc").load(str(tmp_path / "w"))
    payloads = df.where("record_type = 'response'").select("record_id", "payload").collect()
    assert {r["record_id"].rpartition(":")[2]: bytes(r["payload"]) for r in payloads if r["record_id"].startswith(warc.PAGE_URN)} == {"2": "<p>é</p>".encode(), "9": b"", "8": b"", "11": b"x" * 3_000_000, "3": b"own"}
    assert df.where("record_type = 'revisit'").count() == 2
    assert df.where("record_type = 'warcinfo'").count() >= 1
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    warc.write_pages(pages.coalesce(1), str(tmp_path / "w"))
    path = next((tmp_path / "w").glob("*.warc.gz"))
    wanted = lambda h: h["warc-type"] == "response" and h["warc-target-uri"].endswith("/7")
    with path.open("rb") as f:
        assert [(h["warc-target-uri"], b) for h, b in warc.records(f, wanted, False)] == [("http://h/7", None)]
    one = spark.read.format("warc").schema("target_uri string, payload binary").load(str(tmp_path / "w")).where("target_uri = 'http://h/7'")
    assert [bytes(r["payload"]) for r in one.collect()] == [b"<p>7</p>"]
    data = gzip.decompress(path.read_bytes())
    for raw in (data, gzip.compress(data)):  # archives of other writers: plain, and gzip without notes
        found = list(warc.records(io.BytesIO(raw), lambda h: h["warc-type"] == "response", True))
        assert len(found) == 20 and found[3][1].endswith(b"<p>3</p>")
        assert len(list(warc.records(io.BytesIO(raw), wanted, False))) == 1


def test_folders_within_folders_and_members_without_notes(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(6)], "page_id long, url string, html string")
    warc.write_pages(pages.where("page_id < 3"), str(tmp_path / "w" / "a"))
    warc.write_pages(pages.where("page_id >= 3"), str(tmp_path / "w" / "b"))
    assert sorted(r["page_id"] for r in warc.read_pages(spark, str(tmp_path / "w")).collect()) == list(range(6))
    record = lambda i: warc.page_record(i, "u", b"x" * i, None, False)
    raw = warc._member(record(1), 4) + gzip.compress(record(2)) + warc._member(record(3), 4)
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in warc.records(io.BytesIO(raw), lambda h: True, True)] == [1, 2, 3]


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 50)], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    path = next((tmp_path / "w").glob("*.warc.gz"))
    data = bytearray(path.read_bytes())
    data[-6] ^= 255
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        warc.read_pages(spark, str(tmp_path / "w")).collect()
