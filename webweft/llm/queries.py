"""Registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm import ann, embedding_dedup, html_text, jaccard_join, line_dedup, mixing, packing, sharding, toxicity, warc
from webweft.runtime import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("is_toxic").cast("int").alias("predicted"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(rows, with_text=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sharding": op3_sharding,
    "op4_ann": op4_ann,
    "op5_html_extraction": op5_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_warc": op10_warc,
}

_USABLE = """embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

_WEIGHTS = ", ".join(f"('{s}', {w})" for s, w in mixing.TARGET_WEIGHTS.items())

ORACLE_SQL = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE a = e.vec_id) AS component_id,
       (SELECT min(b) FROM reach WHERE a = e.vec_id) = e.vec_id AS kept
FROM embeddings e""",
    "op3_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
p AS (SELECT doc_id, n, h, g.depth FROM d, (SELECT unnest(range(0, 61)) AS depth) g),
b AS (SELECT *, h >> (60 - depth) AS v, sum(n) OVER (PARTITION BY depth, h >> (60 - depth)) AS bytes,
             count(*) OVER (PARTITION BY depth, h >> (60 - depth)) AS members FROM p),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM b
      WHERE bytes <= {sharding.MAX_SHARD_BYTES} OR members = 1)
SELECT doc_id, n AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(v), CAST(depth AS INTEGER), '0') END AS shard_id,
       CAST(depth AS INTEGER) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, bytes > {sharding.MAX_SHARD_BYTES} AS oversized
FROM l WHERE k = 1""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_mixing": f"""
WITH RECURSIVE present AS (SELECT DISTINCT source FROM documents),
w AS (SELECT p.source, coalesce(t.weight, {mixing.DEFAULT_WEIGHT}) AS weight,
             row_number() OVER (ORDER BY p.source NULLS FIRST) AS i
      FROM present p LEFT JOIN (VALUES {_WEIGHTS}) t(source, weight) ON t.source = p.source),
parts AS (SELECT list(weight ORDER BY i) AS ws, CAST(sum(weight) AS BIGINT) AS q, CAST(count(*) AS BIGINT) AS k FROM w),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS nxt, CAST(0 AS BIGINT) AS pick FROM parts
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda i: nxt[i] + CASE WHEN i = c THEN 1 ELSE 0 END), c
  FROM (SELECT t, nxt, k, q, list_min(list_transform(range(1, k + 1), lambda i:
          CASE WHEN nxt[i] < ws[i] AND (nxt[i] * q) // ws[i] <= t + 1
               THEN ((nxt[i] + 1) * q + ws[i] - 1) // ws[i] * 100000 + i END)) % 100000 AS c
        FROM sim, parts WHERE t + 1 < q) s),
cal AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM sim WHERE t >= 0),
d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS n,
         coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT), doc_id, md5(coalesce(text, ''))
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM documents),
c AS (SELECT *, unnest(range(CAST(start // {mixing.BLOCK_CHARS} AS BIGINT), CAST(greatest(start, start + n - 1) // {mixing.BLOCK_CHARS} + 1 AS BIGINT))) AS b FROM d)
SELECT c.doc_id, c.source, CAST(b - start // {mixing.BLOCK_CHARS} AS INTEGER) AS mix_piece, b AS mix_block,
       CAST((b // w.weight) * q + slot AS BIGINT) AS mix_slot,
       CAST(b * q // w.weight AS BIGINT) AS mix_release,
       CAST(((b + 1) * q + w.weight - 1) // w.weight AS BIGINT) AS mix_deadline,
       CAST(start AS BIGINT) AS mix_start,
       CAST(greatest(start, b * {mixing.BLOCK_CHARS}) - b * {mixing.BLOCK_CHARS} AS BIGINT) AS mix_offset,
       CAST(least(start + n, (b + 1) * {mixing.BLOCK_CHARS}) - greatest(start, b * {mixing.BLOCK_CHARS}) AS BIGINT) AS mix_chars
FROM c JOIN w ON w.source IS NOT DISTINCT FROM c.source JOIN parts ON true
JOIN cal ON cal.i = w.i AND cal.j = b % w.weight""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST((5 * i) // 4 + 1 AS BIGINT), 2) AS BIGINT) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > keeper THEN keeper END AS refers_to
FROM k""",
}
