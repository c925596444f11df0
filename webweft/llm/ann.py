"""Nearest neighbours by multiprobe p-stable hashing.

Every vector, scaled to length one, falls into one bucket of each table by Gaussian
projections cut into intervals; a table has more projections the more rows there
are. A query visits the occupied buckets of a table in the order of their estimated
chance to hold one of its neighbours, down to the chance at which the visited ones
together reach their target; the rows of the visited buckets of all tables are merged
and reranked by their exact cosines.

Rows lie in zones by the signs of a few further projections, and tables are built
zone by zone. A query goes to zones in the order of their chance as well, to as many
as leave little chance out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webweft.llm.vectors import as_doubles, by_length, matrix, unit, usable
from webweft.runtime import materialize

TABLES = 2
#: Projections of a table for each binary digit of the number of rows, and the width of their intervals.
PROJECTIONS = 4
WIDTH = 1.0
#: Chance to visit a near neighbour's bucket in at least one table, and its zone.
TARGET = 0.96
ZONE_TARGET = 0.995
NEIGHBOURS = 5
#: Rows whose neighbours among all rows are taken for how near neighbours are, and
#: simulated neighbours of a query by which its chances are added up.
SAMPLE_QUERIES = 64
DRAWS = 256
#: Index rows of one reranking task.
ZONE_ROWS = 16_384
SEED = 7_300_147

_REACH = 24


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x < 0, tail, 1 - tail)


def projections_for(rows: int) -> int:
    return PROJECTIONS * math.ceil(math.log2(max(2, rows)))


def _projection(table: int, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, dim])
    return rng.standard_normal((dim, count)), rng.uniform(0, WIDTH, count)


def _steps(projected: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The interval that each projection falls into."""
    return np.clip(np.floor((projected + shift) / WIDTH) + _REACH, 0, 2 * _REACH - 1).astype(np.uint8)


class Probing:
    """One query's chances in one table: a neighbour at cosine c projects to c times the
    query's own projections plus a Gaussian of the part that these do not explain."""

    def __init__(self, row: np.ndarray, table: int, count: int, cosines: np.ndarray):
        a, b = _projection(table, len(row), count)
        y = row @ a
        rest = np.sqrt(np.maximum(1e-9, (np.square(a).sum(axis=0) - y * y) / max(1, len(row) - 1)))
        c, s = cosines[:, None], np.sqrt(np.maximum(1e-9, 1 - cosines * cosines))[:, None]
        middle = float(np.median(cosines))
        spread = rest * math.sqrt(max(1e-6, 1 - middle * middle))
        edges = (np.arange(-_REACH, _REACH + 1)[None, :] * WIDTH - b[:, None] - middle * y[:, None]) / spread[:, None]
        self.log_chance = np.log(np.maximum(1e-12, np.diff(_phi(edges), axis=1)))
        noise = np.random.default_rng([SEED, table, 1]).standard_normal((len(cosines), count))
        self.draws = self.of(_steps(c * y + s * rest * noise, b).T)

    def of(self, steps: np.ndarray) -> np.ndarray:
        """Logarithm of the chance of each bucket, given by its interval in each projection."""
        out = np.zeros(steps.shape[1])
        for chances, step in zip(self.log_chance, steps):
            out += chances.take(step)
        return out

    def least(self, target: float) -> float:
        """The chance down to which buckets are visited for a neighbour to be in one of
        them with the chance ``target``."""
        return float(np.quantile(self.draws, 1 - target)) - 1e-9


def _signs(rows: np.ndarray, bits: int) -> np.ndarray:
    """Zone numbers: the signs of ``bits`` projections."""
    if not bits:
        return np.zeros(len(rows), np.int64)
    a, _ = _projection(TABLES + 1000, rows.shape[1], bits)
    return (rows @ a > 0) @ (np.int64(1) << np.arange(bits))


def _zones(row: np.ndarray, bits: int, cosines: np.ndarray) -> np.ndarray:
    """Zones in order of their chance to hold a neighbour, until the target is reached."""
    if not bits:
        return np.zeros(1, np.int64)
    a, _ = _projection(TABLES + 1000, len(row), bits)
    y, c = row @ a, float(np.quantile(cosines, 0.25))
    up = _phi(c * y / np.sqrt(np.maximum(1e-9, (np.square(a).sum(axis=0) - y * y) / max(1, len(row) - 1) * (1 - c * c))))
    chance = np.ones(1)
    for p in up[::-1]:
        chance = (chance[:, None] * np.array([1 - p, p])).ravel()  # the first projection is the lowest bit
    order = np.argsort(-chance, kind="stable")
    return order[: int(np.searchsorted(np.cumsum(chance[order]), ZONE_TARGET)) + 1]


def _place(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in by_length(batch, "vector"):
                yield pd.DataFrame({"zone": _signs(unit(matrix(part["vector"])), bits), "id": part["id"], "vector": part["vector"]})

    return run


def _plan(bits: int, cosines: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, vector in zip(batch["id"], batch["vector"]):
                zones = _zones(unit(np.asarray(vector, np.float64)[None, :])[0], bits, cosines)
                yield pd.DataFrame({"zone": zones, "query_id": own, "vector": [vector] * len(zones)})

    return run


def _nearest(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, query: np.ndarray, own: int, k: int):
    """The k nearest of ``rows``; equal ids count once, ties go to smaller ids."""
    size = math.sqrt((query * query).sum())
    rough = rows @ query / (norms * size)
    rough[ids == own] = -np.inf
    close = np.arange(len(rough))
    if len(rough) > 4 * k:
        near = np.flatnonzero(rough >= np.partition(rough, -4 * k)[-4 * k] - 1e-9)
        close = near if len(set(ids[near].tolist()) - {own}) >= k else close
    close = close[rough[close] > -np.inf]
    exact = (rows[close] * query).sum(axis=1) / (norms[close] * size)  # one order of additions for all rows
    order = np.lexsort((ids[close], -exact))
    first = np.sort(np.unique(ids[close][order], return_index=True)[1])[:k]
    return ids[close][order][first], exact[order][first]


class Buckets:
    """The rows of one zone by their buckets in each table."""

    def __init__(self, rows: np.ndarray, tables: int, count: int):
        self.count, self.tables = count, []
        scaled = unit(rows)
        for t in range(tables):
            a, b = _projection(t, rows.shape[1], count)
            buckets, of_row = np.unique(_steps(scaled @ a, b), axis=0, return_inverse=True)
            self.tables.append((np.ascontiguousarray(buckets.T), of_row.ravel()))

    def visited(self, row: np.ndarray, cosines: np.ndarray, target: float) -> np.ndarray:
        """The rows in the buckets that a query visits."""
        each = 1 - (1 - target) ** (1 / len(self.tables))
        seen = None
        for t, (buckets, of_row) in enumerate(self.tables):
            probing = Probing(row, t, self.count, cosines)
            hit = (probing.of(buckets) >= probing.least(each))[of_row]
            seen = hit if seen is None else seen | hit
        return np.flatnonzero(seen)


def _rerank(k: int, tables: int, count: int, cosines: np.ndarray, target: float, every: bool = False):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            for n, part in by_length(index, "vector"):
                ids, rows = part["id"].to_numpy(), matrix(part["vector"])
                norms = np.sqrt((rows * rows).sum(axis=1))
                buckets = None if every else Buckets(rows, tables, count)
                for own, vector in zip(queries["query_id"], queries["vector"]):
                    if len(vector) != n:
                        continue
                    query = np.asarray(vector, np.float64)
                    at = np.arange(len(ids)) if every else buckets.visited(unit(query[None, :])[0], cosines, target)
                    if len(at):
                        found, score = _nearest(ids[at], rows[at], norms[at], query, own, k)
                        out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def _cosines(rows: DataFrame, k: int) -> np.ndarray:
    """Cosines of SAMPLE_QUERIES rows to their k nearest among all rows; DRAWS of them.

    The sample is compared with every batch of rows; the best of each batch are merged.
    """
    probes = [(r["id"], r["vector"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()]
    of_length = {n: unit(np.array([v for _, v in probes if len(v) == n], np.float64)) for n in {len(v) for _, v in probes}}
    names = {n: np.array([i for i, v in probes if len(v) == n]) for n in of_length}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in by_length(batch, "vector"):
                if n in of_length:
                    ids, cosines = part["id"].to_numpy(), of_length[n] @ unit(matrix(part["vector"])).T
                    cosines[names[n][:, None] == ids[None, :]] = -2.0
                    best = np.sort(cosines, axis=1)[:, -k:]
                    yield pd.DataFrame({"probe": np.repeat(names[n], best.shape[1]), "score": best.ravel()})

    best = rows.mapInPandas(run, "probe long, score double").where("score > -2").groupBy("probe").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k).alias("best"))
    found = np.sort(np.array([x for r in best.collect() for x in r["best"]], np.float64))
    found = np.clip(found, 0.0, 0.9999) if len(found) else np.zeros(1)
    draws = found[np.linspace(0, len(found) - 1, DRAWS).round().astype(int)]
    return np.random.default_rng(SEED).permutation(draws)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, tables: int = TABLES, target: float = TARGET, zone_rows: int = ZONE_ROWS) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``.

    Returns ``query_id, rank, vec_id, score``: rank from 1, score the cosine in
    double precision, ties to the smaller id. A row is no candidate of a query
    with its own id. Every row is indexed; how near neighbours are is measured for
    SAMPLE_QUERIES rows against all rows. No number of buckets is set: a query visits
    all above the chance at which its target is reached. A query for which the visited
    buckets hold fewer than ``k`` rows is searched against all rows, in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null id, take no part; nor are vectors of unequal length
    compared. Rows that repeat an id count once, at their best score. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    clean = lambda df: df.where(F.expr(usable(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), as_doubles(vector).alias("vector"))
    rows, asked = clean(vectors), clean(queries)
    rows_in = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, rows_in) / zone_rows)))
    cosines = _cosines(rows, k)
    # A zone that is too large is dealt out to several tasks by id.
    index = materialize(rows.mapInPandas(_place(bits), "zone long, id long, vector array<double>"), "ann-index")
    parts = index.groupBy("zone").count().select("zone", F.ceil(F.col("count") / zone_rows).cast("int").alias("parts"))
    placed = index.join(parts, "zone").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    plan = asked.mapInPandas(_plan(bits, cosines), "zone long, query_id long, vector array<double>")
    sent = plan.join(parts, "zone").select("zone", "query_id", "vector", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    schema = "query_id long, vec_id long, score double"
    count = projections_for(rows_in)
    near = materialize(placed.groupBy("zone", "part").cogroup(sent.groupBy("zone", "part")).applyInPandas(_rerank(k, tables, count, cosines, target), schema), "ann-found")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    enough = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = asked.join(enough, "id", "left_anti")
    blocks = max(1, math.ceil(rows_in / zone_rows))
    every = rows.select(F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)").alias("zone"), "id", "vector")
    to_all = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("zone"), F.col("id").alias("query_id"), "vector")
    rest = every.groupBy("zone").cogroup(to_all.groupBy("zone")).applyInPandas(_rerank(k, tables, count, cosines, target, every=True), schema)
    rest = rest.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_semi")
    merged = near.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
