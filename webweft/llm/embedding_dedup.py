"""Near-duplicate vectors by sorted projection passes.

Exact copies are gathered into classes first. Each pass hashes every class's
vector to sixty random-hyperplane signs, sorts by the concatenated signs within
its label, and compares each vector with the block it falls in and the block
before it, over the edges of partitions too. Verified pairs of all passes are
united into components. Inside a component, and nowhere else, all members are then
compared block by block, so the link counts do not depend on which pass saw which
pair. The number of passes follows from how many signs it takes, measured on all
rows of each label, to cut a label into cells of half a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.llm.components import components
from webweft.llm.vectors import as_doubles, by_length, matrix, unit, usable
from webweft.runtime import materialize

THRESHOLD = 0.98
#: Neighbours on either side that a sorted vector is compared with, at least.
WINDOW = 1024
#: Chance that a lone pair at the threshold escapes all passes.
MISS = 1e-4
SIGNS = 60
#: Share of a label's vectors that may be left in cells wider than half a window.
CROWDED = 0.02
#: Vectors of one exact comparison block.
BLOCK = 2048
#: Cosines this near to the threshold are decided by exactly rounded sums.
DOUBT = 1e-9
#: Pairs of a block up to which cosines are taken one by one, and not of all.
PAIRS = 16_384
SEED = 20_240_501


def passes_for(depth: float, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has agreed on its first ``depth``
    signs, which put it into one cell of half a window, but for the chance ``miss``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    hit = agree ** max(1.0, depth)
    return max(2, math.ceil(math.log(miss) / math.log(1 - hit))) if hit < 1 else 2


def depth_of(classes: DataFrame, window: int) -> int:
    """Signs after which all labels but a share ``CROWDED`` of each are cut into cells of
    at most half a window. Dense labels, whose vectors point one way, take more signs."""
    kind = classes.schema["label"].dataType.simpleString()
    crowded = classes.groupBy("label").count().where(F.col("count") > window // 2)
    rows = classes.select("node", "label", "vector").mapInPandas(_hash_rows(1, False), f"pass int, label {kind}, dim int, signs long, node long")
    cells = rows.join(crowded, "label").select("label", "dim", "count", "signs", F.explode(F.sequence(F.lit(2), F.lit(SIGNS), F.lit(2))).alias("depth"))
    cells = cells.groupBy("label", "dim", "count", "depth", F.expr(f"signs >> ({SIGNS} - depth)").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    wide = cells.groupBy("label", "count", "depth").agg(F.sum(F.when(F.col("n") > window // 2, F.col("n")).otherwise(0)).alias("wide"))
    needed = wide.where(F.col("wide") > CROWDED * F.col("count")).agg(F.max("depth")).first()[0]
    return min(SIGNS, (needed or 0) + 2)


def _sign_keys(rows: np.ndarray, passes: int) -> np.ndarray:
    """Column p: the signs of pass p as a non-negative long, most significant first."""
    bits = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(rows), passes), np.int64)
    for p in range(passes):
        planes = np.random.default_rng([SEED, p, rows.shape[1]]).standard_normal((rows.shape[1], SIGNS))
        out[:, p] = (rows @ planes > 0) @ bits
    return out


def _hash_rows(passes: int, with_vector: bool = True):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in by_length(batch, "vector"):
                keys = _sign_keys(unit(matrix(part["vector"])), passes)
                for p in range(passes):
                    made = {"pass": np.int32(p), "label": part["label"], "dim": np.int32(n), "signs": keys[:, p], "node": part["node"]}
                    yield pd.DataFrame(made | ({"vector": part["vector"]} if with_vector else {}))

    return run


def linked_pairs(vectors: np.ndarray, threshold: float, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the vectors, j from ``own`` on, that have a cosine of at least
    ``threshold``; the last bits of a matrix product depend on its shape, so doubtful
    cosines are taken again in one order. Single precision rules most pairs out first."""
    rows = unit(vectors)
    rough = rows.astype(np.float32)
    off = (rows.shape[1] + 8) * 2.0**-23  # more than rounding to single precision takes from a cosine
    j, i = np.nonzero(rough[own:] @ rough.T >= np.float32(threshold - off))
    j += own
    i, j = i[i < j], j[i < j]
    cosines = np.einsum("ij,ij->i", rows[i], rows[j]) if len(i) <= PAIRS else (rows[own:] @ rows.T)[j - own, i]
    hit = cosines >= threshold
    for k in np.flatnonzero(np.abs(cosines - threshold) < DOUBT).tolist():
        a, b = (vectors[p[k]] / np.abs(vectors[p[k]]).max() for p in (i, j))
        hit[k] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
    return i[hit], j[hit]


def linked(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors have a cosine of at least ``threshold``, themselves included."""
    i, j = linked_pairs(vectors, threshold)
    out = np.eye(len(vectors), dtype=bool)
    out[i, j] = out[j, i] = True
    return out


def _local_roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of ``count`` places over the pairs ``i, j``."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[i], root[j])
        reach = root.copy()
        for ends in (i, j, root[i], root[j]):
            np.minimum.at(reach, ends, least)
        reach = reach[reach]
        if (reach == root).all():
            return root
        root = reach


def _united(rows: pd.DataFrame, threshold: float, own: int = 0) -> pd.DataFrame:
    """Edges that connect what the links of the rows from ``own`` on connect."""
    nodes = rows["node"].to_numpy()
    root = _local_roots(len(nodes), *linked_pairs(matrix(rows["vector"]), threshold, own))
    moved = root != np.arange(len(root))
    return pd.DataFrame({"a": nodes[root[moved]], "b": nodes[moved]})


def _window_edges(threshold: float, window: int):
    """Edges (``a``, ``b``) of one sorted partition, and its first and last rows with
    the number of the edge between partitions that they lie at."""
    held_columns = ["pass", "label", "dim", "node", "vector"]

    def pairs(own: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        # The block before has been compared in itself.
        found = _united(own, threshold) if before is None else _united(pd.concat([before, own], ignore_index=True), threshold, len(before))
        return found.assign(**dict.fromkeys(["edge", *held_columns]))

    def at_edge(rows: pd.DataFrame, edge: int) -> pd.DataFrame:
        return rows[held_columns].assign(a=None, b=None, edge=edge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        first: list[pd.DataFrame] = []
        last: pd.DataFrame | None = None
        held: pd.DataFrame | None = None  # rows that await their block, of one pass and label
        before: pd.DataFrame | None = None
        group = None

        def flush(final: bool):
            nonlocal held, before
            while held is not None and (len(held) >= window or final and len(held)):
                own, held = held.iloc[:window], held.iloc[window:]
                yield pairs(own, before)
                before = own

        for batch in batches:
            if (missing := window - sum(map(len, first))) > 0:
                first.append(batch.iloc[:missing])
            last = batch.iloc[-window:] if last is None else pd.concat([last, batch]).iloc[-window:]
            kinds = list(zip(batch["pass"], batch["label"], batch["dim"]))
            starts = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                if kinds[start] != group:
                    yield from flush(True)
                    held, before, group = None, None, kinds[start]
                part = batch.iloc[start:end]
                held = part if held is None or not len(held) else pd.concat([held, part], ignore_index=True)
                yield from flush(False)
        yield from flush(True)
        if last is not None:
            yield at_edge(pd.concat(first), number - 1)
            yield at_edge(last, number)

    return run


def _over_edge(threshold: float):
    """Edges between the last rows of one partition and the first rows of the next."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = [_united(rows.drop_duplicates("node"), threshold) for _, rows in frame.groupby(["pass", "label", "dim"])]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=["a", "b"], dtype="int64")

    return run


def _count_links(threshold: float):
    """Rows of two blocks (or of many small components): links that each has in the group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["component", "part", "node"], ignore_index=True)
        nodes, sizes, parts = frame["node"].to_numpy(), frame["size"].to_numpy(), frame["part"].to_numpy()
        counts = np.zeros(len(frame), np.int64)
        edges = np.flatnonzero(np.diff(frame["component"].to_numpy())) + 1
        for start, end in zip([0, *edges], [*edges, len(frame)]):
            part = parts[start:end]
            near = linked(matrix(frame["vector"].iloc[start:end]), threshold)
            np.fill_diagonal(near, False)
            if part[0] != part[-1]:
                near &= part[:, None] != part[None, :]
            counts[start:end] = near @ sizes[start:end]
        return pd.DataFrame({"node": nodes, "links": counts})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """Links between vectors of equal label with cosine of at least ``threshold``.

    Returns ``key, n_links, component_id, kept``, one row per input row:
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest key reachable by links, ``kept`` says that it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null label, link with nothing; vectors of unequal length do not
    link either. Rows with equal vectors and labels are linked, whatever their keys;
    rows with equal keys are vectors of their own. A null key is not smaller than any
    other; a component of null keys alone has a null id. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.transform(as_doubles(vector), lambda x: x + F.lit(0.0)).alias("_vector"), F.expr(f"{usable(vector)} and `{label}` is not null").alias("_in"))
    # A class is known by two hashes of its label and vector, by which rows find it again.
    known_by = [F.xxhash64("_label", "_vector").alias("node"), F.xxhash64("_vector", F.lit(SEED)).alias("check")]
    good = rows.where("_in")
    classes = good.groupBy(F.col("_label").alias("label"), F.col("_vector").alias("vector")).agg(F.count(F.lit(1)).alias("size"), F.min("_key").alias("least"), *(F.any_value(c).alias(n) for c, n in zip(known_by, ("node", "check"))))
    classes = materialize(classes, "vector-classes")
    count = classes.count()
    passes = passes_for(depth_of(classes, window), threshold, miss)
    kind = classes.schema["label"].dataType.simpleString()
    hashed = classes.select("node", "label", "vector").mapInPandas(_hash_rows(passes), f"pass int, label {kind}, dim int, signs long, node long, vector array<double>")
    order = ["pass", "label", "dim", "signs", "node"]
    parts = max(1, math.ceil(count * passes / (8 * window)))
    schema = f"a long, b long, edge int, pass int, label {kind}, dim int, node long, vector array<double>"
    seen = materialize(hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_window_edges(threshold, window), schema), "vector-windows")
    over = seen.where("edge is not null").drop("a", "b").groupBy("edge").applyInPandas(_over_edge(threshold), "a long, b long")
    found = materialize(components(seen.where("edge is null").select("a", "b").unionByName(over), "a", "b"), "vector-components")

    members = classes.join(found, "node")
    per = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("component_id")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    per = materialize(per, "vector-sizes")
    small = max(1, math.ceil((per.where("parts = 1").agg(F.sum("n")).first()[0] or 0) / (4 * BLOCK)))
    cells = members.join(per, "component").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    # A large component is compared block against block; small ones share a task.
    pairs = cells.select(
        "component", "part", "node", "size", "vector", "parts",
        F.explode(F.expr("sequence(0, parts - 1)")).alias("_other"),
    ).select(
        "component", "part", "node", "size", "vector",
        F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.col("component")).alias("_group"),
        F.when(F.col("parts") == 1, F.expr(f"cast(pmod(xxhash64(component), {small}) as int)")).otherwise(F.least("part", "_other")).alias("_low"),
        F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.greatest("part", "_other")).alias("_high"),
    )
    links = pairs.groupBy("_group", "_low", "_high").applyInPandas(_count_links(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "check", "size", "least").join(found, "node", "left").join(per.select("component", "component_id"), "component", "left").join(links, "node", "left").select(
        "node", "check",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    done = good.select("_key", *known_by).join(known, ["node", "check"]).select("_key", "n_links", "component_id")
    rest = rows.where("not coalesce(_in, false)").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return done.unionByName(rest).select(F.col("_key").alias(key), "n_links", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))
