"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

``postings`` holds each pair of a line key and a document; ``counts`` its exact
reference count and the smallest document of each key. Beside them stands a
cuckoo filter per shard of the key space, holding the keys that two or more
documents share. A line whose key is not in its shard's filter stays without
touching the count table; the few that pass are verified against exact counts.
Inserting documents adds to the tables and filters, deleting documents takes the
same entries out again, and both touch only the keys of those documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.runtime import materialize

SPACE = b" \t\n\x0b\x0c\r"
#: Lines whose key has fewer code points are never dropped.
MIN_KEY_CHARS = 10
#: Keys of one filter, and postings of one probing task.
SHARD_KEYS = 100_000
PROBE_ROWS = 100_000

_SLOTS = 4
_LOAD = 0.9
_MAX_KICKS = 500


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; two buckets for each key.

    Keys are 128 bits as two uint64 arrays. A filter that cannot place a key
    doubles and asks for its keys again, which the exact tables hold.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(0, math.ceil(math.log2(max(1, len(low)) / (_SLOTS * _LOAD))))
        while True:
            made = cls(np.zeros((buckets, _SLOTS), np.uint16))
            if made.insert(low, high):
                return made
            buckets *= 2

    def _places(self, low, high):
        mark = (high & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        size = np.uint64(len(self.table) - 1)
        first = low & size
        return mark, first.astype(np.int64), (first ^ (self._spread(mark) & size)).astype(np.int64)

    @staticmethod
    def _spread(mark):
        return np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)

    def contains(self, low, high) -> np.ndarray:
        mark, one, two = self._places(low, high)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, low, high) -> bool:
        table, size = self.table, len(self.table) - 1
        for mark, one, two in zip(*(x.tolist() for x in self._places(low, high))):
            place = one if 0 in table[one] else two
            for kick in range(_MAX_KICKS):
                row = table[place]
                empty = np.flatnonzero(row == 0)
                if len(empty):
                    row[empty[0]] = mark
                    break
                slot = (kick + mark) % _SLOTS
                mark, row[slot] = int(row[slot]), mark
                place ^= (mark * 0x5BD1E995) & size
            else:
                return False
        return True

    def delete(self, low, high) -> bool:
        """Take out keys that were inserted; False if one had no fingerprint left."""
        done = True
        for mark, one, two in zip(*(x.tolist() for x in self._places(low, high))):
            for place in (one, two):
                at = np.flatnonzero(self.table[place] == mark)
                if len(at):
                    self.table[place, at[0]] = 0
                    break
            else:
                done = False
        return done

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())


def _halves(keys) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short to be dropped.
    The key is the line without outer white space, A-Z lower-cased."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_KEY_CHARS or len(key) < 4 * MIN_KEY_CHARS and len(key.decode()) < MIN_KEY_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, docs = [], []
        for doc, text in zip(batch["_doc"], batch["_text"]):
            found = {k for k in map(line_key, text.encode().split(b"\n")) if k}
            keys += found
            docs += [doc] * len(found)
        yield pd.DataFrame({"line_key": keys, "doc_id": np.array(docs, np.int64)})


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, drop in zip(batch["_text"], batch["_drop"]):
            if text is None:
                texts.append(None), lines.append(1), dropped.append(0)
                continue
            all_lines = text.encode().split(b"\n")
            gone = () if drop is None else set(drop)
            kept = [x for x in all_lines if line_key(x) not in gone] if gone else all_lines
            texts.append(b"\n".join(kept).decode()), lines.append(len(all_lines)), dropped.append(len(all_lines) - len(kept))
        yield batch.drop(columns=["_text", "_drop"]).assign(_kept=texts, _lines=lines, _dropped=dropped)


def _build_filter(keys: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "filter": [CuckooFilter.of(*_halves(keys["line_key"])).to_bytes()]})


def _probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    rows = rows[["line_key", "doc_id"]]
    if rows.empty or filters.empty:
        return rows.iloc[:0]
    return rows[CuckooFilter.from_bytes(filters["filter"].iloc[0]).contains(*_halves(rows["line_key"]))]


def _revise(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """One shard's filter after its keys came (+1) or went (-1); rebuilt by the
    caller where the filter is full (an empty value)."""
    shard = (keys if len(keys) else filters)["shard"].iloc[0]
    data = filters["filter"].iloc[0] if len(filters) else None
    if data is not None and len(keys):
        held, gone, came = CuckooFilter.from_bytes(data), keys[keys["step"] < 0], keys[keys["step"] > 0]
        fits = not len(gone) or held.delete(*_halves(gone["line_key"]))
        fits = fits and (not len(came) or held.insert(*_halves(came["line_key"])))
        data = held.to_bytes() if fits else None
    return pd.DataFrame({"shard": [shard], "filter": [data or b""]})


def _key_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("line_key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """Exact tables and filters of the documents put in so far.

    ``insert`` and ``delete`` return a new index; the old one stays valid.
    Documents with a null id are not indexed and never lose lines. Rows that
    share a doc_id are one document; ids are whole numbers. Null text is one empty
    line. Texts and lines of any length are read whole. Of a tie, that is of several
    documents with a line, the smallest id keeps it. An empty table makes an empty
    index, to which documents can be added. Other columns are ignored.
    """

    postings: DataFrame  # line_key binary, doc_id long
    counts: DataFrame  # line_key binary, refs long, keeper long
    filters: DataFrame  # shard int, filter binary
    shards: int

    @staticmethod
    def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
        rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
        return rows.mapInPandas(_postings, "line_key binary, doc_id long").distinct()

    def _shard(self):
        return F.pmod(F.xxhash64("line_key"), F.lit(self.shards)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        postings = materialize(cls._read(docs, key, text), "line-postings")
        counts = materialize(_key_counts(postings), "line-counts")
        shared = counts.where("refs > 1")
        index = cls(postings, counts, counts, max(1, math.ceil(shared.count() / SHARD_KEYS)))
        return replace(index, filters=materialize(index._filters_of(shared), "line-filters"))

    def _filters_of(self, shared: DataFrame) -> DataFrame:
        return shared.select(self._shard().alias("shard"), "line_key").groupBy("shard").applyInPandas(_build_filter, "shard int, filter binary")

    def _after(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """The index over ``postings``, which differ from ours in the keys ``touched``."""
        old = self.counts.join(touched, "line_key", "left_semi")
        new = materialize(_key_counts(postings.join(touched, "line_key", "left_semi")), "line-counts-new")
        counts = materialize(self.counts.join(touched, "line_key", "left_anti").unionByName(new), "line-counts")
        shared = counts.where("refs > 1")
        needed = math.ceil(shared.count() / SHARD_KEYS)
        if needed > 2 * self.shards:  # filters have outgrown their shards: deal the keys anew
            wider = LineIndex(postings, counts, counts, needed)
            return replace(wider, filters=materialize(wider._filters_of(shared), "line-filters"))
        was, now = old.where("refs > 1").select("line_key"), new.where("refs > 1").select("line_key")
        moved = now.join(was, "line_key", "left_anti").withColumn("step", F.lit(1)).unionByName(was.join(now, "line_key", "left_anti").withColumn("step", F.lit(-1)))
        moved = moved.withColumn("shard", self._shard())
        revised = materialize(moved.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_revise, "shard int, filter binary"), "line-filters-new")
        full = revised.where(F.length("filter") == 0).select("shard")
        rebuilt = self._filters_of(counts.where("refs > 1").withColumn("shard", self._shard()).join(full, "shard", "left_semi"))
        filters = materialize(revised.where(F.length("filter") > 0).unionByName(rebuilt), "line-filters")
        return LineIndex(postings, counts, filters, self.shards)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """Add documents; pairs that are known already change nothing."""
        new = materialize(self._read(docs, key, text).join(self.postings, ["line_key", "doc_id"], "left_anti"), "line-postings-new")
        return self._after(materialize(self.postings.unionByName(new), "line-postings"), new.select("line_key").distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take out the documents in the first column of ``doc_ids``."""
        gone = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc_id")).distinct()
        old = materialize(self.postings.join(gone, "doc_id", "left_semi"), "line-postings-gone")
        kept = self.postings.join(gone, "doc_id", "left_anti").select("line_key", "doc_id")
        return self._after(materialize(kept, "line-postings"), old.select("line_key").distinct())

    def drops(self) -> DataFrame:
        """``line_key, doc_id``: the documents that lose the lines of a key."""
        rows = self.postings.withColumn("shard", self._shard())
        # A hot line's postings spread over as many probing tasks as they need.
        spread = rows.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PROBE_ROWS).cast("int").alias("parts"))
        probes = rows.join(spread, "shard").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts) as int)"))
        copies = self.filters.join(spread, "shard").select("shard", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "filter")
        maybe = probes.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(_probe, "line_key binary, doc_id long")
        exact = self.counts.where("refs > 1").select("line_key", "keeper")
        return maybe.join(exact, "line_key").where("doc_id <> keeper").select("line_key", "doc_id")

    def dedup(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` without the lines that a smaller document of the index holds.

        Returns the columns of ``docs``, ``text`` replaced, then ``n_lines`` and
        ``n_dropped``, which replace columns of those names. Null text stays null
        and counts as one line. Rows with a null id come through as they are. A
        document whose lines all go keeps its row, with an empty text.
        """
        own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        drops = self.drops().groupBy(F.col("doc_id").alias("_drop_doc")).agg(F.collect_list("line_key").alias("_drop"))
        rest = [c for c in own if c != text]
        columns = [*rest, F.col(text).cast("string").alias("_text"), "_drop"]
        # Rows without an id are in no join, where they would meet in one task.
        rows = docs.where(F.col(key).isNotNull()).join(drops, F.col(key).cast("long") == F.col("_drop_doc"), "left").select(*columns)
        rows = rows.unionByName(docs.where(F.col(key).isNull()).withColumn("_drop", F.lit(None).cast("array<binary>")).select(*columns))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema), "_kept string, _lines long, _dropped long"])
        done = rows.mapInPandas(_strip, schema)
        return done.select(*(F.col("_kept").alias(text) if c == text else F.col(c) for c in own), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Build an index over ``docs`` and apply it to them: nulls, repeated ids, ties,
    empty tables and clashing columns as in ``LineIndex``."""
    return LineIndex.build(docs, key, text).dedup(docs, key, text)
