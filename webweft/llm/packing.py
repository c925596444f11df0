"""Best-fit packing of tokenized documents, improved by swap-based local search.

Documents are tokenized in a map over partitions; only piece descriptions travel
further. Pieces are dealt round-robin into blocks of bounded size, or into blocks of
consecutive documents where an order is given; each block is
packed best-fit, and a local search then empties bins: it moves pieces, or exchanges
one for one or two for one, from one underfull bin to another, the emptiest first.
The sum of squared fills grows with every step, so the search ends by itself, when no
step is left or no bin can be spared. It starts from the pieces in descending order
and, unless that reaches the bound, from coarse classes of length as well; the better
result counts.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1024
END_ID = 2
#: Documents dealt to one packing block.
BLOCK_DOCS = 16_384
#: Widths of the classes of length by which pieces are ordered for the fits that the search starts from.
STARTS = (1, 256)


class ByteBpe:
    """Token ids, as little-endian uint32 bytes, of whole texts.

    The vocabulary is read as ranks, which encode faster than the ``tokenizers``
    library and give its ids; texts that name a special token are left to it.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.exact = json_path, None

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
        from tokenizers import Tokenizer

        self.exact = self.exact or Tokenizer.from_file(self.json_path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def default_tokenizer() -> dict[str, str]:
    """Paths of the public byte-level BPE; any files of that form may be given instead."""
    import public_tokenizers as tokenizers

    return {"ranks_path": tokenizers.path("byte_bpe_50k.tiktoken"), "json_path": tokenizers.path("byte_bpe_50k.json"), "pattern": tokenizers.PATTERN}


def cut(ids: bytes, max_tokens: int = MAX_TOKENS) -> Iterator[tuple[int, int, bytes]]:
    """start, length and ids of a document's pieces; the first piece takes the remainder."""
    count = len(ids) // 4
    start, end = 0, (count - 1) % max_tokens + 1
    while start < count:
        yield start, end - start, ids[4 * start : 4 * end]
        start, end = end, end + max_tokens


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: dict[str, str] | None = None, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, and the document's position) of every document."""
    paths = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = ByteBpe(**paths).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            places = batch["_position"] if position else [0] * len(batch)
            rows = [(doc, n, start, length, zlib.crc32(part), part if with_ids else None, place) for doc, t, place in zip(batch["_key"], batch["_text"], places) for n, (start, length, part) in enumerate(cut(encode(t) + end, max_tokens))]
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "position"])
            yield frame.drop(columns=["ids"] * (not with_ids) + ["position"] * (not position))

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *([F.col(position).cast("long").alias("_position")] if position else []))
    more = ", ids binary" * with_ids + ", position long" * bool(position)
    kind = rows.schema["_key"].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):  # null ids would turn into floats in pandas
        rows = rows.withColumn("_key", F.col("_key").cast("string"))
        out = rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long" + more)
        return out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return rows.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + more)


class _Bins:
    """Bins of one block, with an index of underfull bins by content and free space."""

    def __init__(self, size: int):
        self.size, self.items, self.free = size, [], []
        self.at: dict[tuple[int, int], set[int]] = defaultdict(set)  # (length or 0, free): bins
        self.frees: dict[int, int] = defaultdict(int)  # length or 0: bit set of free spaces
        self.by_length: list[dict[int, list[int]]] = []  # of a bin, length: items

    def best_fit(self, lengths: np.ndarray, order: np.ndarray) -> None:
        open_bins: dict[int, list[int]] = defaultdict(list)
        spaces = 0
        for item in order.tolist():
            length = int(lengths[item])
            fitting = spaces >> length
            if fitting:
                space = length + (fitting & -fitting).bit_length() - 1
                b = open_bins[space].pop()
                if not open_bins[space]:
                    spaces ^= 1 << space
            else:
                b, space = len(self.items), self.size
                self.items.append([])
                self.free.append(0)
            self.items[b].append(item)
            self.free[b] = space - length
            if space > length:
                open_bins[space - length].append(b)
                spaces |= 1 << (space - length)

    def _index(self, b: int, add: bool) -> None:
        free = self.free[b]
        if not free:
            return
        for length in (0, *self.by_length[b]):
            bins = self.at[length, free]
            if add:
                bins.add(b)
                self.frees[length] |= 1 << free
            else:
                bins.discard(b)
                if not bins:
                    self.frees[length] &= ~(1 << free)

    def _carry(self, source: int, out: tuple[int, ...], target: int, back: int) -> None:
        """Move pieces of the lengths ``out`` to ``target`` and one of length ``back`` (0: none) here."""
        self._index(target, False)
        for length in out:
            self._shift(source, target, length)
        if back:
            self._shift(target, source, back)
        self._index(target, True)

    def _shift(self, source: int, target: int, length: int) -> None:
        held = self.by_length[source]
        item = held[length].pop()
        if not held[length]:
            del held[length]
        self.by_length[target].setdefault(length, []).append(item)
        self.free[source] += length
        self.free[target] -= length

    def _step(self, b: int) -> bool:
        """The exchange out of bin ``b`` by which squared fill grows most; False if there is none."""
        held = self.by_length[b]
        singles = sorted(held, reverse=True)
        outs = [(x,) for x in singles]
        outs += [(x, y) for i, x in enumerate(singles) for y in singles[i:] if x + y <= self.size and (x != y or len(held[x]) > 1)]
        outs.sort(key=sum, reverse=True)
        best = (0, (), 0, 0)
        for out in outs:
            total = sum(out)
            if total * (total + self.free[b]) <= best[0]:
                break
            for back, frees in self.frees.items():
                carried = total - back
                if carried <= 0 or not frees:
                    continue
                fitting = frees >> carried
                if fitting:
                    free = carried + (fitting & -fitting).bit_length() - 1
                    gain = carried * (carried + self.free[b] - free)  # half of what the squared fills grow by
                    if gain > best[0]:
                        best = (gain, out, back, free)
        gain, out, back, free = best
        if not gain:
            return False
        self._carry(b, out, min(self.at[back, free]), back)
        return True

    def search(self, lengths: np.ndarray) -> None:
        least = -(-int(lengths.sum()) // self.size)
        self.by_length = []
        for items in self.items:
            held: dict[int, list[int]] = {}
            for i in items:
                held.setdefault(int(lengths[i]), []).append(i)
            self.by_length.append(held)
        for b in range(len(self.items)):
            self._index(b, True)
        used, moved = len(self.items), True
        while moved and used > least:
            moved = False
            for b in sorted((b for b in range(len(self.items)) if self.by_length[b] and self.free[b]), key=lambda b: (-self.free[b], b)):
                if used <= least:
                    break
                if not self.by_length[b] or not self.free[b]:
                    continue
                self._index(b, False)
                while self.by_length[b] and self._step(b):
                    moved = True
                if self.by_length[b]:
                    self._index(b, True)
                else:
                    used -= 1
        self.items = [[i for held in x.values() for i in held] for x in self.by_length if x]


def pack_lengths(lengths, size: int = MAX_TOKENS) -> list[list[int]]:
    """Bins, as lists of item numbers, for items of the given lengths (1 to size)."""
    lengths = np.asarray(lengths, np.int64)
    best: list[list[int]] | None = None
    for width in STARTS:
        bins = _Bins(size)
        bins.best_fit(lengths, np.argsort(-(lengths // width), kind="stable"))
        bins.search(lengths)
        if best is None or len(bins.items) < len(best):
            best = bins.items
        if len(best) <= -(-int(lengths.sum()) // size):
            break
    return best or []


def _pack_in_order(made: DataFrame, kind: str, max_tokens: int, block_docs: int) -> DataFrame:
    fields = [f for f in made.schema.fields if f.name not in ("doc_id", "position")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["position", "piece"], ignore_index=True, kind="stable")
        lengths = frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        bins = [sorted(items) for items in pack_lengths(lengths, max_tokens)]
        bins.sort(key=lambda items: max(items, key=lambda i: (lengths[i], -i)))
        for n, items in enumerate(bins):
            own = lengths[items]
            sequence[items] = (int(frame["block"].iloc[0]) << 32) + n
            offset[items] = np.cumsum(own) - own
        return frame.drop(columns=["position", "block"]).assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(["doc_id string", *(f"{f.name} {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    dealt = made.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", F.expr(f"position div {int(block_docs)}"))
    return dealt.groupBy("block").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, tokenizer: dict[str, str] | None = None, block_docs: int = BLOCK_DOCS, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """Pack ``docs`` into sequences of at most ``max_tokens`` token ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row
    per piece, and with ``with_ids`` the ids themselves (little-endian uint32).
    Documents end with ``end_id``; only those longer than ``max_tokens`` are cut.

    Null or empty text is the end id alone. Null and repeated doc_ids are packed
    like any other row, one set of pieces per row; texts of any length are encoded
    whole. Other columns are ignored, whatever their names; an empty table gives no
    rows.

    ``position`` names a column that numbers the documents from 0. Blocks are then
    ranges of it, and sequence ids ascend with the block and, inside a block, with
    the position of a sequence's longest piece.
    """
    if position:
        return _pack_in_order(pieces(docs, key, text, max_tokens, end_id, tokenizer, with_ids, position), docs.schema[key].dataType.simpleString(), max_tokens, block_docs)
    blocks = max(1, math.ceil(docs.count() / block_docs))
    made = pieces(docs, key, text, max_tokens, end_id, tokenizer, with_ids)
    fields = [f for f in made.schema.fields if f.name not in ("doc_id",)]
    kind = made.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        frame = pd.concat(rows, ignore_index=True).sort_values(["doc_id", "piece"], ignore_index=True, kind="stable")
        lengths = frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        base = TaskContext.get().partitionId() << 32
        for n, items in enumerate(pack_lengths(lengths, max_tokens)):
            own = lengths[items]
            sequence[items] = base + n
            offset[items] = np.cumsum(own) - own
        yield frame.assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(["doc_id string", *(f"{f.name} {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long"])
    dealt = made.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(blocks)
    return dealt.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
