"""Exact Jaccard join on word shingles by partitioning the shingle universe.

Shingles hash to segments whose number depends on the size band of the smaller
document, so that two documents over the threshold differ in fewer shingles than
there are segments and hence agree on some whole segment. Every document files
the contents of its segments under (band, segment, content). Copies are gathered
into classes first and file once.

Candidates grow with the entries, not with the square of those under a key. Each
class is first compared with one that stands for its key and size; what links is
one component from then on. Keys that hold one component only need nothing more,
keys of few classes give the pairs of different components. Other keys are common:
documents left with too few rare keys to be sure of meeting buy certainty back
where it is cheapest, from one-deletion neighbourhoods of their largest rare
segments, which find partners that differ there by one shingle. Documents that
this cannot help are compared with the others of their crowd block by block.

Every candidate pair is decided exactly: parity sketches, whose bits two sets
cannot differ in without differing in as many shingles, rule pairs out; the
rest is verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.llm.components import components
from webweft.runtime import give_back, lean, local_table, materialize, small_batches

WORDS = 5
PERCENT = 80
#: Ratio of a size band's ends.
BAND_RATIO = 1.5
#: Classes under one key up to which their pairs are compared one by one.
KEY_PAIRS = 32
#: Classes of one writer under one key from which the key counts as common.
LOCAL_COMMON = 32
#: Keys filed by one bucket task, and buffered by one writer.
TASK_KEYS = 500_000
BUFFER_KEYS = 250_000
#: Classes whose rows are looked up by broadcasting their keys; more are joined.
LOOKED_UP = 200_000
#: Bytes of text and rows that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 18
CHUNK_ROWS = 500
#: Pairs of one class that one task verifies.
TASK_DOCS = 4096
#: Bits of a sketch for each shingle, at least.
SKETCH_BITS = 4
#: Classes of a crowd that are compared in one block, and the ratio of their sizes, more than that of any link.
BLOCK = 1024
STEP = 2.01

_U = np.uint64
_GOLD, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_STEP = 0x2545F4914F6CDD1D
_STIR = _U(0x5851F42D4C957F2D)
_BYTES = np.random.default_rng(977).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _STEP, np.uint64)
    up[0] = 1
    down = np.full(size, pow(_STEP, -1, 2**64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a run of bytes, A-Z lower-cased."""
    codes = _LOWER[np.frombuffer(text, np.uint8)]
    blank = _SPACE[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _powers(1 << max(16, (len(codes) + 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[codes] * up[: len(codes)])))
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str] | list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of five words; of a
    text of fewer words, its whole sequence as one; none of a text without words.
    Bytes are taken as UTF-8."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size < CHUNK):
            chunk.append(texts[at] if isinstance(texts[at], bytes) else texts[at].encode("utf-8", "surrogatepass"))
            size, at = size + len(chunk[-1]) + 1, at + 1
        words, starts = _word_hashes(b" ".join(chunk))
        bounds = np.cumsum([len(c) + 1 for c in chunk])
        firsts = np.searchsorted(starts, np.concatenate(([0], bounds)))
        rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            rolled = _mix(rolled * _GOLD + words[k : k + len(rolled)])
        for first, last in zip(firsts[:-1], firsts[1:]):
            if last - first >= WORDS:
                out.append(np.unique(rolled[first : last - WORDS + 1]))
            elif last > first:
                whole = np.zeros(1, np.uint64)
                for w in words[first:last]:
                    whole = _mix(whole * _GOLD + w)
                out.append(_mix(whole + _U(last - first)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands and the numbers of segments that make the join exact."""

    def __init__(self, percent: int = PERCENT):
        if not 50 <= percent <= 100:
            raise ValueError("percent is 50 to 100")
        self.percent = percent

    @staticmethod
    @lru_cache(maxsize=None)
    def edge(band: int) -> int:
        """Smallest size of a band."""
        return 1 if band == 0 else max(Bands.edge(band - 1) + 1, int(Bands.edge(band - 1) * BAND_RATIO))

    @staticmethod
    @lru_cache(maxsize=None)
    def of(size: int) -> int:
        band = 0
        while Bands.edge(band + 1) <= size:
            band += 1
        return band

    def larger(self, size: int) -> int:
        """Largest set that a set of this size can match."""
        return 100 * size // self.percent

    def differ(self, a: int, b: int) -> int:
        """Shingles that matching sets of these sizes can differ in, at most."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def segments(self, band: int) -> int:
        top = self.edge(band + 1) - 1
        least = self.differ(top, self.larger(top)) + 1
        return least + 1 + math.ceil(0.06 * least)

    def filed_in(self, codes: np.ndarray) -> np.ndarray:
        """Bands from sizes doubled, plus one where the band is the one below."""
        top = self.of(int(codes.max(initial=2)) // 2)
        edges = np.array([self.edge(b) for b in range(top + 1)])
        return np.searchsorted(edges, codes // 2, side="right") - 1 - codes % 2

    def filings(self, size: int) -> list[tuple[int, int]]:
        """Bands that a set files in, with the most it can differ from partners there."""
        own = self.of(size)
        out = [(own, self.differ(size, min(self.larger(size), self.edge(own + 1) - 1)))]
        below = self.edge(own) - 1
        if below and self.larger(below) >= size:
            out.append((own - 1, self.differ(size, below)))
        return out


def _segment_of(shingles: np.ndarray, segments: int) -> np.ndarray:
    return ((_mix(shingles * _GOLD) >> _U(32)) % _U(segments)).astype(np.int64)


def _key(content: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return _mix(content + _mix((segment.astype(np.uint64) << _U(16)) + _U(band + 1)))


def _contents(shingles: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each segment's content as one number and its size, and each shingle's segment."""
    place = _segment_of(shingles, segments)
    content = np.zeros(segments, np.uint64)
    np.add.at(content, place, _mix(shingles + _GOLD))
    return content, np.bincount(place, minlength=segments), place


def _class_of(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (digest & (2**64 - 1)) - 2**63, (digest >> 64) - 2**63


def sketch_of(shingles: np.ndarray) -> bytes:
    """The parity of the shingles in each of at least ``SKETCH_BITS`` cells a shingle.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    The number of cells is a power of two; halves put upon each other are the
    sketch of half as many cells.
    """
    bits = max(64, 1 << (SKETCH_BITS * len(shingles) - 1).bit_length())
    cells = np.bincount((_mix(shingles ^ _STIR) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _may_link(percent: int):
    """Pairs whose sizes and sketches do not rule a link out."""
    bands = Bands(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (n, m, one, two) in enumerate(zip(batch["n_a"], batch["n_b"], batch["sketch_a"], batch["sketch_b"])):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                words = min(len(one), len(two))
                apart = int(np.bitwise_count(_folded(one, words) ^ _folded(two, words)).sum())
                keep[i] = 100 * min(n, m) >= percent * max(n, m) and apart <= bands.differ(n, m)
            yield batch.loc[keep, ["a", "b"]]
            batch = None  # before the next is read
        give_back()

    return run


def _rows_and_sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Some rows at a time with the sets of their texts. A batch stays in Arrow's memory,
    as its texts as Python strings take several times as much."""
    for at in range(0, batch.num_rows, CHUNK_ROWS):
        rows = batch.slice(at, CHUNK_ROWS)
        yield rows, shingle_sets(rows.column("_text").cast(pa.binary()).to_pylist())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, sets in _rows_and_sets(batch):
            ids = [_class_of(s) if len(s) else (None, None) for s in sets]
            made = {
                "_row": rows.column("_row"), "_hash": rows.column("_hash"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "cls": pa.array([a for a, _ in ids], pa.int64()), "cls2": pa.array([b for _, b in ids], pa.int64()),
                "sketch": pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(made)
        batch = rows = made = None  # before the next is read
    give_back()


def _fine(sizes: np.ndarray) -> np.ndarray:
    """Size steps within which a key has one representative."""
    return np.floor(8 * np.log2(sizes)).astype(np.int64)


def _packed(kind: int, route: np.ndarray, *columns: np.ndarray) -> list[dict]:
    order = np.argsort(route, kind="stable")
    hit, starts = np.unique(route[order], return_index=True)
    parts = zip(hit.tolist(), np.split(order, starts[1:])) if len(hit) else ()
    return [{"task": task, "kind": kind, "data": b"".join(np.ascontiguousarray(c[part], np.int64).tobytes() for c in columns)} for task, part in parts]


def _filed(key: np.ndarray, cls: np.ndarray, code: np.ndarray, group: np.ndarray, tasks: int) -> list[dict]:
    """Entries on their way to the task of their key: kind 0. Of a key that is common
    here, and so nowhere gathered, one entry for each of its groups travels for all
    (kind 0, marked by kind 1), and the entries themselves, with the class that
    travels, to tasks dealt by class (kind 2)."""
    order = np.argsort(key, kind="stable")
    key, cls, code = key[order], cls[order], code[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    common = np.repeat(sizes > LOCAL_COMMON, sizes)
    route = lambda k: (k.view(np.uint64) % _U(tasks)).astype(np.int64)
    rare = np.flatnonzero(~common)
    rows = _packed(0, route(key[rare]), key[rare], cls[rare], code[rare])
    if common.any():
        key, cls, code, group = key[common], cls[common], code[common], group[order[common]]
        order = np.lexsort((cls, group, key))
        key, cls, code, group = key[order], cls[order], code[order], group[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        leader = cls[np.flatnonzero(first)][np.cumsum(first) - 1]
        marks = np.unique(key)
        rows += _packed(0, route(key[first]), key[first], cls[first], code[first])
        rows += _packed(1, route(marks), marks) + _packed(2, cls % tasks, key, cls, code, leader)
    return rows


def _unpacked(frame: pd.DataFrame, kind: int, width: int) -> np.ndarray:
    parts = [np.frombuffer(d, np.int64).reshape(width, -1) for d in frame.loc[frame["kind"] == kind, "data"]]
    return np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), np.int64)


def _gathered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries of kind 0 by key, and which of them have a marked key."""
    key, cls, code = _unpacked(frame, 0, 3)
    order = np.lexsort((code, cls, key))
    key, cls, code = key[order], cls[order], code[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (code[1:] != code[:-1])
    key, cls, code = key[fresh], cls[fresh], code[fresh]
    return key, cls, code, np.isin(key, _unpacked(frame, 1, 1)[0])


def _file(percent: int, tasks: int):
    """Keys of all segments, packed by bucket task: kinds 0 to 2 as of ``_filed``, the
    code being a class's size doubled, plus one in the band below its own; kind 3 a
    class, a band and how many segments are empty there."""
    bands = Bands(percent)

    def flush(held: np.ndarray, empties: list) -> pa.RecordBatch:
        key, cls, code = held
        rows = _filed(key, cls, code, _fine(code // 2), tasks) if len(key) else []
        if empties:
            cls, band, count = np.array(empties, np.int64).T
            rows += _packed(3, cls % tasks, cls, band, count)
        return pa.RecordBatch.from_pylist(rows, pa.schema({"task": pa.int64(), "kind": pa.int32(), "data": pa.binary()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Key, class and code in one buffer: many small arrays that outlive others would scatter a worker's memory.
        buffer, held, empties, seen = np.empty((3, BUFFER_KEYS), np.int64), 0, [], set()
        for batch in batches:
            for _, sets in _rows_and_sets(batch):
                for shingles in sets:
                    if not len(shingles):
                        continue
                    cls = _class_of(shingles)
                    if cls in seen:
                        continue
                    seen.add(cls)
                    for band, _ in bands.filings(len(shingles)):
                        segments = bands.segments(band)
                        content, size, _ = _contents(shingles, segments)
                        full = np.flatnonzero(size)
                        if held and held + len(full) > buffer.shape[1]:
                            yield flush(buffer[:, :held], empties)
                            held, empties, seen = 0, [], {cls}
                        if len(full) > buffer.shape[1]:
                            buffer = np.empty((3, len(full)), np.int64)
                        to = buffer[:, held : held + len(full)]
                        to[0], to[1], to[2] = _key(content[full], full, band).view(np.int64), cls[0], 2 * len(shingles) + (band < bands.of(len(shingles)))
                        held += len(full)
                        if len(full) < segments:
                            empties.append((cls[0], band, segments - len(full)))
            batch = None  # before the next is read
        yield flush(buffer[:, :held], empties)
        buffer = to = empties = seen = None
        give_back()

    return run


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket task: kind 0, each class under a key that others share, with the size
    code and the class that stands for those of its size under the key; kind 3 as filed."""
    key, cls, code, marked = _gathered(frame)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    shared = np.repeat(sizes > 1, sizes) | marked
    key, cls, code = key[shared], cls[shared], code[shared]
    fine = _fine(np.maximum(1, code // 2))
    order = np.lexsort((cls, fine, key))
    key, cls, code, fine = key[order], cls[order], code[order], fine[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (fine[1:] != fine[:-1])
    leader = cls[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else cls
    # Those that travelled for others of their key stand under the leader of all; their followers under them.
    far, empty = _unpacked(frame, 2, 4), _unpacked(frame, 3, 3)
    return pd.DataFrame(
        {
            "kind": np.repeat([0, 0, 3], [len(key), far.shape[1], empty.shape[1]]),
            "key": np.concatenate((key, far[0], empty[1])),
            "cls": np.concatenate((cls, far[1], empty[0])),
            "code": np.concatenate((code, far[2], empty[2])),
            "leader": np.concatenate((leader, far[3], empty[0])),
        }
    )


def _close(percent: int):
    """Pairs of different components under keys of few classes, for one bucket task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        key, cls, code, part = (frame[c].to_numpy() for c in ("key", "cls", "code", "part"))
        size = code // 2
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.diff(np.append(starts, len(key)))
        found, held = [np.zeros((2, 0), np.int64)], 0
        for count in np.unique(counts[counts > 1]).tolist():
            i, j = np.triu_indices(count, 1)
            of_count = starts[counts == count]
            step = max(1, 1_000_000 // len(i))
            for at in range(0, len(of_count), step):
                places = of_count[at : at + step, None] + np.arange(count)
                a, b = places[:, i].ravel(), places[:, j].ravel()
                good = (part[a] != part[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
                a, b = cls[a[good]], cls[b[good]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                held += len(a)
                if held > 2_000_000:
                    found, held = [np.unique(np.concatenate(found, axis=1), axis=1)], 0
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"a": both[0], "b": both[1]})

    return run


def _widen(percent: int, tasks: int):
    """For documents unsure of meeting under rare keys, packed as of ``_filed``: keys
    under which they are found by own content and by one deletion (code 0), and
    probes of either for the other (code 1); kind 4, common keys of documents that
    one deletion cannot help, and the class."""
    bands = Bands(percent)

    def flush(keys: list, classes: list, codes: list, stuck: list) -> pd.DataFrame:
        rows = []
        if keys:
            code = np.concatenate(codes)
            rows = _filed(np.concatenate(keys).view(np.int64), np.concatenate(classes), code, code, tasks)
        if stuck:
            cls = np.concatenate([np.full(len(k), c) for c, k in stuck])
            rows += _packed(4, cls % tasks, np.concatenate([k for _, k in stuck]).view(np.int64), cls)
        return pd.DataFrame(rows, columns=["task", "kind", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, classes, codes, stuck, held = [], [], [], [], 0
        for batch in batches:
            for text, cls, band, common in zip(batch["_text"], batch["cls"], batch["band"], batch["common"]):
                shingles = shingle_sets([text])[0]
                if not len(shingles) or _class_of(shingles)[0] != cls:
                    continue  # another row of the same key
                segments = bands.segments(band)
                content, size, place = _contents(shingles, segments)
                own = _key(content, np.arange(segments), band)
                less = _key(content[place] - _mix(shingles + _GOLD), place, band)
                differ = dict(bands.filings(len(shingles)))[band]
                rare = (size > 0) & ~np.isin(own.view(np.int64), np.asarray(common, np.int64))
                extra = differ + 1 - int(rare.sum())  # certainty still to be bought, one for each widened segment
                order = np.argsort(-size, kind="stable")
                widened = order[rare[order]][: max(0, extra)]
                chosen = np.isin(place, widened)
                for code, found in ((0, own ^ _STIR), (0, less), (1, own[widened]), (1, less[chosen] ^ _STIR)):
                    found = np.unique(found)
                    keys.append(found), classes.append(np.full(len(found), cls)), codes.append(np.full(len(found), code))
                    held += len(found)
                if extra > int(rare.sum()):
                    shared = (size > 0) & ~rare
                    if int((size == 0).sum()) >= segments - differ:
                        shared = ~rare
                    stuck.append((cls, own[shared]))
                if held > BUFFER_KEYS:
                    yield flush(keys, classes, codes, stuck)
                    keys, classes, codes, stuck, held = [], [], [], [], 0
        yield flush(keys, classes, codes, stuck)
        keys = classes = codes = stuck = None
        give_back()

    return run


def _meet_widened(frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket task of ``_widen``: kind 0, a probing class and one that it finds;
    kind 1, keys that too many are found under, and each class there; kind 2, the same
    for keys that were common to a writer; kind 3, those of the latter that are probed."""
    key, cls, code, marked = _gathered(frame)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(key))
    a, b, crowd, probed = [], [], [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        if not code[s:e].any():
            continue
        probes, found = cls[s:e][code[s:e] == 1], cls[s:e][code[s:e] == 0]
        if marked[s]:
            probed.append(key[s])
        if marked[s] or len(found) > KEY_PAIRS:
            crowd.append(np.arange(s, e))
        elif len(found):
            a.append(np.repeat(probes, len(found))), b.append(np.tile(found, len(probes)))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
    crowd = np.concatenate(crowd) if crowd else np.zeros(0, np.int64)
    far, stuck, probed = _unpacked(frame, 2, 4), _unpacked(frame, 4, 2), np.array(probed, np.int64)
    return pd.DataFrame(
        {
            "kind": np.repeat([0, 1, 2, 3], [both.shape[1], len(crowd) + stuck.shape[1], far.shape[1], len(probed)]),
            "a": np.concatenate((both[0], key[crowd], stuck[0], far[0], probed)),
            "b": np.concatenate((both[1], cls[crowd], stuck[1], far[1], probed)),
        }
    )


def _linked(percent: int, a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sets_of(docs: pd.DataFrame) -> dict[int, np.ndarray]:
    """The shingle set of each class; other rows that share a key with it are passed over."""
    return {c: s for c, s in zip(docs["cls"], shingle_sets(docs["_text"].tolist())) if len(s) and _class_of(s)[0] == c}


def _verify(percent: int):
    """The pairs of one task that are linked."""

    def run(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        sets = _sets_of(docs)
        hit = [(a, b) for a, b in zip(pairs["a"], pairs["b"]) if a in sets and b in sets and _linked(percent, sets[a], sets[b])]
        sets = None
        give_back()
        return pd.DataFrame(hit, columns=["a", "b"], dtype="int64")

    return run


_BLOCK_KEY = ["crowd", "step_a", "step_b", "block_a", "block_b"]


def _sides(frame: pd.DataFrame) -> tuple[np.ndarray, bool]:
    """Whether each row is of the first of the two blocks compared, and whether they are one."""
    same = bool((frame["step_a"].iloc[0] == frame["step_b"].iloc[0]) and (frame["block_a"].iloc[0] == frame["block_b"].iloc[0]))
    return ((frame["step"] == frame["step_a"]) & (frame["block"] == frame["block_a"])).to_numpy(), same


def _doubtful(percent: int):
    """Of two blocks of a crowd, the classes whose sketches allow a link to one of the
    other block that is not yet of their component."""
    bands = Bands(percent)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("cls")
        side, same = _sides(frame)
        words = min(len(s) for s in frame["sketch"]) // 8
        sketches = np.stack([_folded(np.frombuffer(s, np.uint64), words) for s in frame["sketch"]])
        size, part = frame["n"].to_numpy(), frame["part"].to_numpy()
        doubt = np.zeros(len(frame), bool)
        others = np.flatnonzero(side if same else ~side)
        for i in np.flatnonzero(side).tolist():
            near = others[(part[others] != part[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
            apart = np.bitwise_count(sketches[near] ^ sketches[i]).sum(axis=1, dtype=np.int64)
            near = near[apart <= (100 - bands.percent) * (size[near] + size[i]) // (100 + bands.percent)]
            if len(near):
                doubt[i] = True
                doubt[near] = True
        return frame.loc[doubt, [*_BLOCK_KEY, "cls", "part", "step", "block"]]

    return run


def _verify_block(percent: int):
    """Links between two blocks of documents, or within one, by counting common
    shingles in strips; only links that join components are returned."""

    def run(docs: pd.DataFrame) -> pd.DataFrame:
        held = _sets_of(docs)
        docs = docs[docs["cls"].isin(list(held))].drop_duplicates("cls")
        if not len(docs):
            return pd.DataFrame(columns=["a", "b"], dtype="int64")
        side, same = _sides(docs)
        classes, part = docs["cls"].tolist(), docs["part"].tolist()
        sets = [held[c] for c in classes]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        shingles, number = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for low in range(0, len(shingles), 4096):
            start, end = np.searchsorted(number, [low, low + 4096])
            strip = np.zeros((len(sets), 4096), np.float32)
            strip[owner[start:end], number[start:end] - low] = 1
            common += strip @ strip.T
        linked = 100 * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - common.astype(np.int64))
        if not same:
            linked &= side[:, None] != side[None, :]
        numbers = {p: k for k, p in enumerate(dict.fromkeys(part))}
        root, own = list(range(len(numbers))), [numbers[p] for p in part]
        edges = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1)))):
            p, q = own[i], own[j]
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            while root[q] != q:
                root[q] = root[root[q]]
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((classes[i], classes[j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


class _Join:
    """The texts, sketches and sizes that candidate pairs are decided on."""

    def __init__(self, texts: DataFrame, known: DataFrame, classes: DataFrame, percent: int):
        self.texts, self.known, self.classes, self.percent = texts, known, classes, percent
        self.spark = texts.sparkSession

    def _of(self, wanted: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        """``columns`` of one row of each class in ``wanted``."""
        at = materialize(wanted.select("cls").distinct().join(self.classes.select("cls", "row", "hash"), "cls"), "jaccard-wanted")
        if at.count() <= LOOKED_UP:
            at = F.broadcast(at)
        found = at.join(table, at["row"].eqNullSafe(table["_row"]) & (at["hash"] == table["_hash"]))
        return found.select("cls", *columns)

    def sketches(self, wanted: DataFrame) -> DataFrame:
        """``cls, n, sketch``; a repeated row may give a class more than once."""
        return self._of(wanted, self.known.drop("cls", "cls2"), "n_shingles", "sketch").withColumnRenamed("n_shingles", "n").dropDuplicates(["cls"])

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        return self._of(wanted, self.texts, "_text")

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs ``a, b`` that are linked: sketches first, whole sets where they leave a doubt."""
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        held = materialize(self.sketches(ends), f"jaccard-{label}-sketches")
        one = held.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        two = held.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        close = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInPandas(_may_link(self.percent), "a long, b long")
        close = materialize(close, f"jaccard-{label}-pairs")
        count = close.count()
        if not count:
            return close
        # Pairs go to the task of their first class; a class of many pairs is dealt to several.
        spread = math.ceil(count / TASK_DOCS) * 4
        dealt = close.withColumn("parts", F.lit(None).cast("int"))
        if count > TASK_DOCS:
            many = close.groupBy("a").count().where(F.col("count") > TASK_DOCS).select("a", F.ceil(F.col("count") / TASK_DOCS).cast("int").alias("parts"))
            dealt = materialize(close.join(many, "a", "left"), f"jaccard-{label}-dealt")
        dealt = dealt.select(
            "a", "b",
            F.when(F.col("parts").isNull(), F.expr(f"pmod(xxhash64(a), {spread})")).otherwise(F.col("a")).alias("task"),
            F.expr("case when parts is null then -1 else cast(pmod(xxhash64(b), parts) as int) end").alias("part"),
        )
        texts = materialize(self.texts_of(dealt.select(F.col("a").alias("cls")).unionByName(dealt.select(F.col("b").alias("cls")))), f"jaccard-{label}-texts")
        to = dealt.select("task", "part", F.col("a").alias("cls")).unionByName(dealt.select("task", "part", F.col("b").alias("cls"))).distinct()
        sent = to.join(texts, "cls").select("task", "part", "cls", "_text")
        asked = dealt.select(F.col("task").alias("_task"), F.col("part").alias("_part"), "a", "b")
        return materialize(sent.groupBy("task", "part").cogroup(asked.groupBy("_task", "_part")).applyInPandas(_verify(self.percent), "a long, b long"), f"jaccard-{label}-links")

    def crowd_links(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Links that join components among the classes ``cls`` that share a ``key`` or
        are connected by shared keys, compared block by block: sketches of all, sets of
        the classes that sketches leave in doubt."""
        members = materialize(members, "jaccard-members")
        if members.isEmpty():
            return local_table(self.spark, [], "a long, b long")
        least = members.groupBy("key").agg(F.min("cls").alias("_least"))
        edges = members.join(least, "key").where("cls <> _least").select(F.col("cls").alias("a"), F.col("_least").alias("b"))
        crowds = materialize(components(edges, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("crowd")), "jaccard-crowds")
        step = F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("int")
        rows = crowds.join(self.sketches(crowds), "cls").withColumn("step", step).join(found, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
        rows = materialize(rows.select("cls", "crowd", "n", "sketch", "step", "part"), "jaccard-crowd-rows")
        blocks = rows.groupBy("crowd", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(blocks, ["crowd", "step"]).withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
        other = F.explode(F.expr("sequence(0, others - 1)")).alias("other")
        own = ["cls", "crowd", "n", "sketch", "step", "part", "block"]

        def beside(by: int) -> DataFrame:
            return rows.join(blocks.select("crowd", (F.col("step") - by).alias("step"), F.col("blocks").alias("others")), ["crowd", "step"]).select(*own, other)

        s, b, o = F.col("step"), F.col("block"), F.col("other")
        compared = (
            beside(0).withColumns({"step_a": s, "step_b": s, "block_a": F.least(b, o), "block_b": F.greatest(b, o)})
            .unionByName(beside(1).withColumns({"step_a": s, "step_b": s + 1, "block_a": b, "block_b": o}))
            .unionByName(beside(-1).withColumns({"step_a": s - 1, "step_b": s, "block_a": o, "block_b": b}))
        ).drop("other")
        schema = "crowd long, step_a int, step_b int, block_a int, block_b int, cls long, part long, step int, block int"
        doubt = materialize(compared.groupBy(*_BLOCK_KEY).applyInPandas(lean(_doubtful(self.percent)), schema), "jaccard-doubt")
        texts = materialize(self.texts_of(doubt), "jaccard-crowd-texts")
        return doubt.join(texts, "cls").groupBy(*_BLOCK_KEY).applyInPandas(lean(_verify_block(self.percent)), "a long, b long")


def similar_classes(texts: DataFrame, known: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links ``a, b`` between classes of unequal sets that connect whatever is
    connected. ``texts`` has _row, _hash and _text, ``known`` what ``_digests`` makes of
    them; ``classes`` has cls, n and the row and hash of one of its texts."""
    total, largest = classes.agg(F.sum("n"), F.max("n")).first()
    join = _Join(texts, known, classes, percent)
    tasks = max(1, math.ceil((total or 0) * 0.45 / TASK_KEYS))
    filed = texts.select("_text").mapInArrow(_file(percent, tasks), "task long, kind int, data binary")
    met = materialize(filed.groupBy("task").applyInPandas(lean(_meet), "kind int, key long, cls long, code long, leader long"), "jaccard-met")

    # First links: of each class to those that stand for its keys. They make most of every group one component.
    entries = met.where("kind = 0").select("key", "cls", "code", "leader")
    stars = entries.where("cls <> leader").select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    first = join.links(stars, "star")
    found = materialize(components(first, "a", "b").select(F.col("node").alias("cls"), F.col("component").alias("part")), "jaccard-found")

    # Keys of one component are done with. Those of few classes give all pairs of different components.
    placed = entries.select("key", "cls", "code").distinct().join(found, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    placed = materialize(placed, "jaccard-placed")
    keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    held = placed.join(keys.select("key", "members"), "key")
    few = held.where(F.col("members") <= KEY_PAIRS).withColumn("task", F.expr(f"pmod(xxhash64(key), {tasks})"))
    pairs = few.groupBy("task").applyInPandas(lean(_close(percent)), "a long, b long").distinct()

    # Classes whose common and empty segments may leave them without a rare one in common with a partner.
    band = Bands(percent).filed_in

    @F.pandas_udf("int")
    def band_of(codes: pd.Series) -> pd.Series:
        return pd.Series(band(codes.to_numpy()), dtype="int32")

    common = held.where(F.col("members") > KEY_PAIRS).select("cls", band_of("code").alias("band"), "key", F.lit(1).cast("long").alias("count"))
    empty = met.where("kind = 3").select("cls", F.col("key").cast("int").alias("band"), F.lit(None).cast("long").alias("key"), F.col("code").alias("count")).distinct()
    useless = common.unionByName(empty).groupBy("cls", "band").agg(F.sum("count").alias("count"), F.collect_list("key").alias("common"))
    needs = local_table(classes.sparkSession, _needs(largest or 1, percent), "band int, low int, high int, segments int, cap int, factor int")
    unsure = useless.join(classes.select("cls", F.col("n").cast("int").alias("n")), "cls").join(F.broadcast(needs), "band")
    differ = F.expr(f"cast(floor({100 - percent} * (n + least(floor(factor * n / 100), cap)) / {100 + percent}) as int)")
    unsure = unsure.where((F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")) & (F.col("segments") - F.col("count") <= differ))
    unsure = materialize(unsure.select("cls", "band", "common"), "jaccard-unsure")
    if unsure.isEmpty():  # rare keys are enough for all
        return first.unionByName(join.links(materialize(pairs, "jaccard-close"), "close"))
    widened = unsure.join(join.texts_of(unsure), "cls").select("cls", "band", "common", "_text").mapInPandas(_widen(percent, tasks), "task long, kind int, data binary")
    widened = materialize(widened.groupBy("task").applyInPandas(lean(_meet_widened), "kind int, a long, b long"), "jaccard-widened")

    part_a, part_b = (found.select(F.col("cls").alias(c), F.col("part").alias(f"part_{c}")) for c in "ab")
    more = widened.where("kind = 0").select("a", "b").join(part_a, "a", "left").join(part_b, "b", "left").where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")
    second = join.links(materialize(pairs.unionByName(more).distinct(), "jaccard-close"), "close")
    there = widened.select("kind", F.col("a").alias("key"), F.col("b").alias("cls"))
    probed = there.where("kind = 2").join(there.where("kind = 3").select("key"), "key", "left_semi")
    crowd = join.crowd_links(there.where("kind = 1").unionByName(probed).select("key", "cls").distinct(), found)
    return first.unionByName(second).unionByName(crowd)


def _needs(largest: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """For each band: the sizes that file in it, its segments, and the largest partner
    there as a cap and a percentage of the size."""
    bands, out = Bands(percent), []
    for band in range(bands.of(largest) + 1):
        low, high = bands.edge(band), bands.edge(band + 1)
        out.append((band, low, high, bands.segments(band), high - 1, 10_000 // percent + 1))
        out.append((band, high, 2**31 - 1, bands.segments(band), high - 1, 100))
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their shingle sets.

    Returns ``key, n_shingles, component_id`` for each row: the size of its set and
    the smallest key reachable by links of at least ``percent`` / 100, itself
    included.

    Null and empty texts, and texts without words, have no shingles and link with
    nothing. Texts of any length are read whole; a long one files more segments, and
    is compared like any other. A null key is not smaller than any other; a component
    of null keys alone has a null id. Rows with equal keys are documents of their
    own. Other columns are ignored, whatever their names; an empty table gives no rows.
    While it runs, the session hands smaller batches to Python (``small_batches``).
    """
    rows = docs.select(F.col(key).alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        known = rows.withColumn("_row", F.col("_row").cast("string")).mapInArrow(_digests, "_row string, _hash long, n_shingles long, cls long, cls2 long, sketch binary")
        known = materialize(known.withColumn("_row", F.col("_row").cast(kind)), "jaccard-sets")
        classes = known.where("cls is not null").groupBy("cls", "cls2").agg(F.max("n_shingles").alias("n"), F.min(F.struct(F.col("_row").isNull().alias("no"), "_row", "_hash")).alias("r"))
        classes = materialize(classes.select("cls", "cls2", "n", F.col("r._row").alias("row"), F.col("r._hash").alias("hash")), "jaccard-classes")
        links = materialize(similar_classes(rows, known, classes, percent), "jaccard-links")
    found = components(links, "a", "b")
    named = classes.join(found, classes["cls"] == found["node"], "left").select("cls", "cls2", "row", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("row").alias("_least"))
    named = named.join(least, "component").select("cls", "cls2", "_least")
    done = known.select("_row", "n_shingles", "cls", "cls2").join(named, ["cls", "cls2"], "left")
    return done.select(F.col("_row").alias(key), "n_shingles", F.coalesce("_least", "_row").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest key. Rows that
    repeat a key stay as they are; rows with a null key stay."""
    found = near_duplicates(docs, key, text, percent)
    gone = found.where(F.col(key).isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")
