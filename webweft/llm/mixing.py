"""Pfair mixing of sources to target weights. Native DataFrame operations only.

Each source's documents, in hash order, are cut into blocks of ``block_chars``
characters; a document that crosses the edge of a block is cut there. Block j of a
source with weight n out of Q is released at slot floor(j*Q/n) and due by slot
ceil((j+1)*Q/n). Earliest-deadline-first over these windows serves one block a slot,
and the stream of pieces then stays within one block of each source's exact share at
every slot. The windows repeat every Q slots, so the calendar of one period, whose
size depends on the weights alone, serves any corpus.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webweft.llm.sharding import md5_60
from webweft.runtime import materialize

#: Integer target weights (parts) of the registered query; other sources get DEFAULT_WEIGHT.
TARGET_WEIGHTS = {"src0": 12, "src1": 8, "src2": 7, "src3": 6, "src4": 6, "src5": 5, "src6": 5}
DEFAULT_WEIGHT = 3
BLOCK_CHARS = 8192
#: Calendars of up to this many slots are broadcast, longer ones written and joined by source.
BROADCAST_SLOTS = 1_000_000
#: Rows of one hash range over all sources, the unit in which running sums are split, and
#: the bits by which ranges are gathered into ranges of ranges.
RANGE_ROWS = 1024
RANGE_BITS = 10

PLACES = ("mix_piece", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_start", "mix_offset", "mix_chars")


def edf_calendar(weights: list[int]) -> list[list[int]]:
    """For each source, the slots of one period at which its blocks are served."""
    period, slots = sum(weights), [[] for _ in weights]
    waiting = [(0, i) for i in range(len(weights))]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * period // weights[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(slot)
        if len(slots[i]) < weights[i]:
            heapq.heappush(waiting, (len(slots[i]) * period // weights[i], i))
    return slots


def _tagged(name):
    """A join key that tells a null source from every named one."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit("null"))


def _calendar(docs: DataFrame, source: str, weights: dict, default_weight: int) -> DataFrame:
    """Of each source its weight, the period and its slots. The names of the sources,
    and no documents, come to the driver, which runs the schedule of one period."""
    spark = docs.sparkSession
    names = sorted((r[0] for r in docs.select(F.col(source).cast("string")).distinct().collect()), key=lambda x: (x is not None, x or ""))
    parts = [weights.get(x, default_weight) for x in names]
    if any(p != int(p) or p < 1 for p in parts):
        raise ValueError("weights are positive whole parts")
    parts = [int(p) // math.gcd(*map(int, parts)) for p in parts]
    rows = [{"s": n, "w": w, "q": sum(parts), "slots": s} for n, w, s in zip(names, parts, edf_calendar(parts))]
    kind = "s string, w bigint, q bigint, slots array<bigint>"
    if sum(parts) > BROADCAST_SLOTS:
        wide = materialize(spark.createDataFrame([tuple(r.values()) for r in rows], kind), "mix-calendar")
        return wide.select(_tagged(F.col("s")).alias("_s"), F.col("w").alias("_w"), F.col("q").alias("_q"), F.col("slots").alias("_slots"))
    found = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")).alias("_c"))
    return F.broadcast(found.select(_tagged(F.col("_c.s")).alias("_s"), F.col("_c.w").alias("_w"), F.col("_c.q").alias("_q"), F.col("_c.slots").alias("_slots")))


def _started(docs: DataFrame, weights: dict[str, int] | None, default_weight: int, block_chars: int, source: str, key: str, text: str) -> DataFrame:
    """``docs`` with the characters of its source before each document (mix_start), its own (_n),
    and its source's weight, period and slots."""
    weights = TARGET_WEIGHTS if weights is None else weights
    calendar = _calendar(docs, source, weights, default_weight)
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / RANGE_ROWS)))
    content = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = (
        docs.withColumn("_src", _tagged(F.col(source).cast("string")))
        .withColumn("_n", F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).cast("long"))
        .withColumn("_h", md5_60(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), content)))
        .withColumn("_range", F.expr(f"_h >> {60 - bits}"))
    )
    # Running sums in three steps, so that no task holds a whole source.
    within = Window.partitionBy("_src", "_range").orderBy("_h", F.col(key), content).rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialize(rows.groupBy("_src", "_range").agg(F.sum("_n").alias("_sum")), "mix-ranges").withColumn("_wide", F.expr(f"_range >> {RANGE_BITS}"))
    inside = Window.partitionBy("_src", "_wide").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("_src").orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    wide = ranges.groupBy("_src", "_wide").agg(F.sum("_sum").alias("_sum")).select("_src", "_wide", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"))
    ranges = ranges.withColumn("_inside", F.coalesce(F.sum("_sum").over(inside), F.lit(0))).join(wide, ["_src", "_wide"])
    ranges = ranges.select(F.col("_src").alias("_src2"), F.col("_range").alias("_range2"), (F.col("_inside") + F.col("_above")).alias("_before"))
    return (
        rows.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(ranges, F.col("_src").eqNullSafe(F.col("_src2")) & F.col("_range").eqNullSafe(F.col("_range2")))  # never null, and so not tested for it
        .join(calendar, F.col("_src") == F.col("_s"))
        .withColumn("mix_start", F.col("_before") + F.col("_in"))
        .withColumn("_first", F.expr(f"mix_start div {int(block_chars)}"))
    )


def _slot(block: str) -> Column:
    return F.expr(f"({block} div _w) * _q + element_at(_slots, cast({block} % _w as int) + 1)")


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
    block_chars: int = BLOCK_CHARS,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """The mixed stream: one row for each piece of each of ``docs``, its own columns
    with the piece's part of the text, and the columns ``PLACES``.

    Reading by (mix_slot, mix_offset) gives the mix, in which at every slot each
    source is within one block of its share until a source runs out. ``mix_piece``
    numbers a document's pieces from 0, ``mix_block`` is the block of the source that
    the piece lies in, at ``mix_offset`` characters, ``mix_chars`` its length;
    ``mix_start`` counts the characters of the source before the document. Every
    character stays: a source that runs out leaves its slots unused, and the others
    go on in their proportions. A document of any length is cut in one pass. Without
    ``with_text`` the texts are left out, and only their lengths and hashes are shuffled.

    A null source is a source of its own, with the default weight; null text is
    empty, and empty documents are one piece, where their predecessor ended; a null
    key hashes as the empty string. Rows alike in source, key and text are
    interchangeable, and so are ties of hashes between them. Columns named like the
    results are replaced; an empty table gives no rows.
    """
    b, own = int(block_chars), [c for c in docs.columns if c not in PLACES]
    rows = _started(docs.select(*own), weights, default_weight, b, source, key, text)
    kept = [c for c in rows.columns if c != text]
    if with_text:
        rows = rows.withColumn("_text", F.col(text).cast("string")).withColumn("_head", F.expr(f"cast(least(_n, (_first + 1) * {b} - mix_start) as int)"))
        rest = F.expr(f"regexp_extract_all(substring(_text, _head + 1), '(?s).{{1,{b}}}', 0)")
        parts = F.concat(F.array(F.expr("substring(_text, 1, _head)")), F.coalesce(rest, F.array().cast("array<string>")))
        cut = rows.withColumn("_parts", parts).select(*kept, F.posexplode_outer("_parts").alias("mix_piece", "_part"))
    else:
        own = [c for c in own if c != text]
        cut = rows.select(*kept, F.explode(F.expr(f"sequence(0, cast(greatest(mix_start, mix_start + _n - 1) div {b} - _first as int))")).alias("mix_piece"))
    cut = cut.withColumn("mix_block", F.expr("_first + mix_piece"))
    at = F.greatest(F.col("mix_start"), F.expr(f"mix_block * {b}"))
    return cut.select(
        *(F.col("_part").alias(text) if c == text else c for c in own),
        "mix_piece",
        "mix_block",
        _slot("mix_block").alias("mix_slot"),
        F.expr("(mix_block * _q) div _w").alias("mix_release"),
        F.expr("((mix_block + 1) * _q + _w - 1) div _w").alias("mix_deadline"),
        "mix_start",
        (at - F.expr(f"mix_block * {b}")).alias("mix_offset"),
        (F.least(F.expr("mix_start + _n"), F.expr(f"(mix_block + 1) * {b}")) - at).alias("mix_chars"),
    )


def mixed_order(docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT, block_chars: int = BLOCK_CHARS, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, whole and with its own columns, as partitions that read in the order
    of the slots in which the documents begin. Ties, nulls and empty tables as in ``mix``;
    whole documents deviate from the shares by a block and the longest document at most."""
    placed = _started(docs, weights, default_weight, block_chars, source, key, text).withColumn("_slot", _slot("_first"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, "_slot", "mix_start").sortWithinPartitions("_slot", "mix_start").select(*docs.columns)
