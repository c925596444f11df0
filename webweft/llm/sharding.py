"""Extendible-hashing shards under a byte limit. Native DataFrame operations only.

A row's address is 120 bits: 60 bits of the md5 of its key, then 60 bits of the md5 of
its text and its number among rows alike, which tell rows with equal keys apart. The directory starts as one bucket; a bucket
over the limit splits on its next address bit, and only that bucket does. The
splits are read off a histogram of address prefixes, fifteen bits at a time, so
a level costs one small aggregation however many buckets split in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweft.runtime import materialize

#: Address bits resolved by one directory level, and levels in the address.
LEVEL_BITS = 15
LEVELS = 8
KEY_BITS = 60
#: Rows alike that are numbered at a time.
RUN = 4096
#: Byte limit of a shard in the registered query.
MAX_SHARD_BYTES = 1 << 20


def md5_60(col):
    """The first 60 bits of the md5 of a column's text."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _digit(level: int):
    word, place = ("_h1", level) if level < LEVELS // 2 else ("_h2", level - LEVELS // 2)
    return F.shiftright(F.col(word), KEY_BITS - LEVEL_BITS * (place + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def _bits(value, width):
    return F.lpad(F.conv(value.cast("string"), 10, 2), width, "0")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_SHARD_BYTES) -> DataFrame:
    """Give each row of ``docs`` a shard of at most ``max_bytes`` UTF-8 text bytes.

    Returns ``key, n_bytes, shard_id, depth, shard_bytes, oversized``: one row per
    input row. ``shard_id`` is the bucket's address prefix as a string of bits
    (empty while one bucket holds everything) and ``depth`` its length.

    Null or empty text weighs nothing. A null key hashes as the empty string.
    Rows with equal keys share a bucket until that bucket is over the limit; they
    then split on bits of the hash of their text, and rows alike in key and text on
    bits of a hash of their number among these, so that no shard depends on the
    layout of the input. Texts of any length are only measured and hashed. A row that alone exceeds the
    limit is a shard of its own, with ``oversized`` true. Other columns of
    ``docs`` are ignored, whatever their names; an empty table gives no rows.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    content = F.col(text).cast("string")
    alike = docs.select(F.col(key).alias("_key"), F.md5(F.coalesce(content, F.lit(""))).alias("_md5"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("_n"))
    # Rows alike differ in nothing that is returned: they are counted, and numbered when they are told apart again.
    runs = alike.groupBy("_key", "_md5", "_n").agg(F.count(F.lit(1)).alias("_count")).select("*", F.explode(F.expr(f"sequence(0L, (_count - 1) div {RUN})")).alias("_run"))
    numbered = runs.select("_key", "_md5", "_n", F.explode(F.expr(f"sequence(_run * {RUN}, least(_count, (_run + 1) * {RUN}) - 1)")).alias("_number"))
    rows = materialize(
        numbered.select("_key", "_n", md5_60(F.col("_key")).alias("_h1"), md5_60(F.concat_ws(":", "_md5", F.col("_number").cast("string"))).alias("_h2")), "shard-rows"
    )
    fits = (F.col("_bytes") <= max_bytes) | (F.col("_rows") == 1)
    open_rows, assigned = rows.withColumn("_prefix", F.lit("")), []
    for level in range(LEVELS):
        placed = open_rows.withColumn("_cell", _digit(level))
        cells = materialize(
            placed.groupBy("_prefix", "_cell").agg(F.sum("_n").alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "shard-cells"
        )
        # Every prefix length of this level, so that the smallest one that fits can be found at once.
        sizes = (
            cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVEL_BITS))).alias("_depth"))
            .withColumn("_value", F.expr(f"_cell >> ({LEVEL_BITS} - _depth)"))
            .groupBy("_prefix", "_depth", "_value")
            .agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
        )
        settled = sizes.where(fits | F.lit(level == LEVELS - 1) & (F.col("_depth") == LEVEL_BITS))
        directory = (
            cells.select("_prefix", "_cell", F.explode(F.sequence(F.lit(0), F.lit(LEVEL_BITS))).alias("_depth"))
            .withColumn("_value", F.expr(f"_cell >> ({LEVEL_BITS} - _depth)"))
            .join(settled, ["_prefix", "_depth", "_value"])
            .groupBy("_prefix", "_cell")
            .agg(F.min(F.struct("_depth", "_value", "_bytes")).alias("_leaf"))
        )
        directory = materialize(directory, "shard-directory")
        if level == 0:  # at most 2**15 rows by construction
            directory = F.broadcast(directory)
        assigned.append(
            placed.join(directory, ["_prefix", "_cell"]).select(
                F.col("_key").alias(key),
                F.col("_n").alias("n_bytes"),
                F.concat("_prefix", F.when(F.col("_leaf._depth") == 0, F.lit("")).otherwise(_bits(F.col("_leaf._value"), F.col("_leaf._depth")))).alias("shard_id"),
                (F.col("_leaf._depth") + F.lit(LEVEL_BITS * level)).cast("int").alias("depth"),
                F.col("_leaf._bytes").alias("shard_bytes"),
                (F.col("_leaf._bytes") > max_bytes).alias("oversized"),
            )
        )
        deeper = cells.where(~fits).select("_prefix", "_cell")
        if level == LEVELS - 1 or deeper.isEmpty():
            break
        open_rows = (
            placed.join(deeper, ["_prefix", "_cell"], "left_semi")
            .withColumn("_prefix", F.concat("_prefix", _bits(F.col("_cell"), F.lit(LEVEL_BITS))))
            .drop("_cell")
        )
    return reduce(DataFrame.unionByName, assigned)
