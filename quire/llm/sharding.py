"""Sharding by jump consistent hashing, with built-in functions only.

The key alone and the number of shards decide: no ring table, and one more shard takes rows
only into itself. The 64-bit state of the public algorithm's generator is kept as three limbs
of 22, 22 and 20 bits, so no product overflows a long under ANSI arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.runtime import staged

_M = 2862933555777941757
_BITS = 22
_MASK = (1 << _BITS) - 1
_M0, _M1, _M2 = _M & _MASK, _M >> _BITS & _MASK, _M >> 2 * _BITS


def jump_pair(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard) of a long key, for `shards` and for one more shard. A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        key.bitwiseAND(F.lit(_MASK).cast("long")).alias("k0"),
        F.shiftrightunsigned(key, _BITS).bitwiseAND(F.lit(_MASK).cast("long")).alias("k1"),
        F.shiftrightunsigned(key, 2 * _BITS).alias("k2"),
        *(F.lit(0).cast("long").alias(x) for x in ("j", "shard", "grown_shard")),
    )
    lit = lambda x: F.lit(x).cast("long")

    def step(acc: Column, _: Column) -> Column:
        k0, k1, k2, j = acc["k0"], acc["k1"], acc["k2"], acc["j"]
        r0 = k0 * lit(_M0) + lit(1)
        r1 = k0 * lit(_M1) + k1 * lit(_M0) + F.shiftright(r0, _BITS)
        r2 = k0 * lit(_M2) + k1 * lit(_M1) + k2 * lit(_M0) + F.shiftright(r1, _BITS)
        n1, n2 = r1.bitwiseAND(lit(_MASK)), r2.bitwiseAND(lit((1 << 20) - 1))
        high = F.shiftleft(n2, 11) + F.shiftright(n1, 11)
        jump = F.floor((j + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double")))
        moved = F.struct(
            r0.bitwiseAND(lit(_MASK)).alias("k0"), n1.alias("k1"), n2.alias("k2"), jump.cast("long").alias("j"),
            F.when(j < shards, j).otherwise(acc["shard"]).alias("shard"), j.alias("grown_shard"),
        )
        return F.when(j < shards + 1, moved).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)), start, step,
        lambda acc: F.struct(acc["shard"].cast("int").alias("shard"), acc["grown_shard"].cast("int").alias("grown_shard")),
    )


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_block: int = 5_000) -> DataFrame:
    """One row per input row: the key, size, text_crc32, law 'key', shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16 (null text: 16). slot: gapless from 0 within the shard. Each
    shard is numbered in blocks of about rows_per_block rows and block offsets are prefix sums of
    counts, so no task holds a whole shard. The block is a hash of the row with its place in a written
    table, so that even one row repeated (a null key, say) is spread over its shard's blocks. Repeated
    keys and rows go to the same shard, in slots of their own. A null key counts as 0. Empty input: no
    rows. Other columns, whatever their names, are not read.
    """
    text_col, key_col = F.coalesce(F.col(text), F.lit("")), F.col(key)
    rows = staged(docs.select(
        key_col.alias("doc_id"), (F.octet_length(text_col) + 16).cast("long").alias("size"), F.crc32(text_col.cast("binary")).cast("long").alias("text_crc32"),
        jump_pair(key_col, shards).alias("j"), F.xxhash64(key_col, F.monotonically_increasing_id()).alias("place"),
    ), "sharded")
    per_shard = max(1, math.ceil(rows.count() / (shards * rows_per_block)))
    rows = rows.select("doc_id", "size", "text_crc32", "j.shard", "j.grown_shard", F.pmod("place", F.lit(per_shard)).cast("int").alias("block"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select(
        "shard", "block",
        F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("i") - 1).cast("long").alias("slot"), "grown_shard",
    )


def op9_jump_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 40)
