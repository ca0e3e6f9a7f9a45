"""Range search over 64-bit hashes: a scan for few queries, an exact join on bands or scans in blocks for many."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.vectors import hamming

#: Queries that may be broadcast to a scan.
SCAN_QUERIES = 10_000
#: Queries in a block, and distances that a worker holds at once, where there are more.
QUERY_BLOCK, PRODUCTS = 65_536, 1 << 20
#: Bits of a band, and the largest distance for which bands prune well (four bands, 137 probes in each).
WIDTH, BANDED = 16, 11


def within(queries: DataFrame, hashes: DataFrame, most: int) -> DataFrame:
    """query_id, region_id, distance of hashes (region_id, phash) at most `most` bits from queries (query_id, phash).

    Few queries go to one scan; more go, up to BANDED bits, through an exact join on bands, and beyond that, where
    bands tell too little, to scans in blocks of queries.
    """
    if queries.limit(SCAN_QUERIES + 1).count() <= SCAN_QUERIES:
        return _scan(queries, hashes, most)
    return banded(queries, hashes, most) if most <= BANDED else blocked(queries, hashes, most)


def scan(queries: DataFrame, hashes: DataFrame, most: int) -> DataFrame:
    """By one scan for up to SCAN_QUERIES queries, by one for each block of more."""
    few = queries.limit(SCAN_QUERIES + 1).count() <= SCAN_QUERIES
    return _scan(queries, hashes, most) if few else blocked(queries, hashes, most)


def _scan(queries: DataFrame, hashes: DataFrame, most: int) -> DataFrame:
    asked = queries.where("phash is not null").select("query_id", F.col("phash").alias("_q"))
    distance = hamming(F.col("phash"), F.col("_q")).cast("int")
    return hashes.where("phash is not null").join(F.broadcast(asked), distance <= most).select("query_id", "region_id", distance.alias("distance"))


def blocked(queries: DataFrame, hashes: DataFrame, most: int) -> DataFrame:
    """Any number of queries: one scan for each block of them, by vectorised counts of bits."""
    live, parts, block = hashes.where("phash is not null").select(F.col("region_id").cast("long").alias("region_id"), "phash"), [], []

    def add() -> None:
        ids, own = (np.array(x, np.int64) for x in zip(*block, strict=True))
        parts.append(live.mapInArrow(_block_scan(ids, own, most), "query_id long, region_id long, distance int"))

    for row in queries.where("phash is not null").select(F.col("query_id").cast("long"), "phash").toLocalIterator():
        block.append(tuple(row))
        if len(block) == QUERY_BLOCK:
            add()
            block = []
    if block:
        add()
    found = parts[0] if parts else hashes.sparkSession.createDataFrame([], "query_id long, region_id long, distance int")
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _block_scan(ids: np.ndarray, asked: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, phash = batch.column("region_id").to_numpy(), batch.column("phash").to_numpy().view(np.uint64)
            step = max(1, PRODUCTS // len(own))
            for i in range(0, len(ids), step):
                bits = np.bitwise_count(asked[i : i + step].view(np.uint64)[:, None] ^ phash)
                q, r = np.nonzero(bits <= most)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + q]), pa.array(own[r]), pa.array(bits[q, r].astype(np.int32))], ["query_id", "region_id", "distance"])

    return run


def probe_masks(radius: int) -> list[int]:
    """All numbers of WIDTH bits with at most `radius` ones."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in itertools.combinations(range(WIDTH), r)]


def _bands(phash: Column) -> list[Column]:
    return [F.shiftrightunsigned(phash, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")) for i in range(64 // WIDTH)]


def banded(queries: DataFrame, hashes: DataFrame, most: int) -> DataFrame:
    """Exact for any `most`, meant for up to BANDED: of four bands of 16 bits one differs in at most most / 4 bits, and a
    query looks up all values that near. A pair is told by the first such band only, so no distinct is needed."""
    radius = most // (64 // WIDTH)
    near = lambda a, b: hamming(a, b) <= radius
    masks = F.lit(probe_masks(min(radius, WIDTH))).cast("array<long>")
    probes = lambda value: F.transform(masks, lambda m: value.bitwiseXOR(m))
    asked = queries.where("phash is not null").select("query_id", F.col("phash").alias("_q"), F.posexplode(F.array(*_bands(F.col("phash")))).alias("band", "_v"))
    asked = asked.select("query_id", "_q", "band", F.explode(probes(F.col("_v"))).alias("value"))
    rows = hashes.where("phash is not null").select("region_id", "phash", F.posexplode(F.array(*_bands(F.col("phash")))).alias("band", "value"))
    distance = hamming(F.col("phash"), F.col("_q")).cast("int")
    first = F.coalesce(*(F.when(near(a, b), F.lit(i)) for i, (a, b) in enumerate(zip(_bands(F.col("phash")), _bands(F.col("_q")), strict=True))))
    return rows.join(asked, ["band", "value"]).where((distance <= most) & (first == F.col("band"))).select("query_id", "region_id", distance.alias("distance"))


# The table of hashes: region_id, phash


def replaced(rows: DataFrame) -> DataFrame:
    """A new table of hashes; rows without one are left out."""
    return rows.where("phash is not null").select("region_id", "phash")


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(replaced(rows))


def removed(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("region_id").distinct(), "region_id", "left_anti").select("region_id", "phash")


def unsigned(phash: Column) -> Column:
    """The hash as the unsigned number whose bits it has: decimal(20,0)."""
    return (phash.cast("decimal(20,0)") + F.when(phash < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0))).cast("decimal(20,0)")


def closest(found: DataFrame, cap: int) -> DataFrame:
    """Each query's `cap` closest, ties by region_id."""
    order = W.partitionBy("query_id").orderBy("distance", "region_id")
    return found.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= cap).drop("_i")
