"""Nearest vectors by an exact scan in query blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.vectors import dot, is_finite

#: Queries that are sent to the workers at once (with 384 dimensions about 12 MB).
QUERY_BLOCK = 4_096
PAIRS = "query_id long, region_id long, product double"


def _vectors(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Products that a worker holds at once.
PRODUCTS = 1 << 20


class Best:
    """The k highest products of each query so far, ties by region_id. Only what reaches a query's k-th one is kept."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

    def add(self, rows: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        """products: of the queries `rows` (numbers) with regions `ids`."""
        low = self.floor[rows]
        if len(ids) > self.k:
            low = np.maximum(low, np.partition(products, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero(products >= low[:, None])
        q, p, i = (np.concatenate(x) for x in zip(self.held, (rows[r], products[r, c], ids[c]), strict=True))
        order = np.lexsort((i, -p, q))
        q, p, i = q[order], p[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = p[last]
        self.held = [x[rank < self.k] for x in (q, p, i)]


def _scan(ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vectors = batch.column("region_id").to_numpy(zero_copy_only=False), _vectors(batch.column("vector"))
            step = max(1, PRODUCTS // len(own))
            for i in range(0, len(ids), step):
                best.add(np.arange(i, min(i + step, len(ids))), own, queries[i : i + step] @ vectors.T)
        q, p, i = best.held
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(p)], ["query_id", "region_id", "product"])

    return run


def _scan_all(ids: np.ndarray, queries: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vectors = batch.column("region_id").to_numpy(zero_copy_only=False), _vectors(batch.column("vector"))
            step = max(1, PRODUCTS // len(own))
            for i in range(0, len(ids), step):
                products = queries[i : i + step] @ vectors.T
                q, r = np.nonzero(products >= least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + q]), pa.array(own[r]), pa.array(products[q, r])], ["query_id", "region_id", "product"])

    return run


def _live(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vector").isNotNull() & is_finite(F.col("vector"))).select(F.col("region_id").cast("long").alias("region_id"), "vector")


def _scanned(queries: DataFrame, live: DataFrame, scan) -> DataFrame | None:
    """The scans of all blocks of queries; None without queries. scan: from ids and vectors of a block to its scan."""
    parts, block = [], []

    def add() -> None:
        ids, own = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
        parts.append(live.mapInArrow(scan(ids, own), PAIRS))

    for row in queries.select(F.col("query_id").cast("long"), "vector").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            add()
            block = []
    if block:
        add()
    found = parts[0] if parts else None
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def at_least(queries: DataFrame, vectors: DataFrame, least: float = float("-inf")) -> DataFrame:
    """query_id, region_id, product: all pairs with a dot product of at least `least`, however many they are."""
    found = _scanned(queries, _live(vectors), lambda ids, own: _scan_all(ids, own, least))
    return vectors.sparkSession.createDataFrame([], PAIRS) if found is None else found


def knn(queries: DataFrame, vectors: DataFrame, k: int, removed: DataFrame | None = None) -> DataFrame:
    """query_id, region_id, product, rank: the k highest dot products of each row of queries (query_id, vector)
    among vectors (region_id, vector), ties by region_id. removed: tombstones (region_id).

    Each partition keeps its k best by a matrix product; queries go in blocks of bounded size, one scan a block.
    """
    live = _live(vectors)
    if removed is not None:
        live = live.join(removed.select("region_id").distinct(), "region_id", "left_anti")
    found = _scanned(queries, live, lambda ids, own: _scan(ids, own, k))
    if found is None:
        return live.sparkSession.createDataFrame([], f"{PAIRS}, rank int")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("product"), "region_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Queries of knn_plain, which are broadcast.
PLAIN_QUERIES = 1_000


def knn_plain(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same by a nested-loop join of a small set of queries: what knn is tested against."""
    if queries.limit(PLAIN_QUERIES + 1).count() > PLAIN_QUERIES:
        raise ValueError("for more queries there is knn")
    pairs = vectors.select("region_id", "vector").crossJoin(F.broadcast(queries.select("query_id", F.col("vector").alias("_q"))))
    return ranked(pairs.select("query_id", "region_id", dot(F.col("vector"), F.col("_q")).alias("product")), k)


def merge_matches(matches: DataFrame) -> DataFrame:
    """query_id, region_id, distance: the least distance over a query's several vectors."""
    return matches.groupBy("query_id", "region_id").agg(F.min("distance").alias("distance"))


def fetch_sizes(k: Column, tombstones: Column, factor: int = 25, least: int = 500, most: int = 2800, breadth: int = 256) -> Column:
    """struct(search_k, fetch_k, ef): the candidates asked for, those fetched where some may be tombstones, and the
    breadth of a graph search for them."""
    search = F.greatest(k * factor, F.lit(least))
    fetch = F.least(search + F.least(tombstones, search * 2), F.lit(most))
    return F.struct(search.alias("search_k"), fetch.alias("fetch_k"), F.greatest(fetch, F.lit(breadth)).alias("ef"))


def live_points(points: Column, tombstones: Column) -> Column:
    return F.greatest(points - tombstones, F.lit(0))
