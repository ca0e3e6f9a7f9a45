"""A stored index for approximate nearest vectors: cells round centroids, additions, tombstones, snapshots.

Vectors are dealt into cells by their nearest centroid and written in the order of cells, so that a
search reads only the row groups of the cells nearest to its queries, and there by matrix products.
Every change is a commit of new files and a pointer: readers see all of it or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vectors import is_finite

from . import ann
from .store import Snapshots, rebuild_needed

TOMBSTONES = "region_id long"


def nearest_cells(vectors: np.ndarray, centroids: np.ndarray, probes: int, chunk: int = 4096) -> np.ndarray:
    """The numbers of the `probes` nearest centroids of each vector, the nearest first."""
    out = [np.argsort(-(vectors[i : i + chunk] @ centroids.T), axis=1, kind="stable")[:, :probes] for i in range(0, len(vectors), chunk)]
    return np.concatenate(out) if out else np.zeros((0, probes), np.int64)


def fit_centroids(data: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = data[rng.permutation(len(data))[: min(cells, len(data))]].copy()
    for _ in range(rounds):
        own = nearest_cells(data, centroids, 1)[:, 0]
        for c in range(len(centroids)):
            if (own == c).any():
                mean = data[own == c].mean(0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


class VectorIndex:
    """Of vectors (region_id, vector). Centroids are fitted to a bounded sample (the first by a hash of region_id); every
    finite vector is indexed. `probes`, the cells that a search reads for a query, are the fewest that reach the
    recall asked for on `trial` vectors of the index, measured against an exact scan."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.shelf = spark, Snapshots(spark, base)
        self.centroids, self.probes = np.zeros((0, 0)), 0

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> VectorIndex:
        """The index stored at base. One that can't be read is deleted and begun anew; without tombstones there are none."""
        made = cls(spark, base)
        try:
            if "vectors" in made.shelf.current():
                rows = made.shelf.read("centroids").orderBy("cell").collect()
                made.centroids, made.probes = np.array([r["vector"] for r in rows]), rows[0]["probes"]
                made.shelf.read("vectors").select("cell", "region_id", "vector").limit(1).collect()
        except Exception:  # noqa: BLE001 - whatever is wrong with the files, the store can make them again
            made.shelf.clear()
            made.centroids, made.probes = np.zeros((0, 0)), 0
        return made

    @classmethod
    def build(cls, spark: SparkSession, base: str, vectors: DataFrame, cells: int | None = None, recall: float = 0.97, sample: int = 20_000, trial: int = 200, rounds: int = 12, seed: int = 1) -> VectorIndex:
        made = cls(spark, base)
        made.fill(vectors, cells, recall, sample, trial, rounds, seed)
        return made

    def fill(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.97, sample: int = 20_000, trial: int = 200, rounds: int = 12, seed: int = 1) -> None:
        """Index these vectors in place of what there was. Cells: about the root of their number, at most a 40th of the sample."""
        live = ann._live(vectors)
        taken = live.withColumn("_h", F.xxhash64("region_id")).orderBy("_h", "region_id").limit(sample).select("region_id", "vector").collect()
        if not taken:
            self.shelf.drop("vectors", "centroids", "tombstones")
            self.centroids, self.probes = np.zeros((0, 0)), 0
            return
        data = np.array([r["vector"] for r in taken], np.float64)
        cells = cells or int(np.clip(2 ** round(np.log2(live.count()) / 2), 16, max(16, len(data) // 40)))
        self.centroids = fit_centroids(data, cells, rounds, seed)
        self.probes = len(self.centroids)
        self.shelf.drop("tombstones")
        self.shelf.commit(vectors=self._celled(live), centroids=self._centroid_rows())
        self.probes = self._fewest_probes([r["region_id"] for r in taken[:trial]], data[:trial], recall)
        self.shelf.commit(centroids=self._centroid_rows())

    def _centroid_rows(self) -> DataFrame:
        return self.spark.createDataFrame([(i, [float(x) for x in c], self.probes) for i, c in enumerate(self.centroids)], "cell long, vector array<double>, probes int")

    def _fewest_probes(self, ids: list[int], data: np.ndarray, recall: float, k: int = 10) -> int:
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, data, strict=True)], "query_id long, vector array<double>")
        stored = self.shelf.read("vectors")
        found = ann.knn(asked, stored.select("region_id", "vector"), k + 1).where("query_id <> region_id")
        # a bounded table: k + 1 rows for each of the trial's queries
        cells = stored.select("region_id", "cell").join(F.broadcast(found.select("query_id", "region_id")), "region_id").collect()
        order = nearest_cells(data, self.centroids, len(self.centroids)).argsort(1)
        at = {i: n for n, i in enumerate(ids)}
        needed = np.sort([order[at[r["query_id"]], r["cell"]] + 1 for r in cells])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else len(self.centroids)

    def _celled(self, rows: DataFrame) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = nearest_cells(ann._vectors(batch.column("vector")), centroids, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("region_id"), batch.column("vector")], ["cell", "region_id", "vector"])

        kind = rows.schema["vector"].dataType.simpleString()
        made = rows.select("region_id", "vector").mapInArrow(run, f"cell long, region_id long, vector {kind}")
        # ranges of cells, so that files hold few of them; a large cell is cut by region_id
        return made.repartitionByRange("cell", "region_id").sortWithinPartitions("cell", "region_id")

    def add(self, vectors: DataFrame) -> None:
        """More vectors, found from now on. An index without any is fitted to them."""
        if not len(self.centroids):
            self.fill(vectors)
            return
        self.shelf.commit(append=True, vectors=self._celled(ann._live(vectors)))

    def remove(self, ids: DataFrame) -> None:
        """Tombstones (region_id): no search finds these any more."""
        self.shelf.commit(append=True, tombstones=ids.select(F.col("region_id").cast("long").alias("region_id")).distinct())

    def tombstones(self) -> DataFrame:
        return self.shelf.read("tombstones", TOMBSTONES).distinct()

    def compact(self) -> None:
        """Write the vectors anew without those under tombstones."""
        stored = self.shelf.read("vectors").join(self.tombstones(), "region_id", "left_anti").select("cell", "region_id", "vector")
        self.shelf.commit(vectors=stored.repartitionByRange("cell", "region_id").sortWithinPartitions("cell", "region_id"), tombstones=self.spark.createDataFrame([], TOMBSTONES))

    def stats(self) -> DataFrame:
        """points, tombstones, live: one row."""
        points = self.shelf.read("vectors", "cell long, region_id long, vector array<double>").agg(F.count("*").alias("points"))
        gone = self.tombstones().agg(F.count("*").alias("tombstones"))
        return points.crossJoin(gone).select("points", "tombstones", ann.live_points(F.col("points"), F.col("tombstones")).alias("live"))

    def rebuild_if_needed(self, vectors: DataFrame, **options) -> bool:
        """Fill from the store's vectors if the index has lost more than half of them; whether it did."""
        stored = vectors.where(F.col("vector").isNotNull() & is_finite(F.col("vector"))).agg(F.count("*").alias("stored"))
        needed = self.stats().crossJoin(stored).select(rebuild_needed(F.col("stored"), F.col("points"), F.col("tombstones")).alias("x")).first()["x"]
        if needed:
            self.fill(vectors, **options)
        return bool(needed)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """Like ann.knn, but only among the vectors in the nearest cells of each query."""
        probes = min(probes or self.probes, len(self.centroids))
        if not probes:
            return self.spark.createDataFrame([], f"{ann.PAIRS}, rank int")
        live = self.shelf.read("vectors").join(self.tombstones(), "region_id", "left_anti").select("cell", "region_id", "vector")
        parts = []

        def add(block: list) -> None:
            ids, own = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)
            cells = nearest_cells(own, self.centroids, probes)
            needed = np.unique(cells)
            rows = live.where(F.col("cell").isin([int(c) for c in needed])) if len(needed) < len(self.centroids) else live
            parts.append(rows.mapInArrow(_cell_scan(ids, own, cells, k), ann.PAIRS))

        block = []
        for row in queries.select(F.col("query_id").cast("long"), "vector").where("vector is not null").toLocalIterator():
            block.append(row)
            if len(block) == ann.QUERY_BLOCK:
                add(block)
                block = []
        if block:
            add(block)
        if not parts:
            return self.spark.createDataFrame([], f"{ann.PAIRS}, rank int")
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return ann.ranked(found, k)


def _cell_scan(ids: np.ndarray, queries: np.ndarray, cells: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = ann.Best(len(ids), k)
        asked = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, own, vectors = batch.column("cell").to_numpy(), batch.column("region_id").to_numpy(), ann._vectors(batch.column("vector"))
            for c in np.unique(cell):
                at, who = np.flatnonzero(cell == c), asked.get(int(c), np.zeros(0, np.int64))
                step = max(1, ann.PRODUCTS // len(at))
                for i in range(0, len(who), step):
                    best.add(who[i : i + step], own[at], queries[who[i : i + step]] @ vectors[at].T)
        q, p, i = best.held
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(p)], ["query_id", "region_id", "product"])

    return run
