"""SearchEngine: the batched search, status and evaluation calls over a store's tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import Settings
from quire.operators import ann, evaluate, fulltext, hashes, rank, store
from quire.operators.index import VectorIndex
from quire.runtime import staged


@dataclass
class SearchEngine:
    """files, pages, regions and page_ocr are DataFrames of the store; tombstones (region_id) and postings are optional.
    With an index, which has tombstones of its own, vectors are looked up there, else by an exact scan."""

    files: DataFrame
    pages: DataFrame
    regions: DataFrame
    page_ocr: DataFrame
    settings: Settings = field(default_factory=Settings)
    tombstones: DataFrame | None = None
    postings: DataFrame | None = None
    index: VectorIndex | None = None

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Ranked results of queries: query_id and any of vector, phash and text (null or absent: that channel is silent)."""
        s, k = self.settings, top_k or self.settings.default_top_k
        regions = self.regions.select(F.col("id").alias("region_id"), "page_id", "vector", "phash")
        have = set(queries.columns)
        empty = lambda schema: queries.sparkSession.createDataFrame([], schema)
        near = empty("query_id long, region_id long, product double")
        if "vector" in have:
            asked, most = queries.where("vector is not null"), s.ann_candidates(k)
            near = self.index.search(asked, most) if self.index else ann.knn(asked, regions.select("region_id", "vector"), most, self.tombstones)
        close = empty("query_id long, region_id long, distance int")
        if "phash" in have:
            close = hashes.closest(hashes.within(queries, regions.select("region_id", "phash"), s.phash_threshold), s.phash_candidates)
        texts = empty("query_id long, page_id long, text_score double")
        if "text" in have:
            texts = fulltext.normalized(fulltext.top_pages(fulltext.bm25(self.page_ocr, queries.where("text is not null"), self.postings), s.text_candidates))
        sims, dists = rank.page_hits(near, close, regions.select("region_id", "page_id"), s.similarity_threshold)
        return rank.assemble(rank.top_k(rank.merge_channels(sims, dists, texts), k, s), self.pages, self.files)

    def timed_search(self, queries: DataFrame, top_k: int | None = None) -> tuple[DataFrame, dict[str, float]]:
        """Results, computed, and the milliseconds that took."""
        began = time.time()
        found = staged(self.search(queries, top_k), "results")
        return found, {"search_ms": (time.time() - began) * 1000}

    def status(self) -> DataFrame:
        return store.index_stats(self.files, self.pages).crossJoin(store.ocr_progress(self.pages, self.page_ocr))

    def evaluate(self, queries: DataFrame, truth: DataFrame, top_k: int = 10) -> DataFrame:
        """Recall and reciprocal rank by size class: truth has query_id, expected_page_id, area_ratio."""
        return evaluate.quality(store.truth_rank(self.search(queries, top_k), truth))
