"""Three channels to one ranking: merge by page, weighted fusion, top k, late enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.config import Settings
from quire.functions.common import clamp
from quire.functions.text import rfc3339
from quire.functions.vectors import similarity


def page_hits(vector: DataFrame, phash: DataFrame, regions: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Vector matches (query_id, region_id, product) that reach the threshold, and hash matches, with page_id."""
    pages = regions.select("region_id", "page_id")
    sims = vector.withColumn("sim", similarity(F.col("product"))).where(F.col("sim") >= threshold)
    return sims.join(pages, "region_id"), phash.join(pages, "region_id")


def merge_channels(sims: DataFrame, hashes: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, page_id, vector_sim (highest), phash_dist (least), text_score: one tagged union and one shuffle
    in place of two full outer joins; a missing signal is null."""
    none = lambda t: F.lit(None).cast(t)
    rows = sims.select("query_id", "page_id", F.col("sim").alias("v"), none("int").alias("d"), none("double").alias("t"))
    rows = rows.unionByName(hashes.select("query_id", "page_id", none("double").alias("v"), F.col("distance").cast("int").alias("d"), none("double").alias("t")))
    rows = rows.unionByName(texts.select("query_id", "page_id", none("double").alias("v"), none("int").alias("d"), F.col("text_score").alias("t")))
    return rows.groupBy("query_id", "page_id").agg(F.max("v").alias("vector_sim"), F.min("d").alias("phash_dist"), F.max("t").alias("text_score"))


def fusion_score(vector_sim: Column, phash_dist: Column, text_score: Column, s: Settings = Settings()) -> Column:
    """Weighted sum within 0 and 1; a missing signal adds nothing."""
    zero = F.lit(0.0)
    v = F.coalesce(clamp(vector_sim), zero)
    p = F.coalesce(F.lit(1.0) - clamp(phash_dist / F.lit(64.0)), zero)
    t = F.coalesce(clamp(text_score), zero)
    return clamp(F.lit(s.weight_vector) * v + F.lit(s.weight_phash) * p + F.lit(s.weight_text) * t)


def top_k(merged: DataFrame, k: int, s: Settings = Settings()) -> DataFrame:
    """merged with score and rank (from 1), ties by page_id."""
    scored = merged.withColumn("score", fusion_score(F.col("vector_sim"), F.col("phash_dist"), F.col("text_score"), s))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "page_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def assemble(top: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """Results with what pages and files tell of them, joined after the cut; those of missing files leave."""
    info = pages.select(F.col("id").alias("page_id"), "file_id", "page_num", "thumb_path")
    file = files.select(F.col("id").alias("file_id"), "path", "filename", "file_type", "file_size", "modified_at")
    return top.join(info, "page_id").join(file, "file_id").select(
        "query_id", "rank", "page_id", "file_id", "path", "filename", "file_type", "page_num", "file_size",
        rfc3339(F.col("modified_at")).alias("modified_at"), F.concat(F.lit("/thumbnails/"), F.col("thumb_path")).alias("thumbnail_url"),
        "score", F.coalesce("vector_sim", F.lit(0.0)).alias("similarity"), F.col("phash_dist").alias("phash_distance"), "text_score",
    )
