"""Evaluation: seeded samples, recall and reciprocal rank by size, latency percentiles, calibration."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.common import nearest_rank

#: Size classes of query crops by their share of the page.
SMALL, MEDIUM, LARGE = "small(<25%)", "medium(25-60%)", "large(>60%)"


def seeded_sample(rows: DataFrame, seed: int, n: int, *key: str) -> DataFrame:
    """The first n rows in the order of a hash of the seed and the key columns."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), *key))).orderBy("_h", *key).limit(n).drop("_h")


def size_class(area: Column) -> Column:
    return F.when(area < 0.25, SMALL).when(area < 0.60, MEDIUM).otherwise(LARGE)


def quality(ranked: DataFrame) -> DataFrame:
    """bucket, n, r1, r5, r10, mrr of ranked (query_id, area_ratio, rank): by size class and 'overall', in one pass."""
    rows = ranked.withColumn("bucket", size_class(F.col("area_ratio")))
    hit = lambda k: F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0))
    made = rows.rollup("bucket").agg(F.count("*").alias("n"), *(hit(k).alias(f"r{k}") for k in (1, 5, 10)), F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))
    return made.withColumn("bucket", F.coalesce("bucket", F.lit("overall")))


def stage_latency(log: DataFrame, stages: tuple[str, ...] = ("encode", "ocr", "ann", "phash", "rank")) -> DataFrame:
    """stage, p50, p95 (nearest rank), mean (whole milliseconds) of log columns <stage>_ms."""
    long = log.select("query_id", F.stack(F.lit(len(stages)), *(x for s in stages for x in (F.lit(s), F.col(f"{s}_ms")))).alias("stage", "ms"))
    means = long.groupBy("stage").agg(F.expr("sum(ms) div count(ms)").alias("mean"))
    return nearest_rank(long, ["stage"], "ms", {"p50": 0.5, "p95": 0.95}).join(means, "stage")


def calibration(log: DataFrame) -> DataFrame:
    """kind, p05, p25, p50, p95 of the similarity of hits, and of the best result of misses."""
    rows = log.select(F.when(F.col("rank").isNotNull(), "hit").otherwise("miss_top1").alias("kind"), F.when(F.col("rank").isNotNull(), F.col("sim")).otherwise(F.col("top1_sim")).alias("s"))
    return nearest_rank(rows, ["kind"], "s", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95})


def suggested_threshold(log: DataFrame) -> float:
    row = calibration(log).where("kind = 'hit'").first()
    return float(row["p05"]) if row else 0.0


def first_misses(ranked: DataFrame, n: int = 50) -> DataFrame:
    return ranked.where("rank is null").orderBy("query_id").limit(n)


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(done * 100.0 / total, F.lit(100.0)))


def progress_report(done: Column, total: Column, files: Column, finished: Column) -> Column:
    """struct(percent, status) as a service would show it."""
    pct = F.when(finished, F.lit(100.0)).when(total == 0, F.when(files > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(progress_percent(done, total))
    return F.struct(pct.alias("percent"), F.when(finished, "ready").otherwise("indexing").alias("status"))


def reconciled(total: Column, done: Column, failed: Column) -> Column:
    """struct(total, failed): what is missing counts as failed; an overshoot raises the total."""
    seen = done + failed
    return F.struct(F.greatest(total, seen).alias("total"), (failed + F.greatest(total - seen, F.lit(0))).alias("failed"))


def synthetic_crops(pages: DataFrame, seed: int, per_page: int = 1) -> DataFrame:
    """pages (page_id, width_px, height_px) with per_page seeded crops: x, y, w, h (share of the page), area_ratio,
    edge (long edge in pixels), brightness and quality. Area 0.08 to 0.90, aspect 0.75 to 1.3333."""
    u = lambda name: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "page_id", "crop", F.lit(name))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = pages.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(per_page - 1))))
    area, aspect = F.lit(0.08) + u("area") * F.lit(0.82), F.lit(0.75) + u("aspect") * F.lit(0.5833)
    rows = rows.withColumns({"_w": F.least(F.sqrt(area * aspect), F.lit(1.0)), "_h": F.least(F.sqrt(area / aspect), F.lit(1.0))})
    pixels = lambda share, dim: F.least(F.greatest(F.round(F.col(share) * F.col(dim)), F.lit(16)), F.col(dim))
    rows = rows.withColumns({"w": pixels("_w", "width_px") / F.col("width_px"), "h": pixels("_h", "height_px") / F.col("height_px")})
    return rows.withColumns({
        "x": u("x") * (1 - F.col("w")), "y": u("y") * (1 - F.col("h")), "area_ratio": F.col("w") * F.col("h"),
        "edge": F.floor(F.lit(320) + u("edge") * 581), "brightness": F.floor(u("light") * 51) - 25, "quality": F.floor(F.lit(70) + u("quality") * 21),
    }).drop("_w", "_h")


def report(ranked: DataFrame, log: DataFrame) -> str:
    """The figures of an evaluation as JSON: quality by size class, latency by stage, calibration, first misses."""
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731 - each has a few rows
    parts = {
        "quality": rows(quality(ranked).orderBy("bucket")), "latency": rows(stage_latency(log).orderBy("stage")), "calibration": rows(calibration(log).orderBy("kind")),
        "suggested_threshold": suggested_threshold(log), "misses": [r["query_id"] for r in first_misses(ranked).collect()],
    }
    return json.dumps(parts, indent=2)
