"""The relational store on snapshots: upserts, inserts, cascades and keyed updates as DataFrame operations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.common import numbered

FILES = "id long, path string, filename string, file_type string, file_size long, modified_at long, page_count long, is_excluded int, indexed_at long, created_at long, crash_attempts long, exclusion_reason string, content_sha1 string"
PAGES = "id long, file_id long, page_num long, width_px long, height_px long, thumb_path string"
REGIONS = "id long, page_id long, kind string, idx long, bbox struct<x:float,y:float,w:float,h:float>, phash long, vector array<float>"
PAGE_OCR = "page_id long, text string, ocr_at long"


def upsert_files(files: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """files with incoming (path, filename, file_type, file_size, modified_at) upserted by path.

    A file that became newer loses its crash count and exclusion. New ones get ids above the largest, by path.
    """
    names = ["filename", "file_type", "file_size", "modified_at"]
    new = incoming.select("path", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_in"))
    both = files.join(new, "path", "full_outer")
    given = F.coalesce(F.col("_in"), F.lit(False))
    newer = F.coalesce(F.col("_modified_at") > F.col("modified_at"), F.lit(False))
    kept = both.where("id is not null").select(
        "id", "path", *(F.when(given, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names), "page_count",
        F.when(newer, 0).otherwise(F.col("is_excluded")).cast("int").alias("is_excluded"), "indexed_at", "created_at",
        F.when(newer, 0).otherwise(F.col("crash_attempts")).cast("long").alias("crash_attempts"),
        F.when(~newer, F.col("exclusion_reason")).alias("exclusion_reason"), "content_sha1",
    )
    top = files.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(both.where("id is null").select("path", *(F.col(f"_{c}").alias(c) for c in names)), "path", name="id").select(
        (F.col("id") + top).alias("id"), "path", *names, F.lit(0).cast("long").alias("page_count"), F.lit(0).alias("is_excluded"), F.lit(None).cast("long").alias("indexed_at"),
        F.lit(now).cast("long").alias("created_at"), F.lit(0).cast("long").alias("crash_attempts"), F.lit(None).cast("string").alias("exclusion_reason"), F.lit(None).cast("string").alias("content_sha1"),
    )
    return kept.unionByName(added)


def insert_pages(payload: DataFrame, last_page: int, last_region: int) -> tuple[DataFrame, DataFrame]:
    """pages and regions of payload (file_id, pages: array of struct(page_num, width_px, height_px, thumb_path,
    regions: array of struct(kind, idx, bbox, phash, vector))), with ids in the order of files, pages and regions."""
    paged = payload.select("file_id", F.posexplode("pages").alias("_p", "p"))
    pages = numbered(paged, "file_id", "_p", name="_n").withColumn("id", F.col("_n") + last_page)
    made = pages.select("id", "file_id", "p.page_num", "p.width_px", "p.height_px", "p.thumb_path")
    regions = pages.select("file_id", "_p", F.col("id").alias("page_id"), F.posexplode("p.regions").alias("_r", "r"))
    regions = numbered(regions, "file_id", "_p", "_r", name="_n").select((F.col("_n") + last_region).alias("id"), "page_id", "r.*")
    return made, regions


def upsert_ocr(ocr: DataFrame, incoming: DataFrame) -> DataFrame:
    """page_ocr with incoming (page_id, text, ocr_at, seq): the last by seq replaces a page's text."""
    rows = ocr.withColumn("seq", F.lit(-1).cast("long")).unionByName(incoming.select(*ocr.columns, F.col("seq").cast("long")))
    last = rows.groupBy("page_id").agg(F.max_by(F.struct("text", "ocr_at"), "seq").alias("x"))
    return last.select("page_id", "x.text", "x.ocr_at")


def orphan_pages(pages: DataFrame, files: DataFrame, ocr: DataFrame, now: int) -> DataFrame:
    """Placeholders (empty text) for pages without OCR whose file is excluded or not indexed."""
    stale = files.where((F.col("is_excluded") == 1) | F.col("indexed_at").isNull()).select(F.col("id").alias("file_id"))
    return pages.join(stale, "file_id", "left_semi").join(ocr.select(F.col("page_id").alias("id")), "id", "left_anti").select(F.col("id").alias("page_id"), F.lit("").alias("text"), F.lit(now).cast("long").alias("ocr_at"))


def updated(table: DataFrame, changes: DataFrame, **columns: Column) -> DataFrame:
    """table with columns set, by expressions over the row and the changes' columns, in rows whose id is in changes."""
    marked = table.join(changes.withColumn("_hit", F.lit(True)), "id", "left")
    return marked.select(*(F.when(F.col("_hit"), columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def mark_excluded(files: DataFrame, ids: DataFrame, reason: str | None = None) -> DataFrame:
    extra = {"exclusion_reason": F.lit(reason)} if reason is not None else {}
    return updated(files, ids, is_excluded=F.lit(1), **extra)


def bump_crash(files: DataFrame, ids: DataFrame) -> DataFrame:
    return updated(files, ids, crash_attempts=F.col("crash_attempts") + 1)


def reset_crash(files: DataFrame, ids: DataFrame) -> DataFrame:
    return updated(files, ids, crash_attempts=F.lit(0).cast("long"))


def mark_indexed(files: DataFrame, counts: DataFrame, now: int) -> DataFrame:
    """counts: id, pages."""
    return updated(files, counts, indexed_at=F.lit(now).cast("long"), page_count=F.col("pages").cast("long"))


def set_hash(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """hashes: id, sha1."""
    return updated(files, hashes, content_sha1=F.col("sha1"))


def cascade_delete(paths: DataFrame, files: DataFrame, pages: DataFrame, regions: DataFrame, ocr: DataFrame) -> dict[str, DataFrame]:
    """What remains of the four tables without the files of paths, and the ids of the regions that went."""
    gone_files = files.join(paths, "path", "left_semi").select(F.col("id").alias("file_id"))
    gone_pages = pages.join(gone_files, "file_id", "left_semi").select(F.col("id").alias("page_id"))
    return {
        "files": files.join(paths, "path", "left_anti"),
        "pages": pages.join(gone_files, "file_id", "left_anti"),
        "regions": regions.join(gone_pages, "page_id", "left_anti"),
        "page_ocr": ocr.join(gone_pages, "page_id", "left_anti"),
        "removed_regions": regions.join(gone_pages, "page_id", "left_semi").select("id"),
    }


def file_regions(files: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """file_id, region_id."""
    return regions.select(F.col("id").alias("region_id"), "page_id").join(pages.select(F.col("id").alias("page_id"), "file_id"), "page_id").join(files.select(F.col("id").alias("file_id")), "file_id").select("file_id", "region_id")


def pending_ocr(pages: DataFrame, files: DataFrame, ocr: DataFrame, after: int, limit: int) -> DataFrame:
    """page_id, path, page_num of the next pages of live files without OCR."""
    live = files.where((F.col("is_excluded") == 0) & F.col("indexed_at").isNotNull()).select(F.col("id").alias("file_id"), "path")
    rows = pages.where(F.col("id") > after).join(live, "file_id").join(ocr.select(F.col("page_id").alias("id")), "id", "left_anti")
    return rows.orderBy("id").limit(limit).select(F.col("id").alias("page_id"), "path", "page_num")


def index_stats(files: DataFrame, pages: DataFrame) -> DataFrame:
    """total_files, indexed_files, excluded_files, failed_files, total_pages: one row."""
    live = F.col("is_excluded") == 0
    counts = files.agg(
        F.count("*").alias("total_files"), F.count_if(F.col("indexed_at").isNotNull() & live).alias("indexed_files"),
        F.count_if(F.col("is_excluded") == 1).alias("excluded_files"), F.count_if(F.col("indexed_at").isNull() & live).alias("failed_files"),
    )
    return counts.crossJoin(pages.agg(F.count("*").alias("total_pages")))


def ocr_progress(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    done, total = ocr.agg(F.count("*").alias("done")), pages.agg(F.count("*").alias("total"))
    return done.crossJoin(total).select("done", F.greatest(F.col("total") - F.col("done"), F.lit(0)).alias("pending"))


def rebuild_needed(stored: Column, points: Column, tombstones: Column) -> Column:
    """Whether an index has lost more than half of what the store has."""
    live = F.greatest(points - tombstones, F.lit(0))
    return (stored > 0) & (live * 2 < stored)


def truth_rank(results: DataFrame, truth: DataFrame) -> DataFrame:
    """truth with the rank at which results have its page, null for a miss."""
    return truth.join(results.select("query_id", F.col("page_id").alias("expected_page_id"), "rank"), ["query_id", "expected_page_id"], "left")


class Snapshots:
    """Tables as versioned folders under a base path, and numbered pointers, of which the highest counts.

    A commit writes new versions first, then a pointer under a new number, moved into place whole: readers see all of
    a commit or none, and a crash leaves the last one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        place = self._path(f"{self.base}/pointers")
        names = [f.getPath().getName() for f in self.fs.listStatus(place)] if self.fs.exists(place) else []
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> dict[str, list[str]]:
        """The folders of each table."""
        numbers = self._numbers()
        if not numbers:
            return {}
        return json.loads(self.spark.read.text(f"{self.base}/pointers/{numbers[-1]:012d}", wholetext=True).first()[0])

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        """A table; with a schema, an empty one where it was never committed."""
        places = self.current().get(table)
        if places is None and schema is not None:
            return self.spark.createDataFrame([], schema)
        if places is None:
            raise KeyError(table)
        return self.spark.read.parquet(*places)

    def commit(self, append: bool = False, **tables: DataFrame) -> None:
        """New versions of the tables, or with append more rows of them, in one step."""
        now, places = self.current(), {}
        for name, df in tables.items():
            place = f"{self.base}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(place)
            places[name] = [*(now.get(name, []) if append else []), place]
        self._point(now | places)

    def drop(self, *tables: str) -> None:
        self._point({k: v for k, v in self.current().items() if k not in tables})

    def clear(self) -> None:
        self.fs.delete(self._path(self.base), True)

    def _point(self, places: dict[str, list[str]]) -> None:
        numbers = self._numbers()
        fresh, name = f"{self.base}/pointers/_next-{uuid.uuid4().hex}", f"{self.base}/pointers/{(numbers or [0])[-1] + 1:012d}"
        out = self.fs.create(self._path(fresh), True)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(fresh), self._path(name)):
            raise OSError("another writer has committed")
        for old in numbers[:-2]:
            self.fs.delete(self._path(f"{self.base}/pointers/{old:012d}"), False)
