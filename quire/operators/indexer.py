"""Ingest end to end: scan, decide, render, insert and index, in batches that are committed whole.

The store is a set of snapshots with the tables files, pages, regions and page_ocr. A batch's files are
taken out of the store and put in anew; a crash between two commits costs a batch, never the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Settings
from quire.sources.pages import page_payload
from quire.runtime import staged

from . import ingest, store
from .index import VectorIndex

TABLES = {"files": store.FILES, "pages": store.PAGES, "regions": store.REGIONS, "page_ocr": store.PAGE_OCR}
REASON = "links to other files"


def tables(shelf: store.Snapshots) -> dict[str, DataFrame]:
    return {name: shelf.read(name, schema) for name, schema in TABLES.items()}


def remove_files(shelf: store.Snapshots, paths: DataFrame, index: VectorIndex | None = None) -> None:
    """Files, with all that is stored of them, out of the store and the index."""
    now = tables(shelf)
    left = store.cascade_delete(paths.select("path").distinct(), now["files"], now["pages"], now["regions"], now["page_ocr"])
    gone = staged(left.pop("removed_regions").select(F.col("id").alias("region_id")), "removed")
    shelf.commit(**left)
    if index is not None:
        index.remove(gone)


def index_files(shelf: store.Snapshots, contents: DataFrame, now: int, render: Callable, encode: Callable, index: VectorIndex | None = None) -> dict[str, int]:
    """Render and store known files: contents has path, content. How many were indexed, excluded and failed."""
    at = tables(shelf)
    rows = contents.join(at["files"].select("path", F.col("id").alias("file_id")), "path").select("file_id", "content", ingest.is_imposition(ingest.latin1(F.col("content"))).alias("linked"), F.sha1("content").alias("sha1"))
    # what is read of the files again: neither rendered twice nor kept in the driver
    known = staged(rows.select("file_id", "linked", "sha1"), "known")
    payload = staged(page_payload(rows.where("not linked"), render, encode), "payload")
    done = payload.where("status = 'ok'").select(F.col("file_id").alias("id"))
    old = store.cascade_delete(at["files"].join(done, "id", "left_semi").select("path"), at["files"], at["pages"], at["regions"], at["page_ocr"])
    top = lambda name: at[name].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    pages, regions = store.insert_pages(payload.where("status = 'ok'").select("file_id", "pages"), top("pages"), top("regions"))
    pages, regions = staged(pages, "pages"), staged(regions, "regions")
    files = store.mark_excluded(at["files"], known.where("linked").select(F.col("file_id").alias("id")), REASON)
    files = store.bump_crash(files, payload.where("status <> 'ok'").select(F.col("file_id").alias("id")))
    files = store.reset_crash(store.mark_indexed(files, payload.where("status = 'ok'").select(F.col("file_id").alias("id"), F.size("pages").alias("pages")), now), done)
    files = store.set_hash(files, known.join(done, known["file_id"] == done["id"], "left_semi").select(F.col("file_id").alias("id"), "sha1"))
    gone = staged(old["removed_regions"].select(F.col("id").alias("region_id")), "removed")
    shelf.commit(files=files, pages=old["pages"].unionByName(pages), regions=old["regions"].unionByName(regions.select(*at["regions"].columns)), page_ocr=old["page_ocr"])
    if index is not None:
        index.remove(gone)
        index.add(regions.select(F.col("id").alias("region_id"), "vector"))
    return {"indexed": done.count(), "excluded": known.where("linked").count(), "failed": payload.where("status <> 'ok'").count()}


def contents_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content") if paths else spark.createDataFrame([], "path string, content binary")


def index_folder(
    spark: SparkSession, shelf: store.Snapshots, roots: list[str], now: int, render: Callable, encode: Callable, index: VectorIndex | None = None, s: Settings = Settings(), batch: int = 1_000
) -> dict[str, int]:
    """One pass over folders: what is new or changed is indexed in batches of paths, what vanished leaves, the rest stays
    as change_decisions tells. Returns how many files met each fate."""
    scan = staged(ingest.scan_directories(spark, roots, s.scan_depth, content=True), "scan")
    actions = staged(ingest.change_decisions(scan, shelf.read("files", store.FILES), s), "actions")
    told = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    vanished = staged(shelf.read("files", store.FILES).select("path").join(scan.select("path"), "path", "left_anti"), "vanished")
    told["vanished"] = vanished.count()
    if told["vanished"]:
        remove_files(shelf, vanished, index)
    chosen = lambda *names: scan.join(actions.where(F.col("action").isin(*names)).select("path"), "path", "left_semi")
    touched = chosen("index_new", "reindex", "refresh")
    files = store.upsert_files(shelf.read("files", store.FILES), touched, now)
    ids = lambda rows: files.join(rows.select("path"), "path", "left_semi").select("id")
    files = store.mark_excluded(files, ids(chosen("skip_and_exclude")), "crashed")
    files = store.updated(files, ids(chosen("refresh")), indexed_at=F.lit(now).cast("long"))
    shelf.commit(files=files)
    paths = [r["path"] for r in chosen("index_new", "reindex").select("path").orderBy("path").limit(batch).collect()]
    while paths:
        for k, n in index_files(shelf, contents_of(spark, paths), now, render, encode, index).items():
            told[k] = told.get(k, 0) + n
        left = chosen("index_new", "reindex").where(F.col("path") > paths[-1]) if len(paths) == batch else None
        paths = [r["path"] for r in left.orderBy("path").limit(batch).collect()] if left is not None else []
    return told
