"""A watched folder end to end: listings to events, settling, the hash gate, and dispatch, in ticks.

Each tick compares a listing with the last one. What vanished is deleted first; what is new or changed
waits until two samples agree; settled files pass the hash gate, and go to `refresh` where their bytes
are known, to `index` where they are not, and back to the waiting ones where they cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.ingest import hash_gate
from quire.operators.store import Snapshots

LISTING = "path string, size long, mtime long"
PENDING = "path string, size long, mtime long, attempts int"


def changes(seen: DataFrame, listing: DataFrame) -> DataFrame:
    """path, event ('create', 'modify' or 'delete') between two listings (path, size, mtime)."""
    both = seen.select("path", F.struct("size", "mtime").alias("_a")).join(listing.select("path", F.struct("size", "mtime").alias("_b")), "path", "full_outer")
    event = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "modify")
    return both.select("path", event.alias("event")).where("event is not null")


def settle_tick(pending: DataFrame, listing: DataFrame, min_bytes: int = 1024, retries: int = 20) -> DataFrame:
    """pending (path, size, mtime, attempts) with the listing's sample of each path and its outcome: 'ready', 'dropped',
    'vanished' or null (it waits on, with one more attempt). The state machine of settle_step, for all paths at once."""
    now = listing.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    both = pending.join(now, "path", "left")
    same = (F.col("_size") >= min_bytes) & (F.col("attempts") > 0) & (F.col("size") == F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    outcome = F.when(F.col("_size").isNull(), "vanished").when(same, "ready").when(F.col("attempts") + 1 >= retries, "dropped")
    return both.select("path", F.col("_size").alias("size"), F.col("_mtime").alias("mtime"), (F.col("attempts") + 1).cast("int").alias("attempts"), outcome.alias("outcome"))


class Watcher:
    """State is kept in snapshots (tables seen and pending), so a new driver goes on where the last one stopped.

    listing() -> (path, size, mtime); hashes(paths) -> (path, content_sha1, null if unreadable); files() -> the known
    files; delete, refresh and index take a DataFrame of paths.
    """

    def __init__(
        self, shelf: Snapshots, listing: Callable[[], DataFrame], hashes: Callable[[DataFrame], DataFrame], files: Callable[[], DataFrame],
        delete: Callable[[DataFrame], None], refresh: Callable[[DataFrame], None], index: Callable[[DataFrame], None], min_bytes: int = 1024, retries: int = 20,
    ):
        self.shelf, self.listing, self.hashes, self.files = shelf, listing, hashes, files
        self.delete, self.refresh, self.index = delete, refresh, index
        self.min_bytes, self.retries = min_bytes, retries

    def tick(self) -> dict[str, int]:
        """One round; how many paths were deleted, refreshed, indexed, put back and dropped."""
        shelf = self.shelf
        shelf.commit(listing=self.listing())
        now, seen, pending = shelf.read("listing"), shelf.read("seen", LISTING), shelf.read("pending", PENDING)
        shelf.commit(events=changes(seen, now))
        events = shelf.read("events")
        gone, new = events.where("event = 'delete'").select("path"), events.where("event <> 'delete'").select("path")
        # a change of a waiting file is seen by its next sample
        waiting = pending.join(gone, "path", "left_anti").unionByName(new.join(pending, "path", "left_anti").selectExpr("path", "-1L as size", "-1L as mtime", "0 as attempts"))
        shelf.commit(settled=settle_tick(waiting, now, self.min_bytes, self.retries))
        settled = shelf.read("settled")
        ready = settled.where("outcome = 'ready'").select("path")
        shelf.commit(gated=hash_gate(self.hashes(ready), self.files()))
        gated = shelf.read("gated")
        again = gated.where("unchanged is null").selectExpr("path", "-1L as size", "-1L as mtime", "0 as attempts")
        told = {"deleted": gone.count(), "refreshed": 0, "indexed": 0, "again": again.count(), "dropped": settled.where("outcome = 'dropped'").count()}
        if told["deleted"]:
            self.delete(gone)
        for name, act, chosen in (("refreshed", self.refresh, gated.where("unchanged")), ("indexed", self.index, gated.where("not unchanged"))):
            told[name] = chosen.count()
            if told[name]:
                act(chosen.select("path"))
        # last: a tick that fails is done again
        shelf.commit(seen=now, pending=settled.where("outcome is null").select("path", "size", "mtime", "attempts").unionByName(again))
        return told

    def start(self, spark: SparkSession, checkpoint: str, seconds: int = 3):
        """A streaming query that ticks every so many seconds."""
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, __: self.tick()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, size, mtime of pdf and ai files anywhere below the roots. Missing roots are skipped, contents not read."""
    from quire.operators.ingest import scan_directories

    return scan_directories(spark, roots, depth=None).select("path", F.col("file_size").alias("size"), F.col("modified_at").alias("mtime"))
