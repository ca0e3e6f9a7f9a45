"""File events: settling of growing files, order within a tick, and OCR backfill."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.store import orphan_pages, pending_ocr, upsert_ocr


@dataclass
class Pending:
    size: int = -1
    mtime: int = -1
    attempts: int = 0


def settle_step(state: Pending, size: int | None, mtime: int | None, min_bytes: int = 1024, retries: int = 20) -> tuple[Pending | None, str | None]:
    """A sample of a pending file: its next state (None: no longer pending) and 'ready', 'vanished', 'dropped' or None."""
    if size is None:
        return None, "vanished"
    large = size >= min_bytes
    if large and state.attempts > 0 and (state.size, state.mtime) == (size, mtime):
        return None, "ready"
    attempts = state.attempts + 1
    if attempts >= retries:
        return None, "dropped"
    return Pending(size, mtime, attempts), None


def settle(samples: DataFrame, min_bytes: int = 1024, retries: int = 20) -> DataFrame:
    """path, outcome, seq of a stream of samples (path, seq, size, mtime; a null size: the file is gone)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = Pending(*state.get) if state.exists else None
        found = []
        # a batch's samples of one path may come in several frames, in any order
        for seq, size, mtime in pd.concat(list(frames)).sort_values("seq")[["seq", "size", "mtime"]].itertuples(index=False):
            now, outcome = settle_step(now or Pending(), None if pd.isna(size) else int(size), None if pd.isna(mtime) else int(mtime), min_bytes, retries)
            if outcome:
                found.append((key[0], outcome, int(seq)))
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((now.size, now.mtime, now.attempts))
        if found:
            yield pd.DataFrame(found, columns=["path", "outcome", "seq"])

    return samples.groupBy("path").applyInPandasWithState(run, "path string, outcome string, seq long", "size long, mtime long, attempts long", "append", GroupStateTimeout.NoTimeout)


def first_stable(samples: DataFrame, min_bytes: int = 1024, retries: int = 20) -> DataFrame:
    """path, seq of each path's first 'ready': the state machine as a batch. A sample of a missing file (null size) and
    every `retries`-th one that is not ready forget what was before; the next is a first one."""
    w = W.partitionBy("path").orderBy("seq")
    gone = F.sum(F.col("size").isNull().cast("int")).over(w)
    runs = samples.withColumn("_run", F.when(F.col("size").isNull(), -1).otherwise(gone))
    inside = W.partitionBy("path", "_run").orderBy("seq")
    same = (F.lag("size").over(inside) == F.col("size")) & F.lag("mtime").over(inside).eqNullSafe(F.col("mtime")) & (F.col("size") >= min_bytes)
    told = runs.withColumns({"_same": same, "_try": (F.row_number().over(inside) - 1) % retries})
    return told.where("_same and _try > 0 and _run >= 0").groupBy("path").agg(F.min("seq").alias("seq"))


def net_events(events: DataFrame) -> DataFrame:
    """path, event, step of one tick's events (path, seq, event): a path's delete (step 0) stands whatever follows and
    cancels the modifies before it; a modify after the last delete stands too (step 1)."""
    last = lambda kind: F.max(F.when(F.col("event") == kind, F.col("seq")))
    ends = events.withColumn("event", F.when(F.col("event") == "delete", "delete").otherwise("modify")).groupBy("path").agg(last("delete").alias("_gone"), last("modify").alias("_new"))
    kinds = F.array(F.when(F.col("_gone").isNotNull(), F.struct(F.lit("delete").alias("event"), F.lit(0).alias("step"))), F.when(F.col("_new").isNotNull() & (F.col("_gone").isNull() | (F.col("_new") > F.col("_gone"))), F.struct(F.lit("modify").alias("event"), F.lit(1).alias("step"))))
    return ends.select("path", F.explode(F.array_compact(kinds)).alias("x")).select("path", "x.*")


def run_events(stream: DataFrame, delete: Callable[[DataFrame], None], modify: Callable[[DataFrame], None], checkpoint: str, seconds: int = 3):
    """Starts a query that handles each tick's deletes, then its modifies."""

    def tick(batch: DataFrame, _: int) -> None:
        net = net_events(batch).persist()
        try:
            delete(net.where("step = 0").select("path"))
            modify(net.where("step = 1").select("path"))
        finally:
            net.unpersist()

    return stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def backfill_ocr(pages: DataFrame, files: DataFrame, ocr: DataFrame, recognize: Callable[[DataFrame], DataFrame], now: int, batch: int = 200, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """page_ocr after all pending pages went through recognize (page_id, path, page_num -> page_id, text), batch by
    batch by a moving key, and orphans got placeholders. Pages that recognize leaves out get an empty text."""
    after = -1
    while True:
        claimed = cut(pending_ocr(pages, files, ocr, after, batch))
        top = claimed.agg(F.max("page_id")).first()[0]
        if top is None:
            break
        read = claimed.select("page_id").join(recognize(claimed), "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(now).cast("long").alias("ocr_at"), F.lit(0).alias("seq"))
        ocr, after = cut(upsert_ocr(ocr, read)), top
    return ocr.unionByName(orphan_pages(pages, files, ocr, now).select(*ocr.columns))


def start_rescan(spark: SparkSession, scan: Callable[[], None], checkpoint: str, seconds: int = 1800, clock: Callable[[], float] = time.time):
    """Starts a query that calls scan every so many seconds; where a scan runs over, the ticks it covers are skipped."""
    ended: list[int] = []

    def tick(_: DataFrame, __: int) -> None:
        if due(ended, seconds, clock()):
            scan()
            ended[:] = [int(clock() // seconds)]

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def due(ended: list[int], seconds: float, now: float) -> bool:
    """Whether a tick at `now` is to scan: not in the interval in which the last scan ended."""
    return not ended or int(now // seconds) > ended[0]
