"""From files to the payload of new pages: a pluggable renderer, ten regions a page, hashes and vectors.

One Python worker handles a partition of files. A file whose rendering raises is reported as an error;
one that kills its worker fails the task, and the ledger of attempts (operators.ingest) tells to skip it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.vectors import gradient_hash

from .upload import stub_encoder

PAYLOAD = "file_id long, status string, pages array<struct<page_num:bigint,width_px:bigint,height_px:bigint,thumb_path:string,regions:array<struct<kind:string,idx:bigint,bbox:struct<x:float,y:float,w:float,h:float>,phash:bigint,vector:array<float>>>>>"


def stub_renderer(content: bytes) -> list[np.ndarray]:
    """One grey page of a file's bytes, 32 wide; an empty file has none. For tests: no renderer is part of this library."""
    data = np.frombuffer(content, np.uint8)
    return [np.resize(data, (-(-len(data) // 32), 32))] if len(data) else []


def regions_of(page: np.ndarray, tiles: bool = True) -> list[tuple[str, int, tuple[float, float, float, float], np.ndarray]]:
    """kind, idx, box (shares of the page) and pixels of the full page and its nine overlapping tiles."""
    height, width = page.shape[:2]
    out = [("full", 0, (0.0, 0.0, 1.0, 1.0), page)]
    if tiles and height and width:
        for i in range(9):
            x, y = i % 3 * 0.25, i // 3 * 0.25
            left, top = int(x * width), int(y * height)
            right, bottom = max(int(np.floor((x + 0.5) * width + 0.5)), left + 1), max(int(np.floor((y + 0.5) * height + 0.5)), top + 1)
            out.append(("tile", i, (x, y, 0.5, 0.5), page[top:bottom, left:right]))
    return out


def page_payload(
    files: DataFrame, render: Callable[[bytes], list[np.ndarray]] = stub_renderer, encode: Callable[[list[bytes]], np.ndarray] = stub_encoder, tiles: bool = True, chunk: int = 32
) -> DataFrame:
    """file_id, status ('ok', or 'error: ...') and pages, as store.insert_pages takes them, of files (file_id, content)."""

    def pages_of(file_id: int, content: bytes) -> list[dict]:
        pages = render(content)
        parts = [(n, r) for n, p in enumerate(pages) for r in regions_of(p, tiles)]
        vectors = [v for i in range(0, len(parts), chunk) for v in encode([np.ascontiguousarray(r[3]).tobytes() for _, r in parts[i : i + chunk]])]
        made = [dict(page_num=n + 1, width_px=p.shape[1], height_px=p.shape[0], thumb_path=f"{file_id}_{n + 1}.webp", regions=[]) for n, p in enumerate(pages)]
        for (n, (kind, idx, box, pixels)), vector in zip(parts, vectors, strict=True):
            grey = pixels.mean(2) if pixels.ndim == 3 else pixels.astype(float)
            signed = int(np.uint64(gradient_hash(grey)).astype(np.int64))
            made[n]["regions"].append(dict(kind=kind, idx=idx, bbox=dict(zip("xywh", box, strict=True)), phash=signed, vector=[float(x) for x in vector]))
        return made

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file_id, content in frame[["file_id", "content"]].itertuples(index=False):
                try:
                    row = (file_id, "ok", pages_of(file_id, content or b""))
                except Exception as e:  # noqa: BLE001 - whatever a renderer raises is this file's outcome
                    row = (file_id, f"error: {type(e).__name__}", [])
                yield pd.DataFrame([row], columns=["file_id", "status", "pages"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInPandas(run, PAYLOAD)
