"""Query images from uploads and the clipboard: checks of their headers and sizes, and a pluggable encoder."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import Settings
from quire.functions.common import half_up


def query_size(w: Column, h: Column, edge: int = 1600) -> Column:
    """struct(width, height): at most `edge` long."""
    scale = F.least(F.lit(float(edge)) / F.greatest(w, h), F.lit(1.0))
    return F.struct(F.greatest(half_up(w * scale), F.lit(1)).alias("width"), F.greatest(half_up(h * scale), F.lit(1)).alias("height"))


def type_accepted(content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    return (kind == "") | F.startswith(kind, F.lit("image/"))


def accepted(uploads: DataFrame, s: Settings = Settings()) -> DataFrame:
    """uploads (content_type, body or n_bytes, width, height, top_k) with problem (null: accepted) and the top_k to use."""
    size = F.col("n_bytes") if "n_bytes" in uploads.columns else F.octet_length("body")
    problem = (
        F.when(~type_accepted(F.col("content_type")), "content type")
        .when(size > s.upload_limit, "too large")
        .when(F.col("width").cast("long") * F.col("height").cast("long") > s.max_query_pixels, "too many pixels")
    )
    return uploads.withColumns({"problem": problem, "top_k": F.coalesce(F.col("top_k").try_cast("long"), F.lit(s.default_top_k))})


def header_size(body: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP, WebP or JPEG image; None if it has no such header."""
    try:
        if body[:8] == b"\x89PNG\r\n\x1a\n" and body[12:16] == b"IHDR":
            return struct.unpack(">II", body[16:24])
        if body[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", body[6:10])
        if body[:2] == b"BM":
            w, h = struct.unpack("<ii", body[18:26])
            return w, abs(h)
        if body[:4] == b"RIFF" and body[8:12] == b"WEBP":
            if body[12:16] == b"VP8X":
                return 1 + int.from_bytes(body[24:27], "little"), 1 + int.from_bytes(body[27:30], "little")
            if body[12:16] == b"VP8L":
                bits = int.from_bytes(body[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if body[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", body[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if body[:2] == b"\xff\xd8":
            at = 2
            while body[at] == 0xFF:
                kind = body[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", body[at + 5 : at + 9])
                    return w, h
                at += 2 + (0 if kind == 0xFF else int.from_bytes(body[at + 2 : at + 4], "big"))
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def probed(bodies: pd.Series) -> pd.DataFrame:
    """Width and height told by images' headers, before anything is decoded; null where there is none."""
    sizes = [header_size(b) if b is not None else None for b in bodies]
    return pd.DataFrame({"width": pd.array([s and s[0] for s in sizes], "Int64"), "height": pd.array([s and s[1] for s in sizes], "Int64")})


def probed_uploads(uploads: DataFrame, s: Settings = Settings()) -> DataFrame:
    """uploads (content_type, body, top_k) with width and height by their headers, problem and top_k as accepted tells; a
    body without a known header is 'not an image'."""
    rows = accepted(uploads.withColumn("_size", probed("body")).withColumns({"width": F.col("_size.width"), "height": F.col("_size.height")}).drop("_size"), s)
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("width").isNull(), "not an image")))


def stub_encoder(images: list[bytes], dimensions: int = 64) -> np.ndarray:
    """Deterministic unit vectors of images' bytes, for tests: no model is part of this library."""
    out = []
    for image in images:
        rng = np.random.default_rng(np.frombuffer(hashlib.sha256(image).digest(), np.uint32))
        v = rng.normal(size=dimensions)
        out.append(v / np.linalg.norm(v))
    return np.array(out, np.float32).reshape(len(images), dimensions)


def encoded(rows: DataFrame, key: str, image: str, encode: Callable[[list[bytes]], np.ndarray] = stub_encoder, chunk: int = 32) -> DataFrame:
    """key, vector: images in chunks through an encoder, which is made once in each worker where it needs a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                vectors = encode([b or b"" for b in part.column(image).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], [key, "vector"])

    return rows.select(F.col(key).cast("long").alias(key), image).mapInArrow(run, f"{key} long, vector array<float>")
