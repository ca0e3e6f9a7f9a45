"""Geometry of regions, renderings and thumbnails, and pixel conversions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import half_up

IMAGE_MEAN, IMAGE_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def _long(x: Column) -> Column:
    return x.cast("long")


def tile_struct(i: Column) -> Column:
    col, row = F.pmod(i, F.lit(3)), F.floor(i / 3)
    return F.struct(F.lit("tile").alias("kind"), _long(i).alias("idx"), (col * F.lit(0.25)).alias("x"), (row * F.lit(0.25)).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))


def full_struct() -> Column:
    return F.struct(F.lit("full").alias("kind"), F.lit(0).cast("long").alias("idx"), *(F.lit(v).alias(k) for k, v in (("x", 0.0), ("y", 0.0), ("w", 1.0), ("h", 1.0))))


def expand_regions(pages: DataFrame, tiles: bool = True, width: str = "width_px", height: str = "height_px") -> DataFrame:
    """pages with a row for the full page and, for pages of some size, its nine overlapping tiles: kind, idx, x, y, w, h
    and the pixel rectangle px, py, pw, ph."""
    some = (F.col(width) > 0) & (F.col(height) > 0)
    nine = F.transform(F.sequence(F.lit(0), F.lit(8)), tile_struct)
    regions = F.concat(F.array(full_struct()), F.when(some, nine).otherwise(F.array().cast("array<struct<kind:string,idx:bigint,x:double,y:double,w:double,h:double>>"))) if tiles else F.array(full_struct())
    out = pages.withColumn("_r", F.explode(regions)).select(*pages.columns, "_r.*")
    for start, size, dim, at, extent in (("x", "w", width, "px", "pw"), ("y", "h", height, "py", "ph")):
        low = F.floor(F.col(start) * F.col(dim))
        out = out.withColumns({at: _long(low), extent: _long(F.greatest(half_up(F.least(F.col(start) + F.col(size), F.lit(1.0)) * F.col(dim)) - low, F.lit(1)))})
    return out


def render_size(w: Column, h: Column, edge: int) -> Column:
    """struct(width, height) with the long edge scaled to `edge`; a page without size is a square."""
    scale = F.lit(float(edge)) / F.greatest(w, h)
    size = lambda x: F.greatest(half_up(x * scale), F.lit(1))
    bad = (w <= 0) | (h <= 0) | w.isNull() | h.isNull()
    return F.struct(F.when(bad, edge).otherwise(size(w)).cast("long").alias("width"), F.when(bad, edge).otherwise(size(h)).cast("long").alias("height"))


def letterbox(w: Column, h: Column, size: int) -> Column:
    """struct(width, height, left, top) of an image fitted into a square."""
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    fit = lambda x: F.least(F.greatest(half_up(x * scale), F.lit(1)), F.lit(size)).cast("long")
    pad = lambda x: _long(F.floor((F.lit(size) - fit(x)) / 2))
    return F.struct(fit(w).alias("width"), fit(h).alias("height"), pad(w).alias("left"), pad(h).alias("top"))


def center_crop(w: Column, h: Column, fraction: float) -> Column:
    """struct(left, top, width, height); a fraction of nearly 1 is the whole."""
    fraction = min(max(fraction, 0.05), 1.0)
    if fraction >= 0.999:
        return F.struct(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("top"), _long(w).alias("width"), _long(h).alias("height"))
    size = lambda x: F.greatest(half_up(x * F.lit(fraction)), F.lit(1))
    start = lambda x: _long(F.floor((x - size(x)) / 2))
    return F.struct(start(w).alias("left"), start(h).alias("top"), _long(size(w)).alias("width"), _long(size(h)).alias("height"))


def thumbnail_size(w: Column, h: Column, edge: int = 256) -> Column:
    """struct(width, height) contained in a square; small images stay."""
    scale = F.least(F.lit(float(edge)) / w, F.lit(float(edge)) / h, F.lit(1.0))
    size = lambda x: F.greatest(half_up(x * scale), F.lit(1)).cast("long")
    return F.struct(size(w).alias("width"), size(h).alias("height"))


def thumbnail_name(file_id: Column, page_num: Column) -> Column:
    return F.concat(file_id.cast("string"), F.lit("_"), page_num.cast("string"), F.lit(".webp"))


def detector_size(w: Column, h: Column, side: int = 1280) -> Column:
    """struct(width, height) for text detection: at most `side` long, in multiples of 32."""
    scale = F.least(F.lit(float(side)) / F.greatest(w, h), F.lit(1.0))
    size = lambda x: F.greatest(half_up(x * scale / 32) * 32, F.lit(32)).cast("long")
    return F.struct(size(w).alias("width"), size(h).alias("height"))


def recognizer_width(w: Column, h: Column, height: int = 48, most: int = 320) -> Column:
    return F.least(F.greatest(F.ceil(F.lit(float(height)) * w / F.greatest(h, F.lit(1))), F.lit(8)), F.lit(most)).cast("long")


def unclipped(x0: Column, y0: Column, x1: Column, y1: Column, w: int, h: int, ratio: float = 1.6) -> Column:
    """struct(x0, y0, x1, y1) of a box (x1, y1 exclusive) grown by area * ratio / perimeter, within the image."""
    bw, bh = x1 - x0, y1 - y0
    grow = F.ceil(bw * bh * F.lit(ratio) / (2 * (bw + bh)))
    return F.struct(
        _long(F.greatest(x0 - grow, F.lit(0))).alias("x0"), _long(F.greatest(y0 - grow, F.lit(0))).alias("y0"),
        _long(F.least(x1 + grow, F.lit(w))).alias("x1"), _long(F.least(y1 + grow, F.lit(h))).alias("y1"),
    )


def bgra_to_rgba(pixels: bytes) -> bytes:
    return np.frombuffer(pixels, np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()


@F.pandas_udf(T.BinaryType())
def rgba(pixels: pd.Series) -> pd.Series:
    """Pixels of blue, green, red and alpha bytes with the red first."""
    return pixels.map(lambda p: None if p is None else bgra_to_rgba(p))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def tensor(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Images (three bytes a pixel) as normalised channels, one after another; null where the bytes don't fit the size."""
    fits = lambda p, w, h: p is not None and len(p) == 3 * w * h
    return pd.Series([rgb_to_tensor(np.frombuffer(p, np.uint8).reshape(h, w, 3)).reshape(-1) if fits(p, w, h) else None for p, w, h in zip(rgb, width, height, strict=True)])


def rgb_to_tensor(rgb: np.ndarray) -> np.ndarray:
    """height x width x 3 bytes to 1 x 3 x height x width floats, normalised by channel."""
    return ((rgb / 255.0 - IMAGE_MEAN) / IMAGE_STD).transpose(2, 0, 1)[None].astype(np.float32)
