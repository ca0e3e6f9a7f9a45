"""Vectors and 64-bit hashes: normalising, products, distances and codecs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clamp, let

SHRINK = 1 - 1e-4
ZERO_NORM = 1e-20


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def square_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """Unit vectors, shrunk by SHRINK; a vector with a non-finite element becomes zero, one near zero stays."""
    scaled = let(square_sum(v), lambda q: F.when(q < ZERO_NORM, v.cast("array<double>")).otherwise(let(F.lit(SHRINK) / F.sqrt(q), lambda s: F.transform(v, lambda x: x.cast("double") * s))))
    return F.when(is_finite(v), scaled).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(product: Column) -> Column:
    """Of a distance 1 - product: its complement, within 0 and 1."""
    return clamp(product)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(v: Column) -> Column:
    """The sign bits of up to 64 elements, the first one highest, as a long."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


@F.pandas_udf(T.BinaryType())
def vector_to_blob(vectors: pd.Series) -> pd.Series:
    """32-bit little-endian floats: one conversion for a whole batch, cut at the vectors' ends."""
    size = vectors.map(len, na_action="ignore").fillna(0).astype(int).to_numpy()
    flat = np.concatenate([v for v in vectors if v is not None] or [np.zeros(0)]).astype("<f4").tobytes()
    ends = np.cumsum(size) * 4
    return pd.Series([None if v is None else flat[e - 4 * n : e] for v, e, n in zip(vectors, ends, size, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: pd.Series) -> pd.Series:
    """32-bit little-endian floats; one to three bytes left over at the end are ignored."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))


def lanczos(source: int, target: int, lobes: int = 3) -> np.ndarray:
    """target x source weights that resample a row by the Lanczos kernel, widened where it shrinks."""
    ratio = source / target
    scale = max(ratio, 1.0)
    centre = (np.arange(target)[:, None] + 0.5) * ratio
    x = (np.arange(source)[None, :] + 0.5 - centre) / scale
    weights = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return weights / weights.sum(1, keepdims=True)


def gradient_hash(pixels: np.ndarray, size: int = 8) -> int:
    """The double-gradient hash of a grey image: it is resampled to (size / 2 + 1) squared grey values; whether each is less
    than the one to its right, row by row, then than the one below, column by column, are bits, the lowest of each byte
    first; the bytes are those of an unsigned number, the lowest first (40 bits at size 8)."""
    n = size // 2 + 1
    small = np.clip(np.round(lanczos(pixels.shape[0], n) @ pixels @ lanczos(pixels.shape[1], n).T), 0, 255)
    bits = np.concatenate([(small[:, :-1] < small[:, 1:]).reshape(-1), (small[:-1] < small[1:]).T.reshape(-1)])
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes()[:8], "little")


@F.pandas_udf(T.LongType())
def phash(images: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Hash of grey images given as bytes (one a pixel), width and height, bit-cast to a signed long."""
    for grey, width, height in images:
        yield pd.Series([int(np.uint64(gradient_hash(np.frombuffer(g, np.uint8).reshape(h, w).astype(float))).astype(np.int64)) for g, w, h in zip(grey, width, height, strict=True)])
