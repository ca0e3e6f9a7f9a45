"""Vectorised tokenising of Arrow string columns: byte offsets and 64-bit hashes of words.

Words are runs of bytes other than 0x20 and 0x09-0x0D; as these separators are ASCII, splitting
UTF-8 by bytes equals splitting by code points. Everything works on blocks of bounded size; a
text longer than a block forms a block of its own, and hashes inside it are made span by span.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SPAN = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_R, SPAN + 1)
_POW_INV = _powers(_R_INV, SPAN + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Block:
    """A few whole documents: rows of the source batch, their bytes and text offsets."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Slices of the batches of at most `most` bytes of text, or a single longer text. Null counts as empty.

    Memory that was freed goes back to the system after each batch: Python workers outlive their tasks.
    """
    for batch in batches:
        texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offs, raw = texts.buffers()
        ends = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            to = min(to, len(texts))
            yield Block(batch.slice(at, to - at), whole[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            at = to
        del batch, texts, whole
        trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, followed by trim."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return tidied


def _libc():
    try:
        found = ctypes.CDLL(None)
        found.malloc_trim  # noqa: B018
    except (OSError, AttributeError):
        return None
    return found


_LIBC = _libc()


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial in a fixed odd base, mixed with the length."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SPAN, side="right")))
        if ends[to - 1] - base > SPAN:
            out[at] = _long_hash(data[base : ends[at]])
            at += 1
            continue
        part = data[base : ends[to - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= _POW[: len(part)]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * _POW_INV[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long_hash(data: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for i in range(0, len(data), SPAN):
        part = data[i : i + SPAN].astype(np.uint64) + np.uint64(1)
        total = (total + scale * int(np.sum(part * _POW[: len(part)], dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(_R, len(part), 1 << 64) % (1 << 64)
    return np.uint64(total)


def windows(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows of each document, and the index of each document's first one.

    A document with 1 to n-1 words has one window: the whole sequence.
    """
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begins = np.zeros(len(first), dtype=np.int64)
    np.cumsum(made, out=begins[1:])
    out = np.zeros(begins[-1], dtype=np.uint64)
    if len(words) >= n:
        size = len(words) - n + 1
        rolled = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            rolled = mix(rolled * np.uint64(_R) + words[k : k + size]) if k == n - 1 else rolled * np.uint64(_R) + words[k : k + size]
        doc = np.repeat(np.arange(len(counts)), made)
        at = np.arange(begins[-1]) - begins[doc] + first[doc]
        full = counts[doc] >= n
        out[full] = rolled[at[full]]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.uint64(int(counts[d]))
        with np.errstate(over="ignore"):
            for w in words[first[d] : first[d + 1]]:
                h = h * np.uint64(_R) + w
        out[begins[d]] = mix(np.array([h]) ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0]
    return out, begins
