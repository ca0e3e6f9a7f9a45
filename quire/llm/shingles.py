"""Sets of word shingles as sorted arrays of 64-bit hashes, made from Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import Block, blocks, hashes, lower_ascii, mix, spans, windows

#: Min-hash rows; bands take BAND of them each.
MINHASHES, BAND = 32, 4
_SEEDS = mix(np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets_of(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, sorted, one after another; and where each begins (one more at the end)."""
    data = lower_ascii(block.data)
    starts, ends, first = spans(data, block.offsets)
    grams, begins = windows(hashes(data, starts, ends), first, n)
    doc = np.repeat(np.arange(block.n), np.diff(begins))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams = grams[fresh]
    return grams, np.searchsorted(doc[fresh], np.arange(block.n + 1))


def per_set(values: np.ndarray, begins: np.ndarray, reduce: np.ufunc, empty: int) -> np.ndarray:
    """reduce over each document's values; `empty` where it has none."""
    out = np.full(len(begins) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(begins) > 0)
    if len(some):
        out[some] = reduce.reduceat(values, begins[:-1][some])
    return out


def minhashes(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """documents x MINHASHES, 32 bits each."""
    out = np.zeros((len(begins) - 1, MINHASHES), dtype=np.uint32)
    for k in range(MINHASHES):
        turned = grams * _SEEDS[k]
        out[:, k] = per_set((turned >> np.uint64(32)).astype(np.uint32), begins, np.minimum, 0)
    return out


def digests(grams: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set, as two signed longs. The first also serves as the set's id."""
    s1 = per_set(grams, begins, np.add, 0)
    s2 = per_set(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), begins, np.bitwise_xor, 0)
    return mix(s1).view(np.int64), s2.view(np.int64)


SIGNED = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sig array<int>, cells binary"


def signer(n: int, bits: int):
    """Rows of doc_id, text_hash, n_shingles, s1, s2, sig (min-hashes); at the end of a partition, rows of cells:
    its counts of shingles by their first `bits` bits, s1 telling which slice of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "text_hash", "n_shingles", "s1", "s2", "sig", "cells"]
        for block in blocks(batches):
            grams, begins = sets_of(block, n)
            counts += np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            s1, s2 = digests(grams, begins)
            sig = minhashes(grams, begins).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * MINHASHES), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), block.rows.column("text_hash"), pa.array(np.diff(begins)), pa.array(s1), pa.array(s2), lists, pa.nulls(block.n, pa.binary())], names
            )
        for k, part in enumerate(np.split(counts, max(1, len(counts) >> SLICE_BITS))):
            if part.any():
                packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.array([packed], pa.binary())], names
                )

    return run


#: The cells of the frequency sketch are shipped in slices of this many.
SLICE_BITS = 12


def summed_cells(bits: int):
    """Adds up slices: rows of s1 (the slice), cells (one byte a cell: eight times the logarithm to base 2 of its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(1 << bits, 1 << SLICE_BITS)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("s1").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                raw = pa.decompress(packed, decompressed_size=4 * size, codec="zstd", asbytes=True)
                sums.setdefault(k, np.zeros(size, np.int64)).__iadd__(np.frombuffer(raw, np.uint32))
        for k, total in sums.items():
            codes = np.minimum(np.log2(total + 1.0) * 8, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([codes.tobytes()], pa.binary())], ["s1", "cells"])

    return run


def setter(n: int):
    """vid, set (sorted unsigned 64-bit hashes) for rows of vid, text; rows whose text has another set are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            grams, begins = sets_of(block, n)
            vid = block.rows.column("vid").to_numpy(zero_copy_only=False)
            own = np.flatnonzero(digests(grams, begins)[0] == vid)
            yield pa.RecordBatch.from_arrays([pa.array(vid[own]), pa.array([grams[begins[i] : begins[i + 1]].tobytes() for i in own], pa.binary())], ["vid", "set"])

    return run


def linker(num: int, den: int):
    """Adds linked to rows of a, b, set_a, set_b: den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run
