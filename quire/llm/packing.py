"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

A piece of L tokens costs LINEAR * L + QUADRATIC * L * L (attention). Documents are cut where they
exceed a sequence; full pieces are sequences by themselves. Of a block of the rest, the pieces go,
longest first, each to the sequence of the lowest cost with room for it; what fits nowhere is cut
over the sequences with most room, so a block wastes less than one sequence. Blocks are bounded
and packed where they are tokenised: no shuffle, no group that grows with the input.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.runtime import bound_batches

from .words import tidy

END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: A block of pieces that are packed together: at most so many tokens and pieces.
BLOCK_TOKENS, BLOCK_PIECES = 500_000, 40_000
_SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


@functools.cache
def _fast(ranks_path: str):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary


@functools.cache
def _exact(json_path: str) -> Tokenizer:
    return Tokenizer.from_file(json_path)


def token_ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """The JSON tokenizer's ids of a text, then END_ID. The ranks file is the same vocabulary for a
    faster library; a text with the special token's string goes to the JSON tokenizer itself."""
    ids = _exact(json_path).encode(text, add_special_tokens=False).ids if _SPECIAL in text else _fast(ranks_path)(text)
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def pack(lengths: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in piece, length, bin, offset in bin) of pieces shorter than `size`, cut only if they fit nowhere."""
    if not len(lengths):
        return []
    bins = -(-int(lengths.sum()) // size)
    room, cost = np.full(bins, size, np.int64), np.zeros(bins)
    placed = []
    for piece in np.argsort(-lengths, kind="stable"):
        left, start = int(lengths[piece]), 0
        while left:
            fits = np.where(room >= left, cost, np.inf)
            at = int(fits.argmin())
            if fits[at] == np.inf:
                at = int(room.argmax())
            take = min(left, int(room[at]))
            placed.append((int(piece), start, take, at, size - int(room[at])))
            room[at] -= take
            cost[at] += LINEAR * take + QUADRATIC * take * take
            left, start = left - take, start + take
    return placed


def _packer(size: int, json_path: str, ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId()) << 40
        out: list[tuple] = []
        rest: list[tuple] = []
        waiting = 0

        def price(n: int) -> float:
            return LINEAR * n + QUADRATIC * n * n

        def flush() -> None:
            nonlocal sequence, waiting
            bins = -1
            for piece, start, length, at, offset in pack(np.array([len(r[3]) for r in rest], np.int64), size):
                doc_id, base, total, ids = rest[piece]
                out.append((doc_id, base + start, length, total, sequence + at, offset, price(length), ids[start : start + length].tobytes()))
                bins = max(bins, at)
            sequence += bins + 1
            rest.clear()
            waiting = 0

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.int64()] * 6 + [pa.float64(), pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return made

        ready = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = token_ids(text.as_py() or "", json_path, ranks_path)
                full = len(ids) // size
                for k in range(full):
                    out.append((doc_id.as_py(), k * size, size, len(ids), sequence, 0, price(size), ids[k * size : (k + 1) * size].tobytes()))
                    sequence += 1
                ready += full * size
                if len(ids) % size:
                    rest.append((doc_id.as_py(), full * size, len(ids), ids[full * size :].copy()))
                    waiting += len(ids) % size
                if waiting >= BLOCK_TOKENS or len(rest) >= BLOCK_PIECES:
                    ready += waiting
                    flush()
                if ready >= BLOCK_TOKENS:
                    yield taken()
                    ready = 0
        flush()
        if out:
            yield taken()

    return tidy(run)


def pack_documents(docs: DataFrame, size: int = 2048, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, cost, ids (unsigned little-endian 32-bit).

    A null or empty text is one end id. Repeated rows are packed each. sequence_id: the partition's
    number times 2**40, then gapless. Offsets in a sequence are gapless from 0. Empty input: no rows.
    Only doc_id and text are read.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(size, str(json_path), str(ranks_path)), SCHEMA)


def with_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op1_cost_packing(spark, sf_dir: str) -> DataFrame:
    return with_digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
