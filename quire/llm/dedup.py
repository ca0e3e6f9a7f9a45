"""Exact dedup with composable polynomial fingerprints.

A text's fingerprint is the value of its UTF-8 bytes as a polynomial modulo two primes below 2**31.
Chunks of a huge text are hashed apart, in parallel; the hash of chunk c with s bytes after it
contributes hash(c) * base**s, and contributions add up, in any order, to the hash of the whole.
Texts with equal fingerprints are then compared with one of their group, chunk by chunk, so a
collision can't merge different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import bound_batches, staged

from .words import Block, blocks

PRIMES = (2147483629, 2147483587)
BASES = (1000003, 92821)
#: Bytes whose weighted sum stays below 2**53, so that a float64 dot product is exact.
ROW = 4096


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    for i in range(n - 2, -1, -1):
        out[i] = out[i + 1] * base % prime
    return out


def _mod_pow(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, power, left = np.ones(len(exponents), np.int64), base % prime, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * power % prime, out)
        power = power * power % prime
        left = left >> 1
    return out


_TABLES = [_powers(b, p, ROW).astype(np.float64) for b, p in zip(BASES, PRIMES, strict=True)]


def fingerprints(block: Block) -> list[np.ndarray]:
    """Polynomial hashes of the block's texts, one array for each prime: rows of ROW bytes by a dot
    product, then rows of a text by length-shifted sums. A byte b counts as b + 1."""
    sizes = np.diff(block.offsets)
    rows = (sizes + ROW - 1) // ROW
    owner = np.repeat(np.arange(block.n), rows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    # the first row of a text is the short one, so every later row is full and sits at a multiple of ROW from the end
    after = (np.repeat(rows, rows) - 1 - at) * ROW
    ends = block.offsets[1:][owner] - after
    begins = np.maximum(block.offsets[:-1][owner], ends - ROW)
    out = [np.zeros(block.n, np.int64) for _ in PRIMES]
    for i in range(0, len(owner), 256):
        b, e, o = begins[i : i + 256], ends[i : i + 256], owner[i : i + 256]
        tile = np.zeros((len(b), ROW), np.float64)
        for k in range(len(b)):
            tile[k, ROW - (e[k] - b[k]) :] = block.data[b[k] : e[k]]
            tile[k, ROW - (e[k] - b[k]) :] += 1
        for h, table, base, prime in zip(out, _TABLES, BASES, PRIMES, strict=True):
            value = (tile @ table).astype(np.int64) % prime
            np.add.at(h, o, value * _mod_pow(base, after[i : i + 256], prime) % prime)
            h %= prime
    return out


def _hasher(column: str, primes: tuple[int, int]):
    """Adds h1, h2 and the factors base**bytes (s1, s2) that shift what stands before the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, column):
            rest = [c for c in block.rows.schema.names if c != column]
            sizes = np.diff(block.offsets)
            made = [*fingerprints(block), *(_mod_pow(b, sizes, p) for b, p in zip(BASES, PRIMES, strict=True))]
            made[:2] = [h % few for h, few in zip(made[:2], primes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(block.rows.column(c) for c in rest), *map(pa.array, made)], [*rest, "h1", "h2", "s1", "s2"])

    return run


def chunked(rows: DataFrame, chunk_chars: int) -> DataFrame:
    """rows with text replaced by pos and chunk: pieces of at most chunk_chars characters, one for an empty text."""
    whole = F.length("text") <= chunk_chars
    count = F.greatest(F.ceil(F.length("text") / chunk_chars), F.lit(1)).cast("int")
    keep = [c for c in rows.columns if c != "text"]
    return rows.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos")).select(
        *keep, "pos", F.when(whole, F.col("text")).otherwise(F.substring("text", F.col("pos") * chunk_chars + 1, F.lit(chunk_chars))).alias("chunk")
    )


def fingerprint_table(rows: DataFrame, chunk_chars: int, primes: tuple[int, int]) -> DataFrame:
    """doc_id, text_sha256, n_bytes, h1, h2 of rows (doc_id, text, text_sha256, n_bytes).

    Texts of up to chunk_chars characters are hashed where they lie; the chunks of longer ones are
    dealt out, hashed in parallel, and their hashes combined in order.
    """
    kept = "doc_id long, text_sha256 string, n_bytes long"
    made = "h1 long, h2 long, s1 long, s2 long"
    out = ["doc_id", "text_sha256", "n_bytes", "h1", "h2"]
    small = rows.where(F.length("text") <= chunk_chars).mapInArrow(_hasher("text", primes), f"{kept}, {made}").select(*out)
    huge = chunked(rows.where(F.length("text") > chunk_chars).withColumn("rid", F.monotonically_increasing_id()), chunk_chars)
    hashed = huge.repartition("rid", "pos").mapInArrow(_hasher("chunk", PRIMES), f"{kept}, rid long, pos int, {made}")
    parts = hashed.groupBy("rid", "doc_id", "text_sha256", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "s1", "s2"))).alias("parts"))

    def whole(h: str, shift: str, k: int) -> Column:
        fold = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: (a * x[shift] + x[h]) % PRIMES[k])
        return (fold % primes[k]).alias(h)

    return small.unionByName(parts.select("doc_id", "text_sha256", "n_bytes", whole("h1", "s1", 0), whole("h2", "s2", 1)))


def dedup_exact(docs: DataFrame, chunk_chars: int = 1 << 20, primes: tuple[int, int] = PRIMES, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their characters are; null counts as empty. Of equal texts the row with the
    largest doc_id stays (null is smallest; of rows that repeat both doc_id and text, one stays).
    Empty input: no rows. Only doc_id and text are read, so other columns may have any names.

    Rows with equal fingerprints are compared with their group's first choice, chunk by chunk; rows
    that differ (a collision) form groups of their own in a further round, until none differ. Only
    texts that share a fingerprint move. Their keys are broadcast up to broadcast_rows (about 40 MB
    at the default) and joined by a shuffle beyond. primes: smaller values cause collisions (tests).
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumns({"text_sha256": F.sha2("text", 256), "n_bytes": F.octet_length("text").cast("long")})
    table = staged(fingerprint_table(rows, chunk_chars, primes).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    group = ["h1", "h2", "n_bytes"]
    me = F.struct("doc_id", "rid", "text_sha256")
    # written first, so that the join has plain shuffles on both sides and can split a hot group
    sized = table.join(staged(table.groupBy(*group).agg(F.count("*").alias("n"), F.max(me).alias("best")), "groups"), group)
    alone = sized.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    pending = sized.where("n > 1").select(*table.columns, "best")
    settled = None
    while True:
        verdict = staged(_compared(rows, pending, chunk_chars, broadcast_rows), "verdicts")
        same = verdict.where("equal")
        settled = same if settled is None else settled.unionByName(same)
        left = verdict.where("not equal").drop("equal", "best")
        if left.isEmpty():
            break
        pending = left.join(left.groupBy(*group).agg(F.max(me).alias("best")), group)
    sizes = staged(settled.groupBy(F.col("best.rid").alias("keep_rid")).agg(F.count("*").alias("group_size")), "sizes")
    copies = settled.withColumn("keep_rid", F.col("best.rid")).join(sizes, "keep_rid").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(copies)


def _compared(rows: DataFrame, pending: DataFrame, chunk_chars: int, broadcast_rows: int) -> DataFrame:
    """pending with equal: whether the row's text is that of its group's best row, compared chunk by chunk."""
    group = ["h1", "h2", "n_bytes"]
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    pending = staged(pending, "pending")
    small = pending.count() <= broadcast_rows
    side = F.broadcast if small else (lambda x: x)
    texts = rows.select(key.alias("key"), "text_sha256", "text")
    who = pending.select(key.alias("key"), "text_sha256", *group).distinct()
    first = pending.select(F.coalesce("best.doc_id", F.lit(-(1 << 63)).cast("long")).alias("key"), F.col("best.text_sha256").alias("text_sha256"), *group).distinct()
    mine = chunked(texts.join(side(who), ["key", "text_sha256"]), chunk_chars)
    best = chunked(texts.join(side(first), ["key", "text_sha256"]), chunk_chars).groupBy(*group, "pos").agg(F.max("chunk").alias("other"))
    best = staged(best, "best")
    checked = mine.join(best, [*group, "pos"], "left").select("key", "text_sha256", *group, F.coalesce(F.col("chunk") == F.col("other"), F.lit(False)).alias("equal"))
    checked = checked.groupBy("key", "text_sha256", *group).agg(F.bool_and("equal").alias("equal"))
    return pending.withColumn("key", key).join(checked, ["key", "text_sha256", *group]).drop("key")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
