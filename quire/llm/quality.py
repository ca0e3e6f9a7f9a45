"""A regularised quadratic discriminant over transformed statistics of documents.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and its diagonal. The
score is the posterior from the difference of the two log-densities, whose Mahalanobis terms use
cached Cholesky factors. Moments are sums over all labelled rows, taken where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import bound_batches, staged

from .words import Block, blocks, hashes, lower_ascii, spans, windows

FEATURES = ("words", "word_length", "symbols", "upper", "shouts", "stops", "digits", "repeats", "variety", "lines", "repeated_lines", "foreign", "bars", "stutter")
BLOCK = 1 << 20
_CLASSES = {"symbols": b"#*$%&<>@^~=+\\{}[]_", "shouts": b"!?", "stops": b".,;:", "digits": b"0123456789", "bars": b"|", "newline": b"\n"}
_TABLES = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _CLASSES.items()}
_TABLES["upper"] = ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
_TABLES["letter"] = _TABLES["upper"] | ((np.arange(256) >= 97) & (np.arange(256) <= 122)).astype(np.uint8)
_TABLES["foreign"] = (np.arange(256) >= 192).astype(np.uint8)


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.float64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some], dtype=np.int64)
    return out


def _distinct(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[fresh], minlength=len(begins) - 1).astype(float)


def statistics(block: Block) -> np.ndarray:
    """documents x FEATURES: logarithms of counts, log-odds of shares. An empty text has the values of zero counts."""
    starts, ends, first = spans(block.data, block.offsets)
    n = np.diff(first).astype(float)
    count = {k: _per_doc(t[block.data], block.offsets) for k, t in _TABLES.items()}
    words = hashes(lower_ascii(block.data), starts, ends)
    grams, at = windows(words, first, 5)
    size = np.diff(block.offsets).astype(float)
    lengths = np.zeros(block.n)
    np.add.at(lengths, np.repeat(np.arange(block.n), np.diff(first)), (ends - starts).astype(float))
    breaks = np.union1d(block.offsets, np.flatnonzero(block.data == 10) + 1)
    line_at, line_end = breaks[:-1], breaks[1:]
    begin = np.searchsorted(line_at, block.offsets)
    line = hashes(block.data, line_at, np.where(block.data[line_end - 1] == 10, line_end - 1, line_end)) if len(line_at) else np.zeros(0, np.uint64)
    lines = np.diff(begin).astype(float)
    odds = lambda k, m: np.log((k + 0.5) / (np.maximum(m - k, 0) + 0.5))
    rate = lambda k: np.log((k + 0.5) / (n + 1))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][n > 0]] = False
    made = {
        "words": np.log1p(n), "word_length": np.log((lengths + 5) / (n + 1)), "symbols": rate(count["symbols"]), "upper": odds(count["upper"], count["letter"]),
        "shouts": rate(count["shouts"]), "stops": rate(count["stops"]), "digits": rate(count["digits"]), "repeats": odds(np.diff(at) - _distinct(grams, at), np.diff(at)),
        "variety": odds(_distinct(words, first), n), "lines": rate(lines), "repeated_lines": odds(lines - _distinct(line, begin), lines), "foreign": odds(count["foreign"], size), "bars": rate(count["bars"]),
        "stutter": rate(np.bincount(np.repeat(np.arange(block.n), np.diff(first)), weights=again, minlength=block.n)),
    }
    return np.stack([made[k] for k in FEATURES], 1)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    for block in blocks(batches, most=BLOCK):
        flat = pa.array(statistics(block).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1, dtype=np.int32) * d), flat)
        yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), block.rows.column("held_out"), lists], ["doc_id", "held_out", "x"])


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, place, value: counts, sums and sums of products of this partition's rows."""
    for batch in batches:
        x = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("x"))])
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for label in np.unique(y):
            own = x[y == label]
            flat = (own.T @ own).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), label, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["label", "place", "value"])


class Discriminant:
    """Two Gaussians with shrunken covariances; fitted from a (1 + d)^2 matrix of moments for each label."""

    def __init__(self, sums: dict[int, np.ndarray], to_pooled: float = 0.2, to_diagonal: float = 0.05, temper: float = 0.3):
        self.ready = all(k in sums and sums[k][0, 0] > 1 for k in (0, 1))
        self.temper = temper
        self.only = 0.5 if not sums else float(max(sums, key=lambda k: sums[k][0, 0]))
        if not self.ready:
            return
        n = {k: s[0, 0] for k, s in sums.items()}
        mean = {k: s[0, 1:] / n[k] for k, s in sums.items()}
        cov = {k: s[1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k, s in sums.items()}
        pooled = sum(n[k] * cov[k] for k in (0, 1)) / (n[0] + n[1])
        self.prior = np.log(n[1] / n[0])
        self.parts = {}
        for k in (0, 1):
            c = (1 - to_pooled) * cov[k] + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.parts[k] = (mean[k], np.linalg.inv(factor).T, 2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.only)
        log = {k: -0.5 * (np.square((x - m) @ inverse).sum(1) + logdet) for k, (m, inverse, logdet) in self.parts.items()}
        # features aren't independent given the class, so their evidence is tempered before the prior is added
        z = self.temper * (log[1] - log[0]) + self.prior
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: DataFrame, **shrinkage: float) -> Discriminant:
    """From rows of label (0 or 1) and x."""
    d = len(FEATURES) + 1
    sums: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        sums.setdefault(r["label"], np.zeros(d * d))[r["place"]] = r["value"]
    return Discriminant({k: v.reshape(d, d) for k, v in sums.items()}, **shrinkage)


def held_out_rows(folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (posterior of label 1), predicted.

    labels: doc_id, quality (rows with null are ignored; of a document's labels the largest counts).
    Learns from labelled rows that aren't held out. A null text counts as empty; an empty text has the
    score of its zero counts. With fewer than two rows of either label all scores are the commoner
    label, 0.5 without any. Repeated rows get equal scores. Empty input: no rows. Only doc_id and text
    are read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out_rows())
    described = staged(rows.mapInArrow(describe, "doc_id long, held_out boolean, x array<double>"), "statistics")
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    model = docs.sparkSession.sparkContext.broadcast(fit(described.where(~F.col("held_out")).join(known, "doc_id").select("label", "x")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.value.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(made), pa.array((made >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return described.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def with_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with score and predicted, as quality_scores gives them, row by row and without a join. Columns of docs that
    have these two names are replaced.

    Only labelled rows are described to learn from them. Up to most_broadcast labels (about 16 MB) go to the documents;
    with more, all rows that aren't held out are described where they lie and joined by their statistics alone.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out_rows().alias("held_out")).where(~F.col("held_out"))
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = staged(known.where(~held_out_rows()), "labels")
    if known.count() <= most_broadcast:
        rows = rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    described = rows.mapInArrow(describe, "doc_id long, held_out boolean, x array<double>")
    model = docs.sparkSession.sparkContext.broadcast(fit(described.join(known, "doc_id").select("label", "x")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=BLOCK):
            made = model.value.score(statistics(block))
            rows_ = block.rows.select([c for c in block.rows.schema.names if c not in ("score", "predicted")])
            yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(made), pa.array((made >= threshold).astype(np.int32))], [*rows_.schema.names, "score", "predicted"])

    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(score, schema)


def op2_quadratic_discriminant(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
