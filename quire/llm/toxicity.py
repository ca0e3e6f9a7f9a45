"""Toxicity by a bidirectional gated recurrent network over all overlapping windows of a text.

Trained in numpy on the driver, on all windows of a bounded sample of labelled documents. Labels are of
documents; the windows of a toxic one that count as toxic are those with a word of which a part is far
more usual in toxic documents than in others, and its likeliest one. A document's logit is that of its
most toxic window, calibrated on documents of the sample that were set aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import bound_batches

from .gru import CHAR_ROWS, WINDOW, WORD_ROWS, Network, Trainer, Words, distinct_words, split_long, trimmed, window_table
from .quality import held_out_rows
from .words import Block, blocks, lower_ascii, mix, spans


@dataclass
class Model:
    net: Network
    slope: float
    offset: float
    #: Score of every text where the labels taught nothing; None if there is a network.
    only: float | None = None


def _read(data: np.ndarray, offsets: np.ndarray):
    data = lower_ascii(data)
    starts, ends, first = split_long(*spans(data, offsets))
    return data, *trimmed(data, starts, ends), first


def _index(places: np.ndarray, table: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    at = table[:, :1] + np.arange(WINDOW)
    mask = at < table[:, 1:]
    return np.where(mask, places[np.minimum(at, len(places) - 1)], padding), mask.astype(np.float32)


def logits(net: Network, block: Block, batch: int = 2048) -> np.ndarray:
    """The highest logit of each document's windows; -inf for one without words."""
    out = np.full(block.n, -np.inf)
    data, starts, ends, first = _read(block.data, block.offsets)
    if not len(starts):
        return out
    words, places = distinct_words(data, starts, ends)
    inputs = net.project(net.vectors(words))
    table, doc = window_table(first)
    for i in range(0, len(doc), batch):
        index, mask = _index(places, table[i : i + batch], inputs.shape[1] - 1)
        np.maximum.at(out, doc[i : i + batch], net.forward(inputs, index, mask))
    return out


def sample(rows: DataFrame, known: DataFrame, most_docs: int, most_bytes: int) -> pa.Table:
    """doc_id, toxic, text of the labelled rows to learn from, as toxicity_scores tells. Of rows that share a labelled
    doc_id the one whose text has the least hash counts, so that a repeated doc_id gathers nothing unbounded."""
    picked = [known.where(F.col("toxic") == k).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(most_docs) for k in (0, 1)]
    hashed = rows.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = hashed.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("toxic", "turn", "doc_id").agg(F.min(F.struct("hash", F.octet_length("text").alias("bytes"))).alias("first"))
    taken, spent = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r["turn"], r["doc_id"])):
        spent[r["toxic"]] += r["first"]["bytes"]
        if spent[r["toxic"]] <= most_bytes or spent[r["toxic"]] == r["first"]["bytes"]:
            taken.append((r["doc_id"], r["toxic"], r["first"]["hash"]))
    chosen = rows.sparkSession.createDataFrame(taken, "doc_id long, toxic int, hash long")
    found = hashed.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "toxic").agg(F.first("text").alias("text"))
    return found.toArrow().sort_by("doc_id")


def evidence(words: Words, index: np.ndarray, mask: np.ndarray, doc: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each window the strongest sign of a toxic word: over the rows of the embedding tables that its words
    use, the highest shrunken log-odds that a toxic or other document uses the row."""
    rows = np.concatenate([words.rows, words.grams + WORD_ROWS])
    owner = np.concatenate([np.arange(len(words.rows)), np.repeat(np.arange(len(words.rows)), np.diff(words.begins))])
    used = np.unique((doc[:, None] * (len(words.rows) + 1) + index)[mask > 0])
    begins = np.searchsorted(used, np.arange(len(label) + 1) * (len(words.rows) + 1))
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(words.rows) + 1))
    sizes, by_word = np.diff(first), rows[order]
    seen = np.zeros((2, WORD_ROWS + CHAR_ROWS))
    # document by document, as all of their words' rows at once would be many times the texts
    for k in range(len(label)):
        word = used[begins[k] : begins[k + 1]] - k * (len(words.rows) + 1)
        size = sizes[word]
        flat = np.repeat(first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        seen[label[k], np.unique(by_word[flat])] += 1
    seen /= np.maximum([[(label == 0).sum()], [(label == 1).sum()]], 1)
    shrink = 3 / max(min((label == 0).sum(), (label == 1).sum()), 1)
    odds = np.log((seen[1] + shrink) / (seen[0] + shrink))
    sign = np.maximum.reduceat(odds[by_word], first[:-1])
    return np.where(mask > 0, np.append(sign, 0)[index], -np.inf).max(1)


def fit(docs: np.ndarray, toxic: np.ndarray, texts: list[bytes], prior: float = 0.5, steps: int = 900, rounds: int = 10, batch: int = 256, strong: float = 1.5, miss_cost: float = 3.0, seed: int = 3) -> Model:
    """A model from all windows of labelled texts. A fifth of the documents calibrate, for a share `prior` of toxic ones
    among all; a score of 0.5 is where a missed toxic document, of cost miss_cost, weighs as much as a false alarm, of
    cost 1. Half of a batch are windows that count as toxic."""
    if len(set(toxic.tolist())) < 2:
        return Model(Network(), 1.0, 0.0, float(toxic[0]) if len(toxic) else 0.5)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, starts, ends, first = _read(np.frombuffer(b"".join(texts), np.uint8), offsets)
    words, places = distinct_words(data, starts, ends)
    table, of = window_table(first)
    index, mask = _index(places, table, len(words.rows))
    docs, toxic = docs[of], toxic[of]
    if len(set(toxic.tolist())) < 2:
        return Model(Network(), 1.0, 0.0, float(toxic[0]) if len(toxic) else 0.5)
    kinds, doc = np.unique(docs, return_inverse=True)
    label = np.zeros(len(kinds), int)
    label[doc] = toxic
    aside = (mix(kinds.astype(np.int64).view(np.uint64)) % np.uint64(5) == 0)[doc]
    if len(set(toxic[~aside].tolist())) < 2 or len(set(toxic[aside].tolist())) < 2:
        aside = np.zeros(len(doc), bool)
    net, rng = Network(), np.random.default_rng(seed)
    trainer = Trainer(net)
    sign = evidence(words, index[~aside], mask[~aside], doc[~aside], label)
    best = np.full(len(kinds), -np.inf)
    np.maximum.at(best, doc[~aside], sign)
    target = np.zeros(len(doc), np.float32)
    target[~aside] = (toxic[~aside] == 1) & ((sign >= strong) | (sign == best[doc[~aside]]))
    use = [np.flatnonzero(~aside & (target == k)) for k in (0, 1)]
    left: list[np.ndarray] = [np.zeros(0, np.int64)] * 2

    def draw(k: int, n: int) -> np.ndarray:
        """The next n windows of a kind, in shuffled rounds over all of them."""
        while len(left[k]) < n:
            left[k] = np.concatenate([left[k], rng.permutation(use[k])])
        out, left[k] = left[k][:n], left[k][n:]
        return out

    steps = min(steps, rounds * -(-int((~aside).sum()) // batch))
    one = np.ones(2 * (batch // 2), np.float32)
    for _ in range(steps if all(map(len, use)) else 0):
        at = np.concatenate([draw(0, batch // 2), draw(1, batch // 2)])
        trainer.step(words, index[at], mask[at], target[at], one, rng)
    now = _all_logits(net, words, index, mask)
    top = np.full(len(kinds), -np.inf)
    np.maximum.at(top, doc, now)
    check = np.unique(doc[aside]) if aside.any() else np.arange(len(kinds))
    slope, offset = calibrated(top[check], label[check])
    return Model(net, slope, offset + float(np.log(miss_cost * prior / (1 - prior))))


def _all_logits(net: Network, words, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    inputs = net.project(net.vectors(words))
    return np.concatenate([net.forward(inputs, index[i : i + 2048], mask[i : i + 2048]) for i in range(0, len(index), 2048)])


def calibrated(top: np.ndarray, label: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """slope and offset of a logistic fit of labels to logits, both classes alike in weight, slightly held to slope 1."""
    a, b = 1.0, 0.0
    w = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -50, 50)))
        e, h = w * (p - label), w * p * (1 - p)
        grad = np.array([(e * top).sum() + 0.01 * (a - 1), e.sum() + 0.001 * b])
        curve = np.array([[(h * top * top).sum() + 0.01, (h * top).sum()], [(h * top).sum(), h.sum() + 0.001]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(curve, grad), -1, 1)
    return max(float(a), 0.05), float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_docs: int = 800, most_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: doc_id, held_out, score (of label 1), predicted.

    labels: doc_id, toxic (rows with null are ignored; of a document's labels the largest counts).
    Learns from labelled rows that aren't held out: of each label, in the order of a hash of doc_id, up
    to most_docs rows and until their whole texts have most_bytes (one at least), with all of their
    windows. Every window of every text is scored. A null, empty or blank text scores 0. Without both
    labels all scores are the one label, 0.5 without any. Repeated rows get equal scores. Empty input:
    no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out_rows())
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out_rows())
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = (totals.get(1, 0) + 1) / (totals.get(0, 0) + totals.get(1, 0) + 2)
    found = sample(rows, known, most_docs, most_bytes)
    model = spark.sparkContext.broadcast(fit(found.column("doc_id").to_numpy(), found.column("toxic").to_numpy(), [x.encode() for x in found.column("text").to_pylist()], prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for block in blocks(batches, most=2 << 20):
            if m.only is None:
                z = logits(m.net, block)
                made = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(m.slope * z + m.offset, -60, 60))), 0.0)
            else:
                made = np.full(block.n, m.only)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column("doc_id"), block.rows.column("held_out"), pa.array(made), pa.array((made >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op8_recurrent_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
