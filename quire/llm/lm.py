"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(v | u) = l2 * c(u, v) / c(u) + l1 * c(v) / N + l0 / (V + 1), with weights (l2, l1, l0) by the
bucket of the context's count c(u) (its bit length). The weights are learned by expectation-
maximisation on held-out counts: the events of all bigram types, each of them deleted once from
the counts that estimate it.

Counts are over all training documents. Bigrams are shipped as sorted binary runs of 32-bit
differences, by a bijective hash of the pair of word numbers, and never as a row each; scores come
back summed by document. The numbered vocabulary is sent to the workers up to max_vocab words
(about 100 MB); beyond, the same model is computed without one: blocks of tokens ask parts of the
hashed words and pairs for their counts, so nothing is held whole anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import bound_batches, staged, unstage

from .words import Block, hashes, lower_ascii, mix, spans, tidy
from .words import blocks as blocks_of

#: The end of a document, as a word's hash; it is also the context of a document's first word.
END = np.uint64(0x452821E638D01377)
BUCKETS = 40
KEY_BITS = 48
_ODD = 0x9E3779B97F4B
_INVERSE = pow(_ODD, -1, 1 << KEY_BITS)
_KEY_MASK = np.uint64((1 << KEY_BITS) - 1)
#: A hot bigram has a count of at least total / HOT_SHARE: there are at most HOT_SHARE of them.
HOT_SHARE = 200_000
ROWS = "kind int, part long, block long, a binary, b binary, c binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Smaller blocks than usual: besides them a worker holds the vocabulary."""
    return blocks_of(batches, most=2 << 20)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, each followed by END; where each document begins (one more at the end)."""
    data = lower_ascii(block.data)
    starts, ends, first = spans(data, block.offsets)
    words = hashes(data, starts, ends)
    begins = first + np.arange(block.n + 1)
    out = np.empty(begins[-1], np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[begins[1:] - 1] = True
    out[is_end], out[~is_end] = END, words
    return out, begins


def contexts(toks: np.ndarray, begins: np.ndarray, start) -> np.ndarray:
    out = np.empty_like(toks)
    out[1:] = toks[:-1]
    out[begins[:-1]] = start
    return out


def bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _flags(block: Block) -> np.ndarray:
    return block.rows.column("train").to_numpy(zero_copy_only=False).astype(bool)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        toks, begins = tokens(block)
        kinds, n = np.unique(toks[np.repeat(_flags(block), np.diff(begins))], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["h", "c"])


class Vocabulary:
    """Numbers of words (their place in the sorted hashes; unknown ones get `size`) and their counts."""

    def __init__(self, hashes_: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts, self.size = hashes_, counts, len(hashes_)

    def numbers(self, toks: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(toks, return_inverse=True)
        if not self.size:
            return np.zeros(len(toks), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, kinds), self.size - 1)
        return np.where(self.hashes[at] == kinds, at, self.size)[back]

    def pairs(self, toks: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers and the keys of the bigrams that they end."""
        numbers = self.numbers(toks)
        end = int(self.numbers(np.array([END]))[0])
        return numbers, (contexts(numbers, begins, end) * (self.size + 1) + numbers).astype(np.uint64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts of the first and second word of bigrams."""
        known = np.append(self.counts, 0)
        u, v = np.divmod(keys.astype(np.int64), self.size + 1)
        return known[u], known[v]


def turned(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(_ODD) & _KEY_MASK


def turned_back(keys: np.ndarray) -> np.ndarray:
    return keys * np.uint64(_INVERSE) & _KEY_MASK


def parted(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int]], list[bytes]]:
    """Of sorted turned keys: the part of each, the runs of equal parts, and each run as packed differences."""
    width = -(-(1 << KEY_BITS) // parts)
    part = (keys // np.uint64(width)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[cut] = keys[cut] - part[cut].astype(np.uint64) * np.uint64(width)
    runs = list(zip(cut, np.r_[cut[1:], len(part)], strict=True))
    return part[cut], runs, [(x := steps[i:j]).astype(np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes() for i, j in runs]


def unpacked(packed: bytes, n: int, part: int, parts: int) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint32 if len(packed) == 4 * n else np.uint64).astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(part) * np.uint64(-(-(1 << KEY_BITS) // parts))


COUNTS = "part long, a binary, b binary, n long"


def count_pairs(vocabulary, parts: int):
    """The distinct training bigrams of each block that belong to a part, and how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            toks, begins = tokens(block)
            _, keys = vocabulary.value.pairs(toks, begins)
            kinds, n = np.unique(turned(keys[np.repeat(_flags(block), np.diff(begins))]), return_counts=True)
            part, runs, packed = parted(kinds, parts)
            counts = [(x := n[i:j]).astype(np.uint8 if x.max() < 1 << 8 else np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes() for i, j in runs]
            sizes = pa.array([j - i for i, j in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(packed, pa.binary()), pa.array(counts, pa.binary()), sizes], ["part", "a", "b", "n"])

    return run


CELLS = "cell long, w double, p2 double, p1 double"


def _cells(c: np.ndarray, cu: np.ndarray, cv: np.ndarray, total: int, events: np.ndarray | None = None) -> pa.RecordBatch:
    """Events (c, or those given of them) with the estimates that remain when one is deleted, summed over cells of like values."""
    p2 = np.where(cu > 1, (c - 1) / np.maximum(cu - 1, 1), 0.0)
    p1 = (cv - 1) / max(total - 1, 1)
    grid = lambda p: np.where(p > 0, np.clip(np.round(-np.log2(np.maximum(p, 1e-18)) * 2), 0, 118) + 1, 0).astype(np.int64)
    cell = (bucket(np.maximum(cu - 1, 0)) * 128 + grid(p2)) * 128 + grid(p1)
    kinds, back = np.unique(cell, return_inverse=True)
    events = (c if events is None else events).astype(float)
    sums = [np.bincount(back, weights=x, minlength=len(kinds)) for x in (events, events * p2, events * p1)]
    return pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, sums)], ["cell", "w", "p2", "p1"])


LEARNED = f"key long, c long, {CELLS}"


def cells_of(vocabulary, total: int, parts: int, hot: int):
    """Of each part: the cells of all its bigram types (key is null), and its hot bigrams (cell is null)."""

    def solve(part: int, held: list[tuple]) -> pa.RecordBatch:
        counts, keys = [], []
        for a, b, n in held:
            counts.append(np.frombuffer(b, f"u{len(b) // n}").astype(np.int64))
            keys.append(unpacked(a, n, part, parts))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, c = keys[order], counts[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, c = turned_back(keys[head]), np.add.reduceat(c, head)
        cells = _cells(c, *vocabulary.value.of(keys), total)
        often = c >= hot
        n, m = cells.num_rows, int(often.sum())
        columns = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x[often].view(np.int64))]) for x in (keys, c)]
        columns += [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in cells.columns]
        return pa.RecordBatch.from_arrays(columns, ["key", "c", *cells.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, *rest in zip(*(batch.column(k).to_pylist() for k in ("part", "a", "b", "n")), strict=True):
                if part != now and held:
                    yield solve(now, held)
                    held = []
                now = part
                held.append(rest)
        if held:
            yield solve(now, held)

    return run


def learn(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """BUCKETS x 3 mixture weights by expectation-maximisation over the cells; where there are no events, an even mix."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    for b, own in cells.groupby(cells["cell"] // (128 * 128)):
        w = own["w"].to_numpy()
        p = np.stack([own["p2"] / w, own["p1"] / w, np.full(len(own), uniform)], 1)
        mixed = weights[int(b)]
        for _ in range(rounds):
            share = p * mixed
            share *= (w / share.sum(1))[:, None]
            mixed = (share.sum(0) + 0.1) / (w.sum() + 0.3)
        weights[int(b)] = mixed
    weights[0, 0] = 0.0
    weights[0] /= weights[0].sum()
    return weights


def log_probability(c: np.ndarray, cu: np.ndarray, cv: np.ndarray, total: int, size: int, weights: np.ndarray) -> np.ndarray:
    l2, l1, l0 = weights[bucket(cu)].T
    return np.log10(l2 * c / np.maximum(cu, 1) + l1 * cv / max(total, 1) + l0 / (size + 1))


def _rows(kind: int, part, block, a, b, c) -> pa.RecordBatch:
    n = len(part)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(part, pa.int64()), pa.array(block, pa.int64()), *(pa.array(x, pa.binary()) for x in (a, b, c))],
        ["kind", "part", "block", "a", "b", "c"],
    )


def ship(vocabulary, hot_keys, hot_logs, total: int, parts: int):
    """Rows of kind 0: the documents of a block; of kind 1: its bigrams that belong to a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot, logs = vocabulary.value, hot_keys.value, hot_logs.value
        number = TaskContext.get().partitionId() << 32
        known = np.append(words.counts, 0)
        for block in blocks(batches):
            toks, begins = tokens(block)
            numbers, keys = words.pairs(toks, begins)
            doc = np.repeat(np.arange(block.n), np.diff(begins))
            c = known[numbers]
            sums = lambda x: np.bincount(doc, weights=x, minlength=block.n)  # noqa: E731, B023
            base = sums(np.log10((c + 1) / (total + words.size + 1)))
            keys = turned(keys)
            at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
            is_hot = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
            ready = sums(np.where(is_hot, logs[at], 0.0)) if len(hot) else np.zeros(block.n)
            ids = block.rows.column("doc_id")
            stats = np.stack([np.diff(begins), sums(c > 0), base, ready]).astype(np.float64)
            marks = np.stack([_flags(block), np.array(ids.is_null().to_pylist(), bool)]).astype(np.uint8)
            yield _rows(0, [number % parts], [number], [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], [stats.tobytes()], [marks.tobytes()])
            keys, doc = keys[~is_hot], doc[~is_hot]
            order = np.argsort(keys)
            keys, doc = keys[order], doc[order].astype(np.uint16)
            part, runs, packed = parted(keys, parts)
            flags = marks[0].tobytes()
            yield _rows(1, part, np.full(len(runs), number), packed, [doc[i:j].tobytes() for i, j in runs], [flags] * len(runs))
            number += 1

    return run


def answer(vocabulary, weights: np.ndarray, total: int, parts: int):
    """Counts and scores the bigrams of each part; rows of kind 2: a block's documents and their sums. Kind 0 passes."""

    def solve(part: int, held: list[tuple]) -> pa.RecordBatch:
        words = vocabulary.value
        keys, owner, train, where = [], [], [], []
        for k, (block, a, b, c) in enumerate(held):
            doc = np.frombuffer(b, np.uint16)
            keys.append(unpacked(a, len(doc), part, parts))
            owner.append(doc.astype(np.int64) + (k << 16))
            train.append(np.frombuffer(c, np.uint8)[doc])
            where.append(block)
        keys, owner, train = map(np.concatenate, (keys, owner, train))
        order = np.argsort(keys, kind="stable")
        keys, owner, train = keys[order], owner[order], train[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        c = np.add.reduceat(train, head, dtype=np.int64)
        logs = np.repeat(log_probability(c, *words.of(turned_back(keys[head])), total, words.size, weights), np.diff(np.r_[head, len(keys)]))
        order = np.argsort(owner, kind="stable")
        owner, logs = owner[order], logs[order]
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sums, owner = np.add.reduceat(logs, head).astype(np.float32), owner[head]
        which = owner >> 16
        cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        runs = list(zip(cut, np.r_[cut[1:], len(which)], strict=True))
        docs = (owner & 0xFFFF).astype(np.uint16)
        return _rows(2, [part] * len(runs), [where[which[i]] for i, _ in runs], [docs[i:j].tobytes() for i, j in runs], [sums[i:j].tobytes() for i, j in runs], [None] * len(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == 0).any():
                yield batch.filter(pa.array(kinds == 0))
            for part, *rest in zip(*(batch.filter(pa.array(kinds == 1)).column(k).to_pylist() for k in ("part", "block", "a", "b", "c")), strict=True):
                if part != now and held:
                    yield solve(now, held)
                    held = []
                now = part
                held.append(rest)
        if held:
            yield solve(now, held)

    return run


def gather(total: int):
    """Adds up the sums of each block's documents."""

    def finish(base: tuple, sums: list[tuple]) -> pa.RecordBatch:
        ids, marks = np.frombuffer(base[0], np.int64), np.frombuffer(base[2], np.uint8).reshape(2, -1)
        n, known, first, score = np.frombuffer(base[1], np.float64).reshape(4, -1)
        score = score.copy()
        for docs, logs in sums:
            score[np.frombuffer(docs, np.uint16)] += np.frombuffer(logs, np.float32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=marks[1] == 1), pa.array(marks[0] == 0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), total)), pa.array(first), pa.array(score)],
            [x.split()[0] for x in RESULT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, sums = None, None, []
        for batch in batches:
            for block, kind, *rest in zip(*(batch.column(k).to_pylist() for k in ("block", "kind", "a", "b", "c")), strict=True):
                if block != now and base:
                    yield finish(base, sums)
                    base, sums = None, []
                now = block
                if kind == 0:
                    base = rest
                else:
                    sums.append(rest[:2])
        if base:
            yield finish(base, sums)

    return run


def lm_scores(docs: DataFrame, held_out: Column, part_rows: int = 1_500_000, max_vocab: int = 8_000_000) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where held_out is false. Tokens: words (runs of characters other than 0x20 and
    0x09-0x0D, A-Z lower-cased) and one end; a null or empty text is one end. n_known: tokens seen in
    training. base_score: add-one unigram log10 probability. score: the model's. Repeated rows count
    each. Without training rows every estimate but the uniform one is 0. Empty input: no rows. Only
    doc_id and text (and what held_out reads) are read. Words are told apart by 64-bit hashes, and
    above max_vocab pairs of words too.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(~held_out, F.lit(True)).alias("train"))
    vocab = staged(rows.select("text", "train").where("train").mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary", free=True)
    size, total = vocab.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    if size > max_vocab:
        unstage(vocab)
        return _by_parts(rows, size, total, part_rows)
    table = vocab.toArrow()
    order = np.argsort(hashed := table.column("h").to_numpy().view(np.uint64))
    counts = table.column("c").to_numpy()[order]
    vocabulary = spark.sparkContext.broadcast(Vocabulary(hashed[order], counts.astype(np.uint32) if total < 1 << 32 else counts))
    hot = max(part_rows, math.ceil(total / HOT_SHARE))
    parts = max(1, math.ceil(total / part_rows))
    counted = rows.where("train").select("text", "train").mapInArrow(count_pairs(vocabulary, parts), COUNTS)
    learned = staged(counted.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(cells_of(vocabulary, total, parts, hot)), LEARNED), "learned", free=True)
    cells = learned.where("cell IS NOT NULL").groupBy("cell").agg(*(F.sum(x).alias(x) for x in ("w", "p2", "p1"))).toPandas()
    weights = learn(cells, 1 / (size + 1))
    hots = learned.where("key IS NOT NULL").select("key", "c").toPandas()
    keys = hots["key"].to_numpy(np.int64).view(np.uint64)
    logs = log_probability(hots["c"].to_numpy(np.int64), *vocabulary.value.of(keys), total, size, weights) if len(hots) else np.zeros(0)
    order = np.argsort(turned(keys))
    hot_keys, hot_logs = (spark.sparkContext.broadcast(x[order]) for x in (turned(keys), logs))
    shipped = rows.mapInArrow(ship(vocabulary, hot_keys, hot_logs, total, parts), ROWS)
    answered = shipped.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(answer(vocabulary, weights, total, parts)), ROWS)
    return answered.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(gather(total)), RESULT)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, without the upper ones that are 0 in all of them."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def opened(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(packed) // n] = np.frombuffer(packed, np.uint8).reshape(-1, n).T
    return out.view(np.uint64)[:, 0]


def _low(part: int, parts: int) -> np.uint64:
    """The smallest 64-bit key of a part."""
    return np.uint64(-(-(part << 32) // parts) << 32)


def cut(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """Of sorted distinct 64-bit keys: each part, its run as packed differences, their counts and how many they are."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for i, j in zip(heads, np.r_[heads[1:], len(keys)], strict=True):
        yield int(part[i]), squeezed(np.diff(keys[i:j], prepend=_low(int(part[i]), parts))), squeezed(counts[i:j]), int(j - i)


BLOCKS = "block long, tokens long, words long, ids binary, marks binary, begins binary, kinds binary, places binary"
RUNS = "block long, part long, a binary, b binary, n long"
ANSWERS = "block long, part long, a binary, n long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of documents as a row: its distinct words, and the place of each token among them."""
    number = TaskContext.get().partitionId() << 32
    for block in blocks(batches):
        toks, begins = tokens(block)
        kinds, places = np.unique(toks, return_inverse=True)
        ids = block.rows.column("doc_id")
        marks = np.stack([_flags(block), np.array(ids.is_null().to_pylist(), bool)]).astype(np.uint8)
        packed = (ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), marks.tobytes(), begins.astype(np.int64).tobytes(), squeezed(np.diff(kinds, prepend=np.uint64(0))), squeezed(places))
        yield _table([(number, len(toks), len(kinds), *packed)], BLOCKS)
        number += 1


class Tokens:
    """A row of BLOCKS, unpacked: pairs are its distinct bigrams' keys, in order; of each, u and v are the places of its
    words and events how often it occurs in training documents; bigram is the place of each token's."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.train, self.null = np.frombuffer(row["marks"], np.uint8).reshape(2, -1).astype(bool)
        begins = np.frombuffer(row["begins"], np.int64)
        self.kinds = np.cumsum(opened(row["kinds"], row["words"]), dtype=np.uint64)
        self.places = opened(row["places"], row["tokens"]).astype(np.int64)
        self.lengths = np.diff(begins)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        u = contexts(self.places, begins, np.searchsorted(self.kinds, END))
        self.pairs, at, self.bigram = np.unique(mix(mix(self.kinds[u]) + self.kinds[self.places]), return_index=True, return_inverse=True)
        self.u, self.v = u[at], self.places[at]
        learned = self.train[self.doc]
        self.events = np.bincount(self.bigram[learned], minlength=len(self.pairs))
        self.word_events = np.bincount(self.places[learned], minlength=len(self.kinds))


def ask(word_parts: int, pair_parts: int):
    """The distinct words and bigrams of each block that belong to a part, and how often they occur in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = Tokens(row)
                rows = [(row["block"], *x) for x in cut(own.kinds, own.word_events, word_parts)]
                rows += [(row["block"], word_parts + part, *x) for part, *x in cut(own.pairs, own.events, pair_parts)]
                yield _table(rows, RUNS)

    return run


def tell(word_parts: int, pair_parts: int):
    """The counts over all blocks of each run's words or bigrams, in the run's order."""

    def solve(part: int, held: list[tuple]) -> pa.RecordBatch:
        low = _low(part, word_parts) if part < word_parts else _low(part - word_parts, pair_parts)
        keys = np.concatenate([np.cumsum(opened(a, n), dtype=np.uint64) for _, a, _, n in held]) + low
        counts = np.concatenate([opened(b, n) for _, _, b, n in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        is_head = np.r_[True, keys[1:] != keys[:-1]]
        del keys
        sums = np.add.reduceat(counts[order], np.flatnonzero(is_head))
        counts[order] = sums[np.cumsum(is_head) - 1]
        ends = np.cumsum([n for *_, n in held])
        return _table([(block, part, squeezed(counts[end - n : end]), n) for (block, _, _, n), end in zip(held, ends, strict=True)], ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, *rest in zip(*(batch.column(k).to_pylist() for k in ("part", "block", "a", "b", "n")), strict=True):
                if part != now and held:
                    yield solve(now, held)
                    held = []
                now = part
                held.append(rest)
        if held:
            yield solve(now, held)

    return run


def told(batches: Iterator[pa.RecordBatch], word_parts: int) -> Iterator[tuple]:
    """Each block (Tokens), the counts of its words and of its bigrams, and of their first and second words."""

    def finish(row: dict, found: list[tuple]):
        own = Tokens(row)
        words, c = (np.concatenate([opened(a, n) for part, a, n in found if (part < word_parts) == first]).astype(np.int64) for first in (True, False))
        return own, words, c, words[own.u], words[own.v]

    base, found = None, []
    for batch in batches:
        for i, (part, a, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("part", "a", "n")), strict=True)):
            if part >= 0:
                found.append((part, a, n))
                continue
            if base:
                yield finish(base, found)
            base, found = batch.slice(i, 1).to_pylist()[0], []
    if base:
        yield finish(base, found)


def _by_parts(rows: DataFrame, size: int, total: int, part_rows: int) -> DataFrame:
    """The same model for any vocabulary. Blocks send their distinct words and bigrams to the parts of the hashes they
    belong to and get the counts back, once to learn the weights and once to score."""
    stored = staged(rows.mapInArrow(tokenised, BLOCKS), "tokens", compression="zstd", **{"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4})
    n_tokens, n_words = stored.agg(F.sum("tokens"), F.sum("words")).first()
    word_parts, pair_parts = (max(1, math.ceil((n or 0) / (2 * part_rows))) for n in (n_words, n_tokens))
    asked = stored.mapInArrow(tidy(ask(word_parts, pair_parts)), RUNS)
    answers = staged(asked.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(tell(word_parts, pair_parts)), ANSWERS), "counts", free=True, compression="zstd")
    both = stored.withColumn("part", F.lit(-1).cast("long")).unionByName(answers, allowMissingColumns=True)
    both = both.repartition("block").sortWithinPartitions("block", "part")

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, c, cu, cv in told(batches, word_parts):
            seen = own.events > 0
            yield _cells(c[seen], cu[seen], cv[seen], total, own.events[seen])

    cells = both.mapInArrow(tidy(events), CELLS).groupBy("cell").agg(*(F.sum(x).alias(x) for x in ("w", "p2", "p1")))
    weights = learn(staged(cells, "cells", free=True).toPandas(), 1 / (size + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, words, c, cu, cv in told(batches, word_parts):
            sums = lambda x: np.bincount(own.doc, weights=x, minlength=len(own.ids))  # noqa: E731, B023
            cw = words[own.places]
            base = sums(np.log10((cw + 1) / (total + size + 1)))
            logs = sums(log_probability(c, cu, cv, total, size, weights)[own.bigram])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.ids, mask=own.null), pa.array(~own.train), pa.array(own.lengths), pa.array(sums(cw > 0).astype(np.int64)), pa.array(np.full(len(own.ids), total)), pa.array(base), pa.array(logs)],
                [x.split()[0] for x in RESULT.split(", ")],
            )

    return both.mapInArrow(tidy(score), RESULT)


def op3_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
