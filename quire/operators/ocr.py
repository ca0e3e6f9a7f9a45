"""What follows text detection and recognition: boxes, reading order, decoding, line filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quire.functions.geometry import unclipped
from quire.runtime import staged


def component_boxes(pixels: DataFrame) -> DataFrame:
    """label, x0, y0, x1, y1 (inclusive), n, mean_prob of pixels (label, x, y, prob)."""
    return pixels.groupBy("label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"), F.avg("prob").alias("mean_prob"))


def text_boxes(boxes: DataFrame, w: int, h: int, least: int = 3, threshold: float = 0.5) -> DataFrame:
    """label and the grown box, of components that are large and sure enough."""
    fit = (F.col("x1") - F.col("x0") + 1 >= least) & (F.col("y1") - F.col("y0") + 1 >= least) & (F.col("mean_prob") >= threshold)
    return boxes.where(fit).select("label", unclipped(F.col("x0"), F.col("y0"), F.col("x1") + 1, F.col("y1") + 1, w, h).alias("b")).select("label", "b.*")


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts of a mask that was grown by one pixel, in the order of their last pixels."""
    grown = _grown(mask.astype(bool))
    starts, ends, last = _runs(grown)
    labels = np.zeros(mask.shape, np.int64)
    labels[grown] = np.repeat(np.unique(last, return_inverse=True)[1] + 1, ends - starts)
    return labels


def _grown(mask: np.ndarray) -> np.ndarray:
    wide = mask.copy()
    wide[:, 1:] |= mask[:, :-1]
    wide[:, :-1] |= mask[:, 1:]
    grown = wide.copy()
    grown[1:] |= wide[:-1]
    grown[:-1] |= wide[1:]
    return grown


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of a mask's rows start and end (in rows longer by one blank pixel), and the last run of each one's 8-connected part.

    Runs are linked with those they touch in the row before. Roots are hung to higher ones until no link is left between
    roots: two rounds at least halve the roots of a part, so the work is nearly linear, however long or wound a part is.
    """
    rows, cols = mask.shape
    flat = np.zeros(rows * (cols + 1) + 1, bool)
    flat[1:].reshape(rows, cols + 1)[:, :cols] = mask
    starts, ends = np.flatnonzero(flat[1:] != flat[:-1]).reshape(-1, 2).T
    low, high = np.searchsorted(ends + cols + 1, starts, "left"), np.searchsorted(starts + cols + 1, ends, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(starts)), n)
    b = np.arange(len(a)) + np.repeat(low - (np.cumsum(n) - n), n)
    root = np.arange(len(starts))
    while len(a):
        np.maximum.at(root, np.minimum(a, b), np.maximum(a, b))
        while not np.array_equal(root, above := root[root]):
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return starts, ends, root


#: Pixels of images that are counted in one go; a larger image is one of its own.
PIXELS_AT_ONCE = 1 << 22


@F.pandas_udf(T.LongType())
def count_components(grey: pd.Series, width: pd.Series, threshold: pd.Series) -> pd.Series:
    """How many connected parts the bright pixels of grey images (a byte a pixel; a last row that isn't full is left) have.
    Images of one width are laid below each other, with a blank row after each."""
    counts = np.zeros(len(grey), np.int64)
    images, widths, thresholds = grey.tolist(), width.tolist(), threshold.tolist()

    def count(some: list[int], w: int) -> None:
        gaps = np.cumsum([len(images[i]) // w + 1 for i in some]) - 1
        mask, top = np.zeros((gaps[-1] + 1, w), bool), 0
        for i, gap in zip(some, gaps, strict=True):
            mask[top:gap] = np.frombuffer(images[i], np.uint8, (gap - top) * w).reshape(-1, w) > thresholds[i]
            top = gap + 1
        grown = _grown(mask)
        grown[gaps] = False
        starts, _, last = _runs(grown)
        kept = starts[last == np.arange(len(last))] // (w + 1)
        counts[some] = np.bincount(np.searchsorted(gaps, kept), minlength=len(some))

    some, pixels = [], 0
    for i in sorted(range(len(images)), key=widths.__getitem__):
        if some and (widths[i] != widths[some[0]] or pixels + len(images[i]) > PIXELS_AT_ONCE):
            count(some, widths[some[0]])
            some, pixels = [], 0
        some.append(i)
        pixels += len(images[i])
    if some:
        count(some, widths[some[0]])
    return pd.Series(counts)


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (page_id, x, y, w, h) with ord from 0: bands from top to bottom, each from left to right.

    A band ends where a box's middle is farther from the band's first one than half of the band's
    greatest height so far. Boxes of one middle are in one band, as heights only let it reach farther: so the
    fold is over a page's distinct middles, as they stream by, and boxes are numbered band by band. No task
    holds a page. boxes are read twice; what made them should be staged if it is dear.
    """
    order = ("x", "mid", "y", "w", "h")
    mid = (F.col("y") + F.floor(F.col("h") / 2)).cast("long").alias("mid")
    longs = boxes.select("page_id", mid, *(F.col(n).cast("long").alias(n) for n in ("x", "y", "w", "h")))
    middles = longs.groupBy("page_id", "mid").agg(F.max("h").alias("h"), F.count("*").alias("n"))
    sorted_middles = middles.repartition("page_id").sortWithinPartitions("page_id", "mid").select(F.col("page_id").alias("_page"), F.col("mid").alias("_mid"), "h", "n")
    made = T.StructType([sorted_middles.schema["_page"], *(T.StructField(n, T.LongType()) for n in ("_mid", "band", "before"))])
    told = longs.join(sorted_middles.mapInArrow(_bands, made), F.col("page_id").eqNullSafe(F.col("_page")) & F.col("mid").eqNullSafe(F.col("_mid")))
    place = F.col("before") + F.row_number().over(W.partitionBy("page_id", "band").orderBy(*order)) - 1
    return told.select("page_id", *(F.col(c).cast(boxes.schema[c].dataType).alias(c) for c in ("x", "y", "w", "h")), place.cast("long").alias("ord"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_page, _mid, band and the boxes before that band, of sorted middles (_page, _mid, h: the greatest height, n: boxes)."""
    page, seen = None, 0
    for batch in batches:
        bands, befores = [], []
        for page_id, mid, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not seen or page_id != page:
                page, seen, band, before, first, tallest = page_id, 0, 0, 0, None, 1
            elif first is not None and abs(mid - first) > max(tallest // 2, 1):
                band, before, first, tallest = band + 1, seen, mid, 1
            first = mid if first is None else first
            tallest = tallest if h is None else max(tallest, h)
            seen += n
            bands.append(band)
            befores.append(before)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.int64()), pa.array(befores, pa.int64())], ["_page", "_mid", "band", "before"])


#: Classes of a vocabulary that may be broadcast.
MOST_CLASSES = 200_000


def ctc_decode(steps: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """line_id, text, score of steps (line_id, t, cls, prob): the best class of each step (the last among equals),
    blanks (0) and repeats of the step before dropped; score is the mean probability of what is left, 0 for none."""
    best = steps.groupBy("line_id", "t").agg(F.max(F.struct("prob", "cls")).alias("b")).select("line_id", "t", "b.*")
    before = F.lag("cls").over(W.partitionBy("line_id").orderBy("t"))
    emitted = best.withColumn("_before", before).withColumn("_out", (F.col("cls") != 0) & ~F.col("cls").eqNullSafe(F.col("_before")))
    few = vocabulary.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES
    spelled = emitted.join(F.broadcast(vocabulary) if few else vocabulary, "cls", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("_out"), F.struct("t", F.coalesce("ch", F.lit("")).alias("ch")))))
    return spelled.groupBy("line_id").agg(F.array_join(F.transform(parts, lambda x: x["ch"]), "").alias("text"), F.coalesce(F.avg(F.when(F.col("_out"), F.col("prob"))), F.lit(0.0)).alias("score"))


def readable_lines(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    return lines.where((F.col("score") >= threshold) & F.col("text").rlike(r"(?U)\S"))


def page_text(lines: DataFrame) -> DataFrame:
    """page_id, text: readable lines (page_id, ord, text, score) in order, a line each."""
    kept = readable_lines(lines).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return kept.select("page_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("text"))


LINES = "page_id long, ord long, text string, score double"


def detected(probabilities: np.ndarray, w: int, h: int, threshold: float = 0.3, sure: float = 0.5, least: int = 3, ratio: float = 1.6) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1; the last two exclusive) of text in a map of probabilities, scaled to a page of w x h."""
    labels = label_components(probabilities > threshold)
    out, (rows, cols) = [], probabilities.shape
    for k in range(1, int(labels.max()) + 1 if labels.size else 1):
        y, x = np.nonzero(labels == k)
        bw, bh = x.max() - x.min() + 1, y.max() - y.min() + 1
        if bw < least or bh < least or probabilities[y, x].mean() < sure:
            continue
        grow = int(np.ceil(bw * bh * ratio / (2 * (bw + bh))))
        x0, y0, x1, y1 = max(x.min() - grow, 0), max(y.min() - grow, 0), min(x.max() + 1 + grow, cols), min(y.max() + 1 + grow, rows)
        out.append((int(x0 * w // cols), int(y0 * h // rows), int(-(-x1 * w // cols)), int(-(-y1 * h // rows))))
    return out


def read_pages(images: DataFrame, detect: Callable[[np.ndarray], np.ndarray], recognize: Callable[[list[np.ndarray]], list[np.ndarray]], vocabulary: DataFrame, batch: int = 8) -> DataFrame:
    """page_id, text of images (page_id, grey: a byte a pixel, width, height): detection, boxes in reading order, lines
    recognised in batches, decoded, filtered and joined.

    detect: pixels to a map of probabilities of text. recognize: crops to arrays of steps x classes. Both are
    parameters; no model is part of this library.
    """

    def boxes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page_id, grey, w, h in frame[["page_id", "grey", "width", "height"]].itertuples(index=False):
                pixels = np.frombuffer(grey or b"", np.uint8)
                if w and h and len(pixels) == w * h:
                    rows += [(page_id, x0, y0, x1 - x0, y1 - y0) for x0, y0, x1, y1 in detected(detect(pixels.reshape(h, w)), w, h)]
            yield pd.DataFrame(rows, columns=["page_id", "x", "y", "w", "h"])

    def steps_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for page_id, grey, w, h, boxes in frame[["page_id", "grey", "width", "height", "boxes"]].itertuples(index=False):
                pixels, rows = np.frombuffer(grey, np.uint8).reshape(h, w), []
                for i in range(0, len(boxes), batch):
                    part = boxes[i : i + batch]
                    for b, made in zip(part, recognize([pixels[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]] for b in part]), strict=True):
                        best = made.shape[1] - 1 - made[:, ::-1].argmax(1)
                        rows += [(page_id, b["ord"], t, int(c), float(made[t, c])) for t, c in enumerate(best)]
                yield pd.DataFrame(rows, columns=["page_id", "ord", "t", "cls", "prob"])

    found = reading_order(staged(images.mapInPandas(boxes_of, "page_id long, x long, y long, w long, h long"), "boxes"))
    boxes = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "w", "h"))).alias("boxes"))
    steps = images.join(boxes, "page_id").mapInPandas(steps_of, "page_id long, ord long, t long, cls int, prob double")
    lines = ctc_decode(steps.withColumn("line_id", F.struct("page_id", "ord")), vocabulary).select("line_id.*", "text", "score")
    return images.select("page_id").join(page_text(lines), "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))
