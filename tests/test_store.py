from __future__ import annotations

import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.config import Settings, load
from quire.functions.common import nearest_rank, numbered
from quire.operators import evaluate, indexer, ingest, ocr, store
from quire.operators.index import VectorIndex
from quire.sources.pages import stub_renderer
from quire.sources.upload import stub_encoder

TYPES = {"pages": "array<struct<page_num:bigint,width_px:bigint,height_px:bigint,thumb_path:string,regions:array<struct<kind:string,idx:bigint,bbox:struct<x:float,y:float,w:float,h:float>,phash:bigint,vector:array<float>>>>>"}


def test_round_trip(spark, tmp_path):
    incoming = spark.createDataFrame([("X:/a/logo.pdf", "logo.pdf", "pdf", 123, 1000)], "path string, filename string, file_type string, file_size long, modified_at long")
    files = store.upsert_files(spark.createDataFrame([], store.FILES), incoming, 5)
    assert [(r.id, r.is_excluded, r.crash_attempts) for r in files.collect()] == [(1, 0, 0)]
    regions = [("full", 0, (0.0, 0.0, 1.0, 1.0), -0x2152411F7FFFFFFF, [0.5] * 8), ("tile", 3, (0.25, 0.0, 0.5, 0.5), 42, [-0.5] * 8)]
    payload = spark.createDataFrame([(1, [(1, 640, 480, "1_1.webp", regions)])], f"file_id long, pages {TYPES['pages']}")
    pages, made = store.insert_pages(payload, 0, 0)
    assert [(r.id, r.page_id, r.kind, r.phash) for r in made.orderBy("id").collect()] == [(1, 1, "full", -0x2152411F7FFFFFFF), (2, 1, "tile", 42)]
    shelf = store.Snapshots(spark, f"file://{tmp_path}/store")
    shelf.commit(files=files, pages=pages, regions=made, page_ocr=spark.createDataFrame([(1, "text", 3)], store.PAGE_OCR))
    left = store.cascade_delete(incoming.select("path"), *(shelf.read(t) for t in ("files", "pages", "regions", "page_ocr")))
    assert {k: v.count() for k, v in left.items()} == {"files": 0, "pages": 0, "regions": 0, "page_ocr": 0, "removed_regions": 2}
    before = shelf.current()
    shelf.commit(files=left["files"])
    assert shelf.read("files").count() == 0 and shelf.read("pages").count() == 1 and shelf.current()["pages"] == before["pages"]


def test_upsert_resets_only_newer(spark):
    base = {"filename": "f", "file_type": "pdf", "file_size": 1, "page_count": 0, "indexed_at": 9, "created_at": 1, "content_sha1": "h"}
    rows = [dict(base, id=i, path=f"p{i}", modified_at=m, is_excluded=1, crash_attempts=2, exclusion_reason="r") for i, m in ((1, 10), (2, 10), (3, None))]
    files = spark.createDataFrame(rows, store.FILES)
    new = spark.createDataFrame([("p1", "f", "pdf", 2, 11), ("p2", "f", "pdf", 2, 10), ("p3", "f", "pdf", 2, 99), ("a", "f", "ai", 2, None)], "path string, filename string, file_type string, file_size long, modified_at long")
    got = {r.path: r for r in store.upsert_files(files, new, 5).collect()}
    assert (got["p1"].crash_attempts, got["p1"].is_excluded, got["p1"].exclusion_reason) == (0, 0, None)
    assert (got["p2"].crash_attempts, got["p2"].is_excluded, got["p2"].exclusion_reason) == (2, 1, "r")
    assert (got["p3"].crash_attempts, got["p3"].modified_at, got["p3"].indexed_at, got["p3"].content_sha1) == (2, 99, 9, "h")
    assert got["a"].id == 4


def test_decisions(spark):
    f = lambda path, mod, idx, exc, crash, sha: dict(id=1, path=path, filename="", file_type="pdf", file_size=1, modified_at=mod, page_count=0, is_excluded=exc, indexed_at=idx, created_at=0, crash_attempts=crash, exclusion_reason=None, content_sha1=sha)
    files = spark.createDataFrame([f("crash", 1, 5, 0, 2, "s"), f("black", 1, 5, 1, 3, "s"), f("fresh", 1, 50, 0, 0, "s"), f("out", 20, 5, 1, 0, "s"), f("same", 1, 5, 0, 1, "s"), f("same_unindexed", 1, None, 0, 0, "s"), f("other", 1, 5, 0, 0, "t")], store.FILES)
    scan = spark.createDataFrame([(p, 20, "s") for p in ("crash", "black", "fresh", "out", "same", "same_unindexed", "other", "new")], "path string, modified_at long, content_sha1 string")
    got = {r.path: r.action for r in ingest.change_decisions(scan, files).collect()}
    assert got == {"crash": "skip_and_exclude", "black": "skip_blacklisted", "fresh": "up_to_date", "out": "skip_excluded", "same": "refresh", "same_unindexed": "reindex", "other": "reindex", "new": "index_new"}


def test_scan(spark, tmp_path):
    for p in ("a.pdf", "x/b.AI", "x/y/c.Pdf", "x/y/z/d.pdf", "x/e.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"123")
    names = lambda depth: {r.filename for r in ingest.scan_directories(spark, [str(tmp_path), str(tmp_path / "missing")], depth).collect()}
    assert names(3) == {"a.pdf", "b.AI", "c.Pdf"} and names(1) == {"a.pdf"} and names(0) == set()
    row = ingest.scan_directories(spark, [str(tmp_path)], 1, content=True).first()
    assert (row.file_type, row.file_size, row.content_sha1) == ("pdf", 3, "40bd001563085fc35165329ea1ff5c5ecbdbbeef")


def test_ctc_and_lines(spark):
    steps = [(1, t, c, 1.0) for t, c in enumerate([1, 1, 0, 1, 2, 2, 0, 3])] + [(2, t, 0, 1.0) for t in range(3)]
    vocab = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "cls int, ch string")
    got = {r.line_id: (r.text, r.score) for r in ocr.ctc_decode(spark.createDataFrame(steps, "line_id long, t int, cls int, prob double"), vocab).collect()}
    assert got == {1: ("AABC", 1.0), 2: ("", 0.0)}
    lines = spark.createDataFrame([(1, 1, "b", 0.9), (1, 0, "a", 0.5), (1, 2, "  ", 0.9), (1, 3, "c", 0.4)], "page_id long, ord int, text string, score double")
    assert ocr.page_text(lines).first().text == "a\nb"


def test_read_pages(spark):
    """Two rows of dark marks: found, put in order, read by a recogniser that tells a crop's grey value."""
    page = np.zeros((40, 80), np.uint8)
    for grey, (y, x) in {200: (5, 45), 220: (6, 10), 240: (25, 30)}.items():
        page[y : y + 8, x : x + 20] = grey
    rows = spark.createDataFrame([(1, page.tobytes(), 80, 40), (2, bytes(200), 20, 10), (3, None, 0, 0)], "page_id long, grey binary, width int, height int")
    names = {200: 1, 220: 2, 240: 3}

    def recognize(crops):
        return [np.eye(4)[[0, names[int(c.max())], 0, 1]] for c in crops]

    vocab = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "cls int, ch string")
    got = {r.page_id: r.text for r in ocr.read_pages(rows, lambda p: (p > 100) * 0.9, recognize, vocab, batch=2).collect()}
    assert got == {1: "BA\nAA\nCA", 2: "", 3: ""}


def test_component_counts(spark):
    rng = np.random.default_rng(2)
    images = [(rng.random((h, w)) < 0.08).astype(np.uint8) * 255 for h, w in ((9, 13), (30, 17), (1, 5))]

    def plain(mask):
        h, w = mask.shape
        grown = {(i, j) for y, x in np.argwhere(mask) for i in range(max(y - 1, 0), min(y + 2, h)) for j in range(max(x - 1, 0), min(x + 2, w))}
        n = 0
        while grown:
            n, stack = n + 1, [grown.pop()]
            while stack:
                y, x = stack.pop()
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & grown
                grown -= near
                stack += near
        return n

    rows = spark.createDataFrame([(i.tobytes(), i.shape[1]) for i in images], "g binary, w int")
    assert [r.n for r in rows.select(ocr.count_components("g", "w", F.lit(110)).alias("n")).collect()] == [plain(i > 0) for i in images]


def test_index_folder(spark, tmp_path):
    """A folder's life: new, changed, unchanged, excluded, broken and vanished files, in batches, with the vector index."""
    docs = tmp_path / "docs"
    (docs / "x").mkdir(parents=True)
    linked = b"<?xpacket begin='x'?><egExtFL:files><rdf:li>file:///b.pdf</rdf:li></egExtFL:files><?xpacket end='w'?>"
    for name, body in {"a.pdf": bytes(range(256)) * 8, "x/b.AI": b"second file " * 99, "x/c.pdf": linked, "d.pdf": b"broken", "e.txt": b"no"}.items():
        (docs / name).write_bytes(body)

    def render(content):
        if content == b"broken":
            raise ValueError
        return stub_renderer(content)

    shelf, index = store.Snapshots(spark, f"file://{tmp_path}/store"), VectorIndex.open(spark, f"file://{tmp_path}/index")
    run = lambda now: indexer.index_folder(spark, shelf, [str(docs)], now, render, stub_encoder, index, batch=2)
    now = int(time.time()) + 100
    assert run(now) == {"index_new": 4, "vanished": 0, "indexed": 2, "excluded": 1, "failed": 1}
    files = {r.filename: r for r in shelf.read("files").collect()}
    assert files["c.pdf"].is_excluded == 1 and files["c.pdf"].exclusion_reason == indexer.REASON and files["d.pdf"].crash_attempts == 1 and files["d.pdf"].indexed_at is None
    assert files["a.pdf"].page_count == 1 and files["a.pdf"].content_sha1 and files["a.pdf"].indexed_at == now
    assert shelf.read("pages").count() == 2 and shelf.read("regions").count() == 20 and tuple(index.stats().first())[2] == 20
    told = run(now + 1)
    assert told["up_to_date"] == 2 and told["skip_excluded"] == 1 and told["reindex"] == 1 and told["failed"] == 1
    assert run(now + 2)["skip_and_exclude"] == 1 and run(now + 3)["skip_blacklisted"] == 1
    (docs / "a.pdf").write_bytes(b"changed bytes " * 300)
    os.utime(docs / "a.pdf", (now + 500, now + 500))
    os.utime(docs / "x/b.AI", (now + 500, now + 500))
    (docs / "x/c.pdf").unlink()
    told = run(now + 600)
    assert (told["reindex"], told["refresh"], told["vanished"], told["indexed"]) == (1, 1, 1, 1)
    regions = {r.id for r in shelf.read("regions").collect()}
    assert len(regions) == 20 and len({r.page_id for r in shelf.read("regions").collect()}) == 2 and tuple(index.stats().first())[2] == 20
    asked = shelf.read("regions").select(F.col("id").alias("query_id"), "vector")
    best = index.search(asked, 1, probes=len(index.centroids))
    assert {r.region_id for r in best.collect()} <= regions


def test_snapshots_are_atomic(spark, tmp_path):
    """A pointer is there before and after each commit; one that was never moved into place doesn't count."""
    shelf = store.Snapshots(spark, f"file://{tmp_path}/store")
    assert shelf.current() == {} and shelf.read("t", "x long").count() == 0
    for n in range(4):
        shelf.commit(t=spark.range(n))
    shelf.commit(append=True, t=spark.range(10))
    assert shelf.read("t").count() == 13
    pointers = tmp_path / "store" / "pointers"
    assert len([p for p in pointers.iterdir() if p.name.isdigit()]) == 3
    (pointers / "_next-crashed").write_text("{")
    assert store.Snapshots(spark, f"file://{tmp_path}/store").read("t").count() == 13
    max(p for p in pointers.iterdir() if p.name.isdigit()).unlink()
    assert shelf.read("t").count() == 3


def test_reading_order(spark):
    boxes = spark.createDataFrame([(1, x, y, 50, 20) for x, y in ((300, 0), (200, 8), (100, 16), (0, 200))], "page_id long, x int, y int, w int, h int")
    got = [(r.x, r.y) for r in ocr.reading_order(boxes).orderBy("ord").collect()]
    assert got == [(200, 8), (300, 0), (100, 16), (0, 200)]


def test_reading_order_of_large_pages(spark):
    """The bands of a plain fold, for pages in many batches, equal boxes and nulls; a page is gathered in no list."""
    rng = np.random.default_rng(5)
    rows = [(int(p), int(x), int(y), 50, int(h)) for p, x, y, h in zip(rng.integers(0, 3, 3000), rng.integers(0, 40, 3000), rng.integers(0, 900, 3000) * 3, rng.integers(-2, 25, 3000), strict=True)]
    rows += [(0, 7, 30, 50, 19)] * 5 + [(0, 4, None, 50, 90), (1, 5, 60, 50, None), (1, None, 60, 50, 30), (None, 1, 2, 3, 4), (None, 1, 500, 3, 4), (4, 1, None, 1, 1)]
    want, low = [], lambda key: tuple((v is not None, v or 0) for v in key)
    for page in {r[0] for r in rows}:
        boxes = [(None if None in (y, h) else y + h // 2, x, y, w, h) for p, x, y, w, h in rows if p == page]
        band, first, tallest, told = 0, None, 1, []
        for mid, x, y, w, h in sorted(boxes, key=low):
            if first is not None and abs(mid - first) > max(tallest // 2, 1):
                band, first, tallest = band + 1, mid, 1
            first, tallest = mid if first is None else first, max(tallest, h or 0)
            told.append((band, x, mid, y, w, h))
        want += [(page, x, y, w, h, i) for i, (_, x, _, y, w, h) in enumerate(sorted(told, key=low))]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 100)
    try:
        got = ocr.reading_order(spark.createDataFrame(rows, "page_id long, x int, y int, w int, h int"))
        assert sorted(map(tuple, got.collect()), key=low) == sorted(want, key=low)
    finally:
        spark.conf.set(size, before)
    assert got.dtypes == [("page_id", "bigint"), ("x", "int"), ("y", "int"), ("w", "int"), ("h", "int"), ("ord", "bigint")]
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_components():
    import numpy as np

    mask = np.zeros((8, 12), bool)
    mask[1, 1] = mask[1, 4] = mask[6, 9] = True
    labels = ocr.label_components(mask)
    assert labels.max() == 2 and labels[1, 1] == labels[1, 4] != labels[6, 9] and labels[0, 11] == 0


def test_components_of_wound_masks(monkeypatch):
    """Labels and counts of plain flooding, ordered by a part's last pixel; a wound or long part takes few rounds over all pixels."""

    def flooded(mask):
        h, w = mask.shape
        grown = {(i, j) for y, x in np.argwhere(mask).tolist() for i in range(max(y - 1, 0), min(y + 2, h)) for j in range(max(x - 1, 0), min(x + 2, w))}
        labels, kinds = np.zeros(mask.shape, int), []
        while grown:
            part, stack = [], [grown.pop()]
            while stack:
                y, x = stack.pop()
                part.append((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & grown
                grown -= near
                stack += near
            kinds.append(part)
        for k, part in enumerate(sorted(kinds, key=max), 1):
            labels[tuple(np.array(part).T)] = k
        return labels

    rng, wound = np.random.default_rng(3), np.zeros((400, 32), bool)
    wound[::4] = True
    wound[np.arange(0, 400, 4)[:, None] + np.arange(4), np.tile([[0], [31]], (50, 1))] = True
    masks = [rng.random((h, w)) < p for h, w in ((40, 32), (1, 9), (9, 1), (25, 40), (0, 5)) for p in (0.02, 0.06, 0.1, 0.5, 1.0)] + [wound, wound[:, ::-1], wound[::-1]]
    for mask in masks:
        assert (ocr.label_components(mask) == flooded(mask)).all()
    for at_once in (1, 2000, ocr.PIXELS_AT_ONCE):
        monkeypatch.setattr(ocr, "PIXELS_AT_ONCE", at_once)
        grey = pd.Series([(m * np.uint8(200)).tobytes() + b"\xff" * (m.shape[1] - 1) for m in masks])
        got = ocr.count_components.func(grey, pd.Series([m.shape[1] for m in masks]), pd.Series([110] * len(masks)))
        assert got.tolist() == [int(flooded(m).max(initial=0)) for m in masks]
    rounds = []
    for name in ("array_equal", "max"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **k: rounds.append(1) or f(*a, **k))
    ocr.label_components(wound)
    assert len(rounds) < 100


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", x) for x in (10, 20, 30, 40, 100)], "k string, v long")
    r = nearest_rank(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    rng = np.random.default_rng(0)
    more = [(None if i % 7 == 0 else i % 3, float(rng.integers(0, 400)) if i % 11 else None) for i in range(4000)]
    got = {r.k: r for r in nearest_rank(spark.createDataFrame(more, "k int, v double").repartition(5), ["k"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for k in (None, 0, 1, 2):
        own = sorted(v for key, v in more if key == k and v is not None)
        assert [got[k][n] for n in ("p05", "p50", "p95", "p100")] == [own[int((len(own) - 1) * p + 0.5)] for p in (0.05, 0.5, 0.95, 1.0)]
    assert (r.p50, r.p95) == (30, 100) and nearest_rank(rows.limit(0), ["k"], "v", {"p": 0.5}).count() == 0


def test_buckets(spark):
    rows = spark.createDataFrame([(0, 0.1, 1), (1, 0.4, None), (2, 0.8, 6)], "query_id long, area_ratio double, rank int")
    got = {r.bucket: r for r in evaluate.quality(rows).collect()}
    assert set(got) == {evaluate.SMALL, evaluate.MEDIUM, evaluate.LARGE, "overall"}
    assert got["overall"].n == 3 and abs(got["overall"].r1 - 1 / 3) < 1e-9 and abs(got["overall"].mrr - (1 + 1 / 6) / 3) < 1e-9 and got[evaluate.MEDIUM].mrr == 0


def test_crops(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit(900).alias("width_px"), F.lit(640).alias("height_px"))
    crops = evaluate.synthetic_crops(pages, 42, 3)
    bad = crops.where("w * width_px < 15.99 or h * height_px < 15.99 or w > 1 or h > 1 or x < 0 or y < 0 or x + w > 1.0001 or y + h > 1.0001 or edge < 320 or edge > 900 or quality < 70 or quality > 90 or abs(brightness) > 25 or area_ratio <= 0 or area_ratio > 1")
    assert crops.count() == 150 and bad.count() == 0
    assert sorted(map(tuple, crops.collect())) == sorted(map(tuple, evaluate.synthetic_crops(pages, 42, 3).collect()))


def test_numbered(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r.n == r.x + 1 for r in numbered(rows, "x").collect()) and numbered(rows.limit(0), "x").count() == 0


def test_settings(tmp_path):
    import pytest

    path = tmp_path / "c.toml"
    path.write_text("[search]\ndefault_top_k = 7\nother = 1\n[scan]\nmax_scan_depth = 90\n")
    s = load(str(path))
    assert s.default_top_k == 7 and s.scan_depth == 32 and load(str(tmp_path / "none")) == Settings() and s.ann_candidates() == 500 and s.ann_candidates(40) == 1000
    with pytest.raises(ValueError):
        Settings(worker_threads=0)
    assert os.path.exists(path)


def test_page_payload(spark):
    from quire.sources.pages import page_payload

    files = spark.createDataFrame([(1, bytes(range(200)) * 20), (2, b""), (3, None)], "file_id long, content binary")
    got = {r.file_id: r for r in page_payload(files).collect()}
    assert {r.status for r in got.values()} == {"ok"} and len(got[1].pages) == 1 and not got[2].pages and not got[3].pages
    regions = got[1].pages[0].regions
    assert [(r.kind, r.idx) for r in regions] == [("full", 0), *(("tile", i) for i in range(9))] and all(len(r.vector) == 64 for r in regions)

    def broken(content):
        raise ValueError

    assert {r.status for r in page_payload(files, broken).collect()} == {"error: ValueError"}
    pages, made = store.insert_pages(page_payload(files).select("file_id", "pages"), 10, 100)
    assert [r.id for r in pages.collect()] == [11] and sorted(r.id for r in made.collect()) == list(range(101, 111))


def test_report(spark, sf):
    import json

    from quire.plans.views import Views

    v = Views(spark, sf)
    made = json.loads(evaluate.report(v.ranked, v.search_log))
    assert {q["bucket"] for q in made["quality"]} == {evaluate.SMALL, evaluate.MEDIUM, evaluate.LARGE, "overall"} and len(made["latency"]) == 5 and made["misses"][0] == 0
