from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import store
from quire.operators.store import Snapshots
from quire.sources.upload import accepted, encoded, header_size, probed, query_size, stub_encoder
from quire.streaming import settle as S
from quire.streaming import watch as W


def replay(samples, **kw):
    state, out = S.Pending(), None
    for size, mtime in samples:
        state, out = S.settle_step(state, size, mtime, **kw)
        if state is None:
            break
    return out


def test_settle_step():
    assert replay([(2000, 1), (2000, 1)]) == "ready"
    assert replay([(2000, 1)]) is None
    assert replay([(2000, 1), (3000, 1), (3000, 2), (3000, 2)]) == "ready"
    assert replay([(10, 1)] * 19) is None and replay([(10, 1)] * 20) == "dropped"
    assert replay([(2000 + i, 1) for i in range(30)]) == "dropped"
    assert replay([(2000, 1), (None, None)]) == "vanished"


def test_stream_equals_batch(spark, sf, tmp_path):
    from quire.plans.views import Views

    rows = Views(spark, sf).settle_samples.select("path", "seq", F.greatest("size", F.lit(2048)).alias("size"), "mtime")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    query = S.settle(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    first = spark.sql("SELECT path, min(seq) AS seq FROM settled WHERE outcome = 'ready' GROUP BY path")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, S.first_stable(rows).collect())) and first.count() > 0


def test_settle_drops(spark):
    """The batch form against the state machine, one sample after another, with drops and vanished files."""
    rng = random.Random(3)
    rows = [(f"p{p}", i, None if rng.random() < 0.05 else rng.choice((10, 2000, 3000)), rng.choice((1, 1, 2))) for p in range(60) for i in range(40)]
    rows = [(p, i, s, None if s is None else m) for p, i, s, m in rows]
    for retries in (3, 20):
        want = {}
        for path in {r[0] for r in rows}:
            state = None
            for _, seq, size, mtime in (r for r in rows if r[0] == path):
                state, outcome = S.settle_step(state or S.Pending(), size, mtime, retries=retries)
                if outcome == "ready":
                    want[path] = seq
                    break
        got = dict(map(tuple, S.first_stable(spark.createDataFrame(rows, "path string, seq long, size long, mtime long"), retries=retries).collect()))
        assert got == want and len(want) > 20


def test_settle_of_many_frames(spark, tmp_path):
    """A path whose samples of one batch come in several Arrow frames, out of order."""
    rows = [("a", i, 2000 + i if i != 700 else 2699, 1) for i in range(1500)]
    random.Random(0).shuffle(rows)
    spark.createDataFrame(rows, "path string, seq long, size long, mtime long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, seq long, size long, mtime long").parquet(f"{tmp_path}/in")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        query = S.settle(stream, retries=1 << 30).writeStream.format("memory").queryName("framed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert [tuple(r) for r in spark.sql("SELECT outcome, seq FROM framed").collect()] == [("ready", 700)]


def test_settle_tick_is_the_state_machine(spark):
    rng = random.Random(1)
    pending = [(f"p{i}", rng.choice((-1, 10, 2000)), rng.choice((-1, 1)), rng.randrange(20)) for i in range(300)]
    listing = {p: (rng.choice((10, 2000)), rng.choice((1, 2))) for p, *_ in pending if rng.random() < 0.9}
    got = W.settle_tick(spark.createDataFrame(pending, W.PENDING), spark.createDataFrame([(p, *x) for p, x in listing.items()], W.LISTING)).collect()
    for r, (p, size, mtime, attempts) in zip(sorted(got, key=lambda r: int(r.path[1:])), pending, strict=True):
        state, outcome = S.settle_step(S.Pending(size, mtime, attempts), *listing.get(p, (None, None)))
        assert r.path == p and r.outcome == outcome
        if state:
            assert (r["size"], r.mtime, r.attempts) == (state.size, state.mtime, state.attempts)


def test_watcher(spark, tmp_path):
    """Files that grow, settle, repeat known bytes, can't be read at first, and vanish; state survives a new watcher."""
    shelf, disk, known, seen, unreadable = Snapshots(spark, f"file://{tmp_path}/watch"), {}, {}, [], {"c"}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)

    def hashed(paths):
        return frame([(r.path, None if r.path in unreadable else disk[r.path][2]) for r in paths.collect()], "path string, content_sha1 string")

    def note(kind):
        def act(paths):
            own = sorted(r.path for r in paths.collect())
            seen.append((kind, *own))
            for p in own:
                known.pop(p, None) if kind == "delete" else known.update({p: disk[p][2]})
        return act

    def tick():
        watcher = W.Watcher(
            shelf, lambda: frame([(p, s, m) for p, (s, m, _) in disk.items()], W.LISTING), hashed,
            lambda: frame([(p, h, 5) for p, h in known.items()], "path string, content_sha1 string, indexed_at long"), note("delete"), note("refresh"), note("index"),
        )
        seen.clear()
        watcher.tick()
        return list(seen)

    disk |= {"a": (2000, 1, "x"), "b": (2000, 1, "y"), "c": (2000, 1, "z"), "small": (10, 1, "s")}
    assert tick() == []
    disk["b"] = (2500, 1, "y")
    assert tick() == [("index", "a")]
    unreadable.clear()
    assert tick() == [("index", "b")]
    assert tick() == [("index", "c")]
    disk["a"] = (2000, 9, "x")
    del disk["b"]
    assert tick() == [("delete", "b")]
    assert tick() == [("refresh", "a")]
    del disk["a"], disk["small"]
    disk["b"] = (3000, 2, "new")
    assert tick() == [("delete", "a", "small")]
    assert tick() == [("index", "b")] and tick() == [] and set(known) == {"b", "c"}


def test_due():
    assert S.due([], 10, 5) and not S.due([3], 10, 35) and S.due([3], 10, 40)


def test_event_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "modify"), ("a", 2, "delete"), ("b", 3, "modify"), ("c", 4, "delete"), ("c", 5, "modify")], "path string, seq long, event string")
    rows.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = S.run_events(stream, lambda df: seen.append(("delete", sorted(r.path for r in df.collect()))), lambda df: seen.append(("modify", sorted(r.path for r in df.collect()))), f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    # a delete stands, whatever follows it, and cancels what was before it
    assert seen == [("delete", ["a", "c"]), ("modify", ["b", "c"])]


def test_backfill(spark):
    files = spark.createDataFrame([(1, "p1", 0, 5), (2, "p2", 1, 5), (3, "p3", 0, None)], "id long, path string, is_excluded int, indexed_at long")
    pages = spark.createDataFrame([(i, 1 + i % 3, 1) for i in range(30)], "id long, file_id long, page_num long")
    ocr = spark.createDataFrame([(0, "old", 1)], store.PAGE_OCR)
    calls = []

    def recognize(claimed):
        calls.append(claimed.count())
        return claimed.where("page_id <> 3").select("page_id", F.lit("new").alias("text"))

    got = {r.page_id: r.text for r in S.backfill_ocr(pages, files, ocr, recognize, 9, batch=4).collect()}
    assert len(got) == 30 and got[0] == "old" and got[3] == "" and got[6] == "new" and got[1] == got[2] == "" and calls == [4, 4, 1]


def test_uploads(spark):
    rows = spark.createDataFrame([(1, "image/png", b"x", 100, 100, "7"), (2, "text/html", b"x", 1, 1, None), (3, None, b"x", 10000, 10000, "z"), (4, "", b"x", 3840, 2160, "")], "id long, content_type string, body binary, width int, height int, top_k string")
    got = {r.id: (r.problem, r.top_k) for r in accepted(rows).collect()}
    assert got == {1: (None, 7), 2: ("content type", 20), 3: ("too many pixels", 20), 4: (None, 20)}
    assert rows.where("id = 4").select(query_size(F.col("width"), F.col("height")).alias("s")).first().s == (1600, 900)
    assert rows.where("id = 1").select(probed("body").alias("s")).first().s.width is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04AB\xff\xc0\x00\x11\x08\x01\x02\x03\x04"
    headers = {b"GIF89a\x05\x00\x07\x00": (5, 7), jpeg: (0x304, 0x102), b"BM" + bytes(16) + b"\x09\x00\x00\x00\xfd\xff\xff\xff": (9, 3), b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + b"\x04\0\0\x02\0\0": (5, 3), b"": None, b"\x89PNG\r\n\x1a\n": None, b"\xff\xd8\xff": None}
    assert {k: header_size(k) for k in headers} == headers
    heads = stub_encoder([b"h" * 5000 + b"a", b"h" * 5000 + b"b", b"h" * 5000 + b"a"])
    assert (heads[0] == heads[2]).all() and not (heads[0] == heads[1]).all()
    vectors = encoded(rows, "id", "body").collect()
    assert len(vectors) == 4 and len(vectors[0].vector) == 64


def test_rescan(spark, tmp_path):
    import time

    calls = []
    query = S.start_rescan(spark, lambda: calls.append(1), f"{tmp_path}/cp", seconds=1)
    until = time.time() + 30
    while len(calls) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert len(calls) >= 2
