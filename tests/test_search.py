from __future__ import annotations

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.engine import SearchEngine
from quire.functions import vectors as V
from quire.functions.text import match_expression
from quire.operators import ann, fulltext, hashes, rank
from quire.operators.index import VectorIndex


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def score(spark, v, d, t):
    return one(spark, rank.fusion_score(F.lit(v).cast("double"), F.lit(d).cast("int"), F.lit(t).cast("double")))


def test_fusion(spark):
    assert score(spark, 0.9, 5, None) > score(spark, 0.5, 5, None)
    assert score(spark, 0.7, 0, None) > score(spark, 0.7, 32, None)
    assert score(spark, 0.85, None, 1.0) > score(spark, 0.88, None, None)
    assert abs(score(spark, None, None, 1.0) - 0.2) < 1e-9
    assert score(spark, 1.0, 0, 1.0) <= 1.0
    assert score(spark, None, 60, None) > score(spark, None, None, None) == 0.0


def test_aggregate_and_missing_signals(spark):
    sims = spark.createDataFrame([(1, 7, x) for x in (0.6, 0.8, 0.7)], "query_id long, page_id long, sim double")
    dists = spark.createDataFrame([(1, 7, x) for x in (20, 8, 15)] + [(1, 9, 3)], "query_id long, page_id long, distance int")
    texts = spark.createDataFrame([(1, 11, 0.0)], "query_id long, page_id long, text_score double")
    got = {r.page_id: (r.vector_sim, r.phash_dist, r.text_score) for r in rank.merge_channels(sims, dists, texts).collect()}
    assert got == {7: (0.8, 8, None), 9: (None, 3, None), 11: (None, None, 0.0)}


def test_merge_matches(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.2), (0, 2, 0.4)], "query_id long, region_id long, distance double")
    assert {(r.region_id, r.distance) for r in ann.merge_matches(rows).collect()} == {(1, 0.2), (2, 0.4)}


def test_match_expression(spark):
    assert one(spark, match_expression(F.lit('VUK1457-115T 金田 ab "x" 峨眉钰泉'))) == '"VUK1457-115T" OR "峨眉钰泉" OR """x"""'
    assert one(spark, match_expression(F.lit("ab x"))) is None
    assert one(spark, match_expression(F.lit(""))) is None
    assert one(spark, match_expression(F.lit("金田茶叶\u3000abc"))) == '"金田茶叶" OR "abc"'


def test_normalized(spark):
    rows = spark.createDataFrame([(0, 1, -7.0), (0, 2, -3.0), (0, 3, -1.0), (1, 9, -2.5)], "query_id long, page_id long, r double")
    got = {r.page_id: r.text_score for r in fulltext.normalized(rows).collect()}
    assert got[1] == 1 and got[3] == 0 and 0 < got[2] < 1 and got[9] == 1


def test_hash_scan(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, -1)], "region_id long, phash long")
    asked = spark.createDataFrame([(0, 0)], "query_id long, phash long")
    for found in (hashes.scan(asked, rows, 4), hashes.banded(asked, rows, 4)):
        assert {(r.region_id, r.distance) for r in found.collect()} == {(1, 0), (2, 1), (3, 2 + 1)}


def test_banded_equals_scan(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40, dtype=np.int64)
    near = [int(b) ^ (1 << int(k)) if k < 63 else int(b) for b in base for k in rng.integers(0, 63, 5)]
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate([*map(int, base), *near])], "region_id long, phash long")
    asked = rows.limit(50).select(F.col("region_id").alias("query_id"), "phash")
    for most in (0, 1, 12, 63):
        key = lambda df: sorted(map(tuple, df.collect()))
        want = key(hashes.scan(asked, rows, most))
        assert want == key(hashes.blocked(asked, rows, most)) and (most > 16 or want == key(hashes.banded(asked, rows, most)))


def test_many_hashes(spark, monkeypatch):
    """More queries than are broadcast: bands for few bits, blocks for more, in several blocks."""
    monkeypatch.setattr(hashes, "QUERY_BLOCK", 7)
    monkeypatch.setattr(hashes, "PRODUCTS", 50)
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 60, dtype=np.int64)]
    values += [v ^ (1 << int(k)) for v in values for k in rng.integers(0, 60, 2)]
    rows = spark.createDataFrame([*enumerate(values), (1000, None)], "region_id long, phash long")
    asked = rows.selectExpr("region_id as query_id", "phash").where("query_id < 40 or query_id = 1000")
    u = np.array(values, np.int64).view(np.uint64)
    for most in (3, 30):
        want = {(i, j) for i in range(40) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= most)}
        monkeypatch.setattr(hashes, "SCAN_QUERIES", 10)
        assert {(r.query_id, r.region_id) for r in hashes.within(asked, rows, most).collect()} == want


def test_l2_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([float("inf"), 2.0],)], "v array<float>")
    got = [r.n for r in rows.select(V.l2_normalize(F.col("v")).alias("n")).collect()]
    assert np.allclose(got[0], np.array([0.6, 0.8]) * (1 - 1e-4)) and got[1] == [0, 0] and got[2] == [0, 0] and got[3] == [0, 0]


def test_blob_codec(spark):
    values = [0.25, -1.5, 3e-7, 0.0, float(np.finfo(np.float32).max)]
    rows = spark.createDataFrame([(values,)], "v array<float>")
    back = rows.select(V.blob_to_vector(V.vector_to_blob("v")).alias("v")).first().v
    assert back == [float(np.float32(x)) for x in values]
    stray = spark.createDataFrame([(np.array([1, 2], "<f4").tobytes() + b"x",)], "b binary")
    assert stray.select(V.blob_to_vector("b").alias("v")).first().v == [1.0, 2.0]


def plain_hash(pixels):
    """The double-gradient hash with loops."""
    def kernel(x):
        return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2

    def row(values, n=5):
        out, ratio = [], len(values) / n
        for k in range(n):
            w = [kernel((i + 0.5 - (k + 0.5) * ratio) / max(ratio, 1)) for i in range(len(values))]
            out.append(sum(a * b for a, b in zip(w, values)) / sum(w))
        return out

    half = [row(list(map(float, r))) for r in pixels]
    small = [[min(max(round(x), 0), 255) for x in r] for r in zip(*[row(list(c)) for c in zip(*half)])]
    bits = [a < b for r in small for a, b in zip(r, r[1:])] + [a < b for c in zip(*small) for a, b in zip(c, c[1:])]
    return sum(1 << i for i, b in enumerate(bits) if b)


def test_phash(spark):
    ramp = np.tile(np.arange(64, dtype=np.uint8), (48, 1))
    rows = spark.createDataFrame([(ramp.tobytes(), 64, 48), (ramp[:, ::-1].tobytes(), 64, 48), (bytes([9]) * 64 * 48, 64, 48)], "g binary, w int, h int")
    a, b, c = (r.p for r in rows.select(V.phash("g", "w", "h").alias("p")).collect())
    assert one(spark, V.hamming(F.lit(a), F.lit(b))) == 20 and c == 0 and one(spark, V.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    rng = np.random.default_rng(1)
    for h, w in ((5, 5), (20, 31), (3, 64), (100, 7)):
        image = rng.integers(0, 256, (h, w))
        assert V.gradient_hash(image.astype(float)) == plain_hash(image)


def test_pixel_codecs(spark):
    from quire.functions import geometry as G

    rows = spark.createDataFrame([(b"\x01\x02\x03\x04\x05\x06\x07\x08", bytes(range(12)), 2, 2), (None, b"abc", 2, 2), (b"", None, 1, 1)], "p binary, rgb binary, w int, h int")
    got = rows.select(G.rgba("p").alias("p"), G.tensor("rgb", "w", "h").alias("t")).collect()
    assert [r.p for r in got] == [b"\x03\x02\x01\x04\x07\x06\x05\x08", None, b""]
    want = (np.arange(12).reshape(2, 2, 3) / 255 - [0.485, 0.456, 0.406]) / [0.229, 0.224, 0.225]
    assert np.allclose(got[0].t, want.transpose(2, 0, 1).reshape(-1), atol=1e-6) and got[1].t is None and got[2].t is None


def test_knn_blocks_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(900, None), (901, [float("nan")] * 8)], "region_id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in range(8)], "query_id long, vector array<double>")
    fine = rows.where("region_id < 900")
    key = lambda df: sorted((r.query_id, r.region_id, r["rank"]) for r in df.collect())
    assert key(ann.knn(asked, rows, 7)) == key(ann.knn_plain(asked, fine, 7))
    assert ann.knn(asked.limit(0), rows, 7).count() == 0


def test_similarity_floor_has_no_cap(spark, monkeypatch, tmp_path):
    from quire.plans.catalog import QUERIES

    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    monkeypatch.setattr(ann, "PRODUCTS", 500)
    rng = np.random.default_rng(4)
    data = np.r_[np.eye(64)[0] + rng.normal(0, 0.05, (700, 64)), rng.normal(size=(100, 64))]
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(data)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = np.array(data, np.float32).astype(float)
    products = vectors[[0, 37, 250]] @ vectors.T
    got = {(r.query_id, r.region_id) for r in QUERIES["p1_similarity_floor"](spark, str(tmp_path)).collect()}
    assert got == set(map(tuple, np.argwhere(products >= 0.3))) and len(got) > 3 * 500
    assert QUERIES["f5_similarity"](spark, str(tmp_path)).count() == 3 * 800
    asked = rows.limit(0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert ann.at_least(asked, rows.select(F.col("vec_id").alias("region_id"), F.col("embedding").alias("vector"))).count() == 0


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_index_recall(spark, tmp_path, table):
    rows = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select(F.col("vec_id").alias("region_id"), F.col("embedding").alias("vector"))
    asked = rows.where("region_id % 50 = 0").select(F.col("region_id").alias("query_id"), "vector")
    exact = {(r.query_id, r.region_id) for r in ann.knn(asked, rows, 10).collect()}
    index = VectorIndex.build(spark, f"file://{tmp_path}/index", rows)
    found = {(r.query_id, r.region_id) for r in index.search(asked, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9 and index.probes < len(index.centroids)


def test_index_lives(spark, tmp_path):
    """Added vectors are found, removed ones are not, a new session sees both, a broken index begins anew."""
    base, rng = f"file://{tmp_path}/index", np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    frame = lambda ids: spark.createDataFrame([(int(i), [float(x) for x in data[i]]) for i in ids], "region_id long, vector array<double>")
    asked = frame(range(0, 300, 7)).withColumnRenamed("region_id", "query_id")
    index = VectorIndex.open(spark, base)
    assert index.search(asked, 3).count() == 0 and tuple(index.stats().first()) == (0, 0, 0)
    index.add(frame(range(200)).unionByName(spark.createDataFrame([(900, [float("nan")] * 8), (901, None)], "region_id long, vector array<double>")))
    index.add(frame(range(200, 300)))
    index.remove(frame(range(0, 300, 5)))
    key = lambda df: sorted((r.query_id, r["rank"], r.region_id) for r in df.collect())
    left = frame([i for i in range(300) if i % 5])
    for at in (index, VectorIndex.open(spark, base)):
        assert tuple(at.stats().first()) == (300, 60, 240)
        assert key(at.search(asked, 4, probes=len(at.centroids))) == key(ann.knn(asked, left, 4))
    index.compact()
    assert tuple(VectorIndex.open(spark, base).stats().first()) == (240, 0, 240)
    assert not index.rebuild_if_needed(frame(range(300))) and index.rebuild_if_needed(frame(range(300)).unionByName(frame(range(300)).withColumn("region_id", F.col("region_id") + 1000)))
    index.shelf.drop("tombstones")
    assert VectorIndex.open(spark, base).stats().first().tombstones == 0
    for place in (tmp_path / "index" / "vectors").iterdir():
        for part in place.glob("*.parquet"):
            part.write_bytes(b"broken")
    again = VectorIndex.open(spark, base)
    assert tuple(again.stats().first()) == (0, 0, 0) and not (tmp_path / "index" / "vectors").exists()
    assert again.rebuild_if_needed(frame(range(300)))
    assert key(again.search(asked, 4, probes=len(again.centroids))) == key(ann.knn(asked, frame(range(300)), 4))


def test_bm25_like_fts5(spark, sf):
    pages = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='trigram')")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(r.page_id + 1, r.text) for r in pages.collect()])
    want = dict(db.execute("SELECT rowid - 1, bm25(f) FROM f WHERE f MATCH ?", ('"thnt" OR "ering"',)).fetchall())
    asked = spark.createDataFrame([(0, "thnt ering")], "query_id long, text string")
    for index in (None, fulltext.postings(pages)):
        got = {r.page_id: r.r for r in fulltext.bm25(pages, asked, index).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_phrases_with_odd_characters(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "金田茶叶精品包装 VUK1457-115T"), (2, "aaaaaa"), (3, "x\\Ey.*z"), (4, None), (5, "")], "page_id long, text string")
    wanted = spark.createDataFrame([(p,) for p in ("UK1457", "茶叶精品", "不存在的词组", "aaa", "\\Ey.*", "ab")], "phrase string")
    got = {(r.phrase, r.page_id, r.tf) for r in fulltext.matches(pages, wanted).collect()}
    assert got == {("UK1457", 1, 1), ("茶叶精品", 1, 1), ("aaa", 2, 4), ("\\Ey.*", 3, 1)}
    assert got == {(r.phrase, r.page_id, r.tf) for r in fulltext.matches(pages, wanted, fulltext.postings(pages.where("text is not null"))).collect()}
    only = fulltext.postings(pages.where("text is not null"), fulltext.trigrams_of(wanted))
    assert got == {(r.phrase, r.page_id, r.tf) for r in fulltext.matches(pages, wanted, only).collect()}
    made = sorted(map(tuple, only.collect()))
    monkeypatch.setattr(fulltext, "FEW_TRIGRAMS", 1)
    assert made == sorted(map(tuple, fulltext.postings(pages.where("text is not null"), fulltext.trigrams_of(wanted)).collect()))
    monkeypatch.setattr(fulltext, "FEW_PHRASES", 2)
    assert got == {(r.phrase, r.page_id, r.tf) for r in fulltext.matches(pages, wanted).collect()}


def test_engine(spark, sf, tmp_path):
    from quire.plans.views import Views

    v = Views(spark, sf)
    engine = SearchEngine(v.files, v.page_t, v.regions, v.page_ocr)
    queries = v.query_vec.join(v.query_text, "query_id", "full_outer")
    found = engine.search(queries, 5)
    index = VectorIndex.build(spark, f"file://{tmp_path}/index", v.vectors)
    index.probes = len(index.centroids)
    assert sorted(map(tuple, SearchEngine(v.files, v.page_t, v.regions, v.page_ocr, index=index).search(queries, 5).drop("score", "similarity").collect())) == sorted(map(tuple, found.drop("score", "similarity").collect()))
    top = {r.query_id: r for r in found.where("rank = 1").collect()}
    assert top[0].similarity > 0.99 and top[0].phash_distance == 0 and top[0].page_id == 0
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5
    assert engine.status().first().total_files == v.files.count()
    truth = spark.createDataFrame([(0, 0, 0.1), (1, 3, 0.4), (2, 25, 0.9)], "query_id long, expected_page_id long, area_ratio double")
    overall = engine.evaluate(queries, truth).where("bucket = 'overall'").first()
    assert overall.n == 3 and 0 < overall.r10 <= 1 and overall.mrr <= 1
