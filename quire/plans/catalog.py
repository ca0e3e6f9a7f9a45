"""The registered queries over the retrieval operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry as G
from quire.functions import text as X
from quire.functions import vectors as V
from quire.functions.common import nearest_rank, numbered
from quire.operators import ann, evaluate, fulltext, hashes, ingest, ocr, rank, store
from quire.operators.index import VectorIndex
from quire.runtime import scratch
from quire.sources.upload import accepted, probed_uploads, type_accepted

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Thresholds with results on the driver's small tables; the defaults of Settings are a second variant.
SIMILARITY, DISTANCE = 0.1, 22
NOW = 1800000000


def query(name: str, sql: str | None = None, *views: str):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql, *views)
        return f

    return add


def r6(column: str, name: str | None = None):
    return F.round(column, 6).alias(name or column)


# Vectors and nearest neighbours


@query("f3_l2_normalize", """SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1], 6) AS first FROM (
    SELECT id, list_transform(vector, lambda x: x::DOUBLE * (1 - 1e-4) / sqrt(list_sum(list_transform(vector, lambda y: y::DOUBLE * y)))) AS v FROM regions)""", "regions")  # fmt: skip
def _(v: Views):
    n = v.regions.select("id", V.l2_normalize(F.col("vector")).alias("v"))
    return n.select("id", F.round(F.sqrt(V.square_sum(F.col("v"))), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("f1_hamming_distance", "SELECT query_id, region_id, distance FROM pairs", "pairs")
def _(v: Views):
    return hashes.scan(v.query_vec, v.hashes, 64)


@query("f5_similarity", "SELECT query_id, region_id, round(least(greatest(product, 0), 1), 6) AS sim FROM pairs", "pairs")
def _(v: Views):
    every = ann.at_least(v.query_vec, v.vectors)
    return every.select("query_id", "region_id", F.round(V.similarity(F.col("product")), 6).alias("sim"))


_KNN = "SELECT query_id, region_id, round(product, 6) AS sim, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product DESC, region_id)::INT AS i FROM pairs {}) WHERE i <= {}"


@query("j10_knn_topk", _KNN.format("", 25), "pairs")
def _(v: Views):
    return ann.knn(v.query_vec, v.vectors, 25).select("query_id", "region_id", r6("product", "sim"), "rank")


@query("j10_knn_nested_loop", _KNN.format("", 25), "pairs")
def _(v: Views):
    return ann.knn_plain(v.query_vec, v.vectors, 25).select("query_id", "region_id", r6("product", "sim"), "rank")


@query("p3_tombstone_filter", _KNN.format("WHERE region_id % 5 <> 2", 10), "pairs")
def _(v: Views):
    gone = v.regions.where("id % 5 = 2").select(F.col("id").alias("region_id"))
    return ann.knn(v.query_vec, v.vectors, 10, gone).select("query_id", "region_id", r6("product", "sim"), "rank")


@query("p1_similarity_floor", "SELECT query_id, region_id, round(product, 6) AS sim FROM pairs WHERE least(greatest(product, 0), 1) >= 0.3", "pairs")
def _(v: Views):
    return ann.at_least(v.query_vec, v.vectors, 0.3).select("query_id", "region_id", r6("product", "sim"))


@query("p4_finite_filter", "SELECT id FROM regions WHERE id % 6 <> 1 AND id % 6 <> 4", "regions")
def _(v: Views):
    broken = F.when(F.col("id") % 6 == 1, F.transform("vector", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).when(F.col("id") % 6 == 4, F.transform("vector", lambda x, i: F.when(i == 5, F.lit(float("-inf"))).otherwise(x)))
    return v.regions.withColumn("vector", F.coalesce(broken, F.col("vector"))).where(V.is_finite(F.col("vector"))).select("id")


@query("a3_merge_min_distance", """SELECT query_id % 2 AS query_id, region_id, round(min(1 - product), 6) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product DESC, region_id) AS i FROM pairs) WHERE i <= 50 GROUP BY ALL""", "pairs")  # fmt: skip
def _(v: Views):
    found = ann.knn(v.query_vec, v.vectors, 50).select((F.col("query_id") % 2).alias("query_id"), "region_id", (1 - F.col("product")).alias("distance"))
    return ann.merge_matches(found).select("query_id", "region_id", r6("distance"))


@query("u2_multi_vector_union", """SELECT region_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product DESC, region_id) AS i FROM pairs) WHERE i <= 50 GROUP BY region_id""", "pairs")
def _(v: Views):
    parts = [ann.knn(v.query_vec.where(F.col("query_id") == q), v.vectors, 50) for q in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("region_id").agg(F.count("*").alias("n"))


@query("j10_inverted_file", _KNN.format("", 10), "pairs")
def _(v: Views):
    # all cells are probed here, so the result is exact
    return VectorIndex.build(v.spark, scratch(v.spark, "index"), v.vectors, cells=16).search(v.query_vec, 10, probes=16).select("query_id", "region_id", r6("product", "sim"), "rank")


@query("j10_index_recall", "SELECT count(*) FILTER (id % 50 = 0) AS queries, true AS recalled, true AS pruned FROM regions", "regions")
def _(v: Views):
    """With its own number of probes, fewer than there are cells, the index finds 0.9 of the 10 nearest or more."""
    index = VectorIndex.build(v.spark, scratch(v.spark, "index"), v.vectors)
    asked = v.vectors.where("region_id % 50 = 0").select(F.col("region_id").alias("query_id"), "vector")
    exact = ann.knn(asked, v.vectors, 10).select("query_id", "region_id", F.lit(1).alias("near"))
    found = index.search(asked, 10).select("query_id", "region_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "region_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.sum("hit") / F.sum("near") >= 0.9).alias("recalled"))
    return both.withColumn("pruned", F.lit(index.probes < len(index.centroids)))


@query("k8_vector_add", "SELECT count(*) AS vectors, sum(id)::BIGINT AS ids FROM (SELECT id FROM regions UNION ALL SELECT id + 1000000 FROM regions)", "regions")
def _(v: Views):
    index = VectorIndex.build(v.spark, scratch(v.spark, "index"), v.vectors)
    index.add(v.vectors.withColumn("region_id", F.col("region_id") + 1000000))
    return index.shelf.read("vectors").agg(F.count("*").alias("vectors"), F.sum("region_id").alias("ids"))


@query("k9_index_remove", _KNN.format("WHERE region_id % 5 <> 2", 10), "pairs")
def _(v: Views):
    index = VectorIndex.build(v.spark, scratch(v.spark, "index"), v.vectors)
    index.remove(v.vectors.where("region_id % 5 = 2"))
    return index.search(v.query_vec, 10, probes=len(index.centroids)).select("query_id", "region_id", r6("product", "sim"), "rank")


@query("k10_saved_index", "SELECT 2 * count(*) AS points, count(*) FILTER (id % 5 = 2) AS tombstones, 2 * count(*) - count(*) FILTER (id % 5 = 2) AS live FROM regions", "regions")
def _(v: Views):
    place = scratch(v.spark, "index")
    index = VectorIndex.build(v.spark, place, v.vectors)
    index.add(v.vectors.withColumn("region_id", F.col("region_id") + 1000000))
    index.remove(v.vectors.where("region_id % 5 = 2"))
    return VectorIndex.open(v.spark, place).stats()


@query("k14_rebuild_index", "SELECT true AS rebuilt, false AS again, count(*) AS points FROM regions", "regions")
def _(v: Views):
    index = VectorIndex.build(v.spark, scratch(v.spark, "index"), v.vectors.where("region_id % 3 = 0"))
    rebuilt, again = index.rebuild_if_needed(v.vectors), index.rebuild_if_needed(v.vectors)
    return index.stats().select(F.lit(rebuilt).alias("rebuilt"), F.lit(again).alias("again"), "points")


@query("u5_tombstones", "SELECT count(*) FILTER (id % 3 = 0 OR id % 5 = 0) AS tombstones, greatest(count(*) - count(*) FILTER (id % 3 = 0 OR id % 5 = 0), 0) AS live FROM regions", "regions")
def _(v: Views):
    gone = v.regions.where("id % 3 = 0").select("id").union(v.regions.where("id % 5 = 0").select("id")).distinct()
    return gone.agg(F.count("*").alias("tombstones")).crossJoin(v.regions.agg(F.count("*").alias("n"))).select("tombstones", ann.live_points(F.col("n"), F.col("tombstones")).alias("live"))


@query("f29_fetch_sizes", "SELECT k, greatest(25 * k, 500) AS search_k, least(greatest(25 * k, 500) + least(t, 2 * greatest(25 * k, 500)), 2800) AS fetch_k, greatest(256, least(greatest(25 * k, 500) + least(t, 2 * greatest(25 * k, 500)), 2800)) AS ef FROM (SELECT l_linenumber * 8 AS k, l_orderkey % 3000 AS t FROM lineitem)")
def _(v: Views):
    rows = v.table("lineitem").select((F.col("l_linenumber") * 8).alias("k"), (F.col("l_orderkey") % 3000).alias("t"))
    return rows.select("k", ann.fetch_sizes(F.col("k"), F.col("t")).alias("s")).select("k", "s.*")


# Hashes

_RANGE = "SELECT query_id, region_id, distance FROM pairs WHERE distance <= {}"


@query("j11_hamming_range", _RANGE.format(DISTANCE), "pairs")
def _(v: Views):
    return hashes.within(v.query_vec, v.hashes, DISTANCE)


@query("j11_hamming_default", _RANGE.format(12), "pairs")
def _(v: Views):
    return hashes.within(v.query_vec, v.hashes, 12)


@query("j11_hamming_banded", _RANGE.format(12), "pairs")
def _(v: Views):
    return hashes.banded(v.query_vec, v.hashes, 12)


@query("j11_hamming_banded_wide", _RANGE.format(DISTANCE), "pairs")
def _(v: Views):
    return hashes.banded(v.query_vec, v.hashes, DISTANCE)


@query("t3_hamming_cap", "SELECT query_id, region_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, region_id) AS i FROM pairs WHERE distance <= 30) WHERE i <= 5", "pairs")
def _(v: Views):
    return hashes.closest(hashes.within(v.query_vec, v.hashes, 30), 5)


@query("s7_phash_scan", "SELECT id AS region_id, phash FROM regions WHERE id % 9 <> 2", "regions")
def _(v: Views):
    return hashes.replaced(v.hashes.withColumn("phash", F.when(F.col("region_id") % 9 != 2, F.col("phash"))))


@query("k11_phash_store", "SELECT id AS region_id, phash FROM regions WHERE id % 4 <> 1 UNION ALL SELECT id + 1000000, phash FROM regions", "regions")
def _(v: Views):
    added = v.hashes.withColumn("region_id", F.col("region_id") + 1000000)
    gone = v.hashes.where("region_id % 4 = 1").select("region_id")
    return hashes.appended(hashes.removed(hashes.replaced(v.hashes), gone), added)


@query("f11_bit_cast", "SELECT id, (phash::HUGEINT + CASE WHEN phash < 0 THEN 18446744073709551616 ELSE 0 END)::VARCHAR AS unsigned FROM regions", "regions")
def _(v: Views):
    return v.regions.select("id", hashes.unsigned(F.col("phash")).cast("string").alias("unsigned"))


# Full text


@query("p9_text_gate", "SELECT query_id, length(trim(text)) >= 4 AS passes FROM query_text", "query_text")
def _(v: Views):
    return v.query_text.select("query_id", X.passes_gate(F.col("text")).alias("passes"))


@query("t5_segments", "SELECT query_id, pos, phrase AS segment FROM phrases", "phrases")
def _(v: Views):
    return fulltext.phrases(v.query_text).withColumnRenamed("phrase", "segment")


@query("t5_document_segments", r"""SELECT doc_id, pos, segment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(segment) DESC, pos) AS i FROM (
    SELECT doc_id, unnest(s) AS segment, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split_regex(text, '\s+') AS s FROM documents)) WHERE length(segment) >= 3) WHERE i <= 16""")
def _(v: Views):
    return v.table("documents").select("doc_id", F.explode(X.segments(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query("f8_match_expr", """SELECT q.query_id, (SELECT string_agg('"' || replace(phrase, '"', '""') || '"', ' OR ' ORDER BY length(phrase) DESC, pos) FROM phrases p WHERE p.query_id = q.query_id) AS expr FROM query_text q""", "phrases")
def _(v: Views):
    return v.query_text.select("query_id", X.match_expression(F.col("text")).alias("expr"))


@query("a18_corpus_stats", "SELECT count(*) AS n_docs, round(avg(greatest(length(text) - 2, 0)), 6) AS avgdl FROM page_ocr", "page_ocr")
def _(v: Views):
    return fulltext.corpus_stats(v.page_ocr).select("n_docs", r6("avgdl"))


@query("a18_phrase_frequency", "SELECT phrase, count(*) AS df_phrase, sum(tf)::BIGINT AS tf FROM found GROUP BY phrase", "found")
def _(v: Views):
    return fulltext.matches(v.page_ocr, fulltext.phrases(v.query_text)).groupBy("phrase").agg(F.count("*").alias("df_phrase"), F.sum("tf").alias("tf"))


@query("j12_phrase_match", "SELECT phrase, page_id, tf, dl FROM found", "found")
def _(v: Views):
    return fulltext.matches(v.page_ocr, fulltext.phrases(v.query_text))


@query("j12_postings_match", "SELECT phrase, page_id, tf, dl FROM found", "found")
def _(v: Views):
    wanted = fulltext.phrases(v.query_text)
    return fulltext.matches(v.page_ocr, wanted, fulltext.postings(v.page_ocr, fulltext.trigrams_of(wanted)))


@query("k7_fts_sync", """SELECT page_id, count(DISTINCT t) AS trigrams FROM (SELECT page_id, substr(lower(text), i::INT, 3) AS t FROM (SELECT *, unnest(generate_series(1, length(text) - 2)) AS i FROM (
    SELECT page_id, CASE WHEN page_id % 40 = 0 THEN 'Changed text ' || page_id ELSE text END AS text FROM page_ocr WHERE page_id % 40 <> 20))) GROUP BY page_id""", "page_ocr")  # fmt: skip
def _(v: Views):
    changed = v.page_ocr.where("page_id % 20 = 0").select("page_id", F.when(F.col("page_id") % 40 == 0, F.concat(F.lit("Changed text "), F.col("page_id").cast("string"))).alias("text"))
    return fulltext.sync_postings(fulltext.postings(v.page_ocr), changed).groupBy("page_id").agg(F.count("*").alias("trigrams"))


@query("f9_bm25", "SELECT query_id, page_id, round(r, 6) AS r FROM bm25", "bm25")
def _(v: Views):
    return fulltext.bm25(v.page_ocr, v.query_text).select("query_id", "page_id", r6("r"))


@query("t4_text_top", "SELECT query_id, page_id, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, page_id) AS i FROM bm25) WHERE i <= 40", "bm25")
def _(v: Views):
    return fulltext.top_pages(fulltext.bm25(v.page_ocr, v.query_text), 40).select("query_id", "page_id", r6("r"))


def _texts(v: Views) -> DataFrame:
    return fulltext.normalized(fulltext.top_pages(fulltext.bm25(v.page_ocr, v.query_text)))


@query("w2_bm25_normalize", "SELECT query_id, page_id, round(text_score, 6) AS text_score FROM texts", "texts")
def _(v: Views):
    return _texts(v).select("query_id", "page_id", r6("text_score"))


# Ranking


def _merged(v: Views, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    regions = v.regions.select(F.col("id").alias("region_id"), "page_id")
    sims, dists = rank.page_hits(ann.knn(v.query_vec, v.vectors, 500), hashes.within(v.query_vec, v.hashes, distance), regions, similarity)
    return rank.merge_channels(sims, dists, _texts(v))


@query("j1_region_hits", "SELECT query_id, region_id, page_id, file_id, page_num FROM dists JOIN page_t ON page_t.id = page_id", "dists", "page_t")
def _(v: Views):
    hits = hashes.within(v.query_vec, v.hashes, DISTANCE)
    pages = v.page_t.select(F.col("id").alias("page_id"), "file_id", "page_num")
    return hits.join(v.regions.select(F.col("id").alias("region_id"), "page_id"), "region_id").join(pages, "page_id").select("query_id", "region_id", "page_id", "file_id", "page_num")


@query("a1_page_similarity", "SELECT query_id, page_id, round(max(sim), 6) AS vector_sim FROM sims GROUP BY ALL", "sims")
def _(v: Views):
    sims, _d = rank.page_hits(ann.knn(v.query_vec, v.vectors, 500), hashes.within(v.query_vec, v.hashes, DISTANCE), v.regions.select(F.col("id").alias("region_id"), "page_id"), SIMILARITY)
    return sims.groupBy("query_id", "page_id").agg(F.round(F.max("sim"), 6).alias("vector_sim"))


@query("a2_page_distance", "SELECT query_id, page_id, min(distance) AS phash_dist FROM dists GROUP BY ALL", "dists")
def _(v: Views):
    hits = hashes.within(v.query_vec, v.hashes, DISTANCE).join(v.regions.select(F.col("id").alias("region_id"), "page_id"), "region_id")
    return hits.groupBy("query_id", "page_id").agg(F.min("distance").alias("phash_dist"))


@query("u1_region_union", "SELECT DISTINCT query_id, region_id FROM (SELECT query_id, region_id FROM sims UNION ALL SELECT query_id, region_id FROM dists)", "sims", "dists")
def _(v: Views):
    near = ann.knn(v.query_vec, v.vectors, 500).where(V.similarity(F.col("product")) >= SIMILARITY).select("query_id", "region_id")
    return near.union(hashes.within(v.query_vec, v.hashes, DISTANCE).select("query_id", "region_id")).distinct()


@query("j7_three_channel_merge", "SELECT query_id, page_id, round(vector_sim, 6) AS vector_sim, phash_dist, round(text_score, 6) AS text_score FROM merged", "merged")
def _(v: Views):
    return _merged(v).select("query_id", "page_id", r6("vector_sim"), "phash_dist", r6("text_score"))


@query("f6_fusion_topk", """SELECT query_id, rank, page_id, round(score, 6) AS score, round(coalesce(vector_sim, 0), 6) AS similarity, phash_dist AS phash_distance FROM top""", "top")
def _(v: Views):
    top = rank.top_k(_merged(v), 20)
    return top.select("query_id", "rank", "page_id", r6("score"), F.round(F.coalesce("vector_sim", F.lit(0.0)), 6).alias("similarity"), F.col("phash_dist").alias("phash_distance"))


@query("p11_result_assembly", """SELECT query_id, rank, page_id, file_id, path, filename, file_type, page_num, file_size, strftime(make_timestamp(modified_at * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS modified_at,
    '/thumbnails/' || thumb_path AS thumbnail_url, round(score, 6) AS score, round(coalesce(vector_sim, 0), 6) AS similarity, phash_dist AS phash_distance, round(text_score, 6) AS text_score
    FROM top JOIN page_t ON page_t.id = page_id JOIN files ON files.id = file_id""", "top", "page_t", "files")  # fmt: skip
def _(v: Views):
    return rank.assemble(rank.top_k(_merged(v), 20), v.page_t, v.files).withColumns({c: F.round(c, 6) for c in ("score", "similarity", "text_score")})


@query("u4_survivor_files", "SELECT DISTINCT file_id FROM top JOIN page_t ON page_t.id = page_id", "top", "page_t")
def _(v: Views):
    return rank.top_k(_merged(v), 20).join(v.page_t.select(F.col("id").alias("page_id"), "file_id"), "page_id").select("file_id").distinct()


@query("w1_truth_rank", "SELECT t.query_id, t.expected_page_id, rank FROM (VALUES (0, 0), (1, 3), (2, 25), (3, 1)) t(query_id, expected_page_id) LEFT JOIN top ON top.query_id = t.query_id AND page_id = t.expected_page_id", "top")
def _(v: Views):
    truth = v.inline([(0, 0), (1, 3), (2, 25), (3, 1)], "query_id long, expected_page_id long")
    return store.truth_rank(rank.top_k(_merged(v), 20), truth).select("query_id", "expected_page_id", "rank")


@query("j14_truth_match", """SELECT query_id, rank, path, page_num FROM (SELECT top.*, path, page_num FROM top JOIN page_t ON page_t.id = page_id JOIN files ON files.id = file_id) r
    WHERE page_num = 1 AND path LIKE '%.pdf'""", "top", "page_t", "files")  # fmt: skip
def _(v: Views):
    truth = v.files.where("path like '%.pdf'").select("path", F.lit(1).cast("long").alias("page_num"))
    return rank.assemble(rank.top_k(_merged(v), 20), v.page_t, v.files).join(truth, ["path", "page_num"]).select("query_id", "rank", "path", "page_num")


# The store


@query("s4_scan_files", "SELECT id, path, modified_at, content_sha1 FROM files", "files")
def _(v: Views):
    return v.files.select("id", "path", "modified_at", "content_sha1")


@query("s5_point_lookup", "SELECT id, path, is_excluded FROM files WHERE path = (SELECT path FROM files WHERE id = 17)", "files")
def _(v: Views):
    path = v.files.where("id = 17").select("path")
    return v.files.join(F.broadcast(path), "path", "left_semi").select("id", "path", "is_excluded")


@query("s6_in_list", "SELECT id, file_id, page_num FROM page_t WHERE id IN (SELECT page_id FROM top)", "top", "page_t")
def _(v: Views):
    return v.page_t.join(rank.top_k(_merged(v), 20).select(F.col("page_id").alias("id")).distinct(), "id", "left_semi").select("id", "file_id", "page_num")


@query("s8_keyset_vectors", "SELECT id AS region_id, round(vector[1]::DOUBLE, 6) AS first FROM regions WHERE id > 120 ORDER BY id LIMIT 40", "regions")
def _(v: Views):
    return v.vectors.where("region_id > 120").orderBy("region_id").limit(40).select("region_id", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("k1_upsert", """, b AS (SELECT files.*, s.path AS sp, s.filename AS fn, s.file_type AS ft, s.file_size AS fs, s.modified_at AS ma, coalesce(s.modified_at > files.modified_at, false) AS newer FROM files LEFT JOIN scan s USING (path))
    SELECT id, path, coalesce(fn, filename) AS filename, coalesce(ft, file_type) AS file_type, coalesce(fs, file_size) AS file_size, coalesce(ma, modified_at) AS modified_at, page_count,
        CASE WHEN newer THEN 0 ELSE is_excluded END AS is_excluded, indexed_at, created_at, CASE WHEN newer THEN 0 ELSE crash_attempts END AS crash_attempts, exclusion_reason, content_sha1 FROM b
    UNION ALL SELECT (SELECT max(id) FROM files) + row_number() OVER (ORDER BY path), path, filename, file_type, file_size, modified_at, 0, 0, NULL, 1800000000, 0, NULL, NULL FROM scan WHERE path NOT IN (SELECT path FROM files)""", "files", "scan")  # fmt: skip
def _(v: Views):
    return store.upsert_files(v.files, v.scan, NOW)


@query("k2_insert_pages", """, p AS (SELECT file_id, id % 4 AS pos, page_num, id FROM page_t),
    n AS (SELECT *, 5000 + row_number() OVER (ORDER BY file_id, pos) AS new_page FROM p),
    r AS (SELECT file_id, pos, new_page, k FROM n, (SELECT unnest(range(3)) AS k))
    SELECT 90000 + row_number() OVER (ORDER BY file_id, pos, k) AS id, new_page AS page_id, CASE WHEN k = 0 THEN 'full' ELSE 'tile' END AS kind, k AS idx, file_id, page_num, 640 AS width_px, 480 AS height_px, thumb_path
    FROM r JOIN (SELECT file_id, pos, page_num FROM n) USING (file_id, pos) JOIN (SELECT id AS pid, file_id, id % 4 AS pos, thumb_path FROM page_t) USING (file_id, pos)""", "page_t")  # fmt: skip
def _(v: Views):
    region = lambda k: F.struct(F.lit("full" if k == 0 else "tile").alias("kind"), F.lit(k).cast("long").alias("idx"))
    page = F.struct("page_num", F.lit(640).alias("width_px"), F.lit(480).alias("height_px"), "thumb_path", F.array(*(region(k) for k in range(3))).alias("regions"))
    payload = v.page_t.groupBy("file_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    pages, regions = store.insert_pages(payload, 5000, 90000)
    return regions.join(pages.withColumnRenamed("id", "page_id"), "page_id")


@query("j15_positional_zip", "SELECT 100 + row_number() OVER (ORDER BY id) AS new_id, id AS region_id, phash FROM regions", "regions")
def _(v: Views):
    return numbered(v.regions.select("id", "phash"), "id", name="new_id").select((F.col("new_id") + 100).alias("new_id"), F.col("id").alias("region_id"), "phash")


@query("k3_upsert_ocr", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'second ' || page_id ELSE text END AS text, CASE WHEN page_id % 3 = 0 THEN 20 ELSE 5 END AS ocr_at FROM page_ocr
    UNION ALL SELECT doc_id, 'second ' || doc_id, 20 FROM documents WHERE doc_id % 3 = 0 AND doc_id % 19 = 5""", "page_ocr")  # fmt: skip
def _(v: Views):
    old = v.page_ocr.withColumn("ocr_at", F.lit(5).cast("long"))
    ids = v.table("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"))
    new = [ids.select("page_id", F.concat(F.lit(f"{word} "), F.col("page_id").cast("string")).alias("text"), F.lit(at).cast("long").alias("ocr_at"), F.lit(seq).alias("seq")) for word, at, seq in (("first", 10, 1), ("second", 20, 2))]
    return store.upsert_ocr(old, new[0].unionByName(new[1]))


_ORPHANS = """SELECT pg.id AS page_id FROM page_t AS pg WHERE NOT EXISTS (SELECT 1 FROM page_ocr AS done WHERE done.page_id = pg.id)
    AND EXISTS (SELECT 1 FROM files AS fl WHERE fl.id = pg.file_id AND (fl.indexed_at IS NULL OR fl.is_excluded = 1))"""
_WAITING = """SELECT pg.id AS page_id, fl.path, pg.page_num FROM files AS fl, page_t AS pg WHERE fl.id = pg.file_id AND fl.indexed_at IS NOT NULL AND fl.is_excluded = 0
    AND NOT EXISTS (SELECT 1 FROM page_ocr AS done WHERE done.page_id = pg.id)"""


@query("k4_orphans", _ORPHANS, "page_t", "files", "page_ocr")
def _(v: Views):
    return store.orphan_pages(v.page_t, v.files, v.page_ocr, NOW).select("page_id")


@query("k5_updates", """SELECT id, CASE WHEN id % 4 = 0 OR is_excluded = 1 THEN 1 ELSE 0 END AS is_excluded, CASE WHEN id % 4 = 0 THEN 'reason' END AS exclusion_reason,
    CASE WHEN id % 7 = 0 THEN 0 WHEN id % 3 = 0 THEN crash_attempts + 1 ELSE crash_attempts END AS crash_attempts, CASE WHEN id % 5 = 0 THEN 1800000000 ELSE indexed_at END AS indexed_at,
    CASE WHEN id % 5 = 0 THEN 9 ELSE page_count END AS page_count, CASE WHEN id % 6 = 0 THEN 'abc' ELSE content_sha1 END AS content_sha1 FROM files""", "files")  # fmt: skip
def _(v: Views):
    ids = lambda n: v.files.where(f"id % {n} = 0").select("id")
    f = store.mark_excluded(v.files, ids(4), "reason")
    f = store.reset_crash(store.bump_crash(f, ids(3)), ids(7))
    f = store.mark_indexed(f, ids(5).withColumn("pages", F.lit(9)), NOW)
    f = store.set_hash(f, ids(6).withColumn("sha1", F.lit("abc")))
    return f.select("id", "is_excluded", "exclusion_reason", "crash_attempts", "indexed_at", "page_count", "content_sha1")


@query("k6_cascade_delete", """, g AS (SELECT id FROM files WHERE id % 3 = 1), p AS (SELECT * FROM page_t WHERE file_id NOT IN (SELECT id FROM g)), d AS (SELECT id FROM page_t WHERE file_id IN (SELECT id FROM g))
    SELECT 'files' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM files WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'pages', count(*), sum(id)::BIGINT FROM p
    UNION ALL SELECT 'regions', count(*), sum(id)::BIGINT FROM regions WHERE page_id NOT IN (SELECT id FROM d) UNION ALL SELECT 'page_ocr', count(*), sum(page_id)::BIGINT FROM page_ocr WHERE page_id NOT IN (SELECT id FROM d)
    UNION ALL SELECT 'removed_regions', count(*), sum(id)::BIGINT FROM regions WHERE page_id IN (SELECT id FROM d)""", "files", "page_t", "regions", "page_ocr")  # fmt: skip
def _(v: Views):
    left = store.cascade_delete(v.files.where("id % 3 = 1").select("path"), v.files, v.page_t, v.regions, v.page_ocr)
    parts = [df.agg(F.lit(k).alias("name"), F.count("*").alias("n"), F.sum("page_id" if k == "page_ocr" else "id").alias("ids")) for k, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("j13_file_regions", "SELECT f.id AS file_id, r.id AS region_id FROM regions r JOIN page_t p ON p.id = r.page_id JOIN files f ON f.id = p.file_id", "regions", "page_t", "files")
def _(v: Views):
    return store.file_regions(v.files, v.page_t, v.regions)


@query("j2_page_files", "SELECT p.id AS page_id, path, page_num FROM page_t p JOIN files f ON f.id = file_id", "page_t", "files")
def _(v: Views):
    return v.page_t.join(v.files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("page_id"), "path", "page_num")


@query("j3_ocr_claim", f"SELECT * FROM ({_WAITING}) WHERE page_id > 50 ORDER BY page_id LIMIT 200", "page_t", "files", "page_ocr")
def _(v: Views):
    return store.pending_ocr(v.page_t, v.files, v.page_ocr, 50, 200)


@query("t6_keyset_pages", "SELECT id, file_id FROM page_t WHERE id > 99 ORDER BY id LIMIT 50", "page_t")
def _(v: Views):
    return v.page_t.where("id > 99").orderBy("id").limit(50).select("id", "file_id")


@query("a5_index_stats", """SELECT count(*) AS total_files, count(*) FILTER (indexed_at IS NOT NULL AND is_excluded = 0) AS indexed_files, count(*) FILTER (is_excluded = 1) AS excluded_files,
    count(*) FILTER (indexed_at IS NULL AND is_excluded = 0) AS failed_files, (SELECT count(*) FROM page_t) AS total_pages FROM files""", "files", "page_t")  # fmt: skip
def _(v: Views):
    return store.index_stats(v.files, v.page_t)


@query("a6_vector_count", "SELECT count(*) AS vectors FROM regions WHERE id % 4 <> 3", "regions")
def _(v: Views):
    return v.regions.select(F.when(F.col("id") % 4 != 3, F.col("vector")).alias("vector")).agg(F.count("vector").alias("vectors"))


@query("a7_ocr_progress", "SELECT (SELECT count(*) FROM page_ocr) AS done, greatest((SELECT count(*) FROM page_t) - (SELECT count(*) FROM page_ocr), 0) AS pending", "page_t", "page_ocr")
def _(v: Views):
    return store.ocr_progress(v.page_t, v.page_ocr)


@query("k14_rebuild_decision", "SELECT live, count(*) > 0 AND 2 * live < count(*) AS rebuild FROM regions, (VALUES (0), (100), (249), (250), (1000000)) t(live) GROUP BY live", "regions")
def _(v: Views):
    lives = v.inline([(x,) for x in (0, 100, 249, 250, 1000000)], "live long")
    stored = v.regions.where(V.is_finite(F.col("vector"))).agg(F.count("*").alias("stored"))
    return lives.crossJoin(stored).select("live", store.rebuild_needed(F.col("stored"), F.col("live") + 10, F.lit(10)).alias("rebuild"))


@query("k12_thumbnail_name", "SELECT id, thumb_path FROM page_t", "page_t")
def _(v: Views):
    return v.page_t.select("id", G.thumbnail_name(F.col("file_id"), F.col("page_num")).alias("thumb_path"))


@query("p12_eligible", "SELECT p.id AS page_id FROM page_t p JOIN files f ON f.id = file_id WHERE is_excluded = 0 AND indexed_at IS NOT NULL", "page_t", "files")
def _(v: Views):
    live = v.files.where("is_excluded = 0 and indexed_at is not null").select(F.col("id").alias("file_id"))
    return v.page_t.join(live, "file_id", "left_semi").select(F.col("id").alias("page_id"))


# Ingest


@query("s2_classify", "SELECT path, CASE WHEN regexp_extract(lower(path), '\\.([^./\\\\]+)$', 1) IN ('pdf', 'ai') THEN regexp_extract(lower(path), '\\.([^./\\\\]+)$', 1) END AS file_type FROM (SELECT path FROM files UNION ALL SELECT replace(path, '.pdf', '.docx') FROM files)", "files")
def _(v: Views):
    paths = v.files.select("path").union(v.files.select(F.replace("path", F.lit(".pdf"), F.lit(".docx"))))
    return paths.select("path", ingest.classify(F.col("path")).alias("file_type"))


@query("s3_sha1", "SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN sha1(text) END AS digest FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", F.sha1(F.when(F.col("doc_id") % 13 != 0, F.col("text"))).alias("digest"))


@query("s13_data_uri", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha1(text) AS digest FROM documents")
def _(v: Views):
    prefix = F.when(F.col("doc_id") % 2 == 0, "data:image/png;base64,").otherwise("")
    coded = v.table("documents").select("doc_id", F.concat(prefix, F.lit(" "), F.base64(F.col("text").cast("binary"))).alias("u"))
    made = coded.select("doc_id", X.data_uri_bytes(F.col("u")).alias("b"))
    return made.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.sha1("b").alias("digest"))


@query("p5_change_decision", """SELECT s.path, CASE WHEN f.id IS NULL THEN 'index_new' WHEN crash_attempts >= 2 AND is_excluded = 0 THEN 'skip_and_exclude' WHEN crash_attempts >= 2 THEN 'skip_blacklisted'
    WHEN indexed_at IS NOT NULL AND s.modified_at <= indexed_at THEN 'up_to_date' WHEN is_excluded = 1 AND s.modified_at <= f.modified_at THEN 'skip_excluded'
    WHEN s.content_sha1 = f.content_sha1 AND indexed_at IS NOT NULL THEN 'refresh' ELSE 'reindex' END AS action FROM scan s LEFT JOIN files f ON f.path = s.path""", "files", "scan")  # fmt: skip
def _(v: Views):
    return ingest.change_decisions(v.scan, v.files)


@query("j5_scan_join", "SELECT s.path, f.id FROM scan s LEFT JOIN files f ON f.path = s.path", "files", "scan")
def _(v: Views):
    return v.scan.select("path").join(v.files.select("path", "id"), "path", "left")


@query("p6_needs_reindex", "SELECT s.path, CASE WHEN indexed_at IS NULL THEN true ELSE coalesce(CASE WHEN f.id % 3 <> 0 THEN s.modified_at END > indexed_at, false) END AS needed FROM scan s JOIN files f ON f.path = s.path", "files", "scan")
def _(v: Views):
    both = v.scan.select("path", "modified_at").join(v.files.select("path", "id", "indexed_at"), "path")
    return both.select("path", ingest.needs_reindex(F.when(F.col("id") % 3 != 0, F.col("modified_at")), F.col("indexed_at")).alias("needed"))


@query("p7_hash_gate", "SELECT s.path, coalesce(s.content_sha1 = f.content_sha1 AND indexed_at IS NOT NULL, false) AS unchanged FROM scan s LEFT JOIN files f ON f.path = s.path", "files", "scan")
def _(v: Views):
    return ingest.hash_gate(v.scan, v.files)


@query("u3_vanished", "SELECT path FROM files EXCEPT SELECT path FROM scan", "files", "scan")
def _(v: Views):
    return v.files.select("path").join(v.scan.select("path"), "path", "left_anti")


@query("r8_attempt_ledger", """, a AS (SELECT user_id AS file_id, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'ok' WHEN event_id % 9 = 0 THEN 'error' ELSE 'crash' END AS outcome FROM events),
    l AS (SELECT file_id, max(seq) AS last FROM a WHERE outcome <> 'crash' GROUP BY file_id)
    SELECT file_id, count(*) FILTER (outcome = 'crash' AND seq > coalesce(last, -1)) AS crash_attempts, count(*) FILTER (outcome = 'crash' AND seq > coalesce(last, -1)) >= 2 AS blacklisted FROM a LEFT JOIN l USING (file_id) GROUP BY file_id""", "ranked")  # fmt: skip
def _(v: Views):
    i = F.col("event_id")
    rows = v.table("events").select(F.col("user_id").alias("file_id"), i.alias("seq"), F.when(i % 4 == 0, "ok").when(i % 9 == 0, "error").otherwise("crash").alias("outcome"))
    return ingest.attempt_ledger(rows)


_XMP = {
    1: "<rdf:li><stRef:instanceID>file:./a.pdf</stRef:instanceID></rdf:li>", 2: "<rdf:li>file:./a.pdf</rdf:li>", 3: "<rdf:li> <stRef:instanceID>file:../b.PDF</rdf:li><rdf:li>file:c.psd</rdf:li>",
    4: '<rdf:li rdf:parseType="Resource">file:mark.pdf</rdf:li>', 5: '<rdf:li a="1">file:mark.pdf</rdf:li><rdf:li>file:x.psd</rdf:li>', 6: "<rdf:li>file:x.psd</rdf:li><rdf:li b='2'>file:y.Pdf</rdf:li>", 7: "",
}


def _packet(k: int, items: str) -> str:
    return f"junk<?xpacket begin='x'?><egExtFL:files rdf:parseType='Seq'>{items}</egExtFL:files><?xpacket end='w'?>tail" if k != 7 else "no packet file:z.pdf"


_PACKETS = ", ".join("({}, '{}')".format(k, _packet(k, x).replace("'", "''")) for k, x in _XMP.items())


@query("p8_imposition", f"""WITH x AS (SELECT * FROM (VALUES {_PACKETS}) t(kind, content)),
    p AS (SELECT kind, regexp_extract(content, '(?s)<\\?xpacket begin=(.*?)<\\?xpacket end=', 1) AS c FROM x),
    n AS (SELECT kind, regexp_extract(c, '(?s)<egExtFL:files[^>]*>(.*?)</egExtFL:files>', 1) AS c FROM p),
    i AS (SELECT kind, list_concat(regexp_extract_all(c, '(?s)<rdf:li>(.*?)</rdf:li>', 1), regexp_extract_all(regexp_replace(c, '(?s)^.*<rdf:li>.*?</rdf:li>', ''), '(?s)<rdf:li [^>]*>(.*?)</rdf:li>', 1)) AS items FROM n),
    e AS (SELECT kind, len(list_filter(items, lambda s: contains(lower(s), '.pdf') AND NOT regexp_matches(lower(s), '^\\s*<stref:instanceid>file:\\.\\.?/'))) > 0 AS excluded FROM i)
    SELECT doc_id, excluded AND NOT contains(text, '<?xpacket') AS excluded FROM documents JOIN e ON kind = doc_id % 7 + 1""")
def _(v: Views):
    kinds = F.create_map(*(F.lit(x) for k, items in _XMP.items() for x in (k, _packet(k, items))))
    content = F.concat(F.encode("text", "UTF-8"), F.encode(F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")), "ISO-8859-1"), F.encode("text", "UTF-8"))
    return v.table("documents").select("doc_id", ingest.is_imposition(ingest.latin1(content)).alias("excluded"))


@query("p13_upload_validation", """SELECT doc_id, (ct = '' OR ct LIKE 'image/%') AS type_ok, n_chars * 4096 <= 67108864 OR NOT (ct = '' OR ct LIKE 'image/%') AS size_ok, coalesce(TRY_CAST(k AS BIGINT), 20) AS top_k
    FROM (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'image/png' ELSE 'text/html' END AS ct, CASE WHEN doc_id % 4 = 0 THEN 'many' ELSE (doc_id % 50)::VARCHAR END AS k FROM documents)""")
def _(v: Views):
    i = F.col("doc_id")
    rows = v.table("documents").select(i, "n_chars", F.when(i % 3 == 0, "").when(i % 3 == 1, "image/png").otherwise("text/html").alias("ct"), F.when(i % 4 == 0, "many").otherwise((i % 50).cast("string")).alias("k"))
    told = accepted(rows.select("doc_id", F.col("ct").alias("content_type"), F.col("k").alias("top_k"), (F.col("n_chars") * 4096).alias("n_bytes"), F.lit(1).alias("width"), F.lit(1).alias("height")))
    return told.select("doc_id", type_accepted(F.col("content_type")).alias("type_ok"), (F.coalesce("problem", F.lit("")) != "too large").alias("size_ok"), "top_k")


@query("j16_path_mapping", """, m AS (SELECT * FROM (VALUES (0, 'D:/d/1', 'Z:/one'), (1, 'D:/d/', 'Y:/all/'), (2, 'D:/', 'X:')) t(seq, server, client)),
    h AS (SELECT path, min(seq) AS seq FROM files, m WHERE starts_with(path, server) GROUP BY path)
    SELECT path, CASE WHEN regexp_matches(client, '[\\\\/]$') THEN client ELSE client || '\\' END || substr(path, length(server) + CASE WHEN regexp_matches(server, '[\\\\/]$') THEN 1 ELSE 2 END) AS mapped FROM h JOIN m USING (seq)""", "files")
def _(v: Views):
    maps = v.inline([(0, "D:/d/1", "Z:/one"), (1, "D:/d/", "Y:/all/"), (2, "D:/", "X:")], "seq int, server string, client string")
    return ingest.mapped_path(v.files, maps)


# Geometry and formats


def _dims(v: Views) -> DataFrame:
    p = v.table("part")
    return p.select(F.col("p_partkey").alias("page_id"), (F.col("p_partkey") * 37 % 2000).cast("double").alias("w"), (F.col("p_partkey") * 61 % 1700).cast("double").alias("h"))


_DIMS = "SELECT p_partkey AS page_id, (p_partkey * 37 % 2000)::DOUBLE AS w, (p_partkey * 61 % 1700)::DOUBLE AS h FROM part"


def _geometry(name: str, sql: str, make, where: str = "w > 0 and h > 0"):
    @query(name, f"WITH dims AS ({_DIMS}) SELECT page_id, {sql} FROM dims WHERE {where}")
    def _(v: Views):
        return _dims(v).where(where).select("page_id", make(F.col("w"), F.col("h")).alias("g")).select("page_id", "g.*")


_geometry("f14_render_size", "CASE WHEN w <= 0 OR h <= 0 THEN 640 ELSE greatest(round(w * (640.0 / greatest(w, h))), 1) END::BIGINT AS width, CASE WHEN w <= 0 OR h <= 0 THEN 640 ELSE greatest(round(h * (640.0 / greatest(w, h))), 1) END::BIGINT AS height", lambda w, h: G.render_size(w, h, 640), "true")
_FIT = "least(greatest(round({0} * least(224.0 / w, 224.0 / h)), 1), 224)::BIGINT"
_geometry("f15_letterbox", f"{_FIT.format('w')} AS width, {_FIT.format('h')} AS height, (224 - {_FIT.format('w')}) // 2 AS left, (224 - {_FIT.format('h')}) // 2 AS top".replace("AS left", 'AS "left"'), lambda w, h: G.letterbox(w, h, 224))
_CUT = "greatest(round({0} * 0.7), 1)"
_geometry("f17_center_crop", f'floor((w - {_CUT.format("w")}) / 2)::BIGINT AS "left", floor((h - {_CUT.format("h")}) / 2)::BIGINT AS top, {_CUT.format("w")}::BIGINT AS width, {_CUT.format("h")}::BIGINT AS height', lambda w, h: G.center_crop(w, h, 0.7))
_geometry("f18_thumb_fit", "greatest(round(w * least(256.0 / w, 256.0 / h, 1)), 1)::BIGINT AS width, greatest(round(h * least(256.0 / w, 256.0 / h, 1)), 1)::BIGINT AS height", lambda w, h: G.thumbnail_size(w, h))
_geometry("f20_det_size", "greatest(round(w * least(1280.0 / greatest(w, h), 1) / 32) * 32, 32)::BIGINT AS width, greatest(round(h * least(1280.0 / greatest(w, h), 1) / 32) * 32, 32)::BIGINT AS height", lambda w, h: G.detector_size(w, h))
_geometry("f21_rec_width", "least(greatest(ceil(48.0 * w / greatest(h, 1)), 8), 320)::BIGINT AS width", lambda w, h: F.struct(G.recognizer_width(w, h).alias("width")), "true")


@query("f12_tile_explode", """SELECT id AS page_id, 'full' AS kind, 0::BIGINT AS idx, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1.0::DOUBLE AS w, 1.0::DOUBLE AS h FROM page_t
    UNION ALL SELECT id, 'tile', i, (i % 3) * 0.25::DOUBLE, (i // 3) * 0.25::DOUBLE, 0.5, 0.5 FROM page_t, (SELECT unnest(range(9)) AS i) WHERE id % 10 <> 9""", "page_t")  # fmt: skip
def _(v: Views):
    pages = v.page_t.select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 == 9, 0).otherwise(640).alias("width_px"), F.lit(480).alias("height_px"))
    return G.expand_regions(pages).select("page_id", "kind", "idx", "x", "y", "w", "h")


@query("f13_tile_pixels", f"""WITH dims AS ({_DIMS}), t AS (SELECT page_id, w AS pw0, h AS ph0, i, (i % 3) * 0.25 AS x, (i // 3) * 0.25 AS y FROM dims, (SELECT unnest(range(9)) AS i) WHERE w > 0 AND h > 0)
    SELECT page_id, i AS idx, floor(x * pw0)::BIGINT AS px, greatest(round(least(x + 0.5, 1) * pw0) - floor(x * pw0), 1)::BIGINT AS pw, floor(y * ph0)::BIGINT AS py, greatest(round(least(y + 0.5, 1) * ph0) - floor(y * ph0), 1)::BIGINT AS ph FROM t""")
def _(v: Views):
    pages = _dims(v).select("page_id", F.col("w").alias("width_px"), F.col("h").alias("height_px"))
    return G.expand_regions(pages).where("kind = 'tile'").select("page_id", "idx", "px", "pw", "py", "ph")


@query("f23_rfc3339", "SELECT id, strftime(make_timestamp(modified_at * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS t FROM files", "files")
def _(v: Views):
    return v.files.select("id", X.rfc3339(F.col("modified_at")).alias("t"))


@query("f27_depth_clamp", "SELECT l_linenumber * 9 AS depth, count(*) AS n, least(l_linenumber * 9, 32) AS effective FROM lineitem GROUP BY l_linenumber")
def _(v: Views):
    d = v.table("lineitem").select((F.col("l_linenumber") * 9).alias("depth"))
    return d.groupBy("depth").agg(F.count("*").alias("n")).withColumn("effective", F.least("depth", F.lit(32)))


@query("f28_formats", "SELECT doc_id, CASE WHEN b = 0 THEN '–' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', round(b / 1024, 1)) || ' KB' ELSE printf('%.1f', round(b / 1048576, 1)) || ' MB' END AS size, printf('%.1f', round(s * 100, 1)) || '%' AS share FROM (SELECT doc_id, doc_id * doc_id * 3 AS b, doc_id % 64 / 64 AS s FROM documents)")
def _(v: Views):
    i = F.col("doc_id")
    return v.table("documents").select(i, X.human_bytes(i * i * 3).alias("size"), X.percent(i % 64 / 64).alias("share"))


# Reading text


@query("a15_component_boxes", "SELECT l_suppkey AS label, min(l_partkey % 300) AS x0, min(l_orderkey % 200) AS y0, max(l_partkey % 300) AS x1, max(l_orderkey % 200) AS y1, count(*) AS n, round(avg(l_discount * 10), 6) AS mean_prob FROM lineitem GROUP BY l_suppkey")
def _(v: Views):
    return ocr.component_boxes(_pixels(v)).withColumn("mean_prob", F.round("mean_prob", 6))


def _pixels(v: Views) -> DataFrame:
    return v.table("lineitem").select(F.col("l_suppkey").alias("label"), (F.col("l_partkey") % 300).alias("x"), (F.col("l_orderkey") % 200).alias("y"), (F.col("l_discount") * 10).alias("prob"))


@query("f19_unclip", """, b AS (SELECT s_suppkey AS label, s_suppkey % 90 AS x0, s_suppkey % 70 AS y0, s_suppkey % 90 + s_suppkey % 13 AS x1, s_suppkey % 70 + s_suppkey % 7 AS y1, s_suppkey % 10 / 10 AS p FROM supplier),
    g AS (SELECT *, ceil((x1 - x0 + 1) * (y1 - y0 + 1) * 1.6 / (2 * (x1 - x0 + 1 + y1 - y0 + 1))) AS o FROM b WHERE x1 - x0 + 1 >= 3 AND y1 - y0 + 1 >= 3 AND p >= 0.5)
    SELECT label, greatest(x0 - o, 0)::BIGINT AS x0, greatest(y0 - o, 0)::BIGINT AS y0, least(x1 + 1 + o, 96)::BIGINT AS x1, least(y1 + 1 + o, 64)::BIGINT AS y1 FROM g""", "ranked")  # fmt: skip
def _(v: Views):
    i = F.col("s_suppkey")
    boxes = v.table("supplier").select(i.alias("label"), (i % 90).alias("x0"), (i % 70).alias("y0"), (i % 90 + i % 13).alias("x1"), (i % 70 + i % 7).alias("y1"), (i % 10 / 10).alias("mean_prob"))
    return ocr.text_boxes(boxes, 96, 64)


@query("w3_reading_order", """WITH RECURSIVE b AS (SELECT l_orderkey % 500 AS page_id, l_partkey % 600 AS x, l_suppkey % 90 * 9 AS y, 50 AS w, 12 + l_linenumber AS h FROM lineitem),
    s AS (SELECT *, y + h // 2 AS mid, row_number() OVER (PARTITION BY page_id ORDER BY y + h // 2, x, y, w, h) AS i FROM b),
    r AS (SELECT page_id, i, mid AS head, greatest(h, 1) AS tall, 0 AS band FROM s WHERE i = 1
        UNION ALL SELECT s.page_id, s.i, CASE WHEN abs(mid - head) > greatest(tall // 2, 1) THEN mid ELSE head END, CASE WHEN abs(mid - head) > greatest(tall // 2, 1) THEN greatest(h, 1) ELSE greatest(tall, h) END,
            CASE WHEN abs(mid - head) > greatest(tall // 2, 1) THEN band + 1 ELSE band END FROM r JOIN s ON s.page_id = r.page_id AND s.i = r.i + 1)
    SELECT page_id, x, y, w, h, row_number() OVER (PARTITION BY page_id ORDER BY band, x, mid, y, w, h) - 1 AS ord FROM s JOIN r USING (page_id, i)""")
def _(v: Views):
    i = F.col("l_orderkey")
    boxes = v.table("lineitem").select((i % 500).alias("page_id"), (F.col("l_partkey") % 600).cast("int").alias("x"), (F.col("l_suppkey") % 90 * 9).cast("int").alias("y"), F.lit(50).alias("w"), (F.lit(12) + F.col("l_linenumber")).cast("int").alias("h"))
    return ocr.reading_order(boxes)


_STEPS = """SELECT line_id, t, cls, prob FROM (SELECT *, row_number() OVER (PARTITION BY line_id, t ORDER BY prob DESC, cls DESC) AS i FROM (
    SELECT l_orderkey AS line_id, l_linenumber::BIGINT AS t, (l_partkey % 4)::INT AS cls, l_discount * 10 AS prob FROM lineitem)) WHERE i = 1"""


@query("w4_ctc_decode", f"""WITH s AS ({_STEPS}), b AS (SELECT *, lag(cls) OVER (PARTITION BY line_id ORDER BY t) AS before FROM s),
    e AS (SELECT line_id, t, prob, substr('_ABC', cls + 1, 1) AS ch, cls <> 0 AND cls IS DISTINCT FROM before AS ok FROM b)
    SELECT line_id, coalesce(string_agg(ch, '' ORDER BY t) FILTER (ok), '') AS text, round(coalesce(avg(prob) FILTER (ok), 0), 6) AS score FROM e GROUP BY line_id""")
def _(v: Views):
    steps = v.table("lineitem").select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").cast("long").alias("t"), (F.col("l_partkey") % 4).cast("int").alias("cls"), (F.col("l_discount") * 10).alias("prob"))
    return ocr.ctc_decode(steps, v.inline([(0, "_"), (1, "A"), (2, "B"), (3, "C")], "cls int, ch string")).withColumn("score", F.round("score", 6))


@query("a19_line_score", f"""WITH s AS ({_STEPS}), b AS (SELECT *, lag(cls) OVER (PARTITION BY line_id ORDER BY t) AS before FROM s)
    SELECT round(avg(score), 6) AS mean_score, count(*) AS lines FROM (SELECT coalesce(avg(prob) FILTER (cls <> 0 AND cls IS DISTINCT FROM before), 0) AS score FROM b GROUP BY line_id)""")
def _(v: Views):
    steps = v.table("lineitem").select(F.col("l_orderkey").alias("line_id"), F.col("l_linenumber").cast("long").alias("t"), (F.col("l_partkey") % 4).cast("int").alias("cls"), (F.col("l_discount") * 10).alias("prob"))
    lines = ocr.ctc_decode(steps, v.inline([(1, "A"), (2, "B"), (3, "C")], "cls int, ch string"))
    return lines.agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("lines"))


@query("p10_ocr_lines", "SELECT doc_id FROM documents WHERE doc_id % 10 / 10 >= 0.5 AND doc_id % 3 <> 0")
def _(v: Views):
    lines = v.table("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(" \u3000\n")).otherwise(F.col("text")).alias("text"), (F.col("doc_id") % 10 / 10).alias("score"))
    return ocr.readable_lines(lines).select("doc_id")


# Evaluation

_QUALITY = "count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM ranked"


@query("a8_recall_mrr", f"SELECT 'overall' AS bucket, {_QUALITY}", "ranked")
def _(v: Views):
    return _rounded(evaluate.quality(v.ranked).where("bucket = 'overall'"))


@query("a11_buckets", f"SELECT coalesce(CASE WHEN area_ratio < 0.25 THEN 'small(<25%)' WHEN area_ratio < 0.6 THEN 'medium(25-60%)' ELSE 'large(>60%)' END, 'overall') AS bucket, {_QUALITY} GROUP BY CASE WHEN area_ratio < 0.25 THEN 'small(<25%)' WHEN area_ratio < 0.6 THEN 'medium(25-60%)' ELSE 'large(>60%)' END UNION ALL SELECT 'overall', {_QUALITY}", "ranked")
def _(v: Views):
    return _rounded(evaluate.quality(v.ranked))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


_AT = "list_sort(list({0}))[(round((count({0}) - 1) * {1}) + 1)::INT]"


@query("a10_percentiles", f"SELECT event_type, {_AT.format('value', 0.5)} AS p50, {_AT.format('value', 0.95)} AS p95 FROM events GROUP BY event_type")
def _(v: Views):
    return nearest_rank(v.table("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


_LONG = ", s AS (" + " UNION ALL ".join(f"SELECT '{s}' AS stage, {s}_ms AS ms FROM search_log" for s in ("encode", "ocr", "ann", "phash", "rank")) + ")"


@query("a12_stage_latency", f"{_LONG} SELECT stage, {_AT.format('ms', 0.5)} AS p50, {_AT.format('ms', 0.95)} AS p95, (sum(ms) // count(ms))::BIGINT AS mean FROM s GROUP BY stage", "search_log")
def _(v: Views):
    return evaluate.stage_latency(v.search_log)


@query("a13_mean_latency", "SELECT (sum(encode_ms + ocr_ms) // count(*))::BIGINT AS mean_ms FROM search_log", "search_log")
def _(v: Views):
    return v.search_log.selectExpr("encode_ms + ocr_ms as ms").selectExpr("sum(ms) div count(ms) as mean_ms")


@query("a14_calibration", f""", r AS (SELECT CASE WHEN rank IS NULL THEN 'miss_top1' ELSE 'hit' END AS kind, CASE WHEN rank IS NULL THEN top1_sim ELSE sim END AS s FROM search_log)
    SELECT kind, round({_AT.format('s', 0.05)}, 6) AS p05, round({_AT.format('s', 0.25)}, 6) AS p25, round({_AT.format('s', 0.5)}, 6) AS p50, round({_AT.format('s', 0.95)}, 6) AS p95 FROM r GROUP BY kind""", "search_log")
def _(v: Views):
    return _rounded(evaluate.calibration(v.search_log))


@query("t8_seeded_sample", "SELECT path, page_num FROM page_t p JOIN files f ON f.id = file_id WHERE is_excluded = 0 AND indexed_at IS NOT NULL ORDER BY md5('42:' || path || ':' || page_num), path, page_num LIMIT 100", "page_t", "files")
def _(v: Views):
    live = v.files.where("is_excluded = 0 and indexed_at is not null").select(F.col("id").alias("file_id"), "path")
    return evaluate.seeded_sample(v.page_t.join(live, "file_id").select("path", "page_num"), 42, 100, "path", "page_num")


@query("t9_first_misses", "SELECT query_id FROM ranked WHERE rank IS NULL ORDER BY query_id LIMIT 50", "ranked")
def _(v: Views):
    return evaluate.first_misses(v.ranked).select("query_id")


@query("a16_progress", """SELECT id, CASE WHEN t = 0 THEN 0 ELSE least(d * 100.0 / t, 100) END AS pct, CASE WHEN fin THEN 100 WHEN t = 0 THEN CASE WHEN f > 0 THEN 100 ELSE 0 END ELSE least(d * 100.0 / t, 100) END::DOUBLE AS percent, CASE WHEN fin THEN 'ready' ELSE 'indexing' END AS status
    FROM (SELECT doc_id AS id, doc_id % 12 AS d, doc_id % 9 AS t, doc_id % 2 AS f, doc_id % 5 = 0 AS fin FROM documents)""")
def _(v: Views):
    i = F.col("doc_id")
    rows = v.table("documents").select(i.alias("id"), (i % 12).alias("d"), (i % 9).alias("t"), (i % 2).alias("f"), (i % 5 == 0).alias("fin"))
    out = rows.select("id", evaluate.progress_percent(F.col("d"), F.col("t")).alias("pct"), evaluate.progress_report(F.col("d"), F.col("t"), F.col("f"), F.col("fin")).alias("r")).select("id", "pct", "r.*")
    return _rounded(out)


SQL["a16_progress"] = "SELECT id, round(pct::DOUBLE, 6) AS pct, round(percent, 6) AS percent, status FROM (" + SQL["a16_progress"] + ")"


@query("a17_reconcile", "SELECT doc_id, greatest(doc_id % 20, doc_id % 15 + doc_id % 7) AS total, doc_id % 7 + greatest(doc_id % 20 - doc_id % 15 - doc_id % 7, 0) AS failed FROM documents")
def _(v: Views):
    i = F.col("doc_id")
    return v.table("documents").select(i, evaluate.reconciled(i % 20, i % 15, i % 7).alias("r")).select("doc_id", "r.*")


# Events


@query("w5_settle_batch", """SELECT path, min(seq) AS seq FROM (SELECT *, lag(size) OVER w = size AND lag(mtime) OVER w = mtime AND size >= 1024 AND (row_number() OVER w - 1) % 20 > 0 AS same FROM settle_samples WINDOW w AS (PARTITION BY path ORDER BY seq)) WHERE same GROUP BY path""", "settle_samples")
def _(v: Views):
    from quire.streaming.settle import first_stable

    return first_stable(v.settle_samples)


@query("u6_net_events", """, e AS (SELECT path, max(seq) FILTER (event_id % 3 = 0) AS gone, max(seq) FILTER (event_id % 3 <> 0) AS fresh FROM settle_samples GROUP BY path)
    SELECT path, 'delete' AS event, 0 AS step FROM e WHERE gone IS NOT NULL UNION ALL SELECT path, 'modify', 1 FROM e WHERE fresh > coalesce(gone, -1)""", "settle_samples")
def _(v: Views):
    from quire.streaming.settle import net_events

    return net_events(v.settle_samples.select("path", "seq", F.when(F.col("event_id") % 3 == 0, "delete").otherwise("modify").alias("event")))


@query("r6_backfill_step", f"SELECT page_id, length(text) AS n FROM page_ocr UNION ALL SELECT page_id, 0 FROM ({_ORPHANS}) UNION ALL SELECT page_id, length(path) FROM ({_WAITING})", "page_t", "files", "page_ocr")
def _(v: Views):
    from quire.streaming.settle import backfill_ocr

    done = backfill_ocr(v.page_t, v.files, v.page_ocr.withColumn("ocr_at", F.lit(1).cast("long")), lambda claimed: claimed.select("page_id", F.col("path").alias("text")), NOW, batch=1_000_000)
    return done.select("page_id", F.length("text").alias("n"))


@query("s10_folder_changes", """SELECT coalesce(f.path, s.path) AS path, CASE WHEN f.path IS NULL THEN 'create' WHEN s.path IS NULL THEN 'delete' ELSE 'modify' END AS event
    FROM files f FULL JOIN scan s ON s.path = f.path WHERE f.path IS NULL OR s.path IS NULL OR f.modified_at <> s.modified_at""", "files", "scan")  # fmt: skip
def _(v: Views):
    from quire.streaming.watch import changes

    seen = v.files.select("path", F.col("file_size").alias("size"), F.col("modified_at").alias("mtime"))
    return changes(seen, v.scan.select("path", (F.col("file_size") - 1).alias("size"), F.col("modified_at").alias("mtime")))


@query("r2_settle_tick", """SELECT path, size, mtime, attempts + 1 AS attempts, CASE WHEN size IS NULL THEN 'vanished' WHEN size >= 1024 AND attempts > 0 AND size = before AND mtime = mtime_before THEN 'ready' WHEN attempts + 1 >= 20 THEN 'dropped' END AS outcome
    FROM (SELECT doc_id::VARCHAR AS path, doc_id % 5 * 600 AS before, doc_id % 3 AS mtime_before, (doc_id % 21)::INT AS attempts, CASE WHEN doc_id % 9 <> 4 THEN doc_id % 5 * 600 + (doc_id % 4 = 0)::INT END AS size, CASE WHEN doc_id % 9 <> 4 THEN doc_id % 3 + (doc_id % 7 = 0)::INT END AS mtime FROM documents)""")
def _(v: Views):
    from quire.streaming.watch import settle_tick

    i, path = F.col("doc_id"), F.col("doc_id").cast("string").alias("path")
    docs = v.table("documents")
    pending = docs.select(path, (i % 5 * 600).alias("size"), (i % 3).alias("mtime"), (i % 21).cast("int").alias("attempts"))
    listing = docs.where("doc_id % 9 <> 4").select(path, (i % 5 * 600 + (i % 4 == 0).cast("long")).alias("size"), (i % 3 + (i % 7 == 0).cast("long")).alias("mtime"))
    return settle_tick(pending, listing)


# Pixels and headers


@query("f2_phash")
def _(v: Views):
    """Of documents' bytes as grey images, 16 wide."""
    rows = v.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).where(F.octet_length("b") >= 64)
    height = F.floor(F.octet_length("b") / 16).cast("int")
    return rows.select("doc_id", V.phash(F.substr("b", F.lit(1), height * 16), F.lit(16), height).alias("phash"))


@query("f10_blob_codec", "SELECT id, 4 * len(vector) AS n_bytes, round(vector[1]::DOUBLE, 6) AS head, round(vector[len(vector)]::DOUBLE, 6) AS tail FROM regions", "regions")
def _(v: Views):
    blobs = v.regions.select("id", V.vector_to_blob("vector").alias("b"))
    back = blobs.select("id", F.octet_length("b").alias("n_bytes"), V.blob_to_vector(F.concat("b", F.unhex(F.lit("00FF")))).alias("x"))
    return back.select("id", "n_bytes", F.round(F.get("x", F.lit(0)).cast("double"), 6).alias("head"), F.round(F.element_at("x", -1).cast("double"), 6).alias("tail"))


@query("f16_tensor", "SELECT doc_id, 6 AS n, round((doc_id % 256 / 255 - 0.485) / 0.229, 4) AS r0, round((doc_id * 7 % 256 / 255 - 0.456) / 0.224, 4) AS g0, round((doc_id * 13 % 256 / 255 - 0.406) / 0.225, 4) AS b0, round((0 - 0.485) / 0.229, 4) AS r1 FROM documents")
def _(v: Views):
    i = F.col("doc_id")
    pixels = F.unhex(F.format_string("%02X%02X%02X000000", i % 256, i * 7 % 256, i * 13 % 256))
    made = v.table("documents").select(i, G.tensor(pixels, F.lit(2), F.lit(1)).alias("t"))
    return made.select("doc_id", F.size("t").alias("n"), *(F.round(F.get("t", F.lit(k)).cast("double"), 4).alias(n) for k, n in ((0, "r0"), (2, "g0"), (4, "b0"), (1, "r1"))))


@query("f22_rgba", "SELECT doc_id, printf('%02X%02X%02X%02X0A0B0CFF', doc_id * 13 % 256, doc_id * 7 % 256, doc_id % 256, doc_id * 3 % 256) AS rgba FROM documents")
def _(v: Views):
    i = F.col("doc_id")
    bgra = F.unhex(F.format_string("%02X%02X%02X%02X0C0B0AFF", i % 256, i * 7 % 256, i * 13 % 256, i * 3 % 256))
    return v.table("documents").select(i, F.hex(G.rgba(bgra)).alias("rgba"))


_DRAW = "(('0x' || substr(md5('7:' || page_id || ':' || crop || ':{}'), 1, 13))::BIGINT / 4503599627370496.0)"


@query("f25_crops", f"""WITH d AS (SELECT p_partkey AS page_id, 200 + p_partkey * 37 % 2000 AS pw, 100 + p_partkey * 61 % 1700 AS ph, unnest([0, 1]) AS crop FROM part),
    a AS (SELECT *, 0.08 + {_DRAW.format('area')} * 0.82 AS area, 0.75 + {_DRAW.format('aspect')} * 0.5833 AS aspect FROM d),
    s AS (SELECT *, least(greatest(round(least(sqrt(area * aspect), 1) * pw), 16), pw) / pw AS w, least(greatest(round(least(sqrt(area / aspect), 1) * ph), 16), ph) / ph AS h FROM a)
    SELECT page_id, crop, round(w, 6) AS w, round(h, 6) AS h, round({_DRAW.format('x')} * (1 - w), 6) AS x, round({_DRAW.format('y')} * (1 - h), 6) AS y, round(w * h, 6) AS area_ratio,
        floor(320 + {_DRAW.format('edge')} * 581)::BIGINT AS edge, floor({_DRAW.format('light')} * 51)::BIGINT - 25 AS brightness, floor(70 + {_DRAW.format('quality')} * 21)::BIGINT AS quality FROM s""")
def _(v: Views):
    pages = v.table("part").select(F.col("p_partkey").alias("page_id"), (F.lit(200) + F.col("p_partkey") * 37 % 2000).alias("width_px"), (F.lit(100) + F.col("p_partkey") * 61 % 1700).alias("height_px"))
    return _rounded(evaluate.synthetic_crops(pages, 7, per_page=2).drop("width_px", "height_px"))


_HOSTS = ("localhost:7788", "127.0.0.1", "[::1]:7788", "example.org:80", "LocalHost", "[::1", "a:b:c", "")


@query("f26_hosts", f"""WITH h AS (SELECT doc_id, {list(_HOSTS)}[doc_id % {len(_HOSTS)} + 1] AS header, ['10.0.0.7', '127.0.0.9', '::1', '::ffff:127.0.0.1', '1127.0.0.1'][doc_id % 5 + 1] AS address FROM documents),
    n AS (SELECT *, CASE WHEN starts_with(header, '[') AND contains(header, ']') THEN substr(header, 2, instr(header, ']') - 2) WHEN contains(header, ':') THEN left(header, length(header) - position(':' IN reverse(header))) ELSE header END AS host FROM h)
    SELECT doc_id, host, doc_id % 5 IN (1, 2, 3) OR lower(host) IN ('localhost', '127.0.0.1', '::1') AS is_local FROM n""")
def _(v: Views):
    pick = lambda values: F.get(F.lit(list(values)), (F.col("doc_id") % len(values)).cast("int"))
    rows = v.table("documents").select("doc_id", pick(_HOSTS).alias("header"), pick(("10.0.0.7", "127.0.0.9", "::1", "::ffff:127.0.0.1", "1127.0.0.1")).alias("address"))
    return rows.select("doc_id", X.host_name(F.col("header")).alias("host"), X.is_local(F.col("address"), F.col("header")).alias("is_local"))


@query("s12_image_header", """SELECT doc_id, w AS width, h AS height, CASE WHEN w IS NULL THEN 'not an image' WHEN w * h > 60000000 THEN 'too many pixels' END AS problem
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 1 + doc_id * 370 % 12000 END AS w, CASE WHEN doc_id % 7 <> 0 THEN 1 + doc_id * 610 % 9000 END AS h FROM documents)""")
def _(v: Views):
    i = F.col("doc_id")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.format_string("%08X%08X", 1 + i * 370 % 12000, 1 + i * 610 % 9000)))
    rows = v.table("documents").select(i, F.lit("image/png").alias("content_type"), F.when(i % 7 != 0, png).otherwise(F.encode("text", "UTF-8")).alias("body"), F.lit(None).cast("string").alias("top_k"))
    return probed_uploads(rows).select("doc_id", "width", "height", "problem")


@query("x5_components")
def _(v: Views):
    """Connected parts of the bytes above 110 of documents as grey images, 32 wide."""
    rows = v.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).where(F.octet_length("b") >= 32)
    return rows.select("doc_id", ocr.count_components("b", F.lit(32), F.lit(110)).alias("parts"))
