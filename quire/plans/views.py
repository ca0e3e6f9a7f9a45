"""The retrieval tables as views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.vectors import sign_hash

QUERY_REGIONS = {0: 0, 1: 37, 2: 250}
QUERY_TEXTS = {0: "thnt ering", 1: "eaux ouon", 2: "ab", 3: "  ering thnt ering x "}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def inline(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def regions(self) -> DataFrame:
        i = F.col("vec_id")
        idx = F.when(i % 10 == 0, F.lit(0)).otherwise(i % 10 - 1).cast("long")
        return self.table("embeddings").select(
            i.alias("id"), F.floor(i / 10).alias("page_id"), F.when(i % 10 == 0, "full").otherwise("tile").alias("kind"), idx.alias("idx"),
            sign_hash(F.col("embedding")).alias("phash"), F.col("embedding").alias("vector"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.regions.select(F.col("id").alias("region_id"), "vector")

    @cached_property
    def hashes(self) -> DataFrame:
        return self.regions.select(F.col("id").alias("region_id"), "phash")

    @cached_property
    def page_t(self) -> DataFrame:
        i = F.col("doc_id")
        file_id, num = F.floor(i / 4), i % 4 + 1
        return self.table("documents").select(i.alias("id"), file_id.alias("file_id"), num.alias("page_num"), F.concat_ws("", file_id.cast("string"), F.lit("_"), num.cast("string"), F.lit(".webp")).alias("thumb_path"))

    @cached_property
    def page_ocr(self) -> DataFrame:
        docs = self.table("documents").where("doc_id % 19 <> 5")
        return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 17 == 3, "").otherwise(F.col("text")).alias("text"))

    @cached_property
    def files(self) -> DataFrame:
        i = F.col("page_id")
        name = F.concat(i.cast("string"), F.lit("_"), F.regexp_replace("url", "[^A-Za-z0-9]+", "_"), F.when(i % 5 == 0, ".AI").otherwise(".pdf"))
        path = F.concat(F.lit("D:/d/"), name)
        null = lambda t: F.lit(None).cast(t)
        return self.table("pages").select(
            i.alias("id"), path.alias("path"), name.alias("filename"), F.when(i % 5 == 0, "ai").otherwise("pdf").alias("file_type"), F.length("html").cast("long").alias("file_size"),
            (F.lit(1700000000) + i * 60).alias("modified_at"), F.lit(4).cast("long").alias("page_count"), (i % 11 == 10).cast("int").alias("is_excluded"),
            F.when(i % 7 != 6, F.lit(1700000000) + i % 3 * 6000).alias("indexed_at"), F.lit(1690000000).cast("long").alias("created_at"),
            F.floor(i % 13 / 5).alias("crash_attempts"), null("string").alias("exclusion_reason"), F.sha1(path).alias("content_sha1"),
        )

    @cached_property
    def scan(self) -> DataFrame:
        i = F.col("id")
        mtime = F.col("modified_at") + F.when(i % 4 == 1, 100000).otherwise(0)
        digest = F.when(i % 8 == 3, F.sha1(F.concat("path", F.lit("x")))).otherwise(F.sha1("path"))
        rows = self.files.select("path", "filename", "file_type", (F.col("file_size") + 1).alias("file_size"), mtime.alias("modified_at"), digest.alias("content_sha1"), "id")
        more = rows.where("id % 6 = 2").withColumns({"path": F.concat("path", F.lit(".v2.pdf")), "filename": F.concat("filename", F.lit(".v2.pdf"))})
        return rows.where("id % 9 <> 4").unionByName(more).drop("id")

    @cached_property
    def query_vec(self) -> DataFrame:
        asked = self.inline(list(QUERY_REGIONS.items()), "query_id long, id long")
        return self.regions.join(F.broadcast(asked), "id").select("query_id", "vector", "phash")

    @cached_property
    def query_text(self) -> DataFrame:
        return self.inline(list(QUERY_TEXTS.items()), "query_id long, text string")

    @cached_property
    def ranked(self) -> DataFrame:
        i = F.col("vec_id")
        return self.table("embeddings").select(i.alias("query_id"), (i % 10 / 10).alias("area_ratio"), F.when(i % 7 != 0, i % 12 + 1).alias("rank"))

    @cached_property
    def search_log(self) -> DataFrame:
        i = F.col("event_id")
        stages = {"encode": 37, "ocr": 53, "ann": 11, "phash": 29, "rank": 71}
        return self.table("events").select(i.alias("query_id"), F.when(i % 5 != 0, i % 10 + 1).alias("rank"), (i % 97 / 97).alias("sim"), (i % 89 / 89).alias("top1_sim"), *((i * k % 900).alias(f"{s}_ms") for s, k in stages.items()))

    @cached_property
    def settle_samples(self) -> DataFrame:
        seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
        return self.table("events").select(
            F.col("user_id").cast("string").alias("path"), seq.cast("long").alias("seq"), (F.floor(F.col("value") / 50) * 1024).alias("size"), F.lit(7).cast("long").alias("mtime"), "event_id", "event_type"
        )


_PHASH = "list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] < 0 THEN (1::HUGEINT << (63 - i)::INT) ELSE 0::HUGEINT END))"

SQL_VIEWS = {
    "regions": f"""SELECT vec_id AS id, vec_id // 10 AS page_id, CASE WHEN vec_id % 10 = 0 THEN 'full' ELSE 'tile' END AS kind,
        CASE WHEN vec_id % 10 = 0 THEN 0 ELSE vec_id % 10 - 1 END AS idx, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash,
        embedding AS vector FROM (SELECT *, {_PHASH} AS h FROM embeddings)""",
    "page_t": "SELECT doc_id AS id, doc_id // 4 AS file_id, doc_id % 4 + 1 AS page_num, (doc_id // 4) || '_' || (doc_id % 4 + 1) || '.webp' AS thumb_path FROM documents",
    "page_ocr": "SELECT doc_id AS page_id, CASE WHEN doc_id % 17 = 3 THEN '' ELSE text END AS text FROM documents WHERE doc_id % 19 <> 5",
    "files": """SELECT page_id AS id, 'D:/d/' || name AS path, name AS filename, CASE WHEN page_id % 5 = 0 THEN 'ai' ELSE 'pdf' END AS file_type, length(html) AS file_size,
        1700000000 + page_id * 60 AS modified_at, 4::BIGINT AS page_count, (page_id % 11 = 10)::INT AS is_excluded,
        CASE WHEN page_id % 7 <> 6 THEN 1700000000 + page_id % 3 * 6000 END AS indexed_at, 1690000000::BIGINT AS created_at, page_id % 13 // 5 AS crash_attempts,
        NULL::VARCHAR AS exclusion_reason, sha1('D:/d/' || name) AS content_sha1
        FROM (SELECT *, page_id || '_' || regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') || CASE WHEN page_id % 5 = 0 THEN '.AI' ELSE '.pdf' END AS name FROM pages)""",
    "scan_all": """SELECT id, path, filename, file_type, file_size + 1 AS file_size, modified_at + CASE WHEN id % 4 = 1 THEN 100000 ELSE 0 END AS modified_at,
        CASE WHEN id % 8 = 3 THEN sha1(path || 'x') ELSE sha1(path) END AS content_sha1 FROM files""",
    "scan": """SELECT * EXCLUDE (id) FROM scan_all WHERE id % 9 <> 4
        UNION ALL SELECT path || '.v2.pdf', filename || '.v2.pdf', file_type, file_size, modified_at, content_sha1 FROM scan_all WHERE id % 6 = 2""",
    "query_vec": "SELECT q AS query_id, vector, phash FROM regions JOIN (VALUES (0, 0), (1, 37), (2, 250)) v(q, r) ON id = r",
    "query_text": "SELECT * FROM (VALUES (0, 'thnt ering'), (1, 'eaux ouon'), (2, 'ab'), (3, '  ering thnt ering x ')) v(query_id, text)",
    "ranked": "SELECT vec_id AS query_id, vec_id % 10 / 10 AS area_ratio, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 12 + 1 END AS rank FROM embeddings",
    "search_log": """SELECT event_id AS query_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 10 + 1 END AS rank, event_id % 97 / 97 AS sim, event_id % 89 / 89 AS top1_sim,
        event_id * 37 % 900 AS encode_ms, event_id * 53 % 900 AS ocr_ms, event_id * 11 % 900 AS ann_ms, event_id * 29 % 900 AS phash_ms, event_id * 71 % 900 AS rank_ms FROM events""",
    "settle_samples": """SELECT user_id::VARCHAR AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (floor(value / 50) * 1024)::BIGINT AS size, 7 AS mtime, event_id, event_type FROM events""",
    "pairs": """SELECT query_id, r.id AS region_id, r.page_id, list_dot_product(q.vector::DOUBLE[], r.vector::DOUBLE[]) AS product, bit_count(xor(q.phash, r.phash))::INT AS distance
        FROM query_vec q, regions r""",
    "phrases": """SELECT query_id, pos, phrase FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(phrase) DESC, pos) AS i FROM (
        SELECT query_id, unnest(s) AS phrase, unnest(range(len(s))) AS pos FROM (SELECT query_id, string_split_regex(text, '\\s+') AS s FROM query_text WHERE length(trim(text)) >= 4)) WHERE length(phrase) >= 3) WHERE i <= 16""",
    "found": """SELECT phrase, page_id, (length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase) AS tf, greatest(length(text) - 2, 0) AS dl
        FROM page_ocr, (SELECT DISTINCT phrase FROM phrases) WHERE contains(lower(text), phrase)""",
    "bm25": """SELECT query_id, page_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS r
        FROM found JOIN (SELECT phrase, count(*) AS df FROM found GROUP BY phrase) USING (phrase) JOIN phrases USING (phrase),
        (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS avgdl FROM page_ocr) GROUP BY query_id, page_id""",
    "texts": """SELECT query_id, page_id, CASE WHEN max(r) OVER w - min(r) OVER w < 1e-9 THEN 1.0 ELSE (max(r) OVER w - r) / (max(r) OVER w - min(r) OVER w) END AS text_score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, page_id) AS i FROM bm25) WHERE i <= 500 WINDOW w AS (PARTITION BY query_id)""",
    "sims": """SELECT query_id, region_id, page_id, least(greatest(product, 0), 1) AS sim FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product DESC, region_id) AS i FROM pairs) WHERE i <= 500 AND product >= 0.1""",
    "dists": "SELECT query_id, region_id, page_id, distance FROM pairs WHERE distance <= 22",
    "merged": """SELECT query_id, page_id, max(v) AS vector_sim, min(d) AS phash_dist, max(t) AS text_score FROM (
        SELECT query_id, page_id, sim AS v, NULL AS d, NULL AS t FROM sims UNION ALL SELECT query_id, page_id, NULL, distance, NULL FROM dists
        UNION ALL SELECT query_id, page_id, NULL, NULL, text_score FROM texts) GROUP BY query_id, page_id""",
    "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id)::INT AS rank FROM (
        SELECT *, least(greatest(0.7 * coalesce(vector_sim, 0) + 0.1 * coalesce(1 - phash_dist / 64.0, 0) + 0.2 * coalesce(text_score, 0), 0), 1) AS score FROM merged)) WHERE rank <= 20""",
}

_NEEDS = {
    "scan_all": ["files"], "scan": ["scan_all"], "query_vec": ["regions"], "pairs": ["query_vec"], "phrases": ["query_text"], "found": ["page_ocr", "phrases"],
    "bm25": ["found"], "texts": ["bm25"], "sims": ["pairs"], "dists": ["pairs"], "merged": ["sims", "dists", "texts"], "top": ["merged"],
}


def with_views(body: str, *views: str) -> str:
    """body after the definitions of the views that it reads; body may begin with further ones (', x AS ...')."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    return ("WITH " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in order) + "\n" if order else "") + body
