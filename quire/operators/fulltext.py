"""Substring full text over pages: trigram postings, phrase matches, BM25 and its normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.common import let
from quire.functions.text import passes_gate, segments
from quire.runtime import staged

K1, B = 1.2, 0.75


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, lower-cased."""
    made = let(F.split(F.lower(text), ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    return F.when(F.length(text) >= 3, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


#: Trigrams that are looked for one by one.
FEW_TRIGRAMS = 200


def postings(pages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """trigram, page_id of pages (page_id, text): the inverted index, or its rows of some trigrams only."""
    made = trigrams(F.col("text"))
    if only is not None and len(only) <= FEW_TRIGRAMS:
        # looking for a few is cheaper than making all of a page's
        made = let(F.lower("text"), lambda t: F.filter(F.lit(only).cast("array<string>"), lambda x: F.contains(t, x)))
    elif only is not None:
        made = F.array_intersect(made, F.lit(only).cast("array<string>"))
    return pages.select("page_id", F.explode(made).alias("trigram")).select("trigram", "page_id")


def trigrams_of(queries: DataFrame, most: int = 10_000) -> list[str] | None:
    """The distinct trigrams of phrases (phrase), if there are at most `most`; else None."""
    rows = queries.select(F.explode(trigrams(F.col("phrase"))).alias("t")).distinct().limit(most + 1).collect()
    return [r["t"] for r in rows] if len(rows) <= most else None


def sync_postings(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after pages were inserted, updated (their new text) or deleted (null text)."""
    return index.join(changed.select("page_id").distinct(), "page_id", "left_anti").select("trigram", "page_id").unionByName(postings(changed.where("text is not null")))


def phrases(queries: DataFrame) -> DataFrame:
    """query_id, pos, phrase of queries (query_id, text) that pass the gate."""
    gated = queries.where(passes_gate(F.col("text")))
    return gated.select("query_id", F.explode(segments(F.col("text"))).alias("s")).select("query_id", "s.pos", F.col("s.segment").alias("phrase"))


def _quoted(phrase: Column) -> Column:
    return F.concat(F.lit(r"(?=\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))


def occurrences(text: Column, phrase: Column) -> Column:
    """Overlapping occurrences of a phrase in a text, both lower-cased."""
    return F.regexp_count(text, _quoted(phrase))


#: Phrases that may be broadcast to the pages.
FEW_PHRASES = 10_000


def matches(pages: DataFrame, wanted: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """phrase, page_id, tf, dl: where each distinct phrase (3 characters or more) occurs.

    Without an index a small table of phrases goes to the pages; of more phrases each is looked up by one of its
    trigrams. With postings, pages that have all of a phrase's trigrams are verified; only the postings of these
    trigrams move.
    """
    distinct = wanted.where(F.length("phrase") >= 3).select("phrase", F.lower("phrase").alias("_p")).distinct()
    text = pages.select("page_id", F.lower("text").alias("_t"), F.greatest(F.length("text") - 2, F.lit(0)).cast("long").alias("dl"))
    few = distinct.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES
    if index is not None:
        parts = distinct.select("phrase", F.explode(trigrams(F.col("phrase"))).alias("trigram"))
        need = F.size(trigrams(F.col("phrase")))
        narrow = index.join(F.broadcast(parts.select("trigram").distinct()), "trigram", "left_semi") if few else index
        pruned = narrow.join(parts, "trigram").groupBy("phrase", "page_id").agg(F.count("*").alias("n")).where(F.col("n") == need).select("phrase", "page_id")
        found = text.join(pruned, "page_id").withColumn("_p", F.lower("phrase"))
    elif few:
        return text.join(F.broadcast(distinct), F.contains("_t", "_p")).select("phrase", "page_id", occurrences(F.col("_t"), F.col("_p")).cast("long").alias("tf"), "dl")
    else:
        anchored = distinct.withColumn("trigram", F.array_min(F.transform(trigrams(F.col("_p")), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t"))))["t"])
        pruned = postings(pages.select("page_id", "text")).join(anchored, "trigram").select("page_id", "phrase", "_p")
        found = text.join(pruned, "page_id")
    return found.where(F.contains("_t", "_p")).select("phrase", "page_id", occurrences(F.col("_t"), F.col("_p")).cast("long").alias("tf"), "dl")


def corpus_stats(pages: DataFrame) -> DataFrame:
    """n_docs, avgdl over all pages, empty ones included."""
    return pages.agg(F.count("*").alias("n_docs"), F.avg(F.greatest(F.length("text") - 2, F.lit(0))).alias("avgdl"))


def bm25(pages: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """query_id, page_id, r (lower is better): a phrase given twice counts twice."""
    wanted = phrases(queries)
    # written once: it is read for document frequencies and for scores
    found = staged(matches(pages, wanted, index), "found")
    df = found.groupBy("phrase").agg(F.count("*").alias("df_phrase"))
    stats = corpus_stats(pages).first()
    n, avgdl = float(stats["n_docs"]), float(stats["avgdl"] or 0.0)
    idf = F.log((F.lit(n) - F.col("df_phrase") + 0.5) / (F.col("df_phrase") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    return found.join(df, "phrase").join(wanted, "phrase").groupBy("query_id", "page_id").agg((-F.sum(part)).alias("r"))


def top_pages(scores: DataFrame, cap: int = 500) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("r", "page_id")
    return scores.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= cap).drop("_i")


def normalized(scores: DataFrame) -> DataFrame:
    """query_id, page_id, text_score: the best of a query's candidates 1, the worst 0; 1 if they hardly differ."""
    w = W.partitionBy("query_id")
    low, high = F.min("r").over(w), F.max("r").over(w)
    score = F.when(high - low < 1e-9, F.lit(1.0)).otherwise((high - F.col("r")) / (high - low))
    return scores.select("query_id", "page_id", score.alias("text_score"))
