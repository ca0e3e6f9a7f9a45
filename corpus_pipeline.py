"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows of docs. All but the last return
docs' columns. Rows are told apart by doc_id and text, so repeated doc_ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.dedup import dedup_exact
from quire.llm.jaccard import BROADCAST_ROWS, jaccard_components, text_hash
from quire.llm.mixing import replicate, shuffled
from quire.llm.packing import pack_documents, with_digests
from quire.llm.quality import with_quality
from quire.runtime import staged


def whole(docs: DataFrame) -> Column:
    """A row of docs as one column, so that no working column of an operator can clash with its own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def chosen_rows(docs: DataFrame, rows: DataFrame, mark: Column) -> DataFrame:
    """docs without the rows that rows (doc_id, mark, repeats, kept) tell to drop, by doc_id and mark (an
    expression of docs); of rows that agree in both and are kept (repeats > 1), one stays.

    The rows to drop are fewer than those to keep, so they are what moves (or is broadcast).
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key")
    told = rows.select(key, "mark", "repeats", "kept")
    marked = docs.select(whole(docs), key, mark.alias("mark"))

    def side(some: DataFrame) -> DataFrame:
        some = some.select("key", "mark")
        return F.broadcast(some) if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else some

    more = told.where("kept and repeats > 1")
    found = marked.join(side(told.where("not kept or repeats > 1")), ["key", "mark"], "left_anti").select("row.*")
    if more.isEmpty():
        return found
    return found.unionByName(marked.join(side(more), ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"]).select("row.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant does not reject (score of at least 0.3)."""
    scored = with_quality(docs.select(whole(docs), "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    found = staged(dedup_exact(docs), "exact")
    each = found.groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.count("*").alias("repeats"), F.max("kept").alias("kept"))
    return chosen_rows(docs, each, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of at least 0.8 over five-word shingles, the one with the smallest doc_id."""
    found = staged(jaccard_components(docs, n=5, num=80, den=100), "near")
    each = found.groupBy("doc_id", F.col("text_hash").alias("mark"), "group_id").agg(F.count("*").alias("repeats"))
    first = staged(each.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "mark")).alias("first")), "near-first")
    told = each.join(first, "group_id", "left").withColumn("kept", F.col("first").isNull() | F.struct("doc_id", "mark").eqNullSafe(F.col("first")))
    # texts without words are alone: all of them stay
    told = told.where("not (group_id is null)").select("doc_id", "mark", "repeats", "kept")
    return chosen_rows(docs, told, text_hash(F.col("text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources have bytes in proportion to the root of their own, dealt out globally."""
    return shuffled(replicate(docs.select(whole(docs), "doc_id", "source", "text"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return with_digests(pack_documents(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("source_mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
