"""Mixing sources to target weights by Poisson replication, with built-in functions only.

A source with share s of all bytes and target weight w gets the mean repetition rate w / s. Each
document's count is drawn from the Poisson distribution of that mean by inverting its distribution
function at a hash of the document and the seed; documents are exploded by their counts and dealt
out globally by a hash of each copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A larger mean is drawn as a sum of independent parts of at most this mean, so exp(-mean) stays normal.
PART = 64.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 hash of the parts: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """array of P(X <= 0), P(X <= 1), ... until beyond 1 - 2**-53."""
    terms = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(terms, start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float = 1.0) -> DataFrame:
    """source, n_bytes, rate: the mean repetition rate of each source, for `total` times the bytes of docs.

    weights: target share of the bytes by source, relative; a source without one gets 0 (none of its
    rows). None: the sources' own bytes to the power alpha. Bytes: UTF-8 of the text plus 1, so that
    empty texts have a share. The table of sources is joined, not broadcast by force.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sizes = docs.groupBy(source.alias("source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("n_bytes"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n_bytes").cast("double"), F.lit(alpha)))
    else:
        pairs = [F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]
        sizes = sizes.withColumn("w", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0))
    all_ = sizes.agg(F.sum("w").alias("w"), F.sum("n_bytes").alias("b")).first()
    w, b = float(all_["w"] or 0), float(all_["b"] or 0)
    rate = F.col("w") / F.lit(w) * F.lit(total * b) / F.col("n_bytes") if w > 0 else F.lit(0.0)
    return sizes.select("source", "n_bytes", rate.alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 17) -> DataFrame:
    """docs' columns plus rate, copies, copy (from 0) and shuffle_key: a row for each copy of a document.

    The count depends on doc_id, the seed and the source's rate only, so repeated rows get equal
    counts. A null text counts as one byte, a null source as the source '', a null doc_id as 'null'.
    Rows whose count is 0 leave. shuffle_key is a hash of doc_id, seed, copy and the row's place in
    docs, so that rows that share a doc_id are dealt out too. Empty input: no rows. Columns of docs
    named rate, copies, copy or shuffle_key are replaced; those of other names, whatever they are, stay.
    """
    made = ("rate", "copies", "copy", "shuffle_key")
    own = [c for c in docs.columns if c.lower() not in made]
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the row travels as one struct, so that no working column can clash with its own
    rows = docs.select(F.struct(*own).alias("packed"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), doc.alias("doc"), F.monotonically_increasing_id().alias("place"))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = rates(docs, weights, alpha, total).select(F.col("source").alias("name"), "rate", parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf"))
    joined = rows.join(F.broadcast(table) if bounded(table) else table, "name")
    draw = lambda k: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), F.col("doc"), k)))
    copies = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda a, k: a + draw(k))
    drawn = joined.withColumn("copies", copies).where("copies > 0")
    copied = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copied.select("packed.*", "rate", "copies", "copy", F.xxhash64(F.lit(seed), "doc", "copy", "place").alias("shuffle_key"))


def bounded(table: DataFrame, most: int = 10_000) -> bool:
    """Whether the table has at most `most` rows, and so may be broadcast; others are joined by a shuffle."""
    return table.select("name").limit(most + 1).count() <= most


def shuffled(copied: DataFrame) -> DataFrame:
    """Rows dealt out by the hash of each copy and put in its order: a global shuffle that repeats exactly."""
    return copied.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op5_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    copied = replicate(docs)
    return shuffled(copied.select("doc_id", "source", F.round("rate", 9).alias("rate"), "copies", "copy", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shuffle_key")).drop("shuffle_key")


OP5_SQL = """
WITH s AS (SELECT coalesce(source, '') AS source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS b FROM documents GROUP BY 1),
r AS (SELECT source, pow(b, 0.5) / sum(pow(b, 0.5)) OVER () * sum(b) OVER () / b AS rate FROM s),
k AS (SELECT source, rate, greatest(ceil(rate / 64), 1)::INT AS parts FROM r),
c AS (SELECT source, j, exp(j * ln(rate / parts) - rate / parts - lgamma(j + 1)) AS p
      FROM (SELECT *, unnest(generate_series(0, ceil(rate / parts + 12 * sqrt(rate / parts) + 24)::BIGINT)) AS j FROM k)),
f AS (SELECT source, list(cdf ORDER BY j) AS cdf FROM (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS cdf FROM c) GROUP BY source),
d AS (SELECT doc_id, coalesce(documents.source, '') AS source, strlen(coalesce(text, '')) AS n_bytes, rate, cdf,
             list_transform(generate_series(0, parts - 1), lambda i: ('0x' || substr(md5('17:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0) AS u
      FROM documents JOIN k ON k.source = coalesce(documents.source, '') JOIN f ON f.source = k.source),
n AS (SELECT doc_id, source, n_bytes, rate, list_sum(list_transform(u, lambda x: len(list_filter(cdf, lambda y: y <= x))))::INT AS copies FROM d)
SELECT doc_id, source, round(rate, 9) AS rate, copies, unnest(generate_series(0, copies - 1))::INT AS copy, n_bytes::BIGINT AS n_bytes FROM n WHERE copies > 0
"""
