"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.runtime import staged


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def half_up(x: Column) -> Column:
    """Rounds half away from zero, as a long."""
    return F.round(x).cast("long")


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with a gapless number from 1 in the order of columns, without gathering rows in one task: rows are
    dealt out by range and numbered within ranges; range offsets are prefix sums of counts."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before, pairs = 0, []
    for k in sorted(counts):
        pairs += [F.lit(k), F.lit(before)]
        before += counts[k]
    row = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    offset = F.element_at(F.create_map(*pairs), F.col("_range")) if pairs else F.lit(0)
    return ranged.withColumn(name, (row + offset).cast("long")).drop("_range")


def nearest_rank(df: DataFrame, keys: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """keys and, for each name in places, the value at index round((n - 1) p) of the group's sorted non-null values.

    Counts of distinct values are dealt out by ranges of keys and values; sums of ranges tell which range of a group
    holds a rank, and running sums are made inside these ranges only. So no list and no task holds a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranged = staged(counts.repartitionByRange(*keys, value).select(F.struct(*keys).alias("_k"), F.col(value).alias("_v"), "_c", F.spark_partition_id().alias("_range")), "ranks")
    w = W.partitionBy("_k")
    sums = ranged.groupBy("_k", "_range").agg(F.sum("_c").alias("_t")).withColumns({"_n": F.sum("_t").over(w), "_before": F.sum("_t").over(w.orderBy("_range")) - F.col("_t")})
    wanted = F.array(*(half_up((F.col("_n") - 1) * F.lit(p)) for p in places.values()))
    held = sums.withColumn("_at", wanted).where(F.exists("_at", lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_t"))))
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy("_k", "_range").orderBy("_v"))
    rows = ranged.join(held, ["_k", "_range"]).withColumn("_upto", upto)
    found = rows.groupBy("_k").agg(*(F.min(F.when((F.col("_upto") > F.get("_at", F.lit(i))) & (F.col("_before") <= F.get("_at", F.lit(i))), F.col("_v"))).alias(name) for i, name in enumerate(places)))
    return found.select("_k.*", *places)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
