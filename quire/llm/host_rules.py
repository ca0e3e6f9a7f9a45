"""Host-level quality rules, with built-in functions only.

Rules fail documents; a host's failure rate is shrunk towards the other hosts' by a beta prior
fitted to them by moments; hosts whose shrunken rate is too high lose their documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import staged

#: Java regular expressions: white space that parts words, and a word.
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
#: Strength of a prior where hosts do not differ beyond their sampling.
NO_VARIANCE = 1e12
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more. Hashes of windows tell that there are
    none (equal windows have equal hashes); where there may be some, the windows themselves decide."""

    def covered(p: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(n), lambda a, k: a + F.least(F.lit(n), F.get(p, k) - F.get(p, k - 1)))
        return F.when(F.size(p) > 1, steps).otherwise(F.lit(0))

    def positions(s: Column) -> Column:
        same = lambda k, d: F.get(s, k)["g"].eqNullSafe(F.get(s, k + d)["g"])
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def counted(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        quick = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        exact = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("g"), i.alias("i"))))
        full = let(exact, lambda s: let(positions(s), covered))
        return F.when(F.size(w) < n, F.lit(0)).otherwise(let(quick, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(full)))

    return let(words, counted)


def measured(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, host and the COUNTS of each document's whole text."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select("doc_id", "host", "text", F.array_remove(F.split("text", GAP), "").alias("words"), lines.alias("lines"))
    columns = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words")),
    }
    return rows.select("doc_id", "host", *(c.cast("long").alias(k) for k, c in columns.items()))


def beta_prior(docs: float, fails: float, hosts: float, docs2: float, fails2: float) -> tuple[float, float]:
    """Mean and strength of the prior, from sums over hosts of n documents with x failures: n, x, 1, n * n and x * x / n."""
    m = fails / docs if docs else 0.0
    if not 0 < m < 1:
        return m, NO_VARIANCE
    # the expected weighted square deviation is m (1 - m) ((hosts - 1) + rho * room)
    room = docs - docs2 / docs - (hosts - 1)
    beyond = (fails2 - fails * m) / (m * (1 - m)) - (hosts - 1)
    rho = beyond / room if room > 1e-9 else 0.0
    return m, NO_VARIANCE if rho <= 1e-12 else max(1 / rho - 1, 1e-3)


def host_verdicts(metrics: DataFrame, most_rate: float = 0.5, symbols_per_word: float = 0.1, dup_lines_per_word: float = 0.2, most_broadcast: int = 100_000) -> DataFrame:
    """metrics with base_failed, rule_failed, host_docs, host_rate and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated windows. rule_failed: that,
    or more than symbols_per_word symbols or dup_lines_per_word repeated lines a word. host_rate: the
    host's share of rule_failed, shrunk by a beta prior with the mean of all documents and a strength
    of 1 / rho - 1, where rho is the share of the hosts' variance that their sampling doesn't explain
    (beta-binomial moments, weighted by documents). Where sampling explains all of it, as with hosts
    of one document each, the rate is the mean. kept: not rule_failed, and host_rate is at most most_rate. Hosts hold few columns of counts, and hot hosts are summed before the shuffle. Up to
    most_broadcast hosts (a few MB) go to the documents; more are joined by a shuffle that can split hot ones.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    own = base | (F.col("n_symbols") > symbols_per_word * F.col("n_words")) | (F.col("n_dup_lines") > dup_lines_per_word * F.col("n_words"))
    rows = metrics.withColumns({"base_failed": base, "rule_failed": own})
    hosts = staged(rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("fails")), "hosts")
    sums = hosts.agg(*(F.coalesce(F.sum(x), F.lit(0.0)).cast("double").alias(k) for k, x in {
        "docs": F.col("host_docs"), "fails": F.col("fails"), "hosts": F.lit(1), "docs2": F.col("host_docs").cast("double") * F.col("host_docs"), "fails2": F.col("fails").cast("double") * F.col("fails") / F.col("host_docs"),
    }.items())).first()
    m, strength = beta_prior(**sums.asDict())
    shrunk = (F.col("fails") + m * strength) / (F.col("host_docs") + strength)
    hosts = hosts.select("host", "host_docs", F.round(shrunk, 6).alias("host_rate"))
    few = hosts.limit(most_broadcast + 1).count() <= most_broadcast
    return rows.join(F.broadcast(hosts) if few else hosts, "host").withColumn("kept", ~F.col("rule_failed") & (F.col("host_rate") <= most_rate))


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", most_rate: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, host, COUNTS, base_failed, rule_failed, host_docs, host_rate, kept.

    A null text has no words (and so fails); a null host is the host ''. Repeated rows count each.
    Empty input: no rows. Only doc_id, host and text are read.
    """
    return host_verdicts(staged(measured(docs, host, text), "host-metrics"), most_rate)


def op10_host_rules(spark, sf_dir: str) -> DataFrame:
    return host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM p) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.2 * n_words AS rule_failed
  FROM m),
h AS (SELECT host, count(*) AS host_docs, sum(rule_failed::INT) AS fails FROM f GROUP BY host),
q AS (SELECT sum(host_docs)::DOUBLE AS n, sum(fails)::DOUBLE AS x, count(*)::DOUBLE AS hosts, sum(host_docs::DOUBLE * host_docs) AS n2, sum(fails::DOUBLE * fails / host_docs) AS x2 FROM h),
b AS (SELECT x / n AS m, n - n2 / n - (hosts - 1) AS room, (x2 - x * x / n) / nullif(x / n * (1 - x / n), 0) - (hosts - 1) AS beyond FROM q),
k AS (SELECT m, CASE WHEN m <= 0 OR m >= 1 OR room <= 1e-9 OR beyond / room <= 1e-12 THEN 1e12 ELSE greatest(room / beyond - 1, 1e-3) END AS s FROM b),
z AS (SELECT host, host_docs, round((fails + m * s) / (host_docs + s), 6) AS host_rate FROM h, k)
SELECT doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed, host_docs, host_rate,
       NOT rule_failed AND host_rate <= 0.5 AS kept
FROM f JOIN z USING (host)
"""
