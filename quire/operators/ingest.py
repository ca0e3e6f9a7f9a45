"""Scans, file classes, change decisions and the imposition filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Settings
from quire.functions.common import let


def classify(path: Column) -> Column:
    """'pdf' or 'ai' by the extension, in any case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("pdf", "ai"), ext)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def below(path: Column, root: Column) -> Column:
    """Segments of a path below a root: 1 for files directly in it."""
    rest = F.regexp_replace(F.substr(path, F.length(root) + 1), r"^[/\\]+", "")
    return F.size(F.split(rest, r"[/\\]+"))


def scan_directories(spark: SparkSession, roots: list[str], depth: int | None = 3, content: bool = False) -> DataFrame:
    """path, filename, file_type, file_size, modified_at (and content_sha1) of pdf and ai files up to `depth`
    segments below a root (None: any). Missing roots are skipped. Contents are read only if a hash is wanted."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    schema = "path string, filename string, file_type string, file_size long, modified_at long, content_sha1 string"
    out = spark.createDataFrame([], schema)
    for root in roots:
        place = jvm.org.apache.hadoop.fs.Path(root)
        fs = place.getFileSystem(hadoop)
        if not fs.exists(place):
            continue
        base = fs.makeQualified(place).toString()
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = files.withColumns({"_root": F.lit(base), "file_type": classify(F.col("path"))})
        files = files.where("file_type is not null")
        if depth is not None:
            files = files.where(below(F.regexp_replace("path", "^file:/+", "/"), F.regexp_replace("_root", "^file:/+", "/")) <= min(depth, 32))
        digest = F.sha1("content") if content else F.lit(None).cast("string")
        out = out.unionByName(files.select("path", file_name(F.col("path")).alias("filename"), "file_type", F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("modified_at"), digest.alias("content_sha1")))
    return out.dropDuplicates(["path"])


def needs_reindex(mtime: Column, stamp: Column) -> Column:
    return F.when(stamp.isNull(), True).otherwise(F.coalesce(mtime > stamp, F.lit(False)))


def change_decisions(scan: DataFrame, files: DataFrame, s: Settings = Settings()) -> DataFrame:
    """path, action for each scanned file (path, modified_at, content_sha1) against the known files.

    In order: blacklisted by crashes; up to date; excluded and unchanged; same bytes ('refresh');
    changed; new. The hash column should be computed only where a plan needs it.
    """
    known = files.select("path", "id", "is_excluded", "indexed_at", "crash_attempts", F.col("modified_at").alias("_known_at"), F.col("content_sha1").alias("_known_sha1"))
    both = scan.join(known, "path", "left")
    same = (F.col("content_sha1") == F.col("_known_sha1")) & F.col("indexed_at").isNotNull()
    action = (
        F.when(F.col("id").isNull(), "index_new")
        .when((F.col("crash_attempts") >= s.crash_limit) & (F.col("is_excluded") == 0), "skip_and_exclude")
        .when(F.col("crash_attempts") >= s.crash_limit, "skip_blacklisted")
        .when(~needs_reindex(F.col("modified_at"), F.col("indexed_at")), "up_to_date")
        .when((F.col("is_excluded") == 1) & F.coalesce(F.col("modified_at") <= F.col("_known_at"), F.lit(False)), "skip_excluded")
        .when(F.coalesce(same, F.lit(False)), "refresh")
        .otherwise("reindex")
    )
    return both.select("path", action.alias("action"))


def hash_gate(ready: DataFrame, files: DataFrame) -> DataFrame:
    """path, unchanged: whether a settled file has the bytes that are indexed (its metadata is then upserted only).
    A null hash, of an unreadable file, is told by unchanged being null (to be queued again)."""
    known = files.select("path", F.col("content_sha1").alias("_sha1"), "indexed_at")
    same = F.coalesce((F.col("content_sha1") == F.col("_sha1")) & F.col("indexed_at").isNotNull(), F.lit(False))
    return ready.join(known, "path", "left").select("path", F.when(F.col("content_sha1").isNotNull(), same).alias("unchanged"))


def _after(text: Column, mark: str) -> Column:
    return let(text, lambda t: F.when(F.instr(t, mark) > 0, F.substr(t, F.instr(t, mark) + len(mark))))


def _until(text: Column, mark: str) -> Column:
    return let(text, lambda t: F.when(F.instr(t, mark) > 0, F.substr(t, F.lit(1), F.instr(t, mark) - 1)))


def list_items(content: Column) -> Column:
    """Contents of list elements. A plain element ahead goes before those with attributes that precede it."""
    plain = lambda c: F.regexp_extract_all(c, F.lit(r"(?s)<rdf:li>(.*?)</rdf:li>"), 1)
    rest = lambda c: F.regexp_replace(c, r"(?s)^.*<rdf:li>.*?</rdf:li>", "")
    others = lambda r: F.regexp_extract_all(r, F.lit(r"(?s)<rdf:li [^>]*>(.*?)</rdf:li>"), 1)
    left = lambda c: let(rest(c), lambda r: F.when(F.instr(r, "<rdf:li>") > 0, F.array().cast("array<string>")).otherwise(others(r)))
    return let(content, lambda c: F.concat(plain(c), left(c)))


def is_imposition(content: Column) -> Column:
    """Whether a file's text (ISO-8859-1) has a packet of metadata that links a PDF by no relative path."""
    packet = _until(let(content, lambda t: F.when(F.instr(t, "<?xpacket begin=") > 0, F.substr(t, F.instr(t, "<?xpacket begin=")))), "<?xpacket end=")
    inner = _until(_after(_after(packet, "<egExtFL:files"), ">"), "</egExtFL:files>")

    def external(item: Column) -> Column:
        low = F.lower(item)
        start = F.regexp_replace(low, r"^[ \t\n\f\r]+", "")
        return F.contains(low, F.lit(".pdf")) & ~F.startswith(start, F.lit("<stref:instanceid>file:./")) & ~F.startswith(start, F.lit("<stref:instanceid>file:../"))

    return F.coalesce(F.exists(list_items(inner), external), F.lit(False))


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def attempt_ledger(attempts: DataFrame, limit: int = 2) -> DataFrame:
    """file_id, crash_attempts, blacklisted: tries since the last handled outcome (ok, error, excluded)."""
    last = attempts.where(F.col("outcome") != "crash").groupBy("file_id").agg(F.max("seq").alias("_last"))
    counted = attempts.join(last, "file_id", "left").groupBy("file_id").agg(F.count_if((F.col("outcome") == "crash") & (F.col("seq") > F.coalesce("_last", F.lit(-1)))).alias("crash_attempts"))
    return counted.withColumn("blacklisted", F.col("crash_attempts") >= limit)


#: Mappings of path prefixes, a table kept by hand.
MOST_MAPPINGS = 10_000


def mapped_path(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """paths (path) with mapped: the first prefix of mappings (seq, server, client) that a path starts with is replaced."""
    slash = lambda x: F.when(x.rlike(r"[\\/]$"), x).otherwise(F.concat(x, F.lit("\\")))
    if mappings.limit(MOST_MAPPINGS + 1).count() > MOST_MAPPINGS:
        raise ValueError(f"more than {MOST_MAPPINGS} mappings of paths")
    hit = paths.select("path").distinct().join(F.broadcast(mappings), F.startswith("path", "server"))
    first = hit.groupBy("path").agg(F.min(F.struct("seq", "server", "client")).alias("m"))
    new = F.concat(slash(F.col("m.client")), F.substr("path", F.length(slash(F.col("m.server"))) + 1))
    return paths.join(first, "path", "left").select("path", F.when(F.col("m").isNull(), F.col("path")).otherwise(new).alias("mapped"))
