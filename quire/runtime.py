"""Session helpers: the shared staging folder and staged (materialised) tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where one process is the whole engine (master local) may it be unset:
    a local folder then serves; elsewhere that is an error, as no executor sees another's folders."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="quire-shared-")
    return f"file://{_LOCAL_DIRS[app]}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/quire-staged/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Rows of texts that a worker, the JVM or a Parquet reader should hold at once.
TEXT_ROWS = 1_000


def bound_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the session's Arrow and Parquet batches to at most `rows` rows: texts are long, and the JVM, its
    column vectors and the Python workers hold whole batches."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        now = int(spark.conf.get(key))
        if now <= 0 or now > rows:
            spark.conf.set(key, rows)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str, free: bool = False, **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage so that lost executors
    cost a reread, and lets several consumers use one computation. Removed when the JVM ends.
    With free, the shuffle files that df needed go at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/quire-staged/" in name}:
        target = jvm.org.apache.hadoop.fs.Path(parent)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
