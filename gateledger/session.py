"""Session defaults and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "gateledger",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: both come
    from the submit command, and AQE coalesces small shuffles at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Key pads appear as literals in plans; keep them out of UI and logs.
        .config("spark.sql.redaction.string.regex", r"X'[0-9A-Fa-f]{128}'|(?i)(36|5c){20,}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating one only for local runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder every executor can reach"
        )
    folder = tempfile.mkdtemp(prefix="gateledger-ckpt-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint that keeps partitions as they are.

    An eager checkpoint evaluates its input twice, once to count and once to
    write; the disk cache in between makes that once.  Losing an executor then
    costs a recomputation of its part, never the result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.DISK_ONLY)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Deal rows out to ``parts`` tasks before a CPU-heavy stage; as they are without a number.

    The caller decides: one small file would otherwise be a single task, while a
    large input has its splits already and needs no shuffle.
    """
    return df if parts is None else df.repartition(parts, *keys)


def fresh_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"


def durable_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back.

    Like ``durable``, but later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
