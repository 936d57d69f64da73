"""Session helpers for local runs (tests, bench).  On a cluster the caller's
session and its settings are used as they are."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "velostat") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VELOSTAT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and curated tables.

    This is the shared folder the cluster names in ``spark.checkpoint.dir``.
    Failing that, it is the one the user set with
    ``SparkContext.setCheckpointDir``.  Only when neither exists (local runs,
    tests) is a fresh scratch folder created and set on the context; a
    cluster without either raises, as its nodes share no scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="velostat-ckpt-")
    sc.setCheckpointDir(path)
    return path


_RUN_TAG = uuid.uuid4().hex[:12]


def session_folder(spark: SparkSession) -> str:
    """The folder (under the checkpoint folder) holding this session's
    curated and per-group tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/velostat-{_RUN_TAG}-{id(spark):x}"


def delete_session_folder(spark: SparkSession) -> bool:
    """Delete :func:`session_folder` (only this session's tables) through the
    Hadoop FileSystem of its path, so it works on any shared store."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


#: With some writers open at once, a partitioned write need not sort its rows by
#: partition first.  A task that meets more partition values sorts the rest.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_WRITERS = 4


def save_and_reload(df, name: str, partition_by: tuple[str, ...] = ()):
    """Write ``df`` once as parquet under the checkpoint folder and return a
    scan of it: one job computes it, lineage is cut, and a lost executor
    costs a re-read.  A write that fails raises.  The columns keep the order
    of ``df``; the files' own schema is read, so a folder without data raises
    too instead of being an empty table.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(max(OPEN_WRITERS, int(before))))
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)
    return spark.read.parquet(path).select(*df.columns)
