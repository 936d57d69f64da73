"""What the operators of this package share: reading tables, intermediate
tables in the shared folder, and words and hashes inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words: space, \t, \n, \v, \f, \r.  ``bytes.split()``
#: splits on exactly these.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``,
    or the context's checkpoint folder.  Only a local session without either
    (tests) gets a scratch folder of its own; a cluster without one raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="velostat-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/velostat-llm/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a written table's job go when it ends, not when the driver
#: next collects garbage.  The table is read from its files only.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the
    lineage is cut, and a lost executor costs a read of the file again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """How many parts hold ``size`` bytes or items, ``each`` in one, and at
    least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


#: A key with more than one of so many rows is hot.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n_rows: int, count: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row for each value of
    ``key``), whatever share of the ``n_rows`` rows one value has: values of
    more than one in HOT_SHARE rows, of which there are fewer than HOT_SHARE,
    are joined by broadcast, the others by what AQE measures.  ``count`` names
    a column of ``table`` that says how many rows a value has; without one they
    are counted.  ``rows`` is read two or three times and best a saved table."""
    if count is None:
        often = rows.groupBy(key).count().where(F.col("count") * HOT_SHARE > n_rows).select(key)
        hot = table.join(often, key, "left_semi")
    else:
        hot = table.where(F.col(count) * HOT_SHARE > n_rows)
    met = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    rest = met.where("__hot IS NULL").select(*rows.columns).join(table, key)
    return met.where("__hot").drop("__hot").unionByName(rest)


#: Ids (of 8 bytes) that may be broadcast.
BROADCAST_IDS = 2_000_000


def of_ids(ids: DataFrame) -> DataFrame:
    """A saved table of one long column, to filter rows by: marked for
    broadcast if it has at most BROADCAST_IDS rows (16 MB of ids), else left to
    be joined by what AQE measures."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove one of this package's own intermediate tables."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def deleted(df: DataFrame) -> None:
    """Remove a table that :func:`saved` wrote, once nothing reads it again."""
    files = df.inputFiles()
    if files:
        delete_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def whole_row(docs: DataFrame) -> F.Column:
    """All columns, whatever their names, as one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def lower_ascii(column):
    """A-Z to a-z, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def rows_of(frames: Iterable[pd.DataFrame], *columns: str) -> Iterator[list]:
    """Per Arrow batch, the named columns zipped into a list of tuples."""
    for frame in frames:
        yield list(zip(*(frame[c].tolist() for c in columns), strict=True))


def is_null(value) -> bool:
    return value is None or value is pd.NA or value != value


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the finalizer of
    splitmix64), so that any of their bits can be used as a hash."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out)


def compressed(raw: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def packed(text: str, level: int = 1) -> F.Column:
    """A text compressed, to shuffle half the bytes; null is empty."""

    def pack(texts: pd.Series) -> pd.Series:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        return pd.Series([packer.compress(b"" if is_null(t) else t.encode()) for t in texts], dtype=object)

    return F.pandas_udf(pack, "binary")(text)
