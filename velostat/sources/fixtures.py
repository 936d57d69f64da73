"""Trip tables in the two source shapes, derived from the shared test tables.

The legacy ("2019") shape is ``lineitem ⋈ orders ⋈ customer``; the modern
("2020") shape is ``events``.  The derivation rules are fixed values: they
define the fixture, and the DuckDB oracle writes the same arithmetic.

Only the columns each derivation needs are selected, so the parquet scans
are pruned; the joins are plain equi-joins that Catalyst/AQE plan (sort-merge
at scale, broadcast when a side is small at runtime).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velostat.functions import add_seconds

SPREAD_CONF = "velostat.scan.partitions"

# Columns (and their types) the derivations read from each test table.  The
# files' own schema is read, so that a column that is missing raises instead of
# reading as NULL; the scan is limited to these columns.
SOURCE_COLUMNS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name not in SOURCE_COLUMNS:
        return df
    columns = [c.split() for c in SOURCE_COLUMNS[name].split(", ")]
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])


# files of one table whose sizes and times are looked at one by one
LISTED_FILES = 1000


def input_key(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the input files behind the two sources: it changes when a
    file of theirs is added, removed or written again.

    Per table the listing gives each file's path, length and modification
    time.  A table of more than ``LISTED_FILES`` files is described by the
    number, names and total length of its files, which the JVM adds up in one
    call each (names of written parts are unique).  No job runs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def status(path: str):
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).getFileStatus(p)

    parts = []
    for name in SOURCE_COLUMNS:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        at = status(path)
        if at.isFile():
            parts.append((path, at.getLen(), at.getModificationTime()))
            continue
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        listed = listed._jdf.queryExecution().analyzed().relation().location()
        files = listed.allFiles()
        if files.size() > LISTED_FILES:
            parts.append((path, files.size(), files.hashCode(), listed.sizeInBytes()))
            continue
        found = [files.apply(i) for i in range(files.size())]
        parts.extend(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def spread(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a pruned scan over ``velostat.scan.partitions`` tasks when
    that setting is given (unset by default).

    Meant for inputs that cannot be split — e.g. one parquet file holding a
    single row group, which the scan reads in one task.  Large inputs of many
    files/row groups are split by the scan itself and must not set it.
    Hash partitioning on a key (not round-robin) needs no pre-sort to stay
    deterministic when a task is retried.
    """
    n = int(spark.conf.get(SPREAD_CONF, "0") or 0)
    return df.repartition(n, key) if n > 0 else df


def _station_name(station_id):
    return F.concat(F.lit("Station "), station_id.cast("string"))


def legacy_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy trip table: one row per line item, rider fields from the customer."""
    li = spread(spark, read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    ), "l_orderkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # the smaller tables first, so that the line items are shuffled once at most
    riders = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    j = li.join(riders, li.l_orderkey == riders.o_orderkey)

    # fixed values: fixture derivation rules
    offset = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 613) % 86400
    dur = F.floor(F.col("l_extendedprice") / 50).cast("bigint") * F.when(
        F.col("l_partkey") % 40 == 0, F.lit(20)
    ).otherwise(F.lit(1))
    drift = F.when(F.col("l_orderkey") % 1000 == 0, F.lit(90)).otherwise(F.lit(0))
    start = add_seconds("l_shipdate", offset)
    from_id = F.col("l_suppkey") % 50 + 1
    to_id = F.col("l_partkey") % 50 + 1
    custkey = F.col("c_custkey")
    usertype = (
        F.when(custkey % 211 == 0, F.lit("Dependent"))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("Customer"))
        .otherwise(F.lit("Subscriber"))
    )
    gender = F.when(custkey % 13 == 0, F.lit(None).cast("string")).when(
        custkey % 2 == 0, F.lit("Male")
    ).otherwise(F.lit("Female"))
    birth = (
        F.when(custkey % 17 == 0, F.lit(None).cast("bigint"))
        .when(custkey % 97 == 0, F.lit(1890).cast("bigint"))
        .otherwise(F.lit(1930) + custkey % 80)
    )
    staged = j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"),
        start.alias("start_time"),
        dur.alias("tripduration"),
        drift.alias("_drift"),
        F.col("l_partkey").alias("bikeid"),
        from_id.alias("from_station_id"),
        to_id.alias("to_station_id"),
        usertype.alias("usertype"),
        gender.alias("gender"),
        birth.alias("birthyear"),
    )
    return staged.select(
        "trip_id",
        "start_time",
        add_seconds("start_time", F.col("tripduration") + F.col("_drift")).alias("end_time"),
        "bikeid",
        "tripduration",
        "from_station_id",
        _station_name(F.col("from_station_id")).alias("from_station_name"),
        "to_station_id",
        _station_name(F.col("to_station_id")).alias("to_station_name"),
        "usertype",
        "gender",
        "birthyear",
    )


def modern_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modern trip table: one row per event (a single scan, no join)."""
    ev = spread(spark, read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", "props"
    ), "event_id")
    # fixed values: fixture derivation rules
    shift = F.when(F.col("event_id") % 500 == 0, F.lit(-60).cast("bigint")).otherwise(
        F.floor(F.col("value") * 60).cast("bigint")
    )
    k = F.regexp_extract(F.col("props"), "[0-9]+", 0).cast("bigint")
    start_id = F.col("user_id") % 50 + 1
    end_id = F.when(F.col("event_id") % 997 == 0, F.lit(None).cast("bigint")).otherwise(k % 50 + 1)
    staged = ev.select(
        F.concat(F.lit("R"), F.col("event_id").cast("string")).alias("ride_id"),
        F.lit("docked_bike").alias("rideable_type"),
        F.col("ts").alias("started_at"),
        add_seconds("ts", shift).alias("ended_at"),
        start_id.alias("start_station_id"),
        end_id.alias("end_station_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("casual"))
        .otherwise(F.lit("member"))
        .alias("member_casual"),
    )
    lat0, lng0, step = F.lit(41.8).cast("double"), F.lit(-87.6).cast("double"), F.lit(0.001).cast("double")
    s, e = F.col("start_station_id"), F.col("end_station_id")
    return staged.select(
        "ride_id",
        "rideable_type",
        "started_at",
        "ended_at",
        _station_name(s).alias("start_station_name"),
        "start_station_id",
        _station_name(e).alias("end_station_name"),
        "end_station_id",
        (lat0 + s * step).alias("start_lat"),
        (lng0 - s * step).alias("start_lng"),
        (lat0 + e * step).alias("end_lat"),
        (lng0 - e * step).alias("end_lng"),
        "member_casual",
    )
