"""Reading trip tables from files or catalog tables with an explicit schema.

Schemas are declared, never inferred: inference costs an extra pass over the
input and can drift between files.  Columns are matched by name: extra ones
are ignored, a missing one raises.  Malformed rows raise, in batch and stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LEGACY_SCHEMA = T.StructType(
    [
        T.StructField("trip_id", T.LongType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("bikeid", T.LongType()),
        T.StructField("tripduration", T.LongType()),
        T.StructField("from_station_id", T.LongType()),
        T.StructField("from_station_name", T.StringType()),
        T.StructField("to_station_id", T.LongType()),
        T.StructField("to_station_name", T.StringType()),
        T.StructField("usertype", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("birthyear", T.LongType()),
    ]
)

MODERN_SCHEMA = T.StructType(
    [
        T.StructField("ride_id", T.StringType()),
        T.StructField("rideable_type", T.StringType()),
        T.StructField("started_at", T.TimestampNTZType()),
        T.StructField("ended_at", T.TimestampNTZType()),
        T.StructField("start_station_name", T.StringType()),
        T.StructField("start_station_id", T.LongType()),
        T.StructField("end_station_name", T.StringType()),
        T.StructField("end_station_id", T.LongType()),
        T.StructField("start_lat", T.DoubleType()),
        T.StructField("start_lng", T.DoubleType()),
        T.StructField("end_lat", T.DoubleType()),
        T.StructField("end_lng", T.DoubleType()),
        T.StructField("member_casual", T.StringType()),
    ]
)

SCHEMAS = {"legacy": LEGACY_SCHEMA, "modern": MODERN_SCHEMA}


#: One set of options for the batch and the stream reader.  The header of every
#: file is checked against the schema, and a malformed row raises.
CSV_OPTIONS = {
    "header": True,
    "enforceSchema": False,
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "nullValue": "NA",
    "mode": "FAILFAST",
}


def file_order_schema(names: list[str], shape: str) -> T.StructType:
    """The declared types of ``shape`` in the order of a file's columns; other
    columns are text.  Raises if a declared column is missing."""
    declared = {f.name: f for f in SCHEMAS[shape]}
    missing = [n for n in declared if n not in names]
    if missing:
        raise ValueError(f"columns missing in the {shape} trip files: {', '.join(missing)}")
    return T.StructType([declared.get(n) or T.StructField(n, T.StringType()) for n in names])


def read_trips_csv(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """CSV with a header row, typed by the declared schema of ``shape``.

    Columns are matched by header name: they may come in another order, and
    extra ones are ignored.  All files of one path must share one header, else
    the read raises.  Timestamps are ``yyyy-MM-dd HH:mm:ss`` as written by
    common exporters.
    """
    names = spark.read.option("header", True).csv(path).columns
    reader = spark.read.schema(file_order_schema(names, shape)).options(**CSV_OPTIONS)
    return reader.csv(path).select(*SCHEMAS[shape].fieldNames())


def read_trips_table(spark: SparkSession, name: str, shape: str) -> DataFrame:
    """A catalog (warehouse) table, projected to the columns of ``shape``."""
    return spark.table(name).select(*SCHEMAS[shape].fieldNames())


def read_trips_parquet(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return spark.read.parquet(path).select(*SCHEMAS[shape].fieldNames())
