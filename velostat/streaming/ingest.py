"""Append newly arrived trip files to the canonical trip table.

The original analysis reads finished files only, so there is no windowed
or stateful streaming logic to rebuild.  Normalisation and feature
derivation are per-row, so the same operators run unchanged on a file
stream: each micro-batch is projected and appended, with exactly-once
bookkeeping in the query's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from velostat import constants as K
from velostat.operators.features import enrich_trips, with_peak_flag
from velostat.operators.normalize import normalize_legacy, normalize_modern, with_year
from velostat.sources.files import CSV_OPTIONS, SCHEMAS


def trip_stream(
    spark: SparkSession, path: str, shape: str, year: int | None = None, fmt: str = "csv",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A streaming DataFrame of canonical, enriched trips from files of one shape.

    CSV files must have the declared columns in the declared order (a stream
    has one schema for files that are not there yet); another header or a
    malformed row fails the micro-batch, and nothing of it is appended."""
    reader = spark.readStream.schema(SCHEMAS[shape])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    raw = reader.format(fmt).load(path)
    if shape == "legacy":
        df, default_year = normalize_legacy(raw), K.LEGACY_YEAR
    elif shape == "modern":
        df, default_year = normalize_modern(raw), K.MODERN_YEAR
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return with_peak_flag(enrich_trips(with_year(df, year if year is not None else default_year)))


def append_trips(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the stream to a parquet table partitioned by ``year``.

    ``available_now`` processes what has arrived and stops (a scheduled
    incremental batch); otherwise the query keeps running.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("year")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out_path)
