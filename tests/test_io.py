"""Sources and sinks: CSV scan with a declared schema, BI export, streaming append."""

import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from velostat.operators.normalize import normalize_legacy
from velostat.plans import datasets as D
from velostat.sources import bi_prepare, published, read_trips_csv, snake_case, write_exports
from velostat.streaming import append_trips, trip_stream


def _legacy_csv(spark, folder):
    src = D.legacy_raw(spark, SF_SMALL)
    src.write.mode("overwrite").option("header", True).option("nullValue", "NA").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(folder)
    return src


def test_csv_scan_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="vs-csv-")
    src = _legacy_csv(spark, folder)
    back = read_trips_csv(spark, folder, "legacy")
    assert back.dtypes == src.dtypes
    assert back.count() == src.count()
    assert back.exceptAll(src).count() == 0 and src.exceptAll(back).count() == 0


def test_snake_case_names():
    assert snake_case("Trip Duration (min)") == "trip_duration_min"
    assert snake_case("startTime") == "start_time"
    assert snake_case("2020 share") == "x2020_share"


def test_bi_prepare_types(spark):
    out = bi_prepare(D.trips(spark, SF_SMALL))
    types = dict(out.dtypes)
    assert types["is_peak"] == "int" and types["round_trip"] == "int"
    assert types["start_time"] == "string"
    row = out.where(F.col("round_trip").isNotNull()).select("start_time", "is_peak").first()
    assert len(row.start_time) == 19 and row.is_peak in (0, 1)


def test_write_exports_writes_each_table(spark):
    out = tempfile.mkdtemp(prefix="vs-bi-")
    import __spark_entry__ as E

    q = E.queries()
    tables = {"route ranked": lambda: q["export_route_ranked"](spark, SF_SMALL),
              "kpi summary": lambda: q["route_kpi_summary"](spark, SF_SMALL)}
    paths = write_exports(tables, out)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["route_ranked", "kpi_summary"]
    back = spark.read.option("header", True).csv(paths[1])
    assert back.count() == q["route_kpi_summary"](spark, SF_SMALL).count()


def test_streaming_append_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="vs-stream-in-")
    _legacy_csv(spark, folder)
    out = tempfile.mkdtemp(prefix="vs-stream-out-")
    ckpt = tempfile.mkdtemp(prefix="vs-stream-ckpt-")
    q = append_trips(trip_stream(spark, folder, "legacy", max_files_per_trigger=1), out, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    batch = normalize_legacy(read_trips_csv(spark, folder, "legacy"))
    assert got.count() == batch.count()
    assert got.select("duration_sec").exceptAll(batch.select("duration_sec")).count() == 0


def test_bi_export_registry_writes_every_table(spark):
    from velostat.plans.exports import bi_tables

    out = tempfile.mkdtemp(prefix="vs-bi-all-")
    tables = bi_tables(spark, SF_SMALL)
    paths = write_exports(tables, out)
    assert len(paths) == len(tables) == 15
    paths = published(spark, out)
    assert list(paths) == list(tables)
    n = spark.read.option("header", True).csv(paths["pct_vld_2019"]).count()
    assert n == tables["pct_vld_2019"]().count()


def test_streaming_modern_shape_keeps_valid_trips_only(spark):
    from velostat.operators.normalize import normalize_modern

    folder = tempfile.mkdtemp(prefix="vs-stream-modern-")
    D.modern_raw(spark, SF_SMALL).write.mode("overwrite").option("header", True).option(
        "nullValue", "NA").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(folder)
    out = tempfile.mkdtemp(prefix="vs-stream-modern-out-")
    ckpt = tempfile.mkdtemp(prefix="vs-stream-modern-ckpt-")
    q = append_trips(trip_stream(spark, folder, "modern"), out, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert {r.year for r in got.select("year").distinct().collect()} == {2020}
    assert got.count() == normalize_modern(D.modern_raw(spark, SF_SMALL)).count()


def test_drop_session_tables_removes_only_this_sessions_folder(spark):
    import os

    from velostat.session import session_folder

    D.trips(spark, SF_SMALL).count()
    folder = session_folder(spark).replace("file:", "")
    assert os.path.isdir(folder)
    root = os.path.dirname(folder)
    others = sorted(set(os.listdir(root)) - {os.path.basename(folder)})
    assert D.drop_session_tables(spark)
    assert not os.path.exists(folder)
    assert sorted(set(os.listdir(root)) - {os.path.basename(folder)}) == others
    assert D.trips(spark, SF_SMALL).count() > 0  # rebuilt on next use


def _csv_file(rows):
    import os

    path = os.path.join(tempfile.mkdtemp(prefix="vs-csv-file-"), "trips.csv")
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")
    return path


LEGACY_ROW = {"trip_id": "1", "start_time": "2019-01-01 08:00:00", "end_time": "2019-01-01 08:10:00", "bikeid": "5",
              "tripduration": "600", "from_station_id": "77", "from_station_name": "A", "to_station_id": "8",
              "to_station_name": "B", "usertype": "Subscriber", "gender": "NA", "birthyear": "1980"}


def test_csv_columns_are_matched_by_name_and_extra_ones_ignored(spark):
    names = [*reversed(LEGACY_ROW), "weather"]
    path = _csv_file([",".join(names), ",".join({**LEGACY_ROW, "weather": "rain"}[n] for n in names)])
    df = read_trips_csv(spark, path, "legacy")
    assert df.columns == list(LEGACY_ROW)
    row = df.first()
    assert (row.trip_id, row.bikeid, row.from_station_id, row.gender, row.birthyear) == (1, 5, 77, None, 1980)


def test_csv_missing_column_raises(spark):
    names = [n for n in LEGACY_ROW if n != "bikeid"]
    path = _csv_file([",".join(names), ",".join(LEGACY_ROW[n] for n in names)])
    with pytest.raises(ValueError, match="bikeid"):
        read_trips_csv(spark, path, "legacy")


def test_csv_malformed_row_raises(spark):
    path = _csv_file([",".join(LEGACY_ROW), ",".join({**LEGACY_ROW, "tripduration": "ten"}.values())])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_trips_csv(spark, path, "legacy").collect()


@pytest.mark.parametrize("fault", ["header", "row"])
def test_stream_fails_on_another_header_or_a_malformed_row(spark, fault):
    import os

    names = list(LEGACY_ROW)
    row = dict(LEGACY_ROW)
    if fault == "header":
        i, j = names.index("bikeid"), names.index("from_station_id")
        names[i], names[j] = names[j], names[i]
    else:
        row["start_time"] = "yesterday"
    path = _csv_file([",".join(names), ",".join(row[n] for n in names)])
    out = tempfile.mkdtemp(prefix="vs-stream-bad-out-")
    q = append_trips(trip_stream(spark, os.path.dirname(path), "legacy"), out, tempfile.mkdtemp(prefix="vs-stream-bad-ckpt-"))
    with pytest.raises(Exception):
        q.awaitTermination(120)
    assert not [f for _, _, files in os.walk(out) for f in files if f.endswith(".parquet")]


def test_missing_parquet_column_raises(spark):
    from velostat.sources.fixtures import read_table

    folder = tempfile.mkdtemp(prefix="vs-pq-")
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").drop("c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    with pytest.raises(Exception, match="c_mktsegment"):
        read_table(spark, folder, "customer").collect()


def test_trip_exports_keep_their_own_columns(spark):
    from velostat.plans.exports import bi_tables

    tables = bi_tables(spark, SF_SMALL)
    assert {"bike_id", "gender", "birth"} <= set(tables["trip_2019"]().columns)
    assert {"start_lat", "start_lng", "end_lat", "end_lng"} <= set(tables["trip_2020"]().columns)


def export_set(spark, tag, fail_at=None, n=6):
    def table(i):
        if i == fail_at:
            # the fault shows only when the table's job runs
            return spark.range(5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("bad row"))).cast("int").alias("v"))
        return spark.createDataFrame([(i, tag)], "i int, tag string")

    return {f"table {i}": (lambda i=i: table(i)) for i in range(n)}


def read_set(spark, out):
    return {n: [tuple(r) for r in spark.read.option("header", True).csv(p).collect()] for n, p in published(spark, out).items()}


def test_a_failed_export_leaves_the_old_set(spark):
    import os

    out = tempfile.mkdtemp(prefix="vs-publish-")
    assert published(spark, out) == {}
    write_exports(export_set(spark, "old"), out)
    old = read_set(spark, out)
    assert old == {f"table_{i}": [(str(i), "old")] for i in range(6)}
    versions = sorted(os.listdir(f"{out}/versions"))
    for fault in (dict(fail_at=5), dict(fail_at=0)):
        with pytest.raises(Exception, match="bad row"):
            write_exports(export_set(spark, "new", **fault), out)
        assert read_set(spark, out) == old and sorted(os.listdir(f"{out}/versions")) == versions
    with pytest.raises(ZeroDivisionError):
        write_exports({**export_set(spark, "new"), "seventh": lambda: 1 / 0}, out)
    assert read_set(spark, out) == old


def test_a_new_export_replaces_the_whole_set_and_keeps_one_before(spark):
    import os

    out = tempfile.mkdtemp(prefix="vs-publish-again-")
    for k, tag in enumerate(["one", "two", "three"]):
        before = published(spark, out)
        write_exports(export_set(spark, tag, n=6 - k), out)
        assert read_set(spark, out) == {f"table_{i}": [(str(i), tag)] for i in range(6 - k)}
        for path in before.values():  # a reader of the set before can finish
            assert spark.read.option("header", True).csv(path).count() == 1
    assert len(os.listdir(f"{out}/versions")) == 2
    assert [f for f in os.listdir(out) if f.endswith(".tmp")] == []
    write_exports(export_set(spark, "four"), out, keep=1)
    assert len(os.listdir(f"{out}/versions")) == 1
    with pytest.raises(ValueError, match="table_1"):
        write_exports({"Table 1": lambda: None, "table_1": lambda: None}, out)


def test_changed_input_files_are_curated_again(spark):
    import shutil

    folder = tempfile.mkdtemp(prefix="vs-inputs-")
    for name in ("lineitem", "orders", "customer"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", folder)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.write.parquet(f"{folder}/events.parquet")
    first = D.trips(spark, folder)
    n = first.where("year = 2020").count()
    assert D.trips(spark, folder) is first
    events.withColumn("event_id", F.col("event_id") + 10_000_019).write.mode("append").parquet(f"{folder}/events.parquet")
    second = D.trips(spark, folder)
    assert second is not first and second.where("year = 2020").count() > n
    assert first.where("year = 2020").count() == n  # a plan handed out keeps its copy
    assert D.trips(spark, folder) is second
    # written again in place: same name and rows, another time
    pq.write_table(pq.read_table(f"{SF_SMALL}/orders.parquet").slice(0, 100), f"{folder}/orders.parquet")
    assert D.legacy_raw(spark, folder).count() < 6000


def test_input_key_of_many_files_follows_names_and_bytes(spark, monkeypatch):
    import shutil

    from velostat.sources import fixtures

    monkeypatch.setattr(fixtures, "LISTED_FILES", 0)
    folder = tempfile.mkdtemp(prefix="vs-keys-")
    for name in ("lineitem", "orders", "customer"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", folder)
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    one = fixtures.input_key(spark, folder)
    assert fixtures.input_key(spark, folder) == one
    events.limit(5).write.mode("append").parquet(f"{folder}/events.parquet")
    assert fixtures.input_key(spark, folder) != one
