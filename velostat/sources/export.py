"""Flat tables for a BI tool: type normalisation, snake_case names, and a CSV
sink that publishes a set of tables at once."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snake_case(name: str) -> str:
    """Lower snake_case: non-alphanumerics become ``_``, camelCase is split."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}_{seen[n]}")
        else:
            seen[n] = 1
            out.append(n)
    return out


def bi_prepare(df: DataFrame) -> DataFrame:
    """Booleans → 0/1 INT, dates → ``yyyy-MM-dd``, timestamps →
    ``yyyy-MM-dd HH:mm:ss``; other columns unchanged.  Names → snake_case.

    One projection driven by the schema, so it stays in whole-stage codegen.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c)
    names = _unique([snake_case(f.name) for f in df.schema.fields])
    return df.select(*[c.alias(n) for c, n in zip(cols, names)])


MANIFEST = "_manifest.json"


def write_exports(
    tables: Mapping[str, Callable[[], DataFrame]], out_dir: str, keep: int = 2,
) -> list[str]:
    """Publish the named tables as CSV directories, all of them or none.

    The tables are built and written one after another, in insertion order (a
    table may depend on one built before it), into a folder of this run,
    ``<out_dir>/versions/<run>/<name>``.  Only when all are written, a manifest
    naming them is renamed over ``<out_dir>/_manifest.json`` — one rename of
    one file — and readers (:func:`published`) follow it: they see the whole
    old set or the whole new one.  A failure before that leaves the old
    manifest and its tables as they were, removes this run's folder and raises.
    Versions older than the last ``keep`` are removed after publishing, so that
    a reader of the set before has time to finish.

    Each write is a distributed job (one file per task); NULL is written as
    ``NA``.  Returns the paths written.
    """
    names = [snake_case(n) for n in tables]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"tables of one name: {', '.join(twice)}")
    if keep < 1:
        raise ValueError("keep the published version at least")
    root = out_dir.rstrip("/")
    spark = SparkSession.active()
    before = _read_manifest(spark, root)
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    folder = f"{root}/versions/{version}"
    entries = {}
    try:
        for name, build in zip(names, tables.values()):
            df = bi_prepare(build())
            df.write.option("header", True).option("nullValue", "NA").csv(f"{folder}/{name}")
            entries[name] = {"path": f"versions/{version}/{name}", "columns": df.columns}
        versions = [version, *(before or {}).get("versions", [])]
        _write_manifest(spark, root, {"version": version, "versions": versions[:keep], "tables": entries})
    except BaseException:
        _delete(spark, folder)
        raise
    for old in versions[keep:]:
        _delete(spark, f"{root}/versions/{old}")
    return [f"{root}/{e['path']}" for e in entries.values()]


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """The tables of the published set: name to path.  Empty before the first
    :func:`write_exports`."""
    root = out_dir.rstrip("/")
    return {n: f"{root}/{e['path']}" for n, e in (_read_manifest(spark, root) or {"tables": {}})["tables"].items()}


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _read_manifest(spark: SparkSession, root: str) -> dict | None:
    p, fs = _path(spark, f"{root}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """Write beside the manifest, then rename over it."""
    new, fs = _path(spark, f"{root}/_manifest-{manifest['version']}.tmp")
    stream = fs.create(new, True)
    try:
        stream.write(json.dumps(manifest, indent=1).encode())
    finally:
        stream.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(target), options)
