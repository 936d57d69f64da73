"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased.  Keys of at least ``min_chars`` code points that several
documents hold stay in the smallest ``doc_id`` only; there all their lines
stay.

The state (:class:`LineRuns`) is a set of runs: Parquet tables of (key hash,
first holder), bucketed by the hash and sorted inside each bucket, so that a
merge join with a batch shuffles and sorts the batch alone.  A batch of
documents merge-anti-joins the runs and adds what is left as a run of level 0;
``fanout`` runs of one level are compacted into one of the next.  Batches come
in rising order of ``doc_id``, hence the first run to hold a key has its
smallest holder.

Keys are told apart by their 128-bit MD5.  A null or empty text is one empty
line.  A null ``doc_id`` holds no key and loses no line.  Rows that share a
``doc_id`` count as one document, and each is returned.  Further columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh_path, is_null, lower_ascii, saved, whole_row

MIN_CHARS = 10
BATCHES = 4
FANOUT = 4
#: A key with more than 1 / HEAVY of all lines is heavy: at most HEAVY of them.
HEAVY = 1000


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, doc_id, copy, pos) of every line long enough; copy tells apart the
    texts that share a doc_id."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    key = lower_ascii(F.btrim("line", F.lit(ASCII_SPACE)))
    return (
        lines.select("doc_id", "copy", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.unhex(F.md5("key")).alias("h"), "doc_id", "copy", "pos")
    )


class LineRuns:
    """Levelled sorted runs of (h, first): a key and its smallest holder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.tag = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"{self.tag}_{self.made}"
        self.made += 1
        keys = keys.repartition(self.buckets, "h")
        keys.write.bucketBy(self.buckets, "h").sortBy("h").option("path", fresh_path(self.spark, name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """Add one batch: ``keys(h, first)``, each key once."""
        for run in self.runs():
            keys = keys.hint("merge").join(run.select("h").hint("merge"), "h", "left_anti")
        self._write(keys, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """All runs of a level become one run of the next; they share no key."""
        names, self.levels[level] = self.levels[level], []
        together = self.spark.table(names[0])
        for name in names[1:]:
            together = together.unionAll(self.spark.table(name))
        self._write(together, level + 1)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def lookup(self) -> DataFrame:
        rows, *more = self.runs()
        for run in more:
            rows = rows.unionAll(run)
        return rows

    def forget(self) -> None:
        """Take the runs out of the catalog."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into ``batches`` parts of rising doc_id."""
    at = [i / batches for i in range(1, batches)]
    if not at:
        return []
    cut = docs.agg(F.percentile_approx("doc_id", at, 1000).alias("at")).first()["at"]
    return sorted(set(cut or []))


def _batch(docs: DataFrame, bounds: list[int], i: int) -> DataFrame:
    if i:
        docs = docs.where(F.col("doc_id") > bounds[i - 1])
    return docs.where(F.col("doc_id") <= bounds[i]) if i < len(bounds) else docs


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, copy, drops): the positions of the lines to drop, for each
    document that loses any.  Written to the shared folder."""
    spark = docs.sparkSession
    bounds = _bounds(docs, batches)
    state = LineRuns(spark, fanout)
    lines = saved(keyed_lines(docs, min_chars), "lines")  # read four times below; a key is 16 bytes
    for i in range(len(bounds) + 1):
        state.add(_batch(lines, bounds, i).groupBy("h").agg(F.min("doc_id").alias("first")))
    known = state.lookup()
    # a very frequent key goes by a broadcast join: at most HEAVY of them exist
    counts = saved(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "line-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") > max(1000, total // HEAVY)).select("h")
    lines = lines.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "h", "left")
    hot = F.broadcast(known.join(F.broadcast(heavy), "h", "left_semi"))
    late = F.col("first") < F.col("doc_id")
    drops = lines.where("heavy").join(hot, "h").where(late).select("doc_id", "copy", "pos")
    drops = drops.unionAll(lines.where("heavy IS NULL").join(known, "h").where(late).select("doc_id", "copy", "pos"))
    out = saved(drops.groupBy("doc_id", "copy").agg(F.collect_set("pos").alias("drops")), "line-drops")
    state.forget()
    return out


def _keep(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for text, positions in zip(texts, drops, strict=True):
        lines = ("" if is_null(text) else text).split("\n")
        gone = set() if positions is None else set(positions)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((len(lines), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept", "kept_sha256"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Per row of ``docs``: ``row``, the whole row as a struct, and n_lines,
    n_dropped, the ``kept`` text and its digest."""
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long"), "text")
    drops = dropped_lines(docs.select(F.col("doc_id").cast("long"), "text"), min_chars, batches, fanout)
    keep = F.pandas_udf(_keep, "n_lines long, n_dropped long, kept string, kept_sha256 string")
    return (
        rows.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit(""))))
        .join(drops, ["doc_id", "copy"], "left")
        .select("row", keep("text", "drops").alias("k"))
        .select("row", "k.*")
    )
