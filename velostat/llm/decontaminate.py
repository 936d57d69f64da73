"""Benchmark decontamination by word windows.

A window is ``width`` consecutive words of a benchmark item; a shorter item is
one window.  Texts are lower-cased (A-Z) and words are runs of ASCII letters,
digits and all non-ASCII characters.  The windows are broadcast as a hash set,
whose size is checked first: beyond ``block_words`` benchmark words they go
out in blocks of items, one pass over the documents for each, and the spans of
a document are put together afterwards.  A hash hit is verified against the
words themselves.

A null or empty text has no words and is never contaminated; an item without
words has no window.  Repeated rows are judged alike and each stays; equal
items all count.  A null ``item_id`` has no number and is not reported.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_null, saved, whole_row, window_hashes, word_hashes

WIDTH = 13
#: Benchmark words in one broadcast: some 100 bytes each in a worker.
BLOCK_WORDS = 1_000_000

_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"


def words_of(text) -> list[bytes]:
    return [] if is_null(text) else text.encode().translate(_TO_WORDS).split()


class Windows:
    """The benchmark's windows by width: sorted hashes to look up, and per
    hash the words (to verify a hit) with the items that hold them."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH):
        self.found: dict[int, dict[int, dict[bytes, set[int]]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(width, len(words))
            if not size:
                continue
            by_hash = self.found.setdefault(size, {})
            for start, h in enumerate(window_hashes(word_hashes(words), size).tolist()):
                by_hash.setdefault(h, {}).setdefault(b" ".join(words[start : start + size]), set()).add(item)
        self.hashes = {size: np.array(sorted(x), np.uint64) for size, x in self.found.items()}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) word spans inside windows, and their items."""
        spans, items = [], set()
        own = word_hashes(words)
        for size, known in self.hashes.items():
            found = window_hashes(own, size)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for start in np.nonzero(known[at] == found)[0].tolist():
                holders = self.found[size][int(found[start])].get(b" ".join(words[start : start + size]))
                if holders is not None:
                    spans.append((start, start + size))
                    items |= holders
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scanner(windows: Broadcast):
    def scan_texts(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, old, known in zip(texts, before["spans"], before["items"], strict=True):
            words = words_of(text)
            spans, items = windows.value.hits(words)
            spans = merged([*spans, *((x["start"], x["end"]) for x in (() if old is None else old))])
            items.update(() if known is None else known)
            out.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted(items)))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return F.pandas_udf(scan_texts, _HITS)


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """``benchmark`` in pieces of about ``block_words`` words: by a hash of
    the text, so that no piece is larger than its share of many items."""
    size = F.coalesce(F.length("text"), F.lit(0))
    total = benchmark.agg(F.sum((size + 1) / 2)).first()[0] or 0  # words are half the characters at most
    n = int(total // block_words) + 1
    if n == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [benchmark.where(part == i) for i in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``row``, the whole row as a struct, and n_words,
    the merged word spans inside benchmark windows, the sorted ids of the items
    hit.  After each block but the last the rows are written out."""
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    rows = docs.select(whole_row(docs).alias("row"), F.expr("CAST(NULL AS struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<long>>)").alias("hits"))
    for i, block in enumerate(_blocks(benchmark, block_words)):
        windows = Windows([(r["item_id"], r["text"]) for r in block.toLocalIterator()], width)
        rows = (saved(rows, "hits") if i else rows).withColumn(
            "hits", _scanner(spark.sparkContext.broadcast(windows))(F.col("row.text"), F.col("hits"))
        )
    return rows.select("row", "hits.*")


def _without_spans(text: str, spans: list) -> str:
    """The text without the characters of the spans' words and what stands
    between them."""
    raw = text.encode()
    plain = raw.translate(_TO_WORDS)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for span in spans:
        out.append(raw[last : places[span["start"]][0]])
        last = places[span["end"] - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def _clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series(
        [None if is_null(t) else t if s is None or not len(s) else _without_spans(t, s) for t, s in zip(texts, spans, strict=True)],
        dtype=object,
    )


def remove_spans(scanned: DataFrame) -> DataFrame:
    """The scanned rows with ``cleaned``, the text without the hit words."""
    return scanned.withColumn("cleaned", F.pandas_udf(_clean, "string")(F.col("row.text"), F.col("spans")))


def contaminated() -> F.Column:
    """A twentieth of the words, at least one, are in benchmark windows."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def verdicts(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items and the digest of the items beside each scanned row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (
        scanned.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(ids.cast("binary"), 256))
        .withColumn("contaminated", contaminated())
    )
