"""Periodic runs of words by recompression.

The words of a batch of documents, each document closed by a separator of its
own, are one string of integers.  Recompression rewrites it in levels: blocks
of one repeated symbol become one symbol with its count, then the alphabet is
split in two and every pair of a left symbol followed by a right one becomes
one symbol.  The levels are a run-length grammar of height O(log n).

The grammar answers how far two positions agree, to the right or to the left:
climb while both stand at the edge of a symbol of the next level, stop at the
first symbols that differ, and descend through them to the first words that
differ.  All queries of a batch move together.

Candidates come from a harmonic grid.  A run of period q has at least
L = max(MIN_LENGTH, 2q) words, so some multiple i of L - q has both i and i + q
inside it, and then equal words.  Reaching out from i and i + q in both
directions gives the exact run.  A period that is not the smallest one of its
stretch finds the same stretch, of which the smallest period is kept.

Nulls and empty texts have no words and no runs.  Repeated rows are each
answered.  Other columns are ignored, whatever their names.  An empty table
gives an empty one.  A text is handled whole in one task, with memory in
proportion to it; no row depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_null, mixed, rows_of

#: A run has at least so many words, and at least two periods.
MIN_LENGTH = 12
#: Documents are compressed together up to so many words, longer ones alone.
BATCH_WORDS = 200_000
#: Candidates looked at in one step.
CHUNK = 1 << 20
#: The grammar ends when a level has shrunk so little that scanning it is cheaper.
MAX_LEVELS = 200

_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Level:
    """One level of the grammar.  ``right`` and ``left`` count the equal
    symbols from a place on, itself included, at levels whose blocks are
    compressed next, and are None at the others."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray, blocks: bool):
        self.symbols, self.start = symbols, start
        self.right = self.left = None
        self.parent = self.child = None
        n = len(symbols)
        if blocks:
            edge = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            begin = np.concatenate(([0], edge))
            size = np.diff(np.concatenate((begin, [n])))
            within = np.arange(n) - np.repeat(begin, size)
            self.left = within + 1
            self.right = np.repeat(size, size) - within

    def group(self, first: np.ndarray) -> None:
        """``first`` marks the symbols that begin a symbol of the next level."""
        self.first = first
        self.parent = np.cumsum(first) - 1
        self.last = np.concatenate((first[1:], [True]))
        self.child = {1: np.flatnonzero(first), -1: np.flatnonzero(self.last)}


def _named(keys: np.ndarray, next_name: int) -> tuple[np.ndarray, int]:
    """New symbols for equal keys, from ``next_name`` on."""
    codes, kinds = pd.factorize(keys)
    return codes.astype(np.int64) + next_name, next_name + len(kinds)


def grammar(symbols: np.ndarray, n_separators: int) -> list[Level]:
    """Levels of recompression.  Symbols below ``n_separators`` occur once
    each and are never joined to others."""
    levels = []
    start = np.arange(len(symbols), dtype=np.int64)
    name = int(symbols.max(initial=0)) + 1
    least = 2 * n_separators - 1  # a separator between one symbol for each document
    idle = 0
    for step in range(MAX_LEVELS):
        blocks = step % 2 == 0
        level = Level(symbols, start, blocks)
        levels.append(level)
        n = len(symbols)
        if n <= least or idle == 6:
            break
        if blocks:
            first = level.left == 1
            head = np.flatnonzero(first)
            size = level.right[head]
            symbols = symbols[head]
            many = np.flatnonzero(size > 1)
            symbols[many], name = _named(symbols[many] * (n + 1) + size[many], name)
        else:
            free = symbols >= n_separators
            side = (mixed(symbols.astype(np.uint64) + np.uint64(step << 40)) & np.uint64(1)).astype(bool)
            a, b = side[:-1], side[1:]
            both = free[:-1] & free[1:]
            forward, backward = both & a & ~b, both & ~a & b
            pair = forward if forward.sum() >= backward.sum() else backward
            first = np.concatenate(([True], ~pair))
            head = np.flatnonzero(first)
            at = np.flatnonzero(pair)
            place = np.cumsum(first) - 1
            joined = symbols[head]
            joined[place[at]], name = _named(symbols[at] * name + symbols[at + 1], name)
            symbols = joined
        level.group(first)
        start = start[head]
        idle = idle + 1 if len(symbols) == n else 0
    return levels


def agreement(levels: list[Level], x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from ``x`` and ``y`` on (``x < y``), to the right
    (``way`` 1, both places included) or to the left (-1)."""
    ix, iy = x.astype(np.int64), y.astype(np.int64)
    met = np.full(len(ix), -1)
    going = np.arange(len(ix))

    def advance(level: Level, rows: np.ndarray) -> np.ndarray:
        """Step over equal symbols once; the rows whose symbols were equal."""
        rows = rows[level.symbols[ix[rows]] == level.symbols[iy[rows]]]
        rest = level.right if way == 1 else level.left
        by = way if rest is None else way * np.minimum(rest[ix[rows]], rest[iy[rows]])
        ix[rows] += by
        iy[rows] += by
        return rows

    for depth, level in enumerate(levels):
        if not len(going):
            break
        waiting, risen = going, []
        while len(waiting):
            if level.parent is not None:
                edge = level.first if way == 1 else level.last
                up = edge[ix[waiting]] & edge[iy[waiting]]
                risen.append(waiting[up])
                waiting = waiting[~up]
            met[waiting] = depth
            waiting = advance(level, waiting)
            met[waiting] = -1
        if level.parent is None:
            break
        going = np.concatenate(risen) if risen else going[:0]
        ix[going], iy[going] = level.parent[ix[going]], level.parent[iy[going]]
    for depth in range(int(met.max(initial=0)), 0, -1):
        rows = np.flatnonzero(met == depth)
        child = levels[depth - 1].child[way]
        ix[rows], iy[rows] = child[ix[rows]], child[iy[rows]]
        met[rows] = depth - 1
        while len(rows):
            rows = advance(levels[depth - 1], rows)
    return (ix - x) * way


def grid(sizes: np.ndarray, least: int = MIN_LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (document, place, period): the harmonic grid of documents of
    ``sizes`` words.  A document is split between chunks where it is long."""
    held = 0
    docs, periods, steps, counts = [], [], [], []

    def chunk():
        d, q, s, c = (np.concatenate(a) for a in (docs, periods, steps, counts))
        at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        return np.repeat(d, c), at * np.repeat(s, c), np.repeat(q, c)

    for doc, n in enumerate(sizes.tolist()):
        if n < least:
            continue
        q = np.arange(1, n // 2 + 1)
        step = np.maximum(least, 2 * q) - q
        count = (n - q - 1) // step + 1  # places i with i + q < n
        cuts = np.searchsorted(np.cumsum(count), np.arange(CHUNK, int(count.sum()), CHUNK))
        for part in np.split(np.arange(len(q)), np.unique(cuts)):
            if len(part):
                docs.append(np.full(len(part), doc))
                periods.append(q[part])
                steps.append(step[part])
                counts.append(count[part])
                held += int(count[part].sum())
                if held >= CHUNK:
                    yield chunk()
                    held = 0
                    docs, periods, steps, counts = [], [], [], []
    if held:
        yield chunk()


def runs_of(texts: list[np.ndarray], least: int = MIN_LENGTH) -> list[np.ndarray]:
    """Per sequence of word numbers (from 0), its maximal runs as rows of
    start, length and smallest period, ordered by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n_separators = len(texts) + 1
    string = np.empty(int(sizes.sum()) + n_separators, np.int64)
    base = np.cumsum(sizes + 1) - sizes  # of the first word of each
    string[0] = 0
    for i, (text, at) in enumerate(zip(texts, base.tolist(), strict=True)):
        string[at : at + len(text)] = text + n_separators
        string[at + len(text)] = i + 1
    levels, found = None, []
    for doc, place, period in grid(sizes, least):
        x = base[doc] + place
        hit = np.flatnonzero(string[x] == string[x + period])
        if not len(hit):
            continue
        doc, x, period = doc[hit], x[hit], period[hit]
        if levels is None:
            levels = grammar(string, n_separators)
        right = agreement(levels, x, x + period, 1)
        # a candidate too short even with everything to its left is no run
        able = np.flatnonzero(x - base[doc] + right + period >= np.maximum(least, 2 * period))
        doc, x, period, right = doc[able], x[able], period[able], right[able]
        left = agreement(levels, x - 1, x + period - 1, -1)
        length = left + right + period
        real = length >= np.maximum(least, 2 * period)
        rows = np.stack((doc, x - left - base[doc], length, period), 1)[real]
        found.append(np.unique(rows, axis=0))
    out = [np.empty((0, 3), np.int64)] * len(texts)
    rows = np.unique(np.concatenate(found), axis=0) if found else ()  # by document, start, length, period
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows = rows[new]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        which, begin = np.unique(rows[:, 0], return_index=True)
        for doc, part in zip(which.tolist(), np.split(rows, begin[1:]), strict=True):
            out[doc] = part[:, 1:]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:n]) == 0


def _answers(ids: list, words: list[list[bytes]], least: int) -> pd.DataFrame:
    names: dict[bytes, int] = {}
    name = names.setdefault
    numbered = [np.fromiter((name(w, len(names)) for w in own), np.int64, len(own)) for own in words]
    runs = runs_of(numbered, least)
    texts = []
    for own, found in zip(words, runs, strict=True):
        if len(found):
            own = [w for w, keep in zip(own, kept_words(len(own), found).tolist(), strict=True) if keep]
        texts.append(b" ".join(own).decode())
    spans = [[{"start": s, "length": n, "period": q} for s, n, q in found.tolist()] for found in runs]
    out = pd.DataFrame({"doc_id": ids, "n_words": [len(w) for w in words], "runs": spans, "collapsed": texts})
    return out.astype({"doc_id": "Int64"})


def find_runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_words, the maximal runs of at
    least ``least`` words and two periods (start, length, smallest period;
    ordered by start, then period), and the text ``collapsed`` to the words
    that no run repeats, joined by one space.  Words are what ASCII white
    space separates."""
    if least < 2:
        raise ValueError("a run has two words at least")

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(frames, "doc_id", "text"):
            ids, words, held = [], [], 0
            for doc, text in rows:
                own = [] if is_null(text) else text.encode().split()
                if ids and held + len(own) > BATCH_WORDS:
                    yield _answers(ids, words, least)
                    ids, words, held = [], [], 0
                ids.append(None if is_null(doc) else int(doc))
                words.append(own)
                held += len(own)
            if ids:
                yield _answers(ids, words, least)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(answer, _SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where about one document in ten becomes periodic
    from some word on: with h = crc32(doc_id as text) a multiple of 10, g =
    floor(h / 10) and n words, each word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)), and the words are
    joined by a space.  Other texts, and rows without an id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("__h"), F.when(h % 10 == 0, words).alias("__w"))
    rows = rows.withColumns({"__n": F.size("__w"), "__g": F.floor(F.col("__h") / 10)})
    a = F.expr("CAST(try_mod(__g, __n) AS INT)")
    rows = rows.withColumn("__a", a).withColumn("__p", F.expr("CAST(1 + (__n - __a) div (3 + __g % 8) AS INT)"))
    planted = F.expr("array_join(transform(__w, (w, i) -> IF(i >= __a, __w[__a + (i - __a) % __p], w)), ' ')")
    return rows.select("doc_id", F.when((F.col("__h") % 10 == 0) & (F.col("__n") > 0), planted).otherwise(F.col("text")).alias("text"))
