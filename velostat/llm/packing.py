"""Packing by a configuration linear program.

A document is the ids of its text followed by an end id; one longer than the
capacity is cut into pieces of exactly that length, the last one possibly
shorter.  Only the histogram of piece lengths, at most ``capacity`` rows, goes
to the driver.  There the configuration program (cover every length's count by
configurations, as few as possible) is solved by multiplicative weights: both
its uses and its prices are weights that a round multiplies, a knapsack dynamic
program finds the most valuable configuration at the current prices, and the
value at those prices bounds the number of sequences from below.  Averaged
uses within ``TOLERANCE`` of the bound are rounded down, and the rest is
covered in whole uses at the program's prices.  The result is a bounded list
of (configuration, how often), and a join deals the pieces to places.

A null or empty text is the end id alone.  Repeated rows are packed each, and
so are rows without a ``doc_id``.  An empty table gives an empty one.  Further
columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import is_null, rows_of, saved

CAPACITY = 4096
END = 1
#: How slowly covered lengths get cheap; configurations of one round, and by how
#: much the others may be worth less than its best.
EPSILON, TOGETHER, NEAR = 30.0, 32, 0.001
#: The program is solved to this share of its bound, in so many pricings and
#: multiplications at most, with steps of this rate at first.
TOLERANCE, PRICINGS, WORK, RATE = 0.002, 60, 1 << 25, 0.5
#: Word ids that a worker remembers; it starts anew beyond that.
REMEMBERED = 600_000
#: Pieces that one task numbers, about.
NUMBERED = 1_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids of texts by a tokenizer that lower-cases, drops white space and
    parts letters from marks: each stretch without ASCII white space, cut
    before a mark that follows an ASCII letter, is encoded once and remembered.

    A stretch of ASCII letters alone goes straight to the tokenizer's model,
    unless the steps before the model change such a stretch."""

    #: The mark comes first: a search for marks is faster than one for places.
    MARK = re.compile(rb"[!-/:-@\[-`{-~](?<=[a-z].)")
    #: How the tokenizer's special tokens begin; they are found in raw texts.
    SPECIAL = b"<|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        normalizer, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        normal = normalizer.normalize_str(ascii_lowercase) if normalizer else ascii_lowercase
        self.straight = [x for x, _ in pre.pre_tokenize_str(normal)] == [ascii_lowercase] if pre else False

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if self.straight and word.isalpha():
            ids = [t.id for t in self.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def words(self, text: str) -> list[bytes]:
        return self.MARK.sub(rb" \g<0>", text.encode().lower()).split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        special = self.SPECIAL.decode()
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            if special in t
            else b"".join(map(self.__getitem__, self.words(t)))
            for t in texts
        ]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def pieces_of(ids: bytes, capacity: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    ids += np.array([end], "<u4").tobytes()
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def token_pieces(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document.  ``tokenizer`` is a file's path, or a
    function that finds it on the executor."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(tokenizer() if callable(tokenizer) else tokenizer)
        for rows in rows_of(frames, "doc_id", "text"):
            out = []
            ids = ids_of(["" if is_null(text) else text for _, text in rows])
            for (doc, _), own in zip(rows, ids, strict=True):
                out += [(doc, *x) for x in pieces_of(own, capacity, end)]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, _PIECES)


def best_values(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack program: per room, the highest total price that fits."""
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = prices
    value = np.zeros(capacity + 1)
    for room in range(int(lengths[0]), capacity + 1):
        value[room] = max(value[room - 1], (value[:room] + price[room:0:-1]).max())
    return value


def best_configuration(lengths: np.ndarray, prices: np.ndarray, value: np.ndarray, free: np.ndarray) -> dict[int, int]:
    """A configuration by the knapsack program's values that takes no more of
    a length than are free; of equal choices the longest piece."""
    out: Counter = Counter()
    room = len(value) - 1
    while (fits := np.flatnonzero((free > 0) & (lengths <= room))[::-1]).size:
        best = int(fits[(value[room - lengths[fits]] + prices[fits]).argmax()])
        out[best] += 1
        free[best] -= 1
        room -= int(lengths[best])
    return dict(out)


def priced_rounds(
    size: np.ndarray, have: np.ndarray, capacity: int, weights: np.ndarray | None = None, epsilon: float = EPSILON
) -> list[tuple[dict[int, int], int]]:
    """(configuration by place of length, how often), covering every piece once
    in whole uses.

    A length's price is its ``weights`` (its size) times a factor which each
    use multiplies by exp(-covered share / epsilon): what is covered gets
    cheap.  A round prices the open lengths once and takes up to ``TOGETHER``
    configurations that have no length in common, the best first and others
    while they are worth nearly as much (``NEAR``).  Each is used as many whole
    times as its scarcest length lasts.  A use covers a length or leaves less
    of it than the configuration takes, so the rounds grow with the number of
    lengths, not with the counts."""
    left = have.copy()
    worth_of = size.astype(float) if weights is None else weights
    out: list[tuple[dict[int, int], int]] = []
    while (open_ := np.flatnonzero(left)).size:
        prices = worth_of[open_] * np.exp((left[open_] / have[open_] - 1) / epsilon)
        value, free, best = best_values(size[open_], prices, capacity), left[open_], 0.0
        for _ in range(TOGETHER):
            config = best_configuration(size[open_], prices, value, free)
            worth = sum(prices[i] * n for i, n in config.items())
            if not config or worth < (1 - NEAR) * best:
                break
            best = best or worth
            times = min(int(left[open_[i]]) // n for i, n in config.items())
            for i, n in config.items():
                left[open_[i]] -= n * times
                free[i] = 0
            out.append(({int(open_[i]): n for i, n in config.items()}, times))
    return out


class Game:
    """The configuration program restricted to known configurations, as a game:
    one side spreads uses over configurations, the other prices over lengths.
    A configuration's gain for a length is how often it has the length, over
    the length's count; the program's value is one over the game's.

    Both sides play multiplicative weights with one step of optimism (the last
    change is expected again).  Averages of a growing stretch are bounds from
    both sides; the next stretch starts at the best ones, more carefully if the
    gap does not close."""

    def __init__(self, size: np.ndarray, have: np.ndarray):
        self.size, self.have = size, have.astype(float)
        self.row, self.column, self.often = ([] for _ in range(3))
        self.known: dict[tuple, int] = {}
        self.uses: list[float] = []
        prices = size * self.have
        self.prices = prices / prices.sum()

    def add(self, config: dict[int, int], uses: float) -> bool:
        key = tuple(sorted(config.items()))
        if key in self.known:
            self.uses[self.known[key]] += uses
            return False
        self.known[key] = len(self.uses)
        for i, n in config.items():
            self.row.append(i)
            self.column.append(len(self.uses))
            self.often.append(n)
        self.uses.append(uses)
        return True

    def play(self, total: float, tolerance: float, work: int) -> tuple[float, int]:
        """Improve uses and prices until they bound the restricted program
        within ``tolerance``; the uses that cover everything, as a number of
        sequences, and the multiplications spent."""
        row, column = np.array(self.row), np.array(self.column)
        gain = np.array(self.often) * total / self.have[row]
        m, k = len(self.have), len(self.uses)
        covers = lambda x: np.bincount(row, gain * x[column], m)
        earns = lambda w: np.bincount(column, gain * w[row], k)
        start = self.have * self.size / (self.have * self.size).sum()
        x, w = np.array(self.uses) / sum(self.uses), 0.999 * self.prices + 0.001 * start
        low, high, best_x, best_w = 0.0, np.inf, x, w
        rate, length, spent, gap = RATE, 20, 0, np.inf
        while spent < work:
            sum_x, sum_w = np.zeros(k), np.zeros(m)
            cover, earn = covers(x), earns(w)
            for _ in range(length):
                now_cover, now_earn = covers(x), earns(w)
                x = x * np.exp(rate * np.clip(2 * now_earn - earn - 1, -3, 3))
                w = w * np.exp(-rate * np.clip(2 * now_cover - cover - 1, -3, 3))
                x, w = x / x.sum(), w / w.sum()
                cover, earn = now_cover, now_earn
                sum_x += x
                sum_w += w
            spent += 2 * length * len(row)
            for own in (sum_x / length, x):
                if (worst := covers(own).min()) > low:
                    low, best_x = worst, own
            for own in (sum_w / length, w):
                if (most := earns(own).max()) < high:
                    high, best_w = most, own
            if high < (1 + tolerance) * low:
                break
            if high / low - 1 > 0.9 * gap:
                rate = max(0.7 * rate, 0.01)
            gap, length = high / low - 1, min(2 * length, 2000)
            # a little of everything, or what has become tiny would be lost
            x, w = 0.999 * best_x + 0.001 / k, 0.999 * best_w + 0.001 * start
        self.uses, self.prices = (best_x * total / low).tolist(), best_w
        return total / low, spent


def fractional(
    size: np.ndarray, have: np.ndarray, capacity: int, start: list[tuple[dict[int, int], int]], tolerance: float = TOLERANCE
) -> tuple[list[tuple[dict[int, int], float]], float, np.ndarray]:
    """The configuration program: (configuration, uses) that cover everything,
    a lower bound of the number of sequences, and the lengths' prices.

    ``start`` is a cover in whole uses.  The bound is what all pieces are worth
    at some prices, over the most that one sequence can hold: a knapsack
    program.  At prices by size it may already be within ``tolerance`` of the
    start.  If not, the game on the known configurations is played, the
    knapsack program at its prices gives the bound and the configuration to add,
    and so on."""
    total = float(sum(times for _, times in start))
    game = Game(size, have)
    for config, times in start:
        game.add(config, times)
    bound = float((size * have).sum()) / capacity
    whole = max(total, 1.0)
    spent = 0
    for _ in range(PRICINGS):
        prices = game.prices / game.have
        value = best_values(size, prices, capacity)
        bound = max(bound, game.prices.sum() / value[-1])
        if total <= (1 + tolerance) * bound or spent >= WORK:
            break
        every = np.full(len(size), capacity, np.int64)
        new = game.add(best_configuration(size, prices, value, every), 0.02 * total)
        if not new and spent:
            break
        total, used = game.play(whole, tolerance / 3, WORK - spent)
        spent += used
    configs = sorted(game.known, key=game.known.get)
    return [(dict(c), u) for c, u in zip(configs, game.uses, strict=True)], bound, game.prices / game.have


def rounded(
    size: np.ndarray, have: np.ndarray, capacity: int, uses: list[tuple[dict[int, int], float]], prices: np.ndarray
) -> list[tuple[dict[int, int], int]]:
    """Whole uses of a fractional solution, the most used first and each
    rounded down (a place whose length has run out stays empty); what is left
    of the pieces is covered in whole uses at the program's prices."""
    left = have.copy()
    out: list[tuple[dict[int, int], int]] = []
    for config, often in sorted(uses, key=lambda u: -u[1]):
        rest = int(often + 1e-9)
        while rest and (own := {i: min(n, int(left[i])) for i, n in config.items() if left[i]}):
            times = min(rest, *(int(left[i]) // n for i, n in own.items()))
            for i, n in own.items():
                left[i] -= n * times
            out.append((own, times))
            rest -= times
    open_ = np.flatnonzero(left)
    if open_.size:
        more = priced_rounds(size[open_], left[open_], capacity, prices[open_])
        out += [({int(open_[i]): n for i, n in config.items()}, times) for config, times in more]
    return out


def plan(lengths: list[int], counts: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(configuration by length, how often), covering every piece once, and the
    program's lower bound of the number of sequences.

    The start's whole uses are the plan if the bound shows that they are within
    the tolerance, or if rounding the program's solution needs more."""
    if not lengths:
        return [], 0.0
    order = np.argsort(lengths)
    size, have = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    start = priced_rounds(size, have, capacity)
    uses, bound, prices = fractional(size, have, capacity, start)
    needed = lambda plan: sum(times for _, times in plan)
    best = start
    if needed(start) > (1 + TOLERANCE) * bound:
        best = min(start, rounded(size, have, capacity, uses, prices), key=needed)
    return [({int(size[i]): n for i, n in config.items()}, times) for config, times in best], bound


def placed(pieces: DataFrame, configurations: list[tuple[dict[int, int], int]], n_pieces: int) -> DataFrame:
    """Deal the pieces to the places of the configurations.

    Pieces of one length are numbered across ``parts`` hash parts (so that a
    length that a third of all pieces have is not one task's), each part after
    the ones before it; a number says which configuration, sequence and place
    it gets."""
    spark = pieces.sparkSession
    rows, first, seen = [], 0, Counter()
    for config, times in configurations:
        offset = 0
        for length in sorted(config, reverse=True):
            n = config[length]
            rows.append((length, seen[length], seen[length] + n * times, n, first, offset))
            seen[length] += n * times
            offset += n * length
        first += times
    places = spark.createDataFrame(
        pd.DataFrame(rows, columns=["length", "low", "high", "each", "first", "base"], dtype="int64"),
        "length long, low long, high long, each long, first long, base long",
    )
    parts = 1 + n_pieces // NUMBERED
    part = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(parts)).cast("int")
    pieces = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        pieces.withColumn("number", F.row_number().over(own) - 1)
        .join(starts, ["length", "part"])
        .withColumn("number", F.col("number") + F.col("earlier"))
    )
    # the number falls in one [low, high) of its length: looked up in a short
    # array per length (one entry for each configuration that uses it)
    table = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "each", "first", "base"))).alias("at"))
    place = F.filter("at", lambda x: (x["low"] <= F.col("number")) & (F.col("number") < x["high"]))[0]
    within = F.col("number") - F.col("place.low")
    return (
        numbered.join(F.broadcast(table), "length")  # at most capacity rows, of a bounded plan
        .withColumn("place", place)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("place.first") + F.floor(within / F.col("place.each"))).alias("sequence_id"),
            (F.col("place.base") + within % F.col("place.each") * F.col("length")).alias("offset"),
        )
    )


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece of ``docs(doc_id, text)``: its ids' place, length and CRC-32,
    the sequence it goes to, and the place there."""
    pieces = saved(token_pieces(docs, tokenizer, capacity, end), "pieces")
    histogram = pieces.groupBy("length").count().orderBy("length").collect()  # at most capacity rows
    configurations, _ = plan([r["length"] for r in histogram], [r["count"] for r in histogram], capacity)
    return placed(pieces, configurations, sum(r["count"] for r in histogram))
