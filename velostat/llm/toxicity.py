"""Toxicity by a subsequence string kernel with Nyström landmarks.

Words are compared by their common subsequences of ``ORDER`` characters; each
skipped character costs a factor ``DECAY``, so an insult with inserted or
missing characters stays near the plain one.  The kernel is normalised.

* Landmarks: words that mark label 1 (G-test over labelled documents), taken
  greedily so that no two are nearly alike.  A word's kernel values against
  them, times the inverse root of the landmarks' own kernel matrix, are its
  Nyström features.
* A sentence's kernel value is the largest of its words'; letters written apart
  ("a b c") count as one word too.  A document is as toxic as its worst
  sentence, so a linear SVM is trained on sentences in rounds: in a document
  of label 1 the sentence that scores highest stands for it, in the others
  every sentence counts.  A sigmoid is then fitted to the documents' scores.

Learning takes at most ``max_labelled`` labelled documents (by a hash of the
id) outside the held-out fifth, everything else takes all rows and whole
texts.  An empty or null text has the score of a sentence without any similar
word.  Without documents of both labels the score is the share of label 1 (0
without labels).  Rows without ``toxic`` teach nothing; a document with both
labels counts as 1.  Repeated rows each get their row.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_null, rows_of

#: A subsequence of up to three code points fits one 64-bit number.
ORDER, DECAY = 3, 0.6
LANDMARKS, CANDIDATES = 48, 400
#: Words below this largest kernel value count as similar to no landmark.
ACTIVE = 0.4
#: Labelled documents to learn from, and sentences of one of them.
MAX_LABELLED, MAX_SENTENCES = 20_000, 16
#: Long words are compared in overlapping cuts of this many characters.
CUT = 16
#: Kinds of characters that the bound of a word's kernel values tells apart.
KINDS = 64
REMEMBERED = 500_000

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_MARK = re.compile(r"[\W_]+")
_APART = re.compile(rb"(?<!\S)(?:[^\s.,;:!?]\s){2,}[^\s.,;:!?](?!\S)")
_STOP = (b".", b"!", b"?")


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)


@lru_cache(maxsize=None)
def _choices(n: int, order: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """All ways to choose ``order`` of n places, and decay ** (their span)."""
    places = np.array(list(combinations(range(n), order)), np.int64).reshape(-1, order)
    return places, decay ** (places[:, -1] - places[:, 0] + 1).astype(float)


def _subsequences(codes: np.ndarray, order: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Per word (row) its subsequences as numbers, and their common weights."""
    places, weights = _choices(codes.shape[1], order, decay)
    out = np.zeros((len(codes), len(places)), np.int64)
    for i in range(order):
        out = (out << 21) | codes[:, places[:, i]]
    return out, weights


class Similarity:
    """Normalised subsequence kernel values of words against fixed landmarks.

    The kernel is the inner product of the words' subsequence weights; the
    landmarks' subsequences are a sorted table, in which a batch of words of
    one length is looked up at once.  A word's norm is at least that of a word
    of its length without repeated subsequences, so values that cannot reach
    ``floor`` are left at 0.  Most such words are found before the lookup: no
    value exceeds the sum of each subsequence's largest share in a landmark,
    which a table by kinds of characters bounds."""

    def __init__(self, landmarks: list[str], order: int = ORDER, decay: float = DECAY):
        self.landmarks, self.order, self.decay = landmarks, order, decay
        entries: dict[int, dict[int, float]] = {}
        for i, word in enumerate(landmarks):
            for part in _cuts(word)[:1]:
                found, weights = _subsequences(_codes([part]), order, decay)
                for x, w in zip(found[0].tolist(), weights.tolist(), strict=True):
                    entries.setdefault(x, {})[i] = entries.get(x, {}).get(i, 0.0) + w
        self.known = np.array(sorted(entries), np.int64)
        self.weights = np.zeros((len(entries), len(landmarks)))
        for at, x in enumerate(self.known.tolist()):
            for i, w in entries[x].items():
                self.weights[at, i] = w
        self.norms = np.sqrt(np.maximum((self.weights**2).sum(axis=0), 1e-12))
        places = self.known[:, None] >> (21 * np.arange(order)[::-1]) & 0x1FFFFF
        letters = np.unique(places)
        n_kinds = min(len(letters), KINDS - 1) + 1
        self.kind = np.zeros(sys.maxunicode + 1, np.int32)  # 0: in no landmark
        self.kind[letters] = 1 + np.arange(len(letters)) % (KINDS - 1)
        self.most = np.zeros((n_kinds,) * order, np.float32)
        np.maximum.at(self.most, tuple(self.kind[places].T), (self.weights / self.norms).max(axis=1, initial=0))

    def __call__(self, words: list[str], floor: float = 0.0) -> np.ndarray:
        """(words, landmarks); a long word has the largest of its cuts."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            for part in _cuts(word):
                by_length.setdefault(len(part), []).append((i, part))
        for length, group in by_length.items():
            if length < self.order or not len(self.known):
                continue
            step = max(1, 200_000 // len(_choices(length, self.order, self.decay)[1]))
            for at in range(0, len(group), step):
                owner = np.array([i for i, _ in group[at : at + step]])
                values = self._values([x for _, x in group[at : at + step]], floor)
                hit = np.flatnonzero(values.any(axis=1))
                np.maximum.at(out, owner[hit], values[hit])
        return out

    def _possible(self, codes: np.ndarray, floor: float) -> np.ndarray:
        """The words (rows) whose bound reaches ``floor``, less what rounding
        may take off it."""
        places, weights = _choices(codes.shape[1], self.order, self.decay)
        kinds, n_kinds = self.kind[codes].T, len(self.most)
        at = kinds[places[:, 0]]  # a row for each choice of places: long rows
        for i in range(1, self.order):
            at = at * n_kinds + kinds[places[:, i]]
        bound = weights.astype(np.float32) @ self.most.ravel()[at]
        return np.flatnonzero(bound >= 0.999 * floor * np.sqrt((weights**2).sum()))

    def _values(self, words: list[str], floor: float) -> np.ndarray:
        codes = _codes(words)
        if floor > 0:
            kept = np.zeros((len(words), len(self.landmarks)), np.float32)
            some = self._possible(codes, floor)
            if some.size:
                kept[some] = self._exact(codes[some], floor)
            return kept
        return self._exact(codes, floor)

    def _exact(self, codes: np.ndarray, floor: float) -> np.ndarray:
        own, weights = _subsequences(codes, self.order, self.decay)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        word, place = np.nonzero(self.known[at] == own)
        out = np.zeros((len(codes), len(self.landmarks)), np.float32)
        if word.size:  # rows come in order: sum each word's stretch
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[first]] = np.add.reduceat(weights[place, None] * self.weights[at[word, place]], first, axis=0)
        out /= self.norms
        possible = np.flatnonzero(out.max(axis=1, initial=0) >= floor * np.sqrt((weights**2).sum()))
        kept = np.zeros_like(out)
        for i in possible.tolist():
            names, which = np.unique(own[i], return_inverse=True)
            kept[i] = out[i] / np.sqrt((np.bincount(which, weights, len(names)) ** 2).sum())
        return kept


def _cuts(word: str) -> list[str]:
    return [word[at : at + CUT] for at in range(0, max(1, len(word) - CUT // 2), CUT // 2)]


def words_of(text) -> list[bytes]:
    return [] if is_null(text) else text.encode().lower().split()


def plain(word: bytes) -> str:
    """Without marks at the ends."""
    text = word.decode()
    return text if text.isalnum() else _EDGE.sub("", text)


def apart(text) -> list[bytes]:
    """Words whose letters are written apart."""
    return [] if is_null(text) else [b"".join(m.split()) for m in _APART.findall(text.encode().lower())]


class Sentences:
    """Kernel values of a text's sentences that have any similar word."""

    def __init__(self, landmarks: list[str], active: float = ACTIVE):
        self.similarity, self.active = Similarity(landmarks), active
        #: Words seen, and the values of the few among them that are similar.
        self.seen: set[bytes] = set()
        self.near: dict[bytes, np.ndarray] = {}

    def learn(self, found: set[bytes]) -> None:
        new = found - self.seen
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            self.near.clear()
            new = found
        self.seen |= new
        forms: dict[str, list[bytes]] = {}  # words that differ by marks at their ends
        for w in new:
            forms.setdefault(plain(w), []).append(w)
        words = list(forms)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            values = self.similarity(part, self.active)
            marked = [i for i, w in enumerate(part) if not w.isalnum() and w]
            if marked:  # as it is, or without the marks inside
                values[marked] = np.maximum(values[marked], self.similarity([_MARK.sub("", part[i]) for i in marked], self.active))
            for i in np.flatnonzero(values.max(axis=1, initial=0) >= self.active).tolist():
                self.near.update(dict.fromkeys(forms[part[i]], values[i].copy()))

    def __call__(self, texts: list) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 128):
            split = [(words_of(t), apart(t)) for t in texts[at : at + 128]]
            found = set().union(*(words for both in split for words in both))
            self.learn(found)
            ends = {w for w in found if w.endswith(_STOP)}
            out += [self._of(words, extra, ends) for words, extra in split]
        return out

    def _of(self, words: list[bytes], extra: list[bytes], ends: set[bytes]) -> np.ndarray:
        """The distinct rows, sorted, of sentences with a similar word and of
        similar words written apart; ``ends``: the words that end a sentence."""
        near = self.near
        found = [near[w] for w in extra if w in near]
        hits = [i for i, w in enumerate(words) if w in near]
        if hits:
            sentence, last = 0, 0
            rows: dict[int, np.ndarray] = {}
            for i in hits:
                if not ends.isdisjoint(words[last:i]):
                    sentence += 1
                last = i
                value = near[words[i]]
                rows[sentence] = np.maximum(rows[sentence], value) if sentence in rows else value
            found += rows.values()
        distinct = sorted({tuple(x.tolist()) for x in found})  # few: faster than np.unique
        return np.array(distinct, np.float32) if found else np.empty((0, len(self.similarity.landmarks)), np.float32)


@dataclass
class Model:
    """score = sigmoid(slope * max over sentences of (weights . kernel values
    + bias) + offset); constant if nothing could be learned."""

    landmarks: list[str]
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    constant: float = 0.0

    def margin(self, sentences: np.ndarray) -> float:
        return max(self.bias, float((sentences @ self.weights).max()) + self.bias) if len(sentences) else self.bias

    def score(self, sentences: np.ndarray) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(sentences) + self.offset, -40, 40))))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss by accelerated gradient steps, both labels weighing
    alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (2 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + penalty)
    w = previous = np.zeros(x1.shape[1])
    for i in range(rounds):
        ahead = w + i / (i + 3) * (w - previous)
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        previous, w = w, ahead - rate * (-2 * x1.T @ (weight * y * slack) + penalty * ahead)
    return w[:-1], float(w[-1])


def train(landmarks: list[str], bags: list[tuple[int, np.ndarray]], rounds: int = 5) -> Model:
    """``bags``: (label, kernel values of the sentences) of each document."""
    own = Similarity(landmarks)(landmarks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    none = np.zeros((1, len(landmarks)))
    mapped = [(y, np.vstack([none, x]) @ root) for y, x in bags]
    negative = np.vstack([x for y, x in mapped if not y])
    positive = [x for y, x in mapped if y]
    w, b = np.ones(len(landmarks)) @ np.linalg.inv(root), 0.0
    for _ in range(rounds):
        worst = np.array([x[int((x @ w).argmax())] for x in positive])
        w, b = _svm(np.vstack([worst, negative]), np.array([1.0] * len(worst) + [-1.0] * len(negative)))
    margins = np.array([(x @ w).max() + b for _, x in mapped])
    labels = np.array([y for y, _ in mapped], float)
    slope, offset = _sigmoid(margins, labels)
    return Model(landmarks, (root @ w).astype(np.float32), b, slope, offset)


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Newton steps for the logistic fit, with Platt's smoothed targets."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - target) + 1e-3 * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in rows_of(frames, "text", "toxic"):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in rows:
            counts[int(toxic)].update({plain(w) for w in {*words_of(text), *apart(text)}})
        words = [w for w in counts[0].keys() | counts[1].keys() if len(w) >= ORDER]
        yield pd.DataFrame([(w, counts[1][w], counts[0][w]) for w in words], columns=["word", "n1", "n0"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled documents outside the held-out fifth."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    labels = labels.where(~held_out("doc_id")).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")  # max_labelled rows
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model([], constant=float(bool(n1)))
    counts = rows.select("text", "toxic").mapInPandas(_word_counts, "word string, n1 long, n0 long")
    counts = counts.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = (F.col("n1") + F.col("n0")) / (n1 + n0)
    gain = lambda n, all_: F.when(n > 0, n * F.ln(n / (share * all_))).otherwise(0.0)
    gains = gain(F.col("n1"), F.lit(n1)) + gain(F.col("n0"), F.lit(n0))
    marks = counts.where(F.col("n1") * n0 > F.col("n0") * n1).select("word", gains.alias("gain"))
    candidates = [r["word"] for r in marks.orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()]
    landmarks: list[str] = []
    if candidates:
        alike = Similarity(candidates)(candidates)
        taken: list[int] = []
        for i in range(len(candidates)):
            if len(taken) < LANDMARKS and (not taken or alike[i, taken].max() < 0.9):
                taken.append(i)
        landmarks = [candidates[i] for i in taken]
    if not landmarks:
        return Model([], constant=n1 / (n1 + n0))

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sentences = Sentences(landmarks)
        for frame in frames:
            bags = [x[np.argsort(-x.sum(axis=1))[:MAX_SENTENCES]].tobytes() for x in sentences(frame["text"].tolist())]
            yield pd.DataFrame({"toxic": frame["toxic"], "bag": bags})

    bags = rows.select("text", "toxic").mapInPandas(values, "toxic int, bag binary").collect()  # max_labelled rows
    return train(landmarks, [(r["toxic"], np.frombuffer(r["bag"], np.float32).reshape(-1, len(landmarks))) for r in bags])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: held_out, score, predicted."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sentences = Sentences(model.landmarks) if model.landmarks else None
        for frame in frames:
            found = sentences(frame["text"].tolist()) if sentences else [np.empty((0, 0))] * len(frame)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [model.score(x) for x in found]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(score, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
