"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: :func:`ledger` stores the
measurements and one bit per failed rule.  A policy is a versioned mask of
those bits, so a new policy, its verdicts (:func:`apply_policy`) and its
ablation (:func:`ablation`) come from the ledger without reading a text again.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text has no words; an empty one
neither.  Repeated rows each get their own row, a null ``doc_id`` stays null,
further columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_null, whole_row

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: (name, SQL condition under which the rule fails); the bit is the position.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_word_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def policy_mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: version -> mask of the rules that reject.  Version 1 is the base.
POLICIES = {
    1: policy_mask("few_words", "repeated_words"),
    2: policy_mask("few_words", "repeated_words", "symbols", "repeated_lines"),
    3: policy_mask(*BITS),
}
CURRENT = 3

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names for pairs: equal pairs get equal numbers."""
    pairs = left * np.int64(max(int(right.max()), 0) + 1) + right
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def repeated_window_words(words: list, width: int = WINDOW) -> int:
    """Words inside a window of ``width`` (a power of two) words that occurs
    at least twice.  Windows are named by doubling, so they compare exactly."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    if len(names) == len(words):
        return 0
    step = 1
    while step < width:
        ids = _ranks(ids[:-step], ids[step:])
        step *= 2
    starts = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += starts
    edges[width : width + n] -= starts
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(b"".join(words).decode()),
        sum(map(raw.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))),
        len(lines) - len(Counter(lines)),
        repeated_window_words(words),
        len(lines),
    )


def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(None if is_null(t) else t) for t in texts], columns=list(_MEASURES))


def measured(text: str | F.Column) -> F.Column:
    """The measurements of a text column, as a struct."""
    return F.pandas_udf(_measure, ", ".join(f"{m} long" for m in _MEASURES))(text)


def fail_bits() -> F.Column:
    """The failure bits of a row that has the measurements as columns."""
    return F.expr(" | ".join(f"IF({condition}, {BITS[name]}L, 0L)" for name, condition in RULES))


def ledger(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the measurements and ``fail_bits``."""
    rows = docs.select(F.col("doc_id").cast("long"), measured("text").alias("m"))
    return rows.select("doc_id", "m.*").withColumn("fail_bits", fail_bits())


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """``base_failed`` (policy 1) and ``kept``: no rule of the base and none of
    the policy failed."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", failed(POLICIES[1])).withColumn(
        "kept", ~failed(POLICIES[1] | POLICIES[version])
    )


def keep_good(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, all columns as they are."""
    rows = docs.select(whole_row(docs).alias("row"), measured("text").alias("m")).select("row", "m.*")
    return apply_policy(rows.withColumn("fail_bits", fail_bits()), version).where("kept").select("row.*")


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (and
    so come back without the rule), and the bits seen beside it.

    Documents are first counted by their bits, at most 2^rules rows; only that
    table meets the rules."""
    mask = POLICIES[version]
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = rows.sparkSession.createDataFrame(
        [(name, bit) for name, bit in BITS.items() if bit & mask], "rule string, bit long"
    )
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        rules.join(F.broadcast(seen), hit, "left")  # at most 2^rules rows
        .groupBy("rule", "bit")
        .agg(
            count(hit).alias("n_failed"),
            count(F.col("bits") == F.col("bit")).alias("n_only"),
            F.expr("coalesce(bit_or(bits), 0L)").alias("seen_with"),
        )
    )
