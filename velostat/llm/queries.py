"""The queries of this package, each over its whole tables, and DuckDB SQL for
those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_parts,
    decontaminate,
    html_blocks,
    jaccard_join,
    line_runs,
    packing,
    periodic_runs,
    prefix_trie,
    rule_ledger,
    suffix_dedup,
    token_count,
    toxicity,
    url_aliases,
)
from .common import table
from .oracle import ORACLE_SQL


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> token_count.Vocabulary:
    import public_tokenizers

    return token_count.Vocabulary.from_sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = spark.sql(
        r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = rows.unionByName(hard).select("conv_id", "turn", "role", chat_parts.text_part(F.col("text")).alias("parts"))
    chats = chat_parts.format_chats(rows)
    turns = chat_parts.read_back(F.col("formatted"))
    loss = chat_parts.under_loss(F.col("formatted"), F.col("loss_mask"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, line), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), piece_vocabulary)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_runs.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_join.similar_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    rows = decontaminate.verdicts(decontaminate.scan(docs, items))
    return rows.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), word_tokenizer)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text"))
    runs, best = F.col("runs"), F.col("best")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    return periodic_runs.find_runs(docs).withColumn("best", F.array_max(ranked)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["n"].alias("length"),
        (-best["q"]).alias("period"),
        F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def url_rules() -> list[url_aliases.Rule]:
    return [
        url_aliases.Rule("allow", "org", "/"),
        url_aliases.Rule("block", "example.org", "/es/"),
        url_aliases.Rule("block", "example.org", "/en/1"),
        url_aliases.Rule("allow", "com", "/fr/"),
        url_aliases.Rule("block", "com", "/de/"),
    ]


def op12_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.verdicts(table(spark, sf_dir, "pages", "page_id", "url", "html"), url_rules())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turn_rows(rows)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_chat_formatting,
        op3_token_counts,
        op4_quality_rules,
        op5_line_dedup,
        op6_jaccard_join,
        op7_decontamination,
        op8_packing,
        op9_toxicity,
        op10_suffix_dedup,
        op11_periodic_runs,
        op12_url_aliases,
        op13_prefix_trie,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
