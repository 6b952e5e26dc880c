"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import (
    chat_format, decontaminate, html_text, licenses, merkle, ngram_join, oracles, packing, prefix_trie,
    quality_model, quality_rules, substring_dedup, suffix_dedup, url_filter,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    out = ngram_join.ngram_components(docs, size=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf, "documents"), window=50)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                      F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    return quality_model.quality_scores(docs, labels).withColumnRenamed("id", "doc_id").drop("body")


#: A conversation that every run adds: its texts hold control strings and one that looks escaped.
EXTRA_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"),
                      (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(extra)))


#: The rules that pages are judged by.
URL_RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"),
             url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block"),
             url_filter.Rule("net", "/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = url_filter.judge_urls(_table(spark, sf, "pages"), URL_RULES)
    return out.withColumnRenamed("id", "page_id")


def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(_table(spark, sf, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), tokenizer_path())


def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit",
                      F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"),
                      F.concat_ws(",", "licenses").alias("licenses"), F.col("best").alias("best_license"),
                      F.col("dice").alias("best_dice"))


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(_table(spark, sf, "documents"), window=50)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that open with up to three turns of another one."""
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 4
    turns = prefix_trie.ordered_turns(conversations)
    return prefix_trie.prefix_trie(*prefix_trie.regrown_turns(turns, base=conv - conv % 20, head=head, most=3))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return rebuilt(_table(spark, sf, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_model": op4_quality_model,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_licenses": op10_licenses,
    "op11_merkle": op11_merkle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.OP2,
    "op3_substring_dedup": oracles.OP3,
    "op5_chat_format": oracles.OP5,
    "op6_url_filter": oracles.OP6,
    "op9_decontaminate": oracles.OP9,
    "op10_licenses": oracles.OP10,
    "op11_merkle": oracles.OP11,
    "op12_suffix_dedup": oracles.OP12,
    "op13_prefix_trie": oracles.OP13,
}
