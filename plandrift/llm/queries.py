"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compact_windows, decision_list, exact_dedup, language, link_graph, packing, preference, suffix_family, superminhash
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, whole=False)


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json")))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digests(preference.preference(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=4)


#: The rules that the query is to judge by.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    rules = decision_list.fit(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return decision_list.judge(documents, rules).select(*columns)


def op8_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_family.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")  # of a character that is cut, U+FFFD


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.identify(documents, language.fit(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_compact_windows": op2_compact_windows,
        "op3_vector_packing": op3_vector_packing,
        "op4_preference": op4_preference,
        "op5_superminhash": op5_superminhash,
        "op6_link_graph": op6_link_graph,
        "op7_decision_list": op7_decision_list,
        "op8_perfect_hash_dedup": op8_perfect_hash_dedup,
        "op9_suffix_family": op9_suffix_family,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_preference": preference.ORACLE_SQL,
        "op8_perfect_hash_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
            FROM d JOIN g USING (text_sha256)""",
    }
