"""Registered queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..storage import read_table
from . import op3_linkgraph, op12_divergence, op13_trie
from .op1_surrogates import surrogate_query
from .op2_orc import orc_query
from .op4_windows import windows_query
from .op5_superminhash import near_duplicates
from .op6_repetition import quality_rules
from .op7_language import language_query
from .op8_cgk import find_leaks
from .op9_suffixes import suffix_query
from .op10_packing import pack
from .op11_speculative import bpe_query

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_query(read_table(spark, sf_dir, "documents"))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_query(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_linkgraph.judge_urls(read_table(spark, sf_dir, "pages"))


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_query(read_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(read_table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_query(read_table(spark, sf_dir, "documents"))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), WORD_BPE)


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_query(read_table(spark, sf_dir, "documents"), WORD_BPE)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_trie.trie_query(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogates,
        op2_token_orc,
        op3_link_graph,
        op4_repeated_windows,
        op5_near_duplicates,
        op6_repetition_rules,
        op7_language_id,
        op8_benchmark_leaks,
        op9_suffix_dedup,
        op10_mixture_packing,
        op11_speculative_bpe,
        op12_source_divergence,
        op13_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_link_graph": op3_linkgraph.oracle(), "op12_source_divergence": op12_divergence.oracle(), "op13_prefix_trie": op13_trie.oracle()}
