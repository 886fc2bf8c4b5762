"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next one's docs. Filtering stages return the documents that they keep with all columns, whatever these are called, and an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm.op1_surrogates import surrogate_text
from provenir.llm.op5_superminhash import drop_duplicates
from provenir.llm.op6_repetition import keep_good
from provenir.llm.op8_cgk import drop_leaks
from provenir.llm.op10_packing import pack
from provenir.llm.queries import WORD_BPE
from provenir.storage import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null, empty or short text (under 50 words) fails them; doc_id isn't looked at, so repeated and null ones are judged row by row."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near-duplicates (five words, 0.8). Texts without words and rows without a doc_id are alike with nothing and stay; of rows with one doc_id that of the least text stays."""
    return drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none and stays; repeated rows are judged alike; without items all stay."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, entities in their texts replaced, and n_chars, where there is one, set to the new length. A null text stays null; equal values get equal surrogates in all rows."""
    out = surrogate_text(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null text is an empty document (its end id); rows with one doc_id are documents of their own; an empty table has no piece."""
    return pack(docs, WORD_BPE)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None  # suffix sorts, edit distances and tokenizers have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
