"""Queries of the text problems: token ids (p6), leaked test items (p7), sentences (p8)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import encode_column
from gridloom.llm.eval_leaks import leaks, matches, without_leaks
from gridloom.llm.sentences import sentence_units
from gridloom.session import stage, table

#: Where the published vocabularies lie.
TOKENIZERS = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_column(table(spark, sf, "documents"), "text", ["doc_id"], str(Path(TOKENIZERS) / "byte_bpe_50k.tiktoken"))


def _pair(spark: SparkSession, sf: str) -> tuple:
    return table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text"


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(*_pair(spark, sf))


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Longest verbatim matches with their places."""
    return matches(*_pair(spark, sf))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without leaks."""
    docs = table(spark, sf, "documents")
    return without_leaks(docs, "doc_id", stage(leaks(*_pair(spark, sf)), "leaks")).select("doc_id", "lang", "source", "n_chars")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Test items that leaked, with the number of documents and the longest match."""
    return matches(*_pair(spark, sf)).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("most_words"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_units(table(spark, sf, "documents"), "doc_id", "text", "lang")


QUERIES = {q.__name__: q for q in (p6_ids, p7_found, p7_matches, p7_clean, p7_items, p8_found)}
ORACLE: dict[str, str] = {}
