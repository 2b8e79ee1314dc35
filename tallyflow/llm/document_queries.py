"""Queries on the texts of documents: garbled encodings (p8) and token ids (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.bpe_encode import encode_documents
from tallyflow.llm.encoding_repair import repair_documents
from tallyflow.sources.tables import read_table


def repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every garbled document with its restored text."""
    return repair_documents(read_table(spark, sf, "documents"))


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(read_table(spark, sf, "documents"))


def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, tokens and characters per kind and language."""
    docs = read_table(spark, sf, "documents")
    ids = encode_documents(docs, also=("kind", "lang"))
    return ids.groupBy("kind", "lang").agg(F.count("*").alias("documents"), F.sum(F.size("ids").cast("bigint")).alias("tokens"))


QUERIES = {"p8_found": lambda s, d: repaired(s, d).select("doc_id"), "p8_repaired": repaired, "p6_ids": token_ids, "p6_totals": token_totals}
ORACLE: dict[str, str] = {}
