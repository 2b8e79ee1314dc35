"""Symbol streams from tables.

A stream is a table with one ARRAY of symbols per sequence: position is the index, so neighbours are
found inside the row and no ordering window or shuffle is needed. Tables with one row per position
(events, order items) become lagged rows by ``tallyflow.operators.ordered``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources.tables import spread

#: A segment: a run of ASCII letters, a run of digits, or any other single character.
SEGMENT = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"


def segments(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, syms``: letter runs, digit runs and single other characters; null texts give no row."""
    return spread(texts.select(key, text), key).filter(F.col(text).isNotNull()).select(key, F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)).alias("syms"))


def positions(stream: DataFrame, *keep: str) -> DataFrame:
    """``keep.., pos, sym``: one row per position.

    The outer form of the generator is used and its null row dropped afterwards: for the inner form the
    optimizer adds a filter on the array below it, which would split every text once more.
    """
    return stream.select(*keep, F.posexplode_outer("syms").alias("pos", "sym")).filter(F.col("pos").isNotNull())


def words(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, syms``: the text split at white space (space, tab, line feed, return, feed, vertical tab)."""
    split = F.filter(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    return spread(texts.select(key, text), key).filter(F.col(text).isNotNull()).select(key, split.alias("syms"))


def characters(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, syms``: code points."""
    return spread(texts.select(key, text), key).filter(F.col(text).isNotNull()).select(key, F.filter(F.split(text, ""), lambda c: c != "").alias("syms"))


def byte_histogram(texts: DataFrame, text: str = "text") -> DataFrame:
    """``byte, n`` over the UTF-8 bytes of all texts: one vectorised count per batch, no row per byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            column = b.column(0).cast(pa.large_binary()).drop_null()
            if len(column):
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                if offsets[-1] > offsets[0]:
                    total += np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["byte", "n"])

    return texts.select(F.col(text).cast("binary").alias("b")).mapInArrow(run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))


def tokenizer_counts(texts: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``token, n`` under a published byte-level vocabulary (a rank file); texts are counted where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        total = np.zeros(len(ranks), np.int64)
        for b in batches:
            for t in b["t"]:
                if t:
                    total += np.bincount(np.array(encoder.encode_ordinary(t), np.int64), minlength=len(ranks))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"token": at.astype(np.int32), "n": total[at]})

    return texts.select(F.col(text).alias("t")).mapInPandas(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def manifest(stream: DataFrame, representation: str) -> DataFrame:
    """One row: representation, sequences, symbols and alphabet of a stream (the denominator's companions)."""
    symbols = positions(stream)
    return symbols.agg(F.lit(representation).alias("representation"), F.count("*").alias("n_symbols"), F.countDistinct("sym").alias("alphabet"))


def save_stream(stream: DataFrame, path: str) -> None:
    """Write a stream as Parquet; the committer makes the table appear whole or not at all."""
    stream.write.mode("overwrite").parquet(path)


def load_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
