"""The lossless tokenizer of text bytes: a token stream, spellings, case classes and capital masks.

``encode_bytes`` and ``decode_bytes`` are exact inverses for any bytes. ``stream_costs`` prices the streams of
a whole corpus from its form counts, without making the token stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the token stream (fixed values): first word, first number, end, first vocabulary index.
WORD, NUMBER, END, BASE = 256, 257, 258, 259
CASES = ("lower", "Cap", "UPPER", "mixed")
_SEGMENT = re.compile(rb"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", re.DOTALL)
_LETTERS = re.compile(rb"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def case_of(run: bytes) -> int:
    """0 lower, 1 first letter a capital (also a single one), 2 all capitals (two or more), 3 mixed."""
    if run == run.lower():
        return 0
    if run[:1].isupper() and run[1:] == run[1:].lower():
        return 1
    return 2 if run == run.upper() else 3


def encode_bytes(raw: bytes, numbers: str = "intern", case: str = "conditioned") -> dict:
    """``tokens, spellings, cases, masks``. numbers: ``intern`` digit runs or ``compositional`` single digits;
    case: ``conditioned`` (folded spellings, classes aside) or ``folded`` into the spellings.
    """
    if numbers not in ("intern", "compositional") or case not in ("conditioned", "folded"):
        raise ValueError((numbers, case))
    index: dict[bytes, int] = {}
    tokens: list[int] = []
    cases: list[int] = []
    masks: list[list[int]] = []
    for m in (_SEGMENT if numbers == "intern" else _LETTERS).finditer(raw):
        run = m.group()
        word = run[:1].isalpha() and run[0] < 128
        number = numbers == "intern" and run[:1].isdigit()
        if not word and not number:
            tokens.append(run[0])
            continue
        form = run.lower() if word and case == "conditioned" else run
        if word and case == "conditioned":
            kind = case_of(run)
            cases.append(kind)
            if kind == 3:
                masks.append([int(65 <= c <= 90) for c in run])
        at = index.get(form)
        if at is None:
            index[form] = len(index)
            tokens.append(WORD if word else NUMBER)
        else:
            tokens.append(BASE + at)
    tokens.append(END)
    return {"tokens": tokens, "spellings": list(index), "cases": cases, "masks": masks}


def decode_bytes(streams: dict, case: str = "conditioned") -> bytes:
    """The bytes, from the streams alone."""
    spellings, out, used = streams["spellings"], [], 0
    cases, masks = iter(streams["cases"]), iter(streams["masks"])
    for t in streams["tokens"]:
        if t == END:
            break
        if t < WORD:
            out.append(bytes([t]))
            continue
        if t < END:
            form, used = spellings[used], used + 1
        else:
            form = spellings[t - BASE]
        if case == "conditioned" and form[:1].isalpha():
            kind = next(cases)
            if kind == 1:
                form = form[:1].upper() + form[1:]
            elif kind == 2:
                form = form.upper()
            elif kind == 3:
                form = bytes(c - 32 if up else c for c, up in zip(form, next(masks)))
        out.append(form)
    return b"".join(out)


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", numbers: str = "intern", case: str = "conditioned") -> DataFrame:
    """``key, tokens, vocabulary, cases, masks``: every text encoded by itself, each with its own vocabulary.

    Null and empty texts have the end mark alone.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [encode_bytes((t or "").encode(), numbers, case) for t in b["t"]]
            yield pd.DataFrame({key: b[key], "tokens": [x["tokens"] for x in done], "vocabulary": [[w.decode() for w in x["spellings"]] for x in done], "cases": [x["cases"] for x in done], "masks": [x["masks"] for x in done]})

    return texts.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, tokens array<int>, vocabulary array<string>, cases array<tinyint>, masks array<array<tinyint>>")


def decode_texts(encoded: DataFrame, key: str = "doc_id", case: str = "conditioned") -> DataFrame:
    """``key, text``."""
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [decode_bytes({"tokens": t, "spellings": [w.encode() for w in v], "cases": c, "masks": m}, case).decode() for t, v, c, m in zip(b["tokens"], b["vocabulary"], b["cases"], b["masks"])]
            yield pd.DataFrame({key: b[key], "text": texts})

    return encoded.mapInPandas(run, f"{key} {kind}, text string")


def case_class(run):
    """Column: the case class of a letter run by name."""
    return F.when(run.rlike("^[a-z]+$"), CASES[0]).when(run.rlike("^[A-Z][a-z]*$"), CASES[1]).when(run.rlike("^[A-Z]{2,}$"), CASES[2]).otherwise(CASES[3])


def case_histogram(counts: DataFrame) -> DataFrame:
    """``case_class, runs, n`` of the letter runs of a symbol count table."""
    runs = counts.filter(F.col("sym").rlike("^[A-Za-z]+$"))
    return runs.groupBy(case_class(F.col("sym")).alias("case_class")).agg(F.count("*").alias("runs"), F.sum("n").alias("n"))


def form_counts(counts: DataFrame) -> DataFrame:
    """``kind, form, n``: letter runs folded to lower case, digit runs, single other characters."""
    kind = F.when(F.col("sym").rlike("^[A-Za-z]+$"), "word").when(F.col("sym").rlike("^[0-9]+$"), "number").otherwise("other")
    return counts.select(kind.alias("kind"), F.when(kind == "word", F.lower("sym")).otherwise(F.col("sym")).alias("form"), "n").groupBy("kind", "form").agg(F.sum("n").alias("n"))


def spelling_symbols(forms: DataFrame) -> DataFrame:
    """``kind, ch, n``: letters of each word and digits of each number once per form, and one end ('') each."""
    first = forms.filter("kind <> 'other'").select("kind", F.explode(F.concat(F.filter(F.split("form", ""), lambda c: c != ""), F.array(F.lit("")))).alias("ch"))
    return first.groupBy("kind", "ch").agg(F.count("*").alias("n"))


def stream_profiles(counts: DataFrame) -> DataFrame:
    """``stream, state, symbol, n``: the counts of every stream of the corpus as one text.

    S1: each form's later occurrences, the marks of first ones, the other characters and the end. S2a, S2b:
    spellings. S3: case classes of all letter runs in one state. First occurrences are one per form, so no
    order is needed.
    """
    forms = form_counts(counts)
    other = forms.filter("kind = 'other'").select(F.col("form").alias("symbol"), "n")
    later = forms.filter("kind <> 'other' and n > 1").select(F.col("form").alias("symbol"), (F.col("n") - 1).alias("n"))
    marks = forms.filter("kind <> 'other'").groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("first "), "kind").alias("symbol"), "n")
    end = counts.sparkSession.range(1).select(F.lit("end").alias("symbol"), F.lit(1).cast("bigint").alias("n"))
    s1 = other.unionByName(later).unionByName(marks).unionByName(end).select(F.lit("S1").alias("stream"), "symbol", "n")
    s2 = spelling_symbols(forms).select(F.when(F.col("kind") == "word", "S2a").otherwise("S2b").alias("stream"), F.col("ch").alias("symbol"), "n")
    s3 = case_histogram(counts).select(F.lit("S3").alias("stream"), F.col("case_class").alias("symbol"), "n")
    return s1.unionByName(s2).unionByName(s3)
