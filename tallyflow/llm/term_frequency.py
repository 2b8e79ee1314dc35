"""How often every term, and every run of n terms, occurs, and in how many records.

Method: suffix arrays with common-prefix intervals. Each task sorts the suffixes of its records to their full
length and takes the longest common prefix of neighbours. Runs of n terms are the intervals of neighbours
whose common prefix has at least n terms: an interval's size is the number of occurrences. Each suffix is
linked to the suffix of the same record that stands before it in the array; a link that stays within an
interval is a duplicate of its record, so the number of records is the size less these links. Records are
never split between tasks, so the figures of all tasks add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of first occurrences, the end mark, and the first number of later occurrences.
LETTERS, DIGITS, END, LATER = 256, 257, 258, 259
#: Terms that a task gathers before it builds a suffix array and hands on its intervals.
CHUNK_TERMS = 500_000


@dataclass
class SuffixArray:
    """All suffixes of some records, each up to the end of its record, in order.

    ``suffixes`` are starting positions (equal ones in text order), ``lengths`` the terms each has, ``common``
    the terms that each shares with the one before it (-1 for the first) and ``same`` the place of the
    previous suffix of the same record (-1: none).
    """

    suffixes: np.ndarray
    lengths: np.ndarray
    common: np.ndarray
    same: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, record: np.ndarray) -> SuffixArray:
        """codes: the terms of all records in a row; record: the record of each, not falling.

        Ranks by the first k terms give ranks by the first 2k; the doubling ends once all suffixes differ or
        2^level covers the longest record. The ranks of all levels then give common prefixes, longest part first.
        """
        size = len(codes)
        if not size:
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none)
        last = np.flatnonzero(np.r_[record[1:] != record[:-1], True])
        left = last[np.searchsorted(last, np.arange(size))] - np.arange(size) + 1
        longest = int(left.max())
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        levels, span = [rank.astype(np.int32)], 1
        order = np.argsort(rank, kind="stable")
        while span < longest and rank[order[-1]] + 1 < size:
            follow = np.zeros(size, np.int64)
            inside = np.flatnonzero(left > span)
            follow[inside] = rank[inside + span] + 1
            key = rank * (size + 1) + follow
            order = np.argsort(key, kind="stable")
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[order[1:]] != key[order[:-1]]])
            levels.append(rank.astype(np.int32))
            span *= 2
        one, two = order[:-1], order[1:]
        common = np.zeros(size, np.int64)
        common[0] = -1
        shared = np.zeros(size - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            step = 1 << level
            # Suffixes that end early have ranks of their own length; only whole steps count here.
            fits = np.flatnonzero((left[one] - shared >= step) & (left[two] - shared >= step))
            equal = levels[level][one[fits] + shared[fits]] == levels[level][two[fits] + shared[fits]]
            shared[fits[equal]] += step
        common[1:] = shared
        place = np.argsort(record[order], kind="stable")
        owner = record[order][place]
        same = np.full(size, -1, np.int64)
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        same[place[follows + 1]] = place[follows]
        return cls(order, left[order], common, same)

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a starting position, occurrences, records) of each run of n terms."""
        if not len(self.suffixes):
            return self.suffixes, self.suffixes, self.suffixes
        starts = np.flatnonzero(self.common < n)
        size = np.diff(np.r_[starts, len(self.suffixes)])
        inside = self.same >= np.repeat(starts, size)
        records = size - np.add.reduceat(inside.astype(np.int64), starts)
        # Only a suffix by itself can be shorter than n.
        long = self.lengths[starts] >= n
        return self.suffixes[starts[long]], size[long], records[long]


def spelled(tokens: pa.ListArray, vocabulary: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(term code, record) of each occurrence in order, and the spellings by code.

    An occurrence is a mark of a first occurrence, or a later one of a term whose first mark is in the
    record; what follows the end mark, marks beyond the vocabulary and null spellings are passed over.
    """
    flat = tokens.flatten().to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(flat, nan=-1).astype(np.int64)
    lengths = np.asarray(tokens.value_lengths().fill_null(0))
    record = np.repeat(np.arange(len(lengths)), lengths)
    start = np.r_[0, np.cumsum(lengths)][:-1]
    ended = np.cumsum(flat == END)
    base = np.r_[0, ended][start] if len(flat) else np.zeros(len(lengths), np.int64)
    live = ended - base[record] == 0
    first = ((flat == LETTERS) | (flat == DIGITS)) & live
    seen = np.cumsum(first)
    before = np.r_[0, seen][start] if len(flat) else np.zeros(len(lengths), np.int64)
    index = np.where(first, seen - before[record] - 1, flat - LATER)
    marks = np.bincount(record[first], minlength=len(lengths))
    sizes = np.asarray(vocabulary.value_lengths().fill_null(0))
    keep = live & (first | (flat >= LATER)) & (index < np.minimum(marks, sizes)[record])
    words = vocabulary.flatten().dictionary_encode()
    codes = np.nan_to_num(words.indices.to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    voc_start = np.r_[0, np.cumsum(sizes)][:-1]
    record = record[keep]
    code = codes[voc_start[record] + index[keep]] if len(record) else np.zeros(0, np.int64)
    return code[code >= 0], record[code >= 0], words.dictionary


def one_per_record(records: DataFrame, key: str, columns: tuple[str, ...], order: str) -> DataFrame:
    """One row per distinct non-null ``key`` with non-null tokens: the copy written first."""
    rows = records.filter(F.col(key).isNotNull() & F.col("tokens").isNotNull())
    first = F.min_by(F.struct(*columns), F.struct(F.col(order).isNull(), order)).alias("r")
    return rows.groupBy(key).agg(first).select(key, "r.*")


def run_frequencies(records: DataFrame, least: int = 1, most: int | None = 1) -> DataFrame:
    """``n, terms ARRAY<STRING>, occurrences, records`` of all runs of ``least`` to ``most`` terms.

    records: ``tokens, vocabulary`` of distinct records. ``most`` None reaches to the longest record; the runs of
    all lengths are quadratic in the length of a record, so ask for what is needed. Runs lie within one
    record. Empty records and records without vocabulary have no terms; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [table.column(c).combine_chunks() if table.num_rows else pa.array([]) for c in ("tokens", "vocabulary")]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            code, record, spellings = spelled(*lists)
            array = SuffixArray.of(code, record)
            longest = int(array.lengths.max()) if len(code) else 0
            for n in range(least, (longest if most is None else min(most, longest)) + 1):
                at, occurrences, in_records = array.intervals(n)
                for lo in range(0, len(at), max(1, CHUNK_TERMS // n)):
                    cut = slice(lo, lo + max(1, CHUNK_TERMS // n))
                    picks = code[(at[cut, None] + np.arange(n)).reshape(-1)]
                    terms = pa.ListArray.from_arrays(pa.array(np.arange(0, len(picks) + 1, n), pa.int32()), spellings.take(pa.array(picks)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), n), pa.int32()), terms, pa.array(occurrences[cut], pa.int64()), pa.array(in_records[cut], pa.int64())], ["n", "terms", "occurrences", "records"])

        for b in batches:
            held.append(b)
            size += len(b.column(0).flatten())
            if size >= CHUNK_TERMS:
                yield from hand_on()
                held, size = [], 0
        if held:
            yield from hand_on()

    parts = records.select("tokens", "vocabulary").mapInArrow(run, "n int, terms array<string>, occurrences bigint, records bigint")
    return parts.groupBy("n", "terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def bands(records: Column, whole: Column, rare_upto: int = 2) -> Column:
    """The marks of a term as an array: ``rare`` in up to ``rare_upto`` records, ``common`` in at least half."""
    marks = F.array(F.when(records <= rare_upto, F.lit("rare")), F.when(records * 2 >= whole, F.lit("common")))
    return F.array_compact(marks)
