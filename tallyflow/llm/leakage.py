"""Held-out passages inside a corpus, found by latent semantic retrieval.

Method: passages (short windows of words) become TF-IDF vectors over the words of the held-out items; a
distributed randomised SVD of all passages gives their latent space; the signs of random projections of the
latent vectors put the items' passages into the buckets of several tables, and a passage of a document is
compared by cosine with those that share a bucket with it. Candidates are then read word by word: the longest
common run, the longest common subsequence, and how many of the item's telling words (the answer check) the
passage has.

Equal passages share every bucket, since signs are taken of whole numbers, so no copied run can be missed. Of
others as similar as the cosine asked for, at least RECALL share a bucket on average: the number of tables
follows from the cosine and the number of buckets.

Only stretches of a document whose words all occur in held-out items can hold a copied run, so for copied
runs only these stretches become passages; they are a small part of a corpus. For paraphrases every window
of a document is a passage. Words of no item share one dimension beside the latent space, where items have
nothing: a cosine is that of the known words times the share of the window's length that they hold.
Windows whose share is under the cosine asked for can't reach it and are left out before the search.
Statistics (document frequencies) cover every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.tables import cut, spread

WORD = re.compile("[a-z0-9]+")
#: Words of a passage, steps between the passages of an item, and consecutive words that make a leak.
#: Any LEAK consecutive words hold a whole passage that begins at a multiple of STEP.
PASSAGE, STEP, LEAK = 8, 5, 12
assert PASSAGE + STEP - 1 <= LEAK
#: Latent dimensions, extra random directions and power iterations of the SVD.
RANK, EXTRA, ITERATIONS = 32, 8, 1
#: Held-out text that one pass over the corpus searches for; more of it takes more passes.
BLOCK_CHARS = 8_000_000
#: Document passages handled at a time, and candidate pairs held at a time.
TILE, MOST_PAIRS = 1024, 2_000_000
#: Share of passages at the cosine asked for that meet in a bucket, passages of items in a bucket, bits of a bucket.
RECALL, BUCKET, BITS = 0.97, 8, (4, 14)
#: A paraphrase has a common subsequence of so many words, and either such a share of the item's telling words with
#: such a share of the passages, or a larger share of the passages (a part of an item may be told alone).
PARAPHRASE_WORDS, PARAPHRASE_ANSWER, PARAPHRASE_PART, PARAPHRASE_SHARE = 12, 0.5, 0.3, 0.6


def words_of(text: str | None) -> list[str]:
    """Maximal runs of a-z and 0-9 of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


@dataclass
class Items:
    """A block of held-out items in numbers."""

    ids: list
    words: list[np.ndarray]
    number: dict[str, int]
    at: np.ndarray  # (item, position) of each passage
    passages: np.ndarray  # its words

    @classmethod
    def of(cls, rows: list) -> Items:
        """Items with equal or null texts are items of their own; those under PASSAGE words have no passage."""
        number: dict[str, int] = {}
        words = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for _, t in rows]
        at = [(i, p) for i, w in enumerate(words) for p in range(0, len(w) - PASSAGE + 1, STEP)]
        passages = np.array([words[i][p : p + PASSAGE] for i, p in at], np.int32).reshape(-1, PASSAGE)
        return cls([k for k, _ in rows], words, number, np.array(at, np.int32).reshape(-1, 2), passages)


def blocks_of(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The held-out items in blocks of bounded size, so that what is sent to the workers is bounded too."""
    held, size = [], 0
    for row in items.select(key, text).orderBy(key).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_CHARS:
            yield Items.of(held)
            held, size = [], 0
    if held:
        yield Items.of(held)


_STRETCH = "kind string, doc string, start int, words array<int>"


def stretches(documents: DataFrame, items: Items, key: str, text: str, least: int, whole: bool = False) -> DataFrame:
    """Stretches of at least ``least`` known words of each document, and document frequencies.

    Rows of kind ``s``: document, position, words; with ``whole`` all words of each document that can hold a
    passage, unknown ones as -1. One row of kind ``f`` a task: documents per word, then those with an unknown
    word and all documents. Whole texts are read; null and empty texts have no words.
    """
    number = documents.sparkSession.sparkContext.broadcast(items.number)
    size = len(items.number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = number.value
        frequency = np.zeros(size + 2, np.int64)
        for b in batches:
            rows = []
            for doc, t in zip(b["doc"], b["t"]):
                ids = np.fromiter(map(known.get, words_of(t), repeat(-1)), np.int32)
                ok = ids >= 0
                frequency[size + 1] += 1
                frequency[size] += not ok.all()
                frequency[np.unique(ids[ok])] += 1
                if whole:
                    if len(ids) >= PASSAGE and ok.any():
                        rows.append(("s", doc, 0, ids))
                    continue
                if len(ids) < least:
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, ok, False]))
                for a, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if e - a >= least:
                        rows.append(("s", doc, a, ids[a:e]))
            yield pd.DataFrame(rows, columns=["kind", "doc", "start", "words"])
        yield pd.DataFrame({"kind": ["f"], "doc": [None], "start": [0], "words": [frequency]})

    flat = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("doc"), F.col(text).alias("t"))
    return spread(flat, "doc").mapInPandas(run, _STRETCH)


def _windows(words: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(words, PASSAGE) if len(words) >= PASSAGE else np.zeros((0, PASSAGE), words.dtype)


def known_share(windows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Share of the TF-IDF length of each window that its known words hold; the last idf is that of all unknown words."""
    same = (windows[:, :, None] == windows[:, None, :]) & (windows[:, :, None] >= 0)
    known = (same * (idf[windows] ** 2)[:, :, None]).sum((1, 2))
    unknown = ((windows < 0).sum(1) * idf[-1]) ** 2
    return np.sqrt(known / (known + unknown))


def reachable(texts: DataFrame, idf: np.ndarray, cosine: float) -> DataFrame:
    """Of whole texts (``stretches`` with ``whole``) the parts covered by windows that can reach ``cosine``."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)

    def parts(ids: np.ndarray) -> Iterator[tuple[int, int]]:
        weight = np.where(ids >= 0, sent.value[ids], 0)
        sums = lambda x: (c := np.r_[0, np.cumsum(x)])[PASSAGE:] - c[:-PASSAGE]
        total, unknown = sums(weight), sums(ids < 0) * sent.value[-1]
        # A sum of weights is at least the length of their vector: the exact share is only needed where this one is enough.
        at = np.flatnonzero((total > 0) & (total**2 * (1 - cosine**2) >= cosine**2 * unknown**2 - 1e-6))
        windows = _windows(ids)
        shares = [known_share(windows[at[lo : lo + TILE]], sent.value) for lo in range(0, len(at), TILE)]
        at = at[np.concatenate([np.zeros(0), *shares]) >= cosine - 1e-9]
        mark = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + PASSAGE, -1)
        edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(mark) > 0, False]))
        yield from zip(edge[::2].tolist(), edge[1::2].tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [("s", doc, a, ids[a:e]) for doc, ids in zip(b["doc"], b["words"]) for a, e in parts(ids)]
            yield pd.DataFrame(rows, columns=["kind", "doc", "start", "words"])

    return texts.mapInPandas(run, _STRETCH)


def _project(passages: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``space`` over the words of each passage, always added in the same order; -1 adds nothing."""
    space = np.r_[space, np.zeros((1, space.shape[1]), space.dtype)]
    out = np.zeros((len(passages), space.shape[1]), space.dtype)
    for k in range(PASSAGE):
        out += space[passages[:, k]]
    return out


def latent_space(found: DataFrame, items: Items, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """Word -> latent coordinates (already weighted) by randomised SVD of all passages.

    Each power iteration is one pass over the stretches: a task returns A^T (A Q) of its passages, with
    one row per word of the held-out items; the sums over tasks are added by Spark. Rows of A are the
    passages of documents and items, columns the words.
    """
    rng = np.random.default_rng(seed)
    size = len(idf)
    width = min(size, RANK + EXTRA)
    q = rng.standard_normal((size, width))
    vectors = np.zeros(0)
    for _ in range(ITERATIONS + 1):
        sent = found.sparkSession.sparkContext.broadcast((q * idf[:, None]).astype(np.float64))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((size + 1, width))
            for b in batches:
                every = np.concatenate([np.zeros((0, PASSAGE), np.int32), *[_windows(np.asarray(w, np.int32)) for w in b["words"]]])
                for lo in range(0, len(every), TILE):
                    p = every[lo : lo + TILE]
                    y = _project(p, sent.value)
                    for k in range(PASSAGE):
                        np.add.at(total, p[:, k], y)
            # Most tasks touch few of the words.
            touched = np.flatnonzero(total[:size].any(1))
            yield pd.DataFrame({"word": touched.astype(np.int32), "row": pd.Series(list(total[touched]), dtype=object)})

        each = [F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(width)]
        summed = found.select("words").mapInPandas(run, "word int, row array<double>").groupBy("word").agg(*each).toPandas()
        total = np.zeros((size, width))
        if len(summed):
            total[summed["word"]] = summed[[f"c{k}" for k in range(width)]].to_numpy()
        y = _project(items.passages, q * idf[:, None])
        for k in range(PASSAGE):
            np.add.at(total, items.passages[:, k], y)
        q, s, _ = np.linalg.svd(total * idf[:, None], full_matrices=False)
        vectors = q[:, :RANK]
    return (vectors * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros becomes a fixed direction of its own."""
    x = np.c_[x, np.zeros(len(x), x.dtype)]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x[length[:, 0] == 0, -1] = 1
    length[length == 0] = 1
    return x / length


class Buckets:
    """Passages of items by the signs of random projections of their latent vectors, in several tables."""

    def __init__(self, space: np.ndarray, passages: np.ndarray, cosine: float, seed: int = 11):
        bits = int(np.clip(round(np.log2(max(len(passages), 1) / BUCKET)), *BITS))
        # Two vectors at an angle have unlike signs with probability angle / pi.
        meet = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** bits
        tables = max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(meet, 1 - 1e-9)))))
        rng = np.random.default_rng(seed)
        self.shape = (tables, bits)
        # Whole numbers: their sums are exact in any order, so equal passages have equal signs.
        self.planes = np.rint(rng.standard_normal((space.shape[1], tables * bits)) * 64)
        self.scale = 2**20 / max(float(np.abs(space).max(initial=0)) * PASSAGE, 1e-30)
        codes = self.codes(_project(passages, space))
        self.order = np.argsort(codes, axis=0, kind="stable").T.copy()
        self.codes_sorted = np.take_along_axis(codes.T, self.order, 1)

    def codes(self, latent: np.ndarray) -> np.ndarray:
        """passages x tables."""
        side = (np.rint(latent.astype(np.float64) * self.scale) @ self.planes > 0).reshape(len(latent), *self.shape)
        return side @ (1 << np.arange(self.shape[1]))

    def pairs(self, latent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``latent``, item passage) of all that share a bucket, each pair once, some at a time."""
        codes = self.codes(latent)
        low = np.array([np.searchsorted(self.codes_sorted[t], codes[:, t], "left") for t in range(self.shape[0])])
        high = np.array([np.searchsorted(self.codes_sorted[t], codes[:, t], "right") for t in range(self.shape[0])])
        size = high - low
        upto = np.cumsum(size.sum(0))
        start = 0
        while start < len(latent):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + MOST_PAIRS, "right")))
            keys = []
            for t in range(self.shape[0]):
                n = size[t, start:stop]
                rows = np.repeat(np.arange(start, stop), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[t, start:stop], n)
                keys.append(rows * self.order.shape[1] + self.order[t, at])
            key = np.unique(np.concatenate(keys))
            yield key // self.order.shape[1], key % self.order.shape[1]
            start = stop


def common_run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the longest run of words at the same distance in a and b that touches the passages at a[i:] and b[j:]."""
    back = min(i, j)
    size = min(len(a) - i, len(b) - j) + back
    same = a[i - back : i - back + size] == b[j - back : j - back + size]
    edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
    starts, stops = edge[::2], edge[1::2]
    touching = (starts < back + PASSAGE) & (stops > back)
    return int((stops - starts)[touching].max(initial=0))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, 64 bits of b at a time by whole-number arithmetic."""
    where: dict[int, int] = {}
    for k, w in enumerate(b.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for w in a.tolist():
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def search(found: DataFrame, items: Items, space: np.ndarray, idf: np.ndarray, cosine: float, paraphrases: bool) -> DataFrame:
    """``doc, item, run, lcs, share, answer`` of every pair with a candidate passage.

    Passages of the documents are compared with those of the block's items that share a bucket with them.
    Without ``paraphrases`` only pairs with LEAK common consecutive words are kept and lcs, share and answer are 0.
    """
    context = found.sparkSession.sparkContext
    targets = _unit(_project(items.passages, space))
    telling = []
    for w in items.words:
        u = np.unique(w)
        telling.append(u[idf[u] >= np.median(idf[u])] if len(u) else u)
    sent = context.broadcast((items, targets, space, telling, idf, Buckets(space, items.passages, cosine)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, targets, space, telling, idf, buckets = sent.value
        for b in batches:
            best: dict[tuple, list] = {}
            texts = [np.asarray(w, np.int32) for w in b["words"]]
            docs = b["doc"].tolist()
            views = [_windows(w) for w in texts]
            owner = np.repeat(np.arange(len(texts)), [len(v) for v in views])
            place = np.concatenate([np.arange(len(v)) for v in views]) if views else np.zeros(0, int)
            every = np.concatenate(views) if views else np.zeros((0, PASSAGE), np.int32)
            met: list[np.ndarray] = []
            longest = max(map(len, texts), default=0) + 1
            for lo in range(0, len(every), TILE):
                part = every[lo : lo + TILE]
                latent = _project(part, space)
                unit = _unit(latent)
                share = known_share(part, idf).astype(unit.dtype) if paraphrases else np.ones(len(part), unit.dtype)
                for rows, cols in buckets.pairs(latent):
                    near = np.einsum("ij,ij->i", unit[rows], targets[cols]) * share[rows] >= cosine
                    rows, cols = rows[near], cols[near]
                    # A run of LEAK words through a passage has half of it side by side, or goes through another passage whole.
                    beside = (part[rows] == items.passages[cols]).sum(1) * 2 > PASSAGE
                    for r, c in zip(rows[beside].tolist(), cols[beside].tolist()):
                        item, j = items.at[c]
                        n = common_run(texts[owner[lo + r]], int(place[lo + r]), items.words[item], int(j))
                        if n >= LEAK or paraphrases:
                            pair = best.setdefault((docs[owner[lo + r]], int(item)), [0, 0, 0.0, 0.0])
                            pair[0] = max(pair[0], n)
                    if paraphrases:
                        # (text, item, place) in one number, so that what is near the same item lies together.
                        met.append(np.unique((owner[lo + rows].astype(np.int64) * len(items.words) + items.at[cols, 0]) * longest + place[lo + rows]))
            keys = np.concatenate(met) if met else np.zeros(0, np.int64)
            keys.sort()
            for group in np.split(keys, np.flatnonzero(np.diff(keys // longest)) + 1) if len(keys) else []:
                o, item = divmod(int(group[0]) // longest, len(items.words))
                places = np.unique(group % longest).tolist()
                # The passages near the item with what stands beside them.
                near_item = np.zeros(len(texts[o]), bool)
                inside = np.zeros(len(texts[o]), bool)
                for at in places:
                    inside[at : at + PASSAGE] = True
                    near_item[max(0, at - LEAK) : at + PASSAGE + LEAK] = True
                told = texts[o][near_item]
                length = common_subsequence(told, items.words[item])
                pair = best.setdefault((docs[o], item), [0, 0, 0.0, 0.0])
                pair[1] = max(pair[1], length)
                pair[2] = max(pair[2], common_subsequence(texts[o][inside], items.words[item]) / min(int(inside.sum()), len(items.words[item])))
                pair[3] = max(pair[3], float(np.isin(telling[item], told).mean()))
            yield pd.DataFrame([(d, str(items.ids[i]), *v) for (d, i), v in best.items()], columns=["doc", "item", "run", "lcs", "share", "answer"])

    pairs = found.select("doc", "words").mapInPandas(run, "doc string, item string, run int, lcs int, share double, answer double")
    return pairs.groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in ("run", "lcs", "share", "answer")])


def label() -> Column:
    """``copied`` from LEAK common consecutive words on; ``paraphrased`` by a long common subsequence that has the item's telling words or most of the shorter text; else ``similar``."""
    told = (F.col("lcs") >= PARAPHRASE_WORDS) & (((F.col("answer") >= PARAPHRASE_ANSWER) & (F.col("share") >= PARAPHRASE_PART)) | (F.col("share") >= PARAPHRASE_SHARE))
    return F.when(F.col("run") >= LEAK, "copied").when(told, "paraphrased").otherwise("similar")


def leaks(documents: DataFrame, items: DataFrame, cosine: float, paraphrases: bool, least: int = LEAK, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of document and item: ``doc_key, item_key, run, lcs, share, answer``.

    For paraphrases lcs and answer are of the passages near the item with LEAK words on either side, share is the
    common subsequence's share of the passages alone (or of the item, if that is shorter), unknown words
    included; ``least`` is only for copied runs.
    Equal passages share their buckets and have cosine 1, so no leak of LEAK words can be missed at any
    ``cosine`` below 1. Without items or documents there are no rows.
    """
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[doc_key], dict(items.dtypes)[item_key]
    out = None
    for block in blocks_of(items.filter(F.col(item_key).isNotNull()), item_key, text):
        if not len(block.passages):
            continue
        rows = cut(stretches(documents, block, doc_key, text, least, paraphrases), "leaks")
        sums = rows.filter("kind = 'f'").select(F.posexplode("words").alias("word", "n")).groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        frequency = np.zeros(len(block.number) + 2)
        frequency[sums["word"]] = sums["n"]
        idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
        found = rows.filter("kind = 's'")
        if paraphrases:
            found = cut(reachable(found, idf, cosine), "reachable")
        found = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "start")
        space = latent_space(found, block, idf[:-1])
        pairs = search(found, block, space, idf, cosine, paraphrases)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        out = spark.createDataFrame([], "doc string, item string, run int, lcs int, share double, answer double")
    return out.select(F.col("doc").cast(kinds[0]).alias(doc_key), F.col("item").cast(kinds[1]).alias(item_key), "run", "lcs", F.round("share", 6).alias("share"), F.round("answer", 6).alias("answer"))
