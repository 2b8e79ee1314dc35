"""Token ids of a whole corpus under a published byte-level vocabulary.

Method: forced-boundary splitting. Merging never leaves the vocabulary, so a pair of bytes that stands
inside no token is never bridged: there a cut is certain. Texts are cut at such pairs, found with one
table look-up per byte; the fragments (mostly single words with their leading blank) are encoded
independently, each distinct one once, and the ids are concatenated.

A cut of the text must also leave the pre-splitting pattern as it is. That pattern looks ahead only
from white space and treats an apostrophe by what follows it, so no cut is made after white space,
before an apostrophe or inside a character; runs of letters, digits or signs that a cut divides go on
as the same kind of run, and a forced pair inside them is a boundary of the merges anyway.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyflow.sources.tables import spread

#: The folder of the public vocabularies, the same on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fragments remembered by a worker, and the longest one worth remembering.
MEMORY, LONGEST = 400_000, 64
#: Bytes of text encoded at a time (a longer text is encoded alone, still whole).
SLICE = 1 << 21


@lru_cache(maxsize=4)
def load(path: str):
    """(encoder of plain text, table of forced pairs) of a rank file."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoder, forced_pairs(ranks)


def forced_pairs(tokens) -> np.ndarray:
    """256 x 256 flags: a text may be cut between these two bytes."""
    forced = np.ones((256, 256), bool)
    for t in tokens:
        for x, y in zip(t, t[1:]):
            forced[x, y] = False
    blank = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
    forced[blank, :] = False
    forced[:, ord("'")] = False
    forced[:, 0x80:0xC0] = False
    # The last byte of white space beyond ASCII, whatever stands before it: 85, 80 to 8A, A0, A8, A9, AF, 9F.
    forced[[0x85, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], :] = False
    return forced


class Encoder:
    """Encodes UTF-8 texts; fragments met before are looked up."""

    def __init__(self, path: str):
        self.plain, table = load(path)
        self.flags = table.reshape(-1)
        self.known: dict[bytes, tuple[int, ...]] = {}


    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more entry than texts).

        data: the bytes of all texts; offsets: where each starts, and the end. All cuts of the batch are
        found at once; where a text starts there is always one.
        """
        if len(self.known) > MEMORY:
            self.known.clear()
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int32)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.flags[(data[:-1].astype(np.int32) << 8) | data[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        raw = data.tobytes()
        ends = at.tolist()
        parts = [raw[a:b] for a, b in zip(ends, ends[1:])]
        known = self.known
        found = list(map(known.get, parts))
        if None in found:
            plain = self.plain.encode_ordinary
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    ids = known.get(part)
                    if ids is None:
                        ids = tuple(plain(part.decode("utf-8")))
                        if len(part) <= LONGEST:
                            known[part] = ids
                    found[i] = ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(total[-1]))
        return ids, total[np.searchsorted(at, offsets)].astype(np.int32)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a rank file; its memory serves all batches of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(documents: DataFrame, text: str = "text", key: str = "doc_id", also: tuple[str, ...] = (), folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids`` (and the columns ``also``) of every document, without special tokens.

    Null and empty texts have the empty list; the strings of special tokens are ordinary text. Each
    document is encoded whole where it lies; nothing is shuffled.
    """
    path = os.path.join(folder, vocabulary)
    kinds = dict(documents.dtypes)
    keep = (key, *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.large_string())
            if texts.null_count:
                texts = texts.fill_null("")
            n = len(texts)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
            buffer = texts.buffers()[2]
            data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and n else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
            kept = [b.column(b.schema.get_field_index(k)) for k in keep]
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
                ids, starts = encoder.encode_batch(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in kept], lists], [*keep, "ids"])
                lo = hi

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", ids array<int>"
    return spread(documents.select(*keep, text), key).mapInArrow(run, schema)
