import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyflow.llm.bpe_encode import TOKENIZERS, VOCABULARY, Encoder, encode_documents, forced_pairs

PATH = os.path.join(TOKENIZERS, VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def encode(encoder, texts):
    raws = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raws)])
    ids, starts = encoder.encode_batch(np.frombuffer(b"".join(raws), np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_forced_pairs():
    table = forced_pairs([b"ab", b"bc", b" a"])
    assert not table[ord("a"), ord("b")] and table[ord("a"), ord("c")]
    assert not table[ord(" "), ord("x")] and not table[ord("x"), ord("'")] and not table[ord("x"), 0x80]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sdtlrevm S  \n\t\r.,!?09é×’—λя中　​`_-<|endoftext|>\x1c\x85 Ⅻ²á👩"), max_size=40), max_size=4))
def test_equals_the_plain_encoder(encoder, texts):
    assert encode(encoder, texts) == [encoder.plain.encode_ordinary(t) for t in texts]


def test_equals_the_other_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "  two  blanks \n\n end\n", "It's we'll 12,345.678 <|endoftext|> x", "naïve — ≤ 中文", "a" * 5000, "  x y"]
    assert encode(encoder, texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, encoder):
    long = "word, " * 500_000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "Hello world's end", None), (5, long, "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_documents(df).collect()}
    assert got[1] == got[2] == []
    for k, t in ((3, " \n "), (4, "Hello world's end"), (5, long), (None, "a")):
        assert got[k] == encoder.plain.encode_ordinary(t)
    assert encode_documents(df.filter("doc_id = 77")).collect() == []
