import os
import random

import pytest

from cairnwork.llm.bpe import PATTERN, TOKENIZERS, BytePairEncoder, encode_texts, read_ranks

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary files here")

TEXTS = ["", None, " ", "\n\n  x\t", "Hello world, it's 2024!", "<|endoftext|>", "été 中文テスト мир 🚀‍👩", "a" * 5000, "0" * 777, "​﻿\x1c\x85", "    let rows = x.iter();\n", "é", "don'T we'LL"]


@pytest.fixture(scope="module")
def known():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(FILE), special_tokens={})


def test_segment_tree_against_the_library(known):
    own = BytePairEncoder(read_ranks(FILE))
    rnd = random.Random(1)
    alphabet = [chr(c) for c in range(1, 0x2FFF)] + list(" \n\t'aeiou the")
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rnd.choice("ab") for _ in range(300)), "ab" * 2000, "the" * 999]
    for t in texts:
        assert own.encode(t) == known.encode_ordinary(t), ascii(t)[:80]


def test_merging_is_leftmost_and_by_rank():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4, b"aa": 5}
    own = BytePairEncoder(ranks)
    assert own.merge(b"aaa") == [5, 0] and own.merge(b"abab") == [2, 2] and own.merge(b"baab") == [3, 2] and own.merge(b"a") == [0]


def test_memory_is_bounded(monkeypatch):
    import cairnwork.llm.bpe as B

    monkeypatch.setattr(B, "REMEMBERED", 10)
    own = BytePairEncoder(read_ranks(FILE))
    for i in range(100):
        own.encode(f"w{i}x")
    assert len(own.memory) <= 10


def test_frame(spark, known):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_texts(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    out = [(r["doc_id"], r["ids"]) for r in got.collect()]
    want = [(i, known.encode_ordinary(t) if t else []) for i, t, _ in rows]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    counts = [(r["doc_id"], r["n_tokens"]) for r in encode_texts(df, "doc_id", "text", counts=True).collect()]
    assert sorted(counts, key=repr) == sorted(((i, len(x)) for i, x in want), key=repr)
    assert encode_texts(df.limit(0), "doc_id", "text").collect() == []
