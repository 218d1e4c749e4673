"""Token ids against the public libraries, and speculation against exact merging."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellmend.llm.bpe import DEFAULT_DIRECTORY, _Worker, encode_column, load_vocabulary, tokenizer_path

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(tokenizer_path(DEFAULT_DIRECTORY, "byte_bpe_50k"))


@pytest.fixture(scope="module")
def reference(vocabulary):
    from cellmend.llm.bpe import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


TEXTS = ["", " ", "Hello  world\n\n\tx", "<|endoftext|>", "naïve café ﬁ 😀👍🏽", "日本語のテキスト", "don't we'll I'VE", "a" * 3000, "zzzqqqxxx" * 40, "1234567890 " * 20, "\u0000﻿", "aaaaabbbbb" * 300 + "é" * 500]


def test_words_equal_reference(vocabulary, reference):
    worker = _Worker(vocabulary)
    rng = random.Random(5)
    alphabet = "abcdefghij ABC,.-'\né日🙂0123"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    assert worker.encode(texts) == [reference.encode_ordinary(t) for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_equals_reference(vocabulary, reference, text):
    assert _Worker(vocabulary).encode([text]) == [reference.encode_ordinary(text)]


def test_compatibility_is_merging_of_both(vocabulary):
    rng = random.Random(6)
    by_id = {i: b for b, i in vocabulary.ranks.items()}
    pairs = [(rng.randrange(50_000), rng.randrange(50_000)) for _ in range(3000)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(3000)]
    got = vocabulary.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [vocabulary.merge(by_id[a] + by_id[b]) == [a, b] for a, b in pairs]


def test_column(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None, TEXTS[2], "x " * 100_000])] + [(None, "null id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_column(spark, df, "text", ["doc_id"]).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t, _ in rows}
    counts = {r.doc_id: r.n for r in encode_column(spark, df, "text", ["doc_id"], "n", count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode_column(spark, df.where("false"), "text", ["doc_id"]).collect() == []
