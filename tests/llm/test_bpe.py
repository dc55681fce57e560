import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import bpe
from lodestrata.llm.bpe import VOCABULARY, Encoder, encode_corpus, stretches
from lodestrata.shared import store

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def known():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return Encoder(VOCABULARY)


def check(encoder, known, texts):
    ids, starts = encoder.encode(texts)
    want = [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


TEXTS = ["", None, "a", " ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 30_000, "=" * 5001, "the  the\n\n\tthe'll I'd", "<|endoftext|>", "naïve café 中文字 🎉​﻿", "0123456789" * 50, "\r\n \x00\x7f", "É" * 99]


def test_same_ids_as_the_library(encoder, known):
    check(encoder, known, TEXTS)
    check(encoder, known, TEXTS[::-1])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(encoder, known, texts):
    check(encoder, known, texts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abe ts'", max_size=200))
def test_dense_overlaps(encoder, known, text):
    check(encoder, known, [text])


def test_round_trip(encoder, known):
    text = " ".join(t for t in TEXTS if t)
    ids, _ = encoder.encode([text])
    assert known.decode(ids.tolist(), skip_special_tokens=False) == text


def test_stretches_cover_all():
    texts = ["x" * 400, None, "", "y" * 5000, "z"]
    spans = list(stretches(texts, 1000))
    assert [i for a, b in spans for i in range(a, b)] == list(range(5)) and spans[0] == (0, 4)


def test_frame(spark, known):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("doc_id", "ids_of")
    got = {r.ids_of: r.ids for r in encode_corpus(df, "text").collect()}
    assert got[0] == [] and got[1] == [] and got == {i: known.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    sizes = {r.ids_of: r.n for r in encode_corpus(df, "text", "n", sizes_only=True).collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    assert encode_corpus(df.limit(0), "text").count() == 0
    small = {r.ids_of: r.ids for r in encode_corpus(df.unionAll(df).repartition(3), "text", stretch=20, heap=10).collect()}
    assert small == got


def test_clashing_and_nested_columns(spark, known):
    df = spark.createDataFrame([("a b", 1, {"k": 2}, [None, 3], None)], "text string, ids int, words map<string,int>, codes array<int>, stretch string")
    row = encode_corpus(df, "text").collect()[0]
    assert row.asDict() == {"words": {"k": 2}, "codes": [None, 3], "stretch": None, "ids": known.encode("a b", add_special_tokens=False).ids}


def test_no_stored_row_holds_more_than_a_word_or_a_text(spark, known, monkeypatch):
    stored = []
    monkeypatch.setattr(bpe, "store", lambda df, label: (stored.append(store(df, label)), stored[-1])[1])
    texts = [f"word{i} and {i}" for i in range(500)] + ["", None, "the longest of all, by some words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.ids for r in encode_corpus(df, "text").collect()} == {i: known.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    for table, _ in stored:
        lists = [c for c, kind in table.dtypes if kind.startswith("array")]
        assert not [kind for _, kind in table.dtypes if kind.startswith("array<array")]
        assert all(r[0] <= 20 for c in lists for r in table.select(F.max(F.size(c))).collect())


def test_replay_holds_few_bytes_for_each_of_its_text(known):
    words = [w.encode() for w in (" the", " repeated", "words", " of", "many", " texts", "ééé", "0101", "aaaaa")] * 40_000
    total = sum(map(len, words))
    merges = bpe.Merges(VOCABULARY)
    tracemalloc.start()
    try:
        ids, starts = merges.replay(words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 50 * total
    assert ids.dtype == np.int32 and len(starts) == len(words) + 1
    assert [ids[a:b].tolist() for a, b in zip(starts[:9], starts[1:10])] == [known.encode(w.decode(), add_special_tokens=False).ids for w in words[:9]]
    assert (ids == np.tile(ids[: starts[9]], 40_000)).all()


def test_bytes_of_arrow_words():
    words = ["skipped", "", "é", " 中", "x" * 40, "last"]
    for kind in (pa.string(), pa.large_string()):
        text, starts = bpe.flat_words(pa.array(words, kind).slice(1, 4))
        assert [text[a:b].tobytes().decode() for a, b in zip(starts, starts[1:])] == words[1:5]
    text, starts = bpe.flat_words(pa.array([], pa.string()))
    assert len(text) == 0 and starts.tolist() == [0]
