import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tsq.llm.bpe import VOCABULARY, PairIndexBPE, encode_texts
from tsq.sources.tables import table

TEXTS = ["", " ", "a", "aaaaaaa", "Hello world's  end\n\n  x", "<|endoftext|> hi", "日本語のテキスト", "é​﻿", "\x00\x1f\x85", "🙂👩‍👩‍👧", "x" * 3000, "1234567890 " * 50, "don't we'll I'M"]


@pytest.fixture(scope="module")
def mine():
    return PairIndexBPE(open(VOCABULARY, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_odd_texts(mine, library):
    assert list(mine.encode(TEXTS)) == [library(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_any_text(mine, library, texts):
    assert list(mine.encode(texts)) == [library(t) for t in texts]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    from tsq.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20)
    m = PairIndexBPE(open(VOCABULARY, encoding="utf-8").read())
    texts = ["one two three four five", "two three six", "", "five one seven eight"] * 3
    assert list(m.encode(texts)) == [library(t) for t in texts]


def test_whole_table(spark, data, library):
    docs = table(spark, data, "documents")
    got = encode_texts(docs.unionByName(docs).select("doc_id", "text", "n_chars")).collect()
    assert len(got) == 2 * docs.count()
    assert all(r.ids == (None if r.text is None else library(r.text)) for r in got)


def test_nulls_empty_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (None, "a b", "y")], "doc_id bigint, text string, Ids2 string")
    assert [(r.doc_id, r.ids) for r in encode_texts(df).collect()] == [(1, None), (2, []), (None, [64, 275])]
    with pytest.raises(ValueError):
        encode_texts(df, ids="ids2")
    assert encode_texts(df.limit(0)).count() == 0
