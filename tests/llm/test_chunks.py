import random

import pytest
import tokenizers

from tsq.llm.bpe import VOCABULARY, PairIndexBPE
from tsq.llm.chunks import pieces, segments, split_texts
from tsq.sources.tables import table


@pytest.fixture(scope="module")
def bpe():
    return PairIndexBPE(open(VOCABULARY, encoding="utf-8").read())


@pytest.fixture(scope="module")
def count():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


def cut(bpe, text, **k):
    ws, ids = next(iter(bpe.words([text])))
    return pieces(bpe, ws, ids, **k)


def check(text, ps, limit, overlap, count):
    assert ps[0][0] == 0 and ps[-1][1] == len(text)
    for k, (a, e, n, over) in enumerate(ps):
        assert n == count(text[a:e]) <= limit and a < e
        if k:
            p = ps[k - 1]
            assert p[0] < a <= p[1] < e  # it begins within the one before
            assert over <= overlap


TEXTS = {
    "sentences": " ".join(f"This is sentence number {i} of the text." for i in range(200)),
    "paragraphs": "\n\n".join("A short line of words, and more. " * 12 for _ in range(12)),
    "no blanks": "x7Qz" * 2000,
    "kana": "これは長い文章です。とても長いです、" * 150,
    "emoji": "👩‍👩‍👧🙂" * 400,
    "blanks": "a" + " " * 3000 + "b\n" * 900,
    "mixed": "word " * 300 + "y" * 5000 + ". Next sentence here! " * 80,
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("limit, overlap", [(512, 64), (64, 0), (50, 25)])
def test_pieces_fit_and_make_up_the_text(bpe, count, name, limit, overlap):
    check(TEXTS[name], cut(bpe, TEXTS[name], limit=limit, overlap=overlap), limit, overlap, count)


def test_cuts_lie_at_sentences_and_overlaps_are_as_long_as_they_may(bpe):
    t = TEXTS["sentences"]
    ps = cut(bpe, t)
    for a, b in zip(ps, ps[1:]):
        assert t[: a[1]].rstrip().endswith(".")
        assert 56 <= b[3] <= 64


def test_merging_takes_the_weakest_boundary_first():
    # without room to merge all, the strong boundary in the middle stays
    assert segments([3, 3, 3, 3], [1, 4, 1, 5], 8, 2) == [0, 2]
    assert segments([5, 5], [0, 0], 8, 2) == [0, 1]
    assert segments([], [], 8, 2) == []
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 30)
        sizes, strengths = [rnd.randint(1, 6) for _ in range(n)], [rnd.randint(0, 5) for _ in range(n)]
        s = segments(sizes, strengths, 12, 3)
        whole = [sum(sizes[a:b]) for a, b in zip(s, [*s[1:], n])]
        assert all(x <= 9 for x in whole) and all(x + y > 9 for x, y in zip(whole, whole[1:]))


def test_table(spark, data, count):
    docs = table(spark, data.replace("0.001", "0.01"), "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in split_texts(docs).collect():
        got.setdefault(r.doc_id, []).append((r.piece_no, r.first_char, r.end_char, r.n_tokens, r.overlap_tokens, r.piece))
    assert set(got) == {d for d, t in texts.items() if t and count(t) > 512}
    for d, ps in got.items():
        ps.sort()
        check(texts[d], [p[1:5] for p in ps], 512, 64, count)
        assert all(texts[d][p[1] : p[2]] == p[5] for p in ps)


def test_nulls_empty_and_short_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "short", 0), (None, "word " * 600, 0)], "doc_id bigint, text string, piece_no int")
    assert {(r.doc_id) for r in split_texts(df).collect()} == {None}
    every = split_texts(df, oversized_only=False).where("piece_no = 0").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in every if r.doc_id) == [(2, 0), (3, 1)]
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, limit=100, overlap=80)
