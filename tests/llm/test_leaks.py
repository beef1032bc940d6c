import random

import pytest

from tsq.llm.leaks import Matcher, leaks, myers, words

ITEM = "The amber gardener polished Falwendra's blanket outside the ancient railway arch while fifty potters borrowed another flimsy umbrella around noon today"


def held(text, item=ITEM):
    return bool(Matcher([(1, item)]).find(text))


def test_myers_against_dynamic_programming():
    rnd = random.Random(4)
    for _ in range(300):
        p, t = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))], [rnd.randint(0, 4) for _ in range(rnd.randint(0, 20))]
        masks = {}
        for i, w in enumerate(p):
            masks[w] = masks.get(w, 0) | 1 << i
        row = list(range(len(p) + 1))
        best = row[-1]
        for w in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert myers(masks, len(p), t) == best


@pytest.mark.parametrize(
    "text",
    [
        ITEM,
        "foo bar " + " ".join(ITEM.split()[4:16]) + " baz",
        ITEM.upper().replace(" ", "  "),
        "> " + "\n> ".join(ITEM.split()),
        "<p>" + ITEM.replace("amber", "<b>am</b>ber").replace(" outside", "<br/>outside") + "</p>",
        ITEM.replace("'", "&rsquo;").replace("polished", "po­li​shed").replace("gardener", "gárdener"),
        ITEM.replace("flimsy", "ﬂimsy").replace("fifty", "**ﬁfty**"),
        "the amber gardener polished falwendras blanket outside xxx ancient railway arch while yyy potters",
        "the amber gardener polished blanket outside ancient railway arch while fifty potters",
        "the amber new gardener polished falwendras blanket outside the ancient railway two arch while fifty",
    ],
)
def test_what_doesn_t_count_and_two_edits(text):
    assert held(text)


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ".join(ITEM.split()[:9]),
        " ".join(reversed(ITEM.split())),
        " ".join(w + " foreign" for w in ITEM.split()),
        "the amber gardener xxx falwendras blanket yyy the ancient railway zzz while fifty potters www another flimsy",
    ],
)
def test_too_few_or_too_altered(text):
    assert not held(text)


def brute(item, text, window=12, errors=2):
    a, b = words(item), words(text)
    for s in range(len(a) - window + 1):
        row = list(range(window + 1))
        for w in [None, *b]:
            if w is not None:
                new = [0]
                for i in range(window):
                    new.append(min(row[i] + (a[s + i] != w), row[i + 1] + 1, new[i] + 1))
                row = new
            if row[-1] <= errors:
                return True
    return False


def test_pieces_lose_nothing():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(250):
        item = [rnd.choice(vocabulary) for _ in range(rnd.randint(10, 20))]
        at = rnd.randint(0, 4)
        text = item[at : at + rnd.randint(8, 16)]
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(text) - 1)
            text[k : k + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
        i, t = " ".join(item), " ".join(text)
        assert bool(Matcher([(1, i)]).find(t)) == brute(i, t)


def test_shared_passages_repeats_nulls_and_blocks(spark, monkeypatch):
    from tsq.llm import leaks as module

    monkeypatch.setattr(module, "BLOCK_ITEMS", 1)
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "Yesterday. " + ITEM), (3, "too short"), (4, None), (None, ITEM), (5, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, ITEM, 1), (10, ITEM, 1), (11, "nothing", 2), (12, None, 3), (None, ITEM, 4), (13, "x " * 50_000 + ITEM, 5), (14, "", 6)], "doc_id bigint, text string, item_id int")
    assert sorted((r.item_id, r.doc_id, r.edits) for r in leaks(items, docs).collect()) == [(i, d, 0) for i in (1, 2) for d in (10, 13)]
    assert leaks(items.limit(0), docs).count() == leaks(items, docs.limit(0)).count() == 0


def test_edits_are_those_of_the_best_window():
    ws = ITEM.split()
    assert Matcher([(1, ITEM)]).find(" ".join([*ws[:4], "foreign", *ws[4:]])) == [(1, 0)]
    assert Matcher([(1, ITEM)]).find(" ".join([*ws[:4], "foreign", *ws[5:12], "alien", *ws[13:]])) == [(1, 1)]
