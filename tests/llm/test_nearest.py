import random

import numpy as np
import pytest

from tsq.llm import nearest as module
from tsq.llm.nearest import XFastTrie, emits, nearest
from tsq.sources.tables import table

SCHEMA = "entity string, t bigint, id bigint, shard string, distance string"


def test_trie_against_search():
    rnd = np.random.default_rng(1)
    for bits in (1, 3, 10, 21):
        keys = np.unique(rnd.integers(0, 1 << bits, 200))
        q = np.r_[rnd.integers(0, 1 << bits, 300), keys]
        pred, succ = XFastTrie(keys, bits).neighbours(q)
        assert (pred == np.searchsorted(keys, q, "right") - 1).all() and (succ == np.searchsorted(keys, q, "left")).all()


def brute(left, right, tolerance):
    out = set()
    for e, t, i, *_ in left:
        if None in (e, t, i):
            continue
        near = [(abs(t - u), u, j) for f, u, j, *_ in right if f == e and None not in (f, u, j) and abs(t - u) <= tolerance]
        if near:
            d, _, j = min(near)
            out.add((i, j, d))
    return out


@pytest.mark.parametrize("bits", [6, 10])
def test_matches_brute_force_across_shards_with_ties(spark, bits):
    rnd = random.Random(bits)
    side = lambda n, start: [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, *[rnd.randint(-900, 900)] * 9]), start + i, "x", "y") for i in range(n)]
    left, right = side(250, 0), side(200, 1000)
    left, right = left + left[:50], right + right[:50] + [("a", 5, None, "", "")]
    got = nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 25, bits).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(left, right, 25)


def test_the_tolerance_is_inclusive_and_the_earlier_of_two_wins(spark):
    left = spark.createDataFrame([("a", 100, 1, "", ""), ("a", 200, 2, "", "")], SCHEMA)
    right = spark.createDataFrame([("a", 90, 11, "", ""), ("a", 110, 10, "", ""), ("a", 211, 12, "", "")], SCHEMA)
    assert {tuple(r) for r in nearest(left, right, 10).collect()} == {(1, 11, 10)}
    with pytest.raises(ValueError):
        nearest(left, right, 1 << 21)


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, 1, "", "")], SCHEMA)
    assert nearest(none, some, 5).count() == nearest(some, none, 5).count() == nearest(none, none, 5).count() == 0


def test_only_emits_with_a_number_take_part(spark, data):
    s, v = emits(table(spark, data, "scalar_emits"), table(spark, data, "vector_emits"))
    ok = lambda m: m is not None and (m.kind in (2, 3) or m.kind == 4 and m.d == m.d)
    assert sorted(r.id for r in s.collect()) == sorted(r.emit_id for r in table(spark, data, "scalar_emits").collect() if ok(r.value))
    assert sorted(r.id for r in v.collect()) == sorted(r.emit_id for r in table(spark, data, "vector_emits").collect() if any(ok(x.value) for x in r.tagged or []))


def test_shards_share_tries_and_long_shards_are_matched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "TRIE_ROWS", 50)
    rnd = random.Random(8)
    # many short shards, and one of 3000 rows with ties on both sides, cut into small batches
    row = lambda i, e, t: (e, t, i, "", "")
    left = [row(i, f"e{rnd.randrange(20)}", rnd.randrange(1 << 14)) for i in range(400)] + [row(i, "hot", 5000 + rnd.randrange(900)) for i in range(400, 2000)]
    right = [row(i, f"e{rnd.randrange(20)}", rnd.randrange(1 << 14)) for i in range(5000, 5400)] + [row(i, "hot", 5000 + rnd.randrange(900)) for i in range(5400, 6800)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = nearest(spark.createDataFrame(left + left[::7], SCHEMA), spark.createDataFrame(right + right[::5], SCHEMA), 60, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(brute(left, right, 60))


def test_no_key_of_another_shard_is_within_the_tolerance(spark):
    for tolerance in (1, 511, 1023):
        left = [("a", 1023, 1, "", ""), ("b", 0, 2, "", "")]
        right = [("a", 2046, 3, "", ""), ("a", 1023 + 512, 4, "", ""), ("b", -511, 5, "", "")]
        got = nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), tolerance, 10).collect()
        assert sorted(map(tuple, got)) == sorted(brute(left, right, tolerance))
