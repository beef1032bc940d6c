import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tsq.functions import histogram as hg
from tsq.functions import text
from tsq.functions import values as va
from tsq.plans import folding
from tsq.schema import MV_DDL

NUMBERS = [0, 1, -1, 2, 7, -7, 42, (1 << 31), -(1 << 63), (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 0.0, 2.5, -0.5, 1e300, math.inf, -math.inf, math.nan]
OTHERS = [None, True, False, "", "text"]
OPS = [op for op in va.BINARY if op not in ("<<", ">>")]


def constant(r):
    if r is None:
        return "absent"
    k = r["kind"]
    return None if k == 0 else r["b"] if k == 1 else (r["i"] if r["i"] is not None else int(r["u"])) if k in (2, 3) else r["d"] if k == 4 else r["s"] if k == 5 else [tuple(x) for x in r["h"]]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (a != a and b != b) or math.isclose(a, b, rel_tol=1e-12)
    return type(a) is type(b) and a == b


def mv(x):
    k = 0 if x is None else 1 if isinstance(x, bool) else (2 if x < 0 else 3) if isinstance(x, int) else 4 if isinstance(x, float) else 5 if isinstance(x, str) else 6
    big = k == 3 and x >= 1 << 63
    return k, x if k == 1 else None, x if k in (2, 3) and not big else None, Decimal(x) if big else None, x if k == 4 else None, x if k == 5 else None, [tuple(map(float, r)) for r in x] if k == 6 else None


def rows(spark, *columns):
    """One row per tuple of constants, in order of i."""
    names = "xyz"[: len(columns)]
    return spark.createDataFrame([(i, *map(mv, r)) for i, r in enumerate(zip(*columns))], "i int, " + ", ".join(f"{n} {MV_DDL}" for n in names))


def run(spark, op, pairs):
    df = rows(spark, [x for x, _ in pairs], [y for _, y in pairs]).select("i", va.BINARY[op](F.col("x"), F.col("y")).alias("r"))
    return [constant(r.r) for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("op", OPS)
def test_operators_match_their_python_reference(spark, op):
    rnd = random.Random(1)
    pairs = rnd.sample(list(itertools.product(NUMBERS, NUMBERS)), 90) + rnd.sample(list(itertools.product(NUMBERS + OTHERS, OTHERS)), 30)
    for (x, y), got in zip(pairs, run(spark, op, pairs)):
        want = folding.binary(op, x, y)
        if op == "%" and isinstance(want, float) and y and not abs(x / y) < 2**52:
            continue  # the remainder of a huge quotient is lost to rounding
        assert same(got, want), (op, x, y, got, want)


@pytest.mark.parametrize("op", ["<<", ">>"])
def test_shifts(spark, op):
    pairs = list(itertools.product([0, 1, -1, 3, -8, 1000, (1 << 63), (1 << 63) - 1, 2.5], [0, 1, 3, 62, 63, 64, 70, -1, -3, -64, 0.5, True]))
    for (x, y), got in zip(pairs, run(spark, op, pairs)):
        want = folding.binary(op, x, y)
        assert same(got, want), (op, x, y, got, want)


def test_intended_results():
    b = folding.binary
    assert b("!=", 1, 2) is True and b("<=", 1, 1) is True and b(">=", -1, 1) is False and b("<", -1, 1) is True
    assert b("*", 3, 0.5) == 1.5 and b("%", 7, -2) == 1 and b("%", -7, 2) == -1 and b("%", 5.5, 2.0) == -0.5 and b(">>", 5.0, 1) == 2.5
    assert b("/", 1, 0) is None and b("/", 6, 3) == 2 and b("/", 1, 2) == 0.5 and b("+", "a", 1) is None and b("=", True, 1) is True and b("<", "a", "b") is None
    assert b("+", (1 << 64) - 1, 1) == 2.0**64 and b("-", -(1 << 63), 1) == -(2.0**63) - 1


def test_absent_and_unary(spark):
    xs = NUMBERS + OTHERS
    df = rows(spark, xs, xs)
    r = df.select(*[f(va.absent(), F.col("y")).alias(f"c{i}") for i, f in enumerate([va.add, va.equal, va.logical_and, va.less])], *[f(va.absent()).alias(n) for n, f in (("a", va.negate), ("b", va.logical_not))]).first()
    assert all(x is None for x in r)
    r = df.select("i", va.negate(F.col("x")).alias("n"), va.logical_not(F.col("x")).alias("t")).orderBy("i").collect()
    for x, got in zip(xs, r):
        assert same(constant(got.n), folding.unary("-", x)) and same(constant(got.t), folding.unary("!", x)), x


def test_equality_order_and_text(spark):
    order = [None, False, True, -math.inf, -(1 << 63), -1, 0, 0.5, 1, 42, 42.5, (1 << 64) - 1, "", "a", "b", [(0, 1, 2)]]
    assert [r.i for r in rows(spark, order).select("i", va.sort_key(F.col("x")).alias("k")).orderBy(F.desc("k")).collect()] == [*range(len(order))][::-1]
    pairs = [(42, 42.0, True), (-0.0, 0, True), (True, 1, False), ("a", "a", True), (None, None, True), (1, "1", False), (False, False, True), ([(0, 1, 2)], [(0, 1, 2)], True), (math.nan, math.nan, False)]
    got = rows(spark, [x for x, *_ in pairs], [y for _, y, _ in pairs]).select("i", va.strictly_equal(F.col("x"), F.col("y")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [e for *_, e in pairs]
    texts = [(None, "(none)"), (True, "true"), (17, "17"), (-17, "-17"), ("foobar", '"foobar"'), ("foo\u1017\n\"\\\x01", '"foo\\u1017\\n\\"\\\\\\001"'), ([], "[]"), ([(0, 1, 2), (3, 4, 5)], "[ 0..1=2, 3..4=5 ]"), (2.0, "2.0")]
    assert [r.t for r in rows(spark, [x for x, _ in texts]).select("i", text.value(F.col("x")).alias("t")).orderBy("i").collect()] == [t for _, t in texts]
    xs = [True, 3, 2.5, "s", None, []]
    assert [r.t for r in rows(spark, xs).select("i", va.as_string(F.col("x")).alias("t")).orderBy("i").collect()] == ["true", "3", "2.500000", "s", None, None]


def hist(spark, column):
    r = spark.range(1).select(column.alias("h")).first().h
    return None if r is None else [tuple(x) for x in r]


def test_histograms(spark):
    L = hg.literal
    assert hist(spark, hg.normalise(L([(0, 10, 10), (5, 15, 20)]))) == [(0, 5, 5), (5, 10, 15), (10, 15, 10)]
    assert hist(spark, hg.normalise(L([(0, 10, 10), (2, 4, 6)]))) == [(0, 2, 2), (2, 4, 8), (4, 10, 6)]
    assert hist(spark, hg.normalise(L([(0, 1, 2), (0, 1, 3), (5, 5, 9)]))) == [(0, 1, 5)]
    assert hist(spark, hg.subtract(L([(0, 1, 2), (2, 3, 4)]), L([(0, 1, 2)]))) == [(2, 3, 4)]
    assert hist(spark, hg.normalise(L([]))) == [] and hist(spark, hg.scale_down(L([(0, 1, 2)]), F.lit(0.0))) is None
    r = spark.range(1).select(hg.low(L([])), hg.mean(L([])), hg.count(L([])), hg.total(L([(0, 2, 3)])), hg.mean(L([(0, 2, 3)])), hg.high(L([(0, 2, 3), (4, 5, 1)]))).first()
    assert list(r) == [None, None, 0.0, 3.0, 1.0, 5.0]
    v = lambda c: constant(rows(spark, [[(0, 1, 2)]], [3], [0]).select(c.alias("c")).first().c)
    h, n = F.col("x"), F.col("y")
    assert v(va.multiply(n, h)) == [(0, 1, 6)] and v(va.multiply(h, h)) is None and v(va.add(h, n)) is None and v(va.divide(h, F.col("z"))) is None and v(va.equal(h, h)) is True and v(va.negate(h)) == [(0, 1, -2)]


def test_interpolation(spark):
    at = lambda t, a, b: constant(spark.range(1).select(va.interpolate(F.lit(t), F.lit(0), va.literal(a), F.lit(10), va.literal(b)).alias("c")).first().c)
    assert at(5, 16, 18) == 17.0 and at(2, 0.0, 10) == 2.0 and at(5, "a", "a") == "a" and at(5, "a", "b") == "absent" and at(5, True, True) is True
    assert at(5, True, False) == "absent" and at(5, None, 3) is None and at(5, 1, "a") == "absent" and at(5, [(0, 1, 2)], [(0, 1, 4)]) == [(0, 1, 3)]
