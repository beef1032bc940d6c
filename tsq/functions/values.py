"""Kernels on dynamically typed values: coercions, logic, comparison, arithmetic. All are built-in column expressions.

Arguments and results are MV columns. An absent (null) operand gives an absent result; where an operator isn't defined for the operands' kinds the result is
empty (kind 0), never an error. Booleans count as 0 and 1 in arithmetic and comparisons.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.functions import histogram as hg
from tsq.schema import BOOL, DOUBLE, EMPTY, HISTOGRAM, HISTOGRAM_DDL, MV_DDL, NEGATIVE, STRING, UNSIGNED

_WIDE = "decimal(38,0)"
_U64 = (1 << 64) - 1


def _make(kind: Column | int, **branches: Column) -> Column:
    types = {"b": "boolean", "i": "bigint", "u": "decimal(20,0)", "d": "double", "s": "string", "h": HISTOGRAM_DDL}
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.cast("tinyint").alias("kind"), *[branches.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def absent() -> Column:
    return F.lit(None).cast(MV_DDL)


def empty() -> Column:
    return _make(EMPTY)


def boolean(b: Column) -> Column:
    """Value of a boolean column; null gives an empty value."""
    return F.when(b.isNull(), empty()).otherwise(_make(BOOL, b=b))


def integer(i: Column) -> Column:
    """Value of a bigint column; null gives an absent value."""
    return F.when(i.isNull(), absent()).otherwise(_make(F.when(i < 0, NEGATIVE).otherwise(UNSIGNED), i=i))


def double(d: Column) -> Column:
    return F.when(d.isNull(), absent()).otherwise(_make(DOUBLE, d=d))


def string(s: Column) -> Column:
    return F.when(s.isNull(), absent()).otherwise(_make(STRING, s=s))


def histogram(h: Column) -> Column:
    return F.when(h.isNull(), absent()).otherwise(_make(HISTOGRAM, h=h))


def literal(x) -> Column:
    """Value of a Python constant: None is empty, lists of (lo, hi, cnt) are histograms."""
    if x is None:
        return empty()
    if isinstance(x, bool):
        return _make(BOOL, b=F.lit(x))
    if isinstance(x, int):
        if x > _U64 or x < -(1 << 63):
            return _make(DOUBLE, d=F.lit(float(x)))
        return _make(UNSIGNED, u=F.lit(str(x))) if x >= 1 << 63 else _make(NEGATIVE if x < 0 else UNSIGNED, i=F.lit(x))
    if isinstance(x, float):
        return _make(DOUBLE, d=F.lit(x))
    if isinstance(x, str):
        return _make(STRING, s=F.lit(x))
    return _make(HISTOGRAM, h=hg.literal(x))


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """f as a function that reads each argument column once, whole: the plan then has no field accesses for the optimizer to trace through nested operators, and stays small however deep they nest."""

    def call(*args: Column) -> Column:
        packed = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)])
        return F.get(F.transform(F.array(packed), lambda p: f(*[p.getField(f"a{i}") for i in range(len(args))])), F.lit(0))

    return call


# --- coercions ---


def is_integer(x: Column) -> Column:
    return x["kind"].isin(NEGATIVE, UNSIGNED)


def is_number(x: Column) -> Column:
    return x["kind"].isin(NEGATIVE, UNSIGNED, DOUBLE)


def as_bool(x: Column) -> Column:
    """Boolean of a value: numbers are true if not 0, histograms if not empty; texts and empty values have none."""
    k = x["kind"]
    return (
        F.when(k == BOOL, x["b"])
        .when(is_integer(x), F.coalesce(x["i"] != 0, x["u"] != 0))
        .when(k == DOUBLE, x["d"] != 0)
        .when(k == HISTOGRAM, F.size(x["h"]) > 0)
    )


def as_double(x: Column) -> Column:
    """Number of a value as a double, booleans as 0 and 1; null if it has none."""
    k = x["kind"]
    return F.when(k == DOUBLE, x["d"]).when(is_integer(x), F.coalesce(x["i"].cast("double"), x["u"].cast("double"))).when(k == BOOL, x["b"].cast("int").cast("double"))


def as_number(x: Column) -> Column:
    """x if it is a number, a boolean as 0 or 1; else an empty value."""
    return F.when(x.isNull(), absent()).when(x["kind"] == BOOL, integer(x["b"].cast("bigint"))).when(is_number(x), x).otherwise(empty())


def as_number_or_histogram(x: Column) -> Column:
    return F.when(x["kind"] == HISTOGRAM, x).otherwise(as_number(x))


def as_string(x: Column) -> Column:
    """Text of a value: doubles with six decimals; histograms and empty values have none."""
    k = x["kind"]
    d = x["d"]
    text = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(F.format_string("%.6f", d))
    return (
        F.when(k == BOOL, F.when(x["b"], "true").otherwise("false"))
        .when(is_integer(x), F.coalesce(x["i"].cast("string"), x["u"].cast("string")))
        .when(k == DOUBLE, text)
        .when(k == STRING, x["s"])
    )


def canonical(x: Column) -> Column:
    """x with whole doubles as integers, so that equal values are equal structs: for keys of joins and groups."""
    d = x["d"]
    whole = (x["kind"] == DOUBLE) & (d == F.rint(d)) & (F.abs(d) < float(1 << 63))
    return F.when(whole, integer(d.cast("bigint"))).otherwise(x)


def sort_key(x: Column) -> Column:
    """Struct in the weak order of values: empty, booleans, numbers by value, texts bytewise, histograms."""
    k = x["kind"]
    cls = F.when(is_number(x), NEGATIVE).otherwise(k)
    return F.struct(cls.alias("c"), x["b"].alias("b"), F.when(is_number(x), as_double(x)).alias("n"), F.coalesce(x["i"].cast(_WIDE), x["u"].cast(_WIDE)).alias("w"), x["s"].alias("s"), x["h"].alias("h"))


def strictly_equal(x: Column, y: Column) -> Column:
    """Boolean column: same class and same value; numbers compare by value, a boolean never equals a number."""
    return F.when(is_number(x) & is_number(y), _same_number(x, y)).otherwise(_same_rest(x, y))


def _same_number(x: Column, y: Column) -> Column:
    exact = _whole(x) == _whole(y)
    d = as_double(x)
    return F.when(is_integer(x) & is_integer(y), exact).otherwise((d == as_double(y)) & ~F.isnan(d))


def _same_rest(x: Column, y: Column) -> Column:
    k = x["kind"]
    return F.when(k != y["kind"], False).when(k == EMPTY, True).when(k == BOOL, x["b"] == y["b"]).when(k == STRING, x["s"] == y["s"]).when(k == HISTOGRAM, x["h"] == y["h"]).otherwise(False)


# --- operators ---


def _whole(x: Column) -> Column:
    """Integer of a number or boolean as a wide decimal."""
    return F.when(x["kind"] == BOOL, x["b"].cast("int").cast(_WIDE)).otherwise(F.coalesce(x["i"].cast(_WIDE), x["u"].cast(_WIDE)))


def _long(x: Column) -> Column:
    """Integer of a number or boolean if it fits a bigint."""
    return F.when(x["kind"] == BOOL, x["b"].cast("bigint")).otherwise(x["i"])


def _whole_kind(x: Column) -> Column:
    return x["kind"].isin(BOOL, NEGATIVE, UNSIGNED)


def _numeric(x: Column) -> Column:
    return x["kind"].isin(BOOL, NEGATIVE, UNSIGNED, DOUBLE)


def _fit(w: Column, wide: Column) -> Column:
    """Value of a wide integer: exact within 64 bits, signed or unsigned, else the double."""
    small = w.between(F.lit(str(-(1 << 63))).cast(_WIDE), F.lit(str((1 << 63) - 1)).cast(_WIDE))
    big = w.between(F.lit("0").cast(_WIDE), F.lit(str(_U64)).cast(_WIDE))
    return F.when(small, integer(w.cast("bigint"))).when(big, _make(UNSIGNED, u=w)).otherwise(double(wide))


def _present(x: Column, y: Column, result: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), absent()).otherwise(result)


def _arith(x: Column, y: Column, small: Column, wide: Column, real: Column, rest: Column) -> Column:
    """small: bigint result, null on overflow; wide: decimal result; real: double result."""
    ints = F.when(small.isNotNull(), integer(small)).otherwise(_fit(wide, real))
    return _present(x, y, F.when(_whole_kind(x) & _whole_kind(y), ints).when(_numeric(x) & _numeric(y), double(real)).otherwise(rest))


def _both_histograms(x: Column, y: Column) -> Column:
    return (x["kind"] == HISTOGRAM) & (y["kind"] == HISTOGRAM)


def add(x: Column, y: Column) -> Column:
    """Integers that overflow become doubles; histograms are summed; a histogram and a number give empty."""
    rest = F.when(_both_histograms(x, y), histogram(hg.add(x["h"], y["h"]))).otherwise(empty())
    return _arith(x, y, F.try_add(_long(x), _long(y)), F.try_add(_whole(x), _whole(y)), as_double(x) + as_double(y), rest)


def subtract(x: Column, y: Column) -> Column:
    rest = F.when(_both_histograms(x, y), histogram(hg.subtract(x["h"], y["h"]))).otherwise(empty())
    return _arith(x, y, F.try_subtract(_long(x), _long(y)), F.try_subtract(_whole(x), _whole(y)), as_double(x) - as_double(y), rest)


def multiply(x: Column, y: Column) -> Column:
    """A histogram times a number, either way round, scales its counts; two histograms give empty."""
    hx, hy = x["kind"] == HISTOGRAM, y["kind"] == HISTOGRAM
    rest = F.when(hx & _numeric(y), histogram(hg.scale(x["h"], as_double(y)))).when(hy & _numeric(x), histogram(hg.scale(y["h"], as_double(x)))).otherwise(empty())
    return _arith(x, y, F.try_multiply(_long(x), _long(y)), F.try_multiply(_whole(x), _whole(y)), as_double(x) * as_double(y), rest)


def divide(x: Column, y: Column) -> Column:
    """By zero empty; integers that divide exactly give an integer, others a double; a histogram divides by a number."""
    a, b = as_double(x), as_double(y)
    exact = F.when(F.try_mod(_whole(x), _whole(y)) == 0, F.try_divide(_whole(x), _whole(y)).cast(_WIDE))
    ints = F.when(exact.isNotNull(), _fit(exact, F.try_divide(a, b))).otherwise(double(F.try_divide(a, b)))
    numbers = F.when(b == 0, empty()).when(_whole_kind(x) & _whole_kind(y), ints).otherwise(double(F.try_divide(a, b)))
    scaled = F.when(b == 0, empty()).otherwise(histogram(hg.scale_down(x["h"], b)))
    return _present(x, y, F.when(_numeric(x) & _numeric(y), numbers).when((x["kind"] == HISTOGRAM) & _numeric(y), scaled).otherwise(empty()))


def modulo(x: Column, y: Column) -> Column:
    """By zero empty; of integers the truncated remainder, of doubles the IEEE remainder (to the nearest multiple, ties to even)."""
    a, b = as_double(x), as_double(y)
    real = F.when(F.abs(b) == float("inf"), F.when(F.abs(a) < float("inf"), a).otherwise(F.lit(float("nan")))).otherwise(a - b * F.rint(F.try_divide(a, b)))
    ints = _fit(F.try_mod(_whole(x), _whole(y)), real)
    return _present(x, y, F.when(~(_numeric(x) & _numeric(y)), empty()).when(b == 0, empty()).when(_whole_kind(x) & _whole_kind(y), ints).otherwise(double(real)))


def _shift(x: Column, y: Column, sign: int) -> Column:
    """x * 2**(sign*y). Integers shifted down drop bits towards minus infinity; shifted up beyond 64 bits they become doubles."""
    a, b = as_double(x), as_double(y)
    # pow in two halves: the power alone may overflow where the product doesn't
    half = F.floor(b * sign / 2)
    real = F.when(a == 0, a).otherwise(a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), b * sign - half))
    n = _whole(y) * sign
    near = n.between(-62, 62)
    p = F.lit(1).cast("bigint")
    up = F.call_function("shiftleft", p, F.when(near & (n > 0), n).otherwise(0).cast("int"))
    down = F.when(near & (n < 0), -n).otherwise(0).cast("int")
    wide_up = F.try_multiply(_whole(x), up.cast(_WIDE))
    big = _whole(x) > F.lit(str((1 << 63) - 1)).cast(_WIDE)
    floor_wide = F.floor(F.try_divide(_whole(x), F.call_function("shiftleft", p, down).cast(_WIDE))).cast(_WIDE)
    lower = F.when(~near, F.when(x["kind"] == NEGATIVE, integer(F.lit(-1).cast("bigint"))).when((n == -63) & big, integer(F.lit(1).cast("bigint"))).otherwise(integer(F.lit(0).cast("bigint")))).when(big, _fit(floor_wide, real)).otherwise(integer(F.call_function("shiftright", _long(x), down)))
    upper = F.when(_whole(x) == 0, integer(F.lit(0).cast("bigint"))).when(near, _fit(F.coalesce(wide_up, F.lit("9" * 38).cast(_WIDE)), real)).otherwise(F.when((n == 63) & (_whole(x) == 1), _make(UNSIGNED, u=F.lit(str(1 << 63)))).when((n == 63) & (_whole(x) == -1), integer(F.lit(-(1 << 63)))).otherwise(double(real)))
    ints = F.when(n >= 0, upper).otherwise(lower)
    return _present(x, y, F.when(~(_numeric(x) & _numeric(y)), empty()).when(_whole_kind(x) & _whole_kind(y), ints).otherwise(double(real)))


def shift_left(x: Column, y: Column) -> Column:
    return _shift(x, y, 1)


def shift_right(x: Column, y: Column) -> Column:
    return _shift(x, y, -1)


def negate(x: Column) -> Column:
    """Minus x, of numbers and histograms; an integer whose negative doesn't fit becomes a double."""
    return F.when(x.isNull(), absent()).when(_whole_kind(x), _fit(-_whole(x), -as_double(x))).when(x["kind"] == DOUBLE, double(-x["d"])).when(x["kind"] == HISTOGRAM, histogram(hg.negate(x["h"]))).otherwise(empty())


def logical_not(x: Column) -> Column:
    return F.when(x.isNull(), absent()).otherwise(boolean(~as_bool(x)))


def logical_and(x: Column, y: Column) -> Column:
    """Both as booleans; empty unless both have one."""
    a, b = as_bool(x), as_bool(y)
    return _present(x, y, boolean(F.when(a.isNotNull() & b.isNotNull(), a & b)))


def logical_or(x: Column, y: Column) -> Column:
    a, b = as_bool(x), as_bool(y)
    return _present(x, y, boolean(F.when(a.isNotNull() & b.isNotNull(), a | b)))


def _equal(x: Column, y: Column) -> Column:
    a, b = as_double(x), as_double(y)
    numbers = F.when(_whole_kind(x) & _whole_kind(y), _whole(x) == _whole(y)).otherwise((a == b) & ~F.isnan(a) & ~F.isnan(b))
    same = lambda k: (x["kind"] == k) & (y["kind"] == k)
    return F.when(_numeric(x) & _numeric(y), numbers).when(same(STRING), x["s"] == y["s"]).when(same(HISTOGRAM), x["h"] == y["h"])


def equal(x: Column, y: Column) -> Column:
    """Numbers and booleans compare by value, texts with texts, histograms with histograms; other pairs give empty."""
    return _present(x, y, boolean(_equal(x, y)))


def not_equal(x: Column, y: Column) -> Column:
    return _present(x, y, boolean(~_equal(x, y)))


def _less(x: Column, y: Column) -> Column:
    a, b = as_double(x), as_double(y)
    nan = F.isnan(a) | F.isnan(b)
    exact = _whole(x) < _whole(y)
    return F.when(_numeric(x) & _numeric(y), F.when(_whole_kind(x) & _whole_kind(y), exact).otherwise(~nan & (a < b)))


def less(x: Column, y: Column) -> Column:
    """Of numbers and booleans; texts and histograms aren't ordered and give empty. NaN is less than nothing."""
    return _present(x, y, boolean(_less(x, y)))


def greater(x: Column, y: Column) -> Column:
    return less(y, x)


def less_equal(x: Column, y: Column) -> Column:
    return _present(x, y, boolean(~_less(y, x)))


def greater_equal(x: Column, y: Column) -> Column:
    return _present(x, y, boolean(~_less(x, y)))


BINARY = {
    "||": logical_or, "&&": logical_and, "=": equal, "!=": not_equal, "<": less, ">": greater, "<=": less_equal, ">=": greater_equal,
    "<<": shift_left, ">>": shift_right, "+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo,
}
UNARY = {"!": logical_not, "-": negate}


#: Of those operators that give a double for any two doubles, what they do with them.
DOUBLES = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b}


def _weights(at: Column, t0: Column, t1: Column) -> tuple[Column, Column]:
    span = (t1 - t0).cast("double")
    return F.try_divide((t1 - at).cast("double"), span), F.try_divide((at - t0).cast("double"), span)


def weighted(at: Column, t0: Column, d0: Column, t1: Column, d1: Column) -> Column:
    """The double at a time strictly between t0 and t1, by linear weights."""
    w0, w1 = _weights(at, t0, t1)
    return d0 * w0 + d1 * w1


def interpolate(at: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Value at a time strictly between t0 and t1, by linear weights: numbers give a double, equal booleans and equal texts themselves, histograms the weighted sum.

    An empty value on either side gives empty, other mixes absent.
    """
    w0, w1 = _weights(at, t0, t1)
    both = lambda k: (v0["kind"] == k) & (v1["kind"] == k)
    return (
        F.when(v0.isNull() | v1.isNull(), absent())
        .when((v0["kind"] == EMPTY) | (v1["kind"] == EMPTY), empty())
        .when(is_number(v0) & is_number(v1), double(weighted(at, t0, as_double(v0), t1, as_double(v1))))
        .when(both(BOOL) & (v0["b"] == v1["b"]), v0)
        .when(both(STRING) & (v0["s"] == v1["s"]), v0)
        .when(both(HISTOGRAM), histogram(hg.add(hg.scale(v0["h"], w0), hg.scale(v1["h"], w1))))
        .otherwise(absent())
    )
