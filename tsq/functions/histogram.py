"""Histograms: arrays of (lo, hi, cnt), as built-in higher-order functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.schema import HISTOGRAM_DDL


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def literal(ranges) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"), F.lit(float(n)).alias("cnt")) for a, b, n in ranges]).cast(HISTOGRAM_DDL)


def low(h: Column) -> Column:
    """Low end of the first range; null if empty."""
    return F.array_min(F.transform(h, lambda r: r.lo))


def high(h: Column) -> Column:
    return F.array_max(F.transform(h, lambda r: r.hi))


def total(h: Column) -> Column:
    """Sum of midpoint times count."""
    return F.aggregate(h, F.lit(0.0), lambda a, r: a + (r.lo / 2 + r.hi / 2) * r.cnt)


def count(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, r: a + r.cnt)


def mean(h: Column) -> Column:
    """total / count; null if empty or without a count."""
    return F.try_divide(total(h), count(h))


def is_empty(h: Column) -> Column:
    return F.size(h) == 0


def running(h: Column) -> Column:
    """The histogram's elements with their running counts: (lo, hi, cnt, upto)."""
    sums = F.transform(h, lambda r, i: F.struct(r.lo.alias("lo"), r.hi.alias("hi"), r.cnt.alias("cnt"), count(F.slice(h, 1, i + 1)).alias("upto")))
    return sums


def normalise(h: Column) -> Column:
    """Non-overlapping ranges in order: intersecting ranges are split in proportion to their widths, equal ones summed, those without width or count dropped."""
    return F.when(h.isNotNull(), _let(F.filter(h, lambda r: r.hi > r.lo), _split)).cast(HISTOGRAM_DDL)


def _split(wide: Column) -> Column:
    def share(r: Column, p: Column) -> Column:
        return F.when((r.lo == p.lo) & (r.hi == p.hi), r.cnt).otherwise(r.cnt * (p.hi - p.lo) / (r.hi - r.lo))

    def within(p: Column) -> Column:
        return F.aggregate(wide, F.lit(0.0), lambda a, r: a + F.when((r.lo <= p.lo) & (r.hi >= p.hi), share(r, p)).otherwise(0.0))

    def filled(cuts: Column) -> Column:
        pieces = F.transform(F.slice(cuts, 2, F.greatest(F.size(cuts), F.lit(1))), lambda c, i: F.struct(F.get(cuts, i).alias("lo"), c.alias("hi")))
        return F.transform(pieces, lambda p: F.struct(p.lo.alias("lo"), p.hi.alias("hi"), within(p).alias("cnt")))

    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform(wide, lambda r: F.array(r.lo, r.hi)))))
    return F.filter(_let(cuts, filled), lambda r: r.cnt != 0)


def insert(h: Column, lo: Column, hi: Column, cnt: Column) -> Column:
    """h with a range added."""
    return normalise(F.concat(h, F.array(F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), cnt.cast("double").alias("cnt")))))


def scale(h: Column, by: Column) -> Column:
    return F.transform(h, lambda r: F.struct(r.lo.alias("lo"), r.hi.alias("hi"), (r.cnt * by).alias("cnt")))


def scale_down(h: Column, by: Column) -> Column:
    """Counts divided by a number; by zero null."""
    return F.when(by != 0, F.transform(h, lambda r: F.struct(r.lo.alias("lo"), r.hi.alias("hi"), F.try_divide(r.cnt, by).alias("cnt"))))


def negate(h: Column) -> Column:
    return F.transform(h, lambda r: F.struct(r.lo.alias("lo"), r.hi.alias("hi"), (-r.cnt).alias("cnt")))


def add(x: Column, y: Column) -> Column:
    return normalise(F.concat(x, y))


def subtract(x: Column, y: Column) -> Column:
    return normalise(F.concat(x, negate(y)))


def number_text(d: Column) -> Column:
    """A double as text: whole numbers without decimals."""
    return F.when((d == F.rint(d)) & (F.abs(d) < 1e15), F.format_string("%.0f", d)).otherwise(d.cast("string"))


def text(h: Column) -> Column:
    """[ lo..hi=cnt, ... ], [] if empty."""
    parts = F.transform(h, lambda r: F.concat(number_text(r.lo), F.lit(".."), number_text(r.hi), F.lit("="), number_text(r.cnt)))
    return F.when(F.size(h) == 0, "[]").otherwise(F.concat(F.lit("[ "), F.array_join(parts, ", "), F.lit(" ]")))
