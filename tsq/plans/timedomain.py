"""The time domain: ranges, grids, and the value of a series at times between its samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.functions import values as va
from tsq.plans import match
from tsq.schema import DOUBLE

#: A time shard of a series is this many slacks long.
SHARD_SLACKS = 32
#: Spans in which two series meet get their times by buckets of a slack divided by this.
TIME_BUCKETS = 64


@dataclass(frozen=True)
class TimeRange:
    """begin and end in ms, both inclusive, each optional; interval in ms asks for a regular grid from begin, end included."""

    begin: int | None = None
    end: int | None = None
    interval: int | None = None

    def __post_init__(self):
        if self.begin is not None and self.end is not None and self.begin > self.end:
            raise ValueError("the range begins after its end")
        if self.interval is not None and (self.interval <= 0 or self.begin is None or self.end is None):
            raise ValueError("an interval must be positive and needs both ends")

    def within(self, time: Column, slack: int = 0) -> Column:
        tests = []
        if self.begin is not None:
            tests.append(time >= self.begin - slack)
        if self.end is not None:
            tests.append(time <= self.end + slack)
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def grid(self, spark) -> DataFrame:
        """tp_ms of begin + n * interval up to the end, and the end itself. Made by the executors, however long."""
        steps = spark.range(self.begin, self.end + 1, self.interval).select(F.col("id").alias("tp_ms"))
        end = spark.range(1).select(F.lit(self.end).cast("bigint").alias("tp_ms"))
        return steps.unionByName(end).distinct() if (self.end - self.begin) % self.interval else steps


def _bucket(width: int):
    return lambda t: F.floor(t / F.lit(width)).cast("bigint")


def _paired(series: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """Each sample (keys, tp_ms, value) once, with its series' next one as n (t, v), and lo..hi, the times at which the two are interpolated; null or lo > hi where there are none.

    Series are cut into time shards with a halo of two slacks, so that no series has to lie in one task.
    """
    length = slack * SHARD_SLACKS
    home = F.floor(F.col("tp_ms") / F.lit(length)).cast("bigint")
    own, before = F.struct(home.alias("shard"), F.lit(True).alias("own")), F.struct((home - 1).alias("shard"), F.lit(False).alias("own"))
    s = series.select(*keys, "tp_ms", "value", F.explode(F.when(F.pmod(F.col("tp_ms"), F.lit(length)) <= 2 * slack, F.array(own, before)).otherwise(F.array(own))).alias("at"))
    w = Window.partitionBy(*keys, "at.shard").orderBy("tp_ms")
    s = s.withColumn("n", F.lead(F.struct(F.col("tp_ms").alias("t"), F.col("value").alias("v"))).over(w)).where("at.own")
    # of no next sample no time: greatest and least pass nulls over
    there = lambda c: F.when(F.col("n").isNotNull(), c)
    lo, hi = F.greatest(F.col("tp_ms") + 1, F.col("n.t") - slack), F.least(F.col("n.t") - 1, F.col("tp_ms") + slack)
    return s.select(*keys, "tp_ms", "value", "n", there(lo).alias("lo"), there(hi).alias("hi"))


def between(series: DataFrame, keys: list[str], times: DataFrame, slack: int) -> DataFrame:
    """keys, tp_ms, value: the series' interpolated values at those times that lie strictly between two successive samples p < n, n at most slack after and p at most slack before.

    series: keys, tp_ms, value (one sample per key and time). A pair is usable on (p, n) and [n - slack, p + slack], which is at most slack long: so it falls into at most two
    buckets of that width, and times join by bucket, without a cross join.
    Pairs whose kinds can't be interpolated give no row.
    """
    if slack <= 0:
        return series.select(*keys, "tp_ms", "value").limit(0)
    bucket = _bucket(slack)
    pairs = _paired(series, keys, slack).where("lo <= hi").select(*keys, F.col("tp_ms").alias("p"), F.col("value").alias("v"), "n", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("bucket"))
    t = times.select("tp_ms", bucket(F.col("tp_ms")).alias("bucket"))
    hit = pairs.join(t, "bucket").where("tp_ms > p and tp_ms < n.t" + f" and tp_ms <= p + {slack} and tp_ms >= n.t - {slack}")
    return hit.select(*keys, "tp_ms", va.bound(va.interpolate)(F.col("tp_ms"), F.col("p"), F.col("v"), F.col("n.t"), F.col("n.v")).alias("value")).where("value is not null")


def align(series: DataFrame, keys: list[str], times: DataFrame, slack: int, all_times: bool = False) -> DataFrame:
    """keys, tp_ms, value at the given distinct times: exact samples, else interpolated ones. all_times: times are known to include the series' own, which saves a join."""
    exact = series.select(*keys, "tp_ms", "value")
    if not all_times:
        exact = exact.join(times.select("tp_ms"), "tp_ms", "left_semi").select(*keys, "tp_ms", "value")
    return exact if slack <= 0 else exact.unionByName(between(series, keys, times, slack))


def meet(x: DataFrame, y: DataFrame, times: DataFrame, slack: int, f: Callable[[Column, Column], Column], doubles: Callable[[Column, Column], Column] | None, tags: Callable[[Column, Column], Column]) -> DataFrame:
    """tp_ms, tags, value: f of two sets of series, both aligned at the given distinct times, which include their own, and joined on equal times and keys.

    x, y: tags (a series each), mkey (what they join by), tp_ms, value. doubles: f of two values that are doubles, as plain columns. tags: those of the result from both sides'.

    Rather than each side at all times, what meets is first the spans in which a side has a value, by key: a sample is one of a single time, a pair one between its samples. Only
    the common span of two that meet is filled with times, so the work grows with the result. Spans are at most a slack long and meet in buckets of that width, common ones get
    their times by buckets TIME_BUCKETS times finer.
    """
    bucket, fine = _bucket(slack), _bucket(max(1, slack // TIME_BUCKETS))

    def spans(d: DataFrame, n: str) -> DataFrame:
        one = lambda lo, hi, pair: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(pair).alias("pair"))
        t, lo, hi, v, w = F.col("tp_ms"), F.col("lo"), F.col("hi"), F.col("value"), F.col("n.v")
        s = _paired(d, ["tags", "mkey"], slack)
        s = s.select("tags", "mkey", t.alias("p"), "value", "n", F.explode(F.when(lo <= hi, F.array(one(t, t, False), one(lo, hi, True))).otherwise(F.array(one(t, t, False)))).alias("span"))
        pair = F.col("span.pair")
        # a value that is a double at every time of the span goes on as plain numbers, others as they are
        plain = F.when(pair, va.is_number(v) & va.is_number(w)).otherwise(v["kind"] == DOUBLE)
        s = s.select("span", "tags", "mkey", "p", F.when(pair, F.col("n.t")).alias("q"), F.coalesce(plain, F.lit(False)).alias("plain"), "value", F.when(pair, w).alias("next"))
        d0, d1 = (F.when(F.col("plain"), va.as_double(F.col(c))).alias(a) for c, a in (("value", "d0"), ("next", "d1")))
        v0, v1 = (F.when(~F.col("plain"), F.col(c)).alias(a) for c, a in (("value", "v0"), ("next", "v1")))
        s = s.select(F.xxhash64("mkey").alias("hash"), F.explode(F.sequence(bucket(F.col("span.lo")), bucket(F.col("span.hi")))).alias("bucket"), "span", "mkey", "tags", F.struct("p", "q", "plain", d0, d1, v0, v1).alias("s"))
        return s.alias(n)

    a, b = spans(x, "x"), spans(y, "y")
    lo, hi = F.greatest("x.span.lo", "y.span.lo"), F.least("x.span.hi", "y.span.hi")
    # two spans may share two buckets: they meet in that in which their common span begins
    common = a.join(b, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.bucket") == F.col("y.bucket")) & (lo <= hi) & (bucket(lo) == F.col("x.bucket")) & match.same_keys("x.mkey", "y.mkey"))
    common = common.select(F.col("x.s").alias("x"), F.col("y.s").alias("y"), tags(F.col("x.tags"), F.col("y.tags")).alias("tags"), lo.alias("lo"), hi.alias("hi")).withColumn("bucket", F.explode(F.sequence(fine(F.col("lo")), fine(F.col("hi")))))
    hit = common.join(times.select("tp_ms", fine(F.col("tp_ms")).alias("bucket")), "bucket").where("tp_ms between lo and hi")

    def real(s: str) -> Column:
        at, p, q, d0, d1 = F.col("tp_ms"), *(F.col(f"{s}.{c}") for c in ("p", "q", "d0", "d1"))
        return F.when(q.isNull(), d0).otherwise(va.weighted(at, p, d0, q, d1))

    def value(s: str) -> Column:
        p, q, v0, v1 = (F.col(f"{s}.{c}") for c in ("p", "q", "v0", "v1"))
        return F.when(F.col(f"{s}.plain"), va.double(real(s))).when(q.isNull(), v0).otherwise(va.bound(va.interpolate)(F.col("tp_ms"), p, v0, q, v1))

    both = F.col("x.plain") & F.col("y.plain") if doubles else F.lit(False)
    # of pairs of other values that can't be interpolated there is no value, and so no row; what f makes of samples may be absent
    absent = lambda s: F.col(f"{s}.q").isNotNull() & ~F.col(f"{s}.plain") & value(s).isNull()
    out = hit.where(both | ~(absent("x") | absent("y")))
    result = va.bound(f)(value("x"), value("y"))
    return out.select("tp_ms", "tags", (F.when(both, va.double(doubles(real("x"), real("y")))).otherwise(result) if doubles else result).alias("value"))
