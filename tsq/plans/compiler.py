"""Compiles expressions to DataFrame plans over a table of samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.functions import values as va
from tsq.plans import folding, match
from tsq.plans import parser as ps
from tsq.plans.timedomain import TimeRange, align, meet
from tsq.sources import samples as sm

#: Slack of an evaluation that names none: five minutes.
SLACK_MS = 300_000


@dataclass(frozen=True)
class _Constant:
    value: Column


@dataclass(frozen=True)
class _Scalar:
    df: DataFrame  # tp_ms, value


@dataclass(frozen=True)
class _Vector:
    df: DataFrame  # tp_ms, tags, value; one row per time and key of clause
    clause: ps.Clause


class Compiler:
    """One evaluation: the samples in reach, the time range and the slack. Plans that several operators need are built once."""

    def __init__(self, samples, time: TimeRange, slack: int):
        if slack < 0:
            raise ValueError("the slack may not be negative")
        self.time, self.slack = time, slack
        self.source = sm.source(samples)
        self._times: DataFrame | None = None
        self._selected: dict = {}

    def times(self) -> DataFrame:
        """Every scrape time: the times of constants, and of a grid its points."""
        if self._times is None:
            self._times = sm.emit_time(self.source, self.time, self.slack)
        return self._times

    def select(self, e: ps.Selector, c: ps.Clause) -> DataFrame:
        if (e, c) not in self._selected:
            s = self.source.scan(self.time, self.slack, e.group, e.tags, e.metric)
            if self.time.interval:
                s = align(s, ["grp", "tags", "metric"], self.times(), self.slack)
            if c.kind == "default" and e.group.literal() is not None and e.metric.literal() is not None:
                # one group and one metric: no two series fall on one key, the tags
                self._selected[e, c] = s.select("tp_ms", "tags", "value")
            else:
                self._selected[e, c] = match.first_by_key(s, c, ["grp", "metric", "tags"]).select("tp_ms", "tags", "value")
        return self._selected[e, c]

    def run(self, e, c: ps.Clause = ps.DEFAULT):
        if isinstance(e, ps.Constant):
            return _Constant(va.literal(list(e.value) if isinstance(e.value, tuple) else e.value))
        if isinstance(e, ps.Selector):
            return _Vector(self.select(e, c), c)
        if isinstance(e, ps.Unary):
            return self.map(self.run(e.x, c), va.UNARY[e.op])
        f = va.BINARY[e.op]
        x, y = self.run(e.x, e.clause), self.run(e.y, e.clause)
        if isinstance(x, _Constant) and isinstance(y, _Constant):
            return _Constant(f(x.value, y.value))
        if isinstance(x, _Constant):
            return self.with_constant(y, lambda v: f(x.value, v), c)
        if isinstance(y, _Constant):
            return self.with_constant(x, lambda v: f(v, y.value), c)
        return self.join(x, y, f, e.clause, c, va.DOUBLES.get(e.op))

    @staticmethod
    def map(x, f: Callable[[Column], Column]):
        if isinstance(x, _Constant):
            return _Constant(f(x.value))
        df = x.df.withColumn("value", va.bound(f)(F.col("value")))
        return _Scalar(df) if isinstance(x, _Scalar) else _Vector(df, x.clause)

    def with_constant(self, x, f, c: ps.Clause):
        """A constant is defined at every scrape time: the other side is interpolated at those, no join is needed."""
        keys = [] if isinstance(x, _Scalar) else ["tags"]
        df = x.df if self.time.interval else align(x.df, keys, self.times(), self.slack, all_times=True)
        df = df.withColumn("value", va.bound(f)(F.col("value"))).where("value is not null")
        return _Scalar(df) if isinstance(x, _Scalar) else _Vector(self.wanted(df, x.clause, c), c)

    @staticmethod
    def wanted(df: DataFrame, has: ps.Clause, want: ps.Clause) -> DataFrame:
        # one row per key of the same clause, or of a finer one, can't collide
        return df if has == want or want.kind == "default" else match.collide(df, want)

    def join(self, x, y, f, by: ps.Clause, c: ps.Clause, doubles=None):
        """Output times are the union of both sides' times; a row needs both sides present. doubles: what f does with two doubles."""
        xs, ys = isinstance(x, _Scalar), isinstance(y, _Scalar)
        if self.slack > 0 and not self.time.interval and not xs and not ys:
            a, b = (d.df.withColumn("mkey", match.key(by, F.col("tags"))) for d in (x, y))
            union = x.df.select("tp_ms").unionByName(y.df.select("tp_ms")).distinct()
            out = meet(a, b, union, self.slack, f, doubles, lambda x, y: match.result_tags(by, x, y))
            return self.joined(out, by, c)
        if self.slack > 0 and not self.time.interval:
            union = x.df.select("tp_ms").unionByName(y.df.select("tp_ms")).distinct()
            xd = align(x.df, [] if xs else ["tags"], union, self.slack, all_times=True)
            yd = align(y.df, [] if ys else ["tags"], union, self.slack, all_times=True)
        else:
            xd, yd = x.df, y.df
        value = va.bound(f)(F.col("x.value"), F.col("y.value"))
        a, b = xd.alias("x"), yd.alias("y")
        if xs and ys:
            return _Scalar(a.join(b, F.col("x.tp_ms") == F.col("y.tp_ms")).select("x.tp_ms", value.alias("value")))
        if xs or ys:
            tags = F.col("y.tags") if xs else F.col("x.tags")
            out = a.join(b, F.col("x.tp_ms") == F.col("y.tp_ms")).select("x.tp_ms", tags.alias("tags"), value.alias("value"))
            return _Vector(self.wanted(out, by, c), c)
        a, b = (d.withColumn("mkey", match.key(by, F.col("tags"))).alias(n) for d, n in ((xd, "x"), (yd, "y")))
        tags = match.result_tags(by, F.col("x.tags"), F.col("y.tags"))
        out = a.join(b, (F.col("x.tp_ms") == F.col("y.tp_ms")) & match.same("x.mkey", "y.mkey")).select("x.tp_ms", tags.alias("tags"), value.alias("value"))
        return self.joined(out, by, c)

    def joined(self, out: DataFrame, by: ps.Clause, c: ps.Clause) -> _Vector:
        # under the default clause results have the tags of both sides; else they may fall together
        return _Vector(self.wanted(out, by, c) if by.kind != "by" or by.keep in ("selected", "common") else match.collide(out, c), c)


def evaluate(samples, expression, time: TimeRange = TimeRange(), slack: int = SLACK_MS) -> DataFrame:
    """The facts of an expression (text or tree): tp_ms, tags, value of a vector, tp_ms, value of a scalar one. Unordered; sort at the edge if order is wanted.

    samples: a table of samples, or a source (samples.History, samples.Wide) whose scans take the selectors' predicates.

    Samples from slack before the range to slack after it are read; results lie within the range, or on its grid. Several samples of one series at one
    time must have been merged before (samples.merge_combine). No samples, no rows.
    """
    e = ps.parse(expression) if isinstance(expression, str) else expression
    k = Compiler(samples, time, slack)
    r = k.run(folding.fold(e))
    if isinstance(r, _Constant):
        df = k.times().select("tp_ms", r.value.alias("value"))
    else:
        df = r.df
    return df.where(time.within(F.col("tp_ms")))


def is_scalar(expression) -> bool:
    """Whether an expression has no selector and so no tags."""
    e = ps.parse(expression) if isinstance(expression, str) else expression
    if isinstance(e, ps.Binary):
        return is_scalar(e.x) and is_scalar(e.y)
    return is_scalar(e.x) if isinstance(e, ps.Unary) else isinstance(e, ps.Constant)


def merge_scalars(f: Callable[[list[Column]], Column], inputs: list[DataFrame], slack: int) -> DataFrame:
    """The n-ary merger of scalars (tp_ms, value): f over all inputs' values at every time where all are present."""
    union = inputs[0].select("tp_ms")
    for d in inputs[1:]:
        union = union.unionByName(d.select("tp_ms"))
    union = union.distinct()
    out = None
    for i, d in enumerate(inputs):
        a = align(d, [], union, slack, all_times=True).select("tp_ms", F.col("value").alias(f"v{i}"))
        out = a if out is None else out.join(a, "tp_ms")
    return out.select("tp_ms", va.bound(lambda *v: f(list(v)))(*[F.col(f"v{i}") for i in range(len(inputs))]).alias("value"))


def merge_vectors(f: Callable[[list[Column]], Column], inputs: list[DataFrame], slack: int, clause: ps.Clause = ps.DEFAULT) -> DataFrame:
    """The n-ary merger of vectors (tp_ms, tags, value) and scalars (tp_ms, value); at least one vector. Tags of the result are the first vector's under the clause."""
    union = inputs[0].select("tp_ms")
    for d in inputs[1:]:
        union = union.unionByName(d.select("tp_ms"))
    union = union.distinct()
    out = None
    ordered = sorted(range(len(inputs)), key=lambda i: "tags" not in inputs[i].columns)
    for i in ordered:
        d = inputs[i]
        if "tags" in d.columns:
            d = match.first_by_key(d, clause, ["tags"])
            a = align(d.drop("tags").withColumnRenamed("mkey", "tags"), ["tags"], union, slack, all_times=True).select("tp_ms", "tags", F.col("value").alias(f"v{i}"))
            out = a if out is None else out.join(a, ["tp_ms", "tags"])
        else:
            a = align(d, [], union, slack, all_times=True).select("tp_ms", F.col("value").alias(f"v{i}"))
            out = out.join(a, "tp_ms")
    return out.select("tp_ms", "tags", va.bound(lambda *v: f(list(v)))(*[F.col(f"v{i}") for i in range(len(inputs))]).alias("value"))
