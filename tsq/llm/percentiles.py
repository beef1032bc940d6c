"""Percentiles of very large numeric columns by exact bisection on counts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value's code settled by a pass: each pass counts below 2**DIGIT_BITS - 1 midpoints of every open interval at once.
DIGIT_BITS = 16
PASSES = 64 // DIGIT_BITS
#: Bits kept by mergeable summaries: sign, exponent and 8 bits of the fraction, so a percentile is known to 1 part in 256.
SUMMARY_BITS = 20
#: The intervals of a pass are broadcast if the groups' intervals are at most this many; beyond that they are joined by a shuffle.
BROADCAST_INTERVALS = 100_000

_BITS, _VALUE = ("java.lang.Double", "doubleToLongBits"), ("java.lang.Double", "longBitsToDouble")


def code(x: Column) -> Column:
    """Order-preserving bigint of a double: the bits of its magnitude, negated for negative numbers. a < b as doubles exactly if code(a) < code(b); -0.0 counts as 0.0.

    The bits come from the JVM's own conversion, called once per row. The code of null is null; NaN has none of its own.
    """
    bits = F.reflect(F.lit(_BITS[0]), F.lit(_BITS[1]), F.abs(F.coalesce(x, F.lit(0.0)))).cast("bigint")
    return F.when(x.isNotNull(), bits * F.when(x < 0, -1).otherwise(1))


def decode(c: Column) -> Column:
    """The double with the given code. Its shortest text, by which it passes, reads back as the same double."""
    return F.reflect(F.lit(_VALUE[0]), F.lit(_VALUE[1]), F.abs(c)).cast("double") * F.when(c < 0, -1.0).otherwise(1.0)


def _least(run: DataFrame, keys: list[str]) -> DataFrame:
    """Of each percentile's interval the first child whose running weight reaches the target, and the weight below it."""
    hit = run.where(F.col("below") + F.col("upto") >= F.col("target")).groupBy(*keys, "pct", "n", "target", "below").agg(F.min(F.struct("child", "upto", "w")).alias("m"))
    return hit.select(*keys, "pct", "n", "target", (F.col("below") + F.col("m.upto") - F.col("m.w")).alias("below"), F.col("m.child").alias("child"))


def bisect(items: DataFrame, keys: list[str], percentiles: list[float], groups: DataFrame | None = None, max_broadcast: int = BROADCAST_INTERVALS) -> DataFrame:
    """Exact percentiles per group: keys, pct, n (total weight), value.

    items: keys, code (see code()) and w, the weight. The percentile p is the least value with at least p of the weight at or below it.
    Method: an interval of codes is held per group and percentile. Each pass counts the weight below the midpoints of all open intervals
    (DIGIT_BITS halvings at once) and narrows each to the child where the target rank lies; after PASSES passes the intervals are single values.
    The items are first added up by group and code, over all cores and whatever the skew: that shuffle moves each distinct value of a group once, pre-aggregated
    where it is read. The passes all read it and move only counts, at most 2**DIGIT_BITS per interval, by partial aggregation; no hot group lands in one task.
    groups: rows that number at least the groups, if they cost less to count than those of the items.
    Rows with a null code or a null, zero or negative weight are left out; null keys form a group of their own. No rows, no groups.
    """
    n_k = [f"g{i}" for i in range(len(keys))]
    # structs around the keys: null keys then join with each other
    items = items.where("code is not null and w > 0").select(*[F.struct(F.col(k).alias("k")).alias(a) for k, a in zip(keys, n_k)], "code", F.col("w").cast("double").alias("w"))
    most = max_broadcast // max(1, len(percentiles))
    few = (items.select(*n_k).distinct() if groups is None else groups).limit(most + 1).count() <= most
    # the code can't be null here: said so, the passes put no filters of their own below the shuffle
    items = items.groupBy(*n_k, F.coalesce("code", F.lit(0)).alias("code")).agg(F.sum("w").alias("w")).withColumn("code", F.coalesce("code", F.lit(0)))
    small = F.broadcast if few else (lambda df: df)
    digit = lambda k: F.shiftright(F.col("code"), 64 - DIGIT_BITS * k)
    order = Window.partitionBy(*n_k).orderBy("child").rowsBetween(Window.unboundedPreceding, 0)
    run = items.groupBy(*n_k, digit(1).alias("child")).agg(F.sum("w").alias("w")).withColumn("upto", F.sum("w").over(order)).withColumn("n", F.sum("w").over(Window.partitionBy(*n_k)))
    run = run.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))).withColumn("below", F.lit(0.0))
    # a rank just above a whole number only by rounding counts as that number
    hit = _least(run.withColumn("target", F.greatest(F.col("pct") * F.col("n") - F.col("n") * 1e-12, F.col("n") * 1e-13)), n_k)
    order = Window.partitionBy(*n_k, "parent").orderBy("child").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(2, PASSES + 1):
        # the open intervals, each with the percentiles that lie in it
        open_ = hit.groupBy(*n_k, F.col("child").alias("parent")).agg(F.collect_list(F.struct("pct", "n", "target", "below")).alias("asked"))
        inside = items.withColumn("parent", digit(k - 1)).join(small(open_), [*n_k, "parent"])
        counts = inside.groupBy(*n_k, "parent", "asked", digit(k).alias("child")).agg(F.sum("w").alias("w"))
        run = counts.withColumn("upto", F.sum("w").over(order))
        hit = _least(run.select(*n_k, "parent", "child", "w", "upto", F.inline("asked")), [*n_k, "parent"])
    return hit.select(*[F.col(f"{a}.k").alias(k) for k, a in zip(keys, n_k)], "pct", "n", decode(F.col("child")).alias("value"))


def summarise(items: DataFrame, keys: list[str]) -> DataFrame:
    """A mergeable summary: keys, bucket, w. Summaries of days or files combine by adding the weights of equal buckets (see merged)."""
    items = items.where("code is not null and w > 0")
    return items.groupBy(*keys, F.shiftright("code", 64 - SUMMARY_BITS).alias("bucket")).agg(F.sum("w").alias("w"))


def merged(summaries: DataFrame, keys: list[str], percentiles: list[float]) -> DataFrame:
    """Percentiles of combined summaries: keys, pct, n, lower, upper. The exact percentile lies within lower..upper, which are 1 part in 256 apart (the least denormal apart at zero)."""
    total = summaries.groupBy(*keys, "bucket").agg(F.sum("w").alias("w"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    run = total.withColumn("upto", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("w").over(Window.partitionBy(*keys)))
    run = run.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    hit = run.where(F.col("upto") >= F.greatest(F.col("pct") * F.col("n") - F.col("n") * 1e-12, F.col("n") * 1e-13)).groupBy(*keys, "pct", "n").agg(F.min("bucket").alias("bucket"))
    first = F.shiftleft("bucket", 64 - SUMMARY_BITS)
    return hit.select(*keys, "pct", "n", decode(first).alias("lower"), decode(first + ((1 << (64 - SUMMARY_BITS)) - 1)).alias("upper"))


def reading_items(elements: DataFrame, by_day: bool = False) -> DataFrame:
    """Items of collection elements: grp, metric, kind ('value' | 'range_lo' | 'range_hi'), code, w, with by_day also day (of UTC since the epoch).

    Finite numbers count once each. A histogram's range counts cnt times, at its lower and at its upper end: the percentiles of the two
    enclose that of the values counted, whatever lies inside the ranges. Needs a host tag and a time, as a usable reading; ranges with a null, NaN or infinite end,
    or a count that isn't positive and finite, are left out. Redelivered rows, equal in all columns, count once.
    """
    from tsq.operators.readings import number, tag_text

    e = elements.select("element_id", tag_text("tags", "host").alias("host"), F.array_join("grp", ".").alias("grp"), F.array_join("metric", ".").alias("metric"), "tp_ms", number("value").alias("v"), F.when(F.col("value.kind") == 6, F.col("value.h")).alias("h"))
    finite = lambda c: F.abs(c) < float("inf")  # noqa: E731 (false for NaN, which Spark orders last)
    e = e.where(F.expr("element_id is not null and host is not null and tp_ms is not null") & (finite(F.col("v")) | F.col("h").isNotNull()))
    keys = ["grp", "metric", *["day"] * by_day]
    day = [F.floor(F.col("tp_ms") / F.lit(86_400_000)).cast("bigint").alias("day")] * by_day
    e = e.select("element_id", "grp", "metric", *day, code(F.col("v")).alias("code"), "h").distinct()
    values = e.where("h is null").select(*keys, F.lit("value").alias("kind"), "code", F.lit(1.0).alias("w"))
    # equal ranges are added up before their ends become items
    ranges = e.where("h is not null").select(*keys, F.inline("h")).where(finite(F.col("lo")) & finite(F.col("hi")) & finite(F.col("cnt")) & (F.col("cnt") > 0))
    ranges = ranges.groupBy(*keys, "lo", "hi").agg(F.sum("cnt").alias("w"))
    ends = F.array(*[F.struct(F.lit(f"range_{c}").alias("kind"), code(F.col(c)).alias("code")) for c in ("lo", "hi")])
    return values.unionByName(ranges.select(*keys, "w", F.inline(ends)))
