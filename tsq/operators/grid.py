"""Irregular readings onto a regular grid."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A time shard of a series is this many times the longest gap, so the halo adds an eighth of the rows at most.
SHARD_GAPS = 8


def _floor(x: Column, step: Column) -> Column:
    return x - F.pmod(x, step)


def regular_grid(readings: DataFrame, keys: list[str], *, time: str = "tp_ms", value: str = "v", tie: str = "element_id", interval: str = "interval_ms", max_gap_ms: int = 21_600_000, carry_slots: int = 10) -> DataFrame:
    """Each series (keys) on the grid of its interval, every slot of a run observed, filled or missing.

    Method: readings are aggregated into buckets of a slot [n*interval, (n+1)*interval); the time sequence of each run is generated; it is
    left joined with the buckets; the last observation is carried forward within a maximum gap, carry_slots intervals of the series, and the
    slots beyond it are marked as missing. A silence of more than max_gap_ms between two readings ends the run.

    One shuffle, by (keys, time shard), which both sides of the join read. A series, however hot, is cut into shards of bounded length, and a halo
    of max_gap_ms tells a shard what comes after its end. Sequence, join and carrying stay within a shard, so nothing moves again.

    Columns: keys, slot_ms, status ('observed' | 'filled' | 'missing'), value (last in the slot or carried, null if missing),
    age_ms (from the carried reading's time to the slot's start, 0 if observed).
    Repeated rows change nothing. Of several readings in one slot the latest counts; of equal times the greatest tie.
    Readings of one key with different intervals are series of their own. Rows with a null key, time, value or interval, or an interval below 1, are left out. Other columns are ignored. An empty table gives an empty result.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    step = F.col("step")
    shard_ms = SHARD_GAPS * max_gap_ms
    r = readings.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(time).alias("t"), F.col(value).alias("x"), F.col(tie).alias("tie"), F.col(interval).cast("bigint").alias("step"))
    r = r.where(" and ".join(f"{c} is not null" for c in [*ks, "t", "x"]) + " and step >= 1").withColumn("slot", _floor(F.col("t"), step))
    home = F.floor(F.col("slot") / F.lit(shard_ms)).cast("bigint")
    near = F.col("slot") - home * shard_ms < F.lit(max_gap_ms) + step
    own = F.struct(home.alias("shard"), F.lit(True).alias("own"))
    before = F.struct((home - 1).alias("shard"), F.lit(False).alias("own"))
    r = r.withColumn("at", F.explode(F.when(near, F.array(own, before)).otherwise(F.array(own))))
    # no key of the join can be null: said so, the sides put no filters of their own below the shuffle
    sure = [F.coalesce(F.col(c), F.lit(0)).alias(c.rpartition(".")[2]) for c in ("step", "slot", "at.shard")]
    r = r.select(*ks, *sure, "t", "x", "tie", "at.own").repartition(*ks, "shard")
    buckets = r.groupBy(*ks, "shard", "step", "slot", "own").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("x", F.struct("t", "tie", "x")).alias("x"))
    one = [*ks, "shard", "step"]
    w = Window.partitionBy(*one).orderBy("slot")
    # x is never null: asking for it keeps the same columns below the shuffle as on the other side of the join
    runs = buckets.where("x is not null").withColumn("next", F.lead(F.struct("slot", "first")).over(w))
    goes_on = F.coalesce(F.col("next.first") - F.col("last") <= max_gap_ms, F.lit(False))
    runs = runs.withColumn("goes_on", goes_on).withColumn("run", F.sum(F.when(F.lag("goes_on").over(w), 0).otherwise(1)).over(w)).where("own")
    until = F.when(F.col("goes_on"), F.greatest(F.col("next.slot") - F.col("step"), "slot")).otherwise(F.col("slot"))
    spans = runs.groupBy(*one, "run").agg(F.min("slot").alias("a"), F.max(until).alias("z"))
    sequence = spans.select(*one, F.explode(F.sequence("a", "z", "step")).alias("slot"))
    # the left join, said by grouping: both sides lie by (keys, shard) already, which is enough for a group by all keys but not for a join by them, that would move both again
    seen = F.struct("slot", "last", "x")
    sides = sequence.select(*one, "slot", F.lit(True).alias("asked"), F.lit(None).cast(buckets.select(seen.alias("s")).schema["s"].dataType).alias("seen")).unionByName(buckets.select(*one, "slot", F.lit(False).alias("asked"), seen.alias("seen")))
    slots = sides.groupBy(*one, "slot").agg(F.bool_or("asked").alias("asked"), F.max("seen").alias("seen")).where("asked")
    # a run begins with an observed slot, so nothing is carried from one run into the next
    slots = slots.withColumn("seen", F.last("seen", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    age = F.col("slot") - F.col("seen.last")
    observed = F.col("slot") == F.col("seen.slot")
    filled = F.col("slot") - F.col("seen.slot") <= F.col("step") * carry_slots
    return slots.select(
        *[F.col(a).alias(k) for k, a in zip(keys, ks)],
        F.col("slot").alias("slot_ms"),
        F.when(observed, "observed").when(filled, "filled").otherwise("missing").alias("status"),
        F.when(observed | filled, F.col("seen.x")).alias("value"),
        F.when(observed, F.lit(0).cast("bigint")).otherwise(age).alias("age_ms"),
    )
