"""Rolling totals over trailing periods, from segment trees over the days of each entity."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of the trees: a time shard has 2**LEVELS days.
LEVELS = 5
DAY_MS = 86_400_000


def daily(readings: DataFrame, entity: str, time: str = "tp_ms", value: str = "v", ident: str = "element_id") -> DataFrame:
    """entity, day (number of the UTC day since the epoch), total, n: the leaves. Each ident counts once.

    Rows with a null entity, time, value or ident, or a value of NaN, are left out. The repeats go by a shuffle on ident, which no hot entity skews;
    the totals are pre-aggregated before their shuffle.
    """
    r = readings.select(F.col(entity).alias("entity"), F.floor(F.col(time) / F.lit(DAY_MS)).cast("bigint").alias("day"), F.col(value).cast("double").alias("x"), F.col(ident).alias("ident"))
    r = r.where("entity is not null and day is not null and x is not null and not isnan(x) and ident is not null")
    return r.groupBy("ident").agg(F.min(F.struct("entity", "day", "x")).alias("r")).groupBy("r.entity", "r.day").agg(F.sum("r.x").alias("total"), F.count("*").alias("n"))


def tree(days: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes (entity, level, node) with total and n: node covers the days [node << level, (node + 1) << level).

    The roots, at the highest level, are the time shards. Each leaf adds itself to its ancestors; sums are pre-aggregated.
    """
    up = days.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return up.groupBy("entity", "level", F.expr("shiftright(day, level)").alias("node")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def corrected(nodes: DataFrame, late: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes after late corrections: the days' totals and n to add, as daily() gives them. Sums and counts add up, so only the ancestors of the corrected days get an addition."""
    both = nodes.select("entity", "level", "node", "total", "n").unionByName(tree(late, levels))
    return both.groupBy("entity", "level", "node").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def store(nodes: DataFrame, directory: str, levels: int = LEVELS) -> None:
    """Writes trees to a directory, or adds to those there: Parquet by time shard. To correct stored trees, store tree(late): what is written are the ancestors of the
    corrected days and nothing else; reading adds them up."""
    shard = F.expr(f"shiftright(shiftleft(node, level), {levels})")
    nodes.select("entity", "level", "node", "total", "n", shard.alias("shard")).repartition("shard", "entity").sortWithinPartitions("shard", "entity", "level", "node").write.mode("append").partitionBy("shard").parquet(directory)


def stored(spark: SparkSession, directory: str, first: int | None = None, last: int | None = None, levels: int = LEVELS) -> DataFrame:
    """The nodes of stored trees with all additions, of the time shards that hold the days first..last; other shards aren't read."""
    n = spark.read.parquet(directory)
    if first is not None:
        n = n.where(F.col("shard") >= first >> levels)
    if last is not None:
        n = n.where(F.col("shard") <= last >> levels)
    return n.groupBy("entity", "level", "node").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _ends(first: Column, last: Column, level: int) -> tuple[Column, Column]:
    """The nodes of the level that lie wholly in the days first..last, from one up to before the other."""
    size = F.lit(1 << level)
    return F.floor((first + size - 1) / size).cast("bigint"), F.floor((last + 1) / size).cast("bigint")


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The nodes that make up the days first..last: at each level the odd left end and the even right end, up to the roots in between."""
    node = lambda k, n: F.struct(F.lit(k).alias("level"), n.alias("node"))
    parts = []
    for k in range(levels):
        lo, hi = _ends(first, last, k)
        parts.append(F.array(F.when((lo < hi) & (F.pmod(lo, F.lit(2)) == 1), node(k, lo)), F.when((lo < hi) & (F.pmod(hi, F.lit(2)) == 1), node(k, hi - 1))))
    lo, hi = _ends(first, last, levels)
    roots = F.transform(F.sequence(lo, F.greatest(hi - 1, lo)), lambda n: node(levels, n))
    parts.append(F.when(lo < hi, roots).otherwise(F.array().cast("array<struct<level:int,node:bigint>>")))
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def trailing(days: DataFrame, nodes: DataFrame, periods: tuple[int, ...] = (7, 30), levels: int = LEVELS) -> DataFrame:
    """For each entity and day between its first and last, the totals, counts and averages of the trailing periods, the day included.

    The sequence of days is generated per entity and time shard, over all tasks, so that neither many entities nor one with a long span (as by a wrong date) makes
    the days of all in one task; each period of a day becomes a range query, answered by joining its covering
    nodes with the trees (at most two a level). Columns: entity, day, n_day, and per period p total_p, n_p, avg_p (null without readings).
    Days without activity have n_day 0. No rows in, no rows out.
    """
    span = days.groupBy("entity").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    # a number of partitions that is named isn't merged for the few bytes that arrive
    parts = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = span.select("entity", "a", "b", F.explode(F.expr(f"sequence(shiftright(a, {levels}), shiftright(b, {levels}))")).alias("shard")).repartition(parts, "entity", "shard")
    begin = F.expr(f"shiftleft(shard, {levels})")
    grid = shards.select("entity", F.explode(F.sequence(F.greatest("a", begin), F.least("b", begin + ((1 << levels) - 1)))).alias("day"))
    asked = F.array(F.struct(F.lit(0).alias("period"), F.array(F.struct(F.lit(0).alias("level"), F.col("day").alias("node"))).alias("nodes")), *[F.struct(F.lit(p).alias("period"), _cover(F.col("day") - (p - 1), F.col("day"), levels).alias("nodes")) for p in periods])
    q = grid.select("entity", "day", F.inline(asked)).select("entity", "day", "period", F.inline("nodes"))
    hit = q.join(nodes.select("entity", "level", "node", "total", "n"), ["entity", "level", "node"], "left")
    pick = lambda c, p: F.sum(F.when(F.col("period") == p, F.col(c)))
    cols = [F.coalesce(pick("n", 0), F.lit(0)).alias("n_day")]
    for p in periods:
        n = F.coalesce(pick("n", p), F.lit(0))
        cols += [F.coalesce(pick("total", p), F.lit(0.0)).alias(f"total_{p}"), n.alias(f"n_{p}"), F.when(n > 0, pick("total", p) / n).alias(f"avg_{p}")]
    return hit.groupBy("entity", "day").agg(*cols)


def rolling_totals(readings: DataFrame, entity: str, periods: tuple[int, ...] = (7, 30), levels: int = LEVELS) -> DataFrame:
    """trailing() over readings: leaves, trees and range queries in one plan."""
    days = daily(readings, entity)
    return trailing(days, tree(days, levels), periods, levels)
