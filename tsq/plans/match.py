"""Match clauses: keys that the sides of an operator join by, and tags of the result."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.functions import values as va
from tsq.plans.parser import Clause


def passes(c: Clause, tags: Column) -> Column:
    """Whether a tag set takes part: under 'by' it must have all the names."""
    if c.kind != "by":
        return F.lit(True)
    return F.size(F.filter(tags, lambda t: t.k.isin(*c.names))) == len(set(c.names))


def key(c: Clause, tags: Column) -> Column:
    if c.kind == "by":
        return F.filter(tags, lambda t: t.k.isin(*c.names))
    if c.kind == "without":
        return F.filter(tags, lambda t: ~t.k.isin(*c.names))
    return tags


def result_tags(c: Clause, left: Column, right: Column) -> Column:
    """Tags of a result: of 'by' those kept, of 'without' the left ones but the names, else the (equal) tags."""
    if c.kind == "default":
        return left
    if c.kind == "without" or c.keep == "selected":
        return key(c, left)
    return {"left": left, "right": right}.get(c.keep, F.array_intersect(left, right))


def same(x: str, y: str) -> Column:
    """Join condition that two keys (tag arrays) are equal: by their hashes, which are cheap to shuffle and sort, and then by themselves, in a form that isn't taken for a key of the join."""
    return (F.xxhash64(F.col(x)) == F.xxhash64(F.col(y))) & same_keys(x, y)


def same_keys(x: str, y: str) -> Column:
    """The same of keys whose hashes are known to be equal."""
    a, b = F.col(x), F.col(y)
    return (a <= b) & (a >= b)


def first_by_key(df: DataFrame, c: Clause, order: list[str]) -> DataFrame:
    """A side's rows one per time and key: of several series that fall on one key the first in the given order."""
    df = df.where(passes(c, F.col("tags"))).withColumn("mkey", key(c, F.col("tags")))
    pick = df.groupBy("tp_ms", F.xxhash64("mkey"), "mkey").agg(F.min_by(F.struct("tags", "value"), F.struct(*order)).alias("r"))
    return pick.select("tp_ms", "r.tags", "mkey", "r.value")


def collide(df: DataFrame, c: Clause) -> DataFrame:
    """Results one per time and key under the clause they are wanted for: several that fall on one key give an empty value."""
    df = df.where(passes(c, F.col("tags"))).withColumn("mkey", key(c, F.col("tags")))
    one = df.groupBy("tp_ms", F.xxhash64("mkey"), "mkey").agg(F.min("tags").alias("tags"), F.count("*").alias("n"), F.first("value").alias("v"))
    return one.select("tp_ms", "tags", F.when(F.col("n") > 1, va.empty()).otherwise(F.col("v")).alias("value"))
