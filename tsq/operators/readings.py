"""Usable readings: the flat numeric form of collection elements that the grid, spike and rolling operators start from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_text(tags: str, key: str) -> Column:
    """Text of a tag, null without the tag. Reads only the leaves k and v.s, so the scan prunes the other branches."""
    return F.get(F.col(f"{tags}.v.s"), F.array_position(F.col(f"{tags}.k"), key).cast("int") - 1)


def number(value: str) -> Column:
    """A value's number as a double; null unless its kind is an integer or a double."""
    kind = F.col(f"{value}.kind")
    return (
        F.when(kind == 4, F.col(f"{value}.d"))
        .when(kind == 3, F.coalesce(F.col(f"{value}.i").cast("double"), F.col(f"{value}.u").cast("double")))
        .when(kind == 2, F.col(f"{value}.i").cast("double"))
    )


def usable_readings(elements: DataFrame, finite: bool = False) -> DataFrame:
    """element_id, host, grp, metric, tp_ms and v of the elements with a host tag, a time and a number other than NaN.

    grp and metric are paths joined with '.'. Rows with a null in any of these are left out; infinite numbers stay unless finite.
    Redelivered rows stay too: the operators remove them inside the shuffle that they need anyway. No shuffle.
    """
    out = elements.select(
        "element_id",
        tag_text("tags", "host").alias("host"),
        F.array_join("grp", ".").alias("grp"),
        F.array_join("metric", ".").alias("metric"),
        "tp_ms",
        number("value").alias("v"),
    ).where("host is not null and tp_ms is not null and v is not null and not isnan(v) and element_id is not null")
    return out.where("v > double('-infinity') and v < double('infinity')") if finite else out


def catalog(df: DataFrame) -> DataFrame:
    """The metric catalog keyed as usable_readings: grp, metric, nature, lo, hi, interval_ms."""
    return df.select(
        F.array_join("grp", ".").alias("grp"), F.array_join("metric", ".").alias("metric"), "nature", "lo", "hi", (F.col("interval_s").cast("bigint") * 1000).alias("interval_ms")
    )
