"""Alerts from boolean values, and rules that are run over samples."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.functions import values as va

#: The states of an alert.
OK, TRIGGERING, FIRING, UNKNOWN = "OK", "TRIGGERING", "FIRING", "UNKNOWN"


def status(value: Column) -> Column:
    """State of a value: true is triggering, false ok; absent, empty and text values are unknown."""
    b = va.as_bool(value)
    return F.when(b, TRIGGERING).when(~b, OK).otherwise(UNKNOWN)


def value_is_ok(state: Column) -> Column:
    return state == OK


def alerts(facts: DataFrame, name: Column, message: Column | None = None) -> DataFrame:
    """One alert per row of facts (tp_ms, value, maybe tags): name, tp_ms, state, message, attributes (the tags as text)."""
    from tsq.functions.text import tags as tags_text

    attributes = tags_text(F.col("tags")) if "tags" in facts.columns else F.lit("{}")
    return facts.select(name.alias("name"), "tp_ms", status(F.col("value")).alias("state"), (message if message is not None else F.lit("")).alias("message"), attributes.alias("attributes"))


def extend(states: DataFrame, fire_after_ms: int | None = None) -> DataFrame:
    """The alerts' history: per name and stretch of one state name, state, since, duration (ms) and the other fields of its last row.

    states: name, tp_ms, state, message, attributes. A stretch lasts to its last row: while the state stays the same durations add up and since is kept; a new state starts anew.
    With fire_after_ms a triggering stretch of at least that duration is firing. Rows at one time count by state; rows with a null name or time are left out.
    """
    rows = states.where("name is not null and tp_ms is not null")
    w = Window.partitionBy("name").orderBy("tp_ms", "state")
    rows = rows.withColumn("step", F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)).withColumn("island", F.sum("step").over(w))
    last = lambda c: F.max_by(c, "tp_ms").alias(c)
    out = rows.groupBy("name", "island", "state").agg(F.min("tp_ms").alias("since"), (F.max("tp_ms") - F.min("tp_ms")).alias("duration"), last("message"), last("attributes")).drop("island")
    if fire_after_ms is None:
        return out
    return out.withColumn("state", F.when((F.col("state") == TRIGGERING) & (F.col("duration") >= fire_after_ms), FIRING).otherwise(F.col("state")))


class Rules:
    """Registered rules: named callables from a source of samples to a table of alerts (see alerts())."""

    def __init__(self) -> None:
        self._rules: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, rule: Callable[[DataFrame], DataFrame]) -> "Rules":
        if name in self._rules:
            raise ValueError(f"there is a rule {name} already")
        self._rules[name] = rule
        return self

    def run(self, samples: DataFrame) -> DataFrame:
        """The alerts of all rules, with the rule's name in the column rule."""
        if not self._rules:
            raise ValueError("there are no rules")
        return reduce(DataFrame.unionByName, [r(samples).withColumn("rule", F.lit(n)) for n, r in self._rules.items()])
