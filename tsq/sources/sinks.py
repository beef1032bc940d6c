"""Histories: where complete scrapes are appended, printed and fanned out."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.functions import text
from tsq.functions.names import SEP


def append(samples: DataFrame, directory: str) -> None:
    """Appends samples to a history directory: Parquet by UTC date, sorted by group, metric and time inside files, so that footers prune scans.

    The paths are also written joined (grp_key, metric_key): statistics and predicates know texts, not lists.

    Rows of a date are spread over as many tasks as the shuffle has and AQE keeps; Spark's commit protocol makes the append whole or void.
    """
    joined = lambda c: F.concat(F.array_join(c, SEP), F.when(F.size(c) > 0, SEP).otherwise(""))
    dated = samples.withColumns({"date": F.date_from_unix_date(F.floor(F.col("tp_ms") / F.lit(86_400_000)).cast("int")), "grp_key": joined("grp"), "metric_key": joined("metric")})
    spread = dated.hint("rebalance", "date")
    spread.sortWithinPartitions("date", "grp_key", "metric_key", "tp_ms").write.mode("append").partitionBy("date").parquet(directory)


def lines(samples: DataFrame) -> DataFrame:
    """One printable line per sample: 'time group{tags}::metric = value'."""
    time = F.date_format(F.timestamp_millis("tp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tags = F.when(F.size("tags") > 0, text.tags(F.col("tags"))).otherwise("")
    return samples.select("tp_ms", F.concat(time, F.lit(" "), text.path(F.col("grp")), tags, F.lit("::"), text.path(F.col("metric")), F.lit(" = "), text.value(F.col("value"))).alias("line"))


def printed(samples: DataFrame, out: Callable[[str], None] = print) -> None:
    """Prints every sample, in the order of time; the driver holds one partition at a time."""
    for r in lines(samples).orderBy("tp_ms", "line").toLocalIterator():
        out(r.line)


def fan_out(sinks: Iterable[Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives the facts of every batch (rows with is_fact, or all without that column) to each sink; speculative rows are dropped."""
    sinks = list(sinks)

    def write(batch: DataFrame, _: int) -> None:
        facts = batch.where("is_fact").drop("is_fact") if "is_fact" in batch.columns else batch
        facts.persist()
        try:
            for s in sinks:
                s(facts)
        finally:
            facts.unpersist()

    return write


