"""Catalogue queries over samples and collections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_scrapes(samples: DataFrame) -> DataFrame:
    """One row: the number of distinct scrape times."""
    return samples.agg(F.count_distinct("tp_ms").alias("scrapes"))


def metric_names(samples: DataFrame) -> DataFrame:
    """The distinct grp, tags, metric; sets are united per partition before the shuffle."""
    return samples.select("grp", "tags", "metric").distinct()


def sorted_by_time(samples: DataFrame) -> DataFrame:
    """The samples ascending in time, ties by group, metric and tags: for the API's edge only."""
    return samples.orderBy("tp_ms", "grp", "metric", "tags")


def merge_collections(elements: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections of one time merged: tp_ms, elements (distinct groups and metrics, later elements replacing earlier ones), complete (of any of them; unknown counts as not).

    elements: tp_ms, grp, metric, tags, element_id; collections: tp_ms, is_complete. Rows without a time are left out.
    """
    n = elements.where("tp_ms is not null").groupBy("tp_ms", "grp", "metric", "tags").agg(F.max("element_id").alias("last")).groupBy("tp_ms").agg(F.count("*").alias("elements"), F.max("last").alias("last_element"))
    c = collections.where("tp_ms is not null").groupBy("tp_ms").agg(F.bool_or(F.coalesce("is_complete", F.lit(False))).alias("complete"))
    return c.join(n, "tp_ms", "full").select("tp_ms", F.coalesce("elements", F.lit(0)).alias("elements"), "last_element", F.coalesce("complete", F.lit(False)).alias("complete"))
