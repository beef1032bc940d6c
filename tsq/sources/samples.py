"""Samples: one row per time, group, tags and metric. Scans with filters, merging of sources, range edges, and adapters of the driver's tables."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsq.functions import values as va
from tsq.functions.names import ANY, PathMatcher, TagMatcher
from tsq.plans.timedomain import TimeRange, align
from tsq.schema import HISTOGRAM_DDL, SAMPLES_DDL, TAGS_DDL
from tsq.sources.tables import table

SERIES = ["grp", "tags", "metric"]
DAY_MS = 86_400_000


def read(spark: SparkSession, directory: str, time: TimeRange = TimeRange(), slack: int = 0, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
    """The samples of a history directory (Parquet, see sinks.append) that match.

    A time range prunes the partitions by date; paths up to their first star, and times, reach the scan, whose row groups are pruned by their statistics.
    """
    s = spark.read.parquet(directory)
    for t, end in ((time.begin, "begin"), (time.end, "end")):
        if t is not None:
            day = F.date_from_unix_date(F.lit((t - slack if end == "begin" else t + slack) // DAY_MS).cast("int"))
            s = s.where(F.col("date") >= day if end == "begin" else F.col("date") <= day)
    s = s.where(time.within(F.col("tp_ms"), slack)).where(group.joined(F.col("grp_key"))).where(metric.joined(F.col("metric_key")))
    return matching(s, group, tags, metric).select("tp_ms", *SERIES, "value")


def nothing(spark: SparkSession) -> DataFrame:
    """The source that is always empty."""
    return spark.createDataFrame([], SAMPLES_DDL)


def matching(samples: DataFrame, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
    """The samples whose group path, tags and metric name match."""
    out = samples
    if group is not ANY:
        out = out.where(group.column(F.col("grp")))
    if metric is not ANY:
        out = out.where(metric.column(F.col("metric")))
    return out.where(tags.column(F.col("tags"))) if tags.tests else out


@dataclass(frozen=True)
class History:
    """A history directory as a source."""

    spark: SparkSession
    directory: str

    def scan(self, time: TimeRange = TimeRange(), slack: int = 0, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
        return read(self.spark, self.directory, time, slack, group, tags, metric)


@dataclass(frozen=True)
class Wide:
    """A table whose rows hold several metrics of a series each, as a source: the metrics asked for are chosen before rows are made of them, and tests of tags that are
    columns reach the scan.

    df: tp_ms, grp, tags, the columns of tags and metrics. metrics: path, column and kernel that makes a value of it, each. tags: column of each tag.
    """

    df: DataFrame
    metrics: tuple[tuple[tuple[str, ...], str, Callable[[Column], Column]], ...]
    tags: dict[str, str]

    def scan(self, time: TimeRange = TimeRange(), slack: int = 0, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
        chosen = [m for m in self.metrics if metric.matches(list(m[0]))]
        if not chosen:
            return nothing(self.df.sparkSession)
        df = self.df.where(time.within(F.col("tp_ms"), slack))
        for test in tags.plain(self.tags, dict(self.df.dtypes)):
            df = df.where(test)
        df = matching(df, group, tags)
        row = lambda m: F.struct(_path(*m[0]).alias("metric"), m[2](F.col(m[1])).alias("value"))
        if len(chosen) == 1:
            return df.where(F.col(chosen[0][1]).isNotNull()).select("tp_ms", "grp", "tags", row(chosen[0]).alias("r")).select("tp_ms", "grp", "tags", "r.metric", "r.value")
        return df.select("tp_ms", "grp", "tags", F.inline(F.array(*map(row, chosen)))).where("value is not null").select("tp_ms", *SERIES, "value")

    def samples(self) -> DataFrame:
        return self.scan()


@dataclass(frozen=True)
class Plain:
    """A table of samples as a source."""

    df: DataFrame

    def scan(self, time: TimeRange = TimeRange(), slack: int = 0, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
        return matching(self.df.where(time.within(F.col("tp_ms"), slack)), group, tags, metric)


def source(samples: "DataFrame | History | Wide | Plain") -> "History | Wide | Plain":
    return Plain(samples) if isinstance(samples, DataFrame) else samples


def emit(samples: "DataFrame | History | Wide", time: TimeRange = TimeRange(), group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY, slack: int = 0) -> DataFrame:
    """All matching metrics over a time range. With an interval every series' value at every grid point; else the samples in the range, and at its
    two edges the values interpolated from the neighbours within the slack. Samples exactly at an edge are kept as they are.
    """
    near = source(samples).scan(time, slack, group, tags, metric).select("tp_ms", *SERIES, "value")
    spark = near.sparkSession
    if time.interval:
        return align(near, SERIES, time.grid(spark), slack).select("tp_ms", *SERIES, "value")
    inner = near.where(time.within(F.col("tp_ms")))
    edges = [t for t in (time.begin, time.end) if t is not None]
    if not edges or not slack:
        return inner
    at = spark.range(1).select(F.explode(F.array(*[F.lit(t).cast("bigint") for t in dict.fromkeys(edges)])).alias("tp_ms"))
    from tsq.plans.timedomain import between

    return inner.unionByName(between(near, SERIES, at, slack).select("tp_ms", *SERIES, "value"))


def emit_time(samples: "DataFrame | History | Wide", time: TimeRange = TimeRange(), slack: int = 0) -> DataFrame:
    """The distinct scrape times, tp_ms; on a grid its points. Of a stored history no other column than the times is read."""
    s = source(samples)
    if time.interval:
        return time.grid(SparkSession.active())
    return s.scan(time, slack).select("tp_ms").distinct()


def time_bounds(samples: DataFrame) -> DataFrame:
    """One row: first and last time, null without samples. Parquet answers it from footers."""
    return samples.agg(F.min("tp_ms").alias("first"), F.max("tp_ms").alias("last"))


def canonical_tags(tags: Column) -> Column:
    """Tags sorted by key, whole doubles as integers, so that equal tag sets are equal arrays."""
    fixed = F.transform(tags, lambda t: F.struct(t.k.alias("k"), va.canonical(t.v).alias("v")))
    return F.array_sort(F.when(F.exists(tags, lambda t: t.v.kind == 4), fixed).otherwise(tags), lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0))


def _hash() -> Column:
    """A key before the nested ones of a series, so that sorting and grouping seldom have to compare those."""
    return F.xxhash64(*SERIES)


def merge_combine(sources: list[DataFrame]) -> DataFrame:
    """The union of several sources' samples: of several values of one series at one time that of the first source counts."""
    tagged = [s.select("tp_ms", *SERIES, "value", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    one = reduce(DataFrame.unionByName, tagged).groupBy("tp_ms", _hash(), *SERIES).agg(F.min_by(F.struct("value"), F.struct("source", va.sort_key(F.col("value")))).alias("r"))
    return one.select("tp_ms", *SERIES, "r.value")


def last_wins(samples: DataFrame, seq: str) -> DataFrame:
    """One value per series and time: of several the one latest in seq."""
    one = samples.groupBy("tp_ms", _hash(), *SERIES).agg(F.max_by(F.struct("value"), F.col(seq)).alias("r"))
    return one.select("tp_ms", *SERIES, "r.value")


def scrapes(samples: DataFrame) -> DataFrame:
    """The samples regrouped: per time and group (path and tags) the list of (metric, value), sorted by metric."""
    return samples.groupBy("tp_ms", "grp", "tags").agg(F.array_sort(F.collect_list(F.struct("metric", "value")), lambda a, b: F.when(a.metric < b.metric, -1).when(a.metric > b.metric, 1).otherwise(0)).alias("metrics"))


def flatten(scraped: DataFrame) -> DataFrame:
    """scrapes() undone."""
    return scraped.select("tp_ms", "grp", "tags", F.inline("metrics")).select("tp_ms", *SERIES, "value")


def _tags(**tags: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in sorted(tags.items())]).cast(TAGS_DDL)


def _path(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def millis(ts: str) -> Column:
    """Epoch milliseconds of a timestamp, rounded down."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def wide_of(events: DataFrame) -> Wide:
    """Events (a table or a stream of it) as a source: group app.<event type>, tag user, metrics value and props.k."""
    tags = _tags(user=va.integer(F.col("user_id")))
    e = events.select(millis("ts").alias("tp_ms"), _path("app", F.col("event_type")).alias("grp"), tags.alias("tags"), F.col("user_id"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return Wide(e, ((("value",), "x", va.double), (("props", "k"), "k", va.integer)), {"user": "user_id"})


def wide_events(spark: SparkSession, d: str) -> Wide:
    """The events table, see wide_of."""
    return wide_of(table(spark, d, "events"))


def of_events(spark: SparkSession, d: str, grid_ms: int | None = None) -> DataFrame:
    """Samples of the events table, see wide_of. With grid_ms times are rounded down to a grid; the latest event of a series at a time counts."""
    if not grid_ms:
        return wide_events(spark, d).samples()
    t = millis("ts")
    # by columns, before series are made of them; of a metric the latest value that is there
    e = table(spark, d, "events").select((t - F.pmod(t, F.lit(grid_ms))).alias("tp_ms"), "event_type", "user_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.struct("ts", "event_id").alias("seq"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    e = e.groupBy("tp_ms", "event_type", "user_id").agg(latest("x"), latest("k"))
    e = e.withColumns({"grp": _path("app", F.col("event_type")), "tags": _tags(user=va.integer(F.col("user_id")))})
    return Wide(e, ((("value",), "x", va.double), (("props", "k"), "k", va.integer)), {"user": "user_id"}).samples()


def wide_orders(spark: SparkSession, d: str) -> Wide:
    """The orders table: group orders, tags cust, status and priority, metric totalprice; of a series' orders at one time that with the greatest key counts."""
    keys = {"cust": "o_custkey", "status": "o_orderstatus", "priority": "o_orderpriority"}
    o = table(spark, d, "orders").groupBy(millis("o_orderdate").alias("tp_ms"), *keys.values()).agg(F.max_by("o_totalprice", F.when(F.col("o_totalprice").isNotNull(), F.col("o_orderkey"))).alias("x"))
    tags = _tags(cust=va.integer(F.col("o_custkey")), status=va.string(F.col("o_orderstatus")), priority=va.string(F.col("o_orderpriority")))
    return Wide(o.withColumns({"grp": _path("orders"), "tags": tags}), ((("totalprice",), "x", va.double),), keys)


def wide_lineitem(spark: SparkSession, d: str) -> Wide:
    """The lineitem table by ship date, flag and status; several rows of a series at a time are the norm, of which the greatest order and line counts. It is chosen by plain columns, before series are made of them."""
    keys = {"flag": "l_returnflag", "status": "l_linestatus"}
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    seq = F.struct("l_orderkey", "l_linenumber")
    li = table(spark, d, "lineitem").groupBy(millis("l_shipdate").alias("tp_ms"), *keys.values()).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in names.values()])
    tags = _tags(flag=va.string(F.col("l_returnflag")), status=va.string(F.col("l_linestatus")))
    return Wide(li.withColumns({"grp": _path("lineitem"), "tags": tags}), tuple(((n,), c, va.double) for n, c in names.items()), keys)


def of_orders(spark: SparkSession, d: str) -> DataFrame:
    return wide_orders(spark, d).samples()


def of_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return wide_lineitem(spark, d).samples()


def elements(spark: SparkSession, d: str) -> DataFrame:
    """The rows of collection_elements that have a time, a group, a metric and a present value, as samples with their element_id."""
    e = table(spark, d, "collection_elements").where("tp_ms is not null and grp is not null and metric is not null and value is not null")
    tags = F.coalesce("tags", F.array().cast(TAGS_DDL))
    return e.select("tp_ms", "grp", canonical_tags(tags).alias("tags"), "metric", "value", "element_id")


def of_elements(spark: SparkSession, d: str) -> DataFrame:
    """Samples of collection_elements: elements with a time, a group, a metric and a present value; of a series' values at one time the greatest element_id counts."""
    return last_wins(elements(spark, d), "element_id")


def by_time(samples: DataFrame, times: DataFrame, parts: int) -> DataFrame:
    """samples in parts by ranges of time that hold about as many of the times (tp_ms) each. Rows move once, and those of a series together, so that they pack well."""
    q = times.agg(F.percentile_approx("tp_ms", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cuts = sorted(set(q or []))

    def part(low: int, high: int) -> Column:
        """How many cuts are at or before a time, if between low and high of them are."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("tp_ms") < cuts[mid], part(low, mid)).otherwise(part(mid + 1, high))

    return samples.sortWithinPartitions(_hash()).repartitionById(parts, part(0, len(cuts)))


def with_lists(samples: DataFrame) -> DataFrame:
    """samples whose values have an empty list of ranges instead of none where they are no histograms, for what goes to Python workers: for each row Spark's Arrow writer
    looks again at all rows since the last list that isn't null.
    """

    def full(v: Column) -> Column:
        fields = [F.coalesce(v[c], F.array().cast(HISTOGRAM_DDL)).alias(c) if c == "h" else v[c].alias(c) for c in ("kind", "b", "i", "u", "d", "s", "h")]
        return F.when(v.isNotNull(), F.struct(*fields))

    return samples.withColumns({"tags": F.transform("tags", lambda t: F.struct(t.k.alias("k"), full(t.v).alias("v"))), "value": full(F.col("value"))})
