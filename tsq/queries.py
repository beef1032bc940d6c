"""Queries of the core library and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.operators import drift
from tsq.operators.grid import regular_grid
from tsq.operators.readings import catalog, usable_readings
from tsq.operators.rolling import corrected, daily, rolling_totals, trailing, tree
from tsq.operators.spikes import implausible
from tsq.sources.tables import broadcast_if_small, cut, table

GRID_KEYS = ["host", "metric"]


def _typed(spark: SparkSession, d: str, natures: str) -> DataFrame:
    """Usable readings with what the catalog says of their metric. The catalog's size is checked before it is broadcast."""
    of = broadcast_if_small(catalog(table(spark, d, "metric_catalog")).where(f"nature in ({natures})"))
    return usable_readings(table(spark, d, "collection_elements")).join(of, ["grp", "metric"])


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(_typed(spark, d, "'gauge', 'level', 'counter'"), GRID_KEYS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where("status <> 'observed'").select("host", "metric", "slot_ms")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_changes(spark, d).select("feed", "file_no", "change_kind", "field_name")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    # the schemas of the files are small beside the records: written once, for the several uses in changes()
    return drift.changes(cut(drift.fields(table(spark, d, "raw_collections"))))


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    return drift.fields(table(spark, d, "raw_collections"))


def p3_readings(spark: SparkSession, d: str) -> DataFrame:
    return drift.readings(table(spark, d, "raw_collections"))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible(_typed(spark, d, "'gauge', 'level'"))


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The flags that plain rules tell: impossible and stuck readings."""
    return p4_flags(spark, d).where("reason <> 'spike'")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).select("element_id")


def _work(spark: SparkSession, d: str) -> DataFrame:
    return usable_readings(table(spark, d, "collection_elements")).where("grp = 'batch.worker' and metric = 'work.done'")


def _told(t: DataFrame) -> DataFrame:
    return t.select(F.col("entity").alias("host"), F.date_from_unix_date(F.col("day").cast("int")).cast("string").alias("day_utc"), "n_day", F.round("total_7", 6).alias("total_7"), "n_7", F.round("avg_7", 9).alias("avg_7"), F.round("total_30", 6).alias("total_30"), "n_30", F.round("avg_30", 9).alias("avg_30"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return _told(rolling_totals(_work(spark, d), "host"))


def p6_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same totals, from trees of what was there in time and corrections by what came more than six hours late."""
    e = table(spark, d, "collection_elements").where("grp = array('batch', 'worker') and metric = array('work', 'done')")
    late = F.coalesce(F.unix_millis(F.col("received_at").cast("timestamp")) - F.col("tp_ms") > 6 * 3_600_000, F.lit(False))
    first, then = (daily(usable_readings(e.where(c)), "host") for c in (~late, late))
    nodes = corrected(tree(first), then)
    leaves = nodes.where("level = 0").select("entity", F.col("node").alias("day"), "total", "n")
    return _told(trailing(leaves, nodes))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_totals(spark, d).where("n_day = 0 and n_7 > 0").select("host", "day_utc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_grid, p3_found, p3_changes, p3_fields, p3_readings, p4_found, p4_flags, p4_bounds, p6_found, p6_totals, p6_corrected)}


#: Usable readings, as a common table expression.
_USABLE = """
with u as (
  select distinct element_id, list_extract(list_transform(list_filter(tags, lambda t: t.k = 'host'), lambda t: t.v.s), 1) host, array_to_string(grp, '.') grp, array_to_string(metric, '.') metric, tp_ms,
         case value.kind when 4 then value.d when 3 then coalesce(value.i::double, value.u::double) when 2 then value.i::double end v
  from collection_elements),
r as (select * from u where host is not null and tp_ms is not null and element_id is not null and v is not null and not isnan(v)),
c as (select array_to_string(grp, '.') grp, array_to_string(metric, '.') metric, nature, lo, hi, interval_s * 1000 step from metric_catalog)
"""

_GRID = _USABLE + """,
b as (select host, metric, step, tp_ms // step * step slot, min(tp_ms) f, max(tp_ms) l, max_by(v, (tp_ms, element_id)) x from r join c using (grp, metric) where nature in ('gauge', 'level', 'counter') group by all),
n as (select *, lead(slot) over w ns, lead(f) over w nf from b window w as (partition by host, metric order by slot)),
g as (select *, unnest(case when nf - l <= 21600000 then range(slot, ns, step) else [slot] end) as pos from n)
"""

_ROLL = _USABLE + """,
d as (select host, floor(tp_ms / 86400000)::bigint as day, sum(v) total, count(*) n from r where grp = 'batch.worker' and metric = 'work.done' group by all),
s as (select host, unnest(range(min(day), max(day) + 1)) as day from d group by host),
t as (select host, day, coalesce(n, 0)::bigint n_day,
        coalesce(sum(total) over w7, 0) total_7, coalesce(sum(n) over w7, 0)::bigint n_7, coalesce(sum(total) over w30, 0) total_30, coalesce(sum(n) over w30, 0)::bigint n_30
      from s left join d using (host, day) window w7 as (partition by host order by day range between 6 preceding and current row), w30 as (partition by host order by day range between 29 preceding and current row))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _GRID + "select host, metric, pos as slot_ms from g where pos <> slot",
        "p1_grid": _GRID + """select host, metric, pos as slot_ms, case when pos = slot then 'observed' when pos - slot <= 10 * step then 'filled' else 'missing' end status,
            case when pos - slot <= 10 * step then x end as value, case when pos = slot then 0 else pos - l end::bigint age_ms from g""",
        "p4_bounds": _USABLE + """, g as (select element_id, nature, coalesce(v < lo, false) or coalesce(v > hi, false) outside, host, metric, tp_ms, v from r join c using (grp, metric) where nature in ('gauge', 'level')),
            n as (select *, sum(case when v = p then 0 else 1 end) over (partition by host, metric order by tp_ms, element_id) run from (select *, lag(v) over (partition by host, metric order by tp_ms, element_id) p from g)),
            k as (select *, count(*) over (partition by host, metric, run) n from n)
            select element_id, if(outside, 'impossible', 'stuck') reason from k where outside or nature = 'gauge' and n >= 12""",
        "p6_found": _ROLL + "select host, cast(date '1970-01-01' + day::int as varchar) day_utc from t where n_day = 0 and n_7 > 0",
        **dict.fromkeys(("p6_totals", "p6_corrected"), _ROLL + """select host, cast(date '1970-01-01' + day::int as varchar) day_utc, n_day, round(total_7, 6) total_7, n_7, round(if(n_7 > 0, total_7 / n_7, null), 9) avg_7,
            round(total_30, 6) total_30, n_30, round(if(n_30 > 0, total_30 / n_30, null), 9) avg_30 from t"""),
    }
