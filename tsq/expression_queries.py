"""Queries of the reference's own operators over the driver's tables, and their SQL.

Results are flat: the one tag is a column, values are doubles, booleans or text. An empty value comes out as null here.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq import platform_queries as pq
from tsq.functions import histogram as hg
from tsq.functions import text as tx
from tsq.functions import values as va
from tsq.functions.names import tag_value
from tsq.operators import alerts as al
from tsq.operators import catalog as cat
from tsq.plans import compiler
from tsq.plans.parser import parse_path_matcher, parse_tag_matcher
from tsq.plans.timedomain import TimeRange
from tsq.sources import samples as sm
from tsq.sources.tables import table

HOUR = 3_600_000
JAN_1 = 1_704_067_200_000

Query = Callable[[SparkSession, str], DataFrame]


def _num(v: Column) -> Column:
    return F.round(va.as_double(v), 6).alias("v")


def _user() -> Column:
    return tag_value(F.col("tags"), "user").getField("i").alias("user_id")


def _events(text: str, time: TimeRange = TimeRange(), slack: int = 0, value: Callable[[Column], Column] = _num) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = compiler.evaluate(sm.wide_events(spark, d), text, time, slack)
        return r.select("tp_ms", _user(), value(F.col("value")))

    return run


def _bool(v: Column) -> Column:
    return va.as_bool(v).alias("v")


_EV = "with e as (select epoch_us(ts) // 1000 tp_ms, event_type, user_id, value, cast(json_extract_string(props, '$.k') as bigint) k from events)\n"


def _sql(v: str, event: str = "purchase", where: str = "true") -> str:
    return f"{_EV}select tp_ms, user_id, {v} as v from e where event_type = '{event}' and {where}"


#: Name: expression over events, SQL of its value, event type, whether boolean.
_EXPRESSIONS = {
    "arith_add": ("app.purchase::value + 3", "round(value + 3, 6)", "purchase", False),
    "arith_sub": ("100 - app.purchase::value", "round(100 - value, 6)", "purchase", False),
    "arith_mul": ("app.purchase::value * 2", "round(value * 2, 6)", "purchase", False),
    "arith_div": ("app.view::props.k / 7", "round(k / 7.0::double, 6)", "view", False),
    "arith_div_zero": ("app.view::value / 0", "null::double", "view", False),
    "arith_mod": ("app.view::props.k % 7", "(k % 7)::double", "view", False),
    "arith_mod_real": ("app.click::value % 7.5", "round(value - 7.5::double * round_even(value / 7.5::double, 0), 6)", "click", False),
    "arith_neg": ("-app.signup::value", "round(-value, 6)", "signup", False),
    "arith_shl": ("app.view::props.k << 3", "(k * 8)::double", "view", False),
    "arith_shr": ("app.view::props.k >> 2", "(k >> 2)::double", "view", False),
    "arith_shl_wide": ("app.view::props.k << 62", "round(k * pow(2::double, 62), 6)", "view", False),
    "arith_precedence": ("(1 << 2) * 10 + app.view::props.k * ----2 % 7", "(40 + (k * 2) % 7)::double", "view", False),
    "cmp_eq": ("app.view::props.k = 42", "k = 42", "view", True),
    "cmp_ne": ("app.view::props.k != 42", "k <> 42", "view", True),
    "cmp_lt": ("app.view::value < 50", "value < 50", "view", True),
    "cmp_gt": ("app.view::value > 50", "value > 50", "view", True),
    "cmp_le": ("app.view::props.k <= 42", "k <= 42", "view", True),
    "cmp_ge": ("app.view::props.k >= 42", "k >= 42", "view", True),
    "cmp_text": ("app.view::value < \"text\"", "null::boolean", "view", True),
    "logic_not": ("!app.view::props.k", "k = 0", "view", True),
    "logic_and": ("app.error::value > 50 && app.error::props.k < 50", "value > 50 and k < 50", "error", True),
    "logic_or": ("app.error::value > 90 || app.error::props.k < 10", "value > 90 or k < 10", "error", True),
    "vector_vector": ("app.error::value + app.error::props.k", "round(value + k, 6)", "error", False),
}

_FILTERS = {
    "scan_literal": ("app.view::value", "event_type = 'view'", "value"),
    "tag_presence": ("app.view{user}::value", "event_type = 'view'", "value"),
    "tag_absence": ("app.view{!user}::value", "false", "value"),
    "tag_eq": ("app.view{user=42}::value", "event_type = 'view' and user_id = 42", "value"),
    "tag_ne": ("app.view{user!=42}::value", "event_type = 'view' and user_id <> 42", "value"),
    "tag_range": ("app.view{user>=42, user<99.5}::value", "event_type = 'view' and user_id >= 42 and user_id < 99.5", "value"),
    "tag_order": ("app.view{user<=42, user>7}::value", "event_type = 'view' and user_id <= 42 and user_id > 7", "value"),
    "tag_text": ("app.view{user<\"b\"}::value", "false", "value"),
    "path_wildcard": ("*.click::props.*", "event_type = 'click'", "k"),
    "path_double_wildcard": ("**.click::**.k", "event_type = 'click'", "k"),
}


def _lineitem(text: str, value: Callable[[Column], Column] = _num) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = compiler.evaluate(sm.wide_lineitem(spark, d), text, slack=0)
        return r.select("tp_ms", tag_value(F.col("tags"), "flag").getField("s").alias("flag"), tag_value(F.col("tags"), "status").getField("s").alias("status"), value(F.col("value")))

    return run


_LI = """with l as (select epoch_us(l_shipdate) // 1000 tp_ms, l_returnflag flag, l_linestatus status, l_quantity q, l_extendedprice p, l_discount d, l_tax t
  from lineitem qualify row_number() over (partition by l_shipdate, l_returnflag, l_linestatus order by l_orderkey desc, l_linenumber desc) = 1),
f as (select * from l qualify row_number() over (partition by tp_ms, flag order by status) = 1),
n as (select tp_ms, flag, count(*) n from l group by all)
"""

_JOINS = {
    "join_default": ("lineitem::price * (1 - lineitem::discount)", "select tp_ms, flag, status, round(p * (1 - d), 6) v from l"),
    "join_by_keep_selected": ("lineitem::price - by (flag) lineitem::quantity", "select tp_ms, flag, null::varchar status, round(p - q, 6) v from f"),
    "join_by_keep_left": ("lineitem::price - by (flag) keep left lineitem::quantity", "select tp_ms, flag, status, round(p - q, 6) v from f"),
    "join_by_keep_right": ("lineitem::price - by (flag) keep right lineitem::quantity", "select tp_ms, flag, status, round(p - q, 6) v from f"),
    "join_by_keep_common": ("lineitem::price - by (flag) keep common lineitem::quantity", "select tp_ms, flag, status, round(p - q, 6) v from f"),
    "join_without": ("lineitem::price - without (status) lineitem::tax", "select tp_ms, flag, null::varchar status, round(p - t, 6) v from f"),
    "join_collision": ("(lineitem::price + lineitem::tax) * by (flag) lineitem::quantity", "select tp_ms, flag, null::varchar status, case when n = 1 then round((p + t) * q, 6) end v from f join n using (tp_ms, flag)"),
    "join_missing_tag": ("lineitem::price * by (nosuch) lineitem::tax", "select tp_ms, flag, status, p v from l where false"),
}


def _align_vector(spark: SparkSession, d: str) -> DataFrame:
    return _events("app.view::value + app.click::value", slack=12 * HOUR)(spark, d)


def _align_constant(spark: SparkSession, d: str) -> DataFrame:
    """A constant is defined at every scrape time, so the vector is interpolated at all of them."""
    return _events("app.signup::value * 2", slack=HOUR // 2)(spark, d)


def _by_type(spark: SparkSession, d: str, event: str) -> DataFrame:
    return sm.of_events(spark, d).where((F.get("grp", F.lit(1)) == event) & (F.get("metric", F.lit(0)) == "value")).groupBy("tp_ms").agg(F.max(va.as_double(F.col("value"))).alias("x")).select("tp_ms", va.double(F.col("x")).alias("value"))


def _align_scalar(spark: SparkSession, d: str) -> DataFrame:
    r = compiler.merge_scalars(lambda v: va.subtract(v[0], v[1]), [_by_type(spark, d, "view"), _by_type(spark, d, "error")], 5 * 60_000)
    return r.select("tp_ms", _num(F.col("value")))


def _scalar_vector(spark: SparkSession, d: str) -> DataFrame:
    s = sm.of_events(spark, d).where(F.get("grp", F.lit(1)) == "click")
    v = compiler.evaluate(s, "app.click::props.k", slack=0)
    r = compiler.merge_vectors(lambda x: va.add(x[0], x[1]), [_by_type(spark, d, "click"), v], 0)
    return r.select("tp_ms", _user(), _num(F.col("value")))


def _series(r: DataFrame) -> DataFrame:
    return r.select("tp_ms", F.get("grp", F.lit(1)).alias("event_type"), _user(), F.array_join("metric", ".").alias("metric"), _num(F.col("value")))


def _range_edges(spark: SparkSession, d: str) -> DataFrame:
    return _series(sm.emit(sm.wide_events(spark, d), TimeRange(JAN_1 + 48 * HOUR, JAN_1 + 60 * HOUR), slack=6 * HOUR, metric=parse_path_matcher("value")))


def _whole_range(spark: SparkSession, d: str, interval: int) -> TimeRange:
    """From the first to the last time of the events by an interval that doesn't divide that span; without events an empty one."""
    first, last = sm.time_bounds(sm.of_events(spark, d)).first()
    return TimeRange(0, 0, interval) if first is None else TimeRange(first, last, interval + ((last - first) % interval == 0))


def _resample_grid(spark: SparkSession, d: str) -> DataFrame:
    return _series(sm.emit(sm.wide_events(spark, d), _whole_range(spark, d, 7 * HOUR), slack=12 * HOUR, metric=parse_path_matcher("value")))


def _expression_grid(spark: SparkSession, d: str) -> DataFrame:
    return _events("app.view::value + 1", _whole_range(spark, d, 4 * HOUR), slack=8 * HOUR)(spark, d)


def _scan_range(spark: SparkSession, d: str) -> DataFrame:
    s = sm.emit(sm.wide_events(spark, d), TimeRange(JAN_1 + 24 * HOUR, JAN_1 + 48 * HOUR), parse_path_matcher("app.**"), parse_tag_matcher("{user}"), parse_path_matcher("*"))
    return _series(s)


def _emit_time(spark: SparkSession, d: str) -> DataFrame:
    return sm.emit_time(sm.wide_events(spark, d), TimeRange(JAN_1, JAN_1 + 24 * HOUR), HOUR)


def _count_scrapes(spark: SparkSession, d: str) -> DataFrame:
    return cat.count_scrapes(sm.of_events(spark, d))


def _metric_names(spark: SparkSession, d: str) -> DataFrame:
    n = cat.metric_names(sm.of_events(spark, d))
    return n.select(F.array_join("grp", ".").alias("grp"), _user(), F.array_join("metric", ".").alias("metric"))


def _time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return sm.time_bounds(sm.of_lineitem(spark, d))


def _merge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping sources: the first one's values count."""
    a = sm.of_events(spark, d, HOUR)
    b = sm.of_events(spark, d, HOUR).withColumn("value", va.double(F.lit(-1.0)))
    odd = F.pmod(tag_value(F.col("tags"), "user").getField("i"), F.lit(2)) == 1
    return _series(sm.merge_combine([a.where(odd), b]))


def _last_wins(spark: SparkSession, d: str) -> DataFrame:
    return sm.of_lineitem(spark, d).select("tp_ms", tag_value(F.col("tags"), "flag").getField("s").alias("flag"), tag_value(F.col("tags"), "status").getField("s").alias("status"), F.array_join("metric", ".").alias("metric"), _num(F.col("value")))


def _scrapes(spark: SparkSession, d: str) -> DataFrame:
    s = sm.scrapes(sm.of_lineitem(spark, d))
    return s.select("tp_ms", tag_value(F.col("tags"), "flag").getField("s").alias("flag"), tag_value(F.col("tags"), "status").getField("s").alias("status"), F.size("metrics").alias("metrics"), F.array_join(F.transform("metrics", lambda m: F.array_join(m.metric, ".")), ",").alias("names"))


def _merge_collections(spark: SparkSession, d: str) -> DataFrame:
    return cat.merge_collections(table(spark, d, "collection_elements"), table(spark, d, "scrape_collections"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    r = compiler.evaluate(sm.wide_orders(spark, d), 'orders{status="F", priority}::totalprice / 1000', slack=0)
    return r.select("tp_ms", tag_value(F.col("tags"), "cust").getField("i").alias("cust"), tag_value(F.col("tags"), "priority").getField("s").alias("priority"), _num(F.col("value")))


def _alert_status(spark: SparkSession, d: str) -> DataFrame:
    f = compiler.evaluate(sm.wide_events(spark, d), "app.purchase::value > 40", slack=0)
    return al.alerts(f, _user().cast("string")).select("name", "tp_ms", "state", "attributes")


def _alert_extend(spark: SparkSession, d: str) -> DataFrame:
    f = compiler.evaluate(sm.wide_events(spark, d), "app.purchase::value > 40", slack=0)
    return al.extend(al.alerts(f, _user().cast("string")), fire_after_ms=12 * HOUR).select("name", "state", "since", "duration")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    rules = al.Rules()
    for e in ("view", "error"):
        rules.add(f"high {e}", lambda s, e=e: al.alerts(compiler.evaluate(s, f"app.{e}::value > 95", slack=0), F.lit(e)))
    return rules.run(sm.wide_events(spark, d)).where(F.col("state") == "TRIGGERING").groupBy("rule").agg(F.count("*").alias("alerts"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collection_elements").where("element_id is not null").select("element_id", "value").distinct()


def _coercions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _values(spark, d).select("element_id", va.as_bool(v).alias("truth"), F.round(va.as_double(v), 6).alias("number"), va.as_string(v).alias("string"))


def _value_text(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("element_id", tx.value(F.col("value")).alias("text"))


def _value_order(spark: SparkSession, d: str) -> DataFrame:
    """The least and greatest value of each metric in the weak order, of values of all kinds."""
    e = table(spark, d, "collection_elements").where("value is not null")
    k = F.struct(va.sort_key(F.col("value")).alias("k"), F.col("value"))
    g = e.groupBy(F.array_join("grp", ".").alias("grp"), F.array_join("metric", ".").alias("metric")).agg(F.min(k).alias("a"), F.max(k).alias("b"))
    ends = [c for x, n in (("a", "least"), ("b", "greatest")) for c in (F.col(f"{x}.value.kind").cast("int").alias(f"{n}_kind"), tx.value(F.col(f"{x}.value")).alias(n))]
    return g.select("grp", "metric", *ends)


def _histograms(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).where("value.kind = 6").select("element_id", F.col("value.h").alias("h"))


def _hist_stats(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("h")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _histograms(spark, d).select("element_id", r(hg.low(h), "low"), r(hg.high(h), "high"), r(hg.total(h), "total"), r(hg.count(h), "n"), F.round(hg.mean(h), 9).alias("mean"), hg.is_empty(h).alias("is_empty"))


def _ranges(df: DataFrame) -> DataFrame:
    return df.select("element_id", F.inline("h")).select("element_id", "lo", "hi", F.round("cnt", 6).alias("cnt"))


def _hist_op(f: Callable[[Column], Column]) -> Query:
    return lambda spark, d: _ranges(_histograms(spark, d).select("element_id", f(va.histogram(F.col("h"))).getField("h").alias("h")))


def _hist_difference(spark: SparkSession, d: str) -> DataFrame:
    """Three times each histogram less itself."""
    v = _histograms(spark, d).select("element_id", va.histogram(F.col("h")).alias("v")).withColumn("w", va.multiply(F.col("v"), va.literal(3)))
    return _ranges(v.select("element_id", va.subtract(F.col("w"), F.col("v")).getField("h").alias("h")))


def _hist_add(spark: SparkSession, d: str) -> DataFrame:
    """Each histogram plus the range 0..1000 with a count of 10: every range of it is split off."""
    return _ranges(_histograms(spark, d).select("element_id", hg.insert(F.col("h"), F.lit(0.0), F.lit(1000.0), F.lit(10.0)).alias("h")))


def _hist_running(spark: SparkSession, d: str) -> DataFrame:
    return _histograms(spark, d).select("element_id", F.inline(hg.running(F.col("h")))).select("element_id", "lo", "hi", F.round("upto", 6).alias("upto"))


def _hist_text(spark: SparkSession, d: str) -> DataFrame:
    return _histograms(spark, d).select("element_id", hg.text(F.col("h")).alias("text"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {n: _events(e, value=_bool if b else _num) for n, (e, _, _, b) in _EXPRESSIONS.items()}
    out |= {n: _events(e) for n, (e, _, _) in _FILTERS.items()}
    out |= {n: _lineitem(e) for n, (e, _) in _JOINS.items()}
    out |= {
        "scan_range": _scan_range, "emit_time": _emit_time, "count_scrapes": _count_scrapes, "metric_names": _metric_names, "time_bounds": _time_bounds,
        "merge_dedupe": _merge_dedupe, "last_wins": _last_wins, "scrapes": _scrapes, "merge_collections": _merge_collections, "orders_selector": _orders,
        "align_interpolate_vector": _align_vector, "align_interpolate_constant": _align_constant, "align_interpolate_scalar": _align_scalar, "join_scalar_vector": _scalar_vector,
        "resample_grid": _resample_grid, "range_edges": _range_edges, "expression_grid": _expression_grid,
        "alert_status": _alert_status, "alert_extend": _alert_extend, "rules": _rules,
        "value_coercions": _coercions, "value_text": _value_text, "value_order": _value_order,
        "hist_stats": _hist_stats, "hist_scale": _hist_op(lambda v: va.multiply(v, va.literal(3))), "hist_divide": _hist_op(lambda v: va.divide(v, va.literal(4.0))),
        "hist_negate": _hist_op(va.negate), "hist_add": _hist_add, "hist_sum": _hist_op(lambda v: va.add(v, v)), "hist_difference": _hist_difference,
        "hist_running": _hist_running, "hist_text": _hist_text,
    }
    return out


def _aligned(left: str, right: str, part: str, slack: int) -> str:
    """SQL of two series sets at the union of their times, by windows over each series with rows at all times."""

    def side(n: str, src: str) -> str:
        w = f"partition by {part + ', ' if part else ''}grp order by tp_ms"
        return f"""{n}_all as (select t.tp_ms, k.*, s.x from t, (select distinct {part + ', ' if part else ''}1 grp from {src}) k left join {src} s on s.tp_ms = t.tp_ms {f"and s.{part} = k.{part}" if part else ''}),
        {n}_w as (select *, last_value(case when x is not null then {{'t': tp_ms, 'v': x}} end ignore nulls) over ({w} range between {slack} preceding and 1 preceding) p,
            first_value(case when x is not null then {{'t': tp_ms, 'v': x}} end ignore nulls) over ({w} range between 1 following and {slack} following) f from {n}_all),
        {n} as (select tp_ms, {part + ', ' if part else ''}case when x is not null then x when p is not null and f is not null then p.v * ((f.t - tp_ms)::double / (f.t - p.t)) + f.v * ((tp_ms - p.t)::double / (f.t - p.t)) end x from {n}_w)"""

    return f"t as (select tp_ms from {left} union select tp_ms from {right}), {side('a', left)}, {side('b', right)}"


def _at_times(slack: int) -> str:
    """SQL of all series' values at the times t: exact, or interpolated between the neighbours within the slack."""
    return f"""s as (select user_id, event_type, tp_ms, value x from e), k as (select distinct user_id, event_type from s), q as (select t.tp_ms, k.user_id, k.event_type from t, k),
p as (select q.*, s.tp_ms pt, s.x px from q asof left join s on q.user_id = s.user_id and q.event_type = s.event_type and q.tp_ms >= s.tp_ms),
n as (select p.*, s.tp_ms nt, s.x nx from p asof left join s on p.user_id = s.user_id and p.event_type = s.event_type and p.tp_ms <= s.tp_ms),
at_t as (select tp_ms, event_type, user_id, case when pt = tp_ms then px when pt >= tp_ms - {slack} and nt <= tp_ms + {slack} then px * ((nt - tp_ms)::double / (nt - pt)) + nx * ((tp_ms - pt)::double / (nt - pt)) end v from n)
"""


_VALUES = "with x as (select distinct element_id, value from collection_elements where element_id is not null)\n"
_HIST = "with h as (select distinct element_id, value.h h from collection_elements where element_id is not null and value.kind = 6), r as (select element_id, unnest(h) r from h)\n"
_INT = "coalesce(value.i::varchar, value.u::varchar)"


def oracle_sql() -> dict[str, str]:
    out = {n: _sql(v, ev) for n, (_, v, ev, _) in _EXPRESSIONS.items()}
    out |= {n: f"{_EV}select tp_ms, user_id, round({c}, 6)::double v from e where {w}" for n, (_, w, c) in _FILTERS.items()}
    out |= {n: _LI + s for n, (_, s) in _JOINS.items()}
    whole = lambda step: f"{_EV}, m as (select min(tp_ms) a, max(tp_ms) z from e), t as (select unnest(range(a, z + 1, {step} + if((z - a) % {step} = 0, 1, 0))) tp_ms from m union select z from m), "
    edge = f"{_EV}, t as (select unnest([{JAN_1 + 48 * HOUR}, {JAN_1 + 60 * HOUR}]) tp_ms), "
    alerts = f"""{_EV}, a as (select user_id::varchar as name, tp_ms, case when value > 40 then 'TRIGGERING' else 'OK' end state from e where event_type = 'purchase'),
        i as (select *, sum(case when state = prev then 0 else 1 end) over (partition by name order by tp_ms, state) island from (select *, lag(state) over (partition by name order by tp_ms, state) prev from a))"""
    out |= {
        "scan_range": f"{_EV}select tp_ms, event_type, user_id, 'value' metric, round(value, 6) v from e where tp_ms between {JAN_1 + 24 * HOUR} and {JAN_1 + 48 * HOUR}",
        "emit_time": f"{_EV}select distinct tp_ms from e where tp_ms between {JAN_1 - HOUR} and {JAN_1 + 25 * HOUR}",
        "count_scrapes": f"{_EV}select count(distinct tp_ms) scrapes from e",
        "metric_names": f"{_EV}select distinct 'app.' || event_type grp, user_id, m metric from e, (values ('value'), ('props.k')) x(m)",
        "time_bounds": "select min(epoch_us(l_shipdate) // 1000) as \"first\", max(epoch_us(l_shipdate) // 1000) as \"last\" from lineitem",
        "merge_dedupe": f"""{_EV}, h as (select *, tp_ms // {HOUR} * {HOUR} hr, m.m metric from e, (values ('value'), ('props.k')) m(m)),
            r as (select *, row_number() over (partition by hr, event_type, user_id, metric order by ts desc, event_id desc) rn from (select epoch_us(ts) // 1000 // {HOUR} * {HOUR} hr, ts, event_id, event_type, user_id, value, cast(json_extract_string(props, '$.k') as bigint) k, m metric from events, (values ('value'), ('props.k')) x(m)))
            select hr tp_ms, event_type, user_id, metric, case when user_id % 2 = 1 then case metric when 'value' then round(value, 6) else k end else -1 end::double v from r where rn = 1""",
        "last_wins": _LI + "select tp_ms, flag, status, m metric, round(case m when 'quantity' then q when 'price' then p when 'discount' then d else t end, 6) v from l, (values ('quantity'), ('price'), ('discount'), ('tax')) x(m)",
        "scrapes": _LI + "select tp_ms, flag, status, 4::int metrics, 'discount,price,quantity,tax' names from l",
        "merge_collections": """with d as (select tp_ms, grp, metric, tags, max(element_id) m from collection_elements where tp_ms is not null group by all),
            n as (select tp_ms, count(*) n, max(m) m from d group by all), c as (select tp_ms, bool_or(coalesce(is_complete, false)) c from scrape_collections where tp_ms is not null group by all)
            select tp_ms, coalesce(n, 0)::bigint elements, m last_element, coalesce(c, false) complete from n full join c using (tp_ms)""",
        "orders_selector": """select epoch_us(o_orderdate) // 1000 tp_ms, o_custkey cust, o_orderpriority priority, round(o_totalprice / 1000, 6) v from
            (select * from orders qualify row_number() over (partition by o_orderdate, o_custkey, o_orderstatus, o_orderpriority order by o_orderkey desc) = 1) where o_orderstatus = 'F'""",
        "align_interpolate_vector": f"{_EV}, l as (select tp_ms, user_id, value x from e where event_type = 'view'), r as (select tp_ms, user_id, value x from e where event_type = 'click'), {_aligned('l', 'r', 'user_id', 12 * HOUR)} select a.tp_ms, a.user_id, round(a.x + b.x, 6) v from a join b on a.tp_ms = b.tp_ms and a.user_id = b.user_id where a.x is not null and b.x is not null",
        "align_interpolate_scalar": f"{_EV}, l as (select tp_ms, max(value) x from e where event_type = 'view' group by all), r as (select tp_ms, max(value) x from e where event_type = 'error' group by all), {_aligned('l', 'r', '', 5 * 60_000)} select a.tp_ms, round(a.x - b.x, 6) v from a join b on a.tp_ms = b.tp_ms where a.x is not null and b.x is not null",
        "align_interpolate_constant": f"""{_EV}, t as (select distinct tp_ms from e), s as (select tp_ms, user_id, value x, lead(tp_ms) over w nt, lead(value) over w nx from e where event_type = 'signup' window w as (partition by user_id order by tp_ms))
            select tp_ms, user_id, round(x * 2, 6) v from s union all
            select t.tp_ms, user_id, round((x * ((nt - t.tp_ms)::double / (nt - s.tp_ms)) + nx * ((t.tp_ms - s.tp_ms)::double / (nt - s.tp_ms))) * 2, 6) from (from s where nt - tp_ms <= {HOUR}) s
              join t on t.tp_ms > s.tp_ms and t.tp_ms < s.nt where t.tp_ms <= s.tp_ms + {HOUR // 2} and t.tp_ms >= s.nt - {HOUR // 2}""",
        "join_scalar_vector": f"{_EV}, m as (select tp_ms, max(value) x from e where event_type = 'click' group by all) select tp_ms, user_id, round(x + k, 6) v from e join m using (tp_ms) where event_type = 'click'",
        "resample_grid": whole(7 * HOUR) + _at_times(12 * HOUR) + "select tp_ms, event_type, user_id, 'value' metric, round(v, 6) v from at_t where v is not null",
        "expression_grid": whole(4 * HOUR) + _at_times(8 * HOUR) + "select tp_ms, user_id, round(v + 1, 6) v from at_t where event_type = 'view' and v is not null",
        "range_edges": edge + _at_times(6 * HOUR) + f"select tp_ms, event_type, user_id, 'value' metric, round(v, 6) v from at_t where v is not null union all select tp_ms, event_type, user_id, 'value', round(value, 6) from e where tp_ms > {JAN_1 + 48 * HOUR} and tp_ms < {JAN_1 + 60 * HOUR}",
        "alert_status": alerts + "select name, tp_ms, state, '{user=' || name || '}' attributes from a",
        "alert_extend": alerts + f"select name, case when state = 'TRIGGERING' and max(tp_ms) - min(tp_ms) >= {12 * HOUR} then 'FIRING' else state end as state, min(tp_ms) since, max(tp_ms) - min(tp_ms) duration from i group by name, island, i.state",
        "rules": f"{_EV}select 'high ' || event_type as rule, count(*) alerts from e where event_type in ('view', 'error') and value > 95 group by all",
        "value_coercions": _VALUES + f"""select element_id, case value.kind when 1 then value.b when 2 then true when 3 then coalesce(value.i <> 0, value.u <> 0) when 4 then value.d <> 0 when 6 then len(value.h) > 0 end truth,
            round(case value.kind when 1 then value.b::int when 4 then value.d when 2 then value.i when 3 then coalesce(value.i::double, value.u::double) end::double, 6) number,
            case value.kind when 1 then value.b::varchar when 5 then value.s when 4 then case when isnan(value.d) then 'nan' when isinf(value.d) then if(value.d > 0, 'inf', '-inf') else printf('%.6f', value.d) end when 2 then {_INT} when 3 then {_INT} end as string from x""",
        "value_text": _VALUES + f"select element_id, case when value is not null then {pq.value('value')} end as text from x",
        "value_order": f"""with v as (select array_to_string(grp, '.') grp, array_to_string(metric, '.') metric, value, case when value.kind in (2, 3, 4) then 2 else value.kind end c,
              case value.kind when 4 then value.d when 2 then value.i when 3 then coalesce(value.i::double, value.u::double) end n, coalesce(value.i::hugeint, value.u::hugeint) w from collection_elements where value is not null),
            f as (select *, row_number() over (partition by grp, metric order by c, value.b nulls first, n nulls first, w nulls first, value.s nulls first, value.h nulls first) a,
              row_number() over (partition by grp, metric order by c desc, value.b desc nulls last, n desc nulls last, w desc nulls last, value.s desc nulls last, value.h desc nulls last) z from v)
            select grp, metric, any_value(value.kind::int) filter (a = 1) least_kind, any_value({pq.value('value')}) filter (a = 1) least, any_value(value.kind::int) filter (z = 1) greatest_kind, any_value({pq.value('value')}) filter (z = 1) greatest from f group by all""",
        "hist_stats": _HIST + """select element_id, round(min(r.lo), 6) low, round(max(r.hi), 6) high, round(coalesce(sum((r.lo / 2 + r.hi / 2) * r.cnt), 0), 6) total, round(coalesce(sum(r.cnt), 0), 6) n,
            case when sum(r.cnt) <> 0 then round(sum((r.lo / 2 + r.hi / 2) * r.cnt) / sum(r.cnt), 9) end as mean, count(r) = 0 is_empty from h left join r using (element_id) group by element_id""",
        "hist_scale": _HIST + "select element_id, r.lo, r.hi, round(r.cnt * 3, 6) cnt from r",
        "hist_divide": _HIST + "select element_id, r.lo, r.hi, round(r.cnt / 4, 6) cnt from r",
        "hist_negate": _HIST + "select element_id, r.lo, r.hi, round(-r.cnt, 6) cnt from r",
        "hist_sum": _HIST + "select element_id, r.lo, r.hi, round(r.cnt * 2, 6) cnt from r where r.cnt <> 0",
        "hist_difference": _HIST + "select element_id, r.lo, r.hi, round(r.cnt * 2, 6) cnt from r where r.cnt <> 0",
        "hist_add": _HIST + """, x as (select element_id, r.lo lo, r.hi hi, r.cnt cnt from r where r.hi > r.lo union all select element_id, 0, 1000, 10 from h),
            c as (select distinct element_id, c from (select element_id, lo c from x union all select element_id, hi from x)), g as (select element_id, c lo, lead(c) over (partition by element_id order by c) hi from c)
            select g.element_id, g.lo, g.hi, round(sum(x.cnt * (g.hi - g.lo) / (x.hi - x.lo)), 6) cnt from g join x on x.element_id = g.element_id and x.lo <= g.lo and x.hi >= g.hi group by all having sum(x.cnt * (g.hi - g.lo) / (x.hi - x.lo)) <> 0""",
        "hist_running": _HIST + "select element_id, r.lo, r.hi, round(sum(r.cnt) over (partition by element_id order by r.lo), 6) upto from r",
        "hist_text": _HIST + f"select element_id, {pq.hist('h')} as text from h",
    }
    return out
