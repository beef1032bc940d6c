"""Queries of histories, native files, the language and streams, and their SQL. What they write goes to new folders beside the checkpoints."""

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.functions import text as tx
from tsq.functions import values as va
from tsq.functions.names import ANY, TagMatcher
from tsq.operators import catalog as cat
from tsq.plans import compiler
from tsq.plans import parser as ps
from tsq.plans.timedomain import TimeRange
from tsq.sources import samples as sm
from tsq.sources import sinks
from tsq.sources.native import HistoryFiles
from tsq.sources.tables import scratch, table
from tsq.streaming import live

DAY = 86_400_000
#: The range of the pruned scan: the second of September 2025.
BEGIN = 1_756_771_200_000
SLACK = 3_600_000

Query = Callable[[SparkSession, str], DataFrame]


def _flat(s: DataFrame) -> DataFrame:
    return s.select("tp_ms", F.array_join("grp", ".").alias("grp"), tx.tags(F.col("tags")).alias("tags"), F.array_join("metric", ".").alias("metric"), tx.value(F.col("value")).alias("v"))


def _history(spark: SparkSession, d: str) -> sm.History:
    """The elements as a history directory, appended in two parts."""
    folder = scratch(spark, "history")
    e = sm.of_elements(spark, d)
    for odd in (0, 1):
        sinks.append(e.where(F.pmod("tp_ms", F.lit(2)) == odd), folder)
    return sm.History(spark, folder)


def _history_scan(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_history(spark, d).scan())


def _history_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Partitions, row groups and rows by time and path."""
    return _flat(_history(spark, d).scan(TimeRange(BEGIN, BEGIN + 4 * DAY), 0, ps.parse_path_matcher("batch.**"), ps.parse_tag_matcher("{host}"), ps.parse_path_matcher("work.done")))


def _history_times(spark: SparkSession, d: str) -> DataFrame:
    return sm.emit_time(_history(spark, d), TimeRange(BEGIN, BEGIN + DAY))


def _history_bounds(spark: SparkSession, d: str) -> DataFrame:
    return sm.time_bounds(_history(spark, d).scan())


def _history_expression(spark: SparkSession, d: str) -> DataFrame:
    r = compiler.evaluate(_history(spark, d), "batch.worker{host}::work.done * 2", slack=0)
    return r.select("tp_ms", tx.tags(F.col("tags")).alias("tags"), F.round(va.as_double(F.col("value")), 6).alias("v"))


def _native(version: str, packed: bool = False) -> Query:
    """The elements written in a version of the native format, one file a day or less, and read back."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        spark.dataSource.register(HistoryFiles)
        folder = scratch(spark, "native")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # of a series' values at one time the greatest element_id counts, as in of_elements; the writer sees to that
        e = sm.by_time(sm.elements(spark, d), table(spark, d, "collection_elements").select("tp_ms"), parts)
        sm.with_lists(e).write.format("history").mode("append").option("version", version).option("packed", str(packed).lower()).option("latest", "element_id").save(folder)
        return _flat(spark.read.format("history").load(folder))

    return run


def _native_range(spark: SparkSession, d: str) -> DataFrame:
    """Files and scrapes by time, of the tables version."""
    spark.dataSource.register(HistoryFiles)
    folder = scratch(spark, "native")
    # a task holds its rows, so their number follows the session's
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sm.of_elements(spark, d).repartitionByRange(parts, "tp_ms").write.format("history").mode("append").option("version", "2t").save(folder)
    return _flat(spark.read.format("history").option("begin", str(BEGIN)).option("end", str(BEGIN + 4 * DAY)).load(folder))


def _constant(spark: SparkSession, d: str) -> DataFrame:
    """An expression without a selector: its value at every scrape time."""
    r = compiler.evaluate(sm.wide_events(spark, d), "(1 << 2) * 10 + 1 * ----2")
    return r.select("tp_ms", F.round(va.as_double(F.col("value")), 6).alias("v"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.lines(sm.of_events(spark, d))


def _sorted(spark: SparkSession, d: str) -> DataFrame:
    return _flat(cat.sorted_by_time(sm.of_elements(spark, d)))


def _flattened(spark: SparkSession, d: str) -> DataFrame:
    return _flat(sm.flatten(sm.scrapes(sm.of_elements(spark, d))))


def _printed_back(spark: SparkSession, d: str) -> DataFrame:
    """An expression, its text, and the tree of that text, evaluated: the text is what is parsed here."""
    e = ps.parse("-app.view{user>=42}::props.k * 2 + by (user) keep left app.view::value / (4 - 2)")
    r = compiler.evaluate(sm.wide_events(spark, d), ps.to_text(ps.parse(ps.to_text(e))), slack=0)
    return r.select("tp_ms", F.round(va.as_double(F.col("value")), 6).alias("v"))


#: Matchers and paths, and matchers that overlap or don't.
PATHS = ["foo", "foo.bar", "foo.barium", "foo.bar.baz", "foo.baz", "foo.x.bar.baz", "baz"]
MATCHERS = ["foo.bar", "foo.*", "foo.**", "foo.**.baz", "foo.**.bar.baz", "foo.**.*.baz", "*.**.*", "**"]


def _path_cases(spark: SparkSession, d: str) -> DataFrame:
    """Which matcher matches which path."""
    paths = spark.createDataFrame([(p.split("."),) for p in PATHS], "path array<string>")
    tests = F.array(*[F.struct(F.lit(m).alias("matcher"), ps.parse_path_matcher(m).column(F.col("path")).alias("matches")) for m in MATCHERS])
    return paths.select(F.array_join("path", ".").alias("path"), F.inline(tests))


def _path_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Whether some path matches both."""
    rows = [(a, b, ps.parse_path_matcher(a).overlaps(ps.parse_path_matcher(b))) for a in MATCHERS for b in MATCHERS]
    return spark.createDataFrame(rows, "a string, b string, meet boolean")


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    """Matchers in their normal form."""
    return spark.createDataFrame([(m, ps.path_text(ps.parse_path_matcher(m))) for m in ("a.**.*.b", "**.**", "**.*.**", "a.*")], "matcher string, normal string")


TAG_TESTS = ["{x}", "{!x}", "{x=1}", "{x!=1}", "{x<1}", "{x>=1}", '{x="a"}', '{x!="a"}']


def _tag_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = [(a, b, ps.parse_tag_matcher(a).overlaps(ps.parse_tag_matcher(b))) for a in TAG_TESTS for b in TAG_TESTS]
    return spark.createDataFrame(rows, "a string, b string, meet boolean")


def _tag_satisfied(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of tests that some reading's tags satisfy together, and whether they were said to overlap: of hosts, as texts."""
    tests = ["{host}", "{!host}", '{host="nosuch"}', '{host!="nosuch"}']
    e = table(spark, d, "collection_elements").select("tags")
    both = [F.bool_or(ps.parse_tag_matcher(a).column(F.col("tags")) & ps.parse_tag_matcher(b).column(F.col("tags"))) for a in tests for b in tests]
    said = [ps.parse_tag_matcher(a).overlaps(ps.parse_tag_matcher(b)) for a in tests for b in tests]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), x.alias("found"), F.lit(s).alias("meet")) for (a, b), x, s in zip([(a, b) for a in tests for b in tests], both, said)])
    return e.agg(rows.alias("r")).select(F.inline("r"))


#: Literals and their kinds.
LITERALS = {"42": 3, "-42": 2, "0.0": 4, "1e4": 4, "true": 1, '"a b"': 5, "[]": 6, "[0..1=1, 3..4=5]": 6}


def _literals(spark: SparkSession, d: str) -> DataFrame:
    """Literals as values, and these as texts that read back."""
    one = spark.range(1)
    value = lambda t: va.literal(list(v) if isinstance(v := ps.parse_value(t), tuple) else v)
    rows = F.array(*[F.struct(F.lit(t).alias("literal"), value(t)["kind"].cast("int").alias("kind"), tx.value(value(t)).alias("text")) for t in LITERALS])
    return one.select(F.inline(rows))


def _collectors(spark: SparkSession, d: str) -> DataFrame:
    """What the collector of this process reports, and whether a plan for a path would include it."""
    c = live.SelfCollector()
    rows = sorted({".".join(r[1]) for r in c.collect(1)})
    here = [(n, live.intersects(c, ps.parse_path_matcher(f"process.{n.split('.')[1]}.**")), live.intersects(c, ps.parse_path_matcher("other.**"))) for n in rows if n.startswith("process.cpu")]
    return spark.createDataFrame(here, "name string, included boolean, other boolean")


def _equal(spark: SparkSession, d: str) -> DataFrame:
    """Strict equality of each value, of all kinds, with some values of each kind, histograms among them."""
    h = [(0.0, 5.0, 1.0)]
    v = table(spark, d, "collection_elements").where("element_id is not null and value is not null").select("element_id", "value").distinct()
    others = {"empty": None, "text": "timeout", "one": 1, "truth": True, "double": 1.0, "histogram": h}
    cols = [va.strictly_equal(F.col("value"), va.literal(x)).alias(n) for n, x in others.items()]
    return v.select("element_id", *cols)


# --- streams ---


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if os.path.isdir(path.removeprefix("file://")) else reader.option("pathGlobFilter", Path(path).name).parquet(d)


def _ran(stream: DataFrame, mode: str, **sink) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession, "stream")).trigger(availableNow=True)
    q = q.foreachBatch(sink["each"]).start() if "each" in sink else q.format("parquet").option("path", sink["path"]).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _live_events(spark: SparkSession, d: str) -> DataFrame:
    return sm.wide_of(_stream(spark, d, "events")).samples()


def _stream_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of a finished stream: what the watermark has passed, once; given to two sinks."""
    first, second = scratch(spark, "facts"), scratch(spark, "facts")
    sink = sinks.fan_out([lambda b: sinks.append(b, first), lambda b: sinks.append(b, second)])
    _ran(live.facts(_live_events(spark, d), SLACK), "append", each=sink)
    both = sm.merge_combine([sm.read(spark, first), sm.read(spark, second)])
    return both.select("tp_ms", F.array_join("grp", ".").alias("grp"), tx.tags(F.col("tags")).alias("tags"), F.array_join("metric", ".").alias("metric"), F.round(va.as_double(F.col("value")), 6).alias("v"))


def _stream_updates(spark: SparkSession, d: str) -> DataFrame:
    """The speculative view of a stream: every change at once, the last one counting."""
    folder = scratch(spark, "updates")
    _ran(live.facts(_live_events(spark, d), SLACK), "update", each=lambda b, n: live.upsert(b, n, folder))
    v = live.current(spark, folder)
    return v.select("tp_ms", F.array_join("grp", ".").alias("grp"), tx.tags(F.col("tags")).alias("tags"), F.array_join("metric", ".").alias("metric"), F.round(va.as_double(F.col("value")), 6).alias("v"))


def _stream_filter(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark, "filter")
    _ran(live.selected(_live_events(spark, d), ps.parse_path_matcher("app.error"), ps.parse_tag_matcher("{user>=42}"), ps.parse_path_matcher("value")), "append", path=folder)
    s = spark.read.parquet(folder)
    return s.select("tp_ms", tx.tags(F.col("tags")).alias("tags"), F.round(va.as_double(F.col("value")), 6).alias("v"))


def _stream_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Two streams joined on equal times and tags."""
    folder = scratch(spark, "aligned")
    side = lambda m: live.selected(_live_events(spark, d), ps.parse_path_matcher("app.error"), TagMatcher(), ps.parse_path_matcher(m)).select("tp_ms", "tags", "value")
    _ran(live.aligned(side("value"), side("props.k"), va.add, SLACK), "append", path=folder)
    return spark.read.parquet(folder).select("tp_ms", tx.tags(F.col("tags")).alias("tags"), F.round(va.as_double(F.col("value")), 6).alias("v"))


def _stream_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two streams whose times differ, joined by tags with interpolation."""
    folder = scratch(spark, "merged")
    side = lambda e: live.selected(_live_events(spark, d), ps.parse_path_matcher(f"app.{e}"), TagMatcher(), ps.parse_path_matcher("value")).select("tp_ms", "tags", "value")
    _ran(live.merged(side("view"), side("click"), va.add, 12 * SLACK), "append", path=folder)
    return spark.read.parquet(folder).select("tp_ms", tx.tags(F.col("tags")).alias("tags"), F.round(va.as_double(F.col("value")), 6).alias("v"))


def queries() -> dict[str, Query]:
    return {
        "history_scan": _history_scan, "history_pruned": _history_pruned, "history_times": _history_times, "history_bounds": _history_bounds, "history_expression": _history_expression,
        "native_0": _native("0"), "native_1": _native("1", True), "native_2_list": _native("2"), "native_2_tables": _native("2t", True), "native_range": _native_range,
        "constant": _constant, "print_lines": _lines, "sorted_by_time": _sorted, "flatten_scrapes": _flattened, "expression_text": _printed_back,
        "path_cases": _path_cases, "path_overlaps": _path_overlaps, "path_normalised": _normalised, "tag_overlaps": _tag_overlaps, "tag_satisfied": _tag_satisfied,
        "literals": _literals, "collectors": _collectors, "value_equal": _equal,
        "stream_facts": _stream_facts, "stream_updates": _stream_updates, "stream_filter": _stream_filter, "stream_aligned": _stream_aligned, "stream_merged": _stream_merged,
    }


def real(d: str) -> str:
    """SQL of a double's text. The tables have no numbers that would need an exponent."""
    return f"case when isnan({d}) then 'nan' when isinf({d}) then if({d} > 0, 'Infinity', '-Infinity') when {d} = round({d}) and abs({d}) < 1e15 then printf('%.1f', {d}) else {d}::varchar end"


def short(d: str) -> str:
    """The same in a histogram, where whole numbers have no decimals."""
    return f"case when {d} = round({d}) and abs({d}) < 1e15 then printf('%.0f', {d}) else {d}::varchar end"


def hist(h: str) -> str:
    return f"case when len({h}) = 0 then '[]' else '[ ' || array_to_string(list_transform({h}, lambda r: {short('r.lo')} || '..' || {short('r.hi')} || '=' || {short('r.cnt')}), ', ') || ' ]' end"


def value(v: str) -> str:
    """SQL of a value's text; the texts in the tables need no escapes."""
    return f"case {v}.kind when 0 then '(none)' when 1 then {v}.b::varchar when 4 then {real(v + '.d')} when 5 then '\"' || {v}.s || '\"' when 6 then {hist(v + '.h')} else coalesce({v}.i::varchar, {v}.u::varchar) end"


_TAGS = f"'{{' || array_to_string(list_transform(coalesce(tags, []), lambda t: t.k || '=' || {value('t.v')}), ', ') || '}}'"
_SAMPLES = f"""with s as (select *, row_number() over (partition by tp_ms, grp, coalesce(tags, []), metric order by element_id desc) rn from collection_elements where tp_ms is not null and grp is not null and metric is not null and value is not null),
f as (select tp_ms, array_to_string(grp, '.') grp, {_TAGS} tags, array_to_string(metric, '.') metric, {value('value')} v, value from s where rn = 1)
"""
_ALL = _SAMPLES + "select tp_ms, grp, tags, metric, v from f"
_EV = "with e as (select epoch_us(ts) // 1000 tp_ms, 'app.' || event_type grp, '{user=' || user_id || '}' tags, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) k from events)\n"
_EVENT_ROWS = "(select tp_ms, grp, tags, 'value' metric, round(value, 6) v from e where value is not null union all select tp_ms, grp, tags, 'props.k', k::double from e where k is not null)"


def _listed(rows, *columns: str) -> str:
    lit = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(columns)})"


#: Which of MATCHERS match each of PATHS, said anew as SQL patterns; and those that overlap, by hand.
_PATTERNS = {"foo.bar": "foo\\.bar", "foo.*": "foo\\.[^.]+", "foo.**": "foo(\\.[^.]+)*", "foo.**.baz": "foo(\\.[^.]+)*\\.baz", "foo.**.bar.baz": "foo(\\.[^.]+)*\\.bar\\.baz", "foo.**.*.baz": "foo(\\.[^.]+)+\\.baz", "*.**.*": "[^.]+(\\.[^.]+)+", "**": ".*"}
_APART = [("foo.bar", m) for m in ("foo.**.baz", "foo.**.bar.baz", "foo.**.*.baz")] + [("foo.*", m) for m in ("foo.**.bar.baz", "foo.**.*.baz")]
_TAG_APART = [
    ("{x}", "{!x}"), ("{!x}", "{x=1}"), ("{!x}", "{x!=1}"), ("{!x}", "{x<1}"), ("{!x}", "{x>=1}"), ("{!x}", '{x="a"}'), ("{!x}", '{x!="a"}'),
    ("{x=1}", "{x!=1}"), ("{x=1}", "{x<1}"), ("{x<1}", "{x>=1}"), ('{x="a"}', '{x!="a"}'),
    *[(n, t) for n in ("{x=1}", "{x!=1}", "{x<1}", "{x>=1}") for t in ('{x="a"}', '{x!="a"}')],
]


def _at(x: str) -> str:
    w = "over (partition by tags order by tp_ms range between"
    p, n = (f"{f}(case when {x} is not null then {{'t': tp_ms, 'v': {x}}} end ignore nulls) {w} {r})" for f, r in (("last_value", f"{12 * SLACK} preceding and 1 preceding"), ("first_value", f"1 following and {12 * SLACK} following")))
    return f"{x} here_{x}, {p} p_{x}, {n} n_{x}"


_BETWEEN = "coalesce(here_{x}, p_{x}.v * ((n_{x}.t - tp_ms)::double / (n_{x}.t - p_{x}.t)) + n_{x}.v * ((tp_ms - p_{x}.t)::double / (n_{x}.t - p_{x}.t)))"
_MERGED = f""", u as (select tags, tp_ms, max(value) filter (event_type = 'view') xl, max(value) filter (event_type = 'click') xr from e where event_type in ('view', 'click') group by all),
a as (select tags, tp_ms, {_at('xl')}, {_at('xr')} from u), b as (select tags, tp_ms, {_BETWEEN.format(x='xl')} x, {_BETWEEN.format(x='xr')} y from a)"""


def oracle_sql() -> dict[str, str]:
    apart = lambda pairs, a, b: (a, b) in pairs or (b, a) in pairs
    out = dict.fromkeys(("history_scan", "sorted_by_time", "flatten_scrapes"), _ALL)
    # native files hold whole numbers of 64 bits with a sign; those beyond are doubles there
    out |= dict.fromkeys(("native_0", "native_1", "native_2_list", "native_2_tables"), _SAMPLES + r"select tp_ms, grp, tags, metric, case when value.kind = 3 and value.i is null and value.u >= 9223372036854775808 then regexp_replace(value.u::double::varchar, 'e\+?', 'E') else v end v from f")
    line = f"strftime(make_timestamp(tp_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((tp_ms % 1000)::varchar, 3, '0') || 'Z ' || grp || tags || '::' || metric || ' = ' || v"
    rows = f"(select tp_ms, grp, tags, 'value' metric, {real('value')} v from e where value is not null union all select tp_ms, grp, tags, 'props.k', k::varchar from e where k is not null)"
    return out | {
        "history_pruned": _ALL + f" where tp_ms between {BEGIN} and {BEGIN + 4 * DAY} and (grp = 'batch' or starts_with(grp, 'batch.')) and metric = 'work.done' and (contains(tags, '{{host=') or contains(tags, ', host='))",
        "history_times": _SAMPLES + f"select distinct tp_ms from f where tp_ms between {BEGIN} and {BEGIN + DAY}",
        "history_bounds": _SAMPLES + 'select min(tp_ms) as "first", max(tp_ms) as "last" from f',
        "history_expression": _SAMPLES + "select tp_ms, tags, round(2 * case value.kind when 1 then value.b::int::double when 4 then value.d when 2 then value.i::double when 3 then coalesce(value.i::double, value.u::double) end, 6) v from f where grp = 'batch.worker' and metric = 'work.done' and (contains(tags, '{host=') or contains(tags, ', host='))",
        "native_range": _ALL + f" where tp_ms between {BEGIN} and {BEGIN + 4 * DAY}",
        "constant": _EV + "select distinct tp_ms, 42.0::double v from e",
        "print_lines": _EV + f"select tp_ms, {line} as line from {rows}",
        "expression_text": _EV + "select tp_ms, round(-k * 2 + value / 2, 6) v from e where event_type = 'view' and user_id >= 42 and k is not null and value is not null",
        "path_cases": "select p.path, m.matcher, regexp_full_match(p.path, m.pattern) as matches from (" + _listed([(p,) for p in PATHS], "path") + ") p, (" + _listed(list(_PATTERNS.items()), "matcher", "pattern") + ") m",
        "path_overlaps": _listed([(a, b, not apart(_APART, a, b)) for a in MATCHERS for b in MATCHERS], "a", "b", "meet"),
        "path_normalised": _listed([("a.**.*.b", "a.*.**.b"), ("**.**", "**"), ("**.*.**", "*.**"), ("a.*", "a.*")], "matcher", "normal"),
        "tag_overlaps": _listed([(a, b, not apart(_TAG_APART, a, b)) for a in TAG_TESTS for b in TAG_TESTS], "a", "b", "meet"),
        "literals": _listed([("42", 3, "42"), ("-42", 2, "-42"), ("0.0", 4, "0.0"), ("1e4", 4, "10000.0"), ("true", 1, "true"), ('"a b"', 5, '"a b"'), ("[]", 6, "[]"), ("[0..1=1, 3..4=5]", 6, "[ 0..1=1, 3..4=5 ]")], "literal", "kind", "text"),
        "tag_satisfied": "with e as (select tags is not null and len(list_filter(tags, lambda t: t.k = 'host')) > 0 h from collection_elements), t(a) as (values ('{host}'), ('{!host}'), ('{host=\"nosuch\"}'), ('{host!=\"nosuch\"}')) "
            "select x.a, y.a b, case when x.a = '{!host}' and y.a = '{!host}' then (select bool_or(not h) from e) when '{!host}' in (x.a, y.a) or '{host=\"nosuch\"}' in (x.a, y.a) then false else (select bool_or(h) from e) end as found, "
            "case when x.a = y.a then true when '{!host}' in (x.a, y.a) then false else not ('{host=\"nosuch\"}' in (x.a, y.a) and '{host!=\"nosuch\"}' in (x.a, y.a)) end as meet from t x, t y",
        "collectors": _listed([("process.cpu.system", True, True), ("process.cpu.user", True, True)], "name", "included", "other"),
        "value_equal": """with x as (select distinct element_id, value from collection_elements where element_id is not null and value is not null),
            n as (select *, case value.kind when 4 then value.d when 2 then value.i::double when 3 then coalesce(value.i::double, value.u::double) end n from x)
            select element_id, value.kind = 0 as "empty", coalesce(value.kind = 5 and value.s = 'timeout', false) as "text", coalesce(n = 1, false) as one, coalesce(value.kind = 1 and value.b, false) as truth, coalesce(n = 1, false) as "double",
              coalesce(value.kind = 6 and value.h = [{'lo': 0.0::double, 'hi': 5.0::double, 'cnt': 1.0::double}], false) as histogram from n""",
        "stream_facts": _EV + f"select * from {_EVENT_ROWS} where tp_ms < (select max(tp_ms) from e) - {SLACK} or tp_ms = (select max(tp_ms) from e) - {SLACK}",
        "stream_updates": _EV + f"select * from {_EVENT_ROWS}",
        "stream_filter": _EV + "select tp_ms, tags, round(value, 6) v from e where event_type = 'error' and user_id >= 42 and value is not null",
        "stream_merged": _EV + f"""{_MERGED} select tp_ms, tags, round(x + y, 6) v from b where x is not null and y is not null and tp_ms < (select max(tp_ms) from u) - {24 * SLACK}""",
        "stream_aligned": _EV + "select tp_ms, tags, round(value + k, 6) v from e where event_type = 'error' and value is not null and k is not null",
    }
