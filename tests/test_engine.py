import pytest
from pyspark.sql import functions as F

from tsq.functions import values as va
from tsq.plans import compiler
from tsq.plans import parser as ps
from tsq.plans.timedomain import TimeRange, between
from tsq.schema import SAMPLES_DDL, TAGS_DDL
from tsq.sources import samples as sm
from tsq.sources import sinks

X5 = [("x", (3, None, 5, None, None, None, None))]


def mv(v):
    return (3 if isinstance(v, int) else 4, None, v if isinstance(v, int) else None, None, v if isinstance(v, float) else None, None, None)


def vector(spark, rows):
    return spark.createDataFrame([(t, X5, mv(v)) for t, v in rows], f"tp_ms bigint, tags {TAGS_DDL}, value struct<kind:tinyint,b:boolean,i:bigint,u:decimal(20,0),d:double,s:string,h:array<struct<lo:double,hi:double,cnt:double>>>")


def scalar(spark, rows):
    return vector(spark, rows).drop("tags")


CASES = [([], [], []), ([(1000, 17)], [(1000, 17)], [(1000, 34.0)]), ([(1000, 16), (3000, 18)], [(2000, 17)], [(2000, 34.0)]), ([(2000, 17)], [(1000, 16), (3000, 18)], [(2000, 34.0)])]


@pytest.mark.parametrize("kinds", ["ss", "sv", "vs", "vv"])
@pytest.mark.parametrize("left, right, want", CASES)
def test_merger(spark, kinds, left, right, want):
    ins = [(scalar if k == "s" else vector)(spark, r) for k, r in zip(kinds, (left, right))]
    merge = compiler.merge_scalars if kinds == "ss" else compiler.merge_vectors
    r = merge(lambda v: va.add(v[0], v[1]), ins, 5000)
    assert ("tags" in r.columns) is (kinds != "ss")
    assert [(x.tp_ms, x.n) for x in r.select("tp_ms", va.as_double(F.col("value")).alias("n")).collect()] == want


@pytest.mark.parametrize("gap, times", [(10, 9), (11, 9), (20, 1), (21, 0)])
def test_slack_is_inclusive(spark, gap, times):
    s = scalar(spark, [(0, 0), (gap, gap)])
    got = {r.tp_ms for r in between(s, [], spark.range(-5, 40).withColumnRenamed("id", "tp_ms"), 10).collect()}
    assert got == {t for t in range(1, gap) if t >= gap - 10 and t <= 10}


def samples(spark, rows):
    return spark.createDataFrame([(t, g.split("."), [(k, mv(v)) for k, v in sorted(tags.items())], m.split("."), mv(v)) for t, g, tags, m, v in rows], SAMPLES_DDL)


def values(df):
    return sorted((r.tp_ms, tuple((t.k, t.v.i) for t in r.tags), None if r.value.kind == 0 else r.n) for r in df.withColumn("n", va.as_double(F.col("value"))).collect())


def test_constants_at_every_scrape(spark):
    s = samples(spark, [(t, "g", {}, "m", 1) for t in (10_000, 20_000, 30_000)])
    r = compiler.evaluate(s, "(1 << 2) * 10 + 1 * ----2", slack=10_000)
    assert sorted((x.tp_ms, x.value.i) for x in r.collect()) == [(10_000, 42), (20_000, 42), (30_000, 42)]
    assert compiler.is_scalar("1 + 2") and not compiler.is_scalar("1 + a::b")


def test_match_clauses_and_collisions(spark):
    s = samples(spark, [(1, "a", {"h": 1, "d": 1}, "m", 10), (1, "a", {"h": 1, "d": 2}, "m", 20), (1, "a", {"h": 2}, "m", 30), (1, "b", {"h": 1}, "m", 5), (1, "b", {"d": 7}, "m", 6)])
    run = lambda t: values(compiler.evaluate(s, t, slack=0))
    assert run("a::m + b::m") == []
    assert run("a::m + by(h) b::m") == [(1, (("h", 1),), 15.0)]
    assert run("a::m + by(h) keep left b::m") == [(1, (("d", 1), ("h", 1)), 15.0)]
    assert run("a::m + by(h) keep right b::m") == [(1, (("h", 1),), 15.0)]
    assert run("a::m + without(d) b::m") == [(1, (("h", 1),), 15.0)]
    # the inner results fall on one key of the outer clause: empty, and empty plus a number is empty
    assert run("(a::m + 1) + by(h) b::m") == [(1, (("h", 1),), None)]
    assert run("(a::m + a::m) + by(h) b::m") == [(1, (("h", 1),), None)]


def test_grid_edges_and_exact_values(spark):
    s = samples(spark, [(0, "g", {}, "m", 0), (10, "g", {}, "m", 10), (100, "g", {}, "m", 100)])
    got = lambda t, slack: sorted((r.tp_ms, r.n) for r in sm.emit(s, t, slack=slack).withColumn("n", va.as_double(F.col("value"))).collect())
    assert got(TimeRange(0, 14, 4), 10) == [(0, 0.0), (4, 4.0), (8, 8.0)]
    assert got(TimeRange(5, 50), 60) == [(5, 5.0), (10, 10.0), (50, 50.0)]
    assert got(TimeRange(5, 10), 0) == [(10, 10.0)] and got(TimeRange(), 5) == [(0, 0.0), (10, 10.0), (100, 100.0)]
    with pytest.raises(ValueError):
        TimeRange(5, 4)


def test_empty_source_and_history_directory(spark, tmp_path):
    none = sm.nothing(spark)
    assert compiler.evaluate(none, "a::b + 1").count() == 0 and sm.time_bounds(none).first().first is None
    s = samples(spark, [(1, "g.h", {"x": 1}, "m", 2.5), (86_400_001, "g.h", {}, "n", 3)])
    sinks.append(s, str(tmp_path / "h"))
    sinks.append(s.limit(0), str(tmp_path / "h"))
    back = sm.read(spark, str(tmp_path / "h"))
    assert s.exceptAll(back).count() == 0 and back.count() == 2
    lines = []
    sinks.printed(back, out=lines.append)
    assert lines == ["1970-01-01T00:00:00.001Z g.h{x=1}::m = 2.5", "1970-01-02T00:00:00.001Z g.h::n = 3"]


def test_selectors_reach_the_scan(spark, data, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(compiler.evaluate(sm.wide_events(spark, data), "app.view{user>=42}::value", slack=0))
    assert "EqualTo(event_type,view)" in p and "GreaterThanOrEqual(user_id,42)" in p and "props" not in p and "Generate" not in p
    one = plan(compiler.evaluate(sm.wide_lineitem(spark, data), "lineitem::price", slack=0))
    assert "l_extendedprice" in one and "l_tax" not in one and "Generate" not in one
    sinks.append(sm.of_events(spark, data), str(tmp_path / "h"))
    h = sm.History(spark, str(tmp_path / "h"))
    p = plan(h.scan(TimeRange(1_704_153_600_000, 1_704_240_000_000), 0, ps.parse_path_matcher("app.view"), metric=ps.parse_path_matcher("props.**")))
    assert "PartitionFilters: [isnotnull(date" in p and "EqualTo(grp_key" in p and "StringStartsWith(metric_key" in p
    times = plan(sm.emit_time(h))
    assert "value" not in times[times.index("ReadSchema") :].split("\n")[0]


def test_llm_is_optional_and_whole_library_imports():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tsq.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p7_ids' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("text", ["a::m * 2 + 1", "a::m + by(h) b::m", "-a::m < b::m"])
def test_parsed_trees_and_text_evaluate_alike(spark, text):
    s = samples(spark, [(t, g, {"h": t % 2}, "m", t) for t in range(6) for g in ("a", "b")])
    assert values(compiler.evaluate(s, text, slack=2)) == values(compiler.evaluate(s, ps.to_text(ps.parse(text)), slack=2))


def _most_rows(df):
    """The most rows that a step of the plan that ran puts out."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
        n = p.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    return most


def test_aligned_sides_meet_before_they_are_filled_with_times(spark):
    """100 series a side with a value at all of 4000 times; two of them meet, for a tenth of the time."""
    end, rows = 4_000_000, []
    for i in range(100):
        rows += [(t, "g.l", {"x": i}, "m", float(t)) for t in (0, end)]
        rows += [(t, "g.r", {"x": i + 99}, "m", 2.0 * t) for t in ((0, end) if i else (0, end // 10))]
    rows += [(t, "g.l", {"x": -1}, "m", 1) for t in range(0, end, 1000)]
    df = compiler.evaluate(samples(spark, rows), "g.l::m + g.r::m", slack=end)
    got = df.select("tp_ms", F.col("tags")[0]["v"]["i"].alias("x"), va.as_double(F.col("value")).alias("v"))
    rows = got.collect()
    assert sorted((r.tp_ms, r.x, r.v) for r in rows) == [(t, 99, 3.0 * t) for t in range(0, end // 10 + 1, 1000)]
    assert _most_rows(got) < 40_000


def test_aligned_sides_of_all_kinds_match_brute_force(spark):
    """Also under clauses by which several series of a side meet one of the other, and of values that can't be interpolated."""
    import random

    from tsq.plans.timedomain import align

    r, slack = random.Random(5), 50
    kinds = [lambda: (3, None, r.randrange(99), None, None, None, None), lambda: (4, None, None, None, r.random(), None, None), lambda: (5, None, None, None, None, r.choice("ab"), None), lambda: (1, r.random() < 0.5, None, None, None, None, None), lambda: (0, *[None] * 6), lambda: (6, None, None, None, None, None, [(0.0, 1.0, r.random())])]
    rows = []
    for g in ("l", "r"):
        for x in range(3):
            for y in range(2):
                for t in r.sample(range(-300, 300), 25):
                    rows.append((t, [g], [(k, (3, None, v, None, None, None, None)) for k, v in (("x", x), ("y", y))], ["m"], r.choice(kinds[: 2 if r.random() < 0.7 else 6])()))
    s = spark.createDataFrame(rows, SAMPLES_DDL).cache()
    side = {g: s.where(F.col("grp")[0] == g).select("tp_ms", "tags", "value") for g in ("l", "r")}
    times = s.select("tp_ms").distinct()
    l, q = (align(side[g], ["tags"], times, slack, all_times=True) for g in ("l", "r"))
    for op, f in (("+", va.add), ("-", va.subtract), ("*", va.multiply), ("/", va.divide), ("=", va.equal)):
        want = l.alias("l").join(q.alias("r"), (F.col("l.tp_ms") == F.col("r.tp_ms")) & (F.col("l.tags") == F.col("r.tags"))).select("l.tp_ms", "l.tags", f(F.col("l.value"), F.col("r.value")).alias("value"))
        got = compiler.evaluate(s, f"l::m {op} r::m", slack=slack)
        key = lambda df: sorted(str(tuple(x)) for x in df.collect())
        assert key(got.select("tp_ms", "tags", "value")) == key(want) and want.count() > 300
