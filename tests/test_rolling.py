import random
from pathlib import Path

from pyspark.sql import functions as F

from tsq.operators.rolling import DAY_MS, corrected, daily, rolling_totals, store, stored, trailing, tree

SCHEMA = "host string, tp_ms bigint, v double, element_id bigint, day string, total string"


def brute(rows):
    seen, days = {}, {}
    for h, t, v, e, *_ in rows:
        if None not in (h, t, v, e) and v == v:
            seen[e] = (h, t // DAY_MS, v)
    for h, d, v in seen.values():
        days.setdefault(h, {}).setdefault(d, []).append(v)
    out = {}
    for h, ds in days.items():
        for d in range(min(ds), max(ds) + 1):
            per = []
            for p in (7, 30):
                xs = [v for k in range(d - p + 1, d + 1) for v in ds.get(k, [])]
                per += [round(sum(xs), 6), len(xs), round(sum(xs) / len(xs), 6) if xs else None]
            out[h, d] = (len(ds.get(d, [])), *per)
    return out


def collect(df):
    r = lambda x: None if x is None else round(x, 6)
    return {(x.entity, x.day): (x.n_day, r(x.total_7), x.n_7, r(x.avg_7), r(x.total_30), x.n_30, r(x.avg_30)) for x in df.collect()}


def make():
    rnd = random.Random(5)
    rows = [(h, rnd.randint(-40, 80) * DAY_MS + rnd.randint(0, DAY_MS - 1), rnd.randint(0, 90) / 8, i, "x", "y") for i in range(160) for h in ("a" if i % 3 else "b",)]
    return rows + rows[:30] + [(None, 5, 1.0, 900, "", ""), ("a", None, 1.0, 901, "", ""), ("a", 5, None, 902, "", ""), ("a", 5, float("nan"), 903, "", ""), ("z", 5, 0.0, 904, "", "")]


def test_matches_brute_force(spark):
    rows = make()
    assert collect(rolling_totals(spark.createDataFrame(rows, SCHEMA), "host")) == brute(rows)


def test_zero_is_activity_and_one_day_is_a_series(spark):
    r = rolling_totals(spark.createDataFrame([("z", 5, 0.0, 1, "", "")], SCHEMA), "host").collect()
    assert [(x.n_day, x.total_7, x.n_30, x.avg_30) for x in r] == [(1, 0.0, 1, 0.0)]


def test_late_corrections_touch_only_ancestors(spark, tmp_path):
    rows = make()
    early, late = spark.createDataFrame(rows[:120], SCHEMA), spark.createDataFrame([r for r in rows[120:] if r[3] >= 120], SCHEMA)
    days = daily(spark.createDataFrame(rows, SCHEMA), "host")
    key = ["entity", "level", "node", "n", F.round("total", 6).alias("total")]
    want = sorted(tree(days).select(*key).collect())
    assert sorted(corrected(tree(daily(early, "host")), daily(late, "host")).select(*key).collect()) == want
    # stored: what the correction writes are the ancestors of its days, in the shards of these
    d = str(tmp_path / "trees")
    store(tree(daily(early, "host")), d)
    before = {f.name for f in Path(d).rglob("*.parquet")}
    store(tree(daily(late, "host")), d)
    new = [str(f) for f in Path(d).rglob("*.parquet") if f.name not in before]
    written = {(r.entity, r.level, r.node) for r in spark.read.parquet(*new).collect()}
    assert written == {(r.entity, k, r.day >> k) for r in daily(late, "host").collect() for k in range(6)}
    assert sorted(stored(spark, d).select(*key).collect()) == want
    part = stored(spark, d, 0, 31)
    assert "PartitionFilters: [isnotnull(shard" in part._jdf.queryExecution().executedPlan().toString()
    assert {r.node >> (5 - r.level) for r in part.collect()} == {0}
    assert collect(trailing(days, stored(spark, d))) == collect(trailing(days, tree(days)))


def test_one_wrong_date_makes_its_days_in_many_tasks(spark):
    rows = [("z", 0, 1.0, 1, "", ""), ("z", 400_000 * DAY_MS, 1.0, 2, "", "")]
    r = rolling_totals(spark.createDataFrame(rows, SCHEMA), "host")
    assert r.count() == 400_001 and r.where("n_30 > 0").count() == 31


def test_empty(spark):
    assert rolling_totals(spark.createDataFrame([], SCHEMA), "host").count() == 0
