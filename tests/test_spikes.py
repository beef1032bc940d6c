import random
import statistics

import pytest

from tsq.operators import spikes
from tsq.operators.spikes import implausible

SCHEMA = "element_id bigint, host string, metric string, tp_ms bigint, v double, nature string, lo double, hi double, interval_ms bigint, shard string, own string"
MIN = 60_000


def flagged(spark, rows):
    return {r.element_id: r.reason for r in implausible(spark.createDataFrame(rows, SCHEMA)).collect()}


def series(values, host="h", nature="gauge", lo=None, hi=None, start=0, first=0, gaps=()):
    out, t = [], start
    for i, v in enumerate(values):
        t += MIN * (10 if i in gaps else 1)
        out.append((first + i, host, "m", t, v, nature, lo, hi, MIN, "x", "y"))
    return out


def noise(n, seed=1, base=50.0, s=1.0):
    r = random.Random(seed)
    return [base + r.gauss(0, s) for _ in range(n)]


def test_short_spikes_that_come_back(spark):
    rows, want = [], {}
    for k, (at, size) in enumerate((at, size) for at in (1, 100, 1022, 1023, 1024, 1498) for size in (1, 2, 3) if at + size < 1500):
        v = noise(1500)
        for i in range(size):
            v[at + i] += 40 if i % 2 == 0 else 55
            want[k * 10_000 + at + i] = "spike"
        rows += series(v, f"h{k}", first=k * 10_000)
    assert flagged(spark, rows) == want


def test_shifts_surges_and_slow_movements_are_no_cases(spark):
    shift = noise(200) + noise(200, 2, base=90)
    surge = noise(200, 3) + noise(4, 4, base=95) + noise(200, 5)
    slow = [x + i / 4 for i, x in enumerate(noise(400, 6))]
    assert flagged(spark, series(shift, "a") + series(surge, "b", first=1000) + series(slow, "c", first=2000)) == {}


def test_a_silence_starts_the_course_anew(spark):
    # the last readings before a silence don't come back, nor do the first ones after it leave anything
    v = noise(100) + [150.0, 151.0] + noise(100, 2)
    assert flagged(spark, series(v, gaps={102})) == {}


def test_levels_step_but_don_t_leap(spark):
    r = random.Random(9)
    v = []
    while len(v) < 400:
        v += [float(r.randint(0, 4))] * r.randint(1, 9)
    v[200] = 900.0
    assert flagged(spark, series(v, nature="level")) == {200: "spike"}


def test_spikes_of_a_level_that_rarely_changes_don_t_set_its_fences(spark):
    # eleven everyday steps, and two changes or more by the spikes
    rows, want = series([float(i // 10 % 3) for i in range(120)], "none", "level", first=90_000), {}
    for k, spikes_at in enumerate([{40: [3889.0]}, {40: [3889.0], 90: [600.0]}, {40: [2580.0, 900.0, 2580.0], 90: [600.0]}]):
        v = [float(i // 10 % 3) for i in range(120)]
        for at, high in spikes_at.items():
            v[at + 3 : at + 3 + len(high)] = high
            want |= {k * 1000 + at + 3 + i: "spike" for i in range(len(high))}
        rows += series(v, f"h{k}", "level", first=k * 1000)
    assert flagged(spark, rows) == want


def test_impossible(spark):
    v = noise(50)
    v[10], v[20] = -1.0, float("inf")
    assert flagged(spark, series(v, lo=0.0, hi=100.0)) == {10: "impossible", 20: "impossible"}
    assert flagged(spark, series(v))[20] == "spike"


def brute_stuck(values):
    out, i = set(), 0
    while i < len(values):
        j = i
        while j < len(values) and values[j] == values[i]:
            j += 1
        if j - i >= 12:
            out |= set(range(i, j))
        i = j
    return out


def test_stuck_runs_across_shards_and_silences(spark, monkeypatch):
    monkeypatch.setattr(spikes, "SHARD_INTERVALS", 40)
    rows, want = [], set()
    for seed in range(4):
        r = random.Random(seed)
        v, k = [], 0
        while len(v) < 600:
            k += 1
            v += [float(k % 7)] * r.choice([1, 2, 5, 11, 12, 13, 50, 120])
        rows += series(v, f"h{seed}", first=seed * 10_000, gaps={i for i in range(600) if r.random() < 0.05})
        want |= {seed * 10_000 + i for i in brute_stuck(v)}
    got = {e for e, why in flagged(spark, rows + rows[::3]).items() if why == "stuck"}
    assert got == want


def test_levels_are_never_stuck_and_nulls_and_nan_don_t_count(spark):
    rows = series([3.0] * 30, nature="level") + [(99, None, "m", 1, 1.0, "gauge", None, None, MIN, "", ""), (98, "h", "m", None, 1.0, "gauge", None, None, MIN, "", ""), (97, "h", "m", 5, float("nan"), "gauge", 0.0, 1.0, MIN, "", ""), (96, "h", "m", 5, None, "gauge", 0.0, 1.0, MIN, "", "")]
    assert flagged(spark, rows) == {}
    assert flagged(spark, []) == {}


def test_scatter_is_half_the_interquartile_range(spark):
    v = noise(2000, 11)
    d = sorted(b - a for a, b in zip(v, v[1:]))
    q = statistics.quantiles(d, n=4)
    limits = spikes.fences(spikes.scatter_sketches(spikes._sharded(spark.createDataFrame(series(v), SCHEMA)))).collect()
    assert {round(x.scatter, 9) for x in limits} and all(abs(x.scatter - (q[2] - q[0]) / 2) < 0.05 for x in limits)


def test_the_hour_of_the_day_draws_the_fences_in_or_out(spark):
    # forty days; the hours 0 to 11 are quiet, the others ten times as lively
    r = random.Random(5)
    v = [50 + r.gauss(0, 0.2 if m // 60 % 24 < 12 else 2.0) for m in range(1, 1440 * 40 + 1)]
    v[1440 * 20 + 300] += 8.0  # at about six o'clock, beyond a quiet hour's fences only
    v[1440 * 20 + 1100] += 8.0  # an everyday height in a lively hour
    assert flagged(spark, series(v)) == {1440 * 20 + 300: "spike"}
    (one,) = spikes.fences(spikes.scatter_sketches(spikes._sharded(spark.createDataFrame(series(v), SCHEMA)))).collect()
    assert set(one.by_hour) == set(range(24)) and one.by_hour[5] < one.scatter < one.by_hour[18]


def test_rows_are_shuffled_once_for_all_branches(spark, tmp_path):
    spark.createDataFrame(series(noise(50)), SCHEMA).write.parquet(str(tmp_path / "r"))
    df = implausible(spark.read.parquet(str(tmp_path / "r")))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 2


def test_runs_join_up_over_shards_that_they_fill(spark, monkeypatch):
    monkeypatch.setattr(spikes, "SHARD_INTERVALS", 5)
    v = noise(7) + [7.0] * 4 + noise(3, 2) + [7.0] * 30 + noise(9, 3) + [8.0] * 11
    assert {e for e, why in flagged(spark, series(v)).items() if why == "stuck"} == set(range(14, 44))
