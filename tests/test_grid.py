import random

from tsq.operators.grid import regular_grid

SCHEMA = "host string, metric string, tp_ms bigint, v double, element_id bigint, interval_ms bigint, slot_ms string, K0 string"


def brute(rows, gap, carry):
    series = {}
    for h, m, t, v, e, step, *_ in rows:
        if None not in (h, m, t, v, step) and step >= 1:
            series.setdefault((h, m, step), set()).add((t, e, v))
    out = set()
    for (h, m, step), rs in series.items():
        slots = {}
        for t, e, v in sorted(rs):
            slots.setdefault(t // step * step, []).append((t, e, v))
        order = sorted(slots)
        for i, s in enumerate(order):
            last = slots[s][-1]
            out.add((h, m, s, "observed", last[2], 0))
            if i + 1 < len(order) and slots[order[i + 1]][0][0] - last[0] <= gap:
                for x in range(s + step, order[i + 1], step):
                    near = x - s <= carry * step
                    out.add((h, m, x, "filled" if near else "missing", last[2] if near else None, x - last[0]))
    return out


def rows_of(df):
    return {(r.host, r.metric, r.slot_ms, r.status, r.value, r.age_ms) for r in df.collect()}


def test_matches_brute_force_across_shards(spark):
    rnd = random.Random(3)
    rows = []
    for h in ("a", "b", None):
        t = -5_000
        for e in range(300):
            t += rnd.choice([1, 90, 100, 101, 450, 999, 1000, 1001, 4000])
            rows.append((h, "m", t if e % 50 else None, float(e), e, 100, "x", "y"))
    rows += rows[:40]  # delivered again
    rows += [("a", "m", rows[5][2], 99.0, 999, 100, "x", "y"), ("a", "m", 7, None, 1, 100, "", ""), ("a", "m", 7, 1.0, 1, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = regular_grid(df, ["host", "metric"], max_gap_ms=1000, carry_slots=3)
    assert got.count() == len(rows_of(got))
    assert rows_of(got) == brute(rows, 1000, 3)


def test_gap_of_exactly_the_limit_is_filled_and_a_longer_one_is_not(spark):
    df = spark.createDataFrame([("a", "m", 0, 1.0, 1, 100, "", ""), ("a", "m", 1000, 2.0, 2, 100, "", ""), ("a", "m", 2001, 3.0, 3, 100, "", "")], SCHEMA)
    slots = sorted(r.slot_ms for r in regular_grid(df, ["host", "metric"], max_gap_ms=1000).collect())
    assert slots == [*range(0, 1001, 100), 2000]


def test_empty(spark):
    assert regular_grid(spark.createDataFrame([], SCHEMA), ["host", "metric"]).count() == 0


def test_both_sides_of_the_join_read_one_shuffle(spark, tmp_path):
    spark.createDataFrame([("h", "m", i * 7_000, float(i), i, 5_000, "") for i in range(50)], "host string, metric string, tp_ms bigint, v double, element_id bigint, interval_ms bigint, status string").write.parquet(str(tmp_path / "r"))
    df = regular_grid(spark.read.parquet(str(tmp_path / "r")), ["host", "metric"])
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the second mention is that of the reuse
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1 and final.count("Exchange hashpartitioning") == 2
