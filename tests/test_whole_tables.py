"""Queries over all rows of their tables, against brute force."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from test_values import constant, mv
from tsq import expression_queries as own
from tsq.plans import parser as ps
from tsq.schema import MV_DDL

#: In the weak order.
ORDERED = [None, False, True, -math.inf, -(1 << 63), -7, -0.25, 0, 1e-7, 0.1, 42, 1e300, math.inf, math.nan, "", "a\n", "b", [], [(0.0, 1.0, 2.0)], [(0.5, 2.25, 1.125), (3.0, 4.0, 1e20)]]


def elements(spark, tmp_path, values):
    rows = [(i, ["g"], ["m"], mv(x)) for i, x in enumerate(values)]
    spark.createDataFrame(rows + rows[:3], f"element_id bigint, grp array<string>, metric array<string>, value {MV_DDL}").write.parquet(str(tmp_path / "collection_elements.parquet"))
    return str(tmp_path)


def test_texts_of_all_kinds_read_back(spark, tmp_path):
    d = elements(spark, tmp_path, ORDERED)
    texts = {r.element_id: r.text for r in own.queries()["value_text"](spark, d).collect()}
    assert sorted(texts) == [*range(len(ORDERED))]
    for i, x in enumerate(ORDERED):
        if x is None or isinstance(x, float) and not math.isfinite(x):
            assert texts[i] == {"None": "(none)", "nan": "nan", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]
        else:
            got = ps.parse_value(texts[i])
            assert got == (tuple(x) if isinstance(x, list) else x) and (isinstance(x, list) or type(got) is type(x)), texts[i]
    of_histograms = {r.element_id: r.text for r in own.queries()["hist_text"](spark, d).collect()}
    assert of_histograms == {i: texts[i] for i, x in enumerate(ORDERED) if isinstance(x, list)}


def test_order_of_all_kinds(spark, tmp_path):
    rnd = random.Random(5)
    for n in range(3):
        a, b = sorted(rnd.sample(range(len(ORDERED)), 2)) if n else (0, len(ORDERED) - 1)
        some = ORDERED[a : b + 1]
        d = elements(spark, tmp_path / str(n), rnd.sample(some, len(some)))
        r = own.queries()["value_order"](spark, d).first()
        e = spark.read.parquet(d + "/collection_elements.parquet").select("value")
        texts = {str(constant(x.value)): x.t for x in e.select("value", own.tx.value(F.col("value")).alias("t")).collect()}
        kinds = [mv(x)[0] for x in (some[0], some[-1])]
        assert (r.least, r.greatest) == (texts[str(some[0])], texts[str(some[-1])]) and [r.least_kind, r.greatest_kind] == kinds


def events(spark, tmp_path, rows):
    at = lambda t: dt.datetime.fromtimestamp((own.JAN_1 + t) / 1000, dt.timezone.utc)
    spark.createDataFrame([(i, at(t), e, u, v, '{"k": 1}') for i, (t, e, u, v) in enumerate(rows)], "event_id bigint, ts timestamp, event_type string, user_id bigint, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def at_time(samples, t, slack):
    """Value of a series, a dict by time, at t, or None."""
    if t in samples:
        return samples[t]
    p, n = max((x for x in samples if x < t), default=None), min((x for x in samples if x > t), default=None)
    if p is None or n is None or t - p > slack or n - t > slack:
        return None
    return samples[p] * ((n - t) / (n - p)) + samples[n] * ((t - p) / (n - p))


def some_events(span, n, seed):
    rnd = random.Random(seed)
    rows = {(rnd.randrange(span), rnd.choice(["signup", "view"]), rnd.randrange(3)): rnd.uniform(0, 100) for _ in range(n)}
    return [(*k, v) for k, v in rows.items()]


def by_series(rows):
    out = {}
    for t, e, u, v in rows:
        out.setdefault((e, u), {})[t] = v
    return out


def test_a_constant_meets_a_vector_at_every_time_of_the_table(spark, tmp_path):
    rows = some_events(5 * 24 * own.HOUR, 700, 6)
    got = {(r.tp_ms - own.JAN_1, r.user_id): r.v for r in own.queries()["align_interpolate_constant"](spark, events(spark, tmp_path, rows)).collect()}
    want = {(t, u): 2 * v for (e, u), s in by_series(rows).items() if e == "signup" for t in {r[0] for r in rows} if (v := at_time(s, t, own.HOUR // 2)) is not None}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-5) for k in want)
    assert len(want) > sum(e == "signup" for _, e, *_ in rows) and max(t for t, _ in want) > 4 * 24 * own.HOUR


def test_grids_cover_the_whole_table(spark, tmp_path):
    rows = some_events(12 * 24 * own.HOUR, 900, 7)
    d = events(spark, tmp_path, rows)
    first, last = min(rows)[0], max(rows)[0]
    for name, step, slack, plus, kinds in (("resample_grid", 7, 12, 0, ("signup", "view")), ("expression_grid", 4, 8, 1, ("view",))):
        r = own.queries()[name](spark, d).collect()
        got = {(x.tp_ms - own.JAN_1, x.event_type if "event_type" in x else "view", x.user_id): x.v for x in r}
        grid = {*range(first, last + 1, step * own.HOUR), last}
        want = {(t, *k): v + plus for k, s in by_series(rows).items() if k[0] in kinds for t in grid if (v := at_time(s, t, slack * own.HOUR)) is not None}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-5) for k in want) and len(r) == len(got)
        assert max(got)[0] - min(got)[0] > 0.9 * (last - first)
