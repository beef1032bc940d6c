import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tsq.llm.percentiles import bisect, code, decode, merged, reading_items, summarise
from tsq.sources.tables import table

PS = [0.0001, 0.01, 0.5, 0.9, 0.999, 1.0]


def test_code_is_exact_and_keeps_order(spark):
    rnd = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 - 2**-53]
    xs += [x for x in (struct.unpack("d", rnd.randbytes(8))[0] for _ in range(3000)) if x == x]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", code(F.col("x")).alias("c")).withColumn("y", decode(F.col("c")))
    rows = df.collect()
    assert all(r.x == r.y for r in rows)
    order = sorted(rows, key=lambda r: r.c)
    assert all(a.x <= b.x for a, b in zip(order, order[1:]))


def exact(xs, p):
    """Least value with at least p of the weight at or below it."""
    total, run = sum(w for _, w in xs), 0
    for x, w in sorted(xs):
        run += w
        if run >= p * total - 1e-9:
            return x


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_bisection_matches_brute_force(spark, broadcast):
    rnd = random.Random(2)
    groups = {"a": [(rnd.gauss(0, 1e6), 1) for _ in range(900)], "b": [(float(rnd.randint(-3, 3)), rnd.randint(1, 9)) for _ in range(200)], None: [(5e-324, 1), (-0.0, 2), (1e300, 1)], "one": [(7.5, 3)]}
    rows = [(g, x, float(w)) for g, xs in groups.items() for x, w in xs] + [("a", None, 1.0), ("a", 3.0, 0.0), ("a", 3.0, None), ("a", 3.0, -1.0)]
    items = spark.createDataFrame(rows, "g string, x double, w double").select("g", code(F.col("x")).alias("code"), "w")
    got = {(r.g, r.pct): r.value for r in bisect(items, ["g"], PS, max_broadcast=broadcast).collect()}
    assert got == {(g, p): exact(xs, p) for g, xs in groups.items() for p in PS}
    parts = [summarise(items.where(c), ["g"]) for c in ("code % 2 = 0", "code % 2 <> 0")]
    both = {(r.g, r.pct): (r.lower, r.upper) for r in merged(parts[0].unionByName(parts[1]), ["g"], PS).collect()}
    for k, v in got.items():
        lo, hi = both[k]
        assert lo <= v <= hi and (hi - lo <= abs(v) / 128 or abs(v) < 1e-300)


def test_empty(spark):
    items = spark.createDataFrame([], "g string, code bigint, w double")
    assert bisect(items, ["g"], PS).count() == 0 and merged(summarise(items, ["g"]), ["g"], PS).count() == 0


def test_items_of_readings(spark, data):
    e = table(spark, data, "collection_elements")
    once, twice = reading_items(e), reading_items(e.unionByName(e))
    total = lambda df: {(r.grp, r.metric, r.kind): round(r.n, 6) for r in df.groupBy("grp", "metric", "kind").agg(F.sum("w").alias("n")).collect()}
    assert total(once) == total(twice)
    assert all(total(once)[g, m, "range_lo"] == total(once)[g, m, "range_hi"] for g, m, k in total(once) if k == "range_lo")
