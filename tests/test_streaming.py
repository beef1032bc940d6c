from pyspark.sql import functions as F

from tsq.functions import values as va
from tsq.functions.names import TagMatcher
from tsq.operators import alerts as al
from tsq.plans.parser import parse_path_matcher
from tsq.sources import samples as sm
from tsq.sources import sinks
from tsq.streaming import live


def key(df):
    return sorted((r.tp_ms, tuple(r.grp), str(r.tags), tuple(r.metric), str(r.value)) for r in df.collect())


def test_final_facts_of_a_stream_are_those_of_the_batch(spark, data, tmp_path):
    s = sm.of_events(spark, data, 3_600_000)
    src = str(tmp_path / "in")
    s.repartitionByRange(6, "tp_ms").sortWithinPartitions("tp_ms").write.parquet(src)
    stream = spark.readStream.schema(s.schema).parquet(src)
    out = str(tmp_path / "out")
    q = live.facts(stream, 3_600_000).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.read.parquet(out)
    last = s.agg(F.max("tp_ms")).first()[0]
    # what the watermark has not passed yet stays speculative
    assert key(got) == key(s.where(F.col("tp_ms") < last - 3_600_000).select(got.columns)) or key(got) == key(s.select(got.columns).where(F.col("tp_ms") <= got.agg(F.max("tp_ms")).first()[0]))


def test_speculative_rows_and_fan_out(spark, data, tmp_path):
    s = sm.of_events(spark, data, 3_600_000).limit(50).cache()
    src = str(tmp_path / "in")
    s.write.parquet(src)
    view = str(tmp_path / "view")
    a, b = [], []
    q = live.facts(spark.readStream.schema(s.schema).parquet(src), 1000).writeStream.outputMode("update").foreachBatch(lambda df, n: live.upsert(df, n, view)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert key(live.current(spark, view)) == key(s)
    live.upsert(s.withColumn("value", va.double(F.lit(7.0))), 99, view)
    assert {r.value.d for r in live.current(spark, view).collect()} == {7.0}
    batch = s.withColumn("is_fact", F.col("tp_ms") % 2 == 0)
    sinks.fan_out([lambda d: a.append(d.count()), lambda d: b.append("is_fact" in d.columns)])(batch, 0)
    assert a == [batch.where("is_fact").count()] and b == [False]


def test_collector_source(spark, tmp_path):
    c = live.SelfCollector()
    q = live.selected(live.scrape(spark, c, "own_process"), parse_path_matcher("process.**")).writeStream.format("memory").queryName("own").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("own").count():
                break
    finally:
        q.stop()
    rows = spark.table("own").collect()
    assert rows and {tuple(r.grp)[0] for r in rows} == {"process"} and all(r.metric == [] for r in rows)


def test_one_clock_drives_all_collectors(spark, tmp_path):
    class Fixed(live.Collector):
        def __init__(self, name):
            self.of = name

        def provides(self):
            return [(parse_path_matcher(self.of), TagMatcher(), parse_path_matcher("m"))]

        def collect(self, tp_ms):
            yield tp_ms, [self.of], [], ["m"], live._mv(1)

    stream = live.scrape(spark, [Fixed("a"), Fixed("b"), Fixed("c")], "fixed", 1, group=parse_path_matcher("a")).unionByName(live.scrape(spark, [Fixed("b"), Fixed("c")], "fixed2", 1))
    q = stream.writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("ticks").select("grp").distinct().count() == 3:
                break
    finally:
        q.stop()
    rows = spark.table("ticks").collect()
    assert {r.grp[0] for r in rows} == {"a", "b", "c"} and all(r.tp_ms % 1000 == 0 for r in rows)
    ticks = {g: sorted(r.tp_ms for r in rows if r.grp[0] == g) for g in "bc"}
    assert ticks["b"] == ticks["c"] and len(set(ticks["b"])) == len(ticks["b"])


def test_merged_streams_of_several_batches_and_kinds(spark, tmp_path):
    from tsq.functions import histogram as hg
    from tsq.schema import TAGS_DDL

    def put(n, left, right):
        rows = [(s, t, k) for s, side in (("l", left), ("r", right)) for t, k in side]
        df = spark.createDataFrame(rows, "s string, tp_ms bigint, k string")
        v = F.when(F.col("k") == "h", va.histogram(hg.literal([(0.0, 1.0, 4.0)]))).when(F.col("k") == "t", va.boolean(F.lit(True))).when(F.col("k").rlike("[0-9]"), va.double(F.col("k").try_cast("double"))).otherwise(va.string(F.col("k")))
        df.select("s", "tp_ms", F.array().cast(TAGS_DDL).alias("tags"), v.alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        side = lambda n: s.where(F.col("s") == n).select("tp_ms", "tags", "value")
        m = live.merged(side("l"), side("r"), lambda x, y: x, 5000)
        q = m.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    # exact, interpolated, a gap beyond the slack, texts, booleans, histograms
    put(0, [(1000, "16"), (3000, "18"), (20_000, "a"), (22_000, "a"), (30_000, "t"), (32_000, "t")], [(1000, "1"), (2000, "1"), (9000, "1"), (21_000, "1"), (31_000, "1")])
    run()
    put(1, [(40_000, "h"), (42_000, "h"), (50_000, "a"), (52_000, "b")], [(41_000, "1"), (51_000, "1"), (90_000, "1")])
    run()
    got = {r.tp_ms: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == [1000, 2000, 21_000, 31_000, 41_000]
    assert (got[1000].d, got[2000].d, got[21_000].s, got[31_000].b) == (16.0, 17.0, "a", True) and [tuple(r) for r in got[41_000].h] == [(0.0, 1.0, 4.0)]


def test_pruning_of_collectors():
    class Narrow(live.Collector):
        def provides(self):
            return [(parse_path_matcher("a.*"), TagMatcher(), parse_path_matcher("m"))]

    assert live.intersects(Narrow(), parse_path_matcher("a.b")) and not live.intersects(Narrow(), parse_path_matcher("b.**"))
    assert live.intersects(live.SelfCollector(), metric=parse_path_matcher("anything"))


def test_alerts(spark):
    rows = [(1, True), (2, True), (5, False), (6, None), (9, True)]
    df = spark.createDataFrame(rows, "tp_ms bigint, b boolean").select("tp_ms", F.when(F.col("b").isNull(), va.empty()).otherwise(va.boolean(F.col("b"))).alias("value"))
    a = al.alerts(df, F.lit("n"), F.lit("hello"))
    got = [(r.state, r.since, r.duration) for r in al.extend(a, fire_after_ms=1).orderBy("since").collect()]
    assert got == [("FIRING", 1, 1), ("OK", 5, 0), ("UNKNOWN", 6, 0), ("TRIGGERING", 9, 0)]
    assert al.extend(a.limit(0)).count() == 0
    assert [r.ok for r in a.orderBy("tp_ms").select(al.value_is_ok(F.col("state")).alias("ok")).collect()] == [False, False, True, False, False]
