"""Implausible spikes, stuck values and impossible readings."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.functions.values import bound

#: Readings on either side that make up the course nearby; most readings in a spike; fewest equal readings of a stuck stretch.
NEAR, SPIKE, STUCK = 3, 3, 12
#: A silence of more than this many intervals starts the course anew.
SILENCE = 4
#: Half the width of the fences in scatters. The scatter is half the interquartile range of the changes from reading to reading,
#: which for a noise of deviation s is 0.95 s, so that 9.5 of them are nine to ten deviations.
FENCE = 9.5
#: A level's scatter is the quantile LEVEL of its absolute changes, or that below its OUTLIERS greatest ones, the median at least:
#: so the jumps of three spikes of SPIKE readings, or of six of one reading, set no fence.
LEVEL, OUTLIERS = 0.9, 12
#: Size of the quantile sketches: exact below it, a rank error of about 0.4 % beyond.
SKETCH_K = 1024
#: An hour of the day with so many changes sets its scatter half by its own ones, half by the source's: with fewer the source's weigh more, with more its own.
HOUR_CHANGES = 240
#: A time shard of a series has this many intervals.
SHARD_INTERVALS = 1024

KEYS = ["host", "metric", "shard"]


def _sharded(readings: DataFrame) -> DataFrame:
    """Readings once each, cut into time shards with a halo on both sides, partitioned by (host, metric, shard).

    The repeats go by grouping on all columns, and no column can be null: so the branches that follow all need the same columns, none puts a
    filter of its own below the shuffle, and all read the one shuffle.
    """
    length = F.col("interval_ms") * SHARD_INTERVALS
    # what decides on a reading lies at most NEAR + SPIKE readings off within one course, so this much time
    halo = F.col("interval_ms") * SILENCE * (NEAR + SPIKE + 1)
    home = F.floor(F.col("tp_ms") / length).cast("bigint")
    into = F.pmod(F.col("tp_ms"), length)
    at = lambda d: F.struct((home + d).alias("shard"), F.lit(d == 0).alias("own"))
    places = F.when(into < halo, F.array(at(0), at(-1))).when(length - into <= halo, F.array(at(0), at(1))).otherwise(F.array(at(0)))
    r = readings.where("nature in ('gauge', 'level') and element_id is not null and host is not null and metric is not null and tp_ms is not null and v is not null and not isnan(v) and interval_ms >= 1")
    outside = F.coalesce((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), F.col("v") < F.col("lo"), F.col("v") > F.col("hi"), F.lit(False))
    r = r.select("element_id", "host", "metric", "tp_ms", "v", "interval_ms", (F.col("nature") == "level").alias("level"), outside.alias("outside"), F.explode(places).alias("at"))
    sure = {"element_id": 0, "tp_ms": 0, "v": 0.0, "interval_ms": 1, "level": False, "outside": False, "host": "", "metric": "", "at.shard": 0, "at.own": False}
    r = r.select(*[F.coalesce(F.col(c), F.lit(x)).alias(c.rpartition(".")[2]) for c, x in sure.items()])
    return r.repartition(*KEYS).distinct()


def _in_order():
    """The one order of a shard's rows, which every window of this operator shares: so each branch sorts once."""
    return Window.partitionBy(*KEYS).orderBy("tp_ms", "element_id")


def _silence(later: Column, earlier: Column) -> Column:
    return later - earlier > F.col("interval_ms") * SILENCE


def changes(r: DataFrame) -> DataFrame:
    """host, metric, level, hour (of the day) and change: the changes from reading to reading within a course, of possible own readings, neither zero nor infinite. Of levels the absolute ones."""
    w = _in_order()
    r = r.select("*", F.lag("tp_ms").over(w).alias("t1"), F.lag("v").over(w).alias("v1"), F.lag("outside").over(w).alias("o1"))
    r = r.where("own and not outside and not o1 and v <> v1 and abs(v - v1) < double('infinity')").where(~_silence(F.col("tp_ms"), F.col("t1")))
    hour = F.pmod(F.floor(F.col("tp_ms") / F.lit(3_600_000)), F.lit(24)).cast("int")
    change = F.col("v") - F.col("v1")
    return r.select("host", "metric", "level", hour.alias("hour"), F.when(F.col("level"), F.abs(change)).otherwise(change).alias("change"))


def scatter_sketches(r: DataFrame) -> DataFrame:
    """Quantile sketches of the changes per (host, metric, hour of the day), built where the rows lie and merged over partitions; sketch, level, n."""
    return changes(r).groupBy("host", "metric", "hour").agg(F.kll_sketch_agg_double("change", F.lit(SKETCH_K)).alias("sketch"), F.bool_or("level").alias("level"), F.count("*").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """Per (host, metric) the source's scatter and by_hour, its scatters by hour of the day: half the interquartile range of the changes, for levels a quantile of the absolute ones (see LEVEL).

    A source's sketch is merged from those of its hours; sketches of files or days combine the same way. An hour's scatter stands between its
    own and the source's, in the ratio of its changes to HOUR_CHANGES: a quiet hour has closer fences, a lively one wider, the more surely the more changes it has.
    """
    q = lambda s, p: F.kll_sketch_get_quantile_double(s, p)
    # the functions take constant ranks only: those a level may need, of which the one for the source's number of changes is taken
    ranks = F.array(*[F.lit(p / 20) for p in range(10, round(LEVEL * 20) + 1)])
    usual = lambda n: F.floor((F.greatest(F.lit(0.5), F.least(F.lit(LEVEL), 1 - F.lit(float(OUTLIERS)) / n)) - 0.5) * 20 + 1e-9).cast("int")
    half = lambda s: (q(s, F.lit(0.75)) - q(s, F.lit(0.25))) / 2
    level = F.col("level")
    hours = sketches.select("host", "metric", "hour", "sketch", "level", "n", F.when(level, q(F.col("sketch"), ranks)).otherwise(F.array(half(F.col("sketch")))).alias("of_hour"))
    source = hours.groupBy("host", "metric").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"), F.bool_or("level").alias("level"), F.sum("n").alias("n"), F.collect_list(F.struct("hour", "n", "of_hour")).alias("hours"))
    source = source.select("host", "metric", "hours", F.when(level, usual(F.col("n"))).otherwise(0).alias("rank"), F.when(level, F.get(q(F.col("sketch"), ranks), usual(F.col("n")))).otherwise(half(F.col("sketch"))).alias("scatter"))
    ratio = lambda h: F.try_divide(F.get(h.of_hour, F.col("rank")), F.col("scatter"))
    shared = lambda h: F.when(ratio(h) > 0, F.col("scatter") * F.pow(ratio(h), h.n / (h.n + HOUR_CHANGES))).otherwise(F.col("scatter"))
    return source.select("host", "metric", "scatter", F.map_from_entries(F.transform("hours", lambda h: F.struct(h.hour, shared(h)))).alias("by_hour"))


def _broken() -> Column:
    """Whether a run of equal values ends before a reading that isn't the shard's first own one."""
    return F.col("own") & F.coalesce(F.col("own1"), F.lit(False)) & (F.col("v") != F.col("v1"))


def shard_ends(r: DataFrame) -> DataFrame:
    """(host, metric, shard): breaks (between its runs of equal own values), and whether its first and last run, with those of the neighbouring shards that go on with the same value, are stuck.

    A shard sends one row; of a gauge's shards the first and last runs are joined up in the order of time.
    """
    w = _in_order()
    r = r.select(*KEYS, "own", "v", "level", F.row_number().over(w).alias("rn"), F.lag("v").over(w).alias("v1"), F.lag("own").over(w).alias("own1"))
    r = r.withColumn("broken", _broken()).where("own")
    cut = lambda agg: agg(F.when(F.col("broken"), F.col("rn")))
    one = r.groupBy(*KEYS).agg(F.bool_or("level").alias("level"), F.sum(F.col("broken").cast("int")).alias("breaks"), F.min("rn").alias("a"), (F.max("rn") + 1).alias("z"), cut(F.min).alias("c"), cut(F.max).alias("d"), F.min_by("v", "rn").alias("v0"), F.max_by("v", "rn").alias("v9"))
    run = lambda no, v, n: F.struct(F.lit(no).alias("no"), v.alias("v"), n.alias("n"))
    whole = F.array(run(0, F.col("v0"), F.col("z") - F.col("a")))
    parts = F.array(run(0, F.col("v0"), F.col("c") - F.col("a")), run(1, F.col("v9"), F.col("z") - F.col("d")))
    runs = one.select(*KEYS, "level", "breaks", F.inline(F.when(F.col("breaks") == 0, whole).otherwise(parts)))
    s = Window.partitionBy("host", "metric").orderBy("shard", "no")
    runs = runs.withColumn("chain", F.sum(F.when((F.col("no") == 0) & (F.lag("v").over(s) == F.col("v")), 0).otherwise(1)).over(s))
    runs = runs.withColumn("stuck", (F.sum("n").over(Window.partitionBy("host", "metric", "chain")) >= STUCK) & ~F.col("level"))
    stuck = lambda no: F.coalesce(F.bool_or(F.when(F.col("no") == no, F.col("stuck"))), F.lit(False))
    # of a shard of one run the last run is the first
    return runs.groupBy(*KEYS).agg(F.max("breaks").alias("breaks"), stuck(0).alias("first_stuck"), stuck(1).alias("last_stuck"))


def _median(near: Column, mid: Column, far: Column) -> Column:
    """Median of the one to three readings next to a group; those further off are null where the course ends."""
    three = F.greatest(F.least(near, mid), F.least(F.greatest(near, mid), far))
    return F.when(far.isNotNull(), three).when(mid.isNotNull(), (near + mid) / 2).otherwise(near)


#: Groups that a reading may belong to: its place in the group and the group's size.
GROUPS = [(o, n) for n in range(1, SPIKE + 1) for o in range(n)]


def _beside(r: DataFrame) -> DataFrame:
    """The own readings, each with those around it in its course (x-3..x3), the course before and after the groups it may belong to (b0..b2, f0..f2),
    held (the longest run of equal own values that it is known to be in) and run (number of its run in the shard)."""
    w = _in_order()
    far = max(NEAR, SPIKE)
    sides = [d for k in range(1, far + 1) for d in (-k, k)]
    moved = lambda c, d: F.lag(c, -d).over(w) if d < 0 else F.lead(c, d).over(w)
    r = r.select("*", F.row_number().over(w).alias("rn"), F.lag("own").over(w).alias("own1"), *[moved(c, d).alias(f"{n}{d}") for d in sides for c, n in (("v", "y"), ("tp_ms", "t"))])
    r = r.withColumn("v1", F.col("y-1")).withColumns({"y0": F.col("v"), "t0": F.col("tp_ms"), "x0": F.col("v")})
    for d in sides:
        nearer = d - 1 if d > 0 else d + 1
        gap = (F.col(f"t{d}"), F.col(f"t{nearer}")) if d > 0 else (F.col(f"t{nearer}"), F.col(f"t{d}"))
        r = r.withColumn(f"x{d}", F.when(F.col(f"x{nearer}").isNotNull() & ~_silence(*gap), F.col(f"y{d}")))
    x = {d: F.col(f"x{d}") for d in range(-far, far + 1)}
    started = F.when(F.col("own") & (_broken() | ~F.coalesce(F.col("own1"), F.lit(False))), F.col("rn"))
    r = r.select("element_id", *KEYS, "own", "tp_ms", "level", "outside", "rn", *[x[d].alias(f"x{d}") for d in x], _median(x[-1], x[-2], x[-3]).alias("b0"), _median(x[1], x[2], x[3]).alias("f0"), started.alias("started"), _broken().cast("int").alias("broken"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    r = r.select("*", *[F.lag("b0", o).over(w).alias(f"b{o}") for o in range(1, SPIKE)], *[F.lead("f0", o).over(w).alias(f"f{o}") for o in range(1, SPIKE)], F.max("started").over(so_far).alias("start"), F.sum("broken").over(so_far).alias("run"))
    r = r.withColumn("in_run", F.when(F.col("own"), F.col("rn") - F.col("start") + 1).otherwise(0))
    # a run begun after this reading has fewer than STUCK readings within the frame
    return r.withColumn("held", F.max("in_run").over(w.rowsBetween(0, STUCK - 1))).where("own").drop("rn", "start", "started", "broken", "in_run", "own")


def _far(rows: DataFrame) -> DataFrame:
    """Adds far: how far from its course a reading may be, by the source's scatter in that hour of the day."""
    hour = F.pmod(F.floor(F.col("tp_ms") / F.lit(3_600_000)), F.lit(24)).cast("int")
    return rows.withColumn("far", F.coalesce(F.element_at("by_hour", hour), F.col("scatter")) * FENCE)


def _may_spike() -> Column:
    """Whether a reading is beyond the fences around some course before it and some after it: needed of any spike."""
    beyond = lambda side: reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col("x0") - F.col(f"{side}{o}")) > F.col("far"), F.lit(False)) for o in range(SPIKE)])
    return beyond("b") & beyond("f")


def _spiked() -> Column:
    """Whether a reading is in a spike. The columns are read once and the rest is said of what was read, so that the plan stays small; few readings get here."""
    reach = range(-SPIKE, SPIKE + 1)
    names = ["far", *[f"x{d}" for d in reach], *[f"{side}{o}" for side in "bf" for o in range(SPIKE)]]

    def spiked(*values: Column) -> Column:
        v = dict(zip(names, values))
        far, case = v["far"], F.lit(False)
        for o, n in GROUPS:
            b, f = v[f"b{o}"], v[f"f{n - 1 - o}"]
            course = (b + f) / 2
            # fences around the course, and a rate of change that neither neighbour explains
            out = F.abs(b - f) <= far
            # it is left and reached again at once: the readings next to the group lie on it
            for d in (-o - 1, n - o):
                out = out & (F.abs(v[f"x{d}"] - course) <= far)
            for d in range(-o, n - o):
                x = v[f"x{d}"]
                out = out & (F.abs(x - course) > far) & (F.abs(x - b) > far) & (F.abs(x - f) > far)
            case = case | F.coalesce(out, F.lit(False))
        return case

    return bound(spiked)(*[F.col(n) for n in names])


def implausible(readings: DataFrame) -> DataFrame:
    """Flags implausible readings of gauge and level metrics: element_id and reason, once each.

    readings: element_id, host, metric, tp_ms, v with nature, lo, hi and interval_ms of the metric. Reasons:
    'impossible' outside lo..hi (null: no bound); else 'stuck' one of at least STUCK successive equal readings of a gauge;
    else 'spike' one of at most SPIKE successive readings beyond the source's fences that come back at once.

    Method: each source's changes go into quantile sketches by hour of the day, built where the rows lie and merged; the expanded
    interquartile fences of the hour stand around the course nearby (medians of NEAR readings before and after within the same course).
    A source whose values never change has no fences: only the bounds and the stuck rule apply to it. Nor are there usable ones for a level
    of whose changes more than half are jumps of spikes, as when it is constant but for a spike: nothing tells such a jump from a step.
    Readings lie in time shards of bounded length with a halo, so a hot source is spread; rows move once and are read thrice (for the
    sketches, the ends of runs and the flags), each time in the same order, and only sketches, fences and one row a shard move besides.
    Rows with a null id, host, metric, time, value or interval are left out, NaN too; infinite values take part and are never a source's
    normal. Of equal times the order is by element_id; redelivered rows, equal in all columns, count once.
    """
    sharded = _sharded(readings)
    limits = shard_ends(sharded).join(fences(scatter_sketches(sharded)), ["host", "metric"], "left")
    rows = _far(_beside(sharded).join(limits, KEYS))
    at_end = (F.col("first_stuck") & (F.col("run") == 0)) | (F.col("last_stuck") & (F.col("run") == F.col("breaks")))
    stuck = ~F.col("level") & ((F.col("held") >= STUCK) | at_end)
    rows = rows.where(F.col("outside") | stuck | _may_spike())
    reason = F.when(F.col("outside"), "impossible").when(stuck, "stuck").when(_spiked(), "spike")
    return rows.select("element_id", reason.alias("reason")).where("reason is not null")
