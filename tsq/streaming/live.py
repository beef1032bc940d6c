"""Live evaluation with Structured Streaming: collectors, facts past the watermark, speculative rows before it."""

import os
import pickle
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from tsq.functions import values as va
from tsq.functions.names import ANY, PathMatcher, TagMatcher
from tsq.schema import MV_DDL, SAMPLES_DDL, TAGS_DDL
from tsq.sources.samples import SERIES, last_wins, matching

#: Seconds between scrapes of the daemon loop.
SCRAPE_S = 5


class Collector:
    """A source of collections. provides() says what it may deliver, as (group, tags, metric) matchers; collect() makes one complete collection."""

    def provides(self) -> list[tuple[PathMatcher, TagMatcher, PathMatcher]]:
        return [(ANY, TagMatcher(), ANY)]

    def collect(self, tp_ms: int) -> Iterator[tuple]:
        """Rows (tp_ms, grp, tags, metric, value) of one collection."""
        raise NotImplementedError


def intersects(c: Collector, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> bool:
    """Whether a collector can deliver anything that matches; others are left out of a plan before it is built."""
    return any(g.overlaps(group) and t.overlaps(tags) and m.overlaps(metric) for g, t, m in c.provides())


def _mv(x) -> tuple:
    kind = 0 if x is None else 1 if isinstance(x, bool) else (2 if x < 0 else 3) if isinstance(x, int) else 4 if isinstance(x, float) else 5 if isinstance(x, str) else 6
    return (kind, x if kind == 1 else None, x if kind in (2, 3) else None, None, x if kind == 4 else None, x if kind == 5 else None, x if kind == 6 else None)


class SelfCollector(Collector):
    """The process about itself: CPU seconds, resident memory, threads. The metric names are empty paths; the group says what is measured."""

    def collect(self, tp_ms: int) -> Iterator[tuple]:
        t = os.times()
        found: dict[str, object] = {"cpu.user": t.user, "cpu.system": t.system, "pid": os.getpid(), "clock": time.monotonic()}
        try:
            for line in open("/proc/self/status"):
                k, _, v = line.partition(":")
                if k in ("VmRSS", "Threads"):
                    found[{"VmRSS": "memory.resident_kb", "Threads": "threads"}[k]] = int(v.split()[0])
        except OSError:
            pass
        for k, v in found.items():
            yield tp_ms, ["process", *k.split(".")], [], [], _mv(v)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, collectors: list[Collector], interval_ms: int):
        self.collectors, self.interval_ms = collectors, interval_ms

    def _collect(self, tp_ms: int) -> Iterator[tuple]:
        for c in self.collectors:
            yield from c.collect(tp_ms)

    def initialOffset(self) -> dict:
        return {"tp_ms": 0}

    def read(self, start: dict):
        tick = int(time.time() * 1000) // self.interval_ms * self.interval_ms
        if tick <= start["tp_ms"]:
            return iter(()), start
        return iter(list(self._collect(tick))), {"tp_ms": tick}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._collect(end["tp_ms"])

    def commit(self, end: dict) -> None:
        pass


def source(collectors: list[Collector], name: str, interval_ms: int) -> type[DataSource]:
    """A streaming data source over collectors, for spark.dataSource.register. One clock drives them all: at each tick, a multiple of the interval, every collector makes
    one collection with the tick's time; a micro-batch is one tick."""

    class Collected(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType | str:
            return SAMPLES_DDL

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return _Reader(collectors, interval_ms)

    return Collected


def scrape(spark: SparkSession, collectors: "Collector | list[Collector]", name: str, interval_s: int = SCRAPE_S, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
    """The samples of collectors as a stream, without those collectors that can't deliver anything that matches. Run it with trigger(processingTime=f'{interval_s} seconds') for the daemon loop."""
    every = collectors if isinstance(collectors, list) else [collectors]
    spark.dataSource.register(source([c for c in every if intersects(c, group, tags, metric)], name, interval_s * 1000))
    return matching(spark.readStream.format(name).load(), group, tags, metric)


def watermarked(samples: DataFrame, slack_ms: int) -> DataFrame:
    """A stream of samples with event times and a watermark of the slack: the finality rule. A time is final once all input is past it by the slack; later rows are rejected as late."""
    return samples.withColumn("ts", F.timestamp_millis("tp_ms")).withWatermark("ts", f"{slack_ms} milliseconds")


def facts(samples: DataFrame, slack_ms: int, seq: str | None = None) -> DataFrame:
    """The final value of each series at each time, once: in append mode a row comes when the watermark has passed its time; in update mode every change comes at once, as
    speculative rows that the last one supersedes. Several values of a series at a time: the greatest seq wins, else the greatest value by kind. State is dropped past the watermark.
    """
    s = watermarked(samples, slack_ms)
    order = F.col(seq) if seq else F.struct(F.col("value.kind"), F.col("value.d"), F.col("value.i"), F.col("value.s"))
    return s.groupBy("ts", "tp_ms", *SERIES).agg(F.max_by("value", order).alias("value")).drop("ts")


def upsert(batch: DataFrame, epoch: int, directory: str) -> None:
    """A foreachBatch step: adds a batch's changes, marked with its number, to a directory that holds a stream's speculative view (see current). A batch that is run again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{directory}/epoch={epoch}")


def current(spark: SparkSession, directory: str) -> DataFrame:
    """The view kept by upsert: last write wins by time and series, so a fact replaces what was guessed before it."""
    return last_wins(spark.read.parquet(directory), "epoch")


def selected(samples: DataFrame, group: PathMatcher = ANY, tags: TagMatcher = TagMatcher(), metric: PathMatcher = ANY) -> DataFrame:
    """The live-stream element filter: the same predicates as in batch."""
    return matching(samples, group, tags, metric)


def aligned(left: DataFrame, right: DataFrame, f: Callable, slack_ms: int) -> DataFrame:
    """Two streams of vectors (tp_ms, tags, value) joined on equal times and tags: a stream-stream join whose state is bounded by the watermark."""
    a = watermarked(left, slack_ms).alias("x")
    b = watermarked(right, slack_ms).alias("y")
    on = (F.col("x.ts") == F.col("y.ts")) & (F.col("x.tags") == F.col("y.tags"))
    return a.join(b, on).select("x.tp_ms", "x.tags", f(F.col("x.value"), F.col("y.value")).alias("value"))


_AROUND = f"tp_ms bigint, tags {TAGS_DDL}, " + ", ".join(f"{s}t{i} bigint, {s}v{i} {MV_DDL}" for s in "xy" for i in (0, 1))


def _around(times: list[int], values: dict, t: int, slack: int) -> tuple | None:
    """Time and value of the sample at t, or of its neighbours within the slack; None if there is neither."""
    if t in values:
        return t, values[t], None, None
    i = bisect_left(times, t)
    if 0 < i < len(times) and t - times[i - 1] <= slack and times[i] - t <= slack:
        return times[i - 1], values[times[i - 1]], times[i], values[times[i]]
    return None


def _merger(slack: int):
    """A step of the stateful merger: of each key the samples of both sides that may still matter, and up to which time results were given."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tags, sides, done = pickle.loads(state.get[0]) if state.exists else (None, ({}, {}), -(1 << 62))
        for f in frames:
            for side, t, of, v in zip(f["side"], f["tp_ms"], f["tags"], f["value"]):
                tags = of if tags is None else tags
                if t > done:
                    sides[side][int(t)] = v
        mark = state.getCurrentWatermarkMs()
        times = [sorted(s) for s in sides]
        both = sorted({*times[0], *times[1]})
        # a neighbour may come until the watermark has passed a time by the slack
        final = mark - slack
        rows = []
        for t in both:
            if done < t < final:
                found = [_around(ts, s, t, slack) for ts, s in zip(times, sides)]
                if all(found):
                    rows.append((t, tags, *found[0], *found[1]))
        done = max(done, final - 1)
        # the look-back: samples that a later time may still reach
        sides = tuple({t: v for t, v in s.items() if t > done - slack} for s in sides)
        left = sorted({*sides[0], *sides[1]})
        if left:
            state.update((pickle.dumps((tags, sides, done)),))
            waiting = next((t for t in left if t > done), left[-1])
            state.setTimeoutTimestamp(max(mark + 1, waiting + slack + 1))
        else:
            state.remove()
        yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="object") for i, n in enumerate(_NAMES)})

    return step


_NAMES = ["tp_ms", "tags", *[f"{s}{c}{i}" for s in "xy" for i in (0, 1) for c in "tv"]]


def merged(left: DataFrame, right: DataFrame, f: Callable[[Column, Column], Column], slack_ms: int) -> DataFrame:
    """Two streams of vectors (tp_ms, tags, value) joined by tags though their times differ: at each time of either side of a tag set, f of both sides' values, exact or
    interpolated between neighbours within the slack. Each result comes once, when the watermark has passed its time by the slack, so that no neighbour can still come.

    State is kept per tag set and bounded: what lies more than a slack before the last result is dropped, and a silent tag set's state with it. The state finds the
    neighbours; values are interpolated and joined in the JVM, by the kernels that batches use. Of a side's values at one time the last that came counts.
    """
    side = lambda df, n: df.select(F.lit(n).alias("side"), "tp_ms", "tags", "value")
    both = watermarked(side(left, 0).unionByName(side(right, 1)), slack_ms)
    near = both.withColumn("key", F.to_json("tags")).groupBy("key").applyInPandasWithState(_merger(slack_ms), _AROUND, "state binary", "append", GroupStateTimeout.EventTimeTimeout)

    def at(s: str) -> Column:
        v = va.bound(va.interpolate)(*[F.col(c) for c in ("tp_ms", f"{s}t0", f"{s}v0", f"{s}t1", f"{s}v1")])
        return F.when(F.col(f"{s}t1").isNull(), F.col(f"{s}v0")).otherwise(v)

    out = near.select("tp_ms", "tags", at("x").alias("x"), at("y").alias("y")).where("x is not null and y is not null")
    return out.select("tp_ms", "tags", va.bound(f)(F.col("x"), F.col("y")).alias("value"))
