import random
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tsq.schema import SAMPLES_DDL
from tsq.sources import native
from tsq.sources import native_columns as nc

VALUES = [None, True, False, 0, 1, -1, -(1 << 63), (1 << 63) - 1, 0.5, -0.0, float("inf"), "", "a", "abcd", "äö€", (), ((0.0, 1.0, 2.0), (3.0, 4.0, 5.5))]
PATHS = [(), ("",), ("a",), ("a", "b"), ("ab",), ("", "")]
TAGS = [(), (("a", 1),), (("a", True),), (("a", "x"), ("b", 2.5)), (("b", None),), (("c", ((1.0, 2.0, 3.0),)),)]
FIELDS = ("kind", "b", "i", "u", "d", "s", "h")
VERSIONS = ["0", "2"]


@pytest.fixture(scope="module")
def schema(spark):
    return to_arrow_schema(StructType.fromDDL(SAMPLES_DDL))


def shuffled(spark) -> int:
    """Bytes that the session wrote to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.3)  # the store is brought up to date every 0.1 s
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def read(path, schema, begin=None, end=None):
    out = {}
    for b in nc.read_batches(str(path), schema, begin, end):
        b.validate(full=True)
        for r in b.to_pylist():
            tags = tuple((t["k"], native._plain(t["v"])) for t in r["tags"])
            key = r["tp_ms"], tuple(r["grp"]), repr(tags), tuple(r["metric"])
            assert key not in out
            out[key] = r["value"]["kind"], repr(native._plain(r["value"]))
    return out


@pytest.mark.parametrize("version", VERSIONS)
@pytest.mark.parametrize("n, times", [(1, [5]), (60, [1]), (900, [-7, 0, 3, 1 << 41]), (900, list(range(-300, 300)))])
def test_batches_to_a_file_and_back(tmp_path, schema, version, n, times):
    """Of equal series and times the later counts; files of either code are read by the other's reader."""
    rnd = random.Random(n)
    rows, want = [], {}
    for _ in range(n):
        t, g, tags, m, v = (rnd.choice(x) for x in (times, PATHS, TAGS, PATHS, VALUES))
        mv = lambda x: dict(zip(FIELDS, native._mv(x)))
        rows.append({"tp_ms": t, "grp": g, "tags": [{"k": k, "v": mv(x)} for k, x in rnd.sample(tags, len(tags))], "metric": m, "value": mv(v)})
        want[t, g, repr(tags), m] = native._mv(v)[0], repr(v)
    s = nc.collect(pa.Table.from_pylist(rows, schema).to_batches(101), version == "0")
    (tmp_path / "f").write_bytes({"0": nc.encode0, "2": nc.encode2}[version](s))
    assert read(tmp_path / "f", schema) == want
    assert native.bounds(str(tmp_path / "f")) == (min(times := [k[0] for k in want]), max(times))
    assert read(tmp_path / "f", schema, times[0], times[0]) == {k: v for k, v in want.items() if k[0] == times[0]}
    # as Python objects, where true and 1 are one key, so without those
    plain = {k: v for k, v in want.items() if k[2] not in (repr(TAGS[1]), repr(TAGS[2]))}
    found = {(t, g, repr(tags), m): (native._mv(v)[0], repr(v)) for t, gs in native.read_file(str(tmp_path / "f")) for (g, tags), ms in gs.items() for m, v in ms.items()}
    assert {k: v for k, v in found.items() if k in plain} == plain
    (tmp_path / "old").write_bytes(native.encode(s.scrapes(), version))
    assert {k: v for k, v in read(tmp_path / "old", schema).items() if k in plain} == plain


def test_the_greatest_number_counts(schema):
    mv = lambda x: dict(zip(FIELDS, native._mv(x)))
    rows = [{"tp_ms": 1, "grp": ["g"], "tags": None, "metric": ["m"], "value": mv(x), "id": i} for x, i in (("b", 2), ("c", 3), ("a", 1), ("none", None))]
    s = nc.collect(pa.Table.from_pylist(rows, schema.append(pa.field("id", pa.int64()))).to_batches(2), True, "id")
    assert list(s.scrapes()) == [(1, {(("g",), ()): {("m",): "c"}})]


def test_what_is_missing_is_refused(schema):
    row = {"tp_ms": 1, "grp": ["g"], "tags": [], "metric": ["m"], "value": dict(zip(FIELDS, native._mv(1)))}
    for column in ("tp_ms", "grp", "metric", "value"):
        with pytest.raises(native.FormatError):
            nc.collect(pa.Table.from_pylist([row | {column: None}], schema).to_batches(), True)


@pytest.mark.parametrize("version", VERSIONS)
def test_damage_is_noticed(tmp_path, schema, version):
    scrapes = [(1, {(("g",), ()): {("m",): "text", ("n",): 1}}), (2, {(("g",), ()): {("m",): 0.5}})]
    data = native.encode(scrapes, version)
    (tmp_path / "f").write_bytes(data[:-4])
    with pytest.raises(native.FormatError):
        read(tmp_path / "f", schema)


@pytest.mark.parametrize("name", ["native_0", "native_2_list"])
def test_rows_move_once_and_packed(spark, data, name):
    """The files take most of the disk that a query may use, so shuffles mustn't: 5 times the input is too much."""
    from tsq import platform_queries as pq

    before = shuffled(spark)
    pq.queries()[name](spark, data)
    assert 0 < shuffled(spark) - before < 2.5 * Path(data, "collection_elements.parquet").stat().st_size


def test_parts_by_time(spark):
    from tsq.sources import samples as sm

    rows = [(t, ["g"], [], ["m"], native._mv(float(t))) for t in [*range(100), 7, 7, 1 << 50]]
    s = spark.createDataFrame(rows, SAMPLES_DDL)
    parts = sm.by_time(s, s, 4).rdd.mapPartitions(lambda x: [sorted(r["tp_ms"] for r in x)]).collect()
    assert len(parts) == 4 and sum(map(len, parts)) == len(rows) and max(map(len, parts)) < 40
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))
    assert sm.by_time(s.limit(0), s.limit(0), 4).count() == 0 and sm.by_time(s, s, 1).count() == len(rows)
    assert sm.with_lists(s).where("value.h is null").count() == 0 and sm.with_lists(s).count() == len(rows)


def test_a_list_by_columns(tmp_path, schema):
    """Its samples are read in batches: 20 000 scrapes of two samples each."""
    scrapes = [(k, {(("g",), (("host", f"h{k % 50}"),)): {("m",): 0.5 * k, ("n",): "text"}}) for k in range(20_000)]
    (tmp_path / "f").write_bytes(native.encode(scrapes, "2"))
    batches = list(nc.read_batches(str(tmp_path / "f"), schema, None, None))
    assert sum(b.num_rows for b in batches) == 40_000 and max(b.num_rows for b in batches) == nc.BATCH
    (tmp_path / "g").write_bytes(nc.encode2(nc.collect(batches, False)))
    assert list(native.read_file(str(tmp_path / "g"))) == scrapes
