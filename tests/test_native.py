import gzip
import time
from pathlib import Path

import pytest

from tsq.sources import native

T0, T1 = 315_561_600_000, 631_184_400_000
H = ((0.0, 1.0, 2.0), (3.0, 4.0, 5.0))
SCRAPES = [
    (T0, {(("test", "histogram"), (("true", True),)): {("hist", "o", "gram"): H}, (("test", "int"), (("false", False),)): {("i", "n", "t"): 42}}),
    (T1, {(("test", "histogram"), ()): {("hist", "o", "gram"): H}, (("test", "flt"), ()): {("f", "l", "o", "a", "t"): 2.718281828459045}, (("test", "empty"), ()): {("value",): None}, (("test", "string"), ()): {("value",): "a string", ("another",): "string"}}),
    (T1 + 1, {(("test", "int"), (("a", "x"), ("b", 2.5))): {("i",): v, ("j",): -v} for v in (40_000,)} | {(("big",), ()): {("k",): 1 << 40, ("flag",): True, ("no",): False}}),
]


def norm(scrapes):
    fix = lambda v: tuple(map(tuple, v)) if isinstance(v, list) else v
    return [(t, {g: {m: fix(v) for m, v in ms.items()} for g, ms in gs.items()}) for t, gs in scrapes]


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("version", ["0", "1", "2", "2t"])
def test_round_trip(tmp_path, version, packed):
    p = tmp_path / "f"
    p.write_bytes(native.encode(reversed(SCRAPES), version, packed))
    assert native.is_history(str(p)) and native.bounds(str(p)) == (T0, T1 + 1)
    assert norm(native.read_file(str(p))) == SCRAPES


@pytest.mark.parametrize("version", ["0", "1", "2"])
def test_append_to_a_new_file(tmp_path, version):
    p = str(tmp_path / "f")
    native.new_file(p, version)
    assert list(native.read_file(p)) == []
    for s in (SCRAPES[1], SCRAPES[2], SCRAPES[0]):
        native.append(p, s)
    assert sorted(norm(native.read_file(p)), key=lambda s: s[0]) == SCRAPES and native.bounds(p) == (T0, T1 + 1)


def test_what_can_t_be_written(tmp_path):
    for name, data in (("gz", native.encode(SCRAPES, "0", True)), ("tables", native.encode(SCRAPES, "2t"))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(native.FormatError):
            native.append(str(tmp_path / name), SCRAPES[0])
    with pytest.raises(native.FormatError):
        native.new_file(str(tmp_path / "new"), "7")


def test_damage_is_noticed_and_other_files_are_none(tmp_path):
    data = bytearray(native.encode(SCRAPES, "2"))
    data[90] ^= 1
    (tmp_path / "bad").write_bytes(data)
    with pytest.raises(native.FormatError):
        list(native.read_file(str(tmp_path / "bad")))
    (tmp_path / "text").write_text("x")
    (tmp_path / "gz").write_bytes(gzip.compress(b"nothing"))
    assert not any(native.is_history(str(tmp_path / n)) for n in ("text", "gz", "absent", "."))


@pytest.mark.parametrize("n", [0, 1, 32766, 32767, 32768, 70000])
def test_bitset_runs(n):
    for bits in ([True] * n + [False], [False] * n + [True, False, True]):
        o = native._Out()
        o.bits(bits)
        assert native._In(bytes(o.data)).bits() == bits


@pytest.mark.parametrize("version", ["0", "1", "2", "2t"])
def test_data_source(spark, tmp_path, data, version):
    from tsq.sources import samples as sm

    spark.dataSource.register(native.HistoryFiles)
    s = sm.of_events(spark, data)
    folder = str(tmp_path / "h")
    s.repartitionByRange(3, "tp_ms").write.format("history").option("version", version).mode("append").save(folder)
    back = spark.read.format("history").load(folder)
    assert back.count() == s.count() and s.exceptAll(back.select(s.columns)).count() == 0
    lo, hi = 1704200000000, 1704900000000
    part = spark.read.format("history").option("begin", lo).option("end", hi).load(folder)
    assert part.count() == s.where(f"tp_ms between {lo} and {hi}").count()


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "file://localhost{}"])
def test_folders_by_path_and_by_uri(spark, tmp_path, form):
    """Spark's own folders, such as that of the checkpoints, are named file:/folder."""
    spark.dataSource.register(native.HistoryFiles)
    folder = form.format(tmp_path / "a b")
    s = spark.createDataFrame([(T0, ["g"], [], ["m"], native._mv(1.5))], native.SAMPLES_DDL)
    s.write.format("history").mode("append").save(folder)
    assert len(list((tmp_path / "a b").glob("*.tsd"))) == 1
    assert spark.read.format("history").load(folder).count() == 1


def test_other_file_systems_are_refused():
    for folder in ("hdfs://node/h", "s3a://bucket/h", "file:relative", "file://node/h"):
        with pytest.raises(ValueError):
            native._Reader({"path": folder})


@pytest.mark.parametrize("name", ["native_1", "native_2_tables", "native_0", "native_2_list", "native_range"])
def test_queries_write_beside_the_checkpoints(spark, data, monkeypatch, name):
    """Whichever folder the driver and the workers run in."""
    from tsq import platform_queries as pq

    folders = []
    monkeypatch.setattr(pq, "scratch", lambda s, n, f=pq.scratch: folders.append(f(s, n)) or folders[-1])
    assert pq.queries()[name](spark, data).count()
    (folder,) = folders
    assert list(Path(folder.removeprefix("file:")).glob("*.tsd"))


def test_a_series_of_a_table_costs_what_it_holds(tmp_path):
    """Not a look at each of the block's times: 5000 series of a sample each, at 5000 times."""
    n = 5000
    scrapes = [(T0 + i, {(("g",), (("x", i),)): {("m",): 0.5 * i}}) for i in range(n)]
    began = time.process_time()
    (tmp_path / "f").write_bytes(native.encode(scrapes, "2t"))
    assert list(native.read_file(str(tmp_path / "f"))) == scrapes
    assert time.process_time() - began < 5
