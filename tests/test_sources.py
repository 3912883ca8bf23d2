"""The sink that commits by manifest, and filters in the EDF source."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

from ripplebed.operators import sinks
from ripplebed.plans import drivers
from ripplebed.plans.config import PipelineConfig
from ripplebed.sources import committed, edf, edf_ranges
from ripplebed.streaming import incoming


def windows(spark, n, parts=3):
    return spark.range(n).select("id", F.when(F.col("id") % 4 == 0, "dropped").otherwise("ok").alias("status"), F.array(F.array(F.col("id").cast("float"))).alias("data")).repartition(parts)


def test_committed(spark, tmp_path):
    out = "file:" + str(tmp_path / "set")
    committed.write(windows(spark, 100), out, "one")
    committed.write(windows(spark, 20, 1), out, "two")
    assert committed.read(spark, out).count() == 120
    assert committed.counters(spark, out).first().asDict() | {"bytes": 0} == {"runs": 2, "files": 4, "bytes": 0, "windows": 90, "dropped": 30}
    assert committed.counters(spark, out).first()["bytes"] == sum(p.stat().st_size for p in (tmp_path / "set/data").glob("*.parquet"))
    committed.write(windows(spark, 10, 1), out, "two")  # tried again
    assert committed.read(spark, out).count() == 110 and len(list((tmp_path / "set/data").iterdir())) == 4
    committed.fold(out)
    assert len(list((tmp_path / "set/manifest").iterdir())) == 1 and committed.read(spark, out).count() == 110
    committed.write(windows(spark, 30, 2), out, "two")
    committed.write(windows(spark, 0), out, "none")
    assert committed.read(spark, out).count() == 130 and committed.counters(spark, out).first()["runs"] == 3
    committed.write(windows(spark, 5).withColumn("more", F.lit(1)), out, "wider")
    assert committed.read(spark, out).where("more is null").count() == 130
    assert committed.vacuum(out) == [] and committed.verify(spark, out).count() == 0
    committed.write(windows(spark, 7, 1), out, "all", overwrite=True)
    assert committed.read(spark, out).count() == 7 and len(list((tmp_path / "set/data").iterdir())) == 1


def test_what_breaks_off_is_never_read(spark, tmp_path):
    out = str(tmp_path / "set")
    committed.write(windows(spark, 50), out, "good")
    broken = windows(spark, 1000, 4).withColumn("id", F.when((F.spark_partition_id() == 3) & (F.col("id") > 500), F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    for run in ("bad", "good"):
        with pytest.raises(Exception, match="lost"):
            committed.write(broken, out, run)
        assert committed.read(spark, out).count() == 50 and committed.counters(spark, out).first()["runs"] == 1
    # What tasks that were killed would leave.
    (tmp_path / "set/data/.bad-00000-x.parquet.part").write_bytes(b"x")
    (tmp_path / "set/data/bad-00001-y.parquet").write_bytes(b"y")
    assert committed.read(spark, out).count() == 50
    committed.vacuum(out)
    assert len(list((tmp_path / "set/data").iterdir())) == 3 and committed.read(spark, out).count() == 50


def test_sequential_names(spark, tmp_path):
    out = str(tmp_path / "set")
    committed.write(windows(spark, 30, 2), out, "one", names="sequential")
    committed.write(windows(spark, 30, 1), out, "two", names="sequential")
    name = lambda: sorted(p.name for p in (tmp_path / "set/data").iterdir())
    assert name() == ["data_1.parquet", "data_2.parquet", "data_3.parquet"]
    committed.write(windows(spark, 10, 1), out, "one", names="sequential")
    assert name() == ["data_3.parquet", "data_4.parquet"] and committed.verify(spark, out).count() == 0
    committed.write(windows(spark, 10, 1), out, "three", names="sequential")
    assert name() == ["data_1.parquet", "data_3.parquet", "data_4.parquet"] and committed.read(spark, out).count() == 50


def test_paths_read_in_tasks(spark, recordings):
    names = ["", *(f"file:{p}" for p in sorted(recordings.glob("*.edf"))), f"file:{recordings}/absent.edf"]
    paths = spark.createDataFrame([(n,) for n in [*names, names[1]]], "path string")
    got = {r["path"]: r for r in edf_ranges.read_paths(paths).collect()}
    want = {r["path"]: r for r in edf.read_listed(spark, paths.distinct()).collect()}
    assert got.keys() == want.keys() == set(names)
    for k, r in want.items():
        assert got[k]["data"] == r["data"] and got[k]["status"] == r["status"] and got[k]["stem"] == r["stem"]
    assert got[""]["error"] == "blank path" and got[names[-1]]["error"] == "no such file"


def test_windows_of_odd_shapes(spark, tmp_path):
    shapes = [(2, 4), (2, 3), (1, 4), (3, 6)]
    rows = [(f"p{i}", f"p{i}", 0, [[float(10 * c + t) for t in range(n)] for c in range(k)], "ok", None) for i, (k, n) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "path string, stem string, start_sample long, data array<array<float>>, status string, drop_reason string")
    sinks.append(df, df.select("path", "stem"), str(tmp_path / "runs"), "one")
    with pytest.raises(ValueError, match="different shapes"):
        sinks.compact(spark, str(tmp_path / "runs"), str(tmp_path / "no"), 1.0, ["start_sample"])
    got = {r["path"]: r for r in sinks.compact(spark, str(tmp_path / "runs"), str(tmp_path / "packed"), 1.0, ["start_sample"], fit=(2, 4)).collect()}
    assert {p: r["fitted"] for p, r in got.items()} == {"p0": None, "p1": "2x3", "p2": "1x4", "p3": "3x6"}
    assert got["p0"]["data"] == got["p3"]["data"] == [[0, 1, 2, 3], [10, 11, 12, 13]]
    assert got["p1"]["data"] == [[0, 1, 2, 0], [10, 11, 12, 0]] and got["p2"]["data"] == [[0, 1, 2, 3], [0, 0, 0, 0]]


def test_verify_finds_damage(spark, tmp_path):
    out = str(tmp_path / "set")
    committed.write(windows(spark, 90), out, "one")
    one, two, _ = sorted((tmp_path / "set/data").iterdir())
    raw = bytearray(one.read_bytes())
    raw[20] ^= 1
    one.write_bytes(raw)
    two.unlink()
    assert {(r["file"], r["fault"]) for r in committed.verify(spark, out).collect()} == {(one.name, "another checksum"), (two.name, "missing")}


def test_nothing_committed(spark, tmp_path):
    assert committed.manifest(spark, str(tmp_path / "no")).count() == 0
    with pytest.raises(Exception, match="no run has ended"):
        committed.read(spark, str(tmp_path / "no"))


def test_run_committed(spark, tmp_path):
    rng = np.random.default_rng(0)
    names = [f"EEG {c}-REF" for c in ("FP1", "F7", "FZ", "C3")]
    for i in range(3):
        edf.write(str(tmp_path / f"r{i}.edf"), rng.normal(size=(4, 300)) * 1e-5, names, 100)
    (tmp_path / "bad.edf").write_bytes(b"x")
    cfg = PipelineConfig(clean=False, window_length=1.0, sfreq=50.0, channels=("Fp1", "Fz"))
    out = str(tmp_path / "set")
    first = drivers.run_committed(spark, str(tmp_path), out, cfg).first()
    assert (first["runs"], first["windows"], first["dropped"]) == (1, 9, 1)
    edf.write(str(tmp_path / "r9.edf"), rng.normal(size=(4, 200)) * 1e-5, names, 100)
    again = drivers.run_committed(spark, str(tmp_path), out, cfg).first()
    assert (again["runs"], again["windows"], again["dropped"]) == (2, 11, 1)
    assert drivers.run_committed(spark, str(tmp_path), out, cfg).first()["runs"] == 2


@pytest.fixture
def recordings(tmp_path):
    rng = np.random.default_rng(1)
    for i, n in enumerate((200, 400, 3000)):
        edf.write(str(tmp_path / f"r{i}.edf"), rng.normal(size=(3, n)) * 1e-5, list("ABC"), 100)
    (tmp_path / "bad.edf").write_bytes(b"x" * 300)
    return tmp_path


def test_filters_reach_the_source(spark, recordings, capfd):
    spark.dataSource.register(edf.EdfDataSource)
    assert spark.read.format("edf").load(str(recordings)).where("duration > 3.5").count() == 2  # without it Spark filters
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("edf").option("pushdown", "true").load(str(recordings))
    assert {r["path"][-7:]: r["n_times"] for r in df.select("path", "n_times").collect()} == {"r0.edf"[-7:].rjust(7, "/"): 200, "/r1.edf": 400, "/r2.edf": 3000, "bad.edf": None}
    cases = {"duration > 3.5": {400, 3000}, "n_times <= 400 and path like '%r1.edf'": {400}, "status = 'ok' and sfreq = 100": {200, 400, 3000}, "status = 'error'": {None}, "n_times in (200, 3000) and size(ch_names) = 3": {200, 3000}}
    for where, want in cases.items():
        assert {r["n_times"] for r in df.where(where).collect()} == want, where
    df.where("duration > 3.5 and size(ch_names) = 3").explain("formatted")
    plan = capfd.readouterr().out
    assert "PushedFilters" in plan or "PushedPredicates" in plan or "Pushed" in plan
    assert "Filter" in plan and "duration" not in plan.split("Condition", 1)[-1].split("\n")[0]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_filtered_file_is_not_read(recordings, monkeypatch):
    reader = edf.FilteringEdfReader([str(p) for p in sorted(recordings.glob("*.edf"))], True)
    left = list(reader.pushFilters([GreaterThan(("duration",), 3.5), StringContains(("path",), "r"), EqualTo(("ch_names",), [])]))
    assert len(left) == 1 and len(reader.partitions()) >= 3
    told = []

    class Counted:
        def __init__(self, path, mode):
            self.f = real(path, mode)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n=-1):
            raw = self.f.read(n)
            told.append(len(raw))
            return raw

    real = open
    monkeypatch.setattr("builtins.open", lambda p, m="r", *a, **k: Counted(p, m) if str(p).endswith(".edf") else real(p, m, *a, **k))
    bytes_of = {}
    for part in reader.partitions():
        told.clear()
        rows = list(reader.read(part))
        bytes_of[part.file if hasattr(part, "file") else part.path] = (sum(told), len(rows))
    monkeypatch.undo()
    by_name = {k[-6:]: v for k, v in bytes_of.items()}
    assert by_name["r0.edf"] == (256 * 5, 0) and by_name["r2.edf"][0] > 18_000 and by_name["r2.edf"][1] == 1


def test_stream_into_the_committed_sink(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    (tmp_path / "in").mkdir()
    cfg = PipelineConfig(clean=False, window_length=1.0, sfreq=50.0, channels=("Fp1", "Fz"))
    monkeypatch.setattr(incoming, "FOLDED", 2)
    out, want = str(tmp_path / "set"), 0
    for i in range(4):
        edf.write(str(tmp_path / f"in/r{i}.edf"), rng.normal(size=(2, 300)) * 1e-5, ["FP1", "FZ"], 100)
        incoming.watch(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint"), cfg, into="committed").awaitTermination()
        want += 3
        assert committed.counters(spark, out).first()["windows"] == want == committed.read(spark, out).where("status = 'ok'").count()
        assert len(list((tmp_path / "set/manifest").glob("*.json"))) == 1 + (i % 2 == 0 and i > 0)
    with pytest.raises(ValueError):
        incoming.watch(spark, str(tmp_path), out, out, cfg, into="elsewhere")
