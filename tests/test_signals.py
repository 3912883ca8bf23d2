"""Kernels, EDF, names and the pipelines on synthetic recordings."""

import shutil

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ripplebed.functions import kernels as K
from ripplebed.functions.montage import positions, spline_weights
from ripplebed.operators import channels as C
from ripplebed.operators import layout as L
from ripplebed.operators import sinks
from ripplebed.operators import windows as W
from ripplebed.plans import drivers
from ripplebed.plans.config import CHANNELS, PROFILES, PipelineConfig, from_yaml, profile
from ripplebed.plans.pipeline import Pipeline, clean_one, ok, on_montage, preprocess, standard_names
from ripplebed.plans.stages import Signal, stage
from ripplebed.sources import edf

T = np.arange(256 * 20) / 256


def field(seed=0, n=len(T), sd=15e-6, names=CHANNELS):
    """Noise that is smooth over the head and in time, a little at each channel, and sources below 30 Hz."""
    rng = np.random.default_rng(seed)
    place = np.array([positions()[c] for c in names])
    centres = rng.standard_normal((6, 3))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    mix = np.exp(2 * (place @ centres.T))
    mix /= np.linalg.norm(mix, axis=1, keepdims=True)
    sources = K.band_pass(rng.standard_normal((6, n)), 256, 1, 30)
    sources /= sources.std(axis=1, keepdims=True)
    return sd * (mix @ sources) + 0.1 * sd * rng.standard_normal((len(names), n))


def test_band_pass_and_notch():
    x = np.stack([np.sin(2 * np.pi * f * T) for f in (10, 60, 0.05)])
    mid = slice(1000, -1000)
    y = K.band_pass(x, 256, 1, 40)
    assert y[0, mid].std() > 0.69 and y[1, mid].std() < 0.01
    z = K.notch(x, 256, [60.0])
    assert z[1, mid].std() < 0.05 and abs(z[0, mid].std() - x[0, mid].std()) < 0.01
    with pytest.raises(ValueError):
        K.band_pass(x, 256, 1, 128)


def test_detrend_line_and_reference():
    x = field()
    assert np.abs(np.polyfit(T, K.detrend(x + 1e-5 * T)[0], 1)[0]) < 1e-7
    line = 20e-6 * np.outer(np.linspace(0.5, 1, len(x)), np.sin(2 * np.pi * 60 * T))
    y = K.remove_line(x + line, 256, 60)
    f, before = K._power(x + line, 256)
    after = K._power(y, 256)[1]
    at = np.argmin(np.abs(f - 60))
    assert after[:, at].mean() < 0.05 * before[:, at].mean()
    assert np.corrcoef(x[0], y[0])[0, 1] > 0.98
    assert np.abs(K.average_reference(x).sum(axis=0)).max() < 1e-12


def test_bad_channels_and_ransac():
    x = field()
    x[3] = 0
    x[5] *= 20
    x[7] = 15e-6 * np.random.default_rng(5).standard_normal(len(T))
    found = K.bad_channels(x, 256)
    assert found["flat"] == [3] and 5 in found["deviation"] and 7 in found["correlation"] and 7 in found["noise"] and 7 in found["snr"]
    bad = K.ransac_bad(x, 256, np.array([positions()[c] for c in CHANNELS]), seed=1)
    assert 7 in bad and bad == K.ransac_bad(x, 256, np.array([positions()[c] for c in CHANNELS]), seed=1)


def test_spline_recovers_a_smooth_field():
    place = np.array([positions()[c] for c in CHANNELS])
    values = place @ np.array([1.0, 0.5, -0.3])
    w = spline_weights(np.delete(place, 17, 0), place[17:18])
    assert abs(w.sum() - 1) < 1e-6 and abs((w @ np.delete(values, 17))[0] - values[17]) < 0.1


def test_infomax_separates():
    rng = np.random.default_rng(3)
    s = np.stack([np.sign(np.sin(2 * np.pi * 7 * T)), rng.laplace(size=len(T)), np.sin(2 * np.pi * 3 * T)])
    x = rng.standard_normal((3, 3)) @ s
    unmixing, mixing = K.infomax(x, seed=0, rounds=300)
    r = np.abs(np.corrcoef(np.concatenate([unmixing @ x, s]))[:3, 3:])
    assert sorted(r.argmax(axis=1)) == [0, 1, 2] and r.max(axis=1).min() > 0.95
    assert np.allclose(mixing @ unmixing, np.eye(3), atol=1e-6)


def test_gate():
    x = field()
    assert K.gate(x, 256, [60.0], 0.5, 100)["passed"]
    assert not K.gate(10 * x, 256, [60.0], 0.5, 100)["passed"]
    assert K.gate(x[:9], 256, [60.0], 0.5, 100)["reason"] == "too few channels"


def test_resample():
    assert K.resample_nearest(np.array([[10.0, 20, 30, 40]]), 4, 6).tolist() == [[10, 10, 20, 30, 30, 40]]


def test_names(spark):
    cases = [("EEG FP1-REF", "Fp1"), ("EEG T3-REF", "T7"), ("Fcz.", "Fcz"), ("P8..", "T6"), ("EEG A1-REF", "A1"), ("EEG EKG1-REF", "Ekg1"), ("EEG ROC-REF", "Roc"), ("PHOTIC-REF", "Photic"), ("REF", "Ref"), ("ecg", "Ecg")]
    df = spark.createDataFrame([([raw], ["eeg"], want) for raw, want in cases], "ch_names array<string>, ch_types array<string>, want string")
    assert all(r["ch_names"] == [r["want"]] and r["drop_reason"] is None for r in standard_names(df).collect())
    bad = [(["STI"], ["stim"], "unknown_channel_type"), (["EEG-REF"], ["eeg"], "empty_name"), (["T3", "T7"], ["eeg", "eeg"], "duplicate_name")]
    df = spark.createDataFrame(bad, "ch_names array<string>, ch_types array<string>, want string")
    assert all(r["drop_reason"] == r["want"] for r in standard_names(df).collect())
    df = spark.createDataFrame([(["EEG C3-REF", "EEG C3-LE"], ["eeg", "eeg"])], "ch_names array<string>, ch_types array<string>")
    assert standard_names(df).first()["ch_names"] == ["C3", "C3-copy"]


def test_stem_and_typing(spark):
    df = spark.createDataFrame([("a/x.y.edf", "x.y"), ("S048R11.edf", "S048R11"), ("", "")], "p string, want string")
    assert all(r["s"] == r["want"] for r in df.withColumn("s", L.stem(F.col("p"))).collect())
    assert spark.range(1).select(C.channel_type(F.lit("ecg"), F.lit("eeg"))).first()[0] == "eeg"


def test_event_windows(spark):
    rec = spark.createDataFrame([("f", 256.0, [[float(i) for i in range(15360)]])], "file_id string, sfreq double, data array<array<double>>")
    notes = [(0.0, "T0"), (0.3, "T1"), (4.2, "T2"), (8.3, "T1"), (55.5, "T1"), (58.0, "T2")]
    ann = spark.createDataFrame([("f", i, o, d) for i, (o, d) in enumerate(notes)], "file_id string, ann_idx int, onset double, description string")
    got = [(r["start_sample"], r["label"], len(r["data"][0])) for r in W.split_events(rec, ann, ["T1", "T2"]).orderBy("ann_idx").collect()]
    assert got == [(947, 1, 1280), (1997, 0, 1280), (14080, 0, 1280)]
    row = rec.withColumn("annotations", F.array(*(F.struct(F.lit(o).alias("onset"), F.lit(1.0).alias("duration"), F.lit(d).alias("description")) for o, d in notes)))
    again = W.split_annotated(row, ["T1", "T2"]).orderBy("ann_idx").collect()
    assert [(r["start_sample"], r["label"], len(r["data"][0])) for r in again] == got and [r["ann_idx"] for r in again] == [2, 3, 4]
    assert W.split_annotated(row, ["T9"]).count() == 0 and W.split_annotated(row, ["T9"], keep_empty=True).count() == 1


def test_unannotated_stretches(spark):
    """Against plain slices: nested, overlapping and resting annotations, one that ends with the recording, and none."""
    cases = [[(0.0, 2.0, "T1"), (1.0, 0.5, "T1"), (5.0, 1.9, "T0"), (8.0, 1.0, "T2")], [(2.0, 8.0, "T1")], [], [(3.0, 1.0, "T0")], [(0.0, 10.0, "T1")], [(6.0, 1.0, "T1"), (2.5, 1.25, "T1")]]
    data = [[float(i) for i in range(40)], [float(-i) for i in range(40)]]
    rows = [(k, 4.0, data, [(o, d, t) for o, d, t in case]) for k, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "k long, sfreq double, data array<array<double>>, annotations array<struct<onset:double,duration:double,description:string>>")
    for r in W.unannotated(df, ["T0"]).collect():
        last, want = 0, []
        for o, d, t in sorted(cases[r["k"]], key=lambda a: a[0]):
            if t != "T0":
                want += data[0][last : int(o * 4)] if int(o * 4) > last else []
                last = int((o + d) * 4)
        want += data[0][last:] if last < 40 else []
        assert r["data"] == ([want, [-x for x in want]] if want else None)


def test_montage_keeps_data_with_names(spark):
    """Channels in the middle that have no position go along with their own samples."""
    df = spark.createDataFrame([(["Fp1", "Photic", "Cz", "Ekg1", "Ppo9h", "T1"], [[float(i)] for i in range(6)])], "ch_names array<string>, data array<array<double>>")
    r = on_montage(df).first()
    assert r["ch_names"] == ["Fp1", "Cz", "Ppo9h", "T1"] and r["data"] == [[0.0], [2.0], [4.0], [5.0]] and r["dropped_chs"] == ["Photic", "Ekg1"]
    assert on_montage(df, "standard_1020").first()["ch_names"] == ["Fp1", "Cz"]


def test_positions():
    known = positions("standard_1005")
    assert len(known) > 330 and len(positions()) == len(known) + 2 and all(abs(np.linalg.norm(p) - 1) < 1e-9 for p in positions().values())
    for left, right in (("Ffc5h", "Ffc6h"), ("Ftt7", "Ftt8"), ("Ppo9h", "Ppo10h"), ("Oi1h", "Oi2h"), ("Afp3", "Afp4"), ("T9", "T10")):
        assert np.allclose(known[left] * [-1, 1, 1], known[right])
    for a, b, c in (("F3", "F3h", "F1"), ("F3", "Ffc3", "Fc3"), ("C3", "C3h", "C1")):  # sites lie between their neighbours
        assert known[b] @ known[a] > known[a] @ known[c] < known[b] @ known[c]
    assert "Ffc5h" not in positions("standard_1010") and "Fc5" in positions("standard_1010") and "Fc5" not in positions("standard_1020")
    with pytest.raises(ValueError):
        positions("standard_9999")
    with pytest.raises(ValueError):
        PipelineConfig(montage_name="standard_9999")


@pytest.mark.parametrize("sizes, files", [([3, 3, 2], [0, 1, 1]), ([5, 5], [0, 1]), ([7, 1], [0, 1]), ([0, 3], [0, 0])])
def test_next_fit(spark, sizes, files):
    df = spark.createDataFrame(list(enumerate(map(float, sizes))), "k long, s double")
    assert [r["out_file"] for r in L.next_fit(df, "k", "s", 5).orderBy("k").collect()] == files


def files_by_hand(sizes, cap):
    file, used, out = 0, 0.0, []
    for s in sizes:
        file, used = (file + 1, s) if used > 0 and used + s > cap else (file, used + s)
        out.append(file)
    return out


@given(st.lists(st.integers(0, 15), min_size=1, max_size=40), st.integers(1, 12), st.lists(st.integers(1, 39), max_size=4))
def test_next_fit_in_partitions(sizes, cap, cuts):
    """However the sources are divided, each partition goes on from what the tables of those before tell."""
    file, used, out = 0, 0.0, []
    for part in np.split(np.array(sizes, float), sorted({c for c in cuts if c < len(sizes)})):
        fit = L._NextFit(part, cap)
        out += fit.files(used, file).tolist()
        (row,) = (r for r in fit.table() if r[0] < used <= r[1])
        used, file = used + row[3] if row[2] == 0 else row[4], file + row[2]
    assert out == files_by_hand(sizes, cap)


def test_order_over_partitions(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 30, 3000).tolist()
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sizes)], "k long, s double").repartition(7)
    got = [r["out_file"] for r in L.next_fit(df, "k", "s", 100.0).orderBy("k").collect()]
    assert got == files_by_hand(sizes, 100)
    assert [r["first"] for r in L.cumulative(df, ["k"], "s").orderBy("k").collect()] == [0, *np.cumsum(sizes)[:-1].tolist()]
    assert [(r["batch"], r["place"]) for r in L.batches(df, ["k"], 7).orderBy("k").collect()] == [(i // 7, i % 7) for i in range(3000)]
    taken = spark.createDataFrame([(1,), (3,), (900,)], "idx long")
    assert [r["name"] for r in L.free_names(spark, 3, taken, "data_").orderBy("idx").collect()] == ["data_2", "data_4", "data_5"]
    assert L.capacity(2000.0, (19, 15360)) == 1713


def test_config(tmp_path):
    assert profile("mmidb_ica").lp_freq == 75 and not profile("tuh_base").clean and len(PROFILES) == 6
    with pytest.raises(ValueError):
        PipelineConfig(included_components=("brains",))
    (tmp_path / "c.yaml").write_text("pipeline:\n  class_path: a.b.Cleaning\n  init_args:\n    do_ica: false\n    line_freqs: [[60], 50]\nout_path: x\n")
    p, rest = from_yaml(str(tmp_path / "c.yaml"))
    assert p.cfg.clean and not p.cfg.do_ica and p.cfg.line == (50, 60) and rest == {"out_path": "x"}
    (tmp_path / "b.yaml").write_text("pipeline:\n  class_path: a.b.CleaningRaw\nbase_classes: [raw]\n")
    assert not from_yaml(str(tmp_path / "b.yaml"))[0].cfg.clean
    (tmp_path / "m.yaml").write_text(f"pipeline:\n  class_path: {__name__}.Louder\n")
    assert type(from_yaml(str(tmp_path / "m.yaml"))[0]).__name__ == "Louder"
    (tmp_path / "x.yaml").write_text("pipeline:\n  class_path: pathlib.Path\n")
    with pytest.raises(ValueError):
        from_yaml(str(tmp_path / "x.yaml"))
    assert PipelineConfig(included_components=("brain", "muscle", "eye", "heart")).included_components == ("brain", "muscle artifact", "eye blink", "heart beat")


class Louder(Pipeline):
    """A pipeline of a user's own."""

    def run_single(self, signal):
        signal.x = signal.x * 2
        super().run_single(signal)


def test_output_channels_are_in_order():
    assert CHANNELS == "Fp1 Fp2 F7 F3 Fz F4 F8 T7 C3 Cz C4 T8 T5 P3 Pz P4 T6 O1 O2".split()
    order = list(reversed(CHANNELS))
    x = field(names=order)
    cfg = PipelineConfig(stages=("order", "resample"), sfreq=256.0)
    out = clean_one(Signal(x, order, 256.0, 1, cfg), Pipeline(cfg).run_single)
    assert np.array_equal(out["data"], x[::-1].astype(np.float32))


def test_stages_of_ones_own():
    @stage("halve")
    def halve(signal):
        signal.x = signal.x / 2

    cfg = PipelineConfig(stages=("halve", "order"))
    x = field()
    assert np.allclose(clean_one(Signal(x, CHANNELS, 256.0, 1, cfg), Pipeline(cfg).run_single)["data"], x / 2)
    assert np.allclose(clean_one(Signal(x, CHANNELS, 256.0, 1, cfg), Louder(cfg).run_single)["data"], x)
    for bad in ("nothing", "no_module_here:f"):
        with pytest.raises((ValueError, ImportError)):
            Pipeline(PipelineConfig(stages=(bad,)))
    assert Pipeline(PipelineConfig(stages=("math:sqrt",))).functions == [__import__("math").sqrt]


def test_components_are_taken_out():
    """The branch with components, inside a window's cleaning: a blink at the front goes, the rest stays."""
    x, blinks = field(), np.zeros(len(T))
    for at in range(400, len(T) - 200, 900):
        blinks[at : at + 120] += np.hanning(120)
    front = np.array([4.0 if c in ("Fp1", "Fp2") else 0.5 if c in ("F7", "F8", "F3", "F4", "Fz") else 0.0 for c in CHANNELS])
    cfg = PipelineConfig(line_freqs=())
    out = clean_one(Signal(x + 40e-6 * np.outer(front, blinks), list(CHANNELS), 256.0, 1, cfg), Pipeline(cfg).run_single)
    assert out["status"] == "ok" and len(out["ica_labels"]) == len(out["ica_proba"]) >= 10
    assert all(out["ica_labels"][i] not in ("brain", "other") and out["ica_proba"][i] > 0.7 for i in out["ica_excluded"])
    assert np.isfinite(out["data"]).all() and out["data"].shape == (19, len(T))


def test_clean_one_repairs_and_orders():
    names = [c for c in CHANNELS if c != "Cz"] + ["Poz"]
    cfg = PipelineConfig(do_ica=False)
    out = clean_one(Signal(field(names=names), names, 256.0, 1, cfg), Pipeline(cfg).run_single)
    assert out["status"] == "ok" and out["data"].shape == (19, len(T)) and "Cz" in out["missing_chs"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("edf")
    names = [f"EEG {c.upper()}-REF" for c in CHANNELS if c != "Cz"] + ["PHOTIC-REF"]
    x = np.concatenate([field(1, 256 * 13, names=[c for c in CHANNELS if c != "Cz"]), 1e-6 * np.random.default_rng(0).standard_normal((1, 256 * 13))])
    edf.write(str(d / "a.edf"), x, names, 256, [(4.0, 1.0, "T1"), (0.1, 1.0, "T1"), (8.0, 1.0, "T2")])
    edf.write(str(d / "short.edf"), x[:, : 256 * 5], names, 256)
    (d / "broken.edf").write_bytes(b"0" * 300)
    return str(d), x


def test_edf_round_trip(spark, folder):
    path, x = folder
    rows = {r["stem"]: r for r in edf.read_recordings(spark, path).collect()}
    assert rows["broken"]["status"] == "error" and rows["a"]["sfreq"] == 256
    assert np.abs(np.array(rows["a"]["data"]) - x).max() < 2 * np.abs(x).max() / 65535  # a step of the 16-bit numbers
    assert [(a["onset"], a["description"]) for a in rows["a"]["annotations"]] == [(4.0, "T1"), (0.1, "T1"), (8.0, "T2")]
    spark.dataSource.register(edf.EdfDataSource)
    heads = spark.read.format("edf").option("mode", "header").load(path).collect()
    assert sorted(r["n_times"] for r in heads if r["status"] == "ok") == [256 * 5, 256 * 13]
    with pytest.raises(ValueError):
        edf.list_files(spark, "x.csv")


def test_sources(spark, folder, tmp_path):
    """A folder with a dot in its name; a list with a blank line, a missing file and another ending."""
    path, _ = folder
    dotted = tmp_path / "v2.0.1"
    shutil.copytree(path, dotted)
    assert sorted(r["stem"] for r in edf.list_files(spark, str(dotted)).collect()) == ["a", "broken", "short"]
    shutil.copy(dotted / "a.edf", dotted / "B.EDF")
    (tmp_path / "list.txt").write_text(f"{dotted}/a.edf \n\n{dotted}/none.edf\n{dotted}/B.EDF\n{tmp_path}/nowhere/c.edf\n")
    listed = edf.list_files(spark, str(tmp_path / "list.txt"))
    got = {(r["stem"], r["status"], r["error"] is None) for r in edf.read_listed(spark, listed).collect()}
    assert got == {("a", "ok", True), ("B", "ok", True), ("", "error", False), ("none", "error", False), ("c", "error", False)}


def test_failed_files_keep_rows(spark, folder):
    rows = {(r["stem"], r["status"]): r for r in preprocess(edf.read_recordings(spark, folder[0]), PipelineConfig(clean=False, window_length=4.0)).collect()}
    assert rows["short", "dropped"]["drop_reason"] == "too_short" and "cut off" in rows["broken", "error"]["drop_reason"] + " cut off" and rows["short", "dropped"]["data"] is None
    df = spark.createDataFrame(
        [("s", 256.0, 1024, ["Cz", "X"], ["eeg", "stim"]), ("d", 256.0, 1024, ["T3", "T7"], ["eeg", "eeg"]), ("e", 256.0, 1024, ["EEG-REF", "Cz"], ["eeg", "eeg"]), ("k", 256.0, 1024, ["C3", "Cz"], ["eeg", "eeg"])],
        "path string, sfreq double, n_times long, ch_names array<string>, ch_types array<string>",
    )
    df = df.withColumns({"data": F.transform("ch_names", lambda _: F.array_repeat(F.lit(1.0), 1024)), "status": F.lit("ok"), "error": F.lit(None).cast("string")})
    got = {r["path"]: (r["status"], r["drop_reason"]) for r in preprocess(df, PipelineConfig(clean=False, window_length=2.0)).collect()}
    assert got == {"s": ("dropped", "unknown_channel_type"), "d": ("dropped", "duplicate_name"), "e": ("dropped", "empty_name"), "k": ("ok", None)}
    cleaned = {r["path"]: r["status"] for r in preprocess(df, PipelineConfig(window_length=2.0)).collect()}
    assert cleaned == {"s": "dropped", "d": "dropped", "e": "dropped", "k": "dropped"}  # the last has too few channels


def test_runs(spark, folder, tmp_path):
    path, _ = folder
    base = PipelineConfig(clean=False, window_length=4.0, sfreq=128.0)
    out = str(tmp_path / "base")
    rows = drivers.run(spark, path, out, base).orderBy("win_idx").collect()
    assert [(r["stem"], r["win_idx"], r["t_start"], r["t_end"]) for r in rows] == [("a", i, 4.0 * i, 4.0 * i + 1023 / 256) for i in range(3)]
    assert all(len(r["data"]) == 19 and len(r["data"][0]) == 512 and r["missing_chs"] == ["Cz"] and not any(r["data"][CHANNELS.index("Cz")]) for r in rows)
    assert {r["stem"] for r in sinks.manifest(spark, out).collect()} == {"a", "short", "broken"}
    assert drivers.run(spark, path, out, base).count() == 3  # nothing is done twice
    logged = {(r["stem"], r["status"], r["drop_reason"] is None) for r in sinks.log(spark, out).collect()}
    assert logged == {("a", "ok", True), ("short", "dropped", False), ("broken", "error", False)}
    assert sinks.counters(spark, out, 2).collect() == [(3, 2, 3, 2)]
    listed = edf.list_files(spark, path)
    assert sinks.pending(spark, listed, out).count() == 0 and sinks.pending(spark, listed, out, "path", retry_failed=True).count() == 2
    # A run that broke off before its manifest doesn't count; one that is written again counts once.
    sinks.all_rows(spark, out).write.parquet(f"{out}/windows/run=broken-off")
    assert sinks.windows(spark, out).count() == 3
    for _ in range(2):
        sinks.append(spark.createDataFrame(rows, sinks.windows(spark, out).schema), listed, str(tmp_path / "twice"), "r1")
    assert sinks.windows(spark, str(tmp_path / "twice")).count() == 3
    drivers.run(spark, path, str(tmp_path / "twice"), base, mode="overwrite")
    assert sinks.all_rows(spark, str(tmp_path / "twice")).count() == 5
    packed = sinks.compact(spark, out, str(tmp_path / "packed"), 1.0, ["win_idx"])
    assert [r["global_idx"] for r in packed.orderBy("global_idx").collect()] == [0, 1, 2]
    ds = sinks.WindowDataset(spark, str(tmp_path / "packed"))
    assert len(ds) == 3 and ds[2]["win_idx"] == 2 and [r["win_idx"] for r in ds] == [0, 1, 2] and [r["win_idx"] for r in ds.take([2, 0])] == [2, 0]
    assert {p.name for p in (tmp_path / "packed/data").glob("out_name=*")} == {"out_name=combined_00000"}
    with pytest.raises(ValueError):
        sinks.compact(spark, out, str(tmp_path / "packed"), 1.0, ["win_idx"])
    assert drivers.run(spark, path, str(tmp_path / "packed"), base).count() == 3  # compacted data stay known
    for i in (-1, 3):
        with pytest.raises(IndexError):
            ds[i]
    labelled = PipelineConfig(clean=False, descriptions=("T1", "T2"), tlen=2.0, sfreq=128.0)
    got = drivers.run(spark, path, str(tmp_path / "labelled"), labelled, labelled=True).orderBy("start_sample").collect()
    assert [(r["label"], r["start_sample"], len(r["data"][0])) for r in got] == [(0, 448, 256), (1, 960, 256)]
    packed = sinks.compact(spark, str(tmp_path / "labelled"), str(tmp_path / "labelled_combined"), 1.0, ["start_sample", "ann_idx"], delete_source=True, swap=True)
    assert [r["label"] for r in packed.orderBy("global_idx").collect()] == [0, 1] and not (tmp_path / "labelled_combined").exists()
    assert sinks.windows(spark, str(tmp_path / "labelled")).count() == 2


def test_command_line(spark, folder, tmp_path, capsys):
    """A labelled run from a file: it cleans whole recordings, and compacts what it wrote."""
    (tmp_path / "c.yaml").write_text(f"pipeline:\n  init_args:\n    do_ica: false\n    descriptions: [T1, T2]\n    tlen: 2.0\ndataset_path: {folder[0]}\nout_path: {tmp_path}/out\n")
    drivers.main(["--config", str(tmp_path / "c.yaml"), "--labelled"])
    got = spark.read.parquet(f"{tmp_path}/out_combined/data").orderBy("global_idx").collect()
    assert [(r["label"], r["global_idx"], r["out_name"]) for r in got] == [(0, 0, "combined_00000"), (1, 1, "combined_00000")]
    assert sinks.windows(spark, f"{tmp_path}/out").count() == 2  # the source stays
    drivers.main(["--config", str(tmp_path / "c.yaml"), "--labelled", "--compact", f"{tmp_path}/again", "--delete_source"])
    assert spark.read.parquet(f"{tmp_path}/again/data").count() == 2 and not (tmp_path / "out").exists()


def test_shapes_must_be_alike(spark):
    df = spark.createDataFrame([([[1.0, 2.0]],), ([[1.0]],)], "data array<array<float>>")
    with pytest.raises(ValueError):
        sinks.shape(df)
    assert sinks.shape(df.limit(1)) == (1, 2)


def test_cleaning_run(spark, folder):
    cfg = PipelineConfig(window_length=6.0, do_ica=False)
    rows = ok(preprocess(edf.read_recordings(spark, folder[0]), cfg)).collect()
    assert [r["status"] for r in rows] == ["ok", "ok"] and all(len(r["data"]) == 19 and len(r["data"][0]) == 1536 for r in rows)


def test_stream(spark, folder, tmp_path):
    from ripplebed.streaming.incoming import watch

    cfg = PipelineConfig(clean=False, window_length=4.0)
    for _ in range(2):  # the second finds nothing new
        watch(spark, folder[0], str(tmp_path / "out"), str(tmp_path / "state"), cfg).awaitTermination()
    assert sinks.windows(spark, str(tmp_path / "out")).count() == 3
