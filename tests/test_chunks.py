"""Recordings in chunks against the kernels on whole recordings, and joins by overlap against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplebed.functions import kernels as K
from ripplebed.operators import chunks as C
from ripplebed.operators import intervals as I
from ripplebed.plans import long_recordings as R
from ripplebed.plans.config import PipelineConfig
from ripplebed.sources import edf
from ripplebed.sources import edf_ranges as E

RATE = 100


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("long")
    rng = np.random.default_rng(0)
    t = np.arange(47 * RATE) / RATE
    x = rng.normal(size=(6, len(t))) * 20e-6 + (np.sin(2 * np.pi * 20 * t) * 60e-6) * rng.normal(size=(6, 1))
    edf.write(f"{d}/a.edf", x, list("ABCDEF"), RATE, [(3.5, 1.0, "x"), (6.4, 0.5, "y"), (20.0, 2.0, "x"), (46.8, 1.0, "x"), (0.1, 1.0, "x")])
    edf.write(f"{d}/b c.edf", x[:3, :500] * 0.5, list("ABC"), RATE, [(2.0, 0.0, "y")])
    edf.write(f"{d}/one.edf", x[:1, :1600], ["A"], RATE)
    (d / "bad.edf").write_bytes(b"x" * 100)
    raw = (d / "one.edf").read_bytes()
    (d / "cut.edf").write_bytes(raw[:-200])
    return d


@pytest.fixture(scope="module")
def chunks(spark, folder):
    return E.read_chunks(spark, str(folder), 7.0)


@pytest.fixture(scope="module")
def raw(folder):
    return {k: np.array(edf.parse(k, (folder / k).read_bytes())["data"]) for k in ("a.edf", "b c.edf", "one.edf")}


def whole(df):
    out = {}
    for r in df.where("status = 'ok'").orderBy("path", "start_sample").collect():
        out.setdefault(os.path.basename(r["path"]), []).append(np.array(r["data"]))
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


def alike(got, want):
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert got[k].shape == x.shape and np.abs(got[k] - x).max() <= 1e-9 * np.abs(x).max(), k


def test_chunks_are_the_recording(chunks, raw):
    alike(whole(chunks), raw)
    rows = {(os.path.basename(r["path"]), r["chunk"]): r for r in chunks.drop("data").collect()}
    assert [rows["a.edf", i]["start_sample"] for i in range(7)] == [700 * i for i in range(7)]
    assert [n["onset"] for n in rows["a.edf", 0]["annotations"]] == [3.5, 6.4, 20.0, 46.8, 0.1]
    assert rows["bad.edf", None]["status"] == rows["cut.edf", None]["status"] == "error" and "cut off" in rows["cut.edf", None]["error"]


def test_heads_read_heads_alone(spark, folder, monkeypatch):
    files = edf._listing(spark, str(folder), True).select("path", "length")
    got = {os.path.basename(r["path"]): r for r in E.heads(files).collect()}
    assert got["a.edf"]["n_times"] == 4700 and got["a.edf"]["ch_names"] == list("ABCDEF") and got["bad.edf"]["status"] == "error"
    with open(folder / "a.edf", "rb") as f:
        E.read_head(f)
        assert f.tell() == 256 * 8


@pytest.mark.parametrize("seconds", [2.0, 7.0, 100.0])
def test_filters(spark, folder, raw, seconds):
    """Also where a chunk is shorter than the filters, so that edges come from several neighbours."""
    steps = lambda sfreq: K.notch_steps(sfreq, [20.0]) + K.band_pass_steps(sfreq, 1.0, 40.0)
    assert K.halo(steps(RATE)) > 300
    alike(whole(C.filtered(E.read_chunks(spark, str(folder), seconds), steps)), {k: K.filtered(x, steps(RATE)) for k, x in raw.items()})


def test_filters_of_short_signals():
    rng = np.random.default_rng(1)
    steps = K.band_pass_steps(RATE, 1.0, 40.0)
    for n in (1, 2, 5, 200):
        x = rng.normal(size=(2, n))
        got, start = K.filtered_part(x, 0, n, steps)
        assert start == 0 and np.allclose(got, K.filtered(x, steps), atol=1e-12)


def test_line_noise(chunks, raw):
    want = {k: K.remove_line(x, RATE, 20.0) for k, x in raw.items()}
    alike(whole(C.without_line(chunks, 20.0)), want)
    power = lambda x: np.abs(np.fft.rfft(x)[:, 20 * x.shape[1] // RATE]).sum()
    assert power(want["a.edf"]) < power(raw["a.edf"]) / 10


def test_whitening_and_moments(chunks, raw):
    for k, x in whole(C.whitened(chunks)).items():
        assert np.allclose(np.cov(x, bias=True), np.eye(len(x)), atol=1e-9), k
    for r in C.moments(chunks).collect():
        name = os.path.basename(r["path"])
        if name in raw:
            assert r["n"] == raw[name].shape[1] and np.allclose(r["mean"], raw[name].mean(axis=1), rtol=1e-9, atol=1e-18)
            assert np.allclose(np.array(r["products"]) / r["n"], np.cov(raw[name], bias=True), rtol=1e-9, atol=1e-24)
        else:
            assert r["n"] is None


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 1000)) * [[1], [1e-6], [1e3], [1], [1]] + [[0], [5], [1e6], [0], [-3]]
    parts = [K.Moments.of(p) for p in np.array_split(x, 13, axis=1)]
    for order in (parts, parts[::-1]):
        total = order[0]
        for p in order[1:]:
            total = total + p
        one = K.Moments.of(x)
        assert total.n == 1000 and np.allclose(total.mean, one.mean) and np.allclose(total.products, one.products, rtol=1e-9)


def test_reference_and_rate(chunks, raw):
    alike(whole(C.resampled(C.average_reference(chunks), 64.0)), {k: K.resample_nearest(K.average_reference(x), RATE, 64.0) for k, x in raw.items() if len(x) > 1} | {"one.edf": np.zeros((1, 1024))})


def test_a_missing_chunk_fails_its_neighbours(chunks):
    steps = lambda sfreq: K.band_pass_steps(sfreq, 1.0, 40.0)
    rows = C.filtered(chunks.where("chunk <> 3 or path not like '%/a.edf'"), steps).where("path like '%/a.edf'").select("chunk", "status").collect()
    assert {r["chunk"]: r["status"] for r in rows} == {0: "ok", 1: "ok", 2: "error", 4: "error", 5: "ok", 6: "ok"}


def test_labelled_windows(chunks, raw):
    cfg = PipelineConfig(sfreq=64.0, descriptions=("y", "x"), tmin=-0.5, tlen=5.0, hp_freq=1.0, lp_freq=30.0, line_freqs=(20.0,))
    events = R.events_of(chunks)
    got = {(os.path.basename(r["path"]), r["ann_idx"]): r for r in R.labelled_windows(R.clean(chunks, cfg, ("line_noise", "filter", "average_reference")), events, cfg).collect()}
    want = {}
    onsets = {"a.edf": [(3.5, 1), (6.4, 0), (20.0, 1), (46.8, 1), (0.1, 1)], "b c.edf": [(2.0, 0)]}
    for k, notes in onsets.items():
        x = K.average_reference(K.band_pass(K.remove_line(raw[k], RATE, 20.0), RATE, 1.0, 30.0))
        x = K.resample_nearest(x, RATE, 64.0)
        for i, (onset, label) in enumerate(notes):
            s = round((onset - 0.5) * 64)
            if 0 <= s and s + 320 <= x.shape[1]:
                want[k, i] = (label, s, x[:, s : s + 320])
    assert got.keys() == want.keys() and len(want) == 3
    for key, (label, s, x) in want.items():
        r = got[key]
        assert (r["label"], r["start_sample"], r["status"]) == (label, s, "ok") and np.abs(np.array(r["data"]) - x).max() <= 1e-9 * np.abs(x).max()
    with pytest.raises(ValueError, match="not for chunks"):
        R.clean(chunks, cfg, ("components",))


def test_overlaps(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 4)) if i % 3 else 0, float(rng.integers(-50, 50)) / 2, float(rng.integers(-2, 30)) / 2, i) for i in range(150)] + [(None, 0.0, 5.0, 900), (1, None, 5.0, 901)]
    left = spark.createDataFrame([(g, s, None if s is None else s + n, i) for g, s, n, i in rows], "g int, a double, b double, i long")
    right = left.select("g", F.col("a").alias("c"), F.col("b").alias("d"), F.col("i").alias("j"))
    plain = {(p[3], q[3]) for p in rows for q in rows if p[0] is not None and p[0] == q[0] and None not in (p[1], q[1]) and p[1] < p[1] + p[2] and q[1] < q[1] + q[2] and p[1] < q[1] + q[2] and q[1] < p[1] + p[2]}
    for width in (0.7, 4.0, 1000.0):
        got = [(r["i"], r["j"]) for r in I.overlaps(left, right, ["g"], ("a", "b"), ("c", "d"), width).collect()]
        assert len(got) == len(plain) and set(got) == plain
    points = left.select("g", F.col("a").alias("t"), F.col("i").alias("k"))
    held = {(p[3], q[3]) for p in rows for q in rows if p[0] is not None and p[0] == q[0] and None not in (p[1], q[1]) and q[1] <= p[1] < q[1] + q[2]}
    got = [(r["k"], r["i"]) for r in I.within(points, left, ["g"], "t", ("a", "b"), 3.0).collect()]
    assert len(got) == len(held) and set(got) == held
