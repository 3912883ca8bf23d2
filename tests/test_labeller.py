"""The labeller trained on simulated components, and resampling with a low-pass."""

import numpy as np
import pytest

from ripplebed.functions import kernels as K
from ripplebed.functions import labeller as L
from ripplebed.plans.config import CHANNELS, PipelineConfig
from ripplebed.plans.stages import Signal, components, resample


def accuracy(label, seed, sfreq, line):
    found, y, places = L.examples(40, seed, sfreq, line)
    got = [label(s[None], m[:, None], sfreq, places, [line])[0] for s, m in found]
    right = np.array([K.LABELS.index(name) == k for (name, _), k in zip(got, y, strict=True)])
    return right.mean(), right, np.array([p for _, p in got])


@pytest.mark.parametrize("sfreq, line", [(256.0, 60.0), (160.0, 50.0)])
def test_held_out_components(sfreq, line):
    ours, right, p = accuracy(L.labeller("simulated"), 1234, sfreq, line)
    plain, _, _ = accuracy(L.labeller("heuristic"), 1234, sfreq, line)
    assert ours > 0.85 and ours > plain + 0.1
    assert abs(p.mean() - right.mean()) < 0.08  # probabilities mean what they say


def test_gradient():
    """The fit's slope against finite differences of the loss."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 4, 50)
    m = L.Regression(x.mean(axis=0), x.std(axis=0), rng.normal(size=(7, 4)))
    loss = lambda: -np.log(m.probabilities(x)[np.arange(50), y]).mean()
    slope = m._inputs(x).T @ (m.probabilities(x) - np.eye(4)[y]) / 50
    for i, j in ((0, 0), (3, 2), (6, 3)):
        kept = m.weights[i, j]
        m.weights[i, j] = kept + 1e-6
        up = loss()
        m.weights[i, j] = kept - 1e-6
        down = loss()
        m.weights[i, j] = kept
        assert slope[i, j] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    fitted = L.Regression.fit(x[:, :1] * 0 + y[:, None] * 2.0 + rng.normal(size=(50, 1)) * 0.1, y, 4)
    assert (fitted.probabilities(y[:, None] * 2.0).argmax(axis=1) == y).mean() > 0.9


def test_stage_with_each_labeller():
    """A planted line in one direction goes with either labeller; the default is the heuristic."""
    rng = np.random.default_rng(2)
    t = np.arange(2560) / 256
    places = [c for c in CHANNELS]
    x = np.cumsum(rng.normal(size=(19, 2560)), axis=1) * 1e-6
    x = x - x.mean(axis=1, keepdims=True)
    pattern = rng.normal(size=(19, 1)) * 20e-6
    for name in ("heuristic", "simulated"):
        s = Signal(x + pattern * np.sin(2 * np.pi * 60 * t), list(places), 256.0, 1, PipelineConfig(labeller=name))
        components(s)
        at = lambda y: np.abs(np.fft.rfft(y)[:, 600]).sum()
        keep = [places.index(n) for n in s.names]
        assert "line noise" in s.told["ica_labels"] and at(s.x) < at((x + pattern * np.sin(2 * np.pi * 60 * t))[keep]) / 3
    assert PipelineConfig().labeller == "heuristic"
    with pytest.raises(ValueError):
        L.labeller("unheard of")
    assert L.labeller("ripplebed.functions.labeller:simulated_labels") is L.simulated_labels


@pytest.mark.parametrize("old, new", [(512, 256), (250, 256), (500, 128), (100, 256), (256, 256), (512, 100)])
def test_polyphase(old, new):
    t = np.arange(8 * old) / old
    n = int(np.floor(len(t) * new / old))
    inner = slice(n // 8, -n // 8)
    low = 0.3 * min(old, new) / 2
    got = K.resample_polyphase(np.sin(2 * np.pi * low * t)[None], old, new)[0]
    assert len(got) == n and np.abs(got - np.sin(2 * np.pi * low * np.arange(n) / new))[inner].max() < 2e-3
    if new < old:
        high = 1.05 * new / 2
        tone = np.sin(2 * np.pi * high * t)[None]
        assert np.abs(K.resample_polyphase(tone, old, new)[0, inner]).max() < 1e-3 < 0.5 < np.abs(K.resample_nearest(tone, old, new)[0, inner]).max()


def test_polyphase_is_asked_for():
    x = np.random.default_rng(0).normal(size=(2, 500))
    for name, f in K.RESAMPLERS.items():
        s = Signal(x.copy(), ["Fz", "Cz"], 250.0, 0, PipelineConfig(sfreq=100.0, resampling=name))
        resample(s)
        assert np.array_equal(s.x, f(x, 250.0, 100.0)) and s.x.shape == (2, 200)
    assert PipelineConfig().resampling == "nearest"
    for n in (1, 2, 7):
        assert K.resample_polyphase(np.ones((1, n)), 100, 50).shape[1] == n // 2 and np.allclose(K.resample_polyphase(np.ones((1, n)), 50, 100), 1, atol=1e-3)
