"""A labeller of independent components that is trained here, on simulated ones.

Components of the seven classes are simulated by what is published of their spectra, time
courses and maps, described by fourteen features, and told apart by a multinomial
regression that is fitted in numpy.  Its probabilities are calibrated by a temperature on
components that it wasn't fitted on.  Nothing is read: the training set is bounded
(``EXAMPLES`` components of each class, ``SECONDS`` long) and follows from a seed.

It knows simulated components and makes no claim about decisions of classifiers trained
on labelled recordings; a labeller of one's own is named in a configuration as
``module:function`` (sources, mixing, sfreq, places, line frequencies -> labels with
probabilities).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from importlib import import_module

import numpy as np

from ripplebed.functions import kernels as K
from ripplebed.functions.montage import positions

EXAMPLES, SECONDS = 240, 12
#: Edges in Hz of the bands whose shares are features.
BANDS = (1, 4, 7, 13, 20, 30, 45, 70)
Labels = list[tuple[str, float]]
Labeller = Callable[[np.ndarray, np.ndarray, float, np.ndarray, list[float]], Labels]


def _coloured(rng: np.random.Generator, n: int, sfreq: float, power: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Noise of a given power spectrum, of variance 1."""
    f = np.fft.rfftfreq(n, 1 / sfreq)
    x = np.fft.irfft(np.fft.rfft(rng.normal(size=n)) * np.sqrt(power(np.maximum(f, 0.5))), n)
    return x / x.std()


def _pulses(rng: np.random.Generator, n: int, sfreq: float, every: float, jitter: float, shape: np.ndarray) -> np.ndarray:
    x, at = np.zeros(n + len(shape)), rng.uniform(0, every) * sfreq
    while at < n:
        x[int(at) : int(at) + len(shape)] += shape * rng.uniform(0.7, 1.3)
        at += max(0.2, every * (1 + jitter * rng.normal())) * sfreq
    return x[:n]


def simulate(label: str, rng: np.random.Generator, sfreq: float, places: np.ndarray, line: float, seconds: float = SECONDS) -> tuple[np.ndarray, np.ndarray]:
    """Time course and map of a component of a class."""
    n = int(seconds * sfreq)
    back = _coloured(rng, n, sfreq, lambda f: f ** -rng.uniform(0.8, 2.0))
    centre = places[rng.integers(len(places))] + 0.3 * rng.normal(size=3)
    near = np.exp(-np.sum((places - centre) ** 2, axis=1) / rng.uniform(0.3, 1.2)) * rng.choice([-1, 1])
    tilt = places @ rng.normal(size=3)
    if label == "brain":
        peak = rng.uniform(7.5, 13)
        x = back + rng.uniform(0.3, 1.5) * _coloured(rng, n, sfreq, lambda f: np.exp(-((f - peak) ** 2) / 3)) * (1 + 0.5 * _coloured(rng, n, sfreq, lambda f: f < 1.0))
        return x, near + 0.2 * tilt
    if label == "muscle artifact":
        edge = places[np.argmax(np.hypot(places[:, 0], places[:, 1]) + 0.4 * rng.random(len(places)))]
        x = _coloured(rng, n, sfreq, lambda f: 1 / (1 + np.exp(-(f - rng.uniform(18, 30)) / 4))) * (1 + rng.uniform(0, 1) * np.abs(_coloured(rng, n, sfreq, lambda f: f < 1.0)))
        return x + 0.2 * back, np.exp(-np.sum((places - edge) ** 2, axis=1) / rng.uniform(0.1, 0.4))
    if label == "eye blink":
        width = int(rng.uniform(0.2, 0.4) * sfreq)
        x = _pulses(rng, n, sfreq, rng.uniform(1.5, 4), 0.3, np.hanning(width))
        return 4 * x / max(x.std(), 1e-9) / 3 + 0.25 * back, np.maximum(places[:, 1], 0) ** rng.uniform(2, 4) + 0.05 * rng.normal(size=len(places))
    if label == "heart beat":
        beat = np.concatenate([-0.2 * np.hanning(int(0.03 * sfreq) + 2), np.hanning(int(0.05 * sfreq) + 3), -0.3 * np.hanning(int(0.04 * sfreq) + 2), np.zeros(int(0.1 * sfreq)), 0.2 * np.hanning(int(0.15 * sfreq))])
        x = _pulses(rng, n, sfreq, rng.uniform(0.6, 1.2), 0.04, beat)
        return x / x.std() + 0.25 * back, tilt
    if label == "line noise":
        t = np.arange(n) / sfreq
        x = np.sin(2 * np.pi * line * t + rng.uniform(0, 6)) + rng.uniform(0, 0.4) * np.sin(4 * np.pi * line * t) * (2 * line < sfreq / 2)
        return x + rng.uniform(0.05, 0.5) * back, rng.normal(size=len(places)) + tilt
    if label == "channel noise":
        one = np.zeros(len(places))
        one[rng.integers(len(places))] = 1
        return _coloured(rng, n, sfreq, lambda f: f ** -rng.uniform(0, 2.5)) + _pulses(rng, n, sfreq, rng.uniform(2, 9), 0.5, np.exp(-np.arange(int(0.2 * sfreq)) / 9)) * rng.uniform(0, 4), one + 0.04 * rng.normal(size=len(places))
    a, b = rng.choice(["brain", "muscle artifact", "channel noise"], 2, replace=False)
    (x, m), (y, o) = (simulate(k, rng, sfreq, places, line, seconds) for k in (a, b))
    return 0.6 * x / x.std() + 0.6 * y / y.std() + 0.8 * _coloured(rng, n, sfreq, lambda f: f**-0.3), m / np.abs(m).max() + o / np.abs(o).max() + 0.5 * rng.normal(size=len(places))


def features(sources: np.ndarray, mixing: np.ndarray, sfreq: float, places: np.ndarray, line_freqs: list[float]) -> np.ndarray:
    """A row for each component: shares of bands, of the line, and of the strongest channel; front, edge, smoothness and tilt of the map; kurtosis, skew and rhythm of the time course."""
    f, power = K._power(sources, sfreq)
    tiny = np.finfo(float).tiny
    total = np.maximum(power[:, f >= 1].sum(axis=1), tiny)
    share = lambda a, b: power[:, (f >= a) & (f < b)].sum(axis=1) / total
    bands = [np.log10(share(a, b) + 1e-4) for a, b in zip(BANDS[:-1], BANDS[1:], strict=True)]
    lines = [share(x - 1, x + 1) for x in line_freqs if x < sfreq / 2] or [np.zeros(len(sources))]
    z = (sources - sources.mean(axis=1, keepdims=True)) / np.maximum(sources.std(axis=1, keepdims=True), tiny)
    m = mixing / np.maximum(np.abs(mixing).max(axis=0), tiny)
    size = np.abs(m) / np.maximum(np.abs(m).sum(axis=0), tiny)
    # How well a map follows from a plane over the head, and from its neighbours.
    plane = np.column_stack([places, np.ones(len(places))])
    fitted = plane @ np.linalg.lstsq(plane, m, rcond=None)[0]
    spread = np.maximum(((m - m.mean(axis=0)) ** 2).sum(axis=0), tiny)
    tilt = 1 - ((m - fitted) ** 2).sum(axis=0) / spread
    weight = np.exp(-((places[:, None] - places[None]) ** 2).sum(axis=2) / 0.15) * (1 - np.eye(len(places)))
    around = weight @ m / np.maximum(weight.sum(axis=1, keepdims=True), tiny)
    rough = np.log10(((m - around) ** 2).sum(axis=0) / spread + 1e-3)
    spectrum = np.abs(np.fft.rfft(np.maximum(np.abs(z) - 2, 0), 2 * z.shape[1])) ** 2
    pulse = np.fft.irfft(spectrum)[:, : z.shape[1]]
    beat = pulse[:, int(0.5 * sfreq) : int(1.4 * sfreq)].max(axis=1) / np.maximum(pulse[:, 0], tiny)
    return np.column_stack([
        *bands, np.log10(np.max(lines, axis=0) + 1e-4), size.max(axis=0), (size * (places[:, 1:2] > 0.6)).sum(axis=0), (size * (np.hypot(places[:, :1], places[:, 1:2]) > 0.9)).sum(axis=0),
        rough, tilt, np.log10(np.abs((z**4).mean(axis=1) - 3) + 0.1) * np.sign((z**4).mean(axis=1) - 3), np.abs((z**3).mean(axis=1)), beat,
    ])


@dataclass
class Regression:
    """Multinomial regression on standardised features, with their squares."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -4, 4)
        return np.column_stack([z, z * z, np.ones(len(z))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = self._inputs(x) @ self.weights / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Regression:
        out = cls(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), np.zeros((2 * x.shape[1] + 1, classes)))
        inputs, target, moved = out._inputs(x), np.eye(classes)[y], np.zeros_like(out.weights)
        for _ in range(rounds):
            slope = inputs.T @ (out.probabilities(x) - target) / len(x) + ridge * out.weights
            moved = 0.9 * moved - rate * 0.1 * slope
            out.weights = out.weights + moved
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature under which these labels are likeliest."""
        def loss(t: float) -> float:
            self.temperature = t
            return -np.log(self.probabilities(x)[np.arange(len(y)), y] + 1e-12).mean()

        self.temperature = min(np.geomspace(0.3, 5, 40).tolist(), key=loss)


def examples(n: int, seed: int, sfreq: float = 256.0, line: float = 60.0, names: tuple[str, ...] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """``n`` simulated components of each class, their classes, and the electrodes' places."""
    from ripplebed.plans.config import CHANNELS

    known = positions()
    places = np.array([known[c] for c in names or CHANNELS])
    rng = np.random.default_rng(seed)
    y = np.repeat(np.arange(len(K.LABELS)), n)
    return [simulate(K.LABELS[k], rng, sfreq, places, line) for k in y], y, places


@cache
def trained(seed: int = 0) -> Regression:
    """The model, fitted once in a process."""
    tables, labels = [], []
    for k, (sfreq, line) in enumerate(((256.0, 60.0), (200.0, 50.0))):
        found, y, places = examples(EXAMPLES // 2, seed + k, sfreq, line)
        tables += [features(s[None], m[:, None], sfreq, places, [line]) for s, m in found]
        labels.append(y)
    x, y = np.concatenate(tables), np.concatenate(labels)
    held = np.arange(len(y)) % 5 == 0
    model = Regression.fit(x[~held], y[~held], len(K.LABELS))
    model.calibrate(x[held], y[held])
    return model


def simulated_labels(sources: np.ndarray, mixing: np.ndarray, sfreq: float, places: np.ndarray, line_freqs: list[float]) -> Labels:
    """A label and its probability for each component, by the model trained on simulated ones."""
    p = trained().probabilities(features(sources, mixing, sfreq, places, line_freqs))
    return [(K.LABELS[i], float(q[i])) for i, q in zip(p.argmax(axis=1), p, strict=True)]


LABELLERS: dict[str, Labeller] = {"heuristic": K.heuristic_labels, "simulated": simulated_labels}


def labeller(name: str) -> Labeller:
    """A labeller by its name, or imported from "module:function"."""
    if ":" in name:
        module, _, function = name.partition(":")
        return getattr(import_module(module), function)
    if name not in LABELLERS:
        raise ValueError(f"unknown labeller {name!r}; known are {sorted(LABELLERS)}")
    return LABELLERS[name]
