"""Signal kernels in numpy: arrays of channels x samples in, arrays out; every random choice is seeded."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np

from ripplebed.functions.montage import spline_weights

#: Scale that turns an interquartile range into a standard deviation of normal data.
IQR_SD = 0.7413


# --- filters -----------------------------------------------------------------


def _sinc_lowpass(cut: float, sfreq: float, n: int) -> np.ndarray:
    t = np.arange(n) - (n - 1) / 2
    taps = 2 * cut / sfreq * np.sinc(2 * cut / sfreq * t) * np.hamming(n)
    return taps / taps.sum()


def _length(transition: float, sfreq: float) -> int:
    return int(np.ceil(3.3 / transition * sfreq)) | 1


def zero_phase(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolve with a symmetric filter, reflected at the edges and without delay."""
    half, n = len(taps) // 2, x.shape[-1]
    pad = min(half, n - 1)
    y = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad else x
    size = 1 << int(np.ceil(np.log2(y.shape[-1] + len(taps))))
    full = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(taps, size), size)
    return full[..., half + pad : half + pad + n]


def band_pass(x: np.ndarray, sfreq: float, low: float | None, high: float | None) -> np.ndarray:
    """Windowed-sinc filter; None leaves a side open; an edge beyond half the rate is an error."""
    return filtered(x, band_pass_steps(sfreq, low, high))


#: Symmetric taps, and whether what they give is subtracted from the signal.
Step = tuple[np.ndarray, bool]


def band_pass_steps(sfreq: float, low: float | None, high: float | None) -> list[Step]:
    nyquist = sfreq / 2
    if high is not None and high >= nyquist or low is not None and low >= nyquist:
        raise ValueError("a band edge lies beyond half the sampling rate")
    out: list[Step] = []
    if high is not None:
        edge = min(max(0.25 * high, 2.0), nyquist - high)
        out.append((_sinc_lowpass(high + edge / 2, sfreq, _length(edge, sfreq)), False))
    if low is not None and low > 0:
        edge = min(max(0.25 * low, 2.0), low)
        out.append((_sinc_lowpass(low - edge / 2, sfreq, _length(edge, sfreq)), True))
    return out


def notch(x: np.ndarray, sfreq: float, freqs: list[float]) -> np.ndarray:
    """Take out a narrow band around each frequency below half the rate."""
    return filtered(x, notch_steps(sfreq, freqs))


def notch_steps(sfreq: float, freqs: list[float]) -> list[Step]:
    out: list[Step] = []
    for f in freqs:
        half = f / 400 + 0.5
        if f + half < sfreq / 2:
            n = _length(1.0, sfreq)
            out.append((_sinc_lowpass(f + half, sfreq, n) - _sinc_lowpass(f - half, sfreq, n), True))
    return out


def filtered(x: np.ndarray, steps: list[Step]) -> np.ndarray:
    """One filter after the other over a whole recording."""
    for taps, subtract in steps:
        y = zero_phase(x, taps)
        x = x - y if subtract else y
    return x


def filtered_part(x: np.ndarray, start: int, total: int, steps: list[Step]) -> tuple[np.ndarray, int]:
    """The same over the samples from ``start`` on of a recording of ``total``: what can be known of the result, and where it starts.

    Each filter takes half its length from both sides, but for the recording's ends,
    where it is reflected.
    """
    stop = start + x.shape[-1]
    for taps, subtract in steps:
        half = len(taps) // 2
        pad = min(half, total - 1)
        y, a, b = x, start + half, stop - half
        if start == 0:
            a = 0
            y = np.concatenate([np.zeros((*x.shape[:-1], half - pad)), 2 * x[..., :1] - x[..., pad:0:-1], y], axis=-1)
        if stop == total:
            b = total
            y = np.concatenate([y, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1], np.zeros((*x.shape[:-1], half - pad))], axis=-1)
        size = 1 << int(np.ceil(np.log2(y.shape[-1] + len(taps))))
        y = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(taps, size), size)[..., 2 * half : 2 * half + b - a]
        x = x[..., a - start : b - start] - y if subtract else y
        start, stop = a, b
    return x, start


def halo(steps: list[Step]) -> int:
    """Samples that filters need on both sides."""
    return sum(len(taps) // 2 for taps, _ in steps)


def detrend(x: np.ndarray, order: int = 1, rounds: int = 3, outlier: float = 3.0) -> np.ndarray:
    """Subtract a polynomial, fitted again without samples that lie beyond ``outlier`` deviations."""
    n = x.shape[-1]
    basis = np.vander(np.linspace(-1, 1, n), order + 1)
    out = np.empty_like(x)
    for c, row in enumerate(x):
        weight = np.ones(n, bool)
        for _ in range(rounds):
            fit = basis @ np.linalg.lstsq(basis[weight], row[weight], rcond=None)[0]
            left = row - fit
            new = np.abs(left) <= outlier * max(left[weight].std(), np.finfo(float).tiny)
            if new.sum() <= order + 1 or (new == weight).all():
                break
            weight = new
        out[c] = row - fit
    return out


def _power(x: np.ndarray, sfreq: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean Welch spectrum with half-overlapping windows of two seconds."""
    n = min(x.shape[-1], max(8, int(2 * sfreq)))
    starts = range(0, x.shape[-1] - n + 1, max(1, n // 2))
    w = np.hanning(n)
    return np.fft.rfftfreq(n, 1 / sfreq), np.mean([np.abs(np.fft.rfft(x[..., s : s + n] * w)) ** 2 for s in starts], axis=0)


def period_steps(sfreq: float, line: float) -> list[Step]:
    """The mean over a period of the line."""
    period = np.ones(max(1, round(sfreq / line)))
    return [(period / len(period) if len(period) % 2 else np.convolve(period, [0.5, 0.5]) / len(period), False)]


def welch_length(total: int, sfreq: float) -> int:
    return min(total, max(8, int(2 * sfreq)))


@dataclass
class LineStatistics:
    """Sums from which line noise is found: those of two parts of a recording may be added."""

    gram: np.ndarray  # channels x channels
    biased: np.ndarray  # the same of what lies at the line and its harmonics, in windows that overlap by half
    spectra: np.ndarray  # frequencies near the line x channels x channels, of tapered windows
    windows: int

    @classmethod
    def of(cls, fast: np.ndarray, windows: list[np.ndarray], n: int, sfreq: float, line: float) -> LineStatistics:
        c, near, harmonic, weight = len(fast), *line_bins(n, sfreq, line)
        biased, spectra = np.zeros((c, c)), np.zeros((len(near), c, c), complex)
        for w in windows:
            f = np.fft.rfft(w)[:, harmonic]
            biased += ((f * weight) @ f.conj().T).real
            f = np.fft.rfft(w * np.hanning(n))[:, near].T
            spectra += f[:, :, None] * f[:, None, :].conj()
        return cls(fast @ fast.T, biased, spectra, len(windows))

    def __add__(self, other: LineStatistics) -> LineStatistics:
        return LineStatistics(self.gram + other.gram, self.biased + other.biased, self.spectra + other.spectra, self.windows + other.windows)


def line_bins(n: int, sfreq: float, line: float, spread: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a window of ``n`` samples the frequencies near the line, those at it and its harmonics, and how often each of these counts in a real signal."""
    f = np.fft.rfftfreq(n, 1 / sfreq)
    harmonic = np.zeros(len(f), bool)
    for k in range(1, int(sfreq / 2 / line) + 1):
        harmonic |= np.abs(f - k * line) <= 0.5
    at = np.flatnonzero(harmonic)
    return np.flatnonzero(np.abs(f - line) <= spread), at, np.where((at == 0) | (2 * at == n), 1.0, 2.0)


def line_projection(s: LineStatistics, n: int, sfreq: float, line: float, most: int = 20, spread: float = 6.0) -> np.ndarray:
    """The matrix that takes components out which are strongest at the line and its harmonics, one by one while the spectrum still peaks there."""
    f = np.fft.rfftfreq(n, 1 / sfreq)[line_bins(n, sfreq, line, spread)[0]]
    near, peak = (np.abs(f - line) <= spread) & (np.abs(f - line) > 1), np.abs(f - line) <= 0.5
    out = np.eye(len(s.gram))
    gram, biased, spectra = s.gram, s.biased, s.spectra
    if not s.windows or not near.any() or not peak.any():
        return out
    for _ in range(most):
        power = np.maximum(np.einsum("fcc->fc", spectra).real, 0).mean(axis=1) / s.windows
        mean = np.log10(power + 1e-300)
        if mean[peak].max() <= mean[near].mean() + 3 * mean[near].std():
            break
        scale, axes = np.linalg.eigh(gram)
        good = scale > scale.max() * 1e-10
        white = axes[:, good] / np.sqrt(scale[good])
        w = white @ np.linalg.eigh(white.T @ biased @ white)[1][:, -1]
        step = np.eye(len(gram)) - np.outer(gram @ w, w) / (w @ gram @ w)
        out, gram, biased, spectra = step @ out, step @ gram @ step.T, step @ biased @ step.T, step @ spectra @ step.T
    return out


def remove_line(x: np.ndarray, sfreq: float, line: float, most: int = 20) -> np.ndarray:
    """Project out components that are strongest at the line frequency while the spectrum still peaks there."""
    if x.shape[-1] < 2 * sfreq / line or np.linalg.matrix_rank(x) < 2:
        return x
    smooth = filtered(x, period_steps(sfreq, line))
    fast, n = x - smooth, welch_length(x.shape[-1], sfreq)
    windows = [fast[:, s : s + n] for s in range(0, x.shape[-1] - n + 1, max(1, n // 2))]
    found = LineStatistics.of(fast, windows, n, sfreq, line)
    return smooth + line_projection(found, n, sfreq, line, most) @ fast


# --- moments --------------------------------------------------------------------


@dataclass
class Moments:
    """Count, means and centred products of channels; ``a + b`` are those of both parts together."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=1) if x.shape[1] else np.zeros(len(x))
        y = x - mean[:, None]
        return cls(x.shape[1], mean, y @ y.T)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.products + other.products + np.outer(d, d) * (self.n * other.n / n))

    def whitening(self) -> np.ndarray:
        """A matrix, a row for each dimension that the channels span, that makes centred channels uncorrelated and of variance 1."""
        scale, axes = np.linalg.eigh(self.products / self.n)
        good = scale > scale.max() * len(scale) * np.finfo(float).eps
        return (axes[:, good] / np.sqrt(scale[good])).T


# --- bad channels -------------------------------------------------------------


def robust_z(v: np.ndarray) -> np.ndarray:
    q = np.percentile(v, [25, 50, 75])
    return (v - q[1]) / max(IQR_SD * (q[2] - q[0]), np.finfo(float).tiny)


def _mad(x: np.ndarray) -> np.ndarray:
    return np.median(np.abs(x - np.median(x, axis=-1, keepdims=True)), axis=-1)


def bad_channels(x: np.ndarray, sfreq: float, deviation: float = 5.0, frac_bad: float = 0.01, correlation: float = 0.4, list_flat: bool = True) -> dict[str, list[int]]:
    """Channels that are flat or not numbers, deviate, carry high-frequency noise, fail to correlate, or both of the last two."""
    dead = flat(x)
    use = np.flatnonzero(~dead)
    found = {"flat": np.flatnonzero(dead).tolist() if list_flat else [], "deviation": [], "noise": [], "correlation": [], "snr": []}
    if len(use) < 2:
        return found
    y = x[use]
    found["deviation"] = use[np.abs(spread_z(y)) > deviation].tolist()
    low = y
    if sfreq > 100:
        low = band_pass(y, sfreq, None, 50.0) if sfreq > 104 else y
        found["noise"] = use[noise_z(y, low) > 5].tolist()
    found["correlation"] = use[apart(low, max(2, int(sfreq)), correlation) > frac_bad].tolist()
    found["snr"] = noisy_and_apart(found)
    return found


def noisy_and_apart(found: dict[str, list[int]]) -> list[int]:
    """Channels with too little signal for their noise: those found by high-frequency noise and by correlation both."""
    return sorted({*found["noise"]} & {*found["correlation"]})


def union(found: dict[str, list[int]]) -> list[int]:
    """The channels that any detector found, once each."""
    return sorted({i for group in found.values() for i in group})


def spread_z(y: np.ndarray) -> np.ndarray:
    """Robust z of each channel's spread among all."""
    q = np.percentile(y, [25, 75], axis=1)
    return robust_z(IQR_SD * (q[1] - q[0]))


def noise_z(y: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Robust z of what a low-pass takes away, in relation to what it leaves."""
    return robust_z(_mad(y - low) / np.maximum(_mad(low), np.finfo(float).tiny))


def neighbours(part: np.ndarray) -> np.ndarray:
    """For each channel a high percentile of its absolute correlations (0 with itself)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(np.nan_to_num(np.corrcoef(part)))
    np.fill_diagonal(r, 0)
    return np.percentile(r, 98, axis=1)


def apart(y: np.ndarray, width: int, correlation: float) -> np.ndarray:
    """The share of sub-windows in which a channel correlates with no other; 0 where none is full."""
    count = y.shape[1] // width
    bad = [neighbours(y[:, k * width : (k + 1) * width]) < correlation for k in range(count)]
    return np.mean(bad, axis=0) if count else np.zeros(len(y))


def flat(x: np.ndarray) -> np.ndarray:
    """Which channels are not numbers throughout, or don't change."""
    y = np.nan_to_num(x)
    return np.isnan(x).any(axis=1) | (y.std(axis=1) < 1e-15) | (_mad(y) < 1e-15)


def ransac_bad(x: np.ndarray, sfreq: float, places: np.ndarray, seed: int, samples: int = 50, share: float = 0.25, correlation: float = 0.75, unbroken: float = 0.4, window_s: float = 5.0) -> list[int]:
    """Channels that random subsets of the others predict badly in too many windows."""
    rng, n_ch = np.random.default_rng(seed), len(x)
    size = max(3, round(share * n_ch))
    weights = np.zeros((samples, n_ch, n_ch))
    for s in range(samples):
        chosen = np.sort(rng.choice(n_ch, size, replace=False))
        weights[s][:, chosen] = spline_weights(places[chosen], places)
    n = min(x.shape[1], int(window_s * sfreq))
    failed = []
    for at in range(0, x.shape[1] - n + 1, n):
        part = x[:, at : at + n]
        guess = np.median(weights @ part, axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            a, b = part - part.mean(1, keepdims=True), guess - guess.mean(1, keepdims=True)
            failed.append(np.nan_to_num((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))) < correlation)
    return np.flatnonzero(np.mean(failed, axis=0) > unbroken).tolist() if failed else []


# --- independent components ----------------------------------------------------


def infomax(x: np.ndarray, seed: int, rounds: int = 1000, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Extended Infomax: the unmixing and mixing matrices, at the data's rank."""
    x = x - x.mean(axis=1, keepdims=True)
    rank = int(np.linalg.matrix_rank(x))
    scale, axes = np.linalg.eigh(x @ x.T / x.shape[1])
    white = (axes[:, -rank:] / np.sqrt(scale[-rank:])).T
    z, rng, w = white @ x, np.random.default_rng(seed), np.eye(rank)
    block, rate, last, old = int(np.ceil(min(5 * np.log(z.shape[1]), 0.3 * z.shape[1]))), 0.01 / np.log(max(rank, 3)), None, w.copy()
    signs = np.ones(rank)
    for _ in range(rounds):
        order = rng.permutation(z.shape[1])
        for at in range(0, len(order) - block + 1, block):
            u = w @ z[:, order[at : at + block]]
            w = w + rate * (block * np.eye(rank) - signs[:, None] * (np.tanh(u) @ u.T) - u @ u.T) @ w
        if not np.isfinite(w).all() or np.abs(w).max() > 1e8:
            w, old, last, rate = np.eye(rank), np.eye(rank), None, rate * 0.5
            continue
        u = w @ z
        t = np.tanh(u)
        signs = np.sign((1 - t * t).mean(1) * (u * u).mean(1) - (t * u).mean(1) + 1e-12)
        step = (w - old).ravel()
        change = step @ step
        if last is not None and change > 0:
            cosine = step @ last / np.sqrt(change * (last @ last))
            if np.degrees(np.arccos(np.clip(cosine, -1, 1))) > 60:
                rate, last = rate * 0.9, step
        else:
            last = step
        old = w.copy()
        if change < tolerance or rate < 1e-10:
            break
    unmixing = w @ white
    return unmixing, np.linalg.pinv(unmixing)


LABELS = ["brain", "muscle artifact", "eye blink", "heart beat", "line noise", "channel noise", "other"]


def heuristic_labels(sources: np.ndarray, mixing: np.ndarray, sfreq: float, places: np.ndarray, line_freqs: list[float]) -> list[tuple[str, float]]:
    """A label and a confidence for each component, by its spectrum, its map and its kurtosis.

    It takes the place of a trained classifier, whose weights aren't at hand, and doesn't claim its decisions.
    """
    f, power = _power(sources, sfreq)
    share = lambda p, a, b: p[(f >= a) & (f < b)].sum() / max(p[f >= 1].sum(), np.finfo(float).tiny)
    out = []
    for s, p, m in zip(sources, power, np.abs(mixing).T, strict=True):
        top = m.max() / max(m.sum(), np.finfo(float).tiny)
        front = m[places[:, 1] > 0.7].sum() / max(m.sum(), np.finfo(float).tiny) if (places[:, 1] > 0.7).any() else 0.0
        kurtosis = float(np.mean((s - s.mean()) ** 4) / max(s.var() ** 2, np.finfo(float).tiny)) - 3
        score = {
            "line noise": max([2 * share(p, x - 1, x + 1) for x in line_freqs if x < sfreq / 2], default=0.0),
            "muscle artifact": 1.4 * share(p, 30, sfreq / 2),
            "eye blink": 1.2 * share(p, 1, 5) * min(1.0, 2 * front) * (1.0 if kurtosis > 2 else 0.3),
            "channel noise": top if top > 0.5 else 0.3 * top,
            "brain": 1.2 * share(p, 7, 14) + 0.4 * share(p, 1, 30),
            "heart beat": 0.5 if kurtosis > 15 else 0.0,
            "other": 0.3,
        }
        label = max(score, key=score.get)
        out.append((label, float(min(1.0, score[label] / sum(score.values()) * 2))))
    return out


# --- channels and time -----------------------------------------------------------


def resample_nearest(x: np.ndarray, old: float, new: float) -> np.ndarray:
    n = x.shape[-1]
    scale = new / old
    at = np.minimum(np.floor(np.arange(int(np.floor(n * scale))) / scale).astype(int), n - 1)
    return x[..., at]


def resample_polyphase(x: np.ndarray, old: float, new: float, zeros: int = 20, beta: float = 6.8) -> np.ndarray:
    """Resampling by a rational rate with a Kaiser low-pass below the lower of both half rates; as many samples as ``resample_nearest`` gives.

    The filter is split into one short filter for each phase between input samples, so
    its length in input samples doesn't grow with the rate's numerator.
    """
    ratio = Fraction(new / old).limit_denominator(10_000)
    up, down = ratio.numerator, ratio.denominator
    n, out_n = x.shape[-1], int(np.floor(x.shape[-1] * (new / old)))
    half = zeros * max(up, down)
    k = np.arange(-half, half + 1)
    cut = 0.89 / max(up, down)
    taps = cut * np.sinc(cut * k) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    reach = half // up + 1
    pad = min(reach, n - 1)
    y = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad else x
    y = np.pad(y, [(0, 0)] * (x.ndim - 1) + [(reach - pad, reach - pad)], mode="edge")
    out = np.empty((*x.shape[:-1], out_n))
    for phase in range(up):
        # Outputs m whose place m * down / up lies this many parts of ``up`` beyond an input sample.
        m = np.arange(out_n)[(np.arange(out_n) * down) % up == phase]
        if not len(m):
            continue
        first = (m * down) // up
        j = np.arange(-reach, reach + 1)
        at = phase - j * up + half
        use = (at >= 0) & (at < len(taps))
        weights = taps[at[use]]
        for a in range(0, len(m), 65_536):
            where = first[a : a + 65_536, None] + reach + j[use]
            out[..., m[a : a + 65_536]] = np.take(y, np.minimum(where, y.shape[-1] - 1), axis=-1) @ weights
    return out


RESAMPLERS = {"nearest": resample_nearest, "polyphase": resample_polyphase}


def average_reference(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=0, keepdims=True)


def interpolated(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Channels as weighted sums of others."""
    return weights @ x


def discrete(x: np.ndarray, min_unique: int = 100) -> list[int]:
    """Channels with few different values."""
    return [i for i, row in enumerate(x) if len(np.unique(row)) < min_unique]


def amplitude_figures(y: np.ndarray, oha: float = 40e-6, thv: float = 40e-6, chv: float = 80e-6) -> dict[str, float]:
    """Shares of high samples, of instants and of channels whose deviation is large."""
    return {"oha": float(np.mean(np.abs(y) > oha)), "thv": float(np.mean(y.std(axis=0) > thv)), "chv": float(np.mean(y.std(axis=1) > chv))}


def bad_ratio(few: list[int], found: dict[str, list[int]], n: int) -> float:
    """Bad channels in relation to all; the two lists are joined end to end, so a channel in both counts twice."""
    return len(few + union(found)) / n


#: From these shares on a window fails.
LIMITS = {"oha": 0.8, "thv": 0.5, "chv": 0.5, "bcr": 0.8}


def passes(figures: dict[str, float], limits: dict[str, float] = LIMITS) -> bool:
    return all(figures[k] < limit for k, limit in limits.items())


def gate(x: np.ndarray, sfreq: float, line_freqs: list[float], low: float | None, high: float | None, min_nchans: int = 10, oha: float = 40e-6, thv: float = 40e-6, chv: float = 80e-6, min_unique: int = 100) -> dict:
    """The quality figures of a window and whether it passes: bad channels are sought as it is, amplitudes judged after filtering."""
    if len(x) < min_nchans:
        return {"passed": False, "reason": "too few channels"}
    y = band_pass(notch(x, sfreq, line_freqs), sfreq, low, high)
    out = amplitude_figures(y, oha, thv, chv) | {"bcr": bad_ratio(discrete(x, min_unique), bad_channels(x, sfreq), len(x))}
    passed = passes(out)
    return out | {"passed": passed, "reason": None if passed else "quality"}
