"""The stages of cleaning, by name; a run may name others or in another order.

A stage is a function of a ``Signal``, which it changes.  It drops the signal by
raising ``Dropped``; any other error becomes the row's status.  Stages of one's own
are registered by ``stage`` or named in a configuration as ``module:function``; the
module must then be importable where tasks run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module

import numpy as np

from ripplebed.functions import kernels as K
from ripplebed.functions.labeller import labeller
from ripplebed.functions.montage import positions, spline_weights
from ripplebed.plans.config import PipelineConfig

STAGES: dict[str, Callable[[Signal], None]] = {}


class Dropped(Exception):
    """The signal can't go on, for the reason given."""


@dataclass
class Signal:
    """Channels x samples, their names, and what was found on the way."""

    x: np.ndarray
    names: list[str]
    sfreq: float
    seed: int
    cfg: PipelineConfig
    gated: bool = True
    told: dict = field(default_factory=lambda: {"bad_chs": [], "missing_chs": [], "extra_chs": [], "ica_excluded": [], "ica_labels": [], "ica_proba": [], "notes": []})

    def places(self, names: list[str]) -> np.ndarray:
        known = positions(self.cfg.montage_name)
        return np.array([known[n] for n in names])


def stage(name: str):
    """Register a stage under a name."""

    def add(f: Callable[[Signal], None]) -> Callable[[Signal], None]:
        STAGES[name] = f
        return f

    return add


def resolved(names: tuple[str, ...]) -> list[Callable[[Signal], None]]:
    """The stages of these names; "module:function" is imported."""
    out = []
    for name in names:
        if ":" in name:
            module, _, function = name.partition(":")
            out.append(getattr(import_module(module), function))
        elif name in STAGES:
            out.append(STAGES[name])
        else:
            raise ValueError(f"unknown stage {name!r}; known are {sorted(STAGES)}")
    return out


@stage("quality")
def quality(s: Signal) -> None:
    if s.gated and s.cfg.quality_check:
        found = K.gate(s.x, s.sfreq, list(s.cfg.line), s.cfg.hp_freq, s.cfg.lp_freq, s.cfg.min_nchans)
        if not found["passed"]:
            raise Dropped(found["reason"])


@stage("line_noise")
def line_noise(s: Signal) -> None:
    for line in s.cfg.line:
        if line < s.sfreq / 2:
            s.x = K.remove_line(s.x, s.sfreq, line)


@stage("bad_channels")
def bad_channels(s: Signal) -> None:
    found = K.bad_channels(s.x, s.sfreq, deviation=5.0, frac_bad=0.05, list_flat=False)
    bad = set(K.union(found))
    if len(s.x) >= 16:
        try:
            bad |= set(K.ransac_bad(s.x, s.sfreq, s.places(s.names), s.seed))
        except Exception as e:  # noqa: BLE001  the other detectors stand without it
            s.told["notes"].append(f"ransac: {type(e).__name__}: {e}")
    s.told["bad_chs"] += [s.names[i] for i in sorted(bad)]
    keep = [i for i in range(len(s.x)) if i not in bad]
    s.x, s.names = s.x[keep], [s.names[i] for i in keep]


@stage("filter")
def filter_(s: Signal) -> None:
    s.x = K.band_pass(K.detrend(s.x), s.sfreq, s.cfg.hp_freq, s.cfg.lp_freq)


@stage("average_reference")
def average_reference(s: Signal) -> None:
    s.x = K.average_reference(s.x)


@stage("components")
def components(s: Signal) -> None:
    """Take out components that are surely none of those included, and the channels that look bad after it."""
    if not s.cfg.do_ica:
        return
    unmixing, mixing = K.infomax(s.x, s.seed)
    sources = unmixing @ (s.x - s.x.mean(axis=1, keepdims=True))
    labels = labeller(s.cfg.labeller)(sources, mixing, s.sfreq, s.places(s.names), list(s.cfg.line))
    gone = [i for i, (name, p) in enumerate(labels) if name not in s.cfg.included_components and p > s.cfg.iclabel_threshold]
    s.told |= {"ica_excluded": gone, "ica_labels": [n for n, _ in labels], "ica_proba": [p for _, p in labels]}
    s.x = s.x - mixing[:, gone] @ sources[gone]
    bad_channels(s)


@stage("missing")
def missing(s: Signal) -> None:
    s.told["missing_chs"] = [c for c in s.cfg.channels if c not in s.names]
    if s.told["missing_chs"]:
        weights = spline_weights(s.places(s.names), s.places(s.told["missing_chs"]))
        s.x, s.names = np.concatenate([s.x, K.interpolated(s.x, weights)]), s.names + s.told["missing_chs"]


@stage("order")
def order(s: Signal) -> None:
    s.told["extra_chs"] = [n for n in s.names if n not in s.cfg.channels]
    s.x, s.names = s.x[[s.names.index(c) for c in s.cfg.channels]], list(s.cfg.channels)


@stage("resample")
def resample(s: Signal) -> None:
    s.x, s.sfreq = K.RESAMPLERS[s.cfg.resampling](s.x, s.sfreq, s.cfg.sfreq), s.cfg.sfreq
