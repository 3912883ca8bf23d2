"""Electrode positions on an idealised unit sphere, made from the rules of the 10-20, 10-10 and 10-05 systems.

The midline runs from Nz to Iz in steps of nine degrees, a row to each step; the
ring runs at 72 degrees from the vertex.  A row goes from its ring electrode to the
midline over the great arc, which the 10-05 system divides into eight parts; the
sites 9h and 9 lie 9 and 18 degrees below the ring.  x points to the right, y to the
front, z up.  Older names are further names of the same places; T1, T2 and the ears
are approximate.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: The rows of the 10-05 system from front to back, and what the sites near the ring are called in some of them.
ROWS = ["Nfp", "Fp", "Afp", "Af", "Aff", "F", "Ffc", "Fc", "Fcc", "C", "Ccp", "Cp", "Cpp", "P", "Ppo", "Po", "Poo", "O", "Oi"]
TEMPORAL = {"Ffc": "Fft", "Fc": "Ft", "Fcc": "Ftt", "C": "T", "Ccp": "Ttp", "Cp": "Tp", "Cpp": "Tpp"}
#: The sites of the 10-20 system.
TEN_TWENTY = ["Fp1", "Fpz", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T7", "C3", "Cz", "C4", "T8", "P7", "P3", "Pz", "P4", "P8", "O1", "Oz", "O2", "A1", "A2", "T3", "T4", "T5", "T6"]


def _at(inclination: float, azimuth: float) -> np.ndarray:
    i, a = np.radians(inclination), np.radians(azimuth)
    return np.array([np.sin(i) * np.sin(a), np.sin(i) * np.cos(a), np.cos(i)])


def _between(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    angle = np.arccos(np.clip(a @ b, -1, 1))
    return (np.sin((1 - share) * angle) * a + np.sin(share * angle) * b) / np.sin(angle)


def _sites() -> dict[str, np.ndarray]:
    """All sites of the 10-05 system; names have the first letter large, the rest small."""
    out = {"Nz": _at(90, 0), "Iz": _at(90, 180)}
    for side, odd in ((-1, 1), (1, 0)):
        number = lambda n, odd=odd: str(n if odd else n + 1)  # noqa: E731  odd on the left
        for row, inclination, azimuth in (("N", 90, 18), ("Nfp", 81, 18), ("Fp", 72, 18), ("O", 72, 162), ("Oi", 81, 162), ("I", 90, 162)):
            out[row + number(1)] = _at(inclination, side * azimuth)
            out[row + number(1) + "h"] = _at(inclination, side * (azimuth - 9 if azimuth < 90 else azimuth + 9))
    for n, row in enumerate(ROWS, 1):
        azimuth, middle = 9.0 * n, 90.0 - 9.0 * n
        mid = out[f"{row}z"] = _at(abs(middle), 0 if middle >= 0 else 180)
        if row in ("Nfp", "Fp", "O", "Oi"):
            continue
        edge = TEMPORAL.get(row, row)
        for side, odd in ((-1, 1), (1, 0)):
            number = lambda n, odd=odd: str(n if odd else n + 1)
            ring = _at(72, side * azimuth)
            # From the ring to the midline: 7, 7h, 5, 5h, 3, 3h, 1, 1h.
            for part in range(8):
                site = number(7 - 2 * (part // 2)) + ("h" if part % 2 else "")
                out[(edge if part < 2 else row) + site] = _between(ring, mid, part / 8) if part else ring
            out[edge + number(9) + "h"], out[edge + number(9)] = _at(81, side * azimuth), _at(90, side * azimuth)
    for old, new in (("T3", "T7"), ("T4", "T8"), ("T5", "P7"), ("T6", "P8")):
        out[old] = out[new]
    for name, side in (("1", -1), ("2", 1)):
        out["A" + name] = _at(110, side * 90)
    return out


@cache
def _montages() -> dict[str, dict[str, np.ndarray]]:
    sites = _sites()
    temporal = {"T1": _at(100, -65), "T2": _at(100, 65)}
    coarse = {n: p for n, p in sites.items() if not n.endswith("h") and n.rstrip("z0123456789") not in [r for k, r in enumerate(ROWS) if k % 2 == 0] + ["Fft", "Ftt", "Ttp", "Tpp"]}
    return {"tuh": sites | temporal, "standard_1005": sites, "standard_1010": coarse, "standard_1020": {n: coarse[n] for n in TEN_TWENTY}}


def positions(montage: str = "tuh") -> dict[str, np.ndarray]:
    """Name (first letter large, the rest small) to unit vector: all of the 10-05 system with T1 and T2, or a standard system by name."""
    known = _montages()
    if montage not in known:
        raise ValueError(f"unknown montage {montage!r}; known are {sorted(known)}")
    return known[montage]


def legendre_sum(cosines: np.ndarray, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """The spline kernel: sum of (2n + 1) / (n (n + 1))^stiffness P_n(x), over 4 pi."""
    before, now, total = np.ones_like(cosines), cosines.copy(), np.zeros_like(cosines)
    for n in range(1, terms + 1):
        total += (2 * n + 1) / (n * (n + 1.0)) ** stiffness * now
        before, now = now, ((2 * n + 1) * cosines * now - n * before) / (n + 1)
    return total / (4 * np.pi)


def spline_weights(known: np.ndarray, wanted: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Rows of weights that give the ``wanted`` places' values from the ``known`` ones'; each row sums to 1."""
    n = len(known)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = legendre_sum(np.clip(known @ known.T, -1, 1)) + ridge * np.eye(n)
    system[n, n] = 0
    to = np.ones((len(wanted), n + 1))
    to[:, :n] = legendre_sum(np.clip(wanted @ known.T, -1, 1))
    return (to @ np.linalg.pinv(system))[:, :n]
