"""Unfolding of Doppler velocities, sweep by sweep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The Nyquist velocity where none is known, folds at most, and the part of it by which a move must better a gate.
DEFAULT_NYQUIST, MOST_FOLDS, LEAST_GAIN = 30.0, 8, 0.15
METHODS = ("off", "radial", "sweep")


def _unfold(v: np.ndarray, reference: np.ndarray, nyquist: float) -> np.ndarray:
    """Velocities moved by whole folds next to a reference; halves round away from zero."""
    turns = (reference - v) / (2 * nyquist)
    return v + 2 * nyquist * np.clip(np.copysign(np.floor(np.abs(turns) + 0.5), turns), -MOST_FOLDS, MOST_FOLDS)


def _median(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median over the first axis of the values that are there, and how many they are."""
    n, ordered = (~np.isnan(values)).sum(0), np.sort(values, axis=0)
    pick = lambda k: np.take_along_axis(ordered, np.clip(k, 0, len(values) - 1)[None], 0)[0]
    return (pick((n - 1) // 2) + pick(n // 2)) / 2, n


def _seeds(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each radial the gate where unfolding starts (-1: no gate), and whether the radial before has gates in common.

    It is the gate in the middle of what both have, the first of two as near, else the first gate.
    """
    common = there.copy()
    common[0] = False
    common[1:] &= there[:-1]
    shared = common.any(1)
    gate = np.arange(there.shape[1])
    middle = (common * gate).sum(1) / np.maximum(common.sum(1), 1)
    near = np.where(common, np.abs(gate - middle[:, None]), np.inf).argmin(1)
    return np.where(shared, near, np.where(there.any(1), there.argmax(1), -1)), shared


def unfold_radials(observed: np.ndarray, nyquist: float) -> np.ndarray:
    """Velocities (radial, gate; NaN: none) made continuous along and across radials.

    From its seed a radial is walked both ways. A gate moves next to the median of
    the last gate walked, what the last two extrapolate to and the same gate of
    the radial before. A gate needs only earlier gates of its walk and one gate of the
    radial before, so the walks of all radials run side by side, each as many
    steps late as its seed's distance from the one before demands.
    """
    out, there = np.full_like(observed, np.nan), ~np.isnan(observed)
    seed, shared = _seeds(there)
    rows, late = np.flatnonzero(seed >= 0), np.zeros(len(observed), np.int64)
    for r in range(1, len(observed)):
        if shared[r]:
            late[r] = late[r - 1] + 1 + abs(seed[r] - seed[r - 1])
    last = np.full((2, len(observed)), np.nan)
    before = last.copy()
    if not len(rows):
        return out
    reach = np.maximum(seed, observed.shape[1] - 1 - seed)
    for t in range(int((late + reach)[rows].max()) + 1):
        begun = rows[late[rows] == t]
        if len(begun):
            own = observed[begun, seed[begun]]
            ref = np.where(begun > 0, out[begun - 1, seed[begun]], np.nan)
            out[begun, seed[begun]] = last[:, begun] = np.where(np.isnan(ref), own, _unfold(own, ref, nyquist))
        going = rows[(late[rows] < t) & (late[rows] + reach[rows] >= t)]
        for way, step in ((0, 1), (1, -1)):
            gate = seed[going] + step * (t - late[going])
            inside = (gate >= 0) & (gate < observed.shape[1])
            r, g = going[inside], gate[inside]
            r, g = r[there[r, g]], g[there[r, g]]
            if len(r):
                one, two = last[way, r], before[way, r]
                middle, _ = _median(np.stack([one, one + (one - two), np.where(r > 0, out[r - 1, g], np.nan)]))
                out[r, g] = _unfold(observed[r, g], middle, nyquist)
                before[way, r], last[way, r] = one, out[r, g]
    return out


def refine_sweep(observed: np.ndarray, corrected: np.ndarray, nyquist: float, passes: int = 3) -> np.ndarray:
    """Gates moved next to the median of their eight neighbours, radials being a circle, where that betters them enough.

    Two neighbours are needed; passes end early when nothing moves.
    """
    for _ in range(passes):
        wide = np.pad(corrected, ((0, 0), (1, 1)), constant_values=np.nan)
        circle = [np.roll(wide, k, axis=0) for k in (1, 0, -1)]
        around = [ring[:, s : s + corrected.shape[1]] for k, ring in enumerate(circle) for s in (0, 1, 2) if (k, s) != (1, 1)]
        middle, n = _median(np.stack(around))
        moved = _unfold(observed, middle, nyquist)
        better = ~np.isnan(observed) & (n >= 2) & (np.isnan(corrected) | (np.abs(moved - middle) + LEAST_GAIN * nyquist < np.abs(corrected - middle)))
        if not better.any():
            break
        corrected = np.where(better, moved, corrected)
    return corrected


def dealias_sweeps(gates: DataFrame, nyquist: float | str | None = None, passes: int = 3, method: str = "sweep") -> DataFrame:
    """``gates`` (volume, sweep, az, gate, vel and more) with velocities unfolded.

    ``nyquist``: a number, or a column that has each radial's; a sweep uses the
    first positive one by azimuth, else 30 m/s. ``method``: ``off``, ``radial`` (along
    radials) or ``sweep`` (then over neighbours too). Null velocities stay null
    and rows without azimuth or gate unchanged. A sweep hangs together through its
    radials, so it is the unit of work, as large as the radar makes it; sweeps
    run beside each other. Of several rows of one place the last by value counts.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method == "off":
        return gates

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        placed = pdf[pdf["az"].notna() & pdf["gate"].notna()].sort_values(["az", "gate", "vel"], kind="stable")
        if placed["vel"].notna().sum() == 0:
            return pdf
        if isinstance(nyquist, str):
            known = placed[nyquist].astype(float)
            known = known[np.isfinite(known) & (known > 0)]
            limit = float(known.iloc[0]) if len(known) else DEFAULT_NYQUIST
        else:
            limit = nyquist or DEFAULT_NYQUIST
        held = placed[placed["vel"].notna()]
        azimuths, r = np.unique(held["az"].to_numpy(), return_inverse=True)
        g = held["gate"].to_numpy().astype(np.int64)
        g -= g.min()
        observed = np.full((len(azimuths), int(g.max()) + 1), np.nan)
        observed[r, g] = held["vel"].to_numpy(float)
        out = unfold_radials(observed, limit)
        if method == "sweep":
            out = refine_sweep(observed, out, limit, passes)
        vel = pdf["vel"].astype(float).copy()
        vel.loc[held.index] = out[r, g]
        return pdf.assign(vel=vel)

    return gates.groupBy("volume", "sweep").applyInPandas(run, gates.schema)
