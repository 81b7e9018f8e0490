"""Parcel ascents: instability, inhibition and entraining instability of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.operators.profile import wind_bundle

NEWTON_STEPS = 8
KAPPA, RD, CP, LV, EPS, G = 0.2854, 287.04, 1004.0, 2.501e6, 0.622, 9.81
# Fixed values of the entrainment parameter.
MIXING_K2, ALPHA, MIXING_M, PRANDTL, SIGMA = 0.18, 0.8, 120.0, 1 / 3, 1.6
NUMBERS = ("cape", "cin", "lcl_m", "lfc_m", "el_m", "lifted_index", "ecape", "ncape", "ecin")
OUT = "kind string, cape double, cin double, lcl_m double, lfc_m double, el_m double, lifted_index double, ecape double, ncape double, ecin double, failed boolean"
MOTIONS = ("mean_wind", "right_moving", "left_moving")


def _es(t: np.ndarray) -> np.ndarray:
    return 6.112 * np.exp(17.67 * t / (t + 243.5))


def _mix(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    e = np.minimum(_es(t), 0.9 * p)
    return EPS * e / (p - e)


def _moist(t: np.ndarray, p0: np.ndarray, p1: np.ndarray, steps: int = 10) -> np.ndarray:
    """Temperature (C) after pseudoadiabatic ascent from p0 to p1."""
    k = t + 273.15
    dln = np.log(p1 / p0) / steps
    for i in range(steps):
        p = p0 * np.exp(dln * i)
        r = _mix(p, k - 273.15)
        k = k + dln * (RD * k + LV * r) / (CP + LV * LV * r * EPS / (RD * k * k))
    return k - 273.15


def _at(x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each row's value at its own place."""
    return np.take_along_axis(x, j[:, None], 1)[:, 0]


def _share(lo: np.ndarray, hi: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """How far p lies from lo to hi in the logarithm of pressure; 0 where the two are one."""
    span = np.log(lo / hi)
    return np.where(span > 0, np.log(lo / p) / np.where(span > 0, span, 1), 0.0)


def _entrained_inhibition(p: np.ndarray, z: np.ndarray, t: np.ndarray, r: np.ndarray, t0: np.ndarray, r0: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Negative buoyant energy that a diluted parcel meets below its own first positive layer in cloud; 0 if it has none.

    Static energy and water relax towards the layer's mean at ``rate`` a metre;
    the temperature follows from the energy, by Newton's rule where saturated.
    """
    h, env = CP * (t + 273.15) + LV * r + G * z, (t + 273.15) * (1 + 0.608 * r)
    own_h, water = CP * (t0 + 273.15) + LV * r0 + G * z[:, 0], r0.copy()
    b, over = np.zeros_like(z), np.zeros(z.shape, bool)
    for j in range(z.shape[1]):
        if j:
            kept = np.exp(-rate * (z[:, j] - z[:, j - 1]))
            own_h = own_h * kept + (h[:, j] + h[:, j - 1]) / 2 * (1 - kept)
            water = water * kept + (r[:, j] + r[:, j - 1]) / 2 * (1 - kept)
        static = own_h - G * z[:, j]
        dry = (static - LV * water) / CP - 273.15
        wet = dry.copy()
        for _ in range(NEWTON_STEPS):
            q = _mix(p[:, j], wet)
            slope = CP + LV * q * (1 + q / EPS) * 17.67 * 243.5 / (wet + 243.5) ** 2
            wet = wet - (CP * (wet + 273.15) + LV * q - static) / slope
        cloudy = water > _mix(p[:, j], dry)
        up, vapour = np.where(cloudy, wet, dry), np.where(cloudy, _mix(p[:, j], wet), water)
        b[:, j] = G * ((up + 273.15) * (1 + 0.608 * vapour) - env[:, j]) / env[:, j]
        over[:, j] = cloudy
    dz, mid = np.diff(z), (b[:, 1:] + b[:, :-1]) / 2
    positive = (mid > 0) & (dz > 0) & over[:, 1:]
    below = np.arange(dz.shape[1])[None, :] < positive.argmax(1)[:, None]
    return np.where(positive.any(1), (np.minimum(mid * dz, 0) * below).sum(1), 0.0)


def ascend(p: np.ndarray, z: np.ndarray, t: np.ndarray, r: np.ndarray, start: np.ndarray, t0: np.ndarray, r0: np.ndarray, speed: np.ndarray) -> dict[str, np.ndarray]:
    """Lift one parcel through each column (a row, surface first) from its level ``start``.

    Virtual temperatures are compared; layers are integrated by the trapezoid
    rule. ECAPE follows the analytic entraining form of Peters et al. (2023)
    with the given storm-relative inflow speed. What a column lacks is NaN.
    Levels below the start count as the start itself, so their layers have no
    depth; the condensation level is one more level of every column.
    """
    n, p0, tk = p.shape[1], _at(p, start), t0 + 273.15
    e0 = np.log(np.maximum(r0 * p0 / (EPS + r0), 1e-6) / 6.112)
    td = np.minimum(t0, 243.5 * e0 / (17.67 - e0)) + 273.15
    tl = 1 / (1 / (td - 56) + np.log(tk / td) / 800) + 56
    pl = np.minimum(p0 * (tl / tk) ** (1 / KAPPA), p0)
    k = (p > pl[:, None]).sum(1)
    below, above = np.maximum(k - 1, 0), np.minimum(k, n - 1)
    w = _share(_at(p, below), _at(p, above), pl)
    own = np.arange(n + 1)[None, :]
    level = np.maximum(np.minimum(np.where(own < k[:, None], own, own - 1), n - 1), start[:, None])
    lcl = own == k[:, None]

    def with_lcl(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(lcl, at[:, None], np.take_along_axis(x, level, 1))

    z_lcl, t_lcl, r_lcl = (_at(x, below) + w * (_at(x, above) - _at(x, below)) for x in (z, t, r))
    grid, zg, tg, rg = with_lcl(p, np.maximum(pl, p[:, -1])), with_lcl(z, z_lcl), with_lcl(t, t_lcl), with_lcl(r, r_lcl)
    dry = grid >= pl[:, None]
    up = tk[:, None] * (grid / p0[:, None]) ** KAPPA - 273.15
    last_t, last_p = tl - 273.15, pl
    for j in range(n + 1):
        now = np.minimum(grid[:, j], last_p)
        last_t, last_p = _moist(last_t, last_p, now), now
        up[:, j] = np.where(dry[:, j], up[:, j], last_t)
    env = (tg + 273.15) * (1 + 0.608 * rg)
    b = G * ((up + 273.15) * (1 + 0.608 * np.where(dry, r0[:, None], _mix(grid, up))) - env) / env
    dz, mid, layer = np.diff(zg), (b[:, 1:] + b[:, :-1]) / 2, np.arange(n)[None, :]
    positive = (mid > 0) & (grid[:, 1:] <= pl[:, None]) & (dz > 0)
    free, first, top = positive.any(1), positive.argmax(1), n - 1 - positive[:, ::-1].argmax(1)
    inside = free[:, None] & (layer >= first[:, None]) & (layer <= top[:, None])
    cape = (np.maximum(mid, 0) * dz * inside).sum(1)
    cin = (np.minimum(mid * dz, 0) * (free[:, None] & (layer < first[:, None]))).sum(1)
    el = _at(zg, top + 1)
    half = (grid > 500).sum(1)
    lo, hi = np.maximum(half - 1, 0), np.minimum(half, n)
    w, warmer = _share(_at(grid, lo), _at(grid, hi), 500.0), tg - up
    li = np.where((p0 >= 500) & (grid[:, -1] <= 500), _at(warmer, lo) + w * (_at(warmer, hi) - _at(warmer, lo)), np.nan)
    # Analytic form: psi from the mixing length, NCAPE from the saturated static energy of the environment.
    h, rise = CP * (tg + 273.15) + LV * rg + G * zg, zg - zg[:, :1]
    total = np.concatenate((np.zeros((len(p), 1)), np.cumsum((h[:, 1:] + h[:, :-1]) / 2 * dz, 1)), 1)
    hbar = np.where(rise > 0, total / np.where(rise > 0, rise, 1), h[:, :1])
    part = -G / (CP * (tg + 273.15)) * (hbar - CP * (tg + 273.15) - LV * _mix(grid, tg) - G * zg)
    ncape = ((part[:, 1:] + part[:, :-1]) / 2 * dz * inside).sum(1)
    moves = (cape > 0) & (speed > 0)
    c, v2, psi = np.where(moves, cape, 1.0), np.where(moves, speed * speed, 1.0), MIXING_K2 * ALPHA**2 * np.pi**2 * MIXING_M / (4 * PRANDTL * SIGMA**2 * np.where(moves, el, 1.0))
    a = 1 + psi + 2 * psi / v2 * ncape
    root = np.sqrt(np.maximum(a * a + 8 * (psi / v2) * (c - psi * ncape), 0))
    frac = v2 / (2 * c) + (root - a) / (4 * psi / v2 * c)
    ecape = np.where(moves, np.maximum(frac, 0) * c, 0.0)
    # The rate at which air must enter for so much energy to be left (Peters et al. 2023, their fractional entrainment).
    left, buoyant = np.where(moves, ecape / c, 1.0), np.where(moves, ecape / c + ncape / c, 1.0)
    rate = np.where(moves & (buoyant > 1e-9), 2 * (1 - left) / np.maximum(buoyant, 1e-9) / np.where(moves, el, 1.0), 0.0)
    ecin = np.where(free, _entrained_inhibition(grid, zg, tg, rg, t0, r0, np.maximum(rate, 0.0)), 0.0)
    return {
        "cape": cape, "cin": cin, "lcl_m": z_lcl, "lfc_m": np.where(free, _at(zg, first), np.nan), "el_m": np.where(free, el, np.nan),
        "lifted_index": li, "ecape": ecape, "ncape": np.where(free, ncape, 0.0), "ecin": ecin,
    }


def _start(kind: str, p: np.ndarray, t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, temperature and mixing ratio with which a kind of parcel sets out in each column."""
    theta, ground = (t + 273.15) * (1000 / p) ** KAPPA, np.zeros(len(p), np.int64)
    if kind == "sb":
        return ground, t[:, 0], r[:, 0]
    if kind == "ml":  # mean of the lowest 100 hPa
        low = p >= p[:, :1] - 100
        th, q = ((x * low).sum(1) / low.sum(1) for x in (theta, r))
        return ground, th * (p[:, 0] / 1000) ** KAPPA - 273.15, q
    # Greatest equivalent potential temperature in the lowest 300 hPa.
    best = np.where(p >= p[:, :1] - 300, theta * np.exp(LV * r / (CP * (t + 273.15))), -np.inf).argmax(1)
    return best, _at(t, best), _at(r, best)


def _layer_mean(z: np.ndarray, x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Height-weighted mean of each column between two heights over its lowest level, by the trapezoid rule; NaN where it does not reach them."""
    z = z - z[:, :1]
    a, b = np.clip(z[:, :-1], lo, hi), np.clip(z[:, 1:], lo, hi)
    slope = np.diff(x) / np.diff(z)
    xa, xb = x[:, :-1] + slope * (a - z[:, :-1]), x[:, :-1] + slope * (b - z[:, :-1])
    return np.where(z[:, -1] >= hi, ((xa + xb) / 2 * (b - a)).sum(1) / (hi - lo), np.nan)


def inflow(z: np.ndarray, u: np.ndarray, v: np.ndarray, motion: str) -> np.ndarray:
    """Speed of the mean wind of the lowest kilometre relative to a storm.

    ``mean_wind``: it moves with the mean of all levels; ``right_moving``,
    ``left_moving``: with the 0-6 km mean and 7.5 m/s across the shear between its
    outer half kilometres (Bunkers et al. 2000); columns under 6 km take the mean wind.
    """
    low = z <= z[:, :1] + 1000
    near = [(x * low).sum(1) / low.sum(1) for x in (u, v)]
    mean = [x.mean(1) for x in (u, v)]
    if motion != "mean_wind":
        (mu, mv), (bu, bv), (tu, tv) = (tuple(_layer_mean(z, x, *ab) for x in (u, v)) for ab in ((0.0, 6000.0), (0.0, 500.0), (5500.0, 6000.0)))
        du, dv, side = tu - bu, tv - bv, 7.5 if motion == "right_moving" else -7.5
        n = np.hypot(du, dv)
        cross = np.where(n > 0, side / np.where(n > 0, n, 1), 0.0)
        mean = [np.where(np.isnan(mu), m, x) for m, x in zip(mean, (mu + cross * dv, mv - cross * du), strict=True)]
    return np.hypot(mean[0] - near[0], mean[1] - near[1])


def _lift(levels: pa.StructArray, offsets: np.ndarray, kinds: tuple[str, ...], motion: str) -> dict[str, np.ndarray]:
    """Results of all columns, kind after kind; columns of equal depth are lifted together."""
    depth, n = np.diff(offsets), len(offsets) - 1
    values = [np.asarray(x.fill_null(0.0) if i > 3 else x, float) for i, x in enumerate(levels.flatten())]
    out = {c: np.full((len(kinds), n), np.nan) for c in NUMBERS} | {"failed": np.ones((len(kinds), n), bool)}
    for d in np.unique(depth[depth >= 4]):
        at = np.flatnonzero(depth == d)
        spot = offsets[at][:, None] + np.arange(d)[None, :]
        good = (np.diff(values[0][spot]) < 0).all(1) & (np.diff(values[1][spot]) > 0).all(1)
        at, spot = at[good], spot[good]
        if not len(at):
            continue
        p, z, t, r, u, v = (x[spot] for x in values)
        r = np.maximum(r, 1e-10)
        speed = inflow(z, u, v, motion)
        for i, kind in enumerate(kinds):
            for c, x in ascend(p, z, t, r, *_start(kind, p, t, r), speed).items():
                out[c][i, at] = x
            out["failed"][i, at] = False
    return out


def parcel(levels: DataFrame, keys: list[str], kinds: tuple[str, ...] = ("sb", "ml", "mu"), motion: str = "mean_wind") -> DataFrame:
    """One row for each column and kind of parcel; ``levels`` has p_hpa, z_m, t_c, q, u and v.

    ncape is the energy that dry air takes from a mixing parcel, ecin the
    inhibition of a parcel that entrains at the rate its ecape implies; ``motion`` as in ``inflow``.

    A column is gathered into one array (its levels only), sorted from high to
    low pressure; numpy lifts all columns of a batch that have the same number
    of levels together. Columns with fewer than four whole levels, or whose
    pressures do not fall, come back as failed. Formulas are published parcel theory.
    """
    if motion not in MOTIONS:
        raise ValueError(f"motion is one of {MOTIONS}")
    whole = levels.where("p_hpa is not null and z_m is not null and t_c is not null and q is not null")
    number = {c: F.col(c).cast("double").alias(c) for c in ("p_hpa", "z_m", "t_c", "q", "u", "v")}
    cols = whole.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct(*number.values())))).alias("_levels"))
    kept = ", ".join(f"`{k}` {t}" for k, t in levels.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("_levels"), batch.num_rows
            got = _lift(lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py(), kinds, motion)
            rows = pa.array(np.tile(np.arange(n), len(kinds)))
            own = [batch.column(k).take(rows) for k in keys]
            kind = pa.array(np.repeat(np.array(kinds, object), n), pa.string())
            numbers = [pa.array(got[c].ravel(), pa.float64(), from_pandas=True) for c in NUMBERS]
            yield pa.RecordBatch.from_arrays([*own, kind, *numbers, pa.array(got["failed"].ravel())], names=[*keys, "kind", *NUMBERS, "failed"])

    return cols.mapInArrow(run, f"{kept}, {OUT}")


def ecape_fields(levels: DataFrame, keys: list[str], native: DataFrame | None = None, motion: str = "right_moving") -> DataFrame:
    """One row for each column: entraining instability of the three parcels, its ratios to the undiluted and its indices, from one ascent.

    Heights count from the ground, where ``levels`` begins. ``native`` (keys and any
    of sbcape, mlcape, mucape) adds ratios to instability from elsewhere. A ratio needs
    100 J/kg. ``failures`` counts the parcels of a column that could not be lifted.
    """
    lifted = parcel(levels, keys, motion=motion)
    own = {f"{k}_{c}": F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("sb", "ml", "mu") for c in ("cape", "ecape", "ncape", "ecin", "lcl_m")}
    j = lifted.groupBy(*keys).agg(*own.values(), F.count_if("failed").alias("failures")).join(wind_bundle(levels, keys), keys, "left")
    c = F.col
    fields = {
        **{f"{k}ecape": c(f"{k}_ecape") for k in ("sb", "ml", "mu")},
        **{f"{k}_ecape_derived_cape_ratio": T.ratio_guarded(c(f"{k}_ecape"), c(f"{k}_cape")) for k in ("sb", "ml", "mu")},
        "sbncape": c("sb_ncape"), "sbecin": c("sb_ecin"), "mlecin": c("ml_ecin"),
        "ecape_scp": T.scp(c("mu_ecape"), c("srh_0_3km"), c("shear_0_6km")),
        "ecape_ehi_0_1km": T.ehi(c("sb_ecape"), c("srh_0_1km")), "ecape_ehi_0_3km": T.ehi(c("sb_ecape"), c("srh_0_3km")),
        "ecape_stp": T.stp_effective(c("ml_ecape"), c("ml_lcl_m"), c("srh_0_1km"), c("shear_0_6km"), c("ml_ecin")),
    }
    if native is not None:
        kinds = [k for k in ("sb", "ml", "mu") if f"{k}cape" in native.columns]
        j = j.join(native.select(*keys, *(c(f"{k}cape").alias(f"_{k}") for k in kinds)), keys, "left")
        fields |= {f"{k}_ecape_native_cape_ratio": T.ratio_guarded(c(f"{k}_ecape"), c(f"_{k}")) for k in kinds}
    return j.select(*keys, *(x.alias(n) for n, x in fields.items()), "failures")
