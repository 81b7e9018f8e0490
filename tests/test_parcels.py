"""Parcel ascents of columns lifted together, against one column at a time by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import parcels as PA
from cumula.operators.profile import wind_bundle
from cumula.operators.parcels import ALPHA, CP, EPS, KAPPA, LV, MIXING_K2, MIXING_M, PRANDTL, SIGMA, G, _mix, _moist
from cumula.registry import QUERIES


def entrained(grid, zg, tg, rg, t0, r0, rate):
    """Inhibition of a diluted parcel, level by level, its cloudy temperature by halving."""
    energy, water, cloudy, b = CP * (t0 + 273.15) + LV * r0 + G * zg[0], r0, [], []
    for i in range(len(grid)):
        if i:
            kept = math.exp(-rate * (zg[i] - zg[i - 1]))
            h = [CP * (tg[k] + 273.15) + LV * rg[k] + G * zg[k] for k in (i - 1, i)]
            energy, water = energy * kept + sum(h) / 2 * (1 - kept), water * kept + (rg[i] + rg[i - 1]) / 2 * (1 - kept)
        dry = (energy - G * zg[i] - LV * water) / CP - 273.15
        up, vapour = dry, water
        cloudy.append(water > _mix(np.array(grid[i]), np.array(dry)))
        if cloudy[-1]:
            lo, hi = dry, dry + 80
            for _ in range(70):
                up = (lo + hi) / 2
                vapour = float(_mix(np.array(grid[i]), np.array(up)))
                lo, hi = (up, hi) if CP * (up + 273.15) + LV * vapour + G * zg[i] < energy else (lo, up)
        env = (tg[i] + 273.15) * (1 + 0.608 * rg[i])
        b.append(G * ((up + 273.15) * (1 + 0.608 * vapour) - env) / env)
    layers = [((b[i] + b[i + 1]) / 2, zg[i + 1] - zg[i], cloudy[i + 1]) for i in range(len(grid) - 1)]
    first = next((i for i, (m, dz, c) in enumerate(layers) if m > 0 and dz > 0 and c), None)
    return 0.0 if first is None else sum(min(m * dz, 0.0) for m, dz, _ in layers[:first])


def lift(p, z, t, r, p0, t0, r0, speed):
    e0 = max(r0 * p0 / (EPS + r0), 1e-6)
    td0 = min(t0, 243.5 * np.log(e0 / 6.112) / (17.67 - np.log(e0 / 6.112)))
    tl = 1 / (1 / (td0 + 273.15 - 56) + np.log((t0 + 273.15) / (td0 + 273.15)) / 800) + 56
    pl = min(p0, p0 * (tl / (t0 + 273.15)) ** (1 / KAPPA))
    lnp = np.log(p)
    z_lcl = float(np.interp(-np.log(pl), -lnp, z))
    grid = np.unique(np.concatenate((p[p <= p0], [p0], [pl] if pl > p[-1] else [])))[::-1]
    zg, tg, rg = (np.interp(-np.log(grid), -lnp, x) for x in (z, t, r))
    env = (tg + 273.15) * (1 + 0.608 * rg)
    dry = grid >= pl
    up, rp = np.empty_like(grid), np.full_like(grid, r0)
    up[dry] = (t0 + 273.15) * (grid[dry] / p0) ** KAPPA - 273.15
    last_t, last_p = tl - 273.15, pl
    for i in np.flatnonzero(~dry):
        last_t = float(_moist(np.array(last_t), np.array(last_p), np.array(grid[i])))
        last_p, up[i] = grid[i], last_t
        rp[i] = _mix(np.array(grid[i]), np.array(last_t))
    parcel = (up + 273.15) * (1 + 0.608 * rp)
    b = G * (parcel - env) / env
    dz, mid = np.diff(zg), (b[1:] + b[:-1]) / 2
    positive = np.flatnonzero((mid > 0) & (grid[1:] <= pl))
    li = None
    if grid[0] >= 500 >= grid[-1]:
        li = float(np.interp(-np.log(500.0), -np.log(grid), tg) - np.interp(-np.log(500.0), -np.log(grid), up))
    if not len(positive):
        return {"cape": 0.0, "cin": 0.0, "lcl_m": z_lcl, "lfc_m": None, "el_m": None, "lifted_index": li, "ecape": 0.0, "ncape": 0.0, "ecin": 0.0}
    first, top = positive[0], positive[-1]
    cape = float((np.maximum(mid, 0) * dz)[first : top + 1].sum())
    cin = float(np.minimum(mid * dz, 0)[:first].sum())
    el = float(zg[top + 1])
    # Analytic form: psi from the mixing length, NCAPE from the saturated static energy of the environment.
    h = CP * (tg + 273.15) + LV * rg + G * zg
    hs = CP * (tg + 273.15) + LV * _mix(grid, tg) + G * zg
    hbar = np.concatenate(([h[0]], np.cumsum((h[1:] + h[:-1]) / 2 * dz) / (zg[1:] - zg[0])))
    part = -G / (CP * (tg + 273.15)) * (hbar - hs)
    ncape = float((((part[1:] + part[:-1]) / 2) * dz)[first : top + 1].sum())
    rate = 0.0
    if cape <= 0 or speed <= 0:
        ecape = 0.0
    else:
        psi = MIXING_K2 * ALPHA**2 * np.pi**2 * MIXING_M / (4 * PRANDTL * SIGMA**2 * el)
        v2 = speed * speed
        s = v2 / (2 * cape)
        q = (1 + psi + 2 * psi / v2 * ncape) / (4 * psi / v2 * cape)
        inner = (1 + psi + 2 * psi / v2 * ncape) ** 2 + 8 * (psi / v2) * (cape - psi * ncape)
        frac = s - q + np.sqrt(max(inner, 0.0)) / (4 * psi / v2 * cape)
        ecape = float(max(frac, 0.0) * cape)
        if ecape + ncape > 1e-9 * cape:
            rate = max(0.0, 2 * (1 - ecape / cape) / (ecape / cape + ncape / cape) / el)
    ecin = entrained(grid, zg, tg, rg, t0, r0, rate)
    return {"cape": cape, "cin": cin, "lcl_m": z_lcl, "lfc_m": float(zg[first]), "el_m": el, "lifted_index": li, "ecape": ecape, "ncape": ncape, "ecin": ecin}


def starts(p, z, t, r):
    theta = (t + 273.15) * (1000 / p) ** KAPPA
    for kind in ("sb", "ml", "mu"):
        if kind == "sb":
            yield kind, (p[0], t[0], r[0])
        elif kind == "ml":  # mean of the lowest 100 hPa
            low = p >= p[0] - 100
            th, q = theta[low].mean(), r[low].mean()
            yield kind, (p[0], th * (p[0] / 1000) ** KAPPA - 273.15, q)
        else:  # greatest equivalent potential temperature in the lowest 300 hPa
            low = np.flatnonzero(p >= p[0] - 300)
            best = low[np.argmax(theta[low] * np.exp(LV * r[low] / (CP * (t[low] + 273.15))))]
            yield kind, (p[best], t[best], r[best])


def inflow_speed(z, u, v, motion):
    """Speed of the lowest kilometre's wind relative to the storm, one column."""
    low = z <= z[0] + 1000
    near, storm = (u[low].mean(), v[low].mean()), (u.mean(), v.mean())
    if motion != "mean_wind" and z[-1] - z[0] >= 6000:
        fine = np.linspace(0, 6000, 60_001)
        wind = [np.interp(fine, z - z[0], x) for x in (u, v)]
        mean = lambda x, a, b: np.trapezoid(x[(fine >= a) & (fine <= b)], fine[(fine >= a) & (fine <= b)]) / (b - a)
        du, dv = (mean(x, 5500, 6000) - mean(x, 0, 500) for x in wind)
        k = (7.5 if motion == "right_moving" else -7.5) / math.hypot(du, dv)
        storm = (mean(wind[0], 0, 6000) + k * dv, mean(wind[1], 0, 6000) - k * du)
    return math.hypot(storm[0] - near[0], storm[1] - near[1])


def held(levels, keys, motion="mean_wind", rel=1e-7):
    """Compare parcels of all columns with the plain version; returns how many columns were lifted."""
    columns = {}
    for r in levels.collect():
        if None not in (r.p_hpa, r.z_m, r.t_c, r.q):
            columns.setdefault(tuple(r[k] for k in keys), []).append((r.p_hpa, r.z_m, r.t_c, r.q, r.u or 0.0, r.v or 0.0))
    got = {(*(r[k] for k in keys), r.kind): r for r in PA.parcel(levels, keys, motion=motion).collect()}
    assert len(got) == 3 * len(columns)
    lifted = 0
    for key, rows in columns.items():
        a = np.array(sorted(rows, reverse=True), float)
        if len(a) < 4 or (np.diff(a[:, 0]) >= 0).any() or (np.diff(a[:, 1]) <= 0).any():
            assert all(got[*key, k].failed and got[*key, k].cape is None for k in ("sb", "ml", "mu"))
            continue
        lifted += 1
        p, z, t, r = (a[:, i] for i in range(4))
        r = np.maximum(r, 1e-10)
        speed = inflow_speed(z, a[:, 4], a[:, 5], motion)
        for kind, (p0, t0, r0) in starts(p, z, t, r):
            own = got[*key, kind]
            assert not own.failed
            for name, value in lift(p, z, t, r, p0, t0, r0, speed).items():
                assert own[name] == (None if value is None else pytest.approx(value, rel=rel, abs=1e-5 if rel < 1e-6 else 1e-3)), (key, kind, name)
    return lifted


def test_parcels_of_the_table_equal_plain_loops(spark, sf):
    assert held(A.levels(spark, sf), ["run", "grid_index"]) > 0


def test_parcels_of_odd_columns_equal_plain_loops(spark):
    rng, rows = np.random.default_rng(5), []
    for c in range(300):
        n = int(rng.integers(2, 14))
        p = np.sort(rng.uniform(150 if c % 3 else 550, 1020, n))[::-1]
        z = 44330 * (1 - (p / 1013.25) ** 0.19) + 0.0
        t = 32 - 0.0068 * z + rng.normal(0, 2.5, n)
        es = 6.112 * np.exp(17.67 * t / (t + 243.5))
        q = 0.622 * np.minimum(es, 0.9 * p) * rng.uniform(0.2, 1.0, n) / p
        if c % 5 == 0:
            q[0] = 0.622 * es[0] / (p[0] - es[0])  # saturated at the ground
        if c % 11 == 0:
            z[-1] = z[0]  # heights that do not rise
        u, v = rng.normal(10, 8, n), rng.normal(3, 8, n)
        rows += [(c, *map(float, x)) for x in zip(p, z, t, q, u, v, strict=True)]
        rows.append((c, float(p[0]) + 1, None, 20.0, 0.01, None, None))
    kind = "c long, p_hpa double, z_m double, t_c double, q double, u double, v double"
    levels = spark.createDataFrame(rows, kind)
    assert held(levels, ["c"]) > 150
    for motion in ("right_moving", "left_moving"):
        assert held(levels, ["c"], motion, 1e-5) > 150
    with pytest.raises(ValueError, match="motion"):
        PA.parcel(levels, ["c"], motion="up")
    assert PA.parcel(levels.where("c < 0"), ["c"]).count() == 0


def test_ecape_fields_follow_from_parcels_and_winds(spark, sf):
    """Every field of every column, worked out from the parcels and the wind bundle by plain arithmetic."""
    keys = ["run", "grid_index"]
    lv = A.levels(spark, sf).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m")))
    parcels = {(r.run, r.grid_index, r.kind): r for r in PA.parcel(lv, keys, motion="right_moving").collect()}
    winds = {(r.run, r.grid_index): r for r in wind_bundle(lv, keys).collect()}
    native = {(r.run, r.grid_index): r.rh for r in A.surface(spark, sf).collect()}
    rows = QUERIES["ecape_fields"](spark, sf).collect()
    assert len(rows) * 3 == len(parcels)
    ratio = lambda a, b: a / b if a is not None and b is not None and b >= 100 else None
    for r in rows:
        key = (r.run, r.grid_index)
        sb, ml, mu = (parcels[*key, k] for k in ("sb", "ml", "mu"))
        w, rh = winds.get(key), native[key]
        want = {"sbecape": sb.ecape, "mlecape": ml.ecape, "muecape": mu.ecape, "sbncape": sb.ncape, "sbecin": sb.ecin, "mlecin": ml.ecin, "failures": sb.failed + ml.failed + mu.failed}
        want |= {f"{k}_ecape_derived_cape_ratio": ratio(x.ecape, x.cape) for k, x in (("sb", sb), ("ml", ml), ("mu", mu))}
        want |= {"sb_ecape_native_cape_ratio": ratio(sb.ecape, rh * 20), "mu_ecape_native_cape_ratio": ratio(mu.ecape, rh * 15)}
        if w and None not in (w.srh_0_1km, w.srh_0_3km, w.shear_0_6km, sb.ecape):
            s = w.shear_0_6km
            want["ecape_ehi_0_1km"], want["ecape_ehi_0_3km"] = sb.ecape * w.srh_0_1km / 160_000, sb.ecape * w.srh_0_3km / 160_000
            want["ecape_scp"] = max(0, mu.ecape / 1000) * max(0, w.srh_0_3km / 50) * (1 if s > 20 else 0 if s < 10 else s / 20)
            wind = 0 if s < 12.5 else 1.5 if s >= 30 else s / 20
            want["ecape_stp"] = max(0, ml.ecape / 1500) * min(1, max(0, (2000 - ml.lcl_m) / 1000)) * max(0, w.srh_0_1km / 150) * wind * min(1, max(0, (200 + ml.ecin) / 150))
        for name, value in want.items():
            assert r[name] == (None if value is None else pytest.approx(value, abs=6e-5)), (key, name)
