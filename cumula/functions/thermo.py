"""Moisture, heat and severe-weather indices as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DRY_GAS, GRAVITY = 287.0, 9.81
SLP_GAS, SLP_GRAVITY = 287.04, 9.81
MPH_PER_MS = 2.2369362920544


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def positive(x: Column) -> Column:
    return at_least(x, 0)


def es(t: Column) -> Column:
    """Saturation vapour pressure in hPa over water, t in degrees C."""
    return 6.112 * F.exp(17.67 * t / (t + 243.5))


def es_tetens(t: Column) -> Column:
    return 6.1078 * F.exp(17.27 * t / (t + 237.3))


def dewpoint_e(e: Column) -> Column:
    """Dewpoint from a vapour pressure in hPa; null where it is not positive."""
    ln = F.ln(F.when(e > 0, e) / 6.112)
    return 243.5 * ln / (17.67 - ln)


def dewpoint_q(p: Column, q: Column, floor: float = 0.0) -> Column:
    """Dewpoint from pressure in hPa and mixing ratio in kg/kg, kept at or above ``floor``."""
    r = at_least(q, floor)
    return dewpoint_e(at_least(r * p / (0.622 + r), 1e-10))


def dewpoint_rh(t: Column, rh: Column) -> Column:
    return dewpoint_e(es(t) * clamp(rh, 0, 100) / 100)


def mixing_ratio_e(p: Column, e: Column) -> Column:
    return 0.622 * e / at_least(p - e, 1e-6)


def mixing_ratio_td(p: Column, td: Column) -> Column:
    return mixing_ratio_e(p, es(td))


def mixing_ratio_rh(p: Column, t: Column, rh: Column) -> Column:
    """The relative humidity, as a fraction, is held between 0 and 1.5."""
    return mixing_ratio_e(p, es(t) * clamp(rh / 100, 0, 1.5))


def specific_to_mixing(q: Column) -> Column:
    return q / at_least(1 - q, 1e-6)


def mixing_to_specific(r: Column) -> Column:
    return r / (1 + r)


def moisture(p: Column, t: Column, q: Column, td: Column, rh: Column) -> Column:
    """Mixing ratio from the first of q, dewpoint and humidity that is there."""
    return F.coalesce(q, mixing_ratio_td(p, td), mixing_ratio_rh(p, t, rh))


def rh_q(t: Column, p: Column, r: Column) -> Column:
    q = positive(r)
    return clamp(100 * (q * p / (0.622 + q)) / es(t), 0, 100)


def rh_td(t: Column, td: Column) -> Column:
    return clamp(100 * es(td) / es(t), 0, 100)


def lcl_kelvin(t: Column, td: Column) -> Column:
    """Temperature of the lifting condensation level (Bolton 1980, eq. 15)."""
    return 1 / (1 / (td + 273.15 - 56) + F.ln((t + 273.15) / (td + 273.15)) / 800) + 56


def theta_e(p: Column, t: Column, td: Column) -> Column:
    """Equivalent potential temperature in K (Bolton 1980, eq. 43)."""
    r, k = mixing_ratio_td(p, td), lcl_kelvin(t, td)
    theta = (t + 273.15) * F.pow(1000 / p, 0.2854 * (1 - 0.28 * r))
    return theta * F.exp((3.376 / k - 0.00254) * 1000 * r * (1 + 0.81 * r))


def vpd_rh(t: Column, rh: Column) -> Column:
    return es(t) * (1 - clamp(rh / 100, 0, 1))


def vpd_td(t: Column, td: Column) -> Column:
    return positive(es(t) - es(td))


def vpd_tetens(t: Column, rh: Column) -> Column:
    return positive(es_tetens(t) * (1 - clamp(rh / 100, 0, 1)))


def dewpoint_depression(t: Column, td: Column, signed: bool = False) -> Column:
    return t - td if signed else positive(t - td)


def wetbulb_stull(t: Column, rh: Column) -> Column:
    h = clamp(rh, 0, 100)
    return t * F.atan(0.151977 * F.sqrt(h + 8.313659)) + F.atan(t + h) - F.atan(h - 1.676331) + 0.00391838 * F.pow(h, 1.5) * F.atan(0.023101 * h) - 4.686035


def wetbulb(p: Column, t: Column, td: Column, steps: int = 40) -> Column:
    """Wet bulb by bisection of the psychrometric equation between dewpoint and temperature."""
    e = es(td)
    start = F.struct(F.least(t, td).alias("a"), t.alias("b"), t.alias("t"), p.alias("p"), e.alias("e"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        high = es(mid) - 0.00066 * (1 + 0.00115 * mid) * s["p"] * (s["t"] - mid) > s["e"]
        return F.struct(F.when(high, s["a"]).otherwise(mid).alias("a"), F.when(high, mid).otherwise(s["b"]).alias("b"), s["t"].alias("t"), s["p"].alias("p"), s["e"].alias("e"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)
    return F.when((p + t + td).isNotNull(), found)


def heat_index(t: Column, rh: Column) -> Column:
    """Rothfusz regression with both published adjustments; the simple form below 80 F. Degrees C."""
    f, h = t * 1.8 + 32, clamp(rh, 0, 100)
    simple = 0.5 * (f + 61 + (f - 68) * 1.2 + h * 0.094)
    full = -42.379 + 2.04901523 * f + 10.14333127 * h - 0.22475541 * f * h - 0.00683783 * f * f - 0.05481717 * h * h + 0.00122874 * f * f * h + 0.00085282 * f * h * h - 0.00000199 * f * f * h * h
    dry = (13 - h) / 4 * F.sqrt(F.greatest((17 - F.abs(f - 95)) / 17, F.lit(0.0)))
    wet = (h - 85) / 10 * ((87 - f) / 5)
    adjusted = full - F.when((h < 13) & (f >= 80) & (f <= 112), dry).otherwise(0.0) + F.when((h > 85) & (f >= 80) & (f <= 87), wet).otherwise(0.0)
    return (F.when((simple + f) / 2 >= 80, adjusted).otherwise(simple) - 32) / 1.8


def wind_chill(t: Column, wind_ms: Column) -> Column:
    """The 2001 index where it is 10 C or colder and the wind is over 4.8 km/h, else the temperature."""
    v = F.pow(F.greatest(wind_ms * 3.6, F.lit(0.0)), 0.16)
    chill = F.when((t <= 10) & (wind_ms * 3.6 > 4.8), 13.12 + 0.6215 * t - 11.37 * v + 0.3965 * t * v).otherwise(t)
    return F.when(wind_ms.isNotNull(), chill)


def apparent(t: Column, rh: Column, wind_ms: Column) -> Column:
    return F.when(t >= 80 / 1.8 - 32 / 1.8, heat_index(t, rh)).otherwise(wind_chill(t, wind_ms))


def fosberg(t: Column, rh: Column, wind_ms: Column) -> Column:
    """Fosberg fire-weather index from degrees C, percent and m/s."""
    f, h = t * 1.8 + 32, clamp(rh, 0, 100)
    m = (
        F.when(h <= 10, 0.03229 + 0.281073 * h - 0.000578 * h * f)
        .when(h <= 50, 2.22749 + 0.160107 * h - 0.01478 * f)
        .otherwise(21.0606 + 0.005565 * h * h - 0.00035 * h * f - 0.483199 * h)
    ) / 30
    damp = 1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m
    return damp * F.sqrt(1 + F.pow(wind_ms * MPH_PER_MS, 2.0)) / 0.3002


def hdw(vpd: Column, wind_ms: Column) -> Column:
    return vpd * wind_ms


def fire_weather(t: Column, rh: Column, wind_ms: Column, vpd: Column) -> Column:
    return clamp(0.5 * fosberg(t, rh, wind_ms) + 0.5 * clamp(hdw(vpd, wind_ms), 0, 100), 0, 100)


def ehi(cape: Column, srh: Column) -> Column:
    return cape * srh / 160000


def _stp(cape: Column, lcl: Column, srh: Column, shear: Column) -> Column:
    low = F.when(lcl >= 2000, 0.0).when(lcl <= 1000, 1.0).otherwise((2000 - lcl) / 1000)
    wind = F.when(shear < 12.5, 0.0).when(shear >= 30, 1.5).otherwise(shear / 20)
    return positive(cape / 1500) * low * positive(srh / 150) * wind


def stp_fixed(cape: Column, lcl: Column, srh: Column, shear: Column) -> Column:
    return _stp(cape, lcl, srh, shear)


def stp_effective(cape: Column, lcl: Column, srh: Column, ebwd: Column, cin: Column) -> Column:
    return _stp(cape, lcl, srh, ebwd) * clamp((200 + cin) / 150, 0, 1)


def scp(cape: Column, srh: Column, shear: Column) -> Column:
    return positive(cape / 1000) * positive(srh / 50) * F.when(shear > 20, 1.0).when(shear < 10, 0.0).otherwise(shear / 20)


def ship(cape: Column, shear: Column, t500: Column, lapse: Column, r500_gkg: Column) -> Column:
    c = positive(cape)
    raw = c * positive(r500_gkg) * positive(lapse) * positive(-t500) * positive(shear) / 42_000_000
    return F.when(c < 1300, raw * c / 1300).otherwise(raw)


def bri(cape: Column, shear: Column) -> Column:
    d = 0.5 * shear * shear
    return F.when(d > 0.1, F.try_divide(positive(cape), d)).otherwise(0.0)


def ratio_guarded(a: Column, b: Column, least: float = 100.0) -> Column:
    """a / b where b reaches ``least``, else null."""
    return F.when(b >= least, F.try_divide(a, b))


def virtual_temp(t: Column, td: Column, p: Column) -> Column:
    """Virtual temperature in degrees C."""
    r = mixing_ratio_td(p, td)
    return (t + 273.15) * (1 + r / 0.622) / (1 + r) - 273.15


def moisture_transport(q: Column, u: Column, v: Column) -> Column:
    return q * 1000 * F.sqrt(u * u + v * v)


def sim_dbz(t_k: Column, p_pa: Column, qv: Column, rain: Column, snow: Column, graupel: Column) -> Column:
    """Simulated reflectivity of rain, snow and graupel with fixed intercepts."""
    seven, water, alpha = 720.0, 1000.0, 0.224
    density, intercept = {"r": 1000.0, "s": 100.0, "g": 400.0}, {"r": 8e6, "s": 2e7, "g": 4e6}
    factor = {k: seven * 1e18 * (1 / (math.pi * d)) ** 1.75 * (1.0 if k == "r" else (d / water) ** 2 * alpha) / intercept[k] ** 0.75 for k, d in density.items()}
    q, r, s, g = (positive(x) for x in (qv, rain, snow, graupel))
    air = p_pa / (DRY_GAS * t_k * (0.622 + q) / (0.622 * (1 + q)))
    frozen = (s == 0) & (t_k < 273.15)
    r, s = F.when(frozen, 0.0).otherwise(r), F.when(frozen, r).otherwise(s)
    return 10 * F.log10(at_least(sum(factor[k] * F.pow(air * x, 1.75) for k, x in (("r", r), ("s", s), ("g", g))), 0.001))


def full_pressure(p: Column, base: Column) -> Column:
    return p + base


def theta_from_perturbation(t: Column) -> Column:
    return t + 300


def temperature_from_theta(theta: Column, p_pa: Column) -> Column:
    return theta * F.pow(p_pa / 100000, 287.0 / 1004.0)


def geopotential_height(ph: Column, base: Column) -> Column:
    return (ph + base) / GRAVITY


def standard_height(p_hpa: Column) -> Column:
    return 44330 * (1 - F.pow(p_hpa / 1013.25, 0.1903))


def slp_simple(p_pa: Column, t_k: Column, qv: Column, z: Column) -> Column:
    tv = t_k * (1 + 0.608 * positive(qv))
    return p_pa * F.exp(SLP_GRAVITY * positive(z) / (SLP_GAS * at_least(tv, 150)))


def total_precip(acc_c: Column, acc_nc: Column, rain_c: Column, rain_nc: Column, land: Column) -> Column:
    """The first sum that is there: accumulated parts, run totals, the land model's."""
    return F.coalesce(acc_c + acc_nc, rain_c + rain_nc, land)
