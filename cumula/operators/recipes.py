"""Fields by name: catalogues of what each needs, and one pass for each kind of ingredient that a request needs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.functions import wind as W
from cumula.operators import parcels as PA
from cumula.operators import profile as P
from cumula.operators import requests as Q
from cumula.operators import stencil as S
from cumula.operators.windows import hourly_precip

c = F.col


@dataclass(frozen=True)
class Recipe:
    """A field: the columns it is made of, how, its unit, level and kind."""

    needs: tuple[str, ...]
    make: Callable[[], Column]
    units: str = ""
    level: str = "surface"
    kind: str = "derived"


def _same(name: str, units: str, level: str = "surface", kind: str = "decoded_surface", scale: float = 1.0, add: float = 0.0) -> Recipe:
    return Recipe((name,), lambda: c(name) * scale + add if scale != 1 or add else c(name), units, level, kind)


def _of(f: Callable[..., Column], *names: str, units: str = "", level: str = "surface", kind: str = "derived") -> Recipe:
    return Recipe(names, lambda: f(*map(c, names)), units, level, kind)


#: Steps on the way that requests may not name. Ingredients begin with their source: sfc_ (a surface column), p850_ (a column at
#: 850 hPa), sb_, ml_, mu_ (a parcel's result), wind_, kin_, lapse_, adv_ (results of those passes), native_ (instability from elsewhere).
STEPS: dict[str, Recipe] = {
    "_td": _of(T.dewpoint_q, "sfc_p_hpa", "sfc_q"),
    "_rh": _of(T.rh_td, "sfc_t_c", "_td"),
    "_ws": _of(W.wind_speed, "sfc_u", "sfc_v"),
    "_vpd": _of(T.vpd_td, "sfc_t_c", "_td"),
}

_PARTS = {"cape": ("cape", "J/kg"), "cin": ("cin", "J/kg"), "lcl": ("lcl_m", "m"), "ecape": ("ecape", "J/kg"), "ncape": ("ncape", "J/kg"), "ecin": ("ecin", "J/kg")}


def _parcel(names: str) -> dict[str, Recipe]:
    return {n: _same(f"{n[:2]}_{_PARTS[n[2:]][0]}", _PARTS[n[2:]][1], "column", "heavy" if "ecape" in n or "ncape" in n or "ecin" in n else "derived") for n in names.split()}


#: Derived fields by name. The names.
DERIVED: dict[str, Recipe] = {
    **_parcel("sbcape sbcin sblcl mlcape mlcin mucape mucin sbecape mlecape muecape sbncape sbecin mlecin"),
    **{f"{k}_ecape_derived_cape_ratio": _of(T.ratio_guarded, f"{k}_ecape", f"{k}_cape", units="ratio", level="column", kind="heavy") for k in ("sb", "ml", "mu")},
    **{f"{k}_ecape_native_cape_ratio": _of(T.ratio_guarded, f"{k}_ecape", f"native_{k}cape", units="ratio", level="column", kind="heavy") for k in ("sb", "ml", "mu")},
    "ecape_scp": _of(T.scp, "mu_ecape", "wind_srh_0_3km", "wind_shear_0_6km", level="column", kind="heavy"),
    "ecape_ehi_0_1km": _of(T.ehi, "sb_ecape", "wind_srh_0_1km", level="column", kind="heavy"),
    "ecape_ehi_0_3km": _of(T.ehi, "sb_ecape", "wind_srh_0_3km", level="column", kind="heavy"),
    "ecape_stp": _of(T.stp_effective, "ml_ecape", "ml_lcl_m", "wind_srh_0_1km", "wind_shear_0_6km", "ml_ecin", level="column", kind="heavy"),
    "theta_e_2m_10m_winds": _of(T.theta_e, "sfc_p_hpa", "sfc_t_c", "_td", units="K"),
    "vpd_2m": _same("_vpd", "hPa", kind="derived"),
    "dewpoint_depression_2m": _of(T.dewpoint_depression, "sfc_t_c", "_td", units="K"),
    "wetbulb_2m": _of(T.wetbulb, "sfc_p_hpa", "sfc_t_c", "_td", units="degC"),
    "fire_weather_composite": _of(T.fire_weather, "sfc_t_c", "_rh", "_ws", "_vpd"),
    "apparent_temperature_2m": _of(T.apparent, "sfc_t_c", "_rh", "_ws", units="degC"),
    "heat_index_2m": _of(T.heat_index, "sfc_t_c", "_rh", units="degC"),
    "wind_chill_2m": _of(T.wind_chill, "sfc_t_c", "_ws", units="degC"),
    "lifted_index": _same("sb_lifted_index", "K", "column", "derived"),
    "lapse_rate_700_500": _same("lapse_700_500", "K/km", "column", "derived"),
    "lapse_rate_0_3km": _same("lapse_0_3km", "K/km", "column", "derived"),
    "bulk_shear_0_1km": _same("kin_shear_0_1km", "m/s", "column", "derived"),
    "bulk_shear_0_6km": _same("kin_shear_0_6km", "m/s", "column", "derived"),
    "srh_0_1km": _same("wind_srh_0_1km", "m^2/s^2", "column", "derived"),
    "srh_0_3km": _same("wind_srh_0_3km", "m^2/s^2", "column", "derived"),
    "ehi_0_1km": _of(T.ehi, "sb_cape", "wind_srh_0_1km", level="column"),
    "ehi_0_3km": _of(T.ehi, "sb_cape", "wind_srh_0_3km", level="column"),
    "stp_fixed": _of(T.stp_fixed, "sb_cape", "sb_lcl_m", "wind_srh_0_1km", "kin_shear_0_6km", level="column"),
    "scp_mu_0_3km_0_6km_proxy": _of(T.scp, "mu_cape", "wind_srh_0_3km", "kin_shear_0_6km", level="column"),
    "temperature_advection_700mb": _same("adv_700", "K/h", "700 hPa", "derived"),
    "temperature_advection_850mb": _same("adv_850", "K/h", "850 hPa", "derived"),
}
#: Names that are known and not made, and why.
BLOCKED = dict.fromkeys(("stp_effective", "scp", "scp_effective"), "needs an effective inflow layer")

#: Channels of training samples. Names and units.
CHANNELS: dict[str, Recipe] = {
    "t2m": _same("sfc_t_c", "K", add=273.15),
    "d2m": Recipe(("_td",), lambda: c("_td") + 273.15, "K"),
    "q2m": _same("sfc_q", "kg/kg"),
    "u10": _same("sfc_u", "m/s"),
    "v10": _same("sfc_v", "m/s"),
    "wind_speed": _same("_ws", "m/s", kind="derived"),
    "wind_direction": _of(W.wind_dir, "sfc_u", "sfc_v", units="deg"),
    "relative_humidity": _same("_rh", "%", kind="derived"),
    "cape": _same("sb_cape", "J/kg", "column", "derived"),
    "refc": _same("sfc_refc", "dBZ", "entire_atmosphere", "direct_field"),
    "mslp": _same("sfc_mslp_hpa", "Pa", kind="direct_field", scale=100.0),
    "terrain": _same("sfc_orog_m", "m"),
    **{f"t{p}": _same(f"p{p}_t_c", "K", f"{p} hPa", "decoded_pressure_level", add=273.15) for p in (925, 850, 700)},
    **{f"rh{p}": Recipe((f"p{p}_t_c", f"p{p}_q"), lambda p=p: T.rh_td(c(f"p{p}_t_c"), T.dewpoint_q(F.lit(float(p)), c(f"p{p}_q"))), "%", f"{p} hPa", "decoded_pressure_level") for p in (925, 850, 700)},
    **{f"z{p}": _same(f"p{p}_z_m", "m", f"{p} hPa", "decoded_pressure_level") for p in (925, 850, 700)},
    **{f"{w}{p}": _same(f"p{p}_{w}", "m/s", f"{p} hPa", "decoded_pressure_level") for w in "uv" for p in (925, 850, 700)},
    **_parcel("sbcape sbcin mlcape mlcin mucape"),
    "srh01": _same("wind_srh_0_1km", "m^2/s^2", "column", "derived"),
    "srh03": _same("wind_srh_0_3km", "m^2/s^2", "column", "derived"),
    "shear06": _same("kin_shear_0_6km", "kt", "column", "derived", scale=1 / W.MS_PER_KT),
    **_parcel("sblcl sbecape mlecape muecape"),
}
#: A channel that is another under an older name.
ALIASES = {"cape": "sbcape"}
_SURFACE = ("t2m", "d2m", "q2m", "u10", "v10", "wind_speed", "wind_direction", "relative_humidity")
_COLUMN = tuple(n for n in CHANNELS if n not in (*_SURFACE, "cape", "refc", "mslp", "terrain"))
#: Channels of each preset, and what a model's files lack.
PRESETS = {"mesoconvective_v1": (*_SURFACE, "cape", "refc"), "hybrid_column_v1": (*_SURFACE, "mslp", "terrain", "refc", *_COLUMN)}
LACKING = {"rrfs-a": ("mslp", "refc")}
ECAPE_CHANNELS = ("sbecape", "mlecape", "muecape")


def preset_channels(preset: str, model: str = "hrrr", ecape: bool = True) -> list[str]:
    """Channels of a preset for a model, without those that its files lack, and without the entraining ones on demand."""
    if preset not in PRESETS:
        raise ValueError(f"{preset} is none of {sorted(PRESETS)}")
    out = [n for n in PRESETS[preset] if n not in LACKING.get(model, ()) and (ecape or n not in ECAPE_CHANNELS)]
    if not out:
        raise ValueError(f"{preset} has no channel")
    return out


def channel_catalog(spark: SparkSession) -> DataFrame:
    """(name, canonical_name, units, level, level_hpa, height_m_agl, kind, alias_of) of every channel."""
    rows = []
    for n, r in CHANNELS.items():
        hpa = float(r.level.split()[0]) if r.level.endswith("hPa") else None
        height = 10.0 if n in ("u10", "v10", "wind_speed", "wind_direction") else 2.0 if n in _SURFACE else None
        rows.append((n, ALIASES.get(n, n), r.units, r.level, hpa, height, r.kind, ALIASES.get(n)))
    return spark.createDataFrame(rows, "name string, canonical_name string, units string, level string, level_hpa double, height_m_agl double, kind string, alias_of string")


class Planner:
    """Which of the names asked for can be made of the columns at hand, and in which passes."""

    def __init__(self, table: dict[str, Recipe], surface: Iterable[str] = (), levels: Iterable[str] = (), native: Iterable[str] = (), spacing: bool = False):
        self.table, self.surface, self.levels, self.native, self.spacing = table, set(surface), set(levels), set(native), spacing

    def lacks(self, name: str) -> str | None:
        """Why an ingredient is not at hand, if it is not."""
        source, _, rest = name.partition("_")
        column = {"t_c", "u", "v", "q", "z_m", "p_hpa"}
        if source == "sfc":
            return None if rest in self.surface else f"no surface column {rest}"
        if source == "native":
            return None if rest in self.native else f"no native {rest}"
        if re.fullmatch(r"p\d+", source):
            return None if {rest, "p_hpa"} <= self.levels else f"no level column {rest}"
        needs = {"sb": column, "ml": column, "mu": column, "wind": {"u", "v", "z_m"}, "kin": {"u", "v", "z_m"}, "lapse": {"t_c", "z_m", "p_hpa", "q"}, "adv": {"t_c", "u", "v", "p_hpa", "y", "x"}}[source]
        if short := sorted(needs - self.levels):
            return f"no level column {short[0]}"
        return "no grid spacing" if source == "adv" and not self.spacing else None

    def closure(self, name: str) -> tuple[list[str], list[str]]:
        """(steps in order, raw ingredients) of a name."""
        steps, raw = [], []

        def visit(n: str) -> None:
            for need in (self.table.get(n) or STEPS[n]).needs:
                if need in STEPS:
                    if need not in steps:
                        visit(need)
                        steps.append(need)
                elif need not in raw:
                    raw.append(need)

        visit(name)
        return steps, raw

    def reason(self, name: str) -> str | None:
        """Why a name cannot be made, null if it can."""
        if name in BLOCKED:
            return BLOCKED[name]
        if name not in self.table:
            return "unknown"
        return next((x for x in map(self.lacks, self.closure(name)[1]) if x), None)


def at_pressures(levels: DataFrame, keys: list[str], wanted: dict[int, set[str]]) -> DataFrame:
    """Columns p<hPa>_<name> of each column's values at several pressures, linear in the logarithm, in one pass over the levels."""
    names = sorted(set().union(*wanted.values()))
    w = Win.partitionBy(*keys).orderBy("p_hpa")
    own = levels.where("p_hpa is not null").select(*keys, "p_hpa", F.lead("p_hpa").over(w).alias("_p"), *(c(n) for n in names), *(F.lead(n).over(w).alias(f"_{n}") for n in names))
    out = []
    for hpa, some in sorted(wanted.items()):
        hit = (c("p_hpa") <= hpa) & ((c("_p") > hpa) | ((c("p_hpa") == hpa) & c("_p").isNull()))
        f = F.ln(F.lit(float(hpa)) / c("p_hpa")) / F.ln(c("_p") / c("p_hpa"))
        out += [F.max(F.when(hit, F.when(c("p_hpa") == hpa, c(n)).otherwise(c(n) + f * (c(f"_{n}") - c(n))))).alias(f"p{hpa}_{n}") for n in sorted(some)]
    return own.groupBy(*keys).agg(*out)


def make_fields(names: list[str], keys: list[str], surface: DataFrame, levels: DataFrame | None = None, native: DataFrame | None = None, spacing: tuple[float, float] | None = None, table: dict[str, Recipe] | None = None) -> DataFrame:
    """``keys`` and the fields asked for, by the names of ``table`` (derived recipes by default), for every cell of ``surface``.

    What the request needs is gathered by kind: all pressures in one pass, one
    wind pass, one ascent for the kinds of parcel needed, and so on; what it does
    not need is not computed. Names that cannot be made are an error that gives the
    reasons; ``Planner.reason`` tells them beforehand. Heights of ``levels`` count from the
    ground. ``spacing``: metres between columns and rows (levels then have y and x).
    """
    table = DERIVED if table is None else table
    plan = Planner(table, surface.columns, levels.columns if levels is not None else (), native.columns if native is not None else (), spacing is not None)
    wrong = {n: r for n in names if (r := plan.reason(n))}
    if wrong:
        raise ValueError(f"cannot be made: {wrong}")
    steps, raw = [], []
    for n in names:
        s, r = plan.closure(n)
        steps += [x for x in s if x not in steps]
        raw += [x for x in r if x not in raw]
    of = lambda *sources: [x for x in raw if x.split("_")[0] in sources]
    out = surface.select(*keys, *(c(x[4:]).alias(x) for x in of("sfc")))
    pressures: dict[int, set[str]] = {}
    for x in raw:
        if m := re.fullmatch(r"p(\d+)_(\w+)", x):
            pressures.setdefault(int(m[1]), set()).add(m[2])
    for x in of("adv"):
        pressures.setdefault(int(x[4:]), set()).update(("t_c", "u", "v"))
    passes = []
    if pressures:
        at = at_pressures(levels, keys, pressures)
        for x in of("adv"):
            p, own = x[4:], [k for k in keys if k != "grid_index"]
            grid = at.join(surface.select(*keys, "y", "x"), keys).select(*keys, "y", "x", *(c(f"p{p}_{n}").alias(n) for n in ("t_c", "u", "v")))
            passes.append(S.temperature_advection(grid, own, *spacing).select(*keys, c("advection").alias(x)))
        passes.append(at)
    if kinds := tuple(k for k in ("sb", "ml", "mu") if of(k)):
        lifted = PA.parcel(levels, keys, kinds, "right_moving")
        passes.append(lifted.groupBy(*keys).agg(*(F.max(F.when(c("kind") == x[:2], c(x[3:]))).alias(x) for x in of("sb", "ml", "mu"))))
    if of("wind"):
        passes.append(P.wind_bundle(levels, keys).select(*keys, *(c(x[5:]).alias(x) for x in of("wind"))))
    if of("kin"):
        passes.append(Q.column_kinematics(levels, keys).select(*keys, *(c(x[4:]).alias(x) for x in of("kin"))))
    if "lapse_0_3km" in raw:
        passes.append(P.lapse_layer(levels, keys, 0.0, 3000.0).select(*keys, c("lapse").alias("lapse_0_3km")))
    if "lapse_700_500" in raw:
        passes.append(P.lapse_pressure(levels, keys).select(*keys, c("lapse").alias("lapse_700_500")))
    if of("native"):
        passes.append(native.select(*keys, *(c(x[7:]).alias(x) for x in of("native"))))
    for p in passes:
        out = out.join(p, keys, "left")
    for s in steps:
        out = out.withColumn(s, STEPS[s].make())
    return out.select(*keys, *(table[n].make().alias(n) for n in names))


def build_samples(channels: list[str], keys: list[str], surface: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(keys, channel, value): one row for each channel of each cell."""
    wide = make_fields(channels, keys, surface, levels, table=CHANNELS)
    return wide.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("channel"), c(n).cast("double").alias("value")) for n in channels))))


def _direct() -> dict[str, tuple[tuple[str, str], ...]]:
    """Parts (field, level) of every direct product."""
    near, wind = {"temperature": "t", "dewpoint": "td", "relative_humidity": "rh"}, (("u", "10m"), ("v", "10m"))
    out = {f"{p}mb_{a}height_winds": tuple((f, f"{p}mb") for f in (*b, "z", "u", "v")) for a, b, ps in (("", (), (200, 250, 300, 500, 700, 850)), ("temperature_", ("t",), (200, 250, 300, 500, 700, 850)), ("rh_", ("rh",), (200, 300, 500, 700, 850)), ("absolute_vorticity_", ("absv",), (200, 300, 500, 700, 850)), ("dewpoint_", ("td",), (700, 850))) for p in ps}
    for n, f in near.items():
        out |= {f"2m_{n}": ((f, "2m"),), f"2m_{n}_10m_winds": ((f, "2m"), *wind)}
    clouds = {f"{k}_cloud_cover": ((f"cloud_{k}", "atmosphere"),) for k in ("low", "middle", "high")}
    rain = {f"categorical_{k}": ((k, "surface"),) for k in ("rain", "freezing_rain", "ice_pellets", "snow")}
    out |= clouds | rain | {"cloud_cover_levels": tuple(p for v in clouds.values() for p in v), "precipitation_type": tuple(p for v in rain.values() for p in v)}
    out |= {"mslp_10m_winds": (("mslp", "msl"), *wind), "2m_theta_e_10m_winds": (("theta_e", "2m"), *wind), "composite_reflectivity_uh": (("refc", "atmosphere"), ("uh", "2-5km"))}
    single = {
        "10m_wind_gusts": ("gust", "10m"), "precipitable_water": ("pwat", "atmosphere"), "cloud_cover": ("cloud", "atmosphere"), "visibility": ("vis", "surface"),
        "simulated_ir_satellite": ("ir", "top"), "lightning_flash_density": ("flash", "surface"), "total_qpf": ("apcp", "surface"), "1h_qpf": ("apcp_1h", "surface"),
        "2m_heat_index": ("heat_index", "2m"), "2m_wind_chill": ("wind_chill", "2m"), "1km_reflectivity": ("refd", "1km"), "composite_reflectivity": ("refc", "atmosphere"),
        "uh_2to5km": ("uh", "2-5km"), "smoke_pm25_native": ("pm25", "8m"), "smoke_column": ("smoke", "atmosphere"),
    }
    return out | {k: (v,) for k, v in single.items()}


#: Direct products and their parts.
DIRECT = _direct()


def direct_fields(fields: DataFrame, slugs: list[str]) -> DataFrame:
    """Rows of ``fields`` (field, level, ...) under each product asked for, with ``slug`` and ``part`` (its place there).

    A product is a selection: no value changes. One that is unknown or lacks a part
    has one row for it, with the ``reason`` and nulls, and no other. Asked for more than
    once, a product comes once.
    """
    spark = fields.sparkSession
    rows = [(s, i, f, lv) for s in dict.fromkeys(slugs) for i, (f, lv) in enumerate(DIRECT.get(s, ((None, None),)))]
    asked = F.broadcast(spark.createDataFrame(rows, "slug string, part int, field string, level string"))
    there = fields.select("field", "level").distinct().withColumn("_there", F.lit(True))
    state = asked.join(F.broadcast(there), ["field", "level"], "left").groupBy("slug").agg(F.min(F.when(c("_there").isNull(), F.struct("part", "field", "level"))).alias("_lost"))
    ready = state.where("_lost is null").select("slug")
    got = fields.join(F.broadcast(asked.join(ready, "slug")), ["field", "level"]).select("slug", "part", *fields.columns, F.lit(None).cast("string").alias("reason"))
    why = F.when(c("_lost.field").isNull(), "unknown").otherwise(F.concat(F.lit("no "), c("_lost.field"), F.lit(" at "), c("_lost.level")))
    lost = state.where("_lost is not null").select("slug", F.lit(None).cast("int").alias("part"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields.schema), why.alias("reason"))
    return got.unionByName(lost)


#: Variables of a point's series. Names and units. Steps that begin with _ are fallbacks.
POINT_STEPS: dict[str, Recipe] = {
    "_rh0": _of(lambda x: T.clamp(x, 0, 100), "rh"),
    "_td": Recipe(("td_c", "t_c", "_rh0"), lambda: F.coalesce(c("td_c"), T.dewpoint_rh(c("t_c"), c("_rh0")))),
    "_rh": Recipe(("_rh0", "t_c", "_td"), lambda: F.coalesce(c("_rh0"), T.clamp(T.rh_td(c("t_c"), c("_td")), 0, 100))),
    "_p": Recipe(("psfc_hpa", "mslp_hpa"), lambda: F.coalesce(c("psfc_hpa"), c("mslp_hpa"))),
    "_ws": _of(W.wind_speed, "u", "v"),
    "_whole": Recipe(("_p", "t_c", "_td", "u", "v"), lambda: c("_p").isNotNull() & c("t_c").isNotNull() & c("_td").isNotNull() & c("u").isNotNull() & c("v").isNotNull()),
    "_vpd": Recipe(("_whole", "t_c", "_td"), lambda: F.when(c("_whole"), T.vpd_td(c("t_c"), c("_td")))),
}
POINT_VARIABLES: dict[str, Recipe] = {
    "temperature_2m_c": _same("t_c", "degC"),
    "dewpoint_2m_c": _same("_td", "degC"),
    "wetbulb_2m_c": Recipe(("_whole", "_p", "t_c", "_td"), lambda: F.when(c("_whole"), T.wetbulb(c("_p"), c("t_c"), c("_td"))), "degC"),
    "relative_humidity_2m_pct": _same("_rh", "%"),
    "wind_u_10m_ms": _same("u", "m/s"),
    "wind_v_10m_ms": _same("v", "m/s"),
    "wind_speed_10m_ms": _same("_ws", "m/s"),
    "wind_direction_10m_deg": _of(W.wind_dir, "u", "v", units="degrees"),
    "wind_gust_10m_ms": _same("gust", "m/s"),
    "precip_accum_mm": _same("precip", "mm"),
    "precip_hourly_mm": _same("_hourly", "mm"),
    "cloud_low_pct": _same("cloud_low", "%"),
    "cloud_middle_pct": _same("cloud_middle", "%"),
    "cloud_high_pct": _same("cloud_high", "%"),
    "mslp_hpa": _same("mslp_hpa", "hPa"),
    "vpd_2m_hpa": _same("_vpd", "hPa"),
    "hdw": _of(T.hdw, "_vpd", "_ws", units="unitless"),
    "fire_weather_composite": Recipe(("_whole", "t_c", "_td", "_ws", "_vpd"), lambda: F.when(c("_whole"), T.fire_weather(c("t_c"), T.rh_td(c("t_c"), c("_td")), c("_ws"), c("_vpd"))), "unitless"),
}


def point_series(samples: DataFrame, keys: list[str], variables: list[str] | None = None) -> DataFrame:
    """``keys``, fhr and the variables asked for (all 18 by default) of each point and hour, with ``missing``, the names that are null there.

    ``samples`` has keys, fhr and any of t_c, td_c, rh, u, v, gust, precip, cloud_low,
    cloud_middle, cloud_high, mslp_hpa, psfc_hpa; one it lacks counts as null. Dewpoint
    falls back on humidity, humidity on dewpoint, surface pressure on that at sea level;
    wet bulb, deficit and fire weather need all five of their parts. The hourly
    amount is the rise since the hour before. Only what the variables need is worked out.
    """
    names = list(POINT_VARIABLES) if variables is None else variables
    if wrong := [n for n in names if n not in POINT_VARIABLES]:
        raise ValueError(f"unknown variables: {wrong}")
    order: list[str] = []

    def visit(n: str) -> None:
        for need in (POINT_STEPS if n in POINT_STEPS else POINT_VARIABLES)[n].needs:
            if need not in order:
                if need in POINT_STEPS:
                    visit(need)
                order.append(need)

    for n in names:
        visit(n)
    raw = [n for n in order if n not in POINT_STEPS and n != "_hourly"]
    if "_hourly" in order and "precip" not in raw:
        raw.append("precip")
    out = samples.select(*keys, "fhr", *((c(n) if n in samples.columns else F.lit(None).cast("double")).alias(n) for n in raw))
    if "_hourly" in order:
        out = hourly_precip(out.withColumn("value", c("precip")), keys).drop("value").withColumnRenamed("hourly", "_hourly")
    for n in order:
        if n in POINT_STEPS:
            out = out.withColumn(n, POINT_STEPS[n].make())
    out = out.select(*keys, "fhr", *(POINT_VARIABLES[n].make().alias(f"_v_{n}") for n in names))
    out = out.select(*keys, "fhr", *(c(f"_v_{n}").alias(n) for n in names))
    return out.withColumn("missing", F.array_compact(F.array(*(F.when(c(n).isNull(), F.lit(n)) for n in names))))
