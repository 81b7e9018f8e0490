"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.functions import text as X
from cumula.functions import thermo as T
from cumula.functions import wind as W


def _round(df: DataFrame, *keys: str, digits: int = 5, finer: str = "") -> DataFrame:
    """Doubles to so many digits, two more in the column ``finer``."""
    return df.select(*keys, *(F.round(c, digits + 2 * (c == finer)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


def scalar_moisture(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = A.surface(spark, sf_dir), F.col
    t, td, p, q, rh = c("t_c"), c("td_c"), c("p_hpa"), c("q"), c("rh")
    out = s.select(
        "run", "grid_index",
        T.es(t).alias("es"), T.es_tetens(t).alias("es_tetens"), T.dewpoint_q(p, q).alias("dewpoint_q"), T.dewpoint_q(p, q, 1e-10).alias("dewpoint_q_floor"),
        T.dewpoint_rh(t, rh).alias("dewpoint_rh"), T.mixing_ratio_td(p, td).alias("r_td"), T.mixing_ratio_rh(p, t, rh * 2).alias("r_rh"),
        T.mixing_to_specific(q).alias("specific"), T.specific_to_mixing(q).alias("mixing"),
        T.moisture(p, t, F.when(c("grid_index") % 3 == 0, q), F.when(c("grid_index") % 3 == 1, td), rh).alias("moisture"),
        T.rh_q(t, p, q).alias("rh_q"), T.rh_td(t, td).alias("rh_td"), T.vpd_rh(t, rh).alias("vpd_rh"), T.vpd_td(t, td).alias("vpd_td"), T.vpd_tetens(t, rh).alias("vpd_tetens"),
        T.dewpoint_depression(t, td).alias("depression"), T.dewpoint_depression(td, t, True).alias("depression_signed"), T.wetbulb_stull(t, rh).alias("wetbulb_stull"), T.virtual_temp(t, td, p).alias("virtual_t"), T.theta_e(p, t, td).alias("theta_e"),
    )
    return _round(out, "run", "grid_index")


SCALAR_MOISTURE_SQL = f"""
with {A.SURFACE_SQL},
b as (select *, 6.112 * exp(17.67 * t_c / (t_c + 243.5)) as e_t, 6.112 * exp(17.67 * td_c / (td_c + 243.5)) as e_td,
             6.1078 * exp(17.27 * t_c / (t_c + 237.3)) as e_tet,
             greatest(q * p_hpa / (0.622 + q), 1e-10) as e_q,
             greatest(greatest(q, 1e-10) * p_hpa / (0.622 + greatest(q, 1e-10)), 1e-10) as e_qf from surface),
d as (select *, 0.622 * e_td / greatest(p_hpa - e_td, 1e-6) as r_td0,
             0.622 * e_t * least(rh * 2 / 100, 1.5) / greatest(p_hpa - e_t * least(rh * 2 / 100, 1.5), 1e-6) as r_rh0,
             0.622 * e_t * rh / 100 / greatest(p_hpa - e_t * rh / 100, 1e-6) as r_rh1,
             1 / (1 / (td_c + 273.15 - 56) + ln((t_c + 273.15) / (td_c + 273.15)) / 800) + 56 as tl from b)
select run, grid_index, round(e_t, 5) as es, round(e_tet, 5) as es_tetens,
  round(243.5 * ln(e_q / 6.112) / (17.67 - ln(e_q / 6.112)), 5) as dewpoint_q,
  round(243.5 * ln(e_qf / 6.112) / (17.67 - ln(e_qf / 6.112)), 5) as dewpoint_q_floor,
  round(243.5 * ln(e_t * rh / 100 / 6.112) / (17.67 - ln(e_t * rh / 100 / 6.112)), 5) as dewpoint_rh,
  round(r_td0, 5) as r_td, round(r_rh0, 5) as r_rh, round(q / (1 + q), 5) as specific, round(q / (1 - q), 5) as mixing,
  round(case grid_index % 3 when 0 then q when 1 then r_td0 else r_rh1 end, 5) as moisture,
  round(least(100, 100 * (q * p_hpa / (0.622 + q)) / e_t), 5) as rh_q, round(least(100, 100 * e_td / e_t), 5) as rh_td,
  round(e_t * (1 - rh / 100), 5) as vpd_rh, round(greatest(e_t - e_td, 0), 5) as vpd_td, round(e_tet * (1 - rh / 100), 5) as vpd_tetens,
  round(greatest(t_c - td_c, 0), 5) as depression, round(td_c - t_c, 5) as depression_signed,
  round(t_c * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t_c + rh) - atan(rh - 1.676331) + 0.00391838 * rh ** 1.5 * atan(0.023101 * rh) - 4.686035, 5) as wetbulb_stull,
  round((t_c + 273.15) * (1 + r_td0 / 0.622) / (1 + r_td0) - 273.15, 5) as virtual_t,
  round((t_c + 273.15) * (1000 / p_hpa) ** (0.2854 * (1 - 0.28 * r_td0)) * exp((3.376 / tl - 0.00254) * 1000 * r_td0 * (1 + 0.81 * r_td0)), 5) as theta_e
from d
"""


def scalar_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = A.surface(spark, sf_dir), F.col
    t, rh, wind = c("t_c"), c("rh"), W.wind_speed(c("u"), c("v"))
    out = s.select("run", "grid_index", T.heat_index(t, rh).alias("heat_index"), T.wind_chill(t, wind).alias("wind_chill"), T.apparent(t, rh, wind).alias("apparent"), T.fosberg(t, rh, wind).alias("fosberg"), T.hdw(T.vpd_rh(t, rh), wind).alias("hdw"), T.fire_weather(t, rh, wind, T.vpd_rh(t, rh)).alias("fire_weather"), T.moisture_transport(c("q"), c("u"), c("v")).alias("transport"))
    return _round(out, "run", "grid_index")


def heat_steps(source: str) -> str:
    """Steps a, b and d of heat and fire indices over a table with t_c, rh, u, v and q."""
    return f"""
a as (select *, sqrt(u * u + v * v) as ws, t_c * 1.8 + 32 as f, 6.112 * exp(17.67 * t_c / (t_c + 243.5)) * (1 - rh / 100) as vpd from {source}),
b as (select *, 0.5 * (f + 61 + (f - 68) * 1.2 + rh * 0.094) as simple,
  -42.379 + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh - 0.00683783 * f * f - 0.05481717 * rh * rh
    + 0.00122874 * f * f * rh + 0.00085282 * f * rh * rh - 0.00000199 * f * f * rh * rh
    - (case when rh < 13 and f between 80 and 112 then (13 - rh) / 4 * sqrt((17 - abs(f - 95)) / 17) else 0 end)
    + (case when rh > 85 and f between 80 and 87 then (rh - 85) / 10 * (87 - f) / 5 else 0 end) as rothfusz,
  case when t_c <= 10 and ws * 3.6 > 4.8 then 13.12 + 0.6215 * t_c - 11.37 * (ws * 3.6) ** 0.16 + 0.3965 * t_c * (ws * 3.6) ** 0.16 else t_c end as wc,
  (case when rh <= 10 then 0.03229 + 0.281073 * rh - 0.000578 * rh * f when rh <= 50 then 2.22749 + 0.160107 * rh - 0.01478 * f
        else 21.0606 + 0.005565 * rh * rh - 0.00035 * rh * f - 0.483199 * rh end) / 30 as m from a),
d as (select *, ((case when (simple + f) / 2 >= 80 then rothfusz else simple end) - 32) / 1.8 as hi,
  (1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m) * sqrt(1 + (ws * 2.2369362920544) ** 2) / 0.3002 as fos from b)
"""


SCALAR_HEAT_SQL = f"""
with {A.SURFACE_SQL}, {heat_steps("surface")}
select run, grid_index, round(hi, 5) as heat_index, round(wc, 5) as wind_chill, round(case when t_c >= (80.0::double - 32) / 1.8 then hi else wc end, 5) as apparent,
  round(fos, 5) as fosberg, round(vpd * ws, 5) as hdw, round(greatest(0, least(100, 0.5 * fos + 0.5 * least(100, vpd * ws))), 5) as fire_weather, round(q * 1000 * ws, 5) as transport
from d
"""


def scalar_severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite indices over arithmetic ingredients of each cell."""
    g, k, c = A.grid(spark, sf_dir), F.col("k"), F.col("c")
    i = g.select("run", "grid_index", (k * 37 % 4000 - 100.0).alias("cape"), (-(c * 3 % 260) * 1.0).alias("cin"), (k * 11 % 2600 + 0.0).alias("lcl"), (c * 7 % 500 - 50.0).alias("srh"), (k * 5 % 45 + 0.0).alias("shear"), (k % 50 - 35.0).alias("t500"), (4 + c % 6.0).alias("lapse"), (k % 18 + 0.0).alias("r500"))
    x = F.col
    out = i.select("run", "grid_index", T.ehi(x("cape"), x("srh")).alias("ehi"), T.stp_fixed(x("cape"), x("lcl"), x("srh"), x("shear")).alias("stp"), T.stp_effective(x("cape"), x("lcl"), x("srh"), x("shear"), x("cin")).alias("stp_eff"), T.scp(x("cape"), x("srh"), x("shear")).alias("scp"), T.ship(x("cape"), x("shear"), x("t500"), x("lapse"), x("r500")).alias("ship"), T.bri(x("cape"), x("shear") / 20).alias("bri"), T.ratio_guarded(x("srh"), x("cape")).alias("ratio"), (x("cape") - x("srh")).alias("difference"))
    return _round(out, "run", "grid_index", digits=8)


SCALAR_SEVERE_SQL = f"""
with {A.GRID_SQL},
i as (select run, grid_index, k * 37 % 4000 - 100.0::double as cape, -(c * 3 % 260) * 1.0::double as cin, k * 11 % 2600 + 0.0::double as lcl, c * 7 % 500 - 50.0::double as srh,
             k * 5 % 45 + 0.0::double as shear, k % 50 - 35.0::double as t500, 4 + c % 6.0::double as lapse, k % 18 + 0.0::double as r500 from grid),
j as (select *, greatest(cape / 1500, 0) * greatest(0, least(1, (2000 - lcl) / 1000)) * greatest(srh / 150, 0)
                * (case when shear < 12.5 then 0 when shear >= 30 then 1.5 else shear / 20 end) as stp0 from i)
select run, grid_index, round(cape * srh / 160000, 8) as ehi, round(stp0, 8) as stp, round(stp0 * greatest(0, least(1, (200 + cin) / 150)), 8) as stp_eff,
  round(greatest(cape, 0) / 1000 * greatest(srh, 0) / 50 * (case when shear > 20 then 1 when shear < 10 then 0 else shear / 20 end), 8) as scp,
  round(greatest(cape, 0) * r500 * lapse * greatest(-t500, 0) * shear / 42000000 * least(1, greatest(cape, 0) / 1300), 8) as ship,
  round(case when shear * shear / 800 > 0.1 then greatest(cape, 0) / (shear * shear / 800) else 0 end, 8) as bri,
  round(case when cape >= 100 then srh / cape end, 8) as ratio, round(cape - srh, 8) as difference
from j
"""


def scalar_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure, height, reflectivity and precipitation functions on every level."""
    lv, c = A.levels(spark, sf_dir), F.col
    tk, pa = c("t_c") + 273.15, c("p_hpa") * 100
    out = lv.select("run", "grid_index", "k", T.sim_dbz(tk, pa, c("q"), c("cond") * 500, F.when(c("k") % 2 == 0, c("cond") * 200).otherwise(0.0), c("cond") * 100).alias("dbz"), T.full_pressure(pa, F.lit(5.0)).alias("p_full"), T.theta_from_perturbation(c("t_c")).alias("theta"), T.temperature_from_theta(tk, pa).alias("t_from_theta"), T.geopotential_height(c("z_m") * 9, c("z_m")).alias("height"), T.standard_height(c("p_hpa")).alias("std_height"), T.slp_simple(pa, tk, c("q"), c("z_m")).alias("slp"), (T.total_precip(c("q"), c("cond"), F.when(c("k") > 3, c("q")), c("cond"), c("cldfra")) * 1000).alias("precip"))
    return _round(out, "run", "grid_index", "k", digits=4, finer="theta")


SCALAR_COLUMN_SQL = f"""
with {A.LEVELS_SQL},
a as (select *, t_c + 273.15 as tk, p_hpa * 100 as pa, greatest(q, 0) as qv, cond * 500 as rain0, case when k % 2 = 0 then cond * 200 else 0 end as snow0 from levels),
b as (select *, case when snow0 = 0 and tk < 273.15 then 0 else rain0 end as rain, case when snow0 = 0 and tk < 273.15 then rain0 else snow0 end as snow,
             pa / (287.0 * tk * (0.622 + qv) / (0.622 * (1 + qv))) as rho from a)
select run, grid_index, k,
  round(case when q is not null then 10 * log10(greatest(0.001, 720 * 1e18::double * (
      (1 / (pi() * 1000)) ** 1.75 * (rho * rain) ** 1.75 / 8e6::double ** 0.75
    + (1 / (pi() * 100)) ** 1.75 * 0.1::double ** 2 * 0.224 * (rho * snow) ** 1.75 / 2e7::double ** 0.75
    + (1 / (pi() * 400)) ** 1.75 * 0.4::double ** 2 * 0.224 * (rho * cond * 100) ** 1.75 / 4e6::double ** 0.75))) end, 4) as dbz,
  round(pa + 5, 4) as p_full, round(t_c + 300, 6) as theta, round(tk * (pa / 100000) ** (287.0::double / 1004), 4) as t_from_theta,
  round(z_m * 10 / 9.81, 4) as height, round(44330 * (1 - (p_hpa / 1013.25) ** 0.1903), 4) as std_height,
  round(case when q is not null then pa * exp(9.81 * z_m / (287.04 * greatest(tk * (1 + 0.608 * qv), 150))) end, 4) as slp,
  round(coalesce(q + cond, case when k > 3 then q end + cond, cldfra) * 1000, 4) as precip
from b
"""


def scalar_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = A.surface(spark, sf_dir), F.col
    u, v, lat, lon = c("u"), c("v"), c("lat"), c("lon")
    lat2, lon2 = lat + c("q") * 100, lon + c("t_c")
    ru, rv = W.rotate_wind(u, v, F.lit(0.6), F.lit(0.8))
    along, left = W.section_wind(u, v, c("rh") * 3)
    ila, ilo = W.intermediate(lat, lon, lat2, lon2, F.lit(0.3))
    rla, rlo = W.az_to_latlon(lat, lon, c("rh") * 3, c("orog_m"))
    out = s.select(
        "run", "grid_index",
        W.wind_speed(u, v).alias("speed"), F.when((u != 0) | (v != 0), W.wind_dir(u, v)).alias("dir"), ru.alias("ru"), rv.alias("rv"), along.alias("along"), left.alias("lft"),
        W.haversine(lat, lon, lat2, lon2).alias("km"), F.when(W.haversine(lat, lon, lat2, lon2) > 1, W.bearing(lat, lon, lat2, lon2)).alias("bearing"), ila.alias("ilat"), ilo.alias("ilon"),
        W.norm_lon(lon * 3).alias("nlon"), W.norm_lon_360(lon * 3).alias("nlon360"), W.dlon(lon2 * 3 - lat * 5).alias("dlon"), W.distance_score(lat, lon, lat2, lon2).alias("score"),
        rla.alias("rlat"), rlo.alias("rlon"), W.az_diff(c("rh") * 5, c("t_c") * 10).alias("az_diff"), W.beam_height(c("orog_m"), c("rh") / 10).alias("beam"),
        W.unfold(v, u * 7, F.lit(10.3)).alias("unfold"), W.dealias_delta(u * 3.1, F.lit(10.3)).alias("delta"), W.storm_relative(v, c("rh") * 3, F.lit(240.0), F.lit(30.0)).alias("srv"),
        W.tvs_threshold(c("orog_m")).alias("tvs"), W.rotation_strength(c("q")).alias("strength"),
    )
    return _round(out, "run", "grid_index")


SCALAR_WIND_SQL = f"""
with {A.SURFACE_SQL},
a as (select *, lat + q * 100 as lat2, lon + t_c as lon2 from surface),
b as (select *, sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2 as h from a),
d as (select *, 2 * asin(sqrt(least(h, 1))) as ang from b),
e as (select *, case when sin(ang) <> 0 then sin(0.7 * ang) / sin(ang) end as wa, case when sin(ang) <> 0 then sin(0.3 * ang) / sin(ang) end as wb from d),
f as (select *, wa * cos(radians(lat)) * cos(radians(lon)) + wb * cos(radians(lat2)) * cos(radians(lon2)) as px,
             wa * cos(radians(lat)) * sin(radians(lon)) + wb * cos(radians(lat2)) * sin(radians(lon2)) as py, wa * sin(radians(lat)) + wb * sin(radians(lat2)) as pz from e)
select run, grid_index, round(sqrt(u * u + v * v), 5) as speed,
  round(case when u <> 0 or v <> 0 then case when degrees(atan2(-u, -v)) < 0 then degrees(atan2(-u, -v)) + 360 else degrees(atan2(-u, -v)) end end, 5) as dir,
  round(0.8 * u - 0.6 * v, 5) as ru, round(0.8 * v + 0.6 * u, 5) as rv,
  round(u * sin(radians(rh * 3)) + v * cos(radians(rh * 3)), 5) as along, round(v * sin(radians(rh * 3)) - u * cos(radians(rh * 3)), 5) as lft,
  round(6371 * ang, 5) as km,
  round(case when 6371 * ang > 1 then (degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360 end, 5) as bearing,
  round(coalesce(degrees(atan2(pz, sqrt(px * px + py * py))), lat), 5) as ilat, round(coalesce(degrees(atan2(py, px)), lon), 5) as ilon,
  round(lon * 3 - 360 * floor((lon * 3 + 180) / 360), 5) as nlon, round(lon * 3 - 360 * floor(lon * 3 / 360), 5) as nlon360,
  round((lon2 * 3 - lat * 5) + 360 * floor((180 - (lon2 * 3 - lat * 5)) / 360), 5) as dlon,
  round((lat - lat2) ** 2 + ((lon - lon2) * greatest(abs(cos(radians(lat2))), 0.2)) ** 2, 5) as score,
  round(lat + orog_m * cos(radians(rh * 3)) / 111.139, 5) as rlat, round(lon + orog_m * sin(radians(rh * 3)) / (111.139 * cos(radians(lat))), 5) as rlon,
  round(least(abs(rh * 5 - t_c * 10) % 360, 360 - abs(rh * 5 - t_c * 10) % 360), 5) as az_diff,
  round(sqrt(orog_m * orog_m + 8495.0::double * 8495 + 2 * orog_m * 8495 * sin(radians(rh / 10))) - 8495, 5) as beam,
  round(v + 20.6 * greatest(-8, least(8, round((u * 7 - v) / 20.6))), 5) as unfold,
  round(case when u * 3.1 > 10.3 then u * 3.1 - 20.6 * ceil((u * 3.1 - 10.3) / 20.6) when u * 3.1 < -10.3 then u * 3.1 + 20.6 * ceil((-10.3 - u * 3.1) / 20.6) else u * 3.1 end, 5) as delta,
  round(v + 30 * 0.51444 * (sin(radians(240)) * sin(radians(rh * 3)) + cos(radians(240)) * cos(radians(rh * 3))), 5) as srv,
  round(30 - 10 * least(1, orog_m / 100), 5) as tvs, case when q >= 0.012 then 'strong' when q >= 0.008 then 'moderate' else 'weak' end as strength
from f
"""


def scalar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = A.points(spark, sf_dir), F.col
    a = W.centered_bounds(c("plon"), c("plat"), F.lit(1.5), 1.6)
    b = W.centered_bounds(c("plon") + (c("point_id") % 7) * 0.5, c("plat") + 0.4, F.lit(1.0), 1.6)
    e = W.expand_to_aspect(c("plon") - 1, c("plon") + 2, c("plat") - 0.2, c("plat") + 0.3, 0.1, 0.4, 1.6)
    out = p.select("point_id", *(x.alias(n) for x, n in zip(a, ("west", "east", "south", "north"), strict=True)), W.bounds_area(*a).alias("area"), W.overlap_fraction(a, b).alias("overlap"), W.edge_margin(c("plon"), c("plat"), b).alias("margin"), *(x.alias(f"x{n}") for x, n in zip(e, ("west", "east", "south", "north"), strict=True)))
    return _round(out, "point_id")


SCALAR_BOUNDS_SQL = f"""
with {A.POINTS_SQL},
a as (select *, plon + (point_id % 7) * 0.5::double as blon, plat + 0.4 as blat, greatest(abs(cos(radians(plat))), 0.25) as ca from points),
b as (select *, greatest(abs(cos(radians(blat))), 0.25) as cb, 2.4 / ca as wa, greatest(abs(cos(radians(plat + 0.05))), 0.25) as ce from a),
d as (select *, plon - wa as aw, plon + wa as ae, plat - 1.5 as a_s, plat + 1.5 as an, blon - 1.6 / cb as bw, blon + 1.6 / cb as be, blat - 1 as bs, blat + 1 as bn,
             greatest(0.4 * 111.32, 1.5 * 111.32 * ce / 1.6) * 1.1 / 111.32 as half from b),
o as (select *, greatest(aw, bw) as ow, least(ae, be) as oe, greatest(a_s, bs) as os, least(an, bn) as onn from d),
r as (select *, abs(ae - aw) * ca * 111.32 * 3 * 111.32 as area_a, abs(be - bw) * cb * 111.32 * 2 * 111.32 as area_b,
             abs(oe - ow) * greatest(abs(cos(radians((os + onn) / 2))), 0.25) * 111.32 * abs(onn - os) * 111.32 as area_o from o)
select point_id, round(aw, 5) as west, round(ae, 5) as east, round(a_s, 5) as south, round(an, 5) as north, round(area_a, 5) as area,
  round(case when oe <= ow or onn <= os then 0 else least(1, area_o / greatest(1, least(area_a, area_b))) end, 5) as overlap,
  round(least(abs(plon - bw) * ca * 111.32, abs(be - plon) * ca * 111.32, abs(plat - bs) * 111.32, abs(bn - plat) * 111.32), 5) as margin,
  round(plon + 0.5 - half * 1.6 / ce, 5) as xwest, round(plon + 0.5 + half * 1.6 / ce, 5) as xeast, round(plat + 0.05 - half, 5) as xsouth, round(plat + 0.05 + half, 5) as xnorth
from r
"""


def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = A.table(spark, sf_dir, "part"), F.col
    alias = F.get(F.array(*(F.lit(x) for x in ("T2M", " 2m dewpoint", "Gust", "lcc", "HDW", "none"))), (c("p_partkey") % 6).cast("int"))
    threshold = (c("p_partkey") % 9) * 0.25
    cycle = F.expr("timestamp'2026-04-14 00:00:00' + make_dt_interval(0, cast(p_partkey % 24 as int))")
    name = F.concat(F.lit("x_s2026"), F.format_string("%03d", 1 + c("p_partkey") % 300), F.lit("0234207_e"))
    return p.select(
        "p_partkey", X.slug(F.concat(c("p_brand"), F.lit("--"), c("p_name"), F.lit("!"))).alias("slug"), X.title(F.concat(F.lit(" "), c("p_name"), F.lit("  of it"))).alias("title"), X.canonical_variable(alias).alias("variable"),
        X.threshold_label(threshold).alias("label"), X.threshold_token(threshold).alias("token"), X.sample_id(F.lit("HRRR"), cycle, c("p_size"), c("p_type")).alias("sample_id"), X.fetch_key(F.lit("gfs"), F.lit("aws"), cycle, c("p_size"), F.lit("sfc")).alias("fetch_key"),
        X.valid_time(cycle, c("p_size")).alias("valid_ts"), X.cycle_time(F.lit("20260414"), (c("p_partkey") % 30).cast("int")).alias("cycle_ts"), X.goes_time(name).alias("goes_ts"),
        F.round(X.age_minutes(cycle, X.valid_time(cycle, c("p_size"))), 5).alias("age"), X.short_label(F.when(c("p_partkey") % 2 == 0, c("p_brand")).otherwise(""), F.concat(c("p_name"), F.lit("_of_a_long_kind"))).alias("short"), X.sha256(c("p_name")).alias("sha"),
    )


SCALAR_TEXT_SQL = r"""
with a as (select *, timestamp '2026-04-14 00:00:00' + to_hours((p_partkey % 24)::int) as cyc, (p_partkey % 9) * 0.25::double as th,
  (array['temperature_2m', 'dewpoint_2m', 'wind_gust_10m', 'cloud_low', 'hdw', null])[(p_partkey % 6)::int + 1] as variable from part)
select p_partkey, trim(regexp_replace(lower(p_brand || '--' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_') as slug,
  array_to_string(list_transform(string_split(p_name || ' of it', ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title, variable,
  case when th = floor(th) then th::int::varchar else rtrim(rtrim(printf('%.2f', th), '0'), '.') end as label,
  replace(case when th = floor(th) then th::int::varchar else rtrim(rtrim(printf('%.2f', th), '0'), '.') end, '.', 'p') as token,
  'hrrr_' || strftime(cyc, '%Y%m%d_%H') || 'z_f' || lpad(p_size::varchar, 3, '0') || '_' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') as sample_id,
  'gfs:aws:' || strftime(cyc, '%Y%m%d%H') || ':f' || lpad(p_size::varchar, 3, '0') || ':sfc' as fetch_key,
  cyc + to_hours(p_size) as valid_ts, case when p_partkey % 30 <= 23 then timestamp '2026-04-14 00:00:00' + to_hours((p_partkey % 30)::int) end as cycle_ts,
  timestamp '2026-01-01 02:34:20' + to_days((p_partkey % 300)::int) as goes_ts, p_size * 60.0::double as age,
  left(replace(case when p_partkey % 2 = 0 then p_brand else p_name || '_of_a_long_kind' end, '_', ' '), 18) as short, sha256(p_name) as sha
from a
"""


def forecast_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published hours of each order's model and cycle."""
    o = A.table(spark, sf_dir, "orders")
    model = F.get(F.array(*(F.lit(m) for m in ("hrrr", "gfs", "ecmwf-open-data", "rrfs-a", "wrf-gdex", "other"))), (F.col("o_orderkey") % 6).cast("int"))
    m = o.select(model.alias("model"), (F.col("o_custkey") % 24).cast("int").alias("cycle")).groupBy("model", "cycle").agg(F.count("*").alias("runs"))
    return m.select("model", "cycle", "runs", F.explode(X.forecast_hours(F.col("model"), F.col("cycle"))).alias("fhr")).groupBy("model", "cycle", "runs").agg(F.count("*").alias("n"), F.max("fhr").alias("last"), F.sum(F.col("fhr").cast("long")).alias("total"))


FORECAST_SCHEDULE_SQL = """
with m as (select (array['hrrr','gfs','ecmwf-open-data','rrfs-a','wrf-gdex','other'])[(o_orderkey % 6)::int + 1] as model, (o_custkey % 24)::int as cycle, count(*) as runs from orders group by 1, 2),
h as (select unnest(range(385)) as fhr)
select model, cycle, runs, count(*) as n, max(fhr)::int as last, sum(fhr)::bigint as total from m, h
where (model = 'hrrr' and fhr <= (case when cycle % 6 = 0 then 48 else 18 end)) or (model = 'gfs' and (fhr <= 120 or (fhr % 3 = 0)))
   or (model = 'ecmwf-open-data' and cycle % 6 = 0 and ((fhr <= 144 and fhr % 3 = 0) or (cycle % 12 = 0 and fhr between 150 and 360 and fhr % 6 = 0)))
   or (model = 'rrfs-a' and fhr <= 60) or (model = 'wrf-gdex' and fhr <= 23)
group by 1, 2, 3
"""


def polygon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings written as GeoJSON and read again."""
    p = A.polygons(spark, sf_dir).where("ring = 0")
    ring = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda s: F.concat(F.lit("["), s["lon"].cast("string"), F.lit(","), s["lat"].cast("string"), F.lit("]"))), ",")
    text = p.groupBy("poly_id").agg(F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("json"))
    return text.select("poly_id", F.posexplode(X.polygon_from_json(F.col("json"))).alias("pos", "p")).select("poly_id", F.col("pos").cast("long").alias("seq"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


POLYGON_JSON_SQL = f"with {A.POLYGONS_SQL} select poly_id, seq::bigint as seq, round(lat, 6) as lat, round(lon, 6) as lon from polygons where ring = 0"


def wetbulb_2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Psychrometric wet bulb of every cell; it lies between dewpoint and temperature."""
    s, c = A.surface(spark, sf_dir), F.col
    return s.select("run", "grid_index", F.round(T.wetbulb(c("p_hpa"), c("t_c"), c("td_c")), 5).alias("wetbulb"), "t_c", "td_c")


#: Forty halvings between dewpoint and temperature.
WETBULB_2M_SQL = f"""
with recursive {A.SURFACE_SQL},
wet(run, grid_index, p, t, td, e, a, b, i) as (
  select run, grid_index, p_hpa, t_c, td_c, 6.112 * exp(17.67 * td_c / (td_c + 243.5)), least(t_c, td_c), t_c, 0 from surface
  union all
  select run, grid_index, p, t, td, e, case when high then a else mid end, case when high then mid else b end, i + 1 from (
    select *, 6.112 * exp(17.67 * mid / (mid + 243.5)) - 0.00066::double * (1 + 0.00115::double * mid) * p * (t - mid) > e as high from (select *, (a + b) / 2 as mid from wet where i < 40)))
select run, grid_index, round((a + b) / 2, 5) as wetbulb, t as t_c, td as td_c from wet where i = 40
"""

QUERIES = {
    "scalar_moisture": scalar_moisture,
    "scalar_heat": scalar_heat,
    "scalar_severe": scalar_severe,
    "scalar_column": scalar_column,
    "scalar_wind": scalar_wind,
    "scalar_bounds": scalar_bounds,
    "scalar_text": scalar_text,
    "forecast_schedule": forecast_schedule,
    "polygon_json": polygon_json,
    "wetbulb_2m": wetbulb_2m,
}
ORACLES = {
    "scalar_moisture": SCALAR_MOISTURE_SQL,
    "scalar_heat": SCALAR_HEAT_SQL,
    "scalar_severe": SCALAR_SEVERE_SQL,
    "scalar_column": SCALAR_COLUMN_SQL,
    "scalar_wind": SCALAR_WIND_SQL,
    "scalar_bounds": SCALAR_BOUNDS_SQL,
    "scalar_text": SCALAR_TEXT_SQL,
    "forecast_schedule": FORECAST_SCHEDULE_SQL,
    "polygon_json": POLYGON_JSON_SQL,
    "wetbulb_2m": WETBULB_2M_SQL,
}
