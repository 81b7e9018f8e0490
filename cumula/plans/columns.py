"""Queries over vertical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import profile as C
from cumula.plans.areas import _r

COL = ["run", "grid_index"]


def interp_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and wind at 750 hPa, log and linear in pressure, and at 2000 m."""
    lv = A.levels(spark, sf_dir)
    a = C.interp_pressure(lv, COL, 750.0, ["t_c", "q"]).toDF(*COL, "t_log", "q_log")
    b = C.interp_pressure_linear(lv, COL, 750.0, ["t_c"]).toDF(*COL, "t_lin")
    c = C.interp_height(lv, COL, 2000.0, ["t_c", "u", "v"]).toDF(*COL, "t_z", "u_z", "v_z")
    return _r(a.join(b, COL).join(c, COL), 8)


PAIRS_SQL = (
    A.LEVELS_SQL
    + """,
pr as (select *, lead(p_hpa) over w as p1, lead(z_m) over w as z1, lead(t_c) over w as t1, lead(q) over w as q1, lead(u) over w as u1, lead(v) over w as v1
       from levels window w as (partition by run, grid_index order by k))
"""
)
INTERP_LEVELS_SQL = f"""
with {PAIRS_SQL},
hits as (select *, p_hpa > 750 and p1 <= 750 as hit, z_m <= 2000 and z1 > 2000 as rise from pr),
g as (select run, grid_index, count(*) filter (where hit) as n, count(*) filter (where rise) as m,
  max(case when hit then case when p1 = 750 then t1 else t_c + ln(p_hpa / 750) / ln(p_hpa / p1) * (t1 - t_c) end end) as tl, max(case when hit then case when p1 = 750 then q1 else q + ln(p_hpa / 750) / ln(p_hpa / p1) * (q1 - q) end end) as ql,
  max(case when hit then t_c + (p_hpa - 750) / (p_hpa - p1) * (t1 - t_c) end) as ti, max(case when rise then t_c + (2000 - z_m) / (z1 - z_m) * (t1 - t_c) end) as t, max(case when rise then u + (2000 - z_m) / (z1 - z_m) * (u1 - u) end) as u, max(case when rise then v + (2000 - z_m) / (z1 - z_m) * (v1 - v) end) as v
  from hits group by 1, 2)
select run, grid_index, round(tl, 8) as t_log, round(ql, 8) as q_log, round(ti, 8) as t_lin, round(t, 8) as t_z, round(u, 8) as u_z, round(v, 8) as v_z from g where n > 0 and m > 0
"""


def heights_agl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights over the ground of every other cell's surface, else over the lowest level, made to rise."""
    return _r(C.height_agl(A.levels(spark, sf_dir), A.surface(spark, sf_dir).where("grid_index % 2 = 0"), COL).select(*COL, "k", "z_m"), 6)


HEIGHTS_AGL_SQL = f"""
with {A.LEVELS_SQL}, s as (select run, grid_index, ((k * 13) % 400) / 2.0::double as orog from grid where grid_index % 2 = 0),
h as (select l.run, l.grid_index, k, greatest(z_m - coalesce(orog, min(z_m) over (partition by l.run, l.grid_index)), 0) as z from levels l left join s on s.run = l.run and s.grid_index = l.grid_index)
select run, grid_index, k, round(max(z - k) over (partition by run, grid_index order by k) + k, 6) as z_m from h
"""


def column_winds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shear 1-5 km, mean wind 0.2-3 km and helicity of that layer for a fixed motion."""
    lv = A.levels(spark, sf_dir)
    motion = lv.where("k = 3").select(*COL, (F.col("u") * 0.8).alias("cu"), (F.col("v") - 2).alias("cv"))
    return _r(C.bulk_shear(lv, COL, 1000.0, 5000.0).join(C.mean_wind(lv, COL, 200.0, 3000.0), COL).join(C.srh(lv, motion, COL, 200.0, 3000.0), COL), 6)


_SEG = "greatest(z_m, {a}) as za, least(z1, {b}) as zb"
COLUMN_WINDS_SQL = f"""
with {PAIRS_SQL},
x as (select run, grid_index, max(case when z_m <= 1000 and z1 > 1000 then u + (1000 - z_m) / (z1 - z_m) * (u1 - u) end) as ua, max(case when z_m <= 1000 and z1 > 1000 then v + (1000 - z_m) / (z1 - z_m) * (v1 - v) end) as va,
  max(case when z_m <= 5000 and z1 > 5000 then u + (5000 - z_m) / (z1 - z_m) * (u1 - u) end) as ub, max(case when z_m <= 5000 and z1 > 5000 then v + (5000 - z_m) / (z1 - z_m) * (v1 - v) end) as vb from pr group by 1, 2),
m as (select run, grid_index, u * 0.8 as cu, v - 2 as cv from levels where k = 3),
s as (select run, grid_index, z_m, z1, u, u1, v, v1, {_SEG.format(a=200, b=3000)} from pr where z1 > 200 and z_m < 3000),
e as (select *, u + (za - z_m) / (z1 - z_m) * (u1 - u) as a, u + (zb - z_m) / (z1 - z_m) * (u1 - u) as b, v + (za - z_m) / (z1 - z_m) * (v1 - v) as c, v + (zb - z_m) / (z1 - z_m) * (v1 - v) as d from s join m using (run, grid_index)),
g as (select run, grid_index, sum((a + b) / 2 * (zb - za)) / sum(zb - za) as mu, sum((c + d) / 2 * (zb - za)) / sum(zb - za) as mv, sum((b - cu) * (c - cv) - (a - cu) * (d - cv)) as srh from e group by 1, 2)
select run, grid_index, round(sqrt((ub - ua) ** 2 + (vb - va) ** 2), 6) as shear, round(mu, 6) as mean_u, round(mv, 6) as mean_v, round(srh, 6) as srh from x join g using (run, grid_index)
"""


def wind_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helicity and shear for the right mover of every column whose lowest level is at 50 m."""
    lv = A.levels(spark, sf_dir).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m")))
    w = C.wind_bundle(lv, COL)
    return _r(w.select(*COL, *((F.col(c) + 3.3e-9).alias(c) for c in w.columns if c not in COL)), 6)


WIND_BUNDLE_SQL = f"""
with {A.LEVELS_SQL}, l as (select run, grid_index, k, case when k = 0 then 0 else z_m end as z, u, v from levels),
pr as (select *, lead(z) over w as z1, lead(u) over w as u1, lead(v) over w as v1 from l window w as (partition by run, grid_index order by z)),
cut as (select *, greatest(z, l0) as za, least(z1, l1) as zb from pr, (values (0.0::double, 6000.0::double), (0, 500), (5500, 6000), (0, 1000), (0, 3000)) as y(l0, l1) where z1 > l0 and z < l1),
e as (select run, grid_index, l0, l1, zb - za as dz, u + (za - z) / (z1 - z) * (u1 - u) as a, u + (zb - z) / (z1 - z) * (u1 - u) as b, v + (za - z) / (z1 - z) * (v1 - v) as c, v + (zb - z) / (z1 - z) * (v1 - v) as d from cut),
m as (select run, grid_index, l0, l1, sum((a + b) / 2 * dz) / sum(dz) as mu, sum((c + d) / 2 * dz) / sum(dz) as mv from e group by 1, 2, 3, 4),
b as (select run, grid_index, {", ".join(f"max(m{c}) filter (where {w}) as {n}{c}" for n, w in (("w", "l0 = 0 and l1 = 6000"), ("l", "l1 = 500"), ("h", "l0 = 5500")) for c in "uv")} from m group by 1, 2),
t as (select run, grid_index, wu + 7.5 * (hv - lv) / sqrt((hu - lu) ** 2 + (hv - lv) ** 2) as cu, wv - 7.5 * (hu - lu) / sqrt((hu - lu) ** 2 + (hv - lv) ** 2) as cv from b),
s as (select run, grid_index, l1, any_value(cu) as cu, any_value(cv) as cv, sum((b - cu) * (c - cv) - (a - cu) * (d - cv)) as srh from e join t using (run, grid_index) where l0 = 0 and l1 in (1000, 3000) group by 1, 2, 3),
x as (select run, grid_index, max(u) filter (where k = 1) as u0, max(v) filter (where k = 1) as v0, max(case when z <= 6000 and z1 > 6000 then u + (6000 - z) / (z1 - z) * (u1 - u) end) as ut, max(case when z <= 6000 and z1 > 6000 then v + (6000 - z) / (z1 - z) * (v1 - v) end) as vt from pr group by 1, 2)
select run, grid_index, round(max(srh) filter (where l1 = 1000) + 3.3e-9, 6) as srh_0_1km, round(max(srh) filter (where l1 = 3000) + 3.3e-9, 6) as srh_0_3km, round(any_value(sqrt((ut - u0) ** 2 + (vt - v0) ** 2)) + 3.3e-9, 6) as shear_0_6km, round(any_value(cu) + 3.3e-9, 6) as cu, round(any_value(cv) + 3.3e-9, 6) as cv
from s join x using (run, grid_index) group by 1, 2
"""


def lapse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lapse rates 0.2-3 km and 700-500 hPa, of virtual temperature there."""
    lv = A.levels(spark, sf_dir)
    return _r(C.lapse_layer(lv, COL, 200.0, 3000.0).withColumnRenamed("lapse", "lapse_z").join(C.lapse_pressure(lv, COL).withColumnRenamed("lapse", "lapse_p"), COL, "left"), 6)


LAPSE_RATES_SQL = f"""
with {A.LEVELS_SQL},
d as (select *, greatest(greatest(q, 0) * p_hpa / (0.622 + greatest(q, 0)), 1e-10) as e from levels),
tv as (select *, case when q is not null then 0.622 * e / greatest(p_hpa - e, 1e-6) end as r from d),
w as (select *, (t_c + 273.15) * (1 + r / 0.622) / (1 + r) - 273.15 as tv from tv),
pr as (select *, lead(p_hpa) over x as p1, lead(z_m) over x as z1, lead(t_c) over x as t1, lead(tv) over x as tv1 from w window x as (partition by run, grid_index order by k)),
g as (select run, grid_index, max(case when z_m <= 200 and z1 > 200 then t_c + (200 - z_m) / (z1 - z_m) * (t1 - t_c) end) as ta, max(case when z_m <= 3000 and z1 > 3000 then t_c + (3000 - z_m) / (z1 - z_m) * (t1 - t_c) end) as tb,
  max(case when p_hpa > 700 and p1 <= 700 then case when p_hpa = 700 then tv when p1 = 700 then tv1 else tv + (p_hpa - 700) / (p_hpa - p1) * (tv1 - tv) end end) as t700, max(case when p_hpa > 700 and p1 <= 700 then case when p1 = 700 then z1 else z_m + (p_hpa - 700) / (p_hpa - p1) * (z1 - z_m) end end) as z700,
  max(case when p_hpa > 500 and p1 <= 500 then case when p_hpa = 500 then tv when p1 = 500 then tv1 else tv + (p_hpa - 500) / (p_hpa - p1) * (tv1 - tv) end end) as t500, max(case when p_hpa > 500 and p1 <= 500 then case when p1 = 500 then z1 else z_m + (p_hpa - 500) / (p_hpa - p1) * (z1 - z_m) end end) as z500 from pr group by 1, 2)
select run, grid_index, round((ta - tb) / 2.8, 6) as lapse_z, round((t700 - t500) / ((z500 - z700) / 1000), 6) as lapse_p from g where ta is not null and tb is not null
"""


def column_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.pwat(A.levels(spark, sf_dir).withColumn("q", F.coalesce("q", F.lit(0.0))), COL), 6)


COLUMN_WATER_SQL = f"""
with {A.LEVELS_SQL}, n as (select run, grid_index, coalesce(q, 0) as q, lead(coalesce(q, 0)) over w as q1, p_hpa, lead(p_hpa) over w as p1 from levels window w as (partition by run, grid_index order by k))
select run, grid_index, round(sum(0.5 * (greatest(q, 0) + greatest(q1, 0)) * abs(p_hpa - p1) * 100) / 9.81, 6) as pwat from n where p1 is not null group by 1, 2
"""


def sea_level_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.mslp(A.levels(spark, sf_dir), COL), 3)


SEA_LEVEL_PRESSURE_SQL = f"""
with {A.LEVELS_SQL},
s as (select run, grid_index, k, p_hpa * 100 as p, (t_c + 273.15) * (1 + 0.608 * greatest(coalesce(q, 0), 0)) as tv, z_m from levels),
a as (select *, first(p) over w as ps, first(z_m) over w as zs, lag(p) over w as ph, lag(tv) over w as th, lag(z_m) over w as zh from s window w as (partition by run, grid_index order by k)),
b as (select *, row_number() over (partition by run, grid_index order by k) as r from a where ps - p >= 10000),
c as (select *, ps - 10000 as pr, (ln(ps - 10000) - ln(ph)) / (ln(p) - ln(ph)) as f from b where r = 1),
d as (select *, th + f * (tv - th) as tr, zh + f * (z_m - zh) as zr from c),
e as (select *, tr * (ps / pr) ** (0.0065::double * 287.04 / 9.81) as ts, tr + 0.0065::double * zr as lo from d)
select run, grid_index, round(ps * exp(2 * 9.81 * zs / (287.04 * ((case when ts <= 290.66 and lo >= 290.66 then 290.66 else 290.66 - 0.005 * (ts - 290.66) ** 2 end) + ts))), 3) as slp_pa from e
"""


def column_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest condensate, lowest height, summary and cloud layers of each column."""
    lv = A.levels(spark, sf_dir)
    return _r(C.column_max(lv, COL, "cond").join(C.proxy_orography(lv, COL), COL).join(C.profile_summary(lv, COL), COL).join(C.cloud_layers(lv, COL), COL), 7)


_BAND = {"low": "p_hpa between 800 and 1100", "mid": "p_hpa between 450 and 800", "high": "p_hpa between 0 and 450"}
COLUMN_EXTREMES_SQL = f"""
with {A.LEVELS_SQL}, g as (select run, grid_index, max(cond) as cond, min(z_m) as orog_m, count(*) as levels, max(p_hpa) as p_bottom, min(p_hpa) as p_top, min(z_m) as z_bottom, max(z_m) as z_top, arg_max(t_c, p_hpa) as t_bottom,
  {", ".join(f"coalesce(max(least(cldfra, 1) * 100) filter (where {b}), 0) as frac_{n}, coalesce(max(case when cond > 1e-6 then 100.0::double end) filter (where {b}), 0) as cond_{n}" for n, b in _BAND.items())} from levels group by 1, 2)
select run, grid_index, round(cond, 7) as cond, round(orog_m, 7) as orog_m, levels, round(p_bottom, 7) as p_bottom, round(p_top, 7) as p_top, round(z_bottom, 7) as z_bottom, round(z_top, 7) as z_top, round(t_bottom, 7) as t_bottom,
  {", ".join(f"round(frac_{n}, 7) as frac_{n}, cond_{n}" for n in _BAND)}, round(greatest(frac_low, frac_mid, frac_high), 7) as frac_total from g
"""


def level_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of columns, by rule and level."""
    return C.violations(A.levels(spark, sf_dir), COL).groupBy("run", "k", "rule").agg(F.count("*").alias("n"))


LEVEL_CHECKS_SQL = f"""
with {A.LEVELS_SQL}, e as (select *, greatest(q * p_hpa / (0.622 + q), 1e-10) as e, lag(p_hpa) over w as pp, lag(z_m) over w as pz from levels window w as (partition by run, grid_index order by k)),
v as (select run, k, case when q is null then 'missing' when pp <= p_hpa then 'pressure' when pz >= z_m then 'height' when 243.5 * ln(e / 6.112) / (17.67 - ln(e / 6.112)) > t_c + 1e-9 then 'dewpoint' end as rule from e)
select run, k, rule, count(*) as n from v where rule is not null group by 1, 2, 3
"""


def level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pressure and mean humidity within 5 hPa of 800 hPa, and levels with all fields."""
    lv = A.levels(spark, sf_dir)
    rh = C.rh_at_level(lv, COL, 810.0, 5.0).groupBy("run").agg(F.avg("rh").alias("rh"), F.count("*").alias("n"))
    long = lv.select("run", F.col("k").alias("level"), F.inline(F.array(*(F.struct(F.lit(n).alias("field"), (F.col(n) if n != "q" else F.when(F.col("k") < 6, F.col("q"))).alias("value")) for n in ("t_c", "q", "u", "v", "z_m")))))
    common = C.common_levels(long, ["run"], ["t_c", "q", "u", "v", "z_m"]).groupBy("run").agg(F.count("*").alias("common"))
    return _r(C.mean_level_pressure(lv, ["run"]).join(rh, "run").join(common, "run"), 6)


LEVEL_MEANS_SQL = f"""
with {A.LEVELS_SQL}, m as (select run, k, avg(p_hpa) as p_hpa from levels group by 1, 2),
r as (select run, avg(case when q is not null then greatest(0, least(100, 100 * (q * p_hpa / (0.622 + q)) / (6.112 * exp(17.67 * t_c / (t_c + 243.5))))) end) as rh, count(*) as n from levels where abs(p_hpa - 810) <= 5 group by 1),
c as (select run, count(distinct k) as common from levels where k < 6 and q is not null group by 1)
select run, k, round(p_hpa, 6) as p_hpa, round(rh, 6) as rh, n, common from m join r using (run) join c using (run)
"""


def shear_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(C.max_shear_pairs(A.levels(spark, sf_dir), COL, (0.0, 1500.0), (5000.0, 9000.0)), 6)


SHEAR_PAIRS_SQL = f"""
with {A.LEVELS_SQL} select a.run, a.grid_index, round(max(sqrt((b.u - a.u) ** 2 + (b.v - a.v) ** 2)), 6) as shear
from levels a join levels b on a.run = b.run and a.grid_index = b.grid_index and a.z_m between 0 and 1500 and b.z_m between 5000 and 9000 group by 1, 2
"""


def layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = A.levels(spark, sf_dir)
    motion = lv.where("k = 2").select(*COL, F.col("u").alias("cu"), F.col("v").alias("cv"))
    return _r(C.layer_table(lv, motion, COL, [(200.0, 1000.0), (200.0, 3000.0), (200.0, 6000.0), (1000.0, 3000.0)]), 6)


LAYER_TABLE_SQL = f"""
with {PAIRS_SQL}, y(l0, l1) as (values (200.0::double, 1000.0::double), (200, 3000), (200, 6000), (1000, 3000)),
m as (select run, grid_index, u as cu, v as cv from levels where k = 2),
s as (select pr.*, l0, l1, greatest(z_m, l0) as za, least(z1, l1) as zb, cu, cv from pr join m using (run, grid_index), y where z1 > l0 and z_m < l1),
e as (select *, u + (za - z_m) / (z1 - z_m) * (u1 - u) as a, u + (zb - z_m) / (z1 - z_m) * (u1 - u) as b, v + (za - z_m) / (z1 - z_m) * (v1 - v) as c, v + (zb - z_m) / (z1 - z_m) * (v1 - v) as d from s),
g as (select run, grid_index, l0, l1, sum((a + b) / 2 * (zb - za)) / sum(zb - za) as mu, sum((c + d) / 2 * (zb - za)) / sum(zb - za) as mv, sum((b - cu) * (c - cv) - (a - cu) * (d - cv)) as h, any_value(cu) as cu, any_value(cv) as cv from e group by 1, 2, 3, 4)
select run, grid_index, l0 as z0, l1 as z1, round(mu, 6) as mean_u, round(mv, 6) as mean_v, round(h, 6) as srh, round(sqrt((mu - cu) ** 2 + (mv - cv) ** 2), 6) as sr_wind from g
"""


def buoyancy_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess of a parcel cooling by 7 K/km over each column between 500 and 5000 m."""
    lv = A.levels(spark, sf_dir).withColumn("parcel", 27 - F.col("z_m") * 0.007)
    return _r(C.buoyancy_layer(lv, COL, "t_c", "parcel", 500.0, 5000.0), 6)


BUOYANCY_LAYER_SQL = f"""
with {A.LEVELS_SQL}, d as (select run, grid_index, k, z_m, 27 - z_m * 0.007 - t_c as x from levels), n as (select *, lead(z_m) over w as z1, lead(x) over w as x1 from d window w as (partition by run, grid_index order by k)),
s as (select *, greatest(z_m, 500) as za, least(z1, 5000) as zb from n where z1 > 500 and z_m < 5000), e as (select *, x + (za - z_m) / (z1 - z_m) * (x1 - x) as a, x + (zb - z_m) / (z1 - z_m) * (x1 - x) as b from s)
select run, grid_index, round(sum((greatest(a, 0) + greatest(b, 0)) / 2 * (zb - za)), 6) as positive, round(sum((a + b) / 2 * (zb - za)) / sum(zb - za), 6) as mean, round(max(greatest(a, b)), 6) as greatest from e group by 1, 2
"""

QUERIES = {f.__name__: f for f in (interp_levels, heights_agl, column_winds, wind_bundle, lapse_rates, column_water, sea_level_pressure, column_extremes, level_checks, level_means, shear_pairs, layer_table, buoyancy_layer)}
ORACLES = {
    "interp_levels": INTERP_LEVELS_SQL, "heights_agl": HEIGHTS_AGL_SQL, "column_winds": COLUMN_WINDS_SQL, "wind_bundle": WIND_BUNDLE_SQL, "lapse_rates": LAPSE_RATES_SQL, "column_water": COLUMN_WATER_SQL, "sea_level_pressure": SEA_LEVEL_PRESSURE_SQL,
    "column_extremes": COLUMN_EXTREMES_SQL, "level_checks": LEVEL_CHECKS_SQL, "level_means": LEVEL_MEANS_SQL, "shear_pairs": SHEAR_PAIRS_SQL, "layer_table": LAYER_TABLE_SQL, "buoyancy_layer": BUOYANCY_LAYER_SQL,
}
