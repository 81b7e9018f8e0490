"""Queries for what users ask for: points, areas, cases, series, bundles, soundings and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.functions import thermo as T
from cumula.operators import areas as R
from cumula.operators import components as G
from cumula.operators import requests as Q
from cumula.operators import sections as SE
from cumula.plans.areas import _SCORE, MEMBER_SQL, NEAR_SQL, TRANSECT_SQL, _grid, _r
from cumula.plans.stencils import DX, DY, ROUTE_SQL, _route
from cumula.shared import new_path, written


#: Added before rounding in both forms: quotients of short decimals often end in a 5, where the last bit would decide.
_NUDGE = 3.3e-9


def _n(df: DataFrame, digits: int = 6) -> DataFrame:
    return _r(df.select(*(F.col(c) + _NUDGE if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns), digits)


def _products(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Products of every run, humidity only in even runs and one product without values; and the wanted slugs."""
    s = A.surface(spark, sf_dir)
    long = s.select("run", "grid_index", F.inline(F.array(*(F.struct(F.lit(n).alias("product"), v.alias("value")) for n, v in (("t_c", F.col("t_c")), ("rh", F.col("rh")), ("empty", F.lit(None).cast("double")))))))
    slugs = spark.createDataFrame([("t_c", True), ("rh", True), ("empty", True), ("mystery", False)], "slug string, known boolean")
    return long.where("not (product = 'rh' and run % 2 = 1)"), slugs


_PRODUCTS_SQL = """
v as (select * from (select run, grid_index, unnest(['t_c', 'rh', 'empty']) as product, unnest([(price % 4500 / 100 - 5)::double, 5.0::double + (k * 7) % 96, null::double]) as value from grid) where not (product = 'rh' and run % 2 = 1)),
blocked as (select distinct run, 'empty' as product, 'no valid cell' as reason from grid union all select distinct run, 'rh', 'no data in run' from grid where run % 2 = 1 union all select distinct run, 'mystery', 'unknown product' from grid)
"""


def products_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted products of every run at every point, and why others are blocked."""
    v, slugs = _products(spark, sf_dir)
    return _r(Q.sample_products(v, _grid(A.cells(spark, sf_dir)), A.points(spark, sf_dir), slugs, ["run"]))


PRODUCTS_AT_POINTS_SQL = f"""
with {NEAR_SQL}, {_PRODUCTS_SQL}
select run, point_id, product, round(value, 6) as value, null as reason from near join v using (grid_index) where rank = 1 and product <> 'empty'
union all select run, null, product, null, reason from blocked
"""


def products_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted products of every run over every polygon, and why others are blocked."""
    v, slugs = _products(spark, sf_dir)
    return _r(Q.summarize_products(v, _grid(A.cells(spark, sf_dir)), A.polygons(spark, sf_dir), slugs, ["run"]))


PRODUCTS_IN_AREAS_SQL = f"""
with {MEMBER_SQL}, {_PRODUCTS_SQL}
select run, product, poly_id, count(*) as included, count(value) as valid, count(*) - count(value) as missing, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, null as reason from v join member using (grid_index) where product <> 'empty' group by 1, 2, 3
union all select run, product, null, null, null, null, null, null, null, reason from blocked
"""


def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hour of every run against the last one over every polygon."""
    c = A.cells(spark, sf_dir)
    first, last = (c.where(F.col("fhr") == h).select("run", "grid_index", "value") for h in (0, 6))
    return _r(Q.query_field(first, _grid(c), ["run"], polygons=A.polygons(spark, sf_dir), other=last))


FIELD_QUERY_SQL = f"""
with {MEMBER_SQL}, p as (select a.run, poly_id, b.value - a.value as d from cells a join cells b on a.run = b.run and a.grid_index = b.grid_index and a.fhr = 0 and b.fhr = 6
  join member m on m.grid_index = a.grid_index where a.value is not null and b.value is not null)
select run, poly_id, count(*) as compared, count(*) filter (where abs(d) > 1e-9) as changed, round(min(d), 6) as min_diff, round(max(d), 6) as max_diff, round(avg(d), 6) as mean_signed,
  round(avg(abs(d)), 6) as mean_abs, round(sqrt(avg(d * d)), 6) as rmse from p group by 1, 2
"""


def case_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches, thresholds, points and transects of the second hour of every run."""
    c, n = A.cells(spark, sf_dir), F.col("n_nationkey")
    routes = A.table(spark, sf_dir, "nation").select(n.cast("long").alias("route_id"), (26.03 + n * 7 % 8).alias("lat0"), (-123.07 + n * 5 % 27).alias("lon0"), F.lit(29.92).alias("lat1"), F.lit(-110.21).alias("lon1"))
    v = c.where("fhr = 1").select("run", "grid_index", "value")
    return _n(Q.extract_case(v, _grid(c), ["run"], A.polygons(spark, sf_dir), A.points(spark, sf_dir), routes, {"over_20": 20.0}))


_CASE_STATS = {"count": "count(value)", "min": "min(value)", "max": "max(value)", "mean": "avg(value)"} | {f"p{q}": f"quantile_cont(value, {q / 100})" for q in (10, 25, 50, 75, 90)}
CASE_EXTRACT_SQL = f"""
with tr as ({TRANSECT_SQL.replace(", 6) as", " + 3.3e-9, 6) as")}), pts as (with {NEAR_SQL} select run, point_id, value from near join cells using (grid_index) where rank = 1 and fhr = 1),
ar as (with {MEMBER_SQL} select run, poly_id, value from cells join member using (grid_index) where fhr = 1),
st as (select run, poly_id, {", ".join(f"({e})::double as {n}" for n, e in _CASE_STATS.items())}, count(*) filter (where value >= 20) as hits from ar group by 1, 2)
select run, 'patch' as kind, poly_id::varchar as id, unnest([{", ".join(f"'{n}'" for n in _CASE_STATS)}]) as stat, unnest([{", ".join(f"round({n} + 3.3e-9, 6)" for n in _CASE_STATS)}]) as value from st
union all select run, 'threshold', poly_id::varchar, unnest(['valid', 'n_over_20', 'share_over_20']), unnest([count, hits::double, round(hits / nullif(count, 0) + 3.3e-9, 6)]) from st
union all select run, 'point', point_id::varchar, 'value', round(value + 3.3e-9, 6) from pts
union all select run, 'transect', route_id::varchar || ':' || seq::varchar, unnest(['value', 'distance_km']), unnest([value, distance_km]) from tr
"""


def mosaic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each run and hour, ten minutes apart; the last hour of even runs has no values."""
    c = A.cells(spark, sf_dir).withColumn("value", F.when(F.col("grid_index") % 41 == 0, -999.0).otherwise(F.col("value")))
    ts = F.timestamp_micros(F.col("run") * 3_600_000_000 + F.col("fhr") * 601_000_000)
    files = c.select("run", "fhr", ts.alias("valid_ts")).distinct()
    there = c.where("not (fhr = 6 and run % 2 = 0)").select("run", "fhr", "grid_index", "value")
    got = Q.mosaic_series(files, there, _grid(c), A.polygons(spark, sf_dir), ["run", "fhr"], F.timestamp_micros(F.lit(3_601_500_000)), 0.1, {"over_2": 2.0})
    return _n(got.drop("valid_ts"))


MOSAIC_SERIES_SQL = f"""
with {MEMBER_SQL}, f as (select distinct run, fhr, (run * 3600 + fhr * 601 - 3601.5) / 60 as m from cells),
l as (select run, fhr, case when round(m) = 0 then 'T0' when m < 0 then 'T_minus_' || (-round(m))::bigint::varchar || 'min' else 'T_plus_' || round(m)::bigint::varchar || 'min' end as time_label from f),
v as (select run, fhr, poly_id, case when grid_index % 41 <> 0 then value * 0.1::double end as value from cells join member using (grid_index) where not (fhr = 6 and run % 2 = 0)),
s as (select run, fhr, poly_id, count(*) as included, count(value) as valid, count(*) - count(value) as missing, round(min(value) + 3.3e-9, 6) as min, round(max(value) + 3.3e-9, 6) as max, round(avg(value) + 3.3e-9, 6) as mean, count(*) filter (where value >= 2) as n_over_2, round(count(*) filter (where value >= 2) / nullif(count(value), 0) + 3.3e-9, 6) as share_over_2 from v group by 1, 2, 3)
select l.run, l.fhr, time_label, poly_id, included, valid, missing, min, max, mean, n_over_2, share_over_2, case when poly_id is null then 'no values' end as error from l left join s using (run, fhr)
"""


def box_soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-mean column of every point and run, surface first."""
    s = A.surface(spark, sf_dir).withColumn("p_hpa", F.col("p_hpa") + 60)
    return _n(Q.box_sounding(A.levels(spark, sf_dir), s.withColumnRenamed("orog_m", "z_m"), _grid(A.cells(spark, sf_dir)), A.points(spark, sf_dir), ["run"], 25.0), 5)


BOX_SOUNDINGS_SQL = f"""
with {A.LEVELS_SQL}, {A.POINTS_SQL}, cells as (select run, grid_index, lat, lon from grid),
places as (select distinct grid_index, lat, lon from grid),
inside as (select point_id, grid_index from points join places on abs(lat - plat) <= 25.0::double / 111 and abs(lon - plon) <= 25.0::double / 111 / greatest(abs(cos(radians(plat))), 0.2)),
near as (select point_id, grid_index, row_number() over (partition by point_id order by {_SCORE}, grid_index) as rank from points join places on true where point_id not in (select point_id from inside)),
members as (select * from inside union all select point_id, grid_index from near where rank = 1),
sfc as (select run, grid_index, -1 as k, 910.0::double + k % 160 as p_hpa, ((k * 13) % 400) / 2.0::double as z_m, price % 4500 / 100 - 5 as t_c, (c % 200) / 10000.0::double as q, c % 41 - 20.0::double as u, k % 37 - 18.0::double as v from grid),
both_ as (select run, grid_index, k, p_hpa, z_m, t_c, q, u, v from sfc union all select run, grid_index, k, p_hpa, z_m, t_c, q, u, v from levels),
m as (select run, point_id, k, avg(p_hpa) as p_hpa, avg(z_m) as z_m, avg(t_c) as t_c, avg(q) as q, avg(u) as u, avg(v) as v from both_ join members using (grid_index) group by 1, 2, 3),
w as (select m.* from m left join (select run, point_id, p_hpa as p0, z_m as z0 from m where k = -1) g using (run, point_id) where k = -1 or (p_hpa < p0 - 0.1 and z_m > z0 + 1)),
e as (select *, greatest(greatest(q, 0) * p_hpa / (0.622 + greatest(q, 0)), 1e-10) as e from w where q is not null),
t as (select *, least(243.5 * ln(e / 6.112) / (17.67 - ln(e / 6.112)), t_c) as td_c, max(z_m) over b as zb, min(p_hpa) over b as pb from e window b as (partition by run, point_id order by p_hpa desc, k rows between unbounded preceding and 1 preceding))
select run, point_id, k, round(p_hpa + 3.3e-9, 5) as p_hpa, round(z_m + 3.3e-9, 5) as z_m, round(t_c + 3.3e-9, 5) as t_c, round(u + 3.3e-9, 5) as u, round(v + 3.3e-9, 5) as v, round(td_c + 3.3e-9, 5) as td_c from t where zb is null or (z_m > zb + 1e-6 and p_hpa < pb - 1e-6)
"""


def updraft_helicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updraft helicity of 2 to 5 km of every column."""
    return _n(Q.updraft_helicity(A.levels(spark, sf_dir), ["run"], DX, DY), 6)


UPDRAFT_HELICITY_SQL = f"""
with {A.LEVELS_SQL},
g as (select *, case when lead(x) over r = x + 1 and lag(x) over r = x - 1 then (lead(v) over r - lag(v) over r) / 100000 when lead(x) over r = x + 1 then (lead(v) over r - v) / 50000 when lag(x) over r = x - 1 then (v - lag(v) over r) / 50000 end
  - case when lead(y) over c = y + 1 and lag(y) over c = y - 1 then (lead(u) over c - lag(u) over c) / 56000 when lead(y) over c = y + 1 then (lead(u) over c - u) / 28000 when lag(y) over c = y - 1 then (u - lag(u) over c) / 28000 end as rel
  from levels window r as (partition by run, k, y order by x), c as (partition by run, k, x order by y)),
n as (select *, w * rel as h, lead(z_m) over o as z1, lead(w) over o as w1, lead(w * rel) over o as h1 from g window o as (partition by run, grid_index order by k)),
s as (select *, greatest(z_m, 2000) as za, least(z1, 5000) as zb from n where z1 > 2000 and z_m < 5000),
e as (select *, w + (za - z_m) / (z1 - z_m) * (w1 - w) as wa, w + (zb - z_m) / (z1 - z_m) * (w1 - w) as wb, h + (za - z_m) / (z1 - z_m) * (h1 - h) as ha, h + (zb - z_m) / (z1 - z_m) * (h1 - h) as hb from s)
select run, grid_index, round(case when sum((wa + wb) / 2 * (zb - za)) > 0 then sum((ha + hb) / 2 * (zb - za)) else 0 end + 3.3e-9, 6) as uh from e group by 1, 2
"""


def refl_1km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectivity 1 km above ground of every column."""
    lv = A.levels(spark, sf_dir).withColumn("dbz", F.col("cldfra") * 60 - F.col("k") * 2)
    return _r(Q.refl_at_height(lv, ["run", "grid_index"]), 6)


REFL_1KM_SQL = f"""
with {A.LEVELS_SQL}, n as (select run, grid_index, z_m, cldfra * 60 - k * 2 as d, lead(z_m) over w as z1, lead(cldfra * 60 - k * 2) over w as d1 from levels window w as (partition by run, grid_index order by k))
select run, grid_index, round(d + (1000 - z_m) / (z1 - z_m) * (d1 - d), 6) as dbz from n where z_m <= 1000 and z1 > 1000
"""


def surface_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten derived values of every surface cell."""
    s = Q.surface_thermo(A.surface(spark, sf_dir))
    return _r(s.select("run", "grid_index", "dewpoint", "humidity", "theta_e", "wet_bulb", "depression", "vpd", "fire", "heat_index", "wind_chill", "apparent"), 4)


#: Forty halvings between dewpoint and temperature.
_WET_BULB_SQL = """
wet(run, grid_index, p, t, e, a, b, i) as (
  select run, grid_index, p_hpa, t_c, 6.112 * exp(17.67 * td / (td + 243.5)), least(t_c, td), t_c, 0 from bulb
  union all
  select run, grid_index, p, t, e, case when high then a else mid end, case when high then mid else b end, i + 1 from (
    select *, 6.112 * exp(17.67 * mid / (mid + 243.5)) - 0.00066::double * (1 + 0.00115::double * mid) * p * (t - mid) > e as high from (select *, (a + b) / 2 as mid from wet where i < 40))),
"""
SURFACE_BUNDLE_SQL = f"""
with recursive {A.SURFACE_SQL},
a as (select *, greatest(greatest(q, 0) * p_hpa / (0.622 + greatest(q, 0)), 1e-10) as e, sqrt(u * u + v * v) as ws, 6.112 * exp(17.67 * t_c / (t_c + 243.5)) as es, t_c * 1.8 + 32 as f from surface),
b as (select * exclude (rh), 243.5 * ln(e / 6.112) / (17.67 - ln(e / 6.112)) as td from a),
bulb as (select run, grid_index, p_hpa, t_c, td from b), {_WET_BULB_SQL}
c as (select *, 6.112 * exp(17.67 * td / (td + 243.5)) as ed, 1 / (1 / (td + 273.15 - 56) + ln((t_c + 273.15) / (td + 273.15)) / 800) + 56 as tl from b),
d as (select *, greatest(0, least(100, 100 * ed / es)) as rh, greatest(es - ed, 0) as vpd, 0.622 * ed / (p_hpa - ed) as r from c),
h as (select *, 0.5 * (f + 61 + (f - 68) * 1.2 + rh * 0.094) as simple,
  -42.379 + 2.04901523 * f + 10.14333127 * rh - 0.22475541 * f * rh - 0.00683783 * f * f - 0.05481717 * rh * rh + 0.00122874 * f * f * rh + 0.00085282 * f * rh * rh - 0.00000199 * f * f * rh * rh
    - (case when rh < 13 and f between 80 and 112 then (13 - rh) / 4 * sqrt((17 - abs(f - 95)) / 17) else 0 end) + (case when rh > 85 and f between 80 and 87 then (rh - 85) / 10 * (87 - f) / 5 else 0 end) as rothfusz,
  case when t_c <= 10 and ws * 3.6 > 4.8 then 13.12 + 0.6215 * t_c - 11.37 * (ws * 3.6) ** 0.16 + 0.3965 * t_c * (ws * 3.6) ** 0.16 else t_c end as wc,
  (case when rh <= 10 then 0.03229 + 0.281073 * rh - 0.000578 * rh * f when rh <= 50 then 2.22749 + 0.160107 * rh - 0.01478 * f else 21.0606 + 0.005565 * rh * rh - 0.00035 * rh * f - 0.483199 * rh end) / 30 as m from d),
o as (select *, ((case when (simple + f) / 2 >= 80 then rothfusz else simple end) - 32) / 1.8 as hi, (1 - 2 * m + 1.5 * m * m - 0.5 * m * m * m) * sqrt(1 + (ws * 2.2369362920544) ** 2) / 0.3002 as fos from h)
select o.run, o.grid_index, round(td, 4) as dewpoint, round(rh, 4) as humidity, round((t_c + 273.15) * (1000 / p_hpa) ** (0.2854 * (1 - 0.28 * r)) * exp((3.376 / tl - 0.00254) * 1000 * r * (1 + 0.81 * r)), 4) as theta_e, round((w.a + w.b) / 2, 4) as wet_bulb,
  round(greatest(t_c - td, 0), 4) as depression, round(vpd, 4) as vpd, round(greatest(0, least(100, 0.5 * fos + 0.5 * least(100, vpd * ws))), 4) as fire, round(hi, 4) as heat_index, round(wc, 4) as wind_chill, round(case when t_c >= (80.0::double - 32) / 1.8 then hi else wc end, 4) as apparent
from o join wet w on w.run = o.run and w.grid_index = o.grid_index and w.i = 40
"""


def derived_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recipes whose ingredients are worked out and left out of the result."""
    return _r(Q.derive(A.surface(spark, sf_dir).select("run", "grid_index", "t_c", "p_hpa", "q"), ["vpd", "humidity"]).drop("t_c", "p_hpa", "q"), 5)


DERIVED_RECIPES_SQL = f"""
with {A.SURFACE_SQL}, a as (select *, greatest(q * p_hpa / (0.622 + q), 1e-10) as e, 6.112 * exp(17.67 * t_c / (t_c + 243.5)) as es from surface), b as (select *, 243.5 * ln(e / 6.112) / (17.67 - ln(e / 6.112)) as td from a)
select run, grid_index, round(greatest(es - 6.112 * exp(17.67 * td / (td + 243.5)), 0), 5) as vpd, round(greatest(0, least(100, 100 * 6.112 * exp(17.67 * td / (td + 243.5)) / es)), 5) as humidity from b
"""


def column_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shears and mean wind of every column, its lowest level taken as the ground."""
    lv = A.levels(spark, sf_dir).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m")))
    return _n(Q.column_kinematics(lv, ["run", "grid_index"]), 6)


COLUMN_KINEMATICS_SQL = f"""
with {A.LEVELS_SQL}, l as (select run, grid_index, k, case when k = 0 then 0 else z_m end as z, u, v from levels),
pr as (select *, lead(z) over w as z1, lead(u) over w as u1, lead(v) over w as v1 from l window w as (partition by run, grid_index order by k)),
h as (select run, grid_index, {", ".join(f"max(case when z <= {t} and z1 > {t} then {c} + ({t} - z) / (z1 - z) * ({c}1 - {c}) end) as {c}{t}" for c in "uv" for t in (0, 1000, 3000, 6000, 8000))} from pr group by 1, 2),
s as (select *, least(z1, 6000) as zb from pr where z1 > 0 and z < 6000),
m as (select run, grid_index, {", ".join(f"sum(({c} + {c} + (zb - z) / (z1 - z) * ({c}1 - {c})) / 2 * (zb - z)) / sum(zb - z) as m{c}" for c in "uv")} from s group by 1, 2)
select run, grid_index, {", ".join(f"round(sqrt((u{t} - u0) ** 2 + (v{t} - v0) ** 2) + 3.3e-9, 6) as shear_0_{t // 1000}km" for t in (1000, 3000, 6000, 8000))}, round(mu + 3.3e-9, 6) as mean_u, round(mv + 3.3e-9, 6) as mean_v from h join m using (run, grid_index)
"""


def wind_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind speed in knots at levels whose both parts are there."""
    lv = A.levels(spark, sf_dir)
    long = lv.select("run", "grid_index", F.col("k").alias("level"), F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.when((F.col("k") + F.col("grid_index")) % (5 + i) != 0, F.col(n)).alias("value")) for i, n in enumerate("uv")))))
    return _r(Q.wind_speed_fill(long, ["run"]), 6)


WIND_FILL_SQL = f"with {A.LEVELS_SQL} select run, grid_index, k as level, round(sqrt(u * u + v * v) / 0.51444, 6) as value from levels where (k + grid_index) % 5 <> 0 and (k + grid_index) % 6 <> 0"


def asset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's spelling of its nation looked up among slugs, labels and tags."""
    n = A.table(spark, sf_dir, "nation")
    assets = n.select(F.concat(F.lit("country-"), F.col("n_nationkey").cast("string")).alias("slug"), F.initcap(F.lower("n_name")).alias("label"), F.array(F.concat(F.lit("iso:x"), F.col("n_nationkey").cast("string")), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string"))).alias("tags"), F.col("n_nationkey").cast("long").alias("seq"))
    c = A.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    spelled = F.when(k % 4 == 0, F.concat(F.lit("  "), F.col("n_name"), F.lit("!"))).when(k % 4 == 1, F.concat(F.lit("Country "), F.col("n_nationkey").cast("string"))).when(k % 4 == 2, F.concat(F.lit("X"), F.col("n_nationkey").cast("string"))).otherwise(F.lit("nowhere"))
    return Q.find_assets(assets, c.select(k.alias("query_id"), spelled.alias("query")))


ASSET_LOOKUP_SQL = "select c_custkey as query_id, 'country-' || c_nationkey::varchar as slug from customer where c_custkey % 4 <> 3"


def place_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each nation's box by centre, by crop that meets it and by crop within it."""
    n = F.col("n_nationkey")
    boxes = A.table(spark, sf_dir, "nation").select(n.cast("long").alias("area_id"), (-123.07 + n * 5 % 27 - 2).alias("west"), (-123.07 + n * 5 % 27 + 2).alias("east"), (26.03 + n * 7 % 8 - 1.5).alias("south"), (26.03 + n * 7 % 8 + 1.5).alias("north"))
    tiles = boxes.withColumn("_by", F.explode(F.sequence(F.floor(F.col("south") - 1), F.floor(F.col("north") + 1))))
    p = A.points(spark, sf_dir)
    lon, lat, half = F.col("plon"), F.col("plat"), 0.4
    crop, box = (lon - half, lon + half, lat - half, lat + half), tuple(F.col(c) for c in ("west", "east", "south", "north"))
    j = p.withColumn("_by", F.floor("plat")).join(tiles, "_by")
    return j.groupBy("area_id").agg(*(F.count_if(Q.contains_mode(m, lon, lat, crop, box)).alias(m) for m in ("center", "intersects", "within")))


PLACE_CONTAINMENT_SQL = f"""
with {A.POINTS_SQL}, b as (select n_nationkey::bigint as area_id, -123.07::double + n_nationkey * 5 % 27 as cx, 26.03::double + n_nationkey * 7 % 8 as cy from nation)
select area_id, count(*) filter (where abs(plon - cx) <= 2 and abs(plat - cy) <= 1.5) as center, count(*) filter (where abs(plon - cx) <= 2.4 and abs(plat - cy) <= 1.9) as intersects, count(*) filter (where abs(plon - cx) <= 1.6 and abs(plat - cy) <= 1.1) as within from b, points group by 1
"""


def report_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midline and farthest corners of the bounds of every ten storm reports."""
    r = A.reports(spark, sf_dir)
    b = r.groupBy(F.floor(F.col("report_id") / 10).alias("g")).agg(F.min("rlon").alias("west"), F.max("rlon").alias("east"), F.min("rlat").alias("south"), F.max("rlat").alias("north"))
    mid = Q.representative_route(b).withColumn("kind", F.lit("midline"))
    return _r(mid.unionByName(Q.representative_route(b, farthest=True).withColumn("kind", F.lit("farthest"))).drop("west", "east", "south", "north"))


_KM = "2 * asin(sqrt(sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2))"
REPORT_ROUTES_SQL = f"""
with {A.REPORTS_SQL}, b as (select report_id // 10 as g, min(rlon) as w, max(rlon) as e, min(rlat) as s, max(rlat) as n from reports group by 1),
m as (select *, (s + n) / 2 as la, (w + e) / 2 as lo from b), h as (select *, {_KM.format(a="la", b="la", c="w", d="e")} >= {_KM.format(a="s", b="n", c="lo", d="lo")} as wide from m),
c as (select g, unnest([0, 1, 2, 3]) as i, unnest([s, s, n, n]) as lat, unnest([w, e, w, e]) as lon from b),
p as (select a.g, a.lat as lat0, a.lon as lon0, z.lat as lat1, z.lon as lon1, row_number() over (partition by a.g order by {_KM.format(a="a.lat", b="z.lat", c="a.lon", d="z.lon")} desc, a.i, z.i) as r from c a join c z on a.g = z.g and a.i < z.i)
select g, round(case when wide then la else s end, 6) as lat0, round(case when wide then w else lo end, 6) as lon0, round(case when wide then la else n end, 6) as lat1, round(case when wide then e else lo end, 6) as lon1, 'midline' as kind from h
union all select g, round(lat0, 6), round(lon0, 6), round(lat1, 6), round(lon1, 6), 'farthest' from p where r = 1
"""


def terrain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface pressure and height along every route and run: extremes and where they lie."""
    from cumula.operators.sampling import k_nearest

    p = SE.sample_route(_route(spark, sf_dir), 11).withColumn("point_id", F.concat_ws(":", "route_id", "seq"))
    near = k_nearest(_grid(A.cells(spark, sf_dir)), p.select("point_id", "plat", "plon"), 1).select("point_id", "grid_index")
    at = A.surface(spark, sf_dir).select("run", "grid_index", F.col("p_hpa").alias("psfc_hpa"), "orog_m").join(near, "grid_index").join(p.select("point_id", "route_id", "seq"), "point_id")
    return _r(Q.terrain_facts(at, ["run", "route_id"]))


def _extreme(c: str, sign: str) -> str:
    return f"first({c} order by {c} {sign}, seq) as {c}_{'min' if not sign else 'max'}, first(seq order by {c} {sign}, seq) as {c}_{'min' if not sign else 'max'}_seq"


TERRAIN_FACTS_SQL = f"""
with {A.SURFACE_SQL}, {ROUTE_SQL}, places as (select distinct grid_index, lat, lon from grid),
near as (select route_id, seq, grid_index, row_number() over (partition by route_id, seq order by {_SCORE}, grid_index) as rank from route join places on true),
s as (select run, route_id, seq, p_hpa as psfc_hpa, orog_m from near join surface using (grid_index) where rank = 1)
select run, route_id, {", ".join(_extreme(c, s) for c in ("psfc_hpa", "orog_m") for s in ("", "desc"))} from s group by 1, 2
"""


def nearest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sites nearest to every point; suppliers stand for sites."""
    k = F.col("s_suppkey")
    sites = A.table(spark, sf_dir, "supplier").select(k.cast("long").alias("site_id"), (25 + k * 61 % 97 / 97 * 9.75).alias("lat"), (-125 + k * 43 % 89 / 89 * 29.5).alias("lon"))
    return _r(Q.nearest_sites(sites, A.points(spark, sf_dir), 3))


NEAREST_SITES_SQL = f"""
with {A.POINTS_SQL}, s as (select s_suppkey::bigint as site_id, 25 + s_suppkey * 61 % 97 / 97.0::double * 9.75::double as lat, -125 + s_suppkey * 43 % 89 / 89.0::double * 29.5::double as lon from supplier),
d as (select point_id, site_id, 6371 * {_KM.format(a="lat", b="plat", c="lon", d="plon")} as km from points, s), r as (select *, row_number() over (partition by point_id order by km, site_id)::int as rank from d)
select point_id, site_id, round(km, 6) as km, rank from r where rank <= 3
"""


def sweep_nyquist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nyquist velocity of each sweep, from the sweep, its first radial, or the default."""
    g = A.gates(spark, sf_dir).select("volume", "sweep", "az").distinct()
    radials = g.withColumns({"sweep_nyquist": F.when(F.col("sweep") == 0, 26.0), "radial_nyquist": F.when((F.col("sweep") < 3) & (F.col("az") % 16 == 8), 20.0 + F.col("az") % 10)})
    return Q.effective_nyquist(radials)


SWEEP_NYQUIST_SQL = f"""
with {A.GATES_SQL}, r as (select distinct volume, sweep, az, case when sweep = 0 then 26.0::double end as s, case when sweep < 3 and az % 16 = 8 then 20.0::double + az % 10 end as n from gates)
select volume, sweep, coalesce(max(s), arg_min(n, az) filter (where n is not null), 30.0::double) as nyquist from r group by 1, 2
"""


def grid_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case reports of every run as JSON and CSV: masks with their largest objects, field statistics, failures, read back into one wide row."""
    s = A.surface(spark, sf_dir).withColumn("case", F.format_string("run_%04d", "run"))
    masks = s.select("case", "run", "grid_index", "y", "x", F.inline(F.array(F.struct(F.lit("warm").alias("mask"), (F.col("t_c") >= 25).alias("hit")), F.struct(F.lit("dry").alias("mask"), (F.col("rh") <= 20).alias("hit")))))
    own = written(masks.where("hit"))
    objects = G.components(own.select("case", "mask", "y", "x", "grid_index"), ["case", "mask"]).groupBy("case", "mask", "label").agg(F.count("*").alias("n")).groupBy("case", "mask").agg(F.max("n").alias("largest"))
    size = s.groupBy("case").agg(F.count("*").alias("cells"))
    shares = own.groupBy("case", "mask").agg(F.count("*").alias("n")).join(objects, ["case", "mask"]).join(size, "case").select("case", "mask", (F.col("n") / F.col("cells")).alias("fraction"), (F.col("largest") / F.col("cells")).alias("largest_of_grid"), (F.col("largest") / F.col("n")).alias("largest_of_mask"))
    fields = s.select("case", "grid_index", F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("t_c", "u")))))
    stats = R.stats_by_mask(fields, masks, ["case"])
    reports = shares.groupBy("case").agg(F.collect_list(F.struct("mask", "fraction", "largest_of_grid", "largest_of_mask")).alias("masks"))
    reports = reports.join(stats.groupBy("case").agg(F.collect_list(F.struct(*(c for c in stats.columns if c != "case"))).alias("fields")), "case").join(size, "case").join(Q.failure_count(s, ["case"], F.col("rh") < 6), "case")
    reports.write.json(path := new_path(spark, "gridstats"))
    read = spark.read.schema(reports.schema).json(path)
    wide = Q.case_summary(read.select("case", F.inline("masks")), read.select("case", F.inline("fields")), ["warm", "dry"], ["t_c", "u"])
    Q.write_case_summary(wide, read.select("case", F.inline("fields")), csv := new_path(spark, "cases"))
    back = spark.read.schema(wide.schema).csv(f"{csv}/cases", header=True)
    return _r(back.join(read.select("case", "cells", "failures"), "case"))


GRID_RESEARCH_SQL = f"""
with recursive {A.SURFACE_SQL}, mask as (select run, grid_index, y, x, unnest(['warm', 'dry']) as mask, unnest([t_c >= 25, rh <= 20]) as hit from surface),
own as materialized (select run, mask, grid_index, y, x from mask where hit),
nb as materialized (select a.run, a.mask, a.grid_index as a, b.grid_index as b from own a join own b on a.run = b.run and a.mask = b.mask and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and a.grid_index <> b.grid_index),
lab(run, mask, n, label) as (select run, mask, grid_index, grid_index from own union select nb.run, nb.mask, nb.b, lab.label from lab join nb on nb.run = lab.run and nb.mask = lab.mask and nb.a = lab.n and lab.label < nb.b),
best as (select run, mask, n, min(label) as label from lab group by 1, 2, 3), big as (select run, mask, max(c) as largest, sum(c) as n from (select run, mask, label, count(*) as c from best group by 1, 2, 3) group by 1, 2),
z as (select run, count(*) as cells, count(*) filter (where rh < 6) as failures, {", ".join(f"{e} as {f}_{n}" for f in ("t_c", "u") for n, e in (("median", f"quantile_cont({f}, 0.5)"), ("p90", f"quantile_cont({f}, 0.9)"), ("p95", f"quantile_cont({f}, 0.95)"), ("max", f"max({f})")))} from surface group by 1)
select 'run_' || lpad(z.run::varchar, 4, '0') as "case", cells, failures, {", ".join(f"round({m}.n / cells * 100, 6) as {m}_pct, round({m}.largest / cells * 100, 6) as {m}_largest_component_pct, round({m}.largest / {m}.n * 100, 6) as {m}_largest_component_of_mask_pct" for m in ("warm", "dry"))},
  {", ".join(f"round({f}_{n}, 6) as {f}_{n}" for f in ("t_c", "u") for n in ("median", "p90", "p95", "max"))} from z left join big warm on warm.run = z.run and warm.mask = 'warm' left join big dry on dry.run = z.run and dry.mask = 'dry'
"""


QUERIES = {f.__name__: f for f in (products_at_points, products_in_areas, field_query, case_extract, mosaic_series, box_soundings, updraft_helicity, refl_1km, surface_bundle, derived_recipes, column_kinematics, wind_fill, asset_lookup, place_containment, report_routes, terrain_facts, nearest_sites, sweep_nyquist, grid_research)}
ORACLES = {
    "products_at_points": PRODUCTS_AT_POINTS_SQL, "products_in_areas": PRODUCTS_IN_AREAS_SQL, "field_query": FIELD_QUERY_SQL, "case_extract": CASE_EXTRACT_SQL, "mosaic_series": MOSAIC_SERIES_SQL, "box_soundings": BOX_SOUNDINGS_SQL,
    "updraft_helicity": UPDRAFT_HELICITY_SQL, "refl_1km": REFL_1KM_SQL, "surface_bundle": SURFACE_BUNDLE_SQL, "derived_recipes": DERIVED_RECIPES_SQL, "column_kinematics": COLUMN_KINEMATICS_SQL, "wind_fill": WIND_FILL_SQL,
    "asset_lookup": ASSET_LOOKUP_SQL, "place_containment": PLACE_CONTAINMENT_SQL, "report_routes": REPORT_ROUTES_SQL, "terrain_facts": TERRAIN_FACTS_SQL, "nearest_sites": NEAREST_SITES_SQL, "sweep_nyquist": SWEEP_NYQUIST_SQL, "grid_research": GRID_RESEARCH_SQL,
}
