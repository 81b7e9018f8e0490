"""Queries over neighbouring cells, sections, parcels and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.functions import thermo as T
from cumula.functions import wind as W
from cumula.operators import parcels as PA
from cumula.operators import places as PL
from cumula.operators import sections as SE
from cumula.operators import stencil as S
from cumula.plans.areas import _SCORE, _r

DX, DY = 50_000.0, 28_000.0


def temperature_advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.surface(spark, sf_dir).where("grid_index % 97 <> 5")
    return _r(S.temperature_advection(s, ["run"], DX, DY).select("run", "grid_index", "advection"))


def _grad(v: str, table: str, keep: str) -> str:
    return f"""
    select {keep}, case when lead(x) over r = x + 1 and lag(x) over r = x - 1 then (lead({v}) over r - lag({v}) over r) / 100000 when lead(x) over r = x + 1 then (lead({v}) over r - {v}) / 50000 when lag(x) over r = x - 1 then ({v} - lag({v}) over r) / 50000 end as gx,
           case when lead(y) over c = y + 1 and lag(y) over c = y - 1 then (lead({v}) over c - lag({v}) over c) / 56000 when lead(y) over c = y + 1 then (lead({v}) over c - {v}) / 28000 when lag(y) over c = y - 1 then ({v} - lag({v}) over c) / 28000 end as gy
    from {table} window r as (partition by run, y order by x), c as (partition by run, x order by y)"""


TEMPERATURE_ADVECTION_SQL = f"with {A.SURFACE_SQL}, s as (select * from surface where grid_index % 97 <> 5), g as ({_grad('t_c', 's', 'run, grid_index, u, v')}) select run, grid_index, round(-(u * gx + v * gy) * 3600, 6) as advection from g"


def vorticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.vorticity(A.surface(spark, sf_dir), ["run"], DX, DY)
    return _r(v.select("run", "grid_index", (F.col("rel_vort") * 1e5).alias("rel"), (F.col("abs_vort") * 1e5).alias("abs")))


VORTICITY_SQL = f"""
with {A.SURFACE_SQL}, u as ({_grad("u", "surface", "run, grid_index, lat")}), v as ({_grad("v", "surface", "run, grid_index")})
select run, grid_index, round((v.gx - u.gy) * 1e5, 6) as rel, round((v.gx - u.gy + 2 * 7.292e-5 * sin(radians(lat))) * 1e5, 6) as abs from u join v using (run, grid_index)
"""


def destagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.surface(spark, sf_dir).select("run", "y", "x", "u")
    return _r(S.destagger(s, ["run"], "x", "u"))


DESTAGGER_SQL = f"with {A.SURFACE_SQL}, n as (select run, y, x, u, lead(u) over w as u1, lead(x) over w as x1 from surface window w as (partition by run, y order by x)) select run, y, x, round((u + u1) / 2, 6) as u from n where x1 = x + 1"


def rotate_lon(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.grid(spark, sf_dir).select("run", "y", "x", "grid_index", (F.col("lon") * 6 + 720).alias("lon"))
    return _r(S.rotate_lon(g, ["run"]))


ROTATE_LON_SQL = f"with {A.GRID_SQL}, n as (select run, y, grid_index, (lon * 6 + 720) - 360 * floor((lon * 6 + 720 + 180) / 360) as lon from grid) select run, y, row_number() over (partition by run, y order by lon) - 1 as x, grid_index, round(lon, 6) as lon from n"


def fill_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.grid(spark, sf_dir).select("run", "y", "x", (F.col("price") / 1000).alias("value"), (F.col("price") > 200000).alias("masked"))
    return _r(S.fill_masked(g, ["run"], 2))


FILL_MASKED_SQL = f"""
with {A.GRID_SQL}, g as (select run, y, x, price / 1000 as value, price > 200000 as masked from grid),
p as (select a.run, a.y, a.x, b.value, greatest(abs(b.y - a.y), abs(b.x - a.x)) as ring, 1 / sqrt((b.y - a.y) ** 2 + (b.x - a.x) ** 2) as w from g a join g b on a.run = b.run and a.masked and not b.masked and abs(a.y - b.y) <= 12 and abs(a.x - b.x) <= 12),
l as (select run, y, x, min(ring) as least from p group by 1, 2, 3), f as (select run, y, x, sum(value * w) / sum(w) as v from p join l using (run, y, x) where ring = least group by 1, 2, 3)
select run, y, x, round(coalesce(v, value), 6) as value, masked from g left join f using (run, y, x)
"""


def isolines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line pieces at two levels, counted and summed by row."""
    g = A.grid(spark, sf_dir).select("run", "y", "x", (F.col("price") / 1000 + 0.0005).alias("value"))
    s = S.isolines(g, ["run"], "value", [100.0, 320.0])
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return _r(s.groupBy("run", "level", "y").agg(F.count("*").alias("pieces"), F.sum(length).alias("length"), F.sum(F.col("x0") + F.col("x1")).alias("sx")), 5)


_SQ = "sq as (select * from (select run, y, x, v as a, lead(v) over r as b, lead(x) over r as xr from g window r as (partition by run, y order by x)) where xr = x + 1), s4 as (select * from (select *, lead(a) over c as d, lead(b) over c as cc, lead(y) over c as yu from sq window c as (partition by run, x order by y)) where yu = y + 1)"
ISOLINES_SQL = f"""
with {A.GRID_SQL}, g as (select run, y, x, price / 1000 + 0.0005 as v from grid), {_SQ},
l as (select *, (a >= lv)::int + (b >= lv)::int * 2 + (cc >= lv)::int * 4 + (d >= lv)::int * 8 as k, (a + b + cc + d) / 4 >= lv as hi, x + (lv - a) / (b - a) as x_low, y + (lv - b) / (cc - b) as y_right, x + (lv - d) / (cc - d) as x_up, y + (lv - a) / (d - a) as y_left from s4, (values (100.0::double), (320.0::double)) as t(lv)),
p as (select run, lv, y, unnest(case when k in (1, 14) then [[3, 0]] when k in (2, 13) then [[0, 1]] when k in (3, 12) then [[3, 1]] when k in (4, 11) then [[1, 2]] when k in (6, 9) then [[0, 2]] when k = 7 then [[3, 2]] when k = 8 then [[2, 3]]
  when k = 5 and hi then [[3, 2], [0, 1]] when k = 5 then [[3, 0], [1, 2]] when k = 10 and hi then [[3, 0], [1, 2]] when k = 10 then [[0, 1], [2, 3]] else []::int[][] end) as s, x, x_low, y_right, x_up, y_left from l),
e as (select run, lv, y, {", ".join(f"case s[{i + 1}] when 0 then x_low when 1 then x + 1 when 2 then x_up else x end as x{i}, case s[{i + 1}] when 0 then y when 1 then y_right when 2 then y + 1 else y_left end as y{i}" for i in range(2))} from p)
select run, lv as level, y, count(*) as pieces, round(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)), 5) as length, round(sum(x0 + x1), 5) as sx from e group by 1, 2, 3
"""


def band_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each band by run; the bands of a square add up to what lies inside the thresholds."""
    g = A.grid(spark, sf_dir).select("run", "y", "x", (F.col("price") / 1000).alias("value"))
    return _r(S.band_areas(g, ["run"], "value", [0.0, 100.0, 250.0, 1000.0]).groupBy("run", "bin").agg(F.sum("area").alias("area"), F.count("*").alias("squares")), 5)


def _triangle_over(t: str) -> str:
    return f"case when l >= {t} then 0.25 when h <= {t} then 0 when m <= {t} then (h - {t}) ** 2 / ((h - l) * (h - m)) / 4 else (1 - ({t} - l) ** 2 / ((h - l) * (m - l))) / 4 end"


BAND_AREAS_SQL = f"""
with {A.GRID_SQL}, g as (select run, y, x, price / 1000 as v from grid), {_SQ},
t as (select run, y, x, unnest([list_sort([a, b, z]), list_sort([b, cc, z]), list_sort([cc, d, z]), list_sort([d, a, z])]) as t from (select *, (a + b + cc + d) / 4 as z from s4)),
u as (select run, y, x, t[1] as l, t[2] as m, t[3] as h from t),
p as (select run, y, x, {_triangle_over("0")} as o0, {_triangle_over("100")} as o1, {_triangle_over("250")} as o2, {_triangle_over("1000")} as o3 from u),
q as (select run, y, x, unnest([0, 1, 2]) as bin, unnest([sum(o0 - o1), sum(o1 - o2), sum(o2 - o3)]) as area from p group by 1, 2, 3)
select run, bin, round(sum(area), 5) as area, count(*) as squares from q where area > 1e-12 group by 1, 2
"""


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    corners = F.inline(F.array(F.struct(F.lit(0).alias("seq"), (26.03 + n * 7 % 8).alias("lat"), (-123.07 + n * 5 % 27).alias("lon")), F.struct(F.lit(1).alias("seq"), F.lit(29.92).alias("lat"), F.lit(-110.21).alias("lon")), F.struct(F.lit(2).alias("seq"), F.lit(33.13).alias("lat"), F.lit(-101.17).alias("lon"))))
    return A.table(spark, sf_dir, "nation").select(n.cast("long").alias("route_id"), corners)


def route_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven points at equal distances along routes of two legs."""
    return _r(SE.sample_route(_route(spark, sf_dir), 11), 5)


_HAV = "2 * asin(sqrt(sin(radians(({b}.lat - {a}.lat)) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians(({b}.lon - {a}.lon)) / 2) ** 2))"
ROUTE_SQL = f"""
c as (select n_nationkey::bigint as route_id, unnest([0, 1, 2]) as seq, unnest([26.03::double + n_nationkey * 7 % 8, 29.92::double, 33.13::double]) as lat, unnest([-123.07::double + n_nationkey * 5 % 27, -110.21::double, -101.17::double]) as lon from nation),
leg as (select a.route_id, a.seq, a.lat as la, a.lon as lo, b.lat as lb, b.lon as lp, {_HAV.format(a="a", b="b")} as ang from c a join c b on a.route_id = b.route_id and b.seq = a.seq + 1),
cum as (select *, 6371 * ang as len, 6371 * (sum(ang) over (partition by route_id order by seq) - ang) as d0, 6371 * sum(ang) over (partition by route_id) as total from leg),
pt as (select *, total * i / 10 as d from cum, (select unnest(range(11)) as i)),
hit as (select *, least((d - d0) / len, 1) as f from pt where (d >= d0 and d < d0 + len) or (i = 10 and seq = 1)),
xyz as (select *, sin((1 - f) * ang) / sin(ang) as wa, sin(f * ang) / sin(ang) as wb from hit where not (i = 10 and seq = 0)),
r3 as (select *, wa * cos(radians(la)) * cos(radians(lo)) + wb * cos(radians(lb)) * cos(radians(lp)) as px, wa * cos(radians(la)) * sin(radians(lo)) + wb * cos(radians(lb)) * sin(radians(lp)) as py, wa * sin(radians(la)) + wb * sin(radians(lb)) as pz from xyz),
route as (select route_id, i::int as seq, degrees(atan2(pz, sqrt(px * px + py * py))) as plat, degrees(atan2(py, px)) as plon, d as distance_km,
  (degrees(atan2(sin(radians(lp - lo)) * cos(radians(lb)), cos(radians(la)) * sin(radians(lb)) - sin(radians(la)) * cos(radians(lb)) * cos(radians(lp - lo)))) + 360) % 360 as bearing from r3)
"""
ROUTE_SAMPLES_SQL = f"with {ROUTE_SQL} select route_id, seq, round(plat, 5) as plat, round(plon, 5) as plon, round(distance_km, 5) as distance_km, round(bearing, 5) as bearing from route"


def _section(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = A.levels(spark, sf_dir)
    return SE.sample_section(lv, lv.select("grid_index", "lat", "lon").distinct(), SE.sample_route(_route(spark, sf_dir), 11), ["run"], ["p_hpa", "t_c", "q", "u", "v"])


def section_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature, humidity, wind and others of each section, ground masked at 930 hPa, summed up by level."""
    s = SE.section_wind(SE.section_values(_section(spark, sf_dir)))
    ground = s.where("seq % 2 = 0").select("route_id", "seq", F.lit(930.0).alias("psfc_hpa")).distinct()
    names = ["relative_humidity", "theta_e", "wind_speed", "wet_bulb", "vpd", "dewpoint_depression", "moisture_transport", "specific_humidity", "along", "left_wind"]
    m = SE.mask_terrain(s, ground, names)
    return _r(m.groupBy("run", "route_id", "k").agg(F.count("relative_humidity").alias("n"), *((F.avg(c) + 3.3e-9).alias(c) for c in ["temperature", *names])), 4)


SECTION_SQL = (
    A.LEVELS_SQL
    + ","
    + ROUTE_SQL
    + f""",
places as (select distinct grid_index, lat, lon from levels),
near as (select route_id, seq, grid_index, {_SCORE} as score, row_number() over (partition by route_id, seq order by {_SCORE}, grid_index) as rank from route join places on true),
sec as (select run, route_id, near.seq, k, {", ".join(f"sum({n} / score) / nullif(sum(1 / score) filter (where {n} is not null), 0) as {n}" for n in ("p_hpa", "t_c", "q", "u", "v"))} from near join levels using (grid_index) where rank <= 4 group by 1, 2, 3, 4)
"""
)
SECTION_PRODUCTS_SQL = f"""
with {SECTION_SQL},
b as (select sec.*, radians(bearing) as br, 6.112 * exp(17.67 * t_c / (t_c + 243.5)) as es, 6.1078 * exp(17.27 * t_c / (t_c + 237.3)) as et, q * p_hpa / (0.622 + q) as e, sec.seq % 2 = 1 or p_hpa <= 930 as seen from sec join route using (route_id, seq)),
d as (select *, 243.5 * ln(e / 6.112) / (17.67 - ln(e / 6.112)) as td, case when e is not null then greatest(0, least(100, 100 * e / es)) end as rh, sqrt(u * u + v * v) as ws from b),
f as (select *, 6.112 * exp(17.67 * td / (td + 243.5)) as ed from d),
g as (select *, 0.622 * ed / (p_hpa - ed) as r, 1 / (1 / (td + 273.15 - 56) + ln((t_c + 273.15) / (td + 273.15)) / 800) + 56 as tl from f)
select run, route_id, k, count(rh) filter (where seen) as n, round(avg(t_c) + 3.3e-9, 4) as temperature, round(avg(rh) filter (where seen) + 3.3e-9, 4) as relative_humidity,
  round(avg((t_c + 273.15) * (1000 / p_hpa) ** (0.2854 * (1 - 0.28 * r)) * exp((3.376 / tl - 0.00254) * 1000 * r * (1 + 0.81 * r))) filter (where seen) + 3.3e-9, 4) as theta_e, round(avg(ws) filter (where seen) + 3.3e-9, 4) as wind_speed,
  round(avg(t_c * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t_c + rh) - atan(rh - 1.676331) + 0.00391838 * rh ** 1.5 * atan(0.023101 * rh) - 4.686035) filter (where seen) + 3.3e-9, 4) as wet_bulb,
  round(avg(et * (1 - rh / 100)) filter (where seen) + 3.3e-9, 4) as vpd, round(avg(t_c - td) filter (where seen) + 3.3e-9, 4) as dewpoint_depression, round(avg(q * 1000 * ws) filter (where seen) + 3.3e-9, 4) as moisture_transport, round(avg(q / (1 + q) * 1000) filter (where seen) + 3.3e-9, 4) as specific_humidity,
  round(avg(u * sin(br) + v * cos(br)) filter (where seen) + 3.3e-9, 4) as along, round(avg(v * sin(br) - u * cos(br)) filter (where seen) + 3.3e-9, 4) as left_wind from g group by 1, 2, 3
"""


def section_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of temperature and wind of each section."""
    s = SE.section_wind(_section(spark, sf_dir)).withColumn("t_c", F.when(F.col("p_hpa") < 960, F.col("t_c")))
    return _r(SE.section_facts(s, ["run", "route_id"], "t_c").join(SE.wind_facts(s, ["run", "route_id"]), ["run", "route_id"]), 5)


SECTION_FACTS_SQL = f"""
with {SECTION_SQL}, w as (select s.run, s.route_id, s.seq, k, case when p_hpa < 960 then t_c end as t, u, v, u * sin(radians(bearing)) + v * cos(radians(bearing)) as al, v * sin(radians(bearing)) - u * cos(radians(bearing)) as le from sec s join route using (route_id, seq)),
l as (select *, k = min(k) filter (where t is not null) over (partition by run, route_id, seq) as low from w),
lo as (select run, route_id, seq as min_seq, k as min_k, row_number() over (partition by run, route_id order by t, seq, k) as r from w where t is not null), hi as (select run, route_id, seq as max_seq, k as max_k, row_number() over (partition by run, route_id order by t desc, seq, k) as r from w where t is not null)
select run, route_id, count(t) as finite, count(*) - count(t) as missing, round(min(t), 5) as min, any_value(min_seq) as min_seq, any_value(min_k) as min_k, round(max(t), 5) as max, any_value(max_seq) as max_seq, any_value(max_k) as max_k, round(min(t) filter (where low), 5) as low_min, round(max(t) filter (where low), 5) as low_max,
  round(max(sqrt(u * u + v * v)), 5) as strongest, round(max(al) filter (where al > 0), 5) as tail, round(max(-al) filter (where al < 0), 5) as head, round(max(le) filter (where le > 0), 5) as to_left, round(max(-le) filter (where le < 0), 5) as to_right
from l join (select * from lo where r = 1) lo using (run, route_id) join (select * from hi where r = 1) hi using (run, route_id) group by 1, 2
"""


def place_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten places of each nation's box, 60 km apart."""
    n = F.col("n_nationkey")
    areas = A.table(spark, sf_dir, "nation").select(n.cast("long").alias("area_id"), (-123.07 + n * 5 % 27 - 2).alias("west"), (-123.07 + n * 5 % 27 + 2).alias("east"), (26.03 + n * 7 % 8 - 1.5).alias("south"), (26.03 + n * 7 % 8 + 1.5).alias("north"))
    places = A.points(spark, sf_dir).select(F.col("point_id").alias("place_id"), F.col("plat").alias("lat"), F.col("plon").alias("lon"), (F.col("point_id") % 17).alias("source_index"))
    return _r(PL.select_places(PL.score_places(places, areas).withColumn("score", F.round("score", 9)), 60.0, 10))


def place_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    areas = A.table(spark, sf_dir, "nation").select(n.cast("long").alias("area_id"), (-123.07 + n * 5 % 27 - 2).alias("west"), (-123.07 + n * 5 % 27 + 2).alias("east"), (26.03 + n * 7 % 8 - 1.5).alias("south"), (26.03 + n * 7 % 8 + 1.5).alias("north"))
    places = A.points(spark, sf_dir).select(F.col("point_id").alias("place_id"), F.col("plat").alias("lat"), F.col("plon").alias("lon"), (F.col("point_id") % 17).alias("source_index"))
    return _r(PL.score_places(places, areas).select("area_id", "place_id", "score"))


PLACE_SCORES_SQL = f"""
with {A.POINTS_SQL}, a as (select n_nationkey::bigint as area_id, -123.07::double + n_nationkey * 5 % 27 as cx, 26.03::double + n_nationkey * 7 % 8 as cy from nation)
select area_id, point_id as place_id, round(0.55 * least(1, (2 - abs(plon - cx)) / 2, (1.5 - abs(plat - cy)) / 1.5) + 0.35 * (1 - least(1, sqrt(((plon - cx) / 2) ** 2 + ((plat - cy) / 1.5) ** 2) / sqrt(2))) + 0.1 / (1 + point_id % 17), 6) as score
from points, a where abs(plon - cx) <= 2 and abs(plat - cy) <= 1.5
"""


PLACE_SELECTION_SQL = f"""
with recursive {A.POINTS_SQL}, a as (select n_nationkey::bigint as area_id, -123.07::double + n_nationkey * 5 % 27 as cx, 26.03::double + n_nationkey * 7 % 8 as cy from nation),
s as (select area_id, point_id as place_id, plat as lat, plon as lon,
  round(0.55 * least(1, (2 - abs(plon - cx)) / 2, (1.5 - abs(plat - cy)) / 1.5) + 0.35 * (1 - least(1, sqrt(((plon - cx) / 2) ** 2 + ((plat - cy) / 1.5) ** 2) / sqrt(2))) + 0.1 / (1 + point_id % 17), 9) as score
  from points, a where abs(plon - cx) <= 2 and abs(plat - cy) <= 1.5),
o as materialized (select *, row_number() over (partition by area_id order by score desc, place_id) as i from s),
f(area_id, i, kept) as (
  select distinct area_id, 0::bigint, []::struct(place_id bigint, lat double, lon double, score double)[] from o
  union all
  select f.area_id, o.i, case when len(f.kept) >= 10 or len(list_filter(f.kept, lambda y: 2 * 6371 * asin(sqrt(least(1, sin(radians(o.lat - y.lat) / 2) ** 2 + cos(radians(y.lat)) * cos(radians(o.lat)) * sin(radians(o.lon - y.lon) / 2) ** 2))) < 60)) > 0
    then f.kept else list_append(f.kept, {{'place_id': o.place_id::bigint, 'lat': o.lat::double, 'lon': o.lon::double, 'score': o.score::double}}) end
  from f join o on o.area_id = f.area_id and o.i = f.i + 1),
l as (select area_id, arg_max(kept, i) as kept from f group by 1), u as (select area_id, kept, unnest(range(1, len(kept) + 1)) as rank from l)
select area_id, rank::int as rank, kept[rank].place_id as place_id, round(kept[rank].score, 6) as score from u
"""

#: Places of an area in order; a recursive fold keeps those that no kept one crowds.
PLACE_DECLUTTER_SQL = f"""
with recursive {A.POINTS_SQL}, a as (select n_nationkey::bigint as area_id, -123.07::double + n_nationkey * 5 % 27 - 2 as west, -123.07::double + n_nationkey * 5 % 27 + 2 as east, 26.03::double + n_nationkey * 7 % 8 - 1.5 as south, 26.03::double + n_nationkey * 7 % 8 + 1.5 as north from nation),
p as (select *, (0.2::double + point_id % 5 * 0.05::double) as half, greatest(abs(cos(radians(plat))), 0.25) as shrink from points),
c as (select point_id as place_id, plat as lat, plon as lon, shrink, plon - half * 1.4 / shrink as cw, plon + half * 1.4 / shrink as ce, plat - half as cs, plat + half as cn from p),
j as (select *, 2 * 6371 * asin(sqrt(least(1, sin(radians(lat - (south + north) / 2) / 2) ** 2 + cos(radians((south + north) / 2)) * cos(radians(lat)) * sin(radians(lon - (west + east) / 2) / 2) ** 2))) as center_km,
  2 * 6371 * asin(sqrt(least(1, sin(radians(north - south) / 2) ** 2 + cos(radians(south)) * cos(radians(north)) * sin(radians(east - west) / 2) ** 2))) as diagonal,
  least(abs(lon - west) * shrink, abs(east - lon) * shrink, abs(lat - south), abs(north - lat)) * 111.32 as margin_km,
  least(greatest(1, (east - west) * abs(cos(radians((south + north) / 2))) * 111.32 / 2), greatest(1, (north - south) * 111.32 / 2)) as half_km
  from c, a where cw <= east and ce >= west and cs <= north and cn >= south),
s as (select *, round(0.55 * greatest(0, least(1, margin_km / half_km)) + 0.35 * greatest(0, least(1, 1 - center_km / greatest(1, diagonal))) + 0.1 * (1 - place_id / (select greatest(1, max(c_custkey))::double from customer)), 9) as score, round(center_km, 6) as ckm from j),
o as materialized (select *, (ce - cw) * greatest(abs(cos(radians((cs + cn) / 2))), 0.25) * 111.32 * (cn - cs) * 111.32 as area, row_number() over (partition by area_id order by score desc, ckm, place_id) as i from s),
x as materialized (select b.area_id, b.i as better, w.i as worse from o b join o w on b.area_id = w.area_id and b.i < w.i and abs(b.lat - w.lat) < 2 and abs(b.lon - w.lon) < 3
  where 2 * 6371 * asin(sqrt(least(1, sin(radians(w.lat - b.lat) / 2) ** 2 + cos(radians(b.lat)) * cos(radians(w.lat)) * sin(radians(w.lon - b.lon) / 2) ** 2))) < 40
    or (least(b.ce, w.ce) > greatest(b.cw, w.cw) and least(b.cn, w.cn) > greatest(b.cs, w.cs)
      and (least(b.ce, w.ce) - greatest(b.cw, w.cw)) * greatest(abs(cos(radians((greatest(b.cs, w.cs) + least(b.cn, w.cn)) / 2))), 0.25) * 111.32 * (least(b.cn, w.cn) - greatest(b.cs, w.cs)) * 111.32 / greatest(1, least(b.area, w.area)) > 1.0::double / 3)),
y as materialized (select area_id, worse as i, list(better) as rivals from x group by 1, 2),
n as materialized (select o.area_id, o.i, coalesce(y.rivals, []::bigint[]) as rivals from o left join y using (area_id, i)),
f(area_id, i, kept) as (
  select distinct area_id, 0::bigint, []::bigint[] from o
  union all
  select f.area_id, n.i, case when list_has_any(f.kept, n.rivals) then f.kept else list_append(f.kept, n.i) end from f join n on n.area_id = f.area_id and n.i = f.i + 1),
l as (select area_id, unnest(arg_max(kept, i)) as i from f group by 1)
select o.area_id, (row_number() over (partition by o.area_id order by i))::int as rank, o.place_id, round(o.ckm, 6) as center_km, round(o.margin_km, 6) as margin_km, round(o.score, 6) as score from l join o using (area_id, i)
"""


def place_declutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of each nation's box whose crops do not crowd: 40 km apart, at most a third shared."""
    n = F.col("n_nationkey")
    areas = A.table(spark, sf_dir, "nation").select(n.cast("long").alias("area_id"), (-123.07 + n * 5 % 27 - 2).alias("west"), (-123.07 + n * 5 % 27 + 2).alias("east"), (26.03 + n * 7 % 8 - 1.5).alias("south"), (26.03 + n * 7 % 8 + 1.5).alias("north"))
    p = F.col("point_id")
    crop = W.centered_bounds(F.col("plon"), F.col("plat"), 0.2 + p % 5 * 0.05, 1.4)
    places = A.points(spark, sf_dir).select(p.alias("place_id"), F.col("plat").alias("lat"), F.col("plon").alias("lon"), p.alias("source_index"), *(x.alias(name) for x, name in zip(crop, PL.CROP, strict=True)))
    ranked = PL.rank_places(places, areas, "intersects").withColumns({"score": F.round("score", 9), "center_km": F.round("center_km", 6)})
    order = [-F.col("score"), F.col("center_km"), F.col("source_index"), F.col("place_id")]
    return _r(PL.declutter(ranked, order, 40.0, 1 / 3).select("area_id", "rank", "place_id", "center_km", "margin_km", "score"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instability of every column for three kinds of parcel."""
    return _r(PA.parcel(A.levels(spark, sf_dir), ["run", "grid_index"]), 4)


def ecape_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entraining instability of every column for the right-moving storm, with indices and ratios to the surface table's own instability."""
    lv = A.levels(spark, sf_dir).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m")))
    native = A.surface(spark, sf_dir).select("run", "grid_index", (F.col("rh") * 20).alias("sbcape"), (F.col("rh") * 15).alias("mucape"))
    return _r(PA.ecape_fields(lv, ["run", "grid_index"], native), 4)


def severe_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite indices of every column from its parcels and winds."""
    from cumula.operators import profile as C

    lv, keys = A.levels(spark, sf_dir).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m"))), ["run", "grid_index"]
    p = PA.parcel(lv, keys, ("sb", "mu"))
    own = {f"{k}{short}": F.max(F.when(F.col("kind") == k, F.col(c))) for k in ("sb", "mu") for c, short in (("cape", "cape"), ("cin", "cin"), ("lcl_m", "lcl"), ("ecape", "ecape"))}
    j = p.groupBy(*keys).agg(*(v.alias(k) for k, v in own.items())).join(C.wind_bundle(lv, keys), keys)
    c = F.col
    return _r(j.select(*keys, "sbcape", "mucape", "muecape", T.stp_fixed(c("sbcape"), c("sblcl"), c("srh_0_1km"), c("shear_0_6km")).alias("stp"), T.stp_effective(c("sbcape"), c("sblcl"), c("srh_0_1km"), c("shear_0_6km"), c("sbcin")).alias("stp_eff"), T.scp(c("mucape"), c("srh_0_3km"), c("shear_0_6km")).alias("scp"), T.ehi(c("sbcape"), c("srh_0_1km")).alias("ehi"), T.ratio_guarded(c("muecape"), c("mucape")).alias("ratio")), 4)


QUERIES = {f.__name__: f for f in (temperature_advection, vorticity, destagger, rotate_lon, fill_masked, isolines, band_areas, route_samples, section_products, section_facts, place_selection, place_scores, place_declutter, parcels, ecape_fields, severe_bundle)}
ORACLES = {
    "temperature_advection": TEMPERATURE_ADVECTION_SQL, "vorticity": VORTICITY_SQL, "destagger": DESTAGGER_SQL, "rotate_lon": ROTATE_LON_SQL, "fill_masked": FILL_MASKED_SQL, "isolines": ISOLINES_SQL, "band_areas": BAND_AREAS_SQL,
    "route_samples": ROUTE_SAMPLES_SQL, "section_products": SECTION_PRODUCTS_SQL, "section_facts": SECTION_FACTS_SQL, "place_scores": PLACE_SCORES_SQL, "place_selection": PLACE_SELECTION_SQL, "place_declutter": PLACE_DECLUTTER_SQL,
}
