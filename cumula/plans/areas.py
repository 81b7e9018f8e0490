"""Queries over areas, points, masks and pairs of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import areas as R
from cumula.operators import filters as P
from cumula.operators import sampling as S


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _grid(cells: DataFrame) -> DataFrame:
    return cells.select("grid_index", "y", "x", "lat", "lon").distinct()


#: Point in polygon by parity over the edges of a ring; no test point lies on a boundary.
MEMBER_SQL = (
    A.CELLS_SQL
    + ","
    + A.POLYGONS_SQL
    + """,
edges as (select p.poly_id, p.ring, p.lat as y1, p.lon as x1, q.lat as y0, q.lon as x0 from polygons p join polygons q
          on p.poly_id = q.poly_id and p.ring = q.ring and q.seq = (p.seq + 5) % 6),
places as (select distinct grid_index, lat, lon from cells),
inring as (select grid_index, poly_id, ring from places join edges on (y1 > lat) <> (y0 > lat) and lon < (x0 - x1) * (lat - y1) / (y0 - y1) + x1
           group by 1, 2, 3 having count(*) % 2 = 1),
member as (select grid_index, poly_id from inring where ring = 0 and (grid_index, poly_id) not in (select (grid_index, poly_id) from inring where ring = 1))
"""
)


def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells inside each polygon, summed up for every run and hour."""
    c = A.cells(spark, sf_dir)
    return _r(R.summarize_area(c, _grid(c), A.polygons(spark, sf_dir), ["run", "fhr"]))


AREA_SUMMARY_SQL = f"""
with {MEMBER_SQL}
select run, fhr, poly_id, count(*) as included, count(value) as valid, count(*) - count(value) as missing, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean
from cells join member using (grid_index) group by 1, 2, 3
"""


def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each polygon's cells by run."""
    c = A.cells(spark, sf_dir)
    inside = c.join(R.membership(_grid(c), A.polygons(spark, sf_dir)), "grid_index")
    return _r(R.patch_stats(inside, ["run", "poly_id"], (0.99,)))


PATCH_STATS_SQL = f"""
with {MEMBER_SQL}
select run, poly_id, count(value) as count, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean,
  round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50,
  round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99
from cells join member using (grid_index) group by 1, 2
"""


def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each polygon at or beyond thresholds."""
    c = A.cells(spark, sf_dir)
    inside = c.join(R.membership(_grid(c), A.polygons(spark, sf_dir)), "grid_index")
    v, t = F.col("value"), F.lit(20.0)
    return _r(R.threshold_counts(inside, ["run", "fhr", "poly_id"], {o: P.threshold_hit(v, F.lit(o), t) for o in ("gte", "gt", "lte", "lt")}))


THRESHOLD_COUNTS_SQL = f"""
with {MEMBER_SQL},
s as (select run, fhr, poly_id, count(value) as valid, count(*) filter (where value >= 20) as n_gte, count(*) filter (where value > 20) as n_gt,
             count(*) filter (where value <= 20) as n_lte, count(*) filter (where value < 20) as n_lt from cells join member using (grid_index) group by 1, 2, 3)
select *, round(n_gte / nullif(valid, 0), 6) as share_gte, round(n_gt / nullif(valid, 0), 6) as share_gt, round(n_lte / nullif(valid, 0), 6) as share_lte, round(n_lt / nullif(valid, 0), 6) as share_lt from s
"""


def threshold_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cells of each whole field, and those at 30 or more, after the validity test of radar mosaics."""
    c = A.cells(spark, sf_dir).withColumn("value", P.mrms_valid(F.when(F.col("grid_index") % 41 == 0, -999.0).otherwise(F.col("value")), 2.0))
    return _r(R.threshold_counts(c, ["run", "fhr"], {"hit": F.col("value") >= 30}))


THRESHOLD_FIELD_SQL = f"""
with {A.CELLS_SQL}, v as (select run, fhr, case when grid_index % 41 <> 0 then value * 2 end as value from cells),
s as (select run, fhr, count(value) as valid, count(*) filter (where value >= 30) as n_hit from v group by 1, 2)
select *, round(n_hit / nullif(valid, 0), 6) as share_hit from s
"""


def raycast_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in outer rings by the plain ray cast."""
    g = A.grid(spark, sf_dir).select("grid_index", "lat", "lon").distinct()
    e = P.ring_edges(A.polygons(spark, sf_dir).where("ring = 0")).groupBy("poly_id").agg(F.collect_list(F.struct("lat0", "lon0", "lat1", "lon1")).alias("edges"), F.min("lat1").alias("south"), F.max("lat1").alias("north"))
    tiles = e.withColumn("_by", F.explode(F.sequence(F.floor("south"), F.floor("north"))))
    return g.withColumn("_by", F.floor("lat")).join(tiles, "_by").where(P.in_polygon_raycast(F.col("lat"), F.col("lon"), F.col("edges"))).groupBy("poly_id").agg(F.count("*").alias("n"), F.sum("grid_index").alias("total"))


RAYCAST_MEMBERS_SQL = f"with {MEMBER_SQL} select poly_id, count(*) as n, sum(grid_index)::bigint as total from inring where ring = 0 group by 1"


def compare_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour 6 less hour 3 of each run inside each polygon."""
    c = A.cells(spark, sf_dir)
    a, b = (c.where(F.col("fhr") == h).select("run", "grid_index", F.col("value").alias(n)) for h, n in ((3, "a"), (6, "b")))
    pairs = a.join(b, ["run", "grid_index"]).join(R.membership(_grid(c), A.polygons(spark, sf_dir)), "grid_index")
    return _r(R.compare_stats(pairs, ["run", "poly_id"]))


COMPARE_AREA_SQL = f"""
with {MEMBER_SQL}, p as (select a.run, poly_id, b.value - a.value as d from cells a join cells b on a.run = b.run and a.grid_index = b.grid_index and a.fhr = 3 and b.fhr = 6
  join member m on m.grid_index = a.grid_index where a.value is not null and b.value is not null)
select run, poly_id, count(*) as compared, count(*) filter (where abs(d) > 1e-9) as changed, round(min(d), 6) as min_diff, round(max(d), 6) as max_diff, round(avg(d), 6) as mean_signed,
  round(avg(abs(d)), 6) as mean_abs, round(sqrt(avg(d * d)), 6) as rmse from p group by 1, 2
"""


def validate_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour 2 as native against hour 5 as derived."""
    c = A.cells(spark, sf_dir)
    a, b = (c.where(F.col("fhr") == h).select("run", "grid_index", F.col("value").alias(n)) for h, n in ((2, "a"), (5, "b")))
    return _r(R.validate_native(a.join(b, ["run", "grid_index"]), ["run"], 3.0, 3.7))


VALIDATE_NATIVE_SQL = f"""
with {A.CELLS_SQL}, p as (select a.run, a.value as a, b.value as b from cells a join cells b on a.run = b.run and a.grid_index = b.grid_index and a.fhr = 2 and b.fhr = 5 where a.value is not null and b.value is not null),
s as (select run, count(*) as n, avg(a) as ma, avg(b) as mb, corr(a, b) as r, avg(a - b) as ms, avg(abs(a - b)) as mabs, sqrt(avg((a - b) * (a - b))) as rm, max(abs(a - b)) as mx from p group by 1)
select run, n, round(ma, 6) as mean_native, round(mb, 6) as mean_derived, round(ms, 6) as mean_signed, round(mabs, 6) as mean_abs, round(rm, 6) as rmse, round(mx, 6) as max_abs, round(coalesce(r, 0), 6) as r,
  case when mabs <= 3 then 'pass' when mabs <= 3.7 then 'review' else 'reject' end as verdict from s
"""


def field_summary_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.field_summary_rounded(A.cells(spark, sf_dir), ["run", "fhr"]))


FIELD_SUMMARY_SQL = f"""
with {A.CELLS_SQL}, s as (select run, fhr, count(value) as count, avg(value) as mean, list_sort(list(value) filter (where value is not null)) as l from cells group by 1, 2)
select run, fhr, count, round(mean, 6) as mean, {", ".join(f"round(l[round((count - 1) * {q}::double)::int + 1], 6) as p{round(q * 100):02d}" for q in (0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1))} from s
"""


def stats_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields over masks of their thresholds."""
    s = A.surface(spark, sf_dir)
    fields = s.select("run", "grid_index", F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("t_c", "rh")))))
    masks = P.mask_family(s, ["run", "grid_index"], {"t_c": (10, 25.5), "u": (0.5,)})
    both = s.select("run", "grid_index", F.lit("warm_dry").alias("mask"), P.mask_all([(F.col("t_c"), 20.0), (-F.col("rh"), -40.0), (F.col("u"), -5.0)]).alias("hit"))
    return _r(R.stats_by_mask(fields, masks.unionByName(both), ["run"]))


STATS_BY_MASK_SQL = f"""
with {A.SURFACE_SQL},
f as (select run, grid_index, 'all' as mask from surface union all select run, grid_index, 't_c_10' from surface where t_c >= 10 union all select run, grid_index, 't_c_25p5' from surface where t_c >= 25.5
      union all select run, grid_index, 'u_0p5' from surface where u >= 0.5 union all select run, grid_index, 'warm_dry' from surface where t_c >= 20 and rh <= 40 and u >= -5),
v as (select s.run, mask, unnest(['t_c', 'rh']) as field, unnest([t_c, rh]) as value from surface s join f using (run, grid_index))
select run, field, mask, count(*) as count, round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(value), 6) as max,
  {", ".join(f"round(quantile_cont(value, {q}), 6) as p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))}
from v group by 1, 2, 3
"""


def ratio_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the plumes of the ratio of two instabilities."""
    g = A.grid(spark, sf_dir).select("run", (F.col("k") * 37 % 4000 - 100.0).alias("cape"), (F.col("c") * 11 % 3000 + 0.0).alias("ecape"))
    masks = P.mask_ratio(F.when(F.col("cape") >= 100, F.col("ecape") / F.col("cape")), F.col("cape"), F.col("ecape"))
    return g.groupBy("run").agg(*(F.sum(m.cast("long")).alias(n) for n, m in masks.items()))


RATIO_MASKS_SQL = f"""
with {A.GRID_SQL}, g as (select run, k * 37 % 4000 - 100 as cape, c * 11 % 3000 as ecape, case when k * 37 % 4000 - 100 >= 100 then (c * 11 % 3000) / (k * 37 % 4000 - 100) end as r from grid)
select run, (count(*) filter (where r < 0.75 and cape >= 500))::bigint as ratio_low, (count(*) filter (where r >= 1 and cape >= 250))::bigint as ratio_high, (count(*) filter (where r < 0.75 and ecape >= 500))::bigint as ratio_low_ecape from g group by 1
"""


def grid_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing, median cell area, extent and cells of each run's grid."""
    g = A.grid(spark, sf_dir)
    return _r(R.grid_spacing(g, ["run"]).join(R.cell_area(g, ["run"], 4), "run").join(R.grid_summary(g, ["run"], 1400.0), "run"), 5)


_H = "2 * 6371 * asin(sqrt(sin(radians({a}.lat - {b}.lat) / 2) ** 2 + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({a}.lon - {b}.lon) / 2) ** 2))"
GRID_GEOMETRY_SQL = f"""
with {A.GRID_SQL},
n as (select g.*, {_H.format(a="g", b="e")} as dx, {_H.format(a="g", b="n")} as dy from grid g left join grid e on e.run = g.run and e.y = g.y and e.x = g.x + 1 left join grid n on n.run = g.run and n.x = g.x and n.y = g.y + 1)
select run, round(avg(dx), 5) as dx_km, round(avg(dy), 5) as dy_km, round(quantile_cont(dx * dy, 0.5) filter (where x % 4 = 0 and y % 4 = 0), 5) as cell_km2,
  count(*) as cells, count(*) * 1400.0::double as area_km2, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from n group by 1
"""


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.channel_stats(A.cells(spark, sf_dir), ["run", "fhr"]))


CHANNEL_STATS_SQL = f"""
with {A.CELLS_SQL} select run, fhr, round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(value), 6) as max, round(stddev_pop(value), 6) as std, count(value) as count, (count(*) - count(value))::bigint as nan_count from cells group by 1, 2
"""


def crop_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the index rectangle around those in bounds, summed up."""
    c = A.cells(spark, sf_dir)
    inside = P.in_bounds(F.col("lat"), F.col("lon"), -120.2, -110.1, 27.1, 31.9)
    return _r(R.summarize(P.crop_rect(c, ["run", "fhr"], inside).withColumn("corner", (F.col("x") == 0) & (F.col("y") == 0)), ["run", "fhr", "corner"]))


CROP_RECT_SQL = f"""
with {A.CELLS_SQL}, b as (select run, fhr, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from cells where lat between 27.1 and 31.9 and lon between -120.2 and -110.1 group by 1, 2)
select run, fhr, (x = x0 and y = y0) as corner, count(*) as included, count(value) as valid, count(*) - count(value) as missing, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean
from cells join b using (run, fhr) where x between x0 and x1 and y between y0 and y1 group by 1, 2, 3
"""


def crop_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded rectangles around the cells over a value, by run and hour."""
    return P.crop_extent(A.cells(spark, sf_dir), ["run", "fhr"], F.coalesce((F.col("value") > 54.5 - F.col("fhr") * F.col("fhr")) & (F.col("x") < 40 + F.col("fhr") * 4), F.lit(False)), 2)


CROP_EXTENT_SQL = f"""
with {A.CELLS_SQL}, c as (select *, coalesce(value > 54.5 - fhr * fhr and x < 40 + fhr * 4, false) as i from cells),
b as (select run, fhr, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(x) filter (where i) as ix0, max(x) filter (where i) as ix1, min(y) filter (where i) as iy0, max(y) filter (where i) as iy1 from c group by 1, 2),
d as (select run, fhr, x0, x1, y0, y1, ix0, case when ix0 is not null then greatest(ix0 - 2, x0) end as x_from, case when ix0 is not null then least(ix1 + 2, x1) end as x_to, case when ix0 is not null then greatest(iy0 - 2, y0) end as y_from, case when ix0 is not null then least(iy1 + 2, y1) end as y_to from b)
select run, fhr, x_from, x_to, y_from, y_to, case when ix0 is null then 'empty' when x_from = x0 and x_to = x1 and y_from = y0 and y_to = y1 then 'full' else 'crop' end as kind from d
"""


def display_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of ten fields in their units of display."""
    names = [n for n, _, _, _ in P.DISPLAY_UNITS] + ["u_wind"]
    s = A.surface(spark, sf_dir).select("run", "grid_index", F.get(F.array(*map(F.lit, names)), (F.col("grid_index") % len(names)).cast("int")).alias("field"), F.col("p_hpa").alias("value"), F.lit("si").alias("units"))
    return _r(P.to_display_units(s), 4)


DISPLAY_UNITS_SQL = f"""
with {A.SURFACE_SQL}, n as (select run, grid_index, p_hpa as v, (array['smoke_mass_density','column_integrated_smoke','temperature','dewpoint','pressure_reduced_to_mean_sea_level','precipitable_water','visibility','absolute_vorticity','wind_gust','total_precipitation','u_wind'])[(grid_index % 11)::int + 1] as field from surface)
select run, grid_index, field, round(case field when 'smoke_mass_density' then v * 1e9 when 'column_integrated_smoke' then v * 1e6 when 'temperature' then v - 273.15 when 'dewpoint' then v - 273.15 when 'pressure_reduced_to_mean_sea_level' then v * 0.01
  when 'precipitable_water' then v / 25.4 when 'visibility' then v * 0.0006213712 when 'absolute_vorticity' then v * 1e5 when 'wind_gust' then v * 1.9438445 when 'total_precipitation' then v / 25.4 else v end, 4) as value,
  case field when 'smoke_mass_density' then 'ug/m^3' when 'column_integrated_smoke' then 'mg/m^2' when 'temperature' then 'degC' when 'dewpoint' then 'degC' when 'pressure_reduced_to_mean_sea_level' then 'hPa' when 'precipitable_water' then 'in'
  when 'visibility' then 'mi' when 'absolute_vorticity' then '10^-5 s^-1' when 'wind_gust' then 'kt' when 'total_precipitation' then 'in' else 'si' end as units from n
"""


def level_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in bins of their value, by the four ways to extend."""
    c = A.cells(spark, sf_dir)
    kinds = F.array(*(F.struct(F.lit(e).alias("extend"), P.level_bin(F.col("value"), [0.0, 10.0, 25.0, 40.0], e).alias("bin")) for e in ("none", "below", "above", "both")))
    return c.select("run", F.inline(kinds)).groupBy("run", "extend", "bin").agg(F.count("*").alias("n"))


LEVEL_BINS_SQL = f"""
with {A.CELLS_SQL}, e as (select run, extend, value as v from cells, (values ('none'), ('below'), ('above'), ('both')) as x(extend))
select run, extend, (case when v is null then null when v < 0 then case when extend in ('below', 'both') then -1 end when v < 10 then 0 when v < 25 then 1 when v < 40 then 2
  when v >= 40 and extend in ('above', 'both') then 3 when v = 40 then 2 end)::int as bin, count(*) as n from e group by 1, 2, 3
"""


def nearest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of the nearest cell at each point, for every run at hour 4."""
    c = A.cells(spark, sf_dir)
    return _r(S.sample_nearest(c.where("fhr = 4"), _grid(c), A.points(spark, sf_dir), ["run"]))


_SCORE = "(lat - plat) ** 2 + ((lon - plon) * greatest(abs(cos(radians(plat))), 0.2)) ** 2"
#: Every cell ranked for every point.
NEAR_SQL = (
    A.CELLS_SQL
    + ","
    + A.POINTS_SQL
    + f""",
places as (select distinct grid_index, lat, lon from cells),
near as (select point_id, grid_index, {_SCORE} as score, row_number() over (partition by point_id order by {_SCORE}, grid_index) as rank
         from points join places on true)
"""
)
NEAREST_SAMPLE_SQL = f"with {NEAR_SQL} select run, point_id, grid_index, round(value, 6) as value from near join cells using (grid_index) where rank = 1 and fhr = 4"


def idw_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-distance values at each point, with the number of cells that took part."""
    c = A.cells(spark, sf_dir)
    got = S.sample_idw4(c.where("fhr = 4"), _grid(c), A.points(spark, sf_dir), ["run"])
    return _r(got.select("run", "point_id", "value", F.size("contributors").alias("n"), F.aggregate("contributors", F.lit(0.0), lambda a, x: a + x["weight"]).alias("weights")))


IDW_SAMPLE_SQL = f"""
with {NEAR_SQL}, w as (select point_id, grid_index, case when min(score) over (partition by point_id) <= 1e-12 then case when rank = 1 then 1.0 end else 1 / greatest(score, 1e-12) end as w from near where rank <= 4),
x as (select *, w / sum(w) over (partition by point_id) as wt from w where w is not null)
select run, point_id, round(sum(wt * value) / nullif(sum(wt) filter (where value is not null), 0), 6) as value, count(*)::int as n, round(sum(wt), 6) as weights from x join cells using (grid_index) where fhr = 4 group by 1, 2
"""


def box_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box means of 30 km on each side."""
    c = A.cells(spark, sf_dir)
    return _r(S.sample_box_mean(c.where("fhr = 4"), _grid(c), A.points(spark, sf_dir), ["run"], 30.0), 9)


BOX_SAMPLE_SQL = f"""
with {NEAR_SQL}, b as (select point_id, run, avg(value) as box, count(value) as n from points join cells on abs(lat - plat) <= 30.0::double / 111 and abs(lon - plon) <= 30.0::double / 111 / greatest(abs(cos(radians(plat))), 0.2) where fhr = 4 group by 1, 2)
select c.run, near.point_id, round(coalesce(box, value), 9) as value, coalesce(n, 0) as n from near join cells c using (grid_index) left join b on b.point_id = near.point_id and b.run = c.run where rank = 1 and fhr = 4
"""


def transect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine values along a route from each nation's polygon centre to the grid's middle."""
    c = A.cells(spark, sf_dir)
    n = F.col("n_nationkey")
    routes = A.table(spark, sf_dir, "nation").select(n.cast("long").alias("route_id"), (26.03 + n * 7 % 8).alias("lat0"), (-123.07 + n * 5 % 27).alias("lon0"), F.lit(29.92).alias("lat1"), F.lit(-110.21).alias("lon1"))
    return _r(S.transect(c.where("fhr = 1"), _grid(c), routes, 9, ["run"]))


TRANSECT_SQL = f"""
with {A.CELLS_SQL},
rt as (select n_nationkey::bigint as route_id, seq::int as seq, 26.03::double + n_nationkey * 7 % 8 as lat0, -123.07::double + n_nationkey * 5 % 27 as lon0 from nation, (select unnest(range(9)) as seq)),
pt as (select *, lat0 + seq / 8 * (29.92::double - lat0) as plat, lon0 + seq / 8 * (-110.21::double - lon0) as plon from rt),
places as (select distinct grid_index, lat, lon from cells),
near as (select route_id, seq, grid_index, {_SCORE} as score, row_number() over (partition by route_id, seq order by {_SCORE}, grid_index) as rank from pt join places on true)
select run, near.route_id, near.seq, round(sum(value / score) / nullif(sum(1 / score) filter (where value is not null), 0), 6) as value,
  round(any_value(2 * 6371.0088::double * asin(sqrt(sin(radians(plat - lat0) / 2) ** 2 + cos(radians(plat)) * cos(radians(lat0)) * sin(radians(plon - lon0) / 2) ** 2))), 6) as distance_km
from near join cells using (grid_index) join pt on pt.route_id = near.route_id and pt.seq = near.seq where rank <= 4 and fhr = 1 group by 1, 2, 3
"""


def polygon_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest values of every run and hour on an 8 x 8 matrix of each polygon's bounds, null outside the polygon."""
    c, poly = A.cells(spark, sf_dir), A.polygons(spark, sf_dir)
    box = poly.where("ring = 0").groupBy(F.col("poly_id").alias("area_id")).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    m = S.matrix_points(box, 8).withColumn("point_id", F.concat_ws(":", "area_id", "row", "col"))
    inside = m.join(P.polygon_shapes(poly).select(F.col("poly_id").alias("area_id"), "rings"), "area_id").select("point_id", P.in_polygon(F.col("plat"), F.col("plon"), F.col("rings")).alias("inside"))
    got = S.sample_nearest(c, _grid(c), m.select("point_id", "plat", "plon"), ["run", "fhr"])
    return _r(m.join(inside, "point_id").join(got, "point_id").select("run", "fhr", "area_id", "row", "col", F.when(F.col("inside"), F.col("value")).alias("value")).where("row between 1 and 6 and col between 1 and 6"))


POLYGON_MATRIX_SQL = f"""
with {A.CELLS_SQL}, {A.POLYGONS_SQL},
edges as (select p.poly_id, p.ring, p.lat as y1, p.lon as x1, q.lat as y0, q.lon as x0 from polygons p join polygons q on p.poly_id = q.poly_id and p.ring = q.ring and q.seq = (p.seq + 5) % 6),
box as (select poly_id as area_id, min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from polygons where ring = 0 group by 1),
pt as (select area_id, r as row, c as col, south + r / 7 * (north - south) as plat, west + c / 7 * (east - west) as plon from box, (values (1), (2), (3), (4), (5), (6)) as a(r), (values (1), (2), (3), (4), (5), (6)) as b(c)),
par as (select area_id, row, col, ring, count(*) % 2 as odd from pt join edges on area_id = poly_id and (y1 > plat) <> (y0 > plat) and plon < (x0 - x1) * (plat - y1) / (y0 - y1) + x1 group by 1, 2, 3, 4),
ins as (select area_id, row, col from par group by 1, 2, 3 having coalesce(max(odd) filter (where ring = 0), 0) = 1 and coalesce(max(odd) filter (where ring = 1), 0) = 0),
places as (select distinct grid_index, lat, lon from cells),
near as (select area_id, row, col, grid_index, row_number() over (partition by area_id, row, col order by {_SCORE}, grid_index) as rank from pt join places on true)
select run, fhr, area_id, row, col, round(case when (area_id, row, col) in (select (area_id, row, col) from ins) then value end, 6) as value from near join cells using (grid_index) where rank = 1
"""


def flash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time and flashes of each file, over flashes with a place, longitudes normalised."""
    from cumula.functions.wind import norm_lon

    f = A.flashes(spark, sf_dir).where("lat is not null").withColumn("lon", norm_lon(F.col("lon")))
    return _r(f.where(P.in_bounds(F.col("lat"), F.col("lon"), -125, -65, 22, 44)).groupBy("source_file").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("flashes"), F.sum("area_m2").alias("area"), F.min("lon").alias("west")))


FLASH_SUMMARY_SQL = f"""
with {A.FLASHES_SQL}, n as (select *, lon - 360 * floor((lon + 180) / 360) as l from flashes where lat between 22 and 44)
select source_file, min(ts) as first, max(ts) as last, count(*) as flashes, round(sum(area_m2), 6) as area, round(min(l), 6) as west from n where l between -125 and -65 group by 1
"""


def lon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest longitude arc of every six flashes, taken three times around."""
    f = A.flashes(spark, sf_dir).withColumn("lon", F.col("lon") * 3 + F.col("flash_id") % 5)
    return _r(R.lon_bounds(f.withColumn("g", F.floor(F.col("flash_id") / 6)), ["g"]))


LON_BOUNDS_SQL = f"""
with {A.FLASHES_SQL}, x as (select distinct flash_id // 6 as g, (lon * 3 + flash_id % 5) - 360 * floor((lon * 3 + flash_id % 5) / 360) as x from flashes),
gp as (select g, x, coalesce(lead(x) over (partition by g order by x), min(x) over (partition by g) + 360) as n from x),
b as (select *, row_number() over (partition by g order by n - x desc, x) as r from gp)
select g, round(case when n % 360 >= 180 then n % 360 - 360 else n % 360 end, 6) as west, round(case when x >= 180 then x - 360 else x end, 6) as east from b where r = 1
"""

QUERIES = {f.__name__: f for f in (area_summary, patch_stats, threshold_counts, threshold_field, raycast_members, compare_area, validate_native, field_summary_rounded, stats_by_mask, ratio_masks, grid_geometry, channel_stats, crop_rect, crop_extent, display_units, level_bins, nearest_sample, idw_sample, box_sample, transect, polygon_matrix, flash_summary, lon_bounds)}
ORACLES = {
    "area_summary": AREA_SUMMARY_SQL, "patch_stats": PATCH_STATS_SQL, "threshold_counts": THRESHOLD_COUNTS_SQL, "threshold_field": THRESHOLD_FIELD_SQL, "raycast_members": RAYCAST_MEMBERS_SQL,
    "compare_area": COMPARE_AREA_SQL, "validate_native": VALIDATE_NATIVE_SQL, "field_summary_rounded": FIELD_SUMMARY_SQL, "stats_by_mask": STATS_BY_MASK_SQL, "ratio_masks": RATIO_MASKS_SQL,
    "grid_geometry": GRID_GEOMETRY_SQL, "channel_stats": CHANNEL_STATS_SQL, "crop_rect": CROP_RECT_SQL, "crop_extent": CROP_EXTENT_SQL, "display_units": DISPLAY_UNITS_SQL, "level_bins": LEVEL_BINS_SQL,
    "nearest_sample": NEAREST_SAMPLE_SQL, "idw_sample": IDW_SAMPLE_SQL, "box_sample": BOX_SAMPLE_SQL, "transect": TRANSECT_SQL, "polygon_matrix": POLYGON_MATRIX_SQL, "flash_summary": FLASH_SUMMARY_SQL, "lon_bounds": LON_BOUNDS_SQL,
}
