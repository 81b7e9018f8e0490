"""Queries by names from the catalogues: point series, channels, derived recipes and direct products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import recipes as R
from cumula.operators import sampling as S
from cumula.plans.areas import NEAR_SQL, _r
from cumula.plans.scalars import heat_steps
from cumula.plans.stencils import DX, DY, _grad

KEYS = ["run", "grid_index"]


def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels whose lowest stands on the ground."""
    return A.levels(spark, sf_dir).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m")))


def point_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 18 variables of every run and hour at each point, with fallbacks where humidity, dewpoint or pressure lack, and what is missing.

    The series of a cell is worked out once; points take that of their nearest cell.
    """
    g = A.cells(spark, sf_dir)
    near = S.k_nearest(g.select("grid_index", "lat", "lon").distinct(), A.points(spark, sf_dir), 1).select("point_id", "grid_index")
    sfc = A.surface(spark, sf_dir).select(*KEYS, "t_c", "td_c", (F.col("rh") + 0.25).alias("rh"), "u", "v", "p_hpa", "orog_m")
    h = F.col("fhr")
    j = g.select(*KEYS, "fhr", "value").join(sfc, KEYS)
    j = j.withColumns(
        {
            "precip": F.col("value"), "gust": F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) * 1.4, "psfc_hpa": F.when(h != 3, F.col("p_hpa")), "mslp_hpa": F.when(h != 4, F.col("p_hpa") + F.col("orog_m") / 8),
            "rh": F.when(~h.isin(1, 2), F.col("rh")), "td_c": F.when(~h.isin(2, 5), F.col("td_c")), "cloud_low": F.col("rh"), "cloud_high": 100 - F.col("rh"),
        }
    )
    series = _r(R.point_series(j, KEYS).withColumn("missing", F.array_join("missing", ",")), 6)
    return series.join(near, "grid_index").select("run", "point_id", *series.columns[2:])


_ES = "6.112 * exp(17.67 * {0} / ({0} + 243.5))"
_SERIES_FIRE = heat_steps("w")
POINT_SERIES_SQL = f"""
with recursive {NEAR_SQL}, sf as (select run, grid_index, price % 4500 / 100 - 5 as t_c, (price % 4500 / 100 - 5) - (c % 23) * 0.7::double as td0, 850.0::double + k % 160 as ps, 5.25::double + (k * 7) % 96 as rh_in, c % 41 - 20.0::double as u, k % 37 - 18.0::double as v, ((k * 13) % 400) / 2.0::double as orog from grid),
j as materialized (select run, point_id, fhr, value as precip, t_c, case when fhr not in (2, 5) then td0 end as td1, case when fhr not in (1, 2) then greatest(0, least(100, rh_in)) end as rh1, rh_in, case when fhr <> 3 then ps end as ps1, case when fhr <> 4 then ps + orog / 8 end as msl, u, v, 0.0::double as q
  from near join cells using (grid_index) join sf using (run, grid_index) where rank = 1),
m as materialized (select *, coalesce(td1, 243.5 * ln({_ES.format("t_c")} * rh1 / 100 / 6.112) / (17.67 - ln({_ES.format("t_c")} * rh1 / 100 / 6.112))) as td, coalesce(ps1, msl) as p from j),
n as materialized (select *, coalesce(rh1, case when td is not null then greatest(0, least(100, 100 * ({_ES.format("td")}) / ({_ES.format("t_c")})))  end) as rh_out, least(100, 100 * ({_ES.format("td")}) / ({_ES.format("t_c")})) as rh, greatest({_ES.format("t_c")} - {_ES.format("td")}, 0) as deficit from m),
wet(p, t, td, lo, hi, i) as (
  select distinct p, t_c, td, least(t_c, td), t_c, 0 from n where p is not null and td is not null
  union all
  select p, t, td, case when high then lo else mid end, case when high then mid else hi end, i + 1 from (
    select *, 6.112 * exp(17.67 * mid / (mid + 243.5)) - 0.00066::double * (1 + 0.00115::double * mid) * p * (t - mid) > 6.112 * exp(17.67 * td / (td + 243.5)) as high from (select *, (lo + hi) / 2 as mid from wet where i < 40))),
w as (select n.*, (lo + hi) / 2 as wetbulb, p is not null and td is not null as whole from n left join (select p as wp, t as wt, td as wtd, lo, hi from wet where i = 40) on wp = p and wt = t_c and wtd = td),
{_SERIES_FIRE},
o as (select run, point_id, fhr, round(t_c, 6) as temperature_2m_c, round(td, 6) as dewpoint_2m_c, round(wetbulb, 6) as wetbulb_2m_c, round(rh_out, 6) as relative_humidity_2m_pct, u as wind_u_10m_ms, v as wind_v_10m_ms, round(sqrt(u * u + v * v), 6) as wind_speed_10m_ms,
  round((degrees(atan2(0.0 - u, 0.0 - v)) + 360) % 360, 6) as wind_direction_10m_deg, round(sqrt(u * u + v * v) * 1.4, 6) as wind_gust_10m_ms, round(precip, 6) as precip_accum_mm,
  round(greatest(0, case when fhr = 0 then precip else precip - lag(precip) over (partition by run, point_id order by fhr) end) + case when precip is null then null else 0 end, 6) as h0,
  lag(precip) over (partition by run, point_id order by fhr) is not null or fhr = 0 as had, round(rh_in, 6) as cloud_low_pct, null::double as cloud_middle_pct, round(100 - rh_in, 6) as cloud_high_pct, round(msl, 6) as mslp_hpa,
  round(case when whole then deficit end, 6) as vpd_2m_hpa, round(case when whole then deficit * sqrt(u * u + v * v) end, 6) as hdw, round(case when whole then greatest(0, least(100, 0.5 * fos + 0.5 * least(100, deficit * sqrt(u * u + v * v)))) end, 6) as fire_weather_composite from d),
f as (select * exclude (h0, had), case when had and precip_accum_mm is not null then h0 end as precip_hourly_mm from o)
select *, {{missing}} as missing from f
"""
POINT_SERIES_SQL = POINT_SERIES_SQL.replace("{missing}", "concat_ws(',', " + ", ".join(f"case when {n} is null then '{n}' end" for n in R.POINT_VARIABLES) + ")")

#: Channels that SQL can express: neither parcels nor helicity.
SQL_CHANNELS = [n for n in R.PRESETS["hybrid_column_v1"] if R.CHANNELS[n].kind != "heavy" and not n.startswith(("sb", "ml", "mu", "srh", "refc", "mslp"))]


def ml_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, mean and extremes of the channels of the column preset in every run, under what the catalogue says of them."""
    samples = R.build_samples(SQL_CHANNELS, KEYS, A.surface(spark, sf_dir), _ground(spark, sf_dir))
    got = samples.groupBy("run", "channel").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    catalog = F.broadcast(R.channel_catalog(spark)).withColumnRenamed("name", "channel")
    return _r(got.join(catalog, "channel").select("run", "channel", "canonical_name", "units", "level", "level_hpa", "height_m_agl", "kind", "n", "mean", "low", "high"), 4)


def _level_sql(hpa: int) -> str:
    at = lambda n: f"max(case when hit then case when p_hpa = {hpa} then {n} else {n} + f * ({n}1 - {n}) end end) as {n}{hpa}"
    return f"""lv{hpa} as (select run, grid_index, {", ".join(at(n) for n in ("t_c", "q", "z", "u", "v"))} from (
    select *, (p_hpa <= {hpa} and (p1 > {hpa} or (p_hpa = {hpa} and p1 is null))) as hit, ln({hpa}.0::double / p_hpa) / ln(p1 / p_hpa) as f from nx) group by 1, 2)"""


_NEXT = """lg as (select *, case when k = 0 then 0.0::double else z_m end as z from levels),
nx as (select run, grid_index, p_hpa, t_c, q, z, u, v, lead(p_hpa) over w as p1, lead(t_c) over w as t_c1, lead(q) over w as q1, lead(z) over w as z1, lead(u) over w as u1, lead(v) over w as v1 from lg window w as (partition by run, grid_index order by p_hpa)),
hx as (select run, grid_index, z, u, v, lead(z) over w as z1, lead(u) over w as u1, lead(v) over w as v1 from lg window w as (partition by run, grid_index order by z)),
kn as (select run, grid_index, sqrt((u1k - u0) ** 2 + (v1k - v0) ** 2) as shear01, sqrt((u6k - u0) ** 2 + (v6k - v0) ** 2) as shear06 from (select run, grid_index, """ + ", ".join(f"max(case when z <= {h} and z1 > {h} then {n} + ({h} - z) / (z1 - z) * ({n}1 - {n}) end) as {n}{name}" for n in "uv" for h, name in ((0, "0"), (1000, "1k"), (6000, "6k"))) + """ from hx group by 1, 2))"""
_MOIST = f"""
sm as (select *, 243.5 * ln(greatest(q * p_hpa / (0.622 + q), 1e-10) / 6.112) / (17.67 - ln(greatest(q * p_hpa / (0.622 + q), 1e-10) / 6.112)) as dew from {{source}}),
mo as (select * exclude (rh), least(100, 100 * ({_ES.format("dew")}) / ({_ES.format("t_c")})) as rh from sm)"""


def _channel_sql() -> str:
    rh = lambda p: f"case when q{p} is not null then least(100, 100 * greatest(q{p} * {p} / (0.622 + q{p}), 1e-10) / (6.112 * exp(17.67 * t_c{p} / (t_c{p} + 243.5)))) end"
    value = {"t2m": "t_c + 273.15", "d2m": "dew + 273.15", "q2m": "mo.q", "u10": "mo.u", "v10": "mo.v", "wind_speed": "sqrt(mo.u * mo.u + mo.v * mo.v)", "wind_direction": "(degrees(atan2(0.0 - mo.u, 0.0 - mo.v)) + 360) % 360", "relative_humidity": "rh", "terrain": "orog_m", "shear06": "shear06 / 0.51444"}
    for p in (925, 850, 700):
        value |= {f"t{p}": f"t_c{p} + 273.15", f"rh{p}": rh(p), f"z{p}": f"z{p}", f"u{p}": f"u{p}", f"v{p}": f"v{p}"}
    rows = ", ".join(f"('{n}', '{n}', '{R.CHANNELS[n].units}', '{R.CHANNELS[n].level}', {R.CHANNELS[n].level.split()[0] + '.0::double' if 'hPa' in R.CHANNELS[n].level else 'null::double'}, {10.0 if n in ('u10', 'v10', 'wind_speed', 'wind_direction') else 2.0 if n in ('t2m', 'd2m', 'q2m', 'relative_humidity') else 'null'}::double, '{R.CHANNELS[n].kind}')" for n in SQL_CHANNELS)
    wide = ", ".join(f"({value[n]})::double as {n}" for n in SQL_CHANNELS)
    moist = _MOIST.replace("{source}", "surface")
    surface = A.SURFACE_SQL.split(A.GRID_SQL + ",", 1)[1]
    return f"""
with {A.LEVELS_SQL}, {surface}, {moist}, {_NEXT}, {", ".join(_level_sql(p) for p in (925, 850, 700))},
wide as (select mo.run, mo.grid_index, {wide} from mo left join kn using (run, grid_index) left join lv925 using (run, grid_index) left join lv850 using (run, grid_index) left join lv700 using (run, grid_index)),
long as (unpivot wide on columns(* exclude (run, grid_index)) into name channel value value),
cat(channel, canonical_name, units, level, level_hpa, height_m_agl, kind) as (values {rows})
select run, channel, canonical_name, units, level, level_hpa, height_m_agl, kind, count(value) as n, round(avg(value), 4) as mean, round(min(value), 4) as low, round(max(value), 4) as high from long join cat using (channel) group by all
"""


ML_CHANNELS_SQL = _channel_sql()

#: Derived recipes that SQL can express.
SQL_RECIPES = ["theta_e_2m_10m_winds", "vpd_2m", "dewpoint_depression_2m", "fire_weather_composite", "apparent_temperature_2m", "heat_index_2m", "wind_chill_2m", "bulk_shear_0_1km", "bulk_shear_0_6km", "temperature_advection_700mb", "temperature_advection_850mb"]


def recipe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven derived fields of every cell from the three passes they need."""
    return _r(R.make_fields(SQL_RECIPES, KEYS, A.surface(spark, sf_dir), _ground(spark, sf_dir), spacing=(DX, DY)), 4)


_SURFACE_ONLY = A.SURFACE_SQL.split(A.GRID_SQL + ",", 1)[1]
RECIPE_FIELDS_SQL = f"""
with {A.LEVELS_SQL}, {_SURFACE_ONLY}, {_MOIST.replace("{source}", "surface")}, {_NEXT}, {_level_sql(850)}, {_level_sql(700)},
{heat_steps("mo")},
te as (select *, 0.622 * ({_ES.format("dew")}) / greatest(p_hpa - ({_ES.format("dew")}), 1e-6) as r, 1 / (1 / (dew + 273.15 - 56) + ln((t_c + 273.15) / (dew + 273.15)) / 800) + 56 as tl from d),
""" + ", ".join(
    f"x{p} as (select run, grid_index, y, x, t_c{p} as t, u{p} as u, v{p} as v from lv{p} join surface using (run, grid_index)), a{p} as (select run, grid_index, -(u * gx + v * gy) * 3600 as adv from ({_grad('t', f'x{p}', 'run, grid_index, u, v')}))"
    for p in (700, 850)
) + f"""
select te.run, te.grid_index, round((t_c + 273.15) * (1000 / p_hpa) ** (0.2854 * (1 - 0.28 * r)) * exp((3.376 / tl - 0.00254) * 1000 * r * (1 + 0.81 * r)), 4) as theta_e_2m_10m_winds, round(greatest(({_ES.format("t_c")}) - ({_ES.format("dew")}), 0), 4) as vpd_2m, round(greatest(t_c - dew, 0), 4) as dewpoint_depression_2m,
  round(greatest(0, least(100, 0.5 * fos + 0.5 * least(100, vpd * ws))), 4) as fire_weather_composite, round(case when t_c >= (80.0::double - 32) / 1.8 then hi else wc end, 4) as apparent_temperature_2m, round(hi, 4) as heat_index_2m, round(wc, 4) as wind_chill_2m, round(shear01, 4) as bulk_shear_0_1km, round(shear06, 4) as bulk_shear_0_6km, round(a700.adv, 4) as temperature_advection_700mb, round(a850.adv, 4) as temperature_advection_850mb
from te left join kn using (run, grid_index) left join a700 using (run, grid_index) left join a850 using (run, grid_index)
"""

ASKED = [*R.DERIVED, *R.BLOCKED, "no_such_recipe"]


def recipe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived name with the values that each run can give of it from its surface alone, or the reason why it cannot."""
    surface = A.surface(spark, sf_dir)
    plan = R.Planner(R.DERIVED, surface.columns)
    why = {n: plan.reason(n) for n in ASKED}
    made = R.make_fields([n for n, r in why.items() if r is None], KEYS, surface)
    counts = made.groupBy("run").agg(*(F.count(n).alias(n) for n in made.columns[2:]))
    entries = F.array(*(F.struct(F.lit(n).alias("name"), (F.col(n) if r is None else F.lit(0)).cast("long").alias("n"), F.lit(r).cast("string").alias("reason")) for n, r in why.items()))
    return counts.select("run", F.inline(entries))




def _status_sql() -> str:
    rows = []
    for n in ASKED:
        if n in ("stp_effective", "scp", "scp_effective"):
            why = "'needs an effective inflow layer'"
        elif n == "no_such_recipe":
            why = "'unknown'"
        elif n.endswith(("_2m", "_winds")) or n == "fire_weather_composite":
            why = "null"
        elif n.startswith(("bulk_shear", "srh")):
            why = "'no level column u'"
        else:
            why = "'no level column p_hpa'"
        rows.append(f"('{n}', {why})")
    return f"""
with {A.SURFACE_SQL}, runs as (select run, count(*) as cells, count(q) as whole from surface group by 1), names(name, reason) as (values {", ".join(rows)})
select run, name, case when reason is null then whole else 0 end::bigint as n, reason::varchar as reason from runs, names
"""


RECIPE_STATUS_SQL = _status_sql()
DIRECT_ASKED = [*R.DIRECT, "no_such_product"]


def direct_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every direct product by run and part, from fields near the ground and at the pressures of the levels; what lacks a part has a reason."""
    s, lv = A.surface(spark, sf_dir), A.levels(spark, sf_dir)
    long = lambda df, level, parts: df.select("run", "grid_index", level.alias("level"), F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.col(v).cast("double").alias("value")) for k, v in parts.items()))))
    fields = long(s, F.lit("2m"), {"t": "t_c", "td": "td_c", "rh": "rh"}).unionByName(long(s, F.lit("10m"), {"u": "u", "v": "v"}))
    fields = fields.unionByName(long(lv, F.concat(F.array(*(F.lit(p) for p in (1000, 850, 700, 600, 500, 400, 300, 250)))[F.col("k").cast("int")].cast("string"), F.lit("mb")), {"t": "t_c", "z": "z_m", "u": "u", "v": "v"}))
    got = R.direct_fields(fields, DIRECT_ASKED)
    return _r(got.groupBy("slug", "run", "part", "field", "level", "reason").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), 5)


def _direct_sql() -> str:
    asked = ", ".join(f"('{s}', {i}, '{f}', '{lv}')" for s in R.DIRECT for i, (f, lv) in enumerate(R.DIRECT[s]))
    return f"""
with {A.LEVELS_SQL}, {_SURFACE_ONLY}, asked(slug, part, field, level) as (values {asked}, ('no_such_product', 0, null, null)),
fields as (
  select run, '2m' as level, unnest(['t', 'td', 'rh']) as field, unnest([t_c, td_c, rh]) as value from surface
  union all select run, '10m', unnest(['u', 'v']), unnest([u, v]) from surface
  union all select run, [1000, 850, 700, 600, 500, 400, 300, 250][k + 1] || 'mb', unnest(['t', 'z', 'u', 'v']), unnest([t_c, z_m, u, v]) from levels),
there as (select distinct field, level from fields),
lost as (select slug, arg_min(case when a.field is null then 'unknown' else 'no ' || a.field || ' at ' || a.level end, part) as reason from asked a left join there t on a.field = t.field and a.level = t.level where t.field is null group by 1)
select slug, run, part::int as part, field, level, null::varchar as reason, count(value) as n, round(avg(value), 5) as mean from asked join fields using (field, level) where slug not in (select slug from lost) group by all
union all select slug, null, null, null, null, reason, 0, null from lost
"""


DIRECT_PRODUCTS_SQL = _direct_sql()

QUERIES = {f.__name__: f for f in (point_series, ml_channels, recipe_fields, recipe_status, direct_products)}
ORACLES = {"point_series": POINT_SERIES_SQL, "ml_channels": ML_CHANNELS_SQL, "recipe_fields": RECIPE_FIELDS_SQL, "recipe_status": RECIPE_STATUS_SQL, "direct_products": DIRECT_PRODUCTS_SQL}
