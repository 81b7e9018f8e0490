"""Queries over radar gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import cells as C
from cumula.operators import dealias as D
from cumula.operators import radar as R
from cumula.plans.areas import _r

_BEAM = "(sqrt(range_km * range_km + 8495.0::double * 8495 + 2 * range_km * 8495 * sin(radians(elev))) - 8495)"


def radar_vil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.vil(A.gates(spark, sf_dir)))


RADAR_VIL_SQL = f"""
with {A.GATES_SQL}, h as (select *, {_BEAM} as h, 10 ** (dbz / 10) as z from gates where dbz >= 0), l as (select *, lead(h) over w as h1, lead(z) over w as z1 from h window w as (partition by volume, az, gate order by elev))
select volume, az, gate, round(least(80, coalesce(sum(case when h1 > h then 3.44e-6 * ((z + z1) / 2) ** (4.0::double / 7) * (h1 - h) * 1000 end), 0)), 6) as vil from l group by 1, 2, 3
"""


def radar_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echo tops at 45 dBZ and the column's greatest reflectivity."""
    g = A.gates(spark, sf_dir)
    return _r(R.column_composite(g).join(R.echo_tops(g, 45.0), ["volume", "az", "gate"], "left"))


RADAR_TOPS_SQL = f"""
with {A.GATES_SQL} select volume, az, gate, round(max(dbz), 6) as dbz, round(max({_BEAM}) filter (where dbz >= 45), 6) as top_km from gates group by 1, 2, 3
"""


def radar_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm motion of each volume."""
    return _r(R.storm_motion(A.gates(spark, sf_dir)), 5)


_MOTION = """
m as (select volume, elev, sum(vel * sin(radians(az)) * range_km) / sum(range_km) as u, sum(vel * cos(radians(az)) * range_km) / sum(range_km) as v from gates where range_km between 20 and 100 group by 1, 2),
o as (select *, row_number() over (partition by volume order by elev) as i, count(*) over (partition by volume) as n from m),
g as (select volume, any_value(n) as n, avg(u) as mu, avg(v) as mv, avg(u) filter (where i <= greatest(n // 3, 1)) as lu, avg(v) filter (where i <= greatest(n // 3, 1)) as lv, avg(u) filter (where i > n - greatest(n // 3, 1)) as hu, avg(v) filter (where i > n - greatest(n // 3, 1)) as hv,
  max(u) filter (where i = 1) as fu, max(v) filter (where i = 1) as fv from o group by 1),
s as (select *, sqrt((hu - lu) ** 2 + (hv - lv) ** 2) as s from g),
k as (select volume, case when n >= 3 and s > 0.5 then mu + 7.5 * (hv - lv) / s else fu end as u, case when n >= 3 and s > 0.5 then mv - 7.5 * (hu - lu) / s else fv end as v from s),
motion as (select volume, (degrees(atan2(u, v)) + 540) % 360 as dir_from, sqrt(u * u + v * v) / 0.51444 as speed_kt from k)
"""
RADAR_MOTION_SQL = f"with {A.GATES_SQL}, {_MOTION} select volume, round(dir_from, 5) as dir_from, round(speed_kt, 5) as speed_kt from motion"


def radar_srv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm-relative velocities, summed up by sweep."""
    g = A.gates(spark, sf_dir)
    s = R.storm_relative(g, R.storm_motion(g))
    return _r(s.groupBy("volume", "sweep").agg(F.min("srv").alias("min"), F.max("srv").alias("max"), F.avg("srv").alias("mean")), 5)


RADAR_SRV_SQL = f"""
with {A.GATES_SQL}, {_MOTION}, x as (select volume, sweep, vel + speed_kt * 0.51444 * (sin(radians(dir_from)) * sin(radians(az)) + cos(radians(dir_from)) * cos(radians(az))) as srv from gates join motion using (volume))
select volume, sweep, round(min(srv), 5) as min, round(max(srv), 5) as max, round(avg(srv), 5) as mean from x group by 1, 2
"""


def shear_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation candidates between radials four degrees apart."""
    return _r(R.shear_candidates(A.gates(spark, sf_dir), max_gap=4.0))


_SHEAR = """
w as (select * from gates union all select volume, sweep, elev, az + 360, gate, range_km, dbz, vel from gates where az < 5),
l as (select *, lead(az) over x as az1, lead(vel) over x as vel1 from w window x as (partition by volume, sweep, gate order by az)),
d as (select *, vel1 - vel as d0 from l where az < 360 and az1 - az <= 4),
f as (select *, case when d0 > 30 then d0 - 60 * ceil((d0 - 30) / 60) when d0 < -30 then d0 + 60 * ceil((-30 - d0) / 60) else d0 end as d from d),
cand as (select volume, sweep, elev, gate, range_km, az, abs(d) as dv, abs(d) / (range_km * 1000 * radians(az1 - az)) as shear, sign(d) as sense from f where (abs(vel) >= 1 or abs(vel1) >= 1) and abs(d) >= 10 and abs(d) / (range_km * 1000 * radians(az1 - az)) >= 0.004)
"""
SHEAR_CANDIDATES_SQL = f"with {A.GATES_SQL}, {_SHEAR} select volume, sweep, round(elev, 6) as elev, gate, range_km, az, round(dv, 6) as dv, round(shear, 6) as shear, sense::double as sense from cand"


def mesocyclones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of rotation candidates of each sweep."""
    c = R.shear_candidates(A.gates(spark, sf_dir), max_gap=4.0)
    return _r(R.meso_clusters(R.candidate_components(c, 4.0)), 5)


MESOCYCLONES_SQL = f"""
with recursive {A.GATES_SQL}, {_SHEAR},
c as materialized (select *, az // 4 * 10000 + gate as id from cand),
nb as materialized (select a.volume, a.sweep, a.id as a, b.id as b from c a join c b on a.volume = b.volume and a.sweep = b.sweep and a.id <> b.id and abs(a.gate - b.gate) <= 2 and least(abs(a.az - b.az), 360 - abs(a.az - b.az)) <= 8),
lab(volume, sweep, n, label) as (select volume, sweep, id, id from c union select nb.volume, nb.sweep, nb.b, lab.label from lab join nb on nb.volume = lab.volume and nb.sweep = lab.sweep and nb.a = lab.n and lab.label < nb.b),
best as (select volume, sweep, n as id, min(label) as label from lab group by 1, 2, 3),
g as (select volume, sweep, elev, label, count(*) as n, avg(sin(radians(az))) as s, avg(cos(radians(az))) as co, avg(range_km) as range_km, max(shear) as shear, max(dv) as dv, sum(sense) as vote, max(range_km) - min(range_km) as depth from c join best using (volume, sweep, id) group by 1, 2, 3, 4 having count(*) >= 4)
select volume, sweep, round(elev, 5) as elev, label, n, round((degrees(atan2(s, co)) + 360) % 360, 5) as az, round(range_km, 5) as range_km, round(shear, 5) as shear, round(dv, 5) as dv, case when vote >= 0 then 'cyclonic' else 'anticyclonic' end as sense, round(greatest(1, least(20, depth)), 5) as diameter_km,
  case when shear >= 0.012 then 'strong' when shear >= 0.008 then 'moderate' else 'weak' end as strength from g
"""


def tvs_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences along radials of the lowest tilts over the threshold of their middle."""
    return _r(R.tvs_candidates(A.gates(spark, sf_dir)))


_FOLDED = "abs(case when d > 30 then d - 60 * ceil((d - 30) / 60) when d < -30 then d + 60 * ceil((-30 - d) / 60) else d end)"
_TVS = f"""
t as (select *, dense_rank() over (partition by volume order by elev) as t from gates),
pr as (select a.volume, a.sweep, a.elev, a.az, a.gate, (b.gate - a.gate)::int as gap, (a.range_km + b.range_km) / 2 as range_km, b.range_km - a.range_km as apart, b.vel - a.vel as d from t a join t b on a.volume = b.volume and a.sweep = b.sweep and a.az = b.az and b.gate - a.gate between 1 and 3 and a.t <= 3),
tvs as (select volume, sweep, elev, az, gate, gap, range_km, {_FOLDED} as dv, {_FOLDED} / apart as shear from pr where range_km between 2 and 100 and {_FOLDED} >= 30 - 10 * least(1, range_km / 100))
"""
TVS_CANDIDATES_SQL = f"with {A.GATES_SQL}, {_TVS} select volume, sweep, round(elev, 6) as elev, az, gate, gap, range_km, round(dv, 6) as dv, round(shear, 6) as shear from tvs"


def high_z_hail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong echo aloft by volume and sweep, with every range three times as far."""
    g = A.gates(spark, sf_dir).withColumn("range_km", F.col("range_km") * 3)
    return _r(R.high_z_hail(g).groupBy("volume", "sweep").agg(F.count("*").alias("n"), F.max("height_km").alias("top"), F.avg("dbz").alias("dbz")), 5)


HIGH_Z_HAIL_SQL = f"""
with {A.GATES_SQL}, g as (select volume, sweep, elev, range_km * 3 as range_km, dbz, min(elev) over (partition by volume) as low from gates), h as (select *, {_BEAM} as h from g)
select volume, sweep, count(*) as n, round(max(h), 5) as top, round(avg(dbz), 5) as dbz from h where dbz >= 50 and h >= 3 and range_km between 5 and 200 and elev > low group by 1, 2
"""


def tbss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.tbss(A.gates(spark, sf_dir), 55.0))


TBSS_SQL = f"""
with {A.GATES_SQL}, f as (select *, count(*) filter (where dbz between 10 and 30) over (partition by volume, sweep, az order by range_km range between 8 following and 35 following) as flare,
  min(dbz) over (partition by volume, sweep, az order by range_km range between 1 following and 8 following) as gap from gates)
select volume, sweep, az, gate, range_km, dbz, flare from f where dbz >= 55 and flare >= 5 and gap < 40
"""


def _dual(g: DataFrame) -> DataFrame:
    return g.withColumns({"zdr": (F.col("gate") * 7 % 40 - 20) / 10, "cc": 0.5 + (F.col("az") * 3 + F.col("gate") * 11) % 45 / 100})


def tds_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debris candidates with two derived moments, the best of each volume, none near a better one."""
    c = R.tds_candidates(_dual(A.gates(spark, sf_dir)))
    best = c.groupBy("volume", "az", "gate", "range_km").agg(F.round(F.max("score"), 9).alias("score"))
    return _r(R.suppress(best, ["volume"]))


TDS_CANDIDATES_SQL = f"""
with recursive {A.GATES_SQL}, d as (select *, (gate * 7 % 40 - 20) / 10.0::double as zdr, 0.5::double + (az * 3 + gate * 11) % 45 / 100.0::double as cc from gates),
c as (select volume, az, gate, range_km, round(max((dbz - 40) * 0.02::double + (0.82::double - cc) * 2 - abs(zdr) * 0.1::double), 9) as score from d
  where gate % 2 = 0 and range_km between 15 and 120 and dbz >= 40 and abs(zdr) <= 1.25 and cc between 0.55::double and 0.82::double group by 1, 2, 3, 4),
o as materialized (select *, row_number() over (partition by volume order by score desc, az, gate) as i from c),
f(volume, i, kept) as (
  select distinct volume, 0::bigint, []::struct(az bigint, gate bigint, range_km double, score double)[] from o
  union all
  select f.volume, o.i, case when len(f.kept) >= 64 or len(list_filter(f.kept, lambda y: least(abs(y.az - o.az), 360 - abs(y.az - o.az)) < 3 and abs(y.range_km - o.range_km) < 3)) > 0
    then f.kept else list_append(f.kept, {{'az': o.az::bigint, 'gate': o.gate::bigint, 'range_km': o.range_km::double, 'score': o.score::double}}) end
  from f join o on o.volume = f.volume and o.i = f.i + 1),
l as (select volume, arg_max(kept, i) as kept from f group by 1), u as (select volume, kept, unnest(range(1, len(kept) + 1)) as rank from l)
select volume, rank::int as rank, kept[rank].az as az, kept[rank].gate as gate, kept[rank].range_km as range_km, round(kept[rank].score, 6) as score from u
"""


def tds_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.tds_candidates(_dual(A.gates(spark, sf_dir)))
    return _r(c.groupBy("volume", "sweep").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean")))


TDS_SCORES_SQL = f"""
with {A.GATES_SQL}, d as (select *, (gate * 7 % 40 - 20) / 10.0::double as zdr, 0.5::double + (az * 3 + gate * 11) % 45 / 100.0::double as cc from gates),
c as (select *, (dbz - 40) * 0.02::double + (0.82::double - cc) * 2 - abs(zdr) * 0.1::double as score from d where gate % 2 = 0 and range_km between 15 and 120 and dbz >= 40 and abs(zdr) <= 1.25 and cc between 0.55::double and 0.82::double)
select volume, sweep, count(*) as n, round(max(score), 6) as best, round(avg(score), 6) as mean from c group by 1, 2
"""


def storm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of strong gates on the lowest sweep."""
    return _r(R.storm_cores(A.gates(spark, sf_dir), 60.0, 4.0, 4), 5)


STORM_CELLS_SQL = f"""
with recursive {A.GATES_SQL},
c as materialized (select *, az // 4 * 10000 + gate as id from (select *, min(elev) over (partition by volume) as l from gates) where elev = l and dbz >= 60 and range_km between 10 and 230),
nb as materialized (select a.volume, a.id as a, b.id as b from c a join c b on a.volume = b.volume and a.id <> b.id and abs(a.gate - b.gate) <= 3 and least(abs(a.az - b.az), 360 - abs(a.az - b.az)) <= 4),
lab(volume, n, label) as (select volume, id, id from c union select nb.volume, nb.b, lab.label from lab join nb on nb.volume = lab.volume and nb.a = lab.n and lab.label < nb.b),
best as (select volume, n as id, min(label) as label from lab group by 1, 2),
m as (select *, dbz * dbz as w from c join best using (volume, id)),
g as (select volume, label, count(*) as gates, max(dbz) as max_dbz, avg(dbz) as mean_dbz, sum(range_km * w) / sum(w) as range_km, (degrees(atan2(sum(sin(radians(az)) * w), sum(cos(radians(az)) * w))) + 360) % 360 as az, max(range_km) - min(range_km) as depth_km from m group by 1, 2)
select volume, label, gates, max_dbz, round(mean_dbz, 5) as mean_dbz, round(range_km, 5) as range_km, round(az, 5) as az, depth_km, row_number() over (partition by volume order by max_dbz desc, label)::int as rank from g where gates >= (case when range_km > 150 then 8 else 4 end)
"""


def meso_reflectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectivity at every shear candidate's place, from the sweep of nearest elevation."""
    g = A.gates(spark, sf_dir)
    c = R.shear_candidates(g, max_gap=4.0)
    d = c.select("volume", (F.col("sweep") * 10_000_000 + F.col("az") * 10_000 + F.col("gate")).alias("det"), "elev", "az", "range_km")
    return _r(R.lookup_reflectivity(d, g, 4.0))


MESO_REFLECTIVITY_SQL = f"""
with {A.GATES_SQL}, {_SHEAR}, j as (select c.volume, c.sweep * 10000000 + c.az * 10000 + c.gate as det, c.elev, c.az, c.range_km, g.dbz, row_number() over (partition by c.volume, c.sweep, c.az, c.gate order by abs(g.elev - c.elev), g.elev) as r from cand c left join gates g on g.volume = c.volume and g.az = c.az and g.gate = c.gate)
select volume, det, round(elev, 6) as elev, az, range_km, round(dbz, 6) as dbz from j where r = 1
"""


def radar_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory of each volume and the size and valid values of its tensor."""
    g = A.gates(spark, sf_dir)
    t = R.polar_tensor(g, 100).select("volume", F.col("radials").alias("tensor_radials"), F.size("data").alias("tensor_size"), F.size(F.array_compact("data")).alias("tensor_valid"))
    return R.volume_inventory(g).join(t, "volume")


RADAR_INVENTORY_SQL = f"""
with {A.GATES_SQL}, t as (select volume, count(distinct az)::int as tensor_radials, (count(distinct az) * 100)::int as tensor_size, count(dbz)::int as tensor_valid from (select *, min(elev) over (partition by volume) as l from gates) where elev = l group by 1)
select volume, count(distinct sweep) as sweeps, count(distinct sweep * 1000 + az) as radials, count(*) as gates, count(dbz) as with_dbz, count(vel) as with_vel, string_agg(distinct printf('%.1f', elev), ',' order by printf('%.1f', elev)) as elevations, tensor_radials, tensor_size, tensor_valid from gates join t using (volume) group by volume, tensor_radials, tensor_size, tensor_valid
"""


def dealias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfolded velocities of all sweeps, each by its own Nyquist velocity."""
    g = A.gates(spark, sf_dir).select("volume", "sweep", "az", "gate", "vel")
    return D.dealias_sweeps(g.withColumn("nyquist", 14.0 + 3 * F.col("sweep") + F.col("volume") % 3), "nyquist").drop("nyquist")


def cell_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm cells of every volume by falling thresholds."""
    return _r(C.cell_cascade(A.gates(spark, sf_dir), 4.0, 4.0), 5)


def tvs_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate-to-gate differences across and along radials with echo, over their range's threshold."""
    return _r(R.tvs_detections(A.gates(spark, sf_dir), 4.0).drop("det"))


TVS_DETECTIONS_SQL = f"""
with {A.GATES_SQL}, {_TVS}, low as (select * from t where t <= 3 and range_km between 2 and 100), wr as (select * from low union all select volume, sweep, elev, az + 360, gate, range_km, dbz, vel, t from low where az < 4),
l as (select *, lead(az) over w - az as turn, lead(vel) over w - vel as d from wr window w as (partition by volume, sweep, gate order by az)),
ac as (select volume, sweep, elev, (az + turn / 2) % 360 as az, gate, 0 as gap, range_km, {_FOLDED} as dv, {_FOLDED} / (range_km * radians(turn)) as shear, 'azimuthal' as kind from l where az < 360 and turn <= 6 and {_FOLDED} >= 30 - 10 * least(1, range_km / 100)),
c as (select * from ac union all select volume, sweep, elev, az::double, gate, gap, range_km, dv, shear, 'radial' from tvs),
z as (select c.*, g.dbz, row_number() over (partition by c.volume, c.kind, c.sweep, c.az, c.gate, c.gap order by abs(g.elev - c.elev), g.elev) as r from c join gates g on g.volume = c.volume and g.az = (round(c.az / 4)::bigint * 4) % 360 and g.gate = round(c.range_km - 2)::bigint)
select volume, sweep, round(elev, 6) as elev, az, gate, gap, range_km, round(dv, 6) as dv, round(shear, 6) as shear, kind from z where r = 1 and dbz >= 30
"""


def mesocyclone_tilts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation found on two tilts or more of one place, one row a detection."""
    return _r(R.mesocyclone_tilts(A.gates(spark, sf_dir), 4.0, least=2), 5)


_MESO = """
c as materialized (select *, az // 4 * 10000 + gate as id from cand),
nb as materialized (select a.volume, a.sweep, a.id as a, b.id as b from c a join c b on a.volume = b.volume and a.sweep = b.sweep and a.id <> b.id and abs(a.gate - b.gate) <= 2 and least(abs(a.az - b.az), 360 - abs(a.az - b.az)) <= 8),
lab(volume, sweep, n, label) as (select volume, sweep, id, id from c union select nb.volume, nb.sweep, nb.b, lab.label from lab join nb on nb.volume = lab.volume and nb.sweep = lab.sweep and nb.a = lab.n and lab.label < nb.b),
best as (select volume, sweep, n as id, min(label) as label from lab group by 1, 2, 3),
meso as (select volume, sweep, elev, label, count(*) as n, (degrees(atan2(avg(sin(radians(az))), avg(cos(radians(az))))) + 360) % 360 as az, avg(range_km) as range_km, max(shear) as shear, max(dv) as dv, sum(sense) as vote, greatest(1, least(20, max(range_km) - min(range_km))) as diameter_km from c join best using (volume, sweep, id) group by 1, 2, 3, 4)
"""
#: Clusters of two candidates or more with echo, folded over the tilts from the lowest up.
MESOCYCLONE_TILTS_SQL = f"""
with recursive {A.GATES_SQL}, {_SHEAR}, {_MESO},
tl as (select distinct volume, sweep, dense_rank() over (partition by volume order by elev)::int as tilt from gates),
z as (select m.*, g.dbz, row_number() over (partition by m.volume, m.sweep, m.label order by abs(g.elev - m.elev), g.elev) as r from meso m join gates g on g.volume = m.volume and g.az = (round(round(m.az, 9) / 4)::bigint * 4) % 360 and g.gate = round(round(m.range_km - 2, 9))::bigint where n >= 2),
o as materialized (select *, row_number() over (partition by volume order by tilt, det, x, y) as i from (
  select z.* exclude (r), tilt, sweep || ':' || label as det, range_km * sin(radians(az)) as x, range_km * cos(radians(az)) as y from z join tl using (volume, sweep) where r = 1 and dbz >= 20)),
fo(volume, i, acc) as (
  select distinct volume, 0::bigint, []::struct(x double, y double, tilts int[], dets varchar[])[] from o
  union all
  select volume, i, case when spot > 0 then list_transform(acc, lambda g, k: case when k = spot then {{'x': g.x, 'y': g.y, 'tilts': list_append(g.tilts, tilt), 'dets': list_append(g.dets, det)}} else g end)
    else list_append(acc, {{'x': x, 'y': y, 'tilts': [tilt], 'dets': [det]}}) end
  from (select fo.volume, o.i, fo.acc, o.tilt, o.det, o.x, o.y, coalesce(list_position(list_transform(fo.acc, lambda g: sqrt((g.x - o.x) ** 2 + (g.y - o.y) ** 2) < 10 and not list_contains(g.tilts, o.tilt)), true), 0) as spot from fo join o on o.volume = fo.volume and o.i = fo.i + 1)),
gr as (select volume, unnest(arg_max(acc, i)) as g from fo group by 1),
me as (select volume, g.dets[1] as first, len(g.tilts)::int as tilts, unnest(g.dets) as det from gr where len(g.tilts) >= 2),
j as (select me.first, me.tilts, o.*, row_number() over (partition by o.volume, me.first order by shear desc, tilt, o.det) as b from me join o using (volume, det))
select volume, tilts, first as det, round(max(az) filter (where det = first), 5) as az, round(max(range_km) filter (where det = first), 5) as range_km, round(max(shear) filter (where b = 1), 5) as shear, round(max(dv) filter (where b = 1), 5) as dv,
  max(case when shear >= 0.012 then 'strong' when shear >= 0.008 then 'moderate' else 'weak' end) filter (where b = 1) as strength, max(case when vote >= 0 then 'cyclonic' else 'anticyclonic' end) filter (where b = 1) as sense, round(max(diameter_km) filter (where b = 1), 5) as diameter_km, round(max({_BEAM}) filter (where det = first), 5) as base_km
from j group by volume, first, tilts
"""


def _listed(name: str, columns: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_join(F.transform(name, lambda s: F.concat_ws(":", *(s[c].cast("string") for c in columns))), ";"), F.lit("")).alias(name)


def volume_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections of each volume in one row: cells, rotations with their nearest cell, strongest differences and strongest hail."""
    g = A.gates(spark, sf_dir)
    cells = R.storm_cores(g, 60.0, 4.0, 4)
    meso = R.meso_clusters(R.candidate_components(R.shear_candidates(g, max_gap=4.0), 4.0)).withColumn("id", F.col("sweep") * 10_000_000 + F.col("label"))
    tied = R.associate(meso.select("volume", F.col("id").alias("det"), "az", "range_km"), cells, 20.0)
    tvs = R.tvs_candidates(g).withColumn("id", F.col("sweep") * 100_000_000 + F.col("az") * 100_000 + F.col("gate") * 10 + F.col("gap"))
    hail = R.high_z_hail(g).withColumn("id", F.col("sweep") * 10_000_000 + F.col("az") * 10_000 + F.col("gate"))
    columns = {"cells": ("rank", "max_dbz", "gates"), "rotations": ("det", "cell"), "tvs": ("id", "dv", "members"), "hail": ("id", "dbz", "members")}
    own = {"cells": cells, "rotations": tied, "tvs": R.keep_strongest(tvs, ["volume"], 2.0, 3.0, "dv"), "hail": R.keep_strongest(hail, ["volume"], 5.0, 5.0, "dbz")}
    frame = R.volume_frame(**{k: d.select("volume", *columns[k]) for k, d in own.items()})
    return frame.select("volume", *(_listed(k, c) for k, c in columns.items()))


#: Cells and hail by recursive labels; differences lie on one radial when they are under two degrees apart, so there their chains are islands.
VOLUME_FRAMES_SQL = f"""
with recursive {A.GATES_SQL}, {_SHEAR}, {_MESO}, {_TVS},
cells as materialized ({STORM_CELLS_SQL}),
cl as (select volume, string_agg(rank || ':' || max_dbz || ':' || gates, ';' order by rank, max_dbz, gates) as cells from cells group by 1),
rt as (select m.volume, m.sweep * 10000000 + m.label as det, sqrt((m.range_km * sin(radians(m.az)) - c.range_km * sin(radians(c.az))) ** 2 + (m.range_km * cos(radians(m.az)) - c.range_km * cos(radians(c.az))) ** 2) as km, c.rank from meso m left join cells c using (volume) where m.n >= 4),
rd as (select volume, det, coalesce(arg_min(rank, km) filter (where km <= 20), 0) as cell from rt group by 1, 2),
ro as (select volume, string_agg(det || ':' || cell, ';' order by det, cell) as rotations from rd group by 1),
ti as (select *, sweep * 100000000 + az * 100000 + gate * 10 + gap as id, case when range_km - lag(range_km) over (partition by volume, az order by range_km) < 3 then 0 else 1 end as fresh from tvs),
tg as (select *, sum(fresh) over (partition by volume, az order by range_km rows unbounded preceding) as island from ti),
tk as (select volume, id, dv, count(*) over w as members, row_number() over (w order by dv desc, id) as r from tg window w as (partition by volume, az, island)),
tv as (select volume, string_agg(id || ':' || dv || ':' || members, ';' order by id) as tvs from tk where r = 1 group by 1),
h0 as (select *, min(elev) over (partition by volume) as lowest, {_BEAM} as h from gates),
h as materialized (select volume, sweep * 10000000 + az * 10000 + gate as id, az, range_km, dbz from h0 where dbz >= 50 and h >= 3 and range_km between 5 and 200 and elev > lowest),
hn as materialized (select a.volume, a.id as a, b.id as b from h a join h b on a.volume = b.volume and a.id <> b.id and abs(a.range_km - b.range_km) < 5 and least(abs(a.az - b.az), 360 - abs(a.az - b.az)) < 5),
hl(volume, n, label) as (select volume, id, id from h union select hn.volume, hn.b, hl.label from hl join hn on hn.volume = hl.volume and hn.a = hl.n and hl.label < hn.b),
hb as (select volume, n as id, min(label) as label from hl group by 1, 2),
hk as (select volume, id, dbz, count(*) over w as members, row_number() over (w order by dbz desc, id) as r from h join hb using (volume, id) window w as (partition by volume, label)),
ha as (select volume, string_agg(id || ':' || dbz || ':' || members, ';' order by id) as hail from hk where r = 1 group by 1)
select volume, coalesce(cells, '') as cells, coalesce(rotations, '') as rotations, coalesce(tvs, '') as tvs, coalesce(hail, '') as hail from cl full join ro using (volume) full join tv using (volume) full join ha using (volume)
"""


QUERIES = {f.__name__: f for f in (radar_vil, radar_tops, radar_motion, radar_srv, shear_candidates, mesocyclones, tvs_candidates, high_z_hail, tbss, tds_candidates, tds_scores, storm_cells, meso_reflectivity, radar_inventory, dealias, volume_frames, cell_cascade, tvs_detections, mesocyclone_tilts)}
ORACLES = {
    "radar_vil": RADAR_VIL_SQL, "radar_tops": RADAR_TOPS_SQL, "radar_motion": RADAR_MOTION_SQL, "radar_srv": RADAR_SRV_SQL, "shear_candidates": SHEAR_CANDIDATES_SQL, "mesocyclones": MESOCYCLONES_SQL, "tvs_candidates": TVS_CANDIDATES_SQL,
    "high_z_hail": HIGH_Z_HAIL_SQL, "tbss": TBSS_SQL, "tds_candidates": TDS_CANDIDATES_SQL, "tds_scores": TDS_SCORES_SQL, "storm_cells": STORM_CELLS_SQL, "meso_reflectivity": MESO_REFLECTIVITY_SQL, "radar_inventory": RADAR_INVENTORY_SQL, "tvs_detections": TVS_DETECTIONS_SQL,
    "mesocyclone_tilts": MESOCYCLONE_TILTS_SQL, "volume_frames": VOLUME_FRAMES_SQL,
}
