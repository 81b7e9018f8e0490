"""Vertical sections along routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.functions import wind as W
from cumula.operators.sampling import idw_weights


def sample_route(path: DataFrame, n: int) -> DataFrame:
    """n points (route_id, seq, plat, plon, distance_km, bearing) at equal distances along polylines (route_id, seq, lat, lon)."""
    w = Win.partitionBy("route_id").orderBy("seq")
    s = path.select("route_id", "seq", "lat", "lon", F.lead("lat").over(w).alias("lat1"), F.lead("lon").over(w).alias("lon1"))
    s = s.where("lat1 is not null").withColumn("len", W.haversine(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")))
    s = s.withColumn("d0", F.sum("len").over(w.rowsBetween(Win.unboundedPreceding, 0)) - F.col("len"))
    total = s.groupBy("route_id").agg(F.sum("len").alias("total"), F.max("seq").alias("last"))
    p = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("d", F.col("total") * F.col("i") / (n - 1))
    j = p.join(s, "route_id").where(((F.col("d") >= F.col("d0")) & (F.col("d") < F.col("d0") + F.col("len"))) | ((F.col("i") == n - 1) & (F.col("seq") == F.col("last"))))
    f = F.least(F.try_divide(F.col("d") - F.col("d0"), F.col("len")), F.lit(1.0))
    lat, lon = W.intermediate(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), f)
    return j.select("route_id", F.col("i").alias("seq"), lat.alias("plat"), lon.alias("plon"), F.col("d").alias("distance_km"), W.bearing(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")).alias("bearing"))


def sample_section(levels: DataFrame, cells: DataFrame, route: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Inverse-distance values of each level at each route point: (keys, k, route_id, seq, …names)."""
    p = route.withColumn("point_id", F.concat_ws(":", "route_id", "seq"))
    w = idw_weights(cells, p.select("point_id", "plat", "plon"))
    j = levels.join(w, "grid_index")
    mean = lambda n: F.try_divide(F.sum(F.col(n) * F.col("weight")), F.sum(F.when(F.col(n).isNotNull(), F.col("weight")))).alias(n)
    return j.groupBy(*keys, "k", "point_id").agg(*map(mean, names)).join(p.select("point_id", "route_id", "seq", "distance_km", "bearing"), "point_id").drop("point_id")


def section_values(section: DataFrame) -> DataFrame:
    """Ten products of a section (p_hpa, t_c, q, u, v): fire weather is the relative humidity, as its users expect."""
    t, p, q, u, v = (F.col(c) for c in ("t_c", "p_hpa", "q", "u", "v"))
    td, rh = T.dewpoint_q(p, q), T.rh_q(t, p, q)
    out = {
        "temperature": t, "relative_humidity": rh, "specific_humidity": T.mixing_to_specific(q) * 1000, "theta_e": T.theta_e(p, t, td), "wind_speed": W.wind_speed(u, v),
        "wet_bulb": T.wetbulb_stull(t, rh), "vpd": T.vpd_tetens(t, rh), "dewpoint_depression": T.dewpoint_depression(t, td, True), "moisture_transport": T.moisture_transport(q, u, v), "fire_weather": rh,
    }
    return section.withColumns(out)


def mask_terrain(section: DataFrame, surface: DataFrame, names: list[str]) -> DataFrame:
    """``section`` with values below the ground (pressure over the surface's psfc_hpa) null."""
    j = section.join(surface, ["route_id", "seq"], "left")
    return j.withColumns({n: F.when(F.col("p_hpa") <= F.coalesce("psfc_hpa", F.lit(1e9)), F.col(n)) for n in names}).drop("psfc_hpa")


def section_wind(section: DataFrame) -> DataFrame:
    along, left = W.section_wind(F.col("u"), F.col("v"), F.col("bearing"))
    return section.withColumns({"along": along, "left_wind": left})


def section_facts(section: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Finite and missing cells, least and greatest value with place and level, and those of the lowest visible level."""
    at = lambda f, sign: f(F.when(F.col(value).isNotNull(), F.struct(F.col(value), (sign * F.col("seq")).alias("s"), (sign * F.col("k")).alias("k"))))
    low = F.min(F.when(F.col(value).isNotNull(), F.col("k"))).over(Win.partitionBy(*keys, "seq"))
    s = section.withColumn("_low", F.col("k") == low)
    g = s.groupBy(*keys).agg(F.count(value).alias("finite"), (F.count("*") - F.count(value)).alias("missing"), at(F.min, 1).alias("_lo"), at(F.max, -1).alias("_hi"), F.min(F.when(F.col("_low"), F.col(value))).alias("low_min"), F.max(F.when(F.col("_low"), F.col(value))).alias("low_max"))
    return g.select(*keys, "finite", "missing", F.col(f"_lo.{value}").alias("min"), F.col("_lo.s").alias("min_seq"), F.col("_lo.k").alias("min_k"), F.col(f"_hi.{value}").alias("max"), (-F.col("_hi.s")).alias("max_seq"), (-F.col("_hi.k")).alias("max_k"), "low_min", "low_max")


def wind_facts(section: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest wind, tail, head, left and right wind of a section with along and left_wind."""
    s = W.wind_speed(F.col("u"), F.col("v"))
    top = lambda c, name: F.max(F.when(c > 0, c)).alias(name)
    return section.groupBy(*keys).agg(F.max(s).alias("strongest"), top(F.col("along"), "tail"), top(-F.col("along"), "head"), top(F.col("left_wind"), "to_left"), top(-F.col("left_wind"), "to_right"))


def section_bilinear(section: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Values at (route_id, pt, distance_km, level k) between the four section cells around; null outside or where one lacks."""
    w = Win.partitionBy("route_id", "k").orderBy("distance_km")
    s = section.select("route_id", "k", F.col("distance_km").alias("d0"), F.lead("distance_km").over(w).alias("d1"), F.col(value).alias("v0"), F.lead(value).over(w).alias("v1"))
    u = Win.partitionBy("route_id", "d0").orderBy("k")
    s = s.where("d1 is not null").select("*", F.lead("v0").over(u).alias("w0"), F.lead("v1").over(u).alias("w1"), F.lead("k").over(u).alias("k1"))
    p = points.select("route_id", "pt", F.col("distance_km").alias("pd"), F.col("k").alias("pk"))
    j = p.join(s, "route_id").where("pd >= d0 and pd < d1 and pk >= k and pk < k1")
    f, g = (F.col("pd") - F.col("d0")) / (F.col("d1") - F.col("d0")), (F.col("pk") - F.col("k")) / (F.col("k1") - F.col("k"))
    low, high = F.col("v0") + f * (F.col("v1") - F.col("v0")), F.col("w0") + f * (F.col("w1") - F.col("w0"))
    return j.select("route_id", "pt", (low + g * (high - low)).alias("value"))
