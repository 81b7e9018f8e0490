"""Vertical columns: interpolation, layers and integrals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.functions.wind import wind_speed


def _next(keys: list[str], order: str):
    w = Win.partitionBy(*keys).orderBy(order)
    return lambda c: F.lead(c).over(w)


def interpolate(levels: DataFrame, keys: list[str], coord: str, target: float, names: list[str], log: bool = False) -> DataFrame:
    """Values at a coordinate between its two neighbouring levels, linear in it or its logarithm.

    The order of levels does not matter. Columns that do not reach the target
    give no row; a missing value at either neighbour gives null.
    """
    own = levels.where(F.col(coord).isNotNull())
    nxt = _next(keys, coord)
    pairs = own.select(*keys, F.col(coord).alias("_c0"), nxt(coord).alias("_c1"), *(F.col(n).alias(f"_{n}0") for n in names), *(nxt(n).alias(f"_{n}1") for n in names))
    hit = pairs.where((F.col("_c0") <= target) & ((F.col("_c1") > target) | ((F.col("_c0") == target) & F.col("_c1").isNull())))
    f = (F.ln(F.lit(target) / F.col("_c0")) / F.ln(F.col("_c1") / F.col("_c0"))) if log else (F.lit(target) - F.col("_c0")) / (F.col("_c1") - F.col("_c0"))
    at = lambda n: F.when(F.col("_c0") == target, F.col(f"_{n}0")).otherwise(F.col(f"_{n}0") + f * (F.col(f"_{n}1") - F.col(f"_{n}0")))
    return hit.select(*keys, *(at(n).alias(n) for n in names))


def interp_pressure(levels: DataFrame, keys: list[str], hpa: float, names: list[str]) -> DataFrame:
    return interpolate(levels, keys, "p_hpa", hpa, names, log=True)


def interp_pressure_linear(levels: DataFrame, keys: list[str], hpa: float, names: list[str]) -> DataFrame:
    return interpolate(levels, keys, "p_hpa", hpa, names)


def interp_height(levels: DataFrame, keys: list[str], z: float, names: list[str]) -> DataFrame:
    return interpolate(levels, keys, "z_m", z, names)


def height_agl(levels: DataFrame, surface: DataFrame, keys: list[str]) -> DataFrame:
    """Heights above ground: 0 or more, over the cell's orography or else its lowest level, rising by 1 m or more."""
    from cumula.operators.windows import monotone_height

    low = F.min("z_m").over(Win.partitionBy(*keys))
    joined = levels.withColumn("_low", low).join(surface.select(*keys, F.col("orog_m").alias("_orog")), keys, "left")
    agl = joined.withColumn("z_m", F.when(F.col("z_m").isNotNull(), F.greatest(F.col("z_m") - F.coalesce("_orog", "_low", F.lit(0.0)), F.lit(0.0)))).drop("_low", "_orog")
    return monotone_height(agl, keys)


def bulk_shear(levels: DataFrame, keys: list[str], z0: float, z1: float) -> DataFrame:
    a, b = (interp_height(levels, keys, z, ["u", "v"]).toDF(*keys, f"u{i}", f"v{i}") for i, z in enumerate((z0, z1)))
    return a.join(b, keys).select(*keys, wind_speed(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")).alias("shear"))


def layer_segments(levels: DataFrame, keys: list[str], z0: float, z1: float, names: list[str]) -> DataFrame:
    """Pieces of each column between two heights, ends cut by interpolation: za, zb and values at both."""
    nxt = _next(keys, "z_m")
    p = levels.select(*keys, F.col("z_m").alias("_z0"), nxt("z_m").alias("_z1"), *(F.col(n).alias(f"_{n}0") for n in names), *(nxt(n).alias(f"_{n}1") for n in names))
    p = p.where(F.col("_z1").isNotNull() & (F.col("_z1") > z0) & (F.col("_z0") < z1)).withColumns({"za": F.greatest("_z0", F.lit(z0)), "zb": F.least("_z1", F.lit(z1))})
    at = lambda n, z: F.col(f"_{n}0") + (F.col(z) - F.col("_z0")) / (F.col("_z1") - F.col("_z0")) * (F.col(f"_{n}1") - F.col(f"_{n}0"))
    return p.select(*keys, "za", "zb", *(at(n, z).alias(f"{n}{s}") for n in names for s, z in (("a", "za"), ("b", "zb"))))


def mean_wind(levels: DataFrame, keys: list[str], z0: float, z1: float) -> DataFrame:
    """Height-weighted mean of u and v in a layer."""
    s = layer_segments(levels, keys, z0, z1, ["u", "v"])
    dz = F.col("zb") - F.col("za")
    return s.groupBy(*keys).agg(*((F.try_divide(F.sum((F.col(f"{n}a") + F.col(f"{n}b")) / 2 * dz), F.sum(dz))).alias(f"mean_{n}") for n in ("u", "v")))


def srh(levels: DataFrame, motion: DataFrame, keys: list[str], z0: float, z1: float) -> DataFrame:
    """Storm-relative helicity of a layer for a storm motion (keys, cu, cv)."""
    s = layer_segments(levels, keys, z0, z1, ["u", "v"]).join(motion, keys)
    part = (F.col("ub") - F.col("cu")) * (F.col("va") - F.col("cv")) - (F.col("ua") - F.col("cu")) * (F.col("vb") - F.col("cv"))
    return s.groupBy(*keys).agg(F.sum(part).alias("srh"))


def bunkers(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Right-mover motion (keys, cu, cv): 0-6 km mean wind and 7.5 m/s to the right of the shear (Bunkers et al. 2000)."""
    layers = {"mean_{}": (0.0, 6000.0), "{}0": (0.0, 500.0), "{}1": (5500.0, 6000.0)}
    p = _layer_pieces(levels, keys, list(layers.values()))
    own = lambda ab, x: F.sum(F.when((F.col("z0") == ab[0]) & (F.col("z1") == ab[1]), x))
    mean = lambda n, ab: F.try_divide(own(ab, (F.col(f"{n}a") + F.col(f"{n}b")) / 2 * F.col("dz")), own(ab, F.col("dz")))
    s = p.groupBy(*keys).agg(*(mean(n, ab).alias(name.format(n)) for name, ab in layers.items() for n in ("u", "v"))).where("u0 is not null and u1 is not null and mean_u is not null")
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    n = F.sqrt(du * du + dv * dv)
    return s.select(*keys, (F.col("mean_u") + 7.5 * F.try_divide(dv, n)).alias("cu"), (F.col("mean_v") - 7.5 * F.try_divide(du, n)).alias("cv"))


def wind_bundle(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Helicity 0-1 and 0-3 km for the right mover, and 0-6 km shear."""
    m = bunkers(levels, keys)
    a, b = (srh(levels, m, keys, 0.0, z).withColumnRenamed("srh", n) for z, n in ((1000.0, "srh_0_1km"), (3000.0, "srh_0_3km")))
    base = levels.where("z_m > 0").groupBy(*keys).agg(F.min("z_m").alias("_z"))
    lowest = levels.join(base, keys).where(F.col("z_m") == F.col("_z")).select(*keys, F.col("u").alias("u0"), F.col("v").alias("v0"))
    top = interp_height(levels, keys, 6000.0, ["u", "v"]).join(lowest, keys).select(*keys, wind_speed(F.col("u") - F.col("u0"), F.col("v") - F.col("v0")).alias("shear_0_6km"))
    return a.join(b, keys).join(top, keys).join(m, keys)


def lapse_layer(levels: DataFrame, keys: list[str], z0: float, z1: float) -> DataFrame:
    """Fall of temperature from z0 to z1 in K/km."""
    a, b = (interp_height(levels, keys, z, ["t_c"]).withColumnRenamed("t_c", f"t{i}") for i, z in enumerate((z0, z1)))
    return a.join(b, keys).select(*keys, ((F.col("t0") - F.col("t1")) / ((z1 - z0) / 1000)).alias("lapse"))


def lapse_pressure(levels: DataFrame, keys: list[str], low: float = 700.0, high: float = 500.0) -> DataFrame:
    """Fall of virtual temperature between two pressures in K/km."""
    v = levels.withColumn("tv", T.virtual_temp(F.col("t_c"), T.dewpoint_q(F.col("p_hpa"), F.col("q")), F.col("p_hpa")))
    a, b = (interp_pressure_linear(v, keys, p, ["tv", "z_m"]).toDF(*keys, f"t{i}", f"z{i}") for i, p in enumerate((low, high)))
    return a.join(b, keys).select(*keys, F.try_divide(F.col("t0") - F.col("t1"), (F.col("z1") - F.col("z0")) / 1000).alias("lapse"))


def pwat(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Precipitable water in kg/m2: mean mixing ratio times pressure difference over all layers."""
    nxt = _next(keys, "k")
    s = levels.select(*keys, (0.5 * (F.greatest("q", F.lit(0.0)) + F.greatest(nxt("q"), F.lit(0.0))) * F.abs(F.col("p_hpa") - nxt("p_hpa")) * 100).alias("x"), nxt("p_hpa").alias("n"))
    return s.where("n is not null").groupBy(*keys).agg((F.sum("x") / T.GRAVITY).alias("pwat"))


def mslp(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Sea-level pressure from the first level 100 hPa or more above the lowest, by the standard lapse rate."""
    w = Win.partitionBy(*keys).orderBy("k")
    tv = (F.col("t_c") + 273.15) * (1 + 0.608 * F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(0.0)))
    s = levels.select(*keys, "k", (F.col("p_hpa") * 100).alias("p"), tv.alias("tv"), "z_m")
    s = s.select("*", F.first("p").over(w).alias("ps"), F.first("z_m").over(w).alias("zs"), *(F.lag(c).over(w).alias(f"{c}h") for c in ("p", "tv", "z_m")), F.row_number().over(Win.partitionBy(*keys).orderBy(F.desc("k"))).alias("from_top"))
    far = F.col("ps") - F.col("p") >= 10000
    ok = s.where(far | (F.col("from_top") == 1)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    ref = F.col("ps") - 10000
    frac = (F.ln(ref) - F.ln("ph")) / (F.ln("p") - F.ln("ph"))
    same = F.abs(F.col("p") - F.col("ph")) < 1
    ok = ok.select(*keys, "ps", "zs", ref.alias("pr"), F.when(same, F.col("tv")).otherwise(F.col("tvh") + frac * (F.col("tv") - F.col("tvh"))).alias("tr"), F.when(same, F.col("z_m")).otherwise(F.col("z_mh") + frac * (F.col("z_m") - F.col("z_mh"))).alias("zr"))
    lapse, limit = 0.0065, 273.16 + 17.5
    surf = F.col("tr") * F.pow(F.col("ps") / F.col("pr"), F.lit(lapse * T.SLP_GAS / T.SLP_GRAVITY))
    low = F.col("tr") + lapse * F.col("zr")
    sea = F.when((surf <= limit) & (low >= limit), limit).otherwise(limit - 0.005 * (surf - limit) * (surf - limit))
    return ok.select(*keys, (F.col("ps") * F.exp(2 * T.SLP_GRAVITY * F.col("zs") / (T.SLP_GAS * (sea + surf)))).alias("slp_pa"))


def column_max(levels: DataFrame, keys: list[str], value: str) -> DataFrame:
    return levels.groupBy(*keys).agg(F.max(value).alias(value))


def proxy_orography(levels: DataFrame, keys: list[str]) -> DataFrame:
    return levels.groupBy(*keys).agg(F.coalesce(F.min("z_m"), F.lit(0.0)).alias("orog_m"))


def mean_level_pressure(levels: DataFrame, keys: list[str]) -> DataFrame:
    return levels.groupBy(*keys, "k").agg(F.avg("p_hpa").alias("p_hpa"))


def cloud_layers(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest cloud fraction and any condensate (100 or 0) in low, middle and high layers, and their total."""
    p, out = F.col("p_hpa"), {}
    for name, low, high in (("low", 800.0, 1100.0), ("mid", 450.0, 800.0), ("high", 0.0, 450.0)):
        own = p.between(low, high)
        out[f"frac_{name}"] = F.coalesce(F.max(F.when(own, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cldfra"))) * 100)), F.lit(0.0))
        out[f"cond_{name}"] = F.coalesce(F.max(F.when(own & (F.col("cond") > 1e-6), 100.0)), F.lit(0.0))
    got = levels.groupBy(*keys).agg(*(c.alias(n) for n, c in out.items()))
    return got.withColumn("frac_total", F.greatest("frac_low", "frac_mid", "frac_high"))


def common_levels(fields: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Levels at which all named fields are there."""
    return fields.where(F.col("field").isin(names) & F.col("value").isNotNull()).groupBy(*keys, "level").agg(F.countDistinct("field").alias("n")).where(F.col("n") == len(set(names))).drop("n")


def max_shear_pairs(levels: DataFrame, keys: list[str], low: tuple[float, float] = (0.0, 1000.0), high: tuple[float, float] = (6000.0, 10000.0)) -> DataFrame:
    """Greatest wind difference between any level of the low and any of the high layer."""
    a = levels.where(F.col("z_m").between(*low)).groupBy(*keys).agg(F.collect_list(F.struct("u", "v")).alias("a"))
    b = levels.where(F.col("z_m").between(*high)).groupBy(*keys).agg(F.collect_list(F.struct("u", "v")).alias("b"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform(F.col("b"), lambda y: wind_speed(y["u"] - x["u"], y["v"] - x["v"]))))
    return a.join(b, keys).select(*keys, F.array_max(pairs).alias("shear"))


def _layer_pieces(levels: DataFrame, keys: list[str], layers: list[tuple[float, float]]) -> DataFrame:
    """Pieces (keys, z0, z1, dz, ua, ub, va, vb) of each column in every layer, ends cut by interpolation; one window."""
    nxt = _next(keys, "z_m")
    names = ("u", "v")
    p = levels.select(*keys, F.col("z_m").alias("_z0"), nxt("z_m").alias("_z1"), *(F.col(n).alias(f"_{n}0") for n in names), *(nxt(n).alias(f"_{n}1") for n in names)).where("_z1 is not null")
    p = p.select("*", F.inline(F.array(*(F.struct(F.lit(a).alias("z0"), F.lit(b).alias("z1")) for a, b in layers)))).where("_z1 > z0 and _z0 < z1")
    p = p.withColumns({"za": F.greatest("_z0", "z0"), "zb": F.least("_z1", "z1")})
    at = lambda n, z: F.col(f"_{n}0") + (F.col(z) - F.col("_z0")) / (F.col("_z1") - F.col("_z0")) * (F.col(f"_{n}1") - F.col(f"_{n}0"))
    return p.select(*keys, "z0", "z1", (F.col("zb") - F.col("za")).alias("dz"), *(at(n, z).alias(f"{n}{s}") for n in names for s, z in (("a", "za"), ("b", "zb"))))


def layer_table(levels: DataFrame, motion: DataFrame, keys: list[str], layers: list[tuple[float, float]]) -> DataFrame:
    """(keys, z0, z1, mean_u, mean_v, srh, sr_wind) of every layer, in one pass over the pieces of columns."""
    p = _layer_pieces(levels, keys, layers).join(motion, keys)
    names = ("u", "v")
    cross = (F.col("ub") - F.col("cu")) * (F.col("va") - F.col("cv")) - (F.col("ua") - F.col("cu")) * (F.col("vb") - F.col("cv"))
    got = p.groupBy(*keys, "z0", "z1", "cu", "cv").agg(*((F.sum((F.col(f"{n}a") + F.col(f"{n}b")) / 2 * F.col("dz")) / F.sum("dz")).alias(f"mean_{n}") for n in names), F.sum(cross).alias("srh"))
    return got.withColumn("sr_wind", wind_speed(F.col("mean_u") - F.col("cu"), F.col("mean_v") - F.col("cv"))).drop("cu", "cv")


def buoyancy_layer(levels: DataFrame, keys: list[str], a: str, b: str, z0: float, z1: float) -> DataFrame:
    """Integral of the positive part, mean and greatest of the difference b - a in a layer, by the trapezoid rule."""
    s = layer_segments(levels.withColumn("_d", F.col(b) - F.col(a)), keys, z0, z1, ["_d"])
    dz, x, y = F.col("zb") - F.col("za"), F.col("_da"), F.col("_db")
    positive = (F.greatest(x, F.lit(0.0)) + F.greatest(y, F.lit(0.0))) / 2 * dz
    return s.groupBy(*keys).agg(F.sum(F.when(x.isNotNull() & y.isNotNull(), positive)).alias("positive"), F.try_divide(F.sum((x + y) / 2 * dz), F.sum(F.when((x + y).isNotNull(), dz))).alias("mean"), F.max(F.greatest(x, y)).alias("greatest"))


def profile_summary(levels: DataFrame, keys: list[str]) -> DataFrame:
    return levels.groupBy(*keys).agg(F.count("*").alias("levels"), F.max("p_hpa").alias("p_bottom"), F.min("p_hpa").alias("p_top"), F.min("z_m").alias("z_bottom"), F.max("z_m").alias("z_top"), F.max_by("t_c", "p_hpa").alias("t_bottom"))


def violations(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that break a column's rules: values there, pressure falling, height rising, dewpoint at or below temperature."""
    w = Win.partitionBy(*keys).orderBy("k")
    bad = F.when(F.col("p_hpa").isNull() | F.col("z_m").isNull() | F.col("t_c").isNull() | F.col("q").isNull(), "missing").when(F.lag("p_hpa").over(w) <= F.col("p_hpa"), "pressure").when(F.lag("z_m").over(w) >= F.col("z_m"), "height").when(T.dewpoint_q(F.col("p_hpa"), F.col("q")) > F.col("t_c") + 1e-9, "dewpoint")
    return levels.select(*keys, "k", bad.alias("rule")).where("rule is not null")


def rh_at_level(levels: DataFrame, keys: list[str], hpa: float, tolerance: float = 0.25) -> DataFrame:
    from cumula.operators.filters import level_slice

    return level_slice(levels, hpa, tolerance).select(*keys, T.rh_q(F.col("t_c"), F.col("p_hpa"), F.col("q")).alias("rh"))


