"""What users ask for: products at points and in areas, cases, time series of mosaics, bundles and soundings.

Values come as long tables (keys, grid_index, product, value); requests (points,
slugs, thresholds) are small tables and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.functions import wind as W
from cumula.operators import areas as R
from cumula.operators import profile as P
from cumula.operators import sampling as S
from cumula.operators import stencil as ST
from cumula.shared import written

STATS = ("included", "valid", "missing", "min", "max", "mean")


def blockers(values: DataFrame, slugs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, product, reason): wanted products (slug, known) that are unknown, not in the run, or without a valid cell."""
    runs = values.select(*keys).distinct()
    have = values.groupBy(*keys, "product").agg(F.count("value").alias("_n"))
    want = runs.withColumn("_", F.lit(1)).join(F.broadcast(slugs.withColumn("_", F.lit(1))), "_").drop("_").withColumnRenamed("slug", "product")
    j = want.join(have, [*keys, "product"], "left")
    reason = F.when(~F.col("known"), "unknown product").when(F.col("_n").isNull(), "no data in run").when(F.col("_n") == 0, "no valid cell")
    return j.select(*keys, "product", reason.alias("reason")).where("reason is not null")


def _wanted(values: DataFrame, slugs: DataFrame, keys: list[str]) -> DataFrame:
    own = values.join(F.broadcast(slugs.where("known").select(F.col("slug").alias("product"))), "product")
    return own.select(*keys, "product", "grid_index", "value")


def sample_products(values: DataFrame, cells: DataFrame, points: DataFrame, slugs: DataFrame, keys: list[str], method: str = "nearest") -> DataFrame:
    """(keys, point_id, product, value, reason): every wanted product at each point, and a row with a reason for each blocked one."""
    own = _wanted(values, slugs, keys)
    blocked = blockers(values, slugs, keys)
    sampler = S.sample_nearest if method == "nearest" else S.sample_idw4
    got = sampler(own, cells, points, [*keys, "product"]).join(blocked.select(*keys, "product"), [*keys, "product"], "left_anti")
    return got.select(*keys, "point_id", "product", "value", F.lit(None).cast("string").alias("reason")).unionByName(blocked, allowMissingColumns=True)


def summarize_products(values: DataFrame, cells: DataFrame, polygons: DataFrame, slugs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, product, poly_id, counts, min, max, mean, reason): wanted products over polygons, and rows with reasons for blocked ones."""
    blocked = blockers(values, slugs, keys)
    own = _wanted(values, slugs, keys).join(blocked.select(*keys, "product"), [*keys, "product"], "left_anti")
    got = R.summarize_area(own, cells, polygons, [*keys, "product"])
    return got.withColumn("reason", F.lit(None).cast("string")).unionByName(blocked, allowMissingColumns=True)


def query_field(values: DataFrame, cells: DataFrame, keys: list[str], points: DataFrame | None = None, polygons: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """One field (keys, grid_index, value) at points, over areas, or compared with another field (same columns) over areas."""
    if (points is None) == (polygons is None) or (other is not None and polygons is None):
        raise ValueError("ask for points, for areas, or for areas with another field")
    if points is not None:
        return S.sample_nearest(values, cells, points, keys)
    if other is None:
        return R.summarize_area(values, cells, polygons, keys)
    pairs = values.withColumnRenamed("value", "a").join(other.withColumnRenamed("value", "b"), [*keys, "grid_index"])
    return R.compare_stats(pairs.join(R.membership(cells, polygons), "grid_index"), [*keys, "poly_id"])


def extract_case(values: DataFrame, cells: DataFrame, keys: list[str], patches: DataFrame, points: DataFrame, routes: DataFrame, thresholds: dict[str, float], n: int = 9) -> DataFrame:
    """(keys, kind, id, stat, value): patch statistics, threshold shares, nearest point values and transect values of a field."""
    inside = values.join(R.membership(cells, patches), "grid_index")
    own = [*keys, "poly_id"]

    def long(df: DataFrame, kind: str, key: Column, names: list[str]) -> DataFrame:
        stats = F.inline(F.array(*(F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names)))
        return df.select(*keys, F.lit(kind).alias("kind"), key.cast("string").alias("id"), stats)

    stats = R.patch_stats(inside, own)
    counts = R.threshold_counts(inside, own, {k: F.col("value") >= v for k, v in thresholds.items()})
    at = S.sample_nearest(values, cells, points, keys)
    along = S.transect(values, cells, routes, n, keys)
    out = long(stats, "patch", F.col("poly_id"), [c for c in stats.columns if c not in own])
    out = out.union(long(counts, "threshold", F.col("poly_id"), [c for c in counts.columns if c not in own]))
    out = out.union(long(at, "point", F.col("point_id"), ["value"]))
    return out.union(long(along, "transect", F.concat_ws(":", "route_id", "seq"), ["value", "distance_km"]))


def relative_label(ts: Column, ref: Column) -> Column:
    """T0, T_minus_10min or T_plus_10min: whole minutes from a reference time, halves away from it."""
    minutes = F.round((F.unix_micros(ts) - F.unix_micros(ref)) / 60e6).cast("long")
    return F.when(minutes == 0, "T0").when(minutes < 0, F.format_string("T_minus_%dmin", -minutes)).otherwise(F.format_string("T_plus_%dmin", minutes))


def mosaic_series(files: DataFrame, values: DataFrame, cells: DataFrame, patches: DataFrame, keys: list[str], ref: Column, scale: float, thresholds: dict[str, float]) -> DataFrame:
    """One row for each file (keys, valid_ts) and patch: cells, statistics, threshold shares and the label of its time.

    Values at or below -990 or from 1e6 on are missing. Files without values
    stay as rows with an error and without a patch. Members are written, so that their true
    size is known: else values, whose estimate leaves out their hours, would be broadcast.
    """
    v = F.col("value")
    own = values.withColumn("value", F.when((v > -990) & (v < 1e6), v * scale)).join(written(R.membership(cells, patches)), "grid_index")
    by = [*keys, "poly_id"]
    got = R.summarize(own, by).join(R.threshold_counts(own, by, {k: v >= x for k, x in thresholds.items()}).drop("valid"), by)
    label = files.withColumn("time_label", relative_label(F.col("valid_ts"), ref))
    j = label.join(got, keys, "left")
    return j.withColumn("error", F.when(F.col("poly_id").isNull(), "no values"))


def box_sounding(levels: DataFrame, surface: DataFrame, cells: DataFrame, points: DataFrame, keys: list[str], half_km: float) -> DataFrame:
    """(keys, point_id, k, p_hpa, z_m, t_c, td_c, u, v): box-mean column of each point, the surface first (k = -1).

    A point without a cell in its box takes its nearest cell. Levels at or below
    the surface's pressure (but 0.1 hPa) or within a metre of its height go; then
    each level must lie higher, at less pressure, than all before it, and
    dewpoints are held at or below temperatures. Points with the same cells share
    their column: it is worked out once, and the points join it last.
    """
    names = ("p_hpa", "z_m", "t_c", "q", "u", "v")
    inside = S.box_cells(cells, points, half_km)
    alone = points.join(inside.select("point_id").distinct(), "point_id", "left_anti")
    members = inside.unionByName(S.k_nearest(cells, alone, 1).select("point_id", "grid_index"))
    boxes = members.groupBy("point_id").agg(F.array_sort(F.collect_set("grid_index")).alias("_box"))
    homes = written(boxes.select(F.col("point_id").alias("_point"), F.min("point_id").over(Win.partitionBy("_box")).alias("point_id"), "_box"))
    members = homes.where("_point = point_id").select("point_id", F.explode("_box").alias("grid_index"))

    def mean(df: DataFrame, by: list[str]) -> DataFrame:
        return df.join(members, "grid_index").groupBy(*by, "point_id").agg(*(F.avg(n).alias(n) for n in names))

    ground = mean(surface, keys)
    aloft = mean(levels, [*keys, "k"])
    at = ground.select(*keys, "point_id", F.col("p_hpa").alias("_p"), F.col("z_m").alias("_z"))
    own = aloft.join(at, [*keys, "point_id"]).where((F.col("p_hpa") < F.col("_p") - 0.1) & (F.col("z_m") > F.col("_z") + 1)).drop("_p", "_z")
    both = ground.withColumn("k", F.lit(-1).cast("long")).unionByName(own)
    td = T.dewpoint_q(F.col("p_hpa"), F.col("q"))
    both = both.withColumn("td_c", F.least(td, F.col("t_c"))).where("p_hpa > 0 and z_m is not null and t_c is not null and q is not null and u is not null and v is not null")
    before = Win.partitionBy(*keys, "point_id").orderBy(F.desc("p_hpa"), "k").rowsBetween(Win.unboundedPreceding, -1)
    # A level is kept if it tops the highest before it: one that is dropped is lower than that, so it never counts.
    ranked = both.withColumns({"_z": F.max("z_m").over(before), "_p": F.min("p_hpa").over(before)})
    got = ranked.where("_z is null or (z_m > _z + 1e-6 and p_hpa < _p - 1e-6)").drop("_z", "_p", "q")
    return got.join(homes.drop("_box"), "point_id").drop("point_id").withColumnRenamed("_point", "point_id").select(got.columns)


def updraft_helicity(levels: DataFrame, keys: list[str], dx_m: float, dy_m: float, z0: float = 2000.0, z1: float = 5000.0) -> DataFrame:
    """(keys, grid_index, uh): integral of w times vorticity over a layer, 0 where the layer's mean w is not positive.

    ``levels`` has keys, grid_index, k, x, y, lat, z_m, u, v and w.
    """
    rel = ST.vorticity(levels, [*keys, "k"], dx_m, dy_m).withColumn("wz", F.col("w") * F.col("rel_vort"))
    s = P.layer_segments(rel, [*keys, "grid_index"], z0, z1, ["w", "wz"])
    dz = F.col("zb") - F.col("za")
    got = s.groupBy(*keys, "grid_index").agg(F.sum((F.col("wa") + F.col("wb")) / 2 * dz).alias("_w"), F.sum((F.col("wza") + F.col("wzb")) / 2 * dz).alias("_h"))
    return got.select(*keys, "grid_index", F.when(F.col("_w") > 0, F.col("_h")).otherwise(0.0).alias("uh"))


def refl_at_height(levels: DataFrame, keys: list[str], z: float = 1000.0) -> DataFrame:
    """(keys, dbz) at a height above ground."""
    return P.interp_height(levels, keys, z, ["dbz"])


def surface_thermo(surface: DataFrame) -> DataFrame:
    """``surface`` (t_c, p_hpa, q, u, v) with dewpoint, humidity, theta-e, wet bulb, depression, VPD, fire weather, heat index, wind chill and apparent temperature."""
    t, p, q = F.col("t_c"), F.col("p_hpa"), F.col("q")
    base = surface.withColumn("dewpoint", T.dewpoint_q(p, q)).withColumn("wind_ms", W.wind_speed(F.col("u"), F.col("v")))
    td, ws = F.col("dewpoint"), F.col("wind_ms")
    base = base.withColumns({"humidity": T.rh_td(t, td), "theta_e": T.theta_e(p, t, td), "wet_bulb": T.wetbulb(p, t, td), "depression": T.dewpoint_depression(t, td), "vpd": T.vpd_td(t, td)})
    rh = F.col("humidity")
    return base.withColumns({"fire": T.fire_weather(t, rh, ws, F.col("vpd")), "heat_index": T.heat_index(t, rh), "wind_chill": T.wind_chill(t, ws), "apparent": T.apparent(t, rh, ws)})


def column_kinematics(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Shear between the ground and 1, 3, 6 and 8 km, and the mean wind of 0 to 6 km; one pass over each column."""
    nxt = lambda c: F.lead(c).over(Win.partitionBy(*keys).orderBy("z_m"))
    p = levels.select(*keys, "z_m", "u", "v", nxt("z_m").alias("_z"), nxt("u").alias("_u"), nxt("v").alias("_v"))
    at = lambda c, z: F.max(F.when((F.col("z_m") <= z) & (F.col("_z") > z), F.col(c) + (z - F.col("z_m")) / (F.col("_z") - F.col("z_m")) * (F.col(f"_{c}") - F.col(c)))).alias(f"{c}{z}")
    za, zb = F.greatest("z_m", F.lit(0.0)), F.least("_z", F.lit(6000.0))
    inside = F.col("_z").isNotNull() & (F.col("_z") > 0) & (F.col("z_m") < 6000)
    f = lambda c, z: F.col(c) + (z - F.col("z_m")) / (F.col("_z") - F.col("z_m")) * (F.col(f"_{c}") - F.col(c))
    mean = lambda c: F.try_divide(F.sum(F.when(inside, (f(c, za) + f(c, zb)) / 2 * (zb - za))), F.sum(F.when(inside, zb - za))).alias(f"mean_{c}")
    tops = (1000, 3000, 6000, 8000)
    g = p.groupBy(*keys).agg(*(at(c, z) for c in "uv" for z in (0, *tops)), mean("u"), mean("v"))
    shear = lambda z: W.wind_speed(F.col(f"u{z}") - F.col("u0"), F.col(f"v{z}") - F.col("v0")).alias(f"shear_0_{z // 1000}km")
    return g.select(*keys, *map(shear, tops), "mean_u", "mean_v")


#: What each derived recipe needs: recipes whose closure is asked for are computed, others are not.
RECIPES: dict[str, tuple[tuple[str, ...], object]] = {
    "dewpoint": (("p_hpa", "q"), lambda: T.dewpoint_q(F.col("p_hpa"), F.col("q"))),
    "wind_ms": (("u", "v"), lambda: W.wind_speed(F.col("u"), F.col("v"))),
    "humidity": (("t_c", "dewpoint"), lambda: T.rh_td(F.col("t_c"), F.col("dewpoint"))),
    "vpd": (("t_c", "dewpoint"), lambda: T.vpd_td(F.col("t_c"), F.col("dewpoint"))),
    "theta_e": (("p_hpa", "t_c", "dewpoint"), lambda: T.theta_e(F.col("p_hpa"), F.col("t_c"), F.col("dewpoint"))),
    "fire": (("t_c", "humidity", "wind_ms", "vpd"), lambda: T.fire_weather(F.col("t_c"), F.col("humidity"), F.col("wind_ms"), F.col("vpd"))),
    "apparent": (("t_c", "humidity", "wind_ms"), lambda: T.apparent(F.col("t_c"), F.col("humidity"), F.col("wind_ms"))),
}


def derive(df: DataFrame, recipes: list[str]) -> DataFrame:
    """``df`` with the recipes asked for and no other new column; what they need is worked out first, and a lacking input is an error."""
    given, done = set(df.columns), df

    def add(name: str) -> None:
        nonlocal done
        if name in done.columns:
            return
        if name not in RECIPES:
            raise ValueError(f"{name} is neither a column nor a recipe")
        needs, make = RECIPES[name]
        for n in needs:
            add(n)
        done = done.withColumn(name, make())

    for r in recipes:
        add(r)
    return done.select(*df.columns, *(r for r in dict.fromkeys(recipes) if r not in given))


def effective_severe(df: DataFrame) -> DataFrame:
    """``df`` (sbcape, lcl_m, srh_1km, ebwd, cin, mucape, srh_3km) with the effective tornado and supercell parameters."""
    c = F.col
    return df.withColumns({"stp_eff": T.stp_effective(c("sbcape"), c("lcl_m"), c("srh_1km"), c("ebwd"), c("cin")), "scp": T.scp(c("mucape"), c("srh_3km"), c("ebwd"))})


def scp_ehi(df: DataFrame) -> DataFrame:
    """``df`` (mucape, sbcape, srh_1km, srh_3km, shear) with the supercell composite and the energy helicity index."""
    c = F.col
    return df.withColumns({"scp": T.scp(c("mucape"), c("srh_3km"), c("shear")), "ehi": T.ehi(c("sbcape"), c("srh_1km"))})


def wind_speed_fill(values: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """(keys, grid_index, level, value): wind speed in knots from rows of fields u and v, where both are there."""
    part = lambda n: F.max(F.when(F.col("field") == n, F.col("value")))
    g = values.where(F.col("field").isin("u", "v")).groupBy(*keys, "grid_index", level).agg(part("u").alias("_u"), part("v").alias("_v"))
    return g.where("_u is not null and _v is not null").select(*keys, "grid_index", level, (W.wind_speed(F.col("_u"), F.col("_v")) / W.MS_PER_KT).alias("value"))


def lookup_key(s: Column) -> Column:
    """ASCII letters and digits in lower case, all else as single underscores, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", "_")), "_+", "_"), F.lit("_"))


def find_assets(assets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, slug): the first asset (slug, label, tags, seq) whose slug, label or tag behind its last colon has the query's key."""
    names = F.concat(F.array("slug", "label"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.element_at(F.split(t, ":"), -1)))
    keyed = assets.select("slug", "seq", F.explode(F.array_distinct(F.transform(names, lookup_key))).alias("_key")).where("_key <> ''")
    asked = queries.select("query_id", lookup_key(F.col("query")).alias("_key")).where("_key <> ''")
    return asked.join(keyed, "_key").groupBy("query_id").agg(F.min_by("slug", "seq").alias("slug"))


def contains_mode(mode: str, lon: Column, lat: Column, crop: tuple[Column, Column, Column, Column], query: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a place's centre lies in bounds (west, east, south, north), its crop meets them, or its crop lies within them."""
    if mode == "center":
        return (lon >= query[0]) & (lon <= query[1]) & (lat >= query[2]) & (lat <= query[3])
    if mode == "intersects":
        return (crop[0] <= query[1]) & (crop[1] >= query[0]) & (crop[2] <= query[3]) & (crop[3] >= query[2])
    if mode == "within":
        return (crop[0] >= query[0]) & (crop[1] <= query[1]) & (crop[2] >= query[2]) & (crop[3] <= query[3])
    raise ValueError(f"unknown mode {mode}")


def union_catalogs(built_in: DataFrame, *external: DataFrame) -> DataFrame:
    """All catalogues under one another with their ``origin``: 0 built in, then the others in order."""
    out = built_in.withColumn("origin", F.lit(0))
    for i, e in enumerate(external):
        out = out.unionByName(e.withColumn("origin", F.lit(i + 1)), allowMissingColumns=True)
    return out


def representative_route(bounds: DataFrame, farthest: bool = False) -> DataFrame:
    """``bounds`` (west, east, south, north) with lat0, lon0, lat1, lon1: the midline of the longer axis, or the farthest two corners."""
    w, e, s, n = (F.col(c) for c in ("west", "east", "south", "north"))
    lat, lon = (s + n) / 2, (w + e) / 2
    if not farthest:
        wide = W.haversine(lat, w, lat, e) >= W.haversine(s, lon, n, lon)
        ends = (F.when(wide, lat).otherwise(s), F.when(wide, w).otherwise(lon), F.when(wide, lat).otherwise(n), F.when(wide, e).otherwise(lon))
    else:
        corners = ((s, w), (s, e), (n, w), (n, e))
        pairs = [F.struct(W.haversine(*a, *b).alias("d"), F.lit(-i).alias("i"), a[0].alias("a"), a[1].alias("b"), b[0].alias("c"), b[1].alias("e")) for i, (a, b) in enumerate((x, y) for k, x in enumerate(corners) for y in corners[k + 1 :])]
        best = F.greatest(*pairs)
        ends = tuple(best[k] for k in ("a", "b", "c", "e"))
    return bounds.withColumns(dict(zip(("lat0", "lon0", "lat1", "lon1"), ends, strict=True)))


def terrain_facts(section: DataFrame, keys: list[str]) -> DataFrame:
    """Least and greatest surface pressure (psfc_hpa) and height (orog_m) of a section with the place (seq) of each, the first of equals."""
    out = []
    for c in ("psfc_hpa", "orog_m"):
        there = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("seq").alias("s")))
        back = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("seq")).alias("s")))
        out += [F.min(there).alias(f"_{c}_lo"), F.max(back).alias(f"_{c}_hi")]
    g = section.groupBy(*keys).agg(*out)
    names = [x for c in ("psfc_hpa", "orog_m") for x in (F.col(f"_{c}_lo.v").alias(f"{c}_min"), F.col(f"_{c}_lo.s").alias(f"{c}_min_seq"), F.col(f"_{c}_hi.v").alias(f"{c}_max"), (-F.col(f"_{c}_hi.s")).alias(f"{c}_max_seq"))]
    return g.select(*keys, *names)


def nearest_sites(sites: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """(point_id, site_id, km, rank): the n nearest sites by great circle; sites meet points in widening buckets."""
    cells = sites.select(F.col("site_id").alias("grid_index"), "lat", "lon")
    near = S.k_nearest(cells, points, n, km=True)
    km = W.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return near.select("point_id", F.col("grid_index").alias("site_id"), km.alias("km"), "rank")


def effective_nyquist(radials: DataFrame, default: float = 30.0) -> DataFrame:
    """(volume, sweep, nyquist): the sweep's own, else that of its first radial with one, else ``default``."""
    first = F.min(F.when(F.col("radial_nyquist").isNotNull(), F.struct("az", "radial_nyquist")))
    return radials.groupBy("volume", "sweep").agg(F.coalesce(F.max("sweep_nyquist"), first["radial_nyquist"], F.lit(default)).alias("nyquist"))


def failure_count(cells: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """Cells of each key that a solver marked as failed."""
    return cells.groupBy(*keys).agg(F.sum(F.coalesce(failed, F.lit(False)).cast("long")).alias("failures"))


def case_summary(masks: DataFrame, stats: DataFrame, mask_names: list[str], fields: list[str]) -> DataFrame:
    """One row for each case: share of each mask, of its largest object in grid and mask (percent), and median, p90, p95 and max of each field."""
    m = masks.select("case", "mask", F.inline(F.array(*(F.struct(F.lit(n).alias("what"), (F.col(c) * 100).alias("v")) for n, c in (("pct", "fraction"), ("largest_component_pct", "largest_of_grid"), ("largest_component_of_mask_pct", "largest_of_mask"))))))
    s = stats.where("mask = 'all'").select("case", F.col("field").alias("mask"), F.inline(F.array(*(F.struct(F.lit(n).alias("what"), F.col(c).alias("v")) for n, c in (("median", "p50"), ("p90", "p90"), ("p95", "p95"), ("max", "max"))))))
    names = [f"{n}_{w}" for n in mask_names for w in ("pct", "largest_component_pct", "largest_component_of_mask_pct")] + [f"{f}_{w}" for f in fields for w in ("median", "p90", "p95", "max")]
    long = m.union(s).select("case", F.concat_ws("_", "mask", "what").alias("name"), "v")
    return long.groupBy("case").pivot("name", names).agg(F.first("v", ignorenulls=True))


def write_case_summary(wide: DataFrame, long: DataFrame, path: str) -> None:
    """Two CSV tables: one row for each case, and one for each case, field and mask."""
    wide.write.csv(f"{path}/cases", header=True)
    long.write.csv(f"{path}/stats", header=True)
