"""Unit conversion, bounds, polygons, masks and checks over cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumula.functions.wind import dlon

# Field, factor, offset and unit of display.
DISPLAY_UNITS = (
    ("smoke_mass_density", 1e9, 0.0, "ug/m^3"),
    ("column_integrated_smoke", 1e6, 0.0, "mg/m^2"),
    ("temperature", 1.0, -273.15, "degC"),
    ("dewpoint", 1.0, -273.15, "degC"),
    ("pressure_reduced_to_mean_sea_level", 0.01, 0.0, "hPa"),
    ("precipitable_water", 1 / 25.4, 0.0, "in"),
    ("visibility", 0.0006213712, 0.0, "mi"),
    ("absolute_vorticity", 1e5, 0.0, "10^-5 s^-1"),
    ("wind_gust", 1.9438445, 0.0, "kt"),
    ("total_precipitation", 1 / 25.4, 0.0, "in"),
)
CAPE_THRESHOLDS = (250, 500, 750, 1000, 1500, 2000, 2500, 3000, 3500, 4000, 5000, 6000, 7000)
EHI_THRESHOLDS = (0.25, 0.5, 0.75, 1, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10)
HEAVY_CELLS = 1_500_000


def to_display_units(df: DataFrame, field: str = "field", value: str = "value", units: str = "units") -> DataFrame:
    """Value and unit for display; fields without a rule keep theirs."""
    v, u = F.col(value), F.col(units)
    for name, factor, offset, unit in DISPLAY_UNITS:
        v = F.when(F.col(field) == name, F.col(value) * factor + offset).otherwise(v)
        u = F.when(F.col(field) == name, unit).otherwise(u)
    return df.withColumns({value: v, units: u})


def in_bounds(lat: Column, lon: Column, west: float, east: float, south: float, north: float) -> Column:
    """Inside bounds whose west may lie east of their east, over the date line; 359 degrees or more is all."""
    if east - west >= 359:
        return lat.between(south, north)
    return lat.between(south, north) & (F.pmod(lon - west, F.lit(360.0)) <= (east - west) % 360)


def crop_rect(df: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Cells of the index rectangle around those inside, with x and y counted from its corner.

    The rectangle of a key is four numbers; they are joined back by the key.
    """
    rect = df.where(inside).groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    near = df.join(rect, keys).where("x between x0 and x1 and y between y0 and y1")
    return near.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).drop("x0", "x1", "y0", "y1")


def crop_extent(df: DataFrame, keys: list[str], inside: Column, pad: int) -> DataFrame:
    """One row for each key: the padded index rectangle, and whether it is empty, full or a crop."""
    all_ = df.groupBy(*keys).agg(*(f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))), *(f(F.when(inside, F.col(c))).alias(f"i{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))))
    grow = {f"{c}_from": F.when(F.col(f"i{c}0").isNotNull(), F.greatest(F.col(f"i{c}0") - pad, F.col(f"{c}0"))) for c in "xy"} | {f"{c}_to": F.when(F.col(f"i{c}0").isNotNull(), F.least(F.col(f"i{c}1") + pad, F.col(f"{c}1"))) for c in "xy"}
    full = reduce(lambda a, b: a & b, [(F.col(f"{c}_from") == F.col(f"{c}0")) & (F.col(f"{c}_to") == F.col(f"{c}1")) for c in "xy"])
    return all_.withColumns(grow).select(*keys, *grow, F.when(F.col("ix0").isNull(), "empty").when(full, "full").otherwise("crop").alias("kind"))


def guard_cells(df: DataFrame, limit: int = HEAVY_CELLS) -> DataFrame:
    """``df``, or an error where it has more rows than the limit; at most limit + 1 rows are counted."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} cells")
    return df


def level_slice(levels: DataFrame, hpa: float, tolerance: float = 0.25) -> DataFrame:
    return levels.where(F.abs(F.col("p_hpa") - hpa) <= tolerance)


def threshold_hit(v: Column, op: Column, t: Column) -> Column:
    return F.when(op == "gte", v >= t).when(op == "gt", v > t).when(op == "lte", v <= t).when(op == "lt", v < t)


def mask_ge(v: Column, t: float) -> Column:
    return F.coalesce(v >= t, F.lit(False))


def mask_all(pairs: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a & b, [mask_ge(v, t) for v, t in pairs])


def mask_ratio(ratio: Column, cape: Column, ecape: Column) -> dict[str, Column]:
    """Low and high ratio plumes over floors of instability."""
    return {
        "ratio_low": F.coalesce(ratio < 0.75, F.lit(False)) & mask_ge(cape, 500),
        "ratio_high": mask_ge(ratio, 1.0) & mask_ge(cape, 250),
        "ratio_low_ecape": F.coalesce(ratio < 0.75, F.lit(False)) & mask_ge(ecape, 500),
    }


def mask_family(df: DataFrame, keys: list[str], fields: dict[str, tuple]) -> DataFrame:
    """Long table of masks: (keys, mask, hit), one mask for each field and threshold, named by both."""
    token = lambda t: f"{t:g}".replace(".", "p")
    masks = [F.struct(F.lit(f"{f}_{token(t)}").alias("mask"), mask_ge(F.col(f), t).alias("hit")) for f, ts in fields.items() for t in ts]
    return df.select(*keys, F.inline(F.array(*masks)))


def mrms_valid(v: Column, scale: float = 1.0) -> Column:
    return F.when((v > -990) & (v < 1e6), v * scale)


def level_bin(v: Column, thresholds: list[float], extend: str = "none") -> Column:
    """Index of the half-open bin, the last one closed; below and above where ``extend`` says so."""
    n = len(thresholds) - 1
    out = F.when(v.isNull(), None)
    if extend in ("below", "both"):
        out = out.when(v < thresholds[0], -1)
    for i in range(n):
        upper = (v <= thresholds[i + 1]) if i == n - 1 and extend not in ("above", "both") else (v < thresholds[i + 1])
        out = out.when((v >= thresholds[i]) & upper, i)
    if extend in ("above", "both"):
        out = out.when(v >= thresholds[n], n)
    return out


def ring_edges(polygons: DataFrame) -> DataFrame:
    """Edges of polygon rings (poly_id, ring, lat0, lon0, lat1, lon1) from their corners in order."""
    ring = polygons.groupBy("poly_id", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("c"))
    pairs = F.transform("c", lambda p, i: F.struct(p["lat"].alias("lat1"), p["lon"].alias("lon1"), F.get(F.col("c"), F.when(i == 0, F.size("c") - 1).otherwise(i - 1))["lat"].alias("lat0"), F.get(F.col("c"), F.when(i == 0, F.size("c") - 1).otherwise(i - 1))["lon"].alias("lon0")))
    return ring.select("poly_id", "ring", F.inline(pairs))


def polygon_shapes(polygons: DataFrame) -> DataFrame:
    """One row for each polygon: its rings as arrays of edges, the outer bounds and the first longitude."""
    e = ring_edges(polygons)
    ref = polygons.where("ring = 0").groupBy("poly_id").agg(F.min_by("lon", "seq").alias("ref"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    east = polygons.where("ring = 0").join(ref.select("poly_id", "ref"), "poly_id").groupBy("poly_id").agg(F.min(dlon(F.col("lon") - F.col("ref"))).alias("d0"), F.max(dlon(F.col("lon") - F.col("ref"))).alias("d1"))
    rings = e.groupBy("poly_id", "ring").agg(F.collect_list(F.struct("lat0", "lon0", "lat1", "lon1")).alias("edges")).groupBy("poly_id").agg(F.collect_list(F.struct("ring", "edges")).alias("rings"))
    return rings.join(ref, "poly_id").join(east, "poly_id")


def _in_ring(lat: Column, lon: Column, edges: Column) -> Column:
    """Boundary included, longitudes taken relative to the point."""

    def flags(e: Column) -> Column:
        x0, x1, y0, y1 = dlon(e["lon0"] - lon), dlon(e["lon1"] - lon), e["lat0"], e["lat1"]
        cross = (lat - y1) * (x0 - x1) + x1 * (y0 - y1)
        eps = 1e-9
        on = (F.abs(cross) <= eps) & (F.least(x0, x1) - eps <= 0) & (F.greatest(x0, x1) + eps >= 0) & (lat >= F.least(y0, y1) - eps) & (lat <= F.greatest(y0, y1) + eps)
        hit = ((y1 > lat) != (y0 > lat)) & (F.try_divide((x0 - x1) * (lat - y1), y0 - y1) + x1 > 0)
        return F.when(on, 1000).when(hit, 1).otherwise(0)

    total = F.aggregate(edges, F.lit(0), lambda acc, e: acc + flags(e))
    return (F.size(edges) >= 3) & ((total >= 1000) | (total % 2 == 1))


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """In the outer ring (its boundary too) and in no hole."""
    return F.exists(rings, lambda r: (r["ring"] == 0) & _in_ring(lat, lon, r["edges"])) & ~F.exists(rings, lambda r: (r["ring"] > 0) & _in_ring(lat, lon, r["edges"]))


def in_polygon_raycast(lat: Column, lon: Column, edges: Column) -> Column:
    """Plain ray cast over all edges, without a rule for boundaries or the date line."""
    hit = lambda e: ((e["lat1"] > lat) != (e["lat0"] > lat)) & (lon < F.try_divide((e["lon0"] - e["lon1"]) * (lat - e["lat1"]), e["lat0"] - e["lat1"] + 1e-12) + e["lon1"])
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(hit(e), 1).otherwise(0)) % 2 == 1


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, bucket: float = 2.0) -> DataFrame:
    """Cells joined with the polygons that hold their centre.

    Cells and the bounds of the outer rings meet in buckets of ``bucket``
    degrees of latitude and longitude (wrapped), so the join is an equality.
    """
    shapes = polygon_shapes(polygons)
    turns = int(360 // bucket)
    first, last = F.floor(F.pmod(F.col("ref") + F.col("d0"), F.lit(360.0)) / bucket), F.ceil((F.col("d1") - F.col("d0")) / bucket)
    tiles = shapes.withColumn("_bx", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.pmod(first + i, F.lit(turns)))))
    tiles = tiles.withColumn("_by", F.explode(F.sequence(F.floor(F.col("south") / bucket), F.floor(F.col("north") / bucket)))).drop("south", "north", "d0", "d1", "ref")
    placed = cells.withColumns({"_bx": F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / bucket), "_by": F.floor(F.col("lat") / bucket)})
    return placed.join(tiles, ["_bx", "_by"]).where(in_polygon(F.col("lat"), F.col("lon"), F.col("rings"))).drop("_bx", "_by", "rings")


def check_shape(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Keys whose number of rows is not the expected one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def clean_column(levels: Column) -> Column:
    """Levels of a sorted array kept while pressure falls and height rises, with dewpoint at or below temperature."""

    def keep(acc: Column, x: Column) -> Column:
        good = x["p"].isNotNull() & x["z"].isNotNull() & x["t"].isNotNull()
        fits = (F.size(acc) == 0) | ((x["p"] < F.get(acc, F.size(acc) - 1)["p"]) & (x["z"] > F.get(acc, F.size(acc) - 1)["z"]))
        new = F.struct(x["p"].alias("p"), x["z"].alias("z"), x["t"].alias("t"), F.when(x["td"].isNotNull(), F.least(x["td"], x["t"])).alias("td"))
        return F.when(good & fits, F.concat(acc, F.array(new))).otherwise(acc)

    return F.aggregate(levels, F.array().cast("array<struct<p:double,z:double,t:double,td:double>>"), keep)


def select_places(places: DataFrame, kind: str | None = None, group: str | None = None, slugs: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Places of a kind and group, among the slugs, with all of the tags."""
    out = places
    if kind:
        out = out.where(F.col("kind") == kind)
    if group:
        out = out.where(F.array_contains("groups", group))
    if slugs:
        out = out.where(F.col("slug").isin(slugs))
    if tags:
        out = out.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    return out
