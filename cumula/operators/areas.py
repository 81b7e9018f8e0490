"""Summaries of cells by area, mask, key and pair of fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from cumula.functions.wind import haversine
from cumula.operators.filters import cells_in_polygons


def membership(grid: DataFrame, polygons: DataFrame) -> DataFrame:
    """(grid_index, poly_id) of a grid's cells: found once for all fields and hours of the grid."""
    return cells_in_polygons(grid.select("grid_index", "lat", "lon").distinct(), polygons).select("grid_index", "poly_id")


def summarize(values: DataFrame, keys: list[str]) -> DataFrame:
    """Included, valid and missing cells, least, greatest and mean value."""
    return values.groupBy(*keys).agg(F.count("*").alias("included"), F.count("value").alias("valid"), (F.count("*") - F.count("value")).alias("missing"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def summarize_area(values: DataFrame, grid: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """``summarize`` for each key and polygon."""
    return summarize(values.join(membership(grid, polygons), "grid_index"), [*keys, "poly_id"])


def patch_stats(values: DataFrame, keys: list[str], extra: tuple[float, ...] = ()) -> DataFrame:
    """Count, least, greatest, mean and exact percentiles (linear between ranks)."""
    qs = (0.1, 0.25, 0.5, 0.75, 0.9, *extra)
    got = values.groupBy(*keys).agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.percentile("value", F.array(*map(F.lit, qs))).alias("p"))
    return got.select(*keys, "count", "min", "max", "mean", *(F.get("p", F.lit(i)).alias(f"p{round(q * 100)}") for i, q in enumerate(qs)))


def threshold_counts(values: DataFrame, keys: list[str], hits: dict[str, Column]) -> DataFrame:
    """Hits and their share of the valid cells, null where none is valid."""
    sums = [F.sum(F.coalesce(h, F.lit(False)).cast("long")).alias(f"n_{n}") for n, h in hits.items()]
    got = values.groupBy(*keys).agg(F.count("value").alias("valid"), *sums)
    return got.select("*", *(F.try_divide(F.col(f"n_{n}"), F.col("valid")).alias(f"share_{n}") for n in hits))


def compare_stats(pairs: DataFrame, keys: list[str], changed: float = 1e-9) -> DataFrame:
    """Right less left over pairs (a, b) of which both are there."""
    d = F.col("b") - F.col("a")
    both = pairs.where("a is not null and b is not null")
    return both.groupBy(*keys).agg(F.count("*").alias("compared"), F.sum((F.abs(d) > changed).cast("long")).alias("changed"), F.min(d).alias("min_diff"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_signed"), F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"))


def validate_native(pairs: DataFrame, keys: list[str], accept: float, review: float) -> DataFrame:
    """Native (a) less derived (b): correlation (0 without variance), errors, means and a verdict by the mean absolute error."""
    a, b = F.col("a"), F.col("b")
    m = pairs.where("a is not null and b is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a).alias("mean_native"), F.avg(b).alias("mean_derived"), F.avg(a * b).alias("_ab"), F.var_pop(a).alias("_va"), F.var_pop(b).alias("_vb"), F.avg(a - b).alias("mean_signed"), F.avg(F.abs(a - b)).alias("mean_abs"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), F.max(F.abs(a - b)).alias("max_abs"))
    r = F.coalesce(F.try_divide(F.col("_ab") - F.col("mean_native") * F.col("mean_derived"), F.when(F.col("_va") * F.col("_vb") > 0, F.sqrt(F.col("_va") * F.col("_vb")))), F.lit(0.0))
    verdict = F.when(F.col("mean_abs") <= accept, "pass").when(F.col("mean_abs") <= review, "review").otherwise("reject")
    return m.select("*", r.alias("r"), verdict.alias("verdict")).drop("_ab", "_va", "_vb")


#: Accuracy of the sketch that brackets an order statistic, and values of a group up to which all of them are ranked.
SKETCH, RANKED = 10_000, 100_000


def order_statistics(values: DataFrame, keys: list[str], shares: dict[str, float], place: Callable[[Column, float], Column]) -> DataFrame:
    """``keys``, n, mean, min, max and a column for each of ``shares``: the value at its exact place, from 1, in the order of a group's values.

    ``place`` makes a place of n and a share. A mergeable sketch of each group brackets
    every place by values a few ten-thousandths of the group away; what lies below a
    bracket is counted, and only distinct values inside it are ranked, with their
    numbers. So no group is sorted or held whole, whatever its distribution; groups up to
    ``RANKED`` values are ranked whole. Null values count nowhere.
    """
    own, names = values.where("value is not null").select(*keys, "value"), list(shares)
    edge = 3 / SKETCH
    probes = [x for q in shares.values() for x in (max(0.0, q - edge), min(1.0, q + edge))]
    g = own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile_approx("value", F.array(*map(F.lit, probes)), SKETCH).alias("_p"))
    small = F.col("n") <= RANKED
    brackets = F.array(*(F.struct(F.lit(j).alias("j"), F.when(small, F.col("min")).otherwise(F.get("_p", F.lit(2 * j))).alias("lo"), F.when(small, F.col("max")).otherwise(F.get("_p", F.lit(2 * j + 1))).alias("hi"), place(F.col("n"), q).cast("long").alias("at")) for j, q in enumerate(shares.values())))
    g = g.withColumn("_b", brackets).drop("_p")
    near = own.join(g.select(*keys, "_b"), keys)
    below = near.groupBy(*keys).agg(*(F.count_if(F.col("value") < F.col("_b")[j]["lo"]).alias(f"_u{j}") for j in range(len(names))))
    inside = near.select(*keys, "value", F.explode(F.filter("_b", lambda b: F.col("value").between(b["lo"], b["hi"]))).alias("b")).groupBy(*keys, F.col("b.j").alias("j"), "value").agg(F.count("*").alias("c"))
    ranked = inside.withColumn("upto", F.sum("c").over(Win.partitionBy(*keys, "j").orderBy("value").rowsBetween(Win.unboundedPreceding, 0)))
    at = F.element_at(F.col("_b"), F.col("j") + 1)["at"] - F.get(F.array(*(F.col(f"_u{j}") for j in range(len(names)))), F.col("j"))
    hit = ranked.join(g.select(*keys, "_b").join(below, keys), keys).where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at))
    got = hit.groupBy(*keys).agg(*(F.max(F.when(F.col("j") == j, F.col("value"))).alias(n) for j, n in enumerate(names)))
    return g.drop("_b").join(got, keys)


def field_summary_rounded(values: DataFrame, keys: list[str]) -> DataFrame:
    """Values at the rounded places of their order, without interpolation; see ``order_statistics``."""
    shares = {f"p{round(q * 100):02d}": q for q in (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)}
    got = order_statistics(values, keys, shares, lambda n, q: F.round((n - 1) * q) + 1)
    return got.select(*keys, F.col("n").alias("count"), "mean", *shares)


def stats_by_mask(fields: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Ten numbers of each field over all cells ('all') and over each mask's cells.

    ``fields`` is (keys, grid_index, field, value), ``masks`` (keys, grid_index, mask, hit).
    """
    own = masks.where("hit").select(*keys, "grid_index", "mask")
    long = fields.withColumn("mask", F.lit("all")).unionByName(fields.join(own, [*keys, "grid_index"]), allowMissingColumns=True)
    qs = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    got = long.where("value is not null").groupBy(*keys, "field", "mask").agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.percentile("value", F.array(*map(F.lit, qs))).alias("p"))
    return got.select(*keys, "field", "mask", "count", "min", "mean", "max", *(F.get("p", F.lit(i)).alias(f"p{round(q * 100)}") for i, q in enumerate(qs)))


def grid_spacing(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance between neighbours along rows and columns, in km."""
    row, col = Win.partitionBy(*keys, "y").orderBy("x"), Win.partitionBy(*keys, "x").orderBy("y")
    step = lambda w, i: F.when(F.lead(i).over(w) == F.col(i) + 1, haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w)))
    return grid.select(*keys, step(row, "x").alias("dx"), step(col, "y").alias("dy")).groupBy(*keys).agg(F.avg("dx").alias("dx_km"), F.avg("dy").alias("dy_km"))


def cell_area(grid: DataFrame, keys: list[str], stride: int = 1) -> DataFrame:
    """Median area of a cell, from the spacing at every ``stride``-th row and column."""
    row, col = Win.partitionBy(*keys, "y").orderBy("x"), Win.partitionBy(*keys, "x").orderBy("y")
    dx = haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(row), F.lead("lon").over(row))
    dy = haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(col), F.lead("lon").over(col))
    return grid.select(*keys, "x", "y", (dx * dy).alias("a")).where((F.col("x") % stride == 0) & (F.col("y") % stride == 0)).groupBy(*keys).agg(F.percentile("a", F.lit(0.5)).alias("cell_km2"))


def channel_stats(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"), F.count("value").alias("count"), F.sum(F.col("value").isNull().cast("long")).alias("nan_count"))


def grid_summary(grid: DataFrame, keys: list[str], cell_km2: float) -> DataFrame:
    return grid.groupBy(*keys).agg(F.count("*").alias("cells"), (F.count("*") * cell_km2).alias("area_km2"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def lon_bounds(points: DataFrame, keys: list[str], lon: str = "lon") -> DataFrame:
    """Shortest longitude arc that holds all points: the complement of the largest gap."""
    x = points.where(F.col(lon).isNotNull()).select(*keys, F.pmod(F.col(lon), F.lit(360.0)).alias("x")).distinct()
    w = Win.partitionBy(*keys).orderBy("x")
    nxt = F.coalesce(F.lead("x").over(w), F.min("x").over(Win.partitionBy(*keys)) + 360)
    gaps = x.select(*keys, "x", nxt.alias("n"), (nxt - F.col("x")).alias("gap"))
    best = gaps.groupBy(*keys).agg(F.max(F.struct("gap", (-F.col("x")).alias("minus"), "n")).alias("_best"))
    west, east = F.pmod(F.col("_best.n"), F.lit(360.0)), -F.col("_best.minus")
    return best.select(*keys, F.when(west >= 180, west - 360).otherwise(west).alias("west"), F.when(east >= 180, east - 360).otherwise(east).alias("east"))
