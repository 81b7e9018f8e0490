"""Differences between neighbouring cells, fills, contour lines and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

OMEGA = 7.292e-5


def gradient(cells: DataFrame, keys: list[str], value: str, dx_m: float, dy_m: float) -> DataFrame:
    """``cells`` with d_x and d_y: centred differences, one-sided at edges and gaps of the grid."""

    def slope(order: str, other: str, step: float) -> Column:
        w = Win.partitionBy(*keys, other).orderBy(order)
        near = lambda f, d: F.when(f(order).over(w) == F.col(order) + d, f(value).over(w))
        here = lambda f, d: F.coalesce(f(order).over(w) == F.col(order) + d, F.lit(False))
        after, before, v = near(F.lead, 1), near(F.lag, -1), F.col(value)
        return F.when(here(F.lead, 1) & here(F.lag, -1), (after - before) / (2 * step)).when(here(F.lead, 1), (after - v) / step).when(here(F.lag, -1), (v - before) / step)

    return cells.withColumns({"d_x": slope("x", "y", dx_m), "d_y": slope("y", "x", dy_m)})


def temperature_advection(cells: DataFrame, keys: list[str], dx_m: float, dy_m: float) -> DataFrame:
    """``cells`` (t_c, u, v) with the advection of temperature in K per hour."""
    g = gradient(cells, keys, "t_c", dx_m, dy_m)
    return g.withColumn("advection", -(F.col("u") * F.col("d_x") + F.col("v") * F.col("d_y")) * 3600).drop("d_x", "d_y")


def vorticity(cells: DataFrame, keys: list[str], dx_m: float, dy_m: float) -> DataFrame:
    """``cells`` (u, v, lat) with relative and absolute vorticity."""
    u = gradient(cells, keys, "u", dx_m, dy_m).withColumnRenamed("d_y", "_uy").drop("d_x")
    v = gradient(u, keys, "v", dx_m, dy_m)
    return v.withColumn("rel_vort", F.col("d_x") - F.col("_uy")).withColumn("abs_vort", F.col("rel_vort") + 2 * OMEGA * F.sin(F.radians("lat"))).drop("d_x", "d_y", "_uy")


def destagger(cells: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """Means of neighbours along an axis, one fewer than the cells of a line."""
    w = Win.partitionBy(*keys, *(a for a in ("y", "x", "k") if a != axis and a in cells.columns)).orderBy(axis)
    return cells.withColumn("_n", F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(value).over(w))).where("_n is not null").withColumn(value, (F.col(value) + F.col("_n")) / 2).drop("_n")


def rotate_lon(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Longitudes brought to -180 to 180 and x numbered anew from west to east."""
    from cumula.functions.wind import norm_lon

    own = cells.withColumn("lon", norm_lon(F.col("lon")))
    return own.withColumn("x", (F.row_number().over(Win.partitionBy(*keys, "y").orderBy("lon")) - 1).cast("long"))


def fill_masked(cells: DataFrame, keys: list[str], reach: int = 8) -> DataFrame:
    """``cells`` (masked, value) with masked ones filled from the nearest square ring that has others.

    The fill is the mean weighted by 1 over distance in cells. Rings are looked
    up to ``reach``; cells for which none is found look on over all rings, so a
    key without any unmasked cell alone stays unchanged.
    """
    open_ = cells.where("not masked and value is not null").select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("value").alias("v2"))
    hole = cells.where("masked").select(*keys, "y", "x")

    def fill(holes: DataFrame, near: DataFrame) -> DataFrame:
        ring = F.greatest(F.abs(F.col("y2") - F.col("y")), F.abs(F.col("x2") - F.col("x")))
        least = F.min(ring).over(Win.partitionBy(*keys, "y", "x"))
        d = F.sqrt((F.col("y2") - F.col("y")) ** 2 + (F.col("x2") - F.col("x")) ** 2)
        own = near.withColumn("_ring", ring).withColumn("_least", least).where("_ring = _least").withColumn("_w", 1 / d)
        return own.groupBy(*keys, "y", "x").agg((F.sum(F.col("v2") * F.col("_w")) / F.sum("_w")).alias("_fill"))

    bucket = reach
    tiles = hole.select("*", F.inline(F.array(*(F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))))
    tiles = tiles.withColumns({"_by": F.floor(F.col("y") / bucket) + F.col("_a"), "_bx": F.floor(F.col("x") / bucket) + F.col("_b")}).drop("_a", "_b")
    placed = open_.withColumns({"_by": F.floor(F.col("y2") / bucket), "_bx": F.floor(F.col("x2") / bucket)})
    close = tiles.join(placed, [*keys, "_by", "_bx"]).where(F.greatest(F.abs(F.col("y2") - F.col("y")), F.abs(F.col("x2") - F.col("x"))) <= bucket)
    first = fill(hole, close)
    far = hole.join(first.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    rest = fill(far, far.join(open_, keys))
    return cells.join(first.unionByName(rest), [*keys, "y", "x"], "left").withColumn("value", F.coalesce("_fill", "value")).drop("_fill")


def corners(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, y, x, a, b, c, d): values of cell (y, x) and of its right, upper right and upper neighbours."""
    row = Win.partitionBy(*keys, "y").orderBy("x")
    r = cells.select(*keys, "y", "x", F.col(value).alias("a"), F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead(value).over(row)).alias("b"))
    col = Win.partitionBy(*keys, "x").orderBy("y")
    up = lambda c: F.when(F.lead("y").over(col) == F.col("y") + 1, F.lead(c).over(col))
    return r.select("*", up("b").alias("c"), up("a").alias("d")).where("a is not null and b is not null and c is not null and d is not null")


def isolines(cells: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """Line pieces (keys, level, y, x, x0, y0, x1, y1) of each square of four cells; a saddle follows the centre's mean.

    Sides are 0 (lower), 1 (right), 2 (upper), 3 (left); places count in cells.
    """
    sq = corners(cells, keys, value).withColumn("level", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    lv, (a, b, c, d) = F.col("level"), (F.col(n) for n in "abcd")
    case = (a >= lv).cast("int") + (b >= lv).cast("int") * 2 + (c >= lv).cast("int") * 4 + (d >= lv).cast("int") * 8
    high = (a + b + c + d) / 4 >= lv
    pair = lambda *s: F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in s))
    # Sides that the line joins, by which corners reach the level.
    joins = {1: (3, 0), 2: (0, 1), 3: (3, 1), 4: (1, 2), 6: (0, 2), 7: (3, 2), 8: (2, 3), 9: (0, 2), 11: (1, 2), 12: (3, 1), 13: (0, 1), 14: (3, 0)}
    sides = F.when(case == 5, F.when(high, pair((3, 2), (0, 1))).otherwise(pair((3, 0), (1, 2)))).when(case == 10, F.when(high, pair((3, 0), (1, 2))).otherwise(pair((0, 1), (2, 3))))
    for k, s in joins.items():
        sides = sides.when(case == k, pair(s))
    seg = sq.withColumn("s", F.explode(sides))
    cut = lambda p, q: F.try_divide(lv - p, q - p)
    px = lambda s: F.when(s == 0, F.col("x") + cut(a, b)).when(s == 1, F.col("x") + 1.0).when(s == 2, F.col("x") + cut(d, c)).otherwise(F.col("x") + 0.0)
    py = lambda s: F.when(s == 0, F.col("y") + 0.0).when(s == 1, F.col("y") + cut(b, c)).when(s == 2, F.col("y") + 1.0).otherwise(F.col("y") + cut(a, d))
    return seg.select(*keys, "level", "y", "x", px(F.col("s.p")).alias("x0"), py(F.col("s.p")).alias("y0"), px(F.col("s.q")).alias("x1"), py(F.col("s.q")).alias("y1"))


def band_areas(cells: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """(keys, y, x, bin, area): share of each square in each bin, by four triangles around its centre.

    Within a triangle the value is linear, so the area over a level is exact;
    values at the last threshold belong to the last bin.
    """
    sq = corners(cells, keys, value)
    a, b, c, d = (F.col(n) for n in "abcd")
    centre = (a + b + c + d) / 4
    tri = sq.select(*keys, "y", "x", F.explode(F.array(*(F.array_sort(F.array(p, q, centre)) for p, q in ((a, b), (b, c), (c, d), (d, a))))).alias("t"))
    l, m, h = (F.get("t", F.lit(i)) for i in range(3))

    def over(level: float, closed: bool) -> Column:
        top = (h >= level) if closed else (h > level)
        two = F.try_divide((h - level) * (h - level), (h - l) * (h - m))
        one = 1 - F.try_divide((level - l) * (level - l), (h - l) * (m - l))
        flat = F.when(l >= level, 1.0)
        return F.coalesce(flat, F.when(~top, 0.0).when(m <= level, two).otherwise(one), F.lit(0.0)) / 4

    n = len(thresholds) - 1
    full = [over(t, True) for t in thresholds]
    end = F.when(l > thresholds[n], 0.25).otherwise(F.when(h == l, 0.0).otherwise(full[n]))
    parts = F.array(*(F.struct(F.lit(i).alias("bin"), (full[i] - (full[i + 1] if i < n - 1 else end)).alias("area")) for i in range(n)))
    return tri.select(*keys, "y", "x", F.inline(parts)).groupBy(*keys, "y", "x", "bin").agg(F.sum("area").alias("area")).where("area > 1e-12")
