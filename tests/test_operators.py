"""Closed-form values of operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.functions import wind as W
from cumula.operators import areas, components, filters, parcels, profile, radar, sampling, stencil, windows


def values(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_composite_indices(spark):
    got = values(
        spark,
        T.stp_fixed(*lit(1500, 500, 150, 20)), T.stp_fixed(*lit(1500, 1000, 150, 12)), T.stp_fixed(*lit(1500, 1000, 150, 40)),
        T.stp_effective(*lit(1500, 1000, 150, 10, -50)), T.stp_effective(*lit(1500, 1000, 150, 20, -50)), T.stp_effective(*lit(1500, 1000, 150, 20, -250)), T.stp_effective(*lit(1500, 1000, 150, 40, -50)),
        T.scp(*lit(3000, 150, 8)), T.scp(*lit(3000, 150, 20)), T.scp(*lit(3000, 150, 30)),
        T.ship(*lit(2000, 20, -15, 7, 10)), T.ship(*lit(1000, 20, -15, 7, 10)), T.ship(*lit(2000, 20, 5, 7, 10)),
        T.bri(*lit(2000, 20)), T.bri(*lit(500, 30)), T.bri(*lit(1000, 0.1)), T.ehi(*lit(2000, 200)),
    )
    assert got == pytest.approx([1.0, 0.0, 1.5, 0, 1, 0, 1.5, 0, 9, 9, 1.0, 0.384615384615, 0.0, 10, 1.111111111, 0, 2.5])


def test_missing_stays_missing(spark):
    none = F.lit(None).cast("double")
    assert values(spark, T.dewpoint_q(F.lit(1000.0), none), T.rh_q(none, F.lit(1000.0), F.lit(0.01)), T.vpd_td(none, none), T.clamp(none, 0, 1), W.wind_speed(none, F.lit(1.0)), filters.mrms_valid(F.lit(-999.0))) == [None] * 6
    assert 18 < values(spark, T.dewpoint_q(F.lit(1000.0), F.lit(0.014)))[0] < 21


def test_wet_bulb_lies_between(spark):
    got, = values(spark, T.wetbulb(*lit(950, 30, 10)))
    assert 10 < got < 30


def test_section_wind_and_beam(spark):
    along, left = W.section_wind(F.lit(10.0), F.lit(3.0), F.lit(90.0))
    assert values(spark, along, left) == pytest.approx([10, 3])
    assert values(spark, W.norm_lon(F.lit(190.0)), W.dlon(F.lit(-190.0)), W.az_diff(F.lit(350.0), F.lit(10.0))) == pytest.approx([-170, 170, 20])


@pytest.fixture(scope="module")
def square(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 1.0, 10.0), (2, 2, 1.0, 0.0, 20.0), (3, 3, 1.0, 1.0, 30.0)]
    return spark.createDataFrame([(0, g, x, lat, lon, v) for g, x, lat, lon, v in rows], "run long, grid_index long, x long, lat double, lon double, value double")


def test_nearest_and_inverse_distance(spark, square):
    pts = spark.createDataFrame([(1, 0.95, 0.95), (2, 0.5, 0.5), (3, 1.0, 0.0)], "point_id long, plat double, plon double")
    near = {r.point_id: (r.grid_index, r.value) for r in sampling.sample_nearest(square, square, pts, ["run"]).collect()}
    assert near[1] == (3, 30.0)
    idw = {r.point_id: r for r in sampling.sample_idw4(square, square, pts, ["run"]).collect()}
    assert idw[2].value == pytest.approx(15, abs=1e-3) and sum(c.weight for c in idw[2].contributors) == pytest.approx(1)
    assert idw[3].value == 20.0 and len(idw[3].contributors) == 1


def test_nearest_is_exact_far_from_cells(spark, square):
    pts = spark.createDataFrame([(1, 40.0, -170.0), (2, -60.0, 179.0)], "point_id long, plat double, plon double")
    got = {r.point_id: r.grid_index for r in sampling.k_nearest(square, pts, 1).collect()}
    assert len(got) == 2
    assert sampling.k_nearest(square, pts.limit(0), 1).count() == 0


def test_area_with_hole_and_missing(spark):
    cells = spark.createDataFrame([(0, i, float(i // 3), float(i % 3), None if i == 2 else float(i + 1)) for i in range(6)], "run long, grid_index long, lat double, lon double, value double")
    ring = lambda p, r, a, b: [(p, r, i, y, x) for i, (y, x) in enumerate(((a, a), (a, b), (b, b), (b, a)))]
    polys = spark.createDataFrame(ring(1, 0, -0.5, 1.5) + ring(2, 0, -0.5, 2.5) + ring(2, 1, 0.8, 1.2), "poly_id long, ring long, seq long, lat double, lon double")
    got = {r.poly_id: r for r in areas.summarize_area(cells, cells, polys, ["run"]).collect()}
    assert (got[1].included, got[1].valid, got[1].missing, got[1].min, got[1].max, got[1].mean) == (4, 4, 0, 1.0, 5.0, 3.0)
    assert (got[2].included, got[2].missing) == (5, 1)


def test_polygon_over_the_date_line(spark):
    cells = spark.createDataFrame([(0, 1, -20.0, 178.0), (0, 2, -20.0, -178.0), (0, 3, -20.0, -120.0)], "run long, grid_index long, lat double, lon double")
    polys = spark.createDataFrame([(1, 0, i, y, x) for i, (y, x) in enumerate(((-25.0, 170.0), (-25.0, -175.0), (-10.0, -175.0), (-10.0, 170.0)))], "poly_id long, ring long, seq long, lat double, lon double")
    assert {r.grid_index for r in filters.cells_in_polygons(cells, polys).collect()} == {1, 2}
    inside = filters.in_bounds(F.col("lat"), F.col("lon"), 170.0, -175.0, -25.0, -10.0)
    assert {r.grid_index for r in cells.where(inside).collect()} == {1, 2}


def test_compare_golden(spark):
    pairs = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 4.0), (0, 3.0, 3.0), (0, 4.0, 8.0), (0, None, 1.0)], "run long, a double, b double")
    r = areas.compare_stats(pairs, ["run"]).first()
    assert (r.compared, r.changed, r.min_diff, r.max_diff, r.mean_signed, r.mean_abs) == (4, 2, 0, 4, 1.5, 1.5)
    flat = pairs.where("a is not null").withColumn("a", F.lit(1.0))
    assert areas.validate_native(flat, ["run"], 1, 2).first().r == 0.0


def test_windows(spark):
    hours = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (1, 1, 2.0), (1, 2, None)], "grid_index long, fhr long, value double")
    got = {r.grid_index: r for r in windows.window_reduce(hours, ["grid_index"], [1, 2]).collect()}
    assert got[0].sum == 1.5 and got[1].sum is None and got[1].max == 2.0
    rain = spark.createDataFrame([(0, h, 12.7) for h in range(1, 7)], "grid_index long, fhr long, value double")
    direct = spark.createDataFrame([(0, 6, 25.4)], "grid_index long, fhr long, mm double")
    q = {r.fhr: r for r in windows.qpf(rain, direct, ["grid_index"], 6).collect()}
    assert (q[6].qpf_in, q[6].strategy, q[6].hours) == (1.0, "direct", [6]) and q[5].strategy == "blocked"
    q = {r.fhr: r for r in windows.qpf(rain, direct.limit(0), ["grid_index"], 6).collect()}
    assert q[6].qpf_in == pytest.approx(3.0) and q[6].hours == [1, 2, 3, 4, 5, 6]


def test_land_objects(spark):
    water = {0, 1, 5, 6, 14, 18, 19, 23, 24}
    land = spark.createDataFrame([(0, i // 5, i % 5, i, 16 if i in water else 1) for i in range(25)], "run long, y long, x long, grid_index long, lu_index int")
    assert {r.grid_index for r in components.small_water(land, ["run"], 1.0, 4.1).collect()} == {0, 1, 5, 6}
    assert components.small_water(land, ["run"], 1.0, 4.0).count() == 0
    corner = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 6)], "run long, y long, x long, grid_index long")
    assert components.components(corner, ["run"]).select("label").distinct().count() == 1
    assert components.components(corner, ["run"], diagonal=False).select("label").distinct().count() == 2
    assert components.components(corner.limit(0), ["run"]).count() == 0


def test_ring_fill(spark):
    cells = spark.createDataFrame([(0, i // 3, i % 3, 100.0 if i == 4 else float(i + 1), i == 4) for i in range(9)], "run long, y long, x long, value double, masked boolean")
    want = sum(v / d for v, d in zip((1, 2, 3, 4, 6, 7, 8, 9), (2**0.5, 1, 2**0.5, 1, 1, 2**0.5, 1, 2**0.5), strict=True)) / (4 + 4 / 2**0.5)
    assert stencil.fill_masked(cells, ["run"]).where("masked").first().value == pytest.approx(want)
    far = spark.createDataFrame([(0, 0, 0, 5.0, False), (0, 0, 40, 0.0, True)], "run long, y long, x long, value double, masked boolean")
    assert stencil.fill_masked(far, ["run"]).where("masked").first().value == 5.0
    alone = far.withColumn("masked", F.lit(True))
    assert {r.value for r in stencil.fill_masked(alone, ["run"]).collect()} == {5.0, 0.0}


def test_saddle_and_bands(spark):
    cell = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 0.0), (0, 1, 1, 2.0), (0, 1, 0, 0.5)], "run long, y long, x long, value double")
    seg = {tuple(round(v, 3) for v in (r.x0, r.y0, r.x1, r.y1)) for r in stencil.isolines(cell, ["run"], "value", [1.0]).collect()}
    assert seg == {(0.0, 0.667, 0.333, 1.0), (0.5, 0.0, 1.0, 0.5)}
    flat = cell.withColumn("value", F.lit(1.0))
    bands = stencil.band_areas(flat, ["run"], "value", [0.0, 1.0, 2.0]).collect()
    assert [(r.bin, r.area) for r in bands] == [(1, 1.0)]


def test_radial_unfold(spark):
    vel = [10.0, 12.0, 14.0, -14.0, -12.0, -10.0]
    g = spark.createDataFrame([(0, 0, 0, i, v) for i, v in enumerate(vel)], "volume long, sweep long, az long, gate long, vel double")
    assert [r.vel for r in radar.dealias_sweeps(g, 15.0, 0).orderBy("gate").collect()] == [10, 12, 14, 16, 18, 20]
    rows = [(0, 0, a, i, v) for a, r in enumerate(([9.0, 11.0, 13.0], [10.0, 12.0, -14.0], [11.0, 13.0, 15.0])) for i, v in enumerate(r)]
    fixed = radar.dealias_sweeps(spark.createDataFrame(rows, "volume long, sweep long, az long, gate long, vel double"), 15.0)
    assert fixed.where("az = 1 and gate = 2").first().vel == 16.0


def test_parcels_on_the_six_level_column(spark):
    p, t, q = (950, 900, 850, 700, 500, 300), (26, 22, 18, 8, -10, -38), (0.016, 0.013, 0.010, 0.005, 0.0015, 0.0003)
    z, u, v = (150, 800, 1500, 3000, 5600, 9200), (6, 9, 12, 18, 26, 33), (2, 5, 8, 13, 20, 28)
    rows = [(1, *map(float, r)) for r in zip(p, t, q, z, u, v, strict=True)]
    lv = spark.createDataFrame([*rows, *((2, *r[1:]) for r in rows[:2])], "c long, p_hpa double, t_c double, q double, z_m double, u double, v double")
    got = {(r.c, r.kind): r for r in parcels.parcel(lv, ["c"]).collect()}
    sb = got[1, "sb"]
    assert sb.cape > 500 and sb.cin <= 0 and 150 <= sb.lcl_m < 3000 and sb.lifted_index < 0 and sb.ecape >= 0 and not sb.failed
    assert got[1, "mu"].cape >= sb.cape * 0.99
    assert got[2, "sb"].failed
    assert profile.violations(lv.withColumn("k", -F.col("p_hpa")), ["c"]).count() == 0


def test_column_cleaning(spark):
    rows = [(1, [(1000.0, 0.0, 20.0, 25.0), (990.0, None, 19.0, 10.0), (1010.0, 50.0, 19.0, 10.0), (900.0, 900.0, 15.0, 5.0), (850.0, 800.0, 12.0, 1.0)])]
    lv = spark.createDataFrame(rows, "c long, lv array<struct<p:double,z:double,t:double,td:double>>")
    got = lv.select(filters.clean_column(F.col("lv")).alias("x")).first().x
    assert [(r.p, r.td) for r in got] == [(1000.0, 20.0), (900.0, 5.0)]


def test_place_tags(spark):
    p = spark.createDataFrame([("a", "metro", ["g"], ["x", "y"]), ("b", "metro", ["g"], ["x"])], "slug string, kind string, groups array<string>, tags array<string>")
    assert [r.slug for r in filters.select_places(p, "metro", "g", None, ["x", "y"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="more than 1"):
        filters.guard_cells(p, 1)
