"""Joins by coordinates across the date line, points without coordinates, and places that crowd, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cumula.operators import components as G
from cumula.operators import places as P
from cumula.operators import sampling as S

CELLS = "grid_index long, lat double, lon double"
POINTS = "point_id long, plat double, plon double"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(x)))


@pytest.fixture(scope="module")
def globe(spark):
    rnd = random.Random(5)
    lons = [179.95, -179.95, 180.0, -180.0, 179.5, -179.2, 0.02, -0.02, 359.9, 200.0]
    cells = [(i, rnd.uniform(-80, 80) if i % 3 else rnd.uniform(-1, 1), rnd.choice(lons) + rnd.uniform(-0.3, 0.3)) for i in range(250)]
    points = [(i, rnd.uniform(-2, 2), rnd.choice(lons)) for i in range(40)] + [(90, None, 1.0), (91, 1.0, None), (92, float("nan"), 0.0)]
    return cells, points, spark.createDataFrame(cells, CELLS), spark.createDataFrame(points, POINTS)


def test_boxes_cross_the_date_line(globe):
    cells, points, c, p = globe
    got = {(r.point_id, r.grid_index) for r in S.box_cells(c, p, 60.0).collect()}
    half, want = 60.0 / 111, set()
    for i, lat, lon in points[:40]:
        wide = half / max(abs(math.cos(math.radians(lat))), 0.2)
        want |= {(i, k) for k, y, x in cells if abs(y - lat) <= half and abs((x - lon + 180) % 360 - 180) <= wide}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("great_circle", [False, True])
def test_nearest_around_the_globe_and_without_coordinates(globe, great_circle):
    cells, points, c, p = globe
    got = {}
    for r in S.k_nearest(c, p, 3, km=great_circle).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.grid_index))

    def score(lat, lon, y, x):
        if great_circle:
            return km((lat, lon), (y, x))
        return (y - lat) ** 2 + (((x - lon + 180) % 360 - 180) * max(abs(math.cos(math.radians(lat))), 0.2)) ** 2

    for i, lat, lon in points:
        if i >= 90:
            assert got[i] == [(None, None)]
        else:
            near = sorted((score(lat, lon, y, x), k) for k, y, x in cells)[:3]
            assert [k for _, k in sorted(got[i])] == [k for _, k in near]


def test_samplers_keep_points_without_coordinates(globe):
    _, points, c, p = globe
    values = c.select(F.lit(7).alias("run"), "grid_index", F.col("lat").alias("value"))
    for df in (S.sample_nearest(values, c, p, ["run"]), S.sample_idw4(values, c, p, ["run"]), S.sample_box_mean(values, c, p, ["run"], 30.0)):
        rows = df.collect()
        assert len(rows) == len(points)
        assert {r.point_id for r in rows if r.value is None} == {90, 91, 92}
    assert S.sample_nearest(values.limit(0), c.limit(0), p, ["run"]).count() == 3


def test_points_far_from_every_cell_end_soon(spark):
    c = spark.createDataFrame([(1, 40.0, -100.0), (2, 40.1, -100.0), (3, 40.0, -99.9)], CELLS)
    p = spark.createDataFrame([(1, -60.0, 80.0), (2, 89.9, 10.0)], POINTS)
    assert sorted((r.point_id, r.grid_index) for r in S.k_nearest(c, p, 5, km=True).collect()) == [(i, k) for i in (1, 2) for k in (1, 2, 3)]


def test_pairs_and_reports_across_the_date_line(spark):
    pts = [(1, 1, 0.0, 179.95), (1, 2, 0.0, -179.95), (1, 3, 0.05, 180.0), (1, 4, 0.0, 178.0), (2, 5, 0.0, 179.95), (1, 6, None, 179.95), (1, 7, 85.0, 100.0), (1, 8, 85.0, 100.5)]
    df = spark.createDataFrame(pts, "seg long, id long, lat double, lon double")
    got = {(r.a, r.b) for r in G.distance_pairs(df, ["seg"], 12.0).collect()}
    want = {(a[1], b[1]) for a in pts for b in pts if a[1] < b[1] and a[0] == b[0] and None not in (a[2], b[2]) and km(a[2:], b[2:]) <= 12}
    assert got == want and (1, 2) in got
    mask = spark.createDataFrame([(1, 10.0, 179.95), (1, 40.0, 0.0)], "run long, lat double, lon double")
    reports = spark.createDataFrame([(1, "hail", 10.0, -179.95), (2, "wind", None, 0.0), (3, "wind", 40.0, 0.5)], "report_id long, report_type string, rlat double, rlon double")
    near = {r.report_id: r.km for r in G.report_overlap(mask, reports, ["run"]).collect()}
    assert near[1] == pytest.approx(10.95, abs=0.05) and near[2] == 999.0 and near[3] == pytest.approx(42.6, abs=0.1)


def overlap(a, b):
    def area(w, e, s, n):
        return abs(e - w) * max(abs(math.cos(math.radians((s + n) / 2))), 0.25) * 111.32 * abs(n - s) * 111.32

    w, e, s, n = max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3])
    return 0.0 if e <= w or n <= s else min(1.0, area(w, e, s, n) / max(1.0, min(area(*a), area(*b))))


@pytest.mark.parametrize(("spacing", "share", "most"), [(50.0, None, None), (0.0, 0.2, None), (80.0, 0.5, 4), (30.0, 0.0, 1)])
def test_places_that_crowd_equal_a_fold(spark, spacing, share, most):
    rnd, rows = random.Random(7), []
    for area in (1, 2, 3):
        for i in range(60 if area < 3 else 1):
            lat, lon, h = rnd.uniform(30, 33), rnd.choice((0, 179.8 if area == 2 else 0)) + rnd.uniform(0, 3), rnd.uniform(0.1, 0.9)
            rows.append((area, i, lat, lon, round(rnd.random(), 1), lon - h, lon + h, lat - h, lat + h))
    df = spark.createDataFrame(rows, "area_id long, place_id long, lat double, lon double, score double, crop_west double, crop_east double, crop_south double, crop_north double")
    got = {(r.area_id, r.place_id): r["rank"] for r in P.declutter(df, [-F.col("score"), F.col("lat"), F.col("place_id")], spacing, share, most).collect()}
    want = {}
    for area in (1, 2, 3):
        kept = []
        for r in sorted((r for r in rows if r[0] == area), key=lambda r: (-r[4], r[2], r[1])):
            if all(km(r[2:4], k[2:4]) >= spacing and (share is None or overlap(r[5:], k[5:]) <= share) for k in kept):
                kept.append(r)
        want |= {(area, r[1]): i + 1 for i, r in enumerate(kept[:most])}
    assert got == want
    assert P.declutter(df.limit(0), [-F.col("score"), F.col("place_id")], spacing, share, most).count() == 0


def test_areas_across_the_date_line(spark):
    areas = spark.createDataFrame([(1, 178.0, -178.0, -2.0, 2.0), (2, 179.0, 181.0, -1.0, 1.0)], "area_id long, west double, east double, south double, north double")
    rows = [(k, lat, lon, k, lon - 0.1, lon + 0.1, lat - 0.1, lat + 0.1) for k, (lat, lon) in enumerate([(0.0, 179.9), (0.5, -179.5), (0.0, 181.5), (0.0, 177.0), (1.5, -178.5)])]
    places = spark.createDataFrame(rows, "place_id long, lat double, lon double, source_index long, crop_west double, crop_east double, crop_south double, crop_north double")
    inside = {(1, 0), (1, 1), (1, 2), (1, 4), (2, 0), (2, 1)}
    assert {(r.area_id, r.place_id) for r in P.score_places(places, areas).collect()} == inside
    ranked = P.rank_places(places, areas).collect()
    assert {(r.area_id, r.place_id) for r in ranked} == inside
    assert all(0 <= r.score <= 1 and r.center_km < 320 and r.margin_km >= 0 for r in ranked)
