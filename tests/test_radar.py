"""Cells by falling thresholds, tilts of one place and unfolding, against small scenes and brute force."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import cells as C
from cumula.operators import dealias as D
from cumula.operators import radar as R
from cumula.registry import QUERIES

GATES = "volume long, sweep long, elev double, az long, gate long, range_km double, dbz double, vel double"


def block(volume, az0, gate0, n_az, n_gate, dbz):
    return [(volume, 0, 0.5, (az0 + a) % 360, gate0 + g, float(gate0 + g), dbz, 0.0) for a in range(n_az) for g in range(n_gate)]


def test_cells_of_two_storms_and_a_weak_one(spark):
    rows = block(1, 358, 40, 4, 4, 62.0) + block(1, 356, 36, 8, 12, 41.0)[:0] + block(1, 90, 60, 6, 6, 52.0) + block(1, 200, 80, 2, 4, 38.0) + block(2, 10, 200, 2, 3, 61.0)
    got = C.cell_cascade(spark.createDataFrame(rows, GATES), 1.0).collect()
    assert [(r.volume, r.cell, r.gates, r.threshold, r.max_dbz) for r in sorted(got, key=lambda r: (r.volume, r.cell))] == [(1, 1, 16, 60.0, 62.0), (1, 2, 36, 50.0, 52.0)]
    first = min(got, key=lambda r: r.cell)
    assert min(abs(first.az - 359.5), 360 - abs(first.az - 359.5)) < 1e-6 and first.range_km == pytest.approx(41.5)


def test_a_core_grows_and_near_cells_merge(spark):
    core = block(1, 100, 50, 2, 3, 63.0)
    around = [r for r in block(1, 96, 46, 10, 11, 46.0) if (r[3], r[4]) not in {(c[3], c[4]) for c in core}]
    near = block(1, 100, 62, 3, 4, 61.0)
    (cell,) = C.cell_cascade(spark.createDataFrame(core + around + near, GATES), 1.0, merge_km=15.0).collect()
    assert (cell.gates, cell.threshold, cell.max_dbz) == (len(core + around + near), 60.0, 63.0)


def cells_by_search(rows, az_step, steps, reach=3, merge_km=10.0):
    """Cells of one sweep (az, gate, range_km, dbz) by a search at each threshold, every merge worked out anew."""
    rows = sorted(rows)
    turns, cells = round(360 / az_step), []
    for value, need in C.CELL_STEPS:
        place = {(int(a // az_step), g): i for i, (a, g, _, z) in enumerate(rows) if z >= value}
        found = []
        while place:
            start, first = place.popitem()
            group, queue = [first], [start]
            while queue:
                r, g = queue.pop()
                for spot in [((r + a) % turns, g + b) for a in range(-steps, steps + 1) for b in range(-reach, reach + 1)]:
                    if spot in place:
                        group.append(place.pop(spot))
                        queue.append(spot)
            if len(group) >= need * (2 if sum(rows[i][2] for i in group) / len(group) > 150 else 1):
                found.append(set(group))
        for group in sorted(found, key=lambda x: (-max(rows[i][3] for i in x), min(x))):
            home = next((c for c in cells if c[1] & group), None)
            if home:
                home[1] |= group
            else:
                cells.append([value, group])

    def centre(group):
        w = [(rows[i][3] ** 2, math.radians(rows[i][0]), rows[i][2]) for i in sorted(group)]
        return math.degrees(math.atan2(sum(k * math.sin(a) for k, a, _ in w), sum(k * math.cos(a) for k, a, _ in w))) % 360, sum(k * r for k, _, r in w) / sum(k for k, _, _ in w)

    def apart(a, b):
        d = abs(a[0] - b[0])
        return math.hypot((a[1] + b[1]) / 2 * math.radians(min(d, 360 - d)), a[1] - b[1])

    while True:
        at = [centre(c[1]) for c in cells]
        pair = next(((i, j) for i in range(len(cells)) for j in range(i + 1, len(cells)) if apart(at[i], at[j]) < merge_km), None)
        if pair is None:
            break
        i, j = pair if max(rows[k][3] for k in cells[pair[0]][1]) >= max(rows[k][3] for k in cells[pair[1]][1]) else pair[::-1]
        cells[i] = [max(cells[i][0], cells[j][0]), cells[i][1] | cells[j][1]]
        del cells[j]
    return [(value, len(g), max(rows[i][3] for i in g), sum(rows[i][3] for i in g) / len(g), *centre(g), min(rows[i][0] for i in g), max(rows[i][0] for i in g), min(rows[i][2] for i in g), max(rows[i][2] for i in g)) for value, g in cells]


def test_cells_equal_search_at_each_threshold(spark):
    """All gates of all volumes of the larger tables, and random scenes of many cells."""
    rnd, scenes = np.random.default_rng(8), {}
    g = A.gates(spark, "/root/testdata/sf0.01")
    low = {r.volume: r.e for r in g.groupBy("volume").agg(F.min("elev").alias("e")).collect()}
    for r in g.where("dbz >= 35 and range_km between 10 and 230").collect():
        if r.elev == low[r.volume]:
            scenes.setdefault(r.volume, []).append((float(r.az), r.gate, r.range_km, r.dbz))
    made = []
    for v in range(1000, 1040):
        spots = {(int(x + a) % 90, int(y + b)) for x, y in zip(rnd.integers(0, 90, 12), rnd.integers(14, 60, 12), strict=True) for a, b in zip(rnd.integers(-2, 3, 22), rnd.integers(-3, 4, 22), strict=True)}
        scenes[v] = [(4.0 * a, b, 4.0 * b, float(rnd.integers(33, 66))) for a, b in spots]
        made += [(v, 0, 0.5, int(a), b, r, z, 0.0) for a, b, r, z in scenes[v]]
        scenes[v] = [x for x in scenes[v] if x[3] >= 35 and 10 <= x[2] <= 230]
    both = g.select("volume", "sweep", "elev", "az", "gate", "range_km", "dbz", "vel").unionByName(spark.createDataFrame(made, GATES))
    got = {}
    for r in C.cell_cascade(both, 4.0, 4.0).collect():
        got.setdefault(r.volume, []).append((r.threshold, r.gates, r.max_dbz, r.mean_dbz, r.az, r.range_km, r.az_min, r.az_max, r.range_min, r.range_max))
    assert sum(map(len, got.values())) > 150
    for v, rows in scenes.items():
        want = sorted(cells_by_search(rows, 4.0, 1))
        assert np.allclose(sorted(got.get(v, [])), want), v


def test_rotation_without_echo_is_kept_and_consolidated(spark):
    couplet = lambda volume, sweep, dbz, lift: [(volume, sweep, 0.5 + sweep, 40 + a, g, float(g), dbz, (1 if a % 2 else -1) * (12.0 + lift)) for a in range(4) for g in range(30, 33)]
    rows = [x for volume, dbz in ((1, None), (2, 45.0), (3, 5.0)) for sweep in (0, 1) for x in couplet(volume, sweep, dbz, sweep)]
    got = R.mesocyclone_tilts(spark.createDataFrame(rows, GATES), 1.0).collect()
    assert sorted(r.volume for r in got) == [1, 2]
    for r in got:
        assert r.tilts == 2 and r.dv == pytest.approx(26.0) and 0.25 < r.base_km < 0.35 and r.range_km == pytest.approx(31.0)


def test_differences_along_a_radial_count_by_their_middle(spark):
    rows = [(1, 0, 0.5, 0, g, g * 1.0, 40.0, v) for g, v in ((0, -20.0), (1, 20.0), (99, -11.0), (101, 11.0), (50, -13.0), (52, 13.0))]
    got = sorted((r.gate, r.gap, r.range_km, r.dv) for r in R.tvs_candidates(spark.createDataFrame(rows, GATES), 45.0).collect())
    assert got == [(50, 2, 51.0, 26.0), (99, 2, 100.0, 22.0)]


def test_tilts_of_one_place(spark):
    rows = [(1, "a", 1, 90.0, 50.0), (1, "b", 2, 91.0, 51.0), (1, "c", 2, 90.0, 52.0), (1, "d", 3, 90.0, 49.0), (1, "e", 1, 270.0, 50.0), (2, "f", 1, 0.0, 10.0)]
    got = R.match_tilts(spark.createDataFrame(rows, "volume long, det string, tilt int, az double, range_km double")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.volume, r.group), (r.tilts, set()))[1].add(r.det)
    assert sorted((k[0], n, sorted(d)) for k, (n, d) in groups.items()) == [(1, 1, ["c"]), (1, 1, ["e"]), (1, 3, ["a", "b", "d"]), (2, 1, ["f"])]


def by_loops(observed, ny, passes=3):
    """Unfolding of one sweep gate by gate, by the rules as written."""
    def turn(v, ref):
        x = (ref - v) / (2 * ny)
        return v + 2 * ny * max(-8, min(8, math.copysign(math.floor(abs(x) + 0.5), x)))

    rows, cols = len(observed), len(observed[0])
    done = [[None] * cols for _ in range(rows)]
    for r in range(rows):
        own, above = observed[r], done[r - 1] if r else [None] * cols
        both = [k for k in range(cols) if own[k] is not None and above[k] is not None]
        if both:
            seed = min(both, key=lambda k: abs(k - sum(both) / len(both)))
        else:
            seed = next((k for k in range(cols) if own[k] is not None), None)
        if seed is None:
            continue
        done[r][seed] = own[seed] if above[seed] is None else turn(own[seed], above[seed])
        for way in (1, -1):
            walked, k = [seed], seed + way
            while 0 <= k < cols:
                if own[k] is not None:
                    refs = [done[r][walked[-1]]]
                    if len(walked) > 1:
                        refs.append(2 * done[r][walked[-1]] - done[r][walked[-2]])
                    if above[k] is not None:
                        refs.append(above[k])
                    done[r][k] = turn(own[k], statistics.median(refs))
                    walked.append(k)
                k += way
    for _ in range(passes):
        now, moved = [list(x) for x in done], False
        for r in range(rows):
            for k in range(cols):
                if observed[r][k] is None:
                    continue
                near = [now[(r + a) % rows][k + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and 0 <= k + b < cols]
                near = [x for x in near if x is not None]
                if len(near) < 2:
                    continue
                m = statistics.median(near)
                c = turn(observed[r][k], m)
                if abs(c - m) + 0.15 * ny < abs(now[r][k] - m):
                    done[r][k], moved = c, True
        if not moved:
            break
    return done


def grid_of(rows):
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float)


def test_unfolding_scenes():
    """Scenes whose outcome follows from the rules: an outward fold, and one gate that its neighbours mend."""
    folded = np.array([[10.0, 12.0, 14.0, -14.0, -12.0, -10.0]])
    assert D.unfold_radials(folded, 15.0).tolist() == [[10, 12, 14, 16, 18, 20]]
    scene = np.array([[9.0, 11.0, 13.0], [10.0, 12.0, -14.0], [11.0, 13.0, 15.0]])
    assert D.refine_sweep(scene, scene.copy(), 15.0, 2)[1, 2] == 16
    assert np.isnan(D.unfold_radials(np.full((2, 3), np.nan), 15.0)).all()


def test_unfolding_equals_loops_on_random_sweeps():
    rnd = np.random.default_rng(2)
    for n in range(120):
        shape = (int(rnd.integers(1, 9)), int(rnd.integers(1, 14)))
        true = np.cumsum(rnd.normal(0, 6, shape), axis=1) + np.cumsum(rnd.normal(0, 5, (shape[0], 1)), axis=0)
        ny = float(rnd.uniform(8, 25))
        seen = np.where(rnd.random(shape) < (0.3, 0.05, 0.7)[n % 3], np.nan, (true + ny) % (2 * ny) - ny)
        want = grid_of(by_loops([[None if math.isnan(v) else float(v) for v in r] for r in seen], ny))
        assert np.allclose(D.refine_sweep(seen, D.unfold_radials(seen, ny), ny), want, equal_nan=True)


def test_unfolding_gives_back_smooth_winds():
    az, gate = np.meshgrid(np.arange(60), np.arange(80), indexing="ij")
    true = 40 * np.sin(az * 2 * np.pi / 60) * (gate / 80) + 5
    folded = (true + 12) % 24 - 12
    assert np.allclose(D.refine_sweep(folded, D.unfold_radials(folded, 12.0), 12.0), true)


def test_dealias_equals_brute_force(spark, sf):
    """Every gate of every sweep by plain loops."""
    sweeps = {}
    for r in A.gates(spark, sf).select("volume", "sweep", "az", "gate", "vel").collect():
        sweeps.setdefault((r.volume, r.sweep), {})[r.az, r.gate] = r.vel
    want = {}
    for (volume, sweep), cells in sweeps.items():
        azs, lo, hi = sorted({a for a, _ in cells}), min(k for _, k in cells), max(k for _, k in cells)
        out = by_loops([[cells.get((a, k)) for k in range(lo, hi + 1)] for a in azs], 14.0 + 3 * sweep + volume % 3)
        want |= {(volume, sweep, a, lo + k): v for a, row in zip(azs, out, strict=True) for k, v in enumerate(row) if v is not None}
    got = {(r.volume, r.sweep, r.az, r.gate): r.vel for r in QUERIES["dealias"](spark, sf).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)])


def test_nyquist_of_a_sweep_and_odd_rows(spark):
    rows = [(1, 0, 0, k, v, None if k < 2 else 15.0) for k, v in enumerate([10.0, 12.0, None, 14.0, -14.0])] + [(1, 1, 0, 0, None, 15.0), (1, 0, None, 3, -29.0, 15.0), (2, 0, 0, 0, 14.0, 0.0), (2, 0, 0, 1, -14.0, None)]
    df = spark.createDataFrame(rows, "volume long, sweep long, az long, gate long, vel double, nyquist double")
    got = {(r.volume, r.sweep, r.az, r.gate): r.vel for r in D.dealias_sweeps(df, "nyquist").collect()}
    assert got == {(1, 0, 0, 0): 10, (1, 0, 0, 1): 12, (1, 0, 0, 2): None, (1, 0, 0, 3): 14, (1, 0, 0, 4): 16, (1, 1, 0, 0): None, (1, 0, None, 3): -29, (2, 0, 0, 0): 14, (2, 0, 0, 1): -14}
    assert D.dealias_sweeps(df, "nyquist", method="off") is df
    assert D.dealias_sweeps(df.limit(0), 20.0).collect() == []
