"""Storm cells of a sweep from one tree of components over falling thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds in dBZ, the gates each needs, and the range in km beyond which it needs twice as many.
CELL_STEPS = ((60.0, 4), (55.0, 6), (50.0, 10), (45.0, 15), (40.0, 20), (35.0, 30))
FAR_KM, GATE_KM = 150.0, 0.25
CELLS = (
    "volume long, cell int, gates int, max_dbz double, mean_dbz double, threshold double, az double, range_km double, "
    "area_km2 double, az_min double, az_max double, az_extent double, range_min double, range_max double, range_extent double"
)


def _united(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least row of each component) after the links u - v: both ends hook to the lesser label, then paths are halved."""
    label = label.copy()
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not (label[label] == label).all():
            label = label[label]


def _links(radial: np.ndarray, gate: np.ndarray, turns: int, steps: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``steps`` radials (around the circle) and ``reach`` gates apart, each once."""
    width = int(gate.max()) + 1
    row = np.full((turns, width + 2 * reach), -1, np.int64)
    row[radial, gate + reach] = np.arange(len(radial))
    us, vs = [], []
    for dr in range(steps + 1):
        for dg in range(-reach if dr else 1, reach + 1):
            other = row[(radial + dr) % turns, gate + reach + dg]
            us.append(np.flatnonzero(other >= 0))
            vs.append(other[us[-1]])
    return np.concatenate(us), np.concatenate(vs)


def find_cells(az: np.ndarray, gate: np.ndarray, range_km: np.ndarray, dbz: np.ndarray, az_step: float, reach_az: float, reach_gates: int, merge_km: float) -> list[tuple[float, np.ndarray]]:
    """(threshold, rows) of each cell, in order of discovery.

    Links enter in the order of the weaker gate's threshold, so one union-find
    gives the components of every threshold in turn. A component with enough gates
    grows the first cell found inside it, else it is a new one; those of one
    threshold go from the strongest down, ties by their first row. Then the first
    two cells whose centres, weighted by squared dBZ, are under ``merge_km`` apart
    become one, until none are: the stronger keeps its place, and only its centre and
    distances are worked out anew.
    """
    n, turns = len(dbz), round(360 / az_step)
    level = np.zeros(n, np.int64)
    for value, _ in CELL_STEPS:
        level += dbz >= value
    u, v = _links(np.floor(az / az_step + 1e-9).astype(np.int64) % turns, gate - gate.min(), turns, int(reach_az / az_step + 1e-9), reach_gates)
    weaker = np.minimum(level[u], level[v])
    label, steps, rows = np.arange(n), [], []
    for k, (value, need) in enumerate(CELL_STEPS):
        at = len(CELL_STEPS) - k  # gates of this level or above reach the threshold
        label = _united(label, u[weaker == at], v[weaker == at])
        own = np.flatnonzero(level >= at)
        if not len(own):
            continue
        own = own[np.argsort(label[own], kind="stable")]
        starts = np.flatnonzero(np.r_[True, np.diff(label[own]) != 0])
        sizes = np.diff(np.r_[starts, len(own)])
        peak, middle = np.maximum.reduceat(dbz[own], starts), np.add.reduceat(range_km[own], starts) / sizes
        enough = np.flatnonzero(sizes >= need * np.where(middle > FAR_KM, 2, 1))
        holds: dict[int, int] = {}
        for cell, r in enumerate(rows):
            holds.setdefault(int(label[r[0]]), cell)
        for c in enough[np.lexsort((own[starts[enough]], -peak[enough]))]:
            members = own[starts[c] : starts[c] + sizes[c]]
            cell = holds.get(int(label[members[0]]))
            if cell is None:
                steps.append(value)
                rows.append(members)
            else:
                rows[cell] = members
    return _merged(steps, rows, az, range_km, dbz, merge_km)


def _centre(rows: np.ndarray, az: np.ndarray, range_km: np.ndarray, dbz: np.ndarray) -> tuple[float, float]:
    w, a = dbz[rows] ** 2, np.radians(az[rows])
    return float(np.degrees(np.arctan2((np.sin(a) * w).sum(), (np.cos(a) * w).sum())) % 360), float((range_km[rows] * w).sum() / w.sum())


def _merged(steps: list, rows: list, az: np.ndarray, range_km: np.ndarray, dbz: np.ndarray, merge_km: float) -> list[tuple[float, np.ndarray]]:
    centre = np.array([_centre(r, az, range_km, dbz) for r in rows]).reshape(-1, 2)
    peak = np.array([dbz[r].max() for r in rows])

    def apart(k: int) -> np.ndarray:
        d = np.abs(centre[:, 0] - centre[k, 0])
        return np.hypot((centre[:, 1] + centre[k, 1]) / 2 * np.radians(np.minimum(d, 360 - d)), centre[:, 1] - centre[k, 1])

    near = np.array([apart(k) < merge_km for k in range(len(rows))]).reshape(len(rows), len(rows))
    near = np.triu(near, 1)
    alive = np.ones(len(rows), bool)
    while near.any():
        i, j = divmod(int(near.argmax()), len(rows))
        keep, gone = (i, j) if peak[i] >= peak[j] else (j, i)
        rows[keep], steps[keep] = np.union1d(rows[keep], rows[gone]), max(steps[keep], steps[gone])
        alive[gone], peak[keep] = False, max(peak[keep], peak[gone])
        centre[keep] = _centre(rows[keep], az, range_km, dbz)
        near[gone], near[:, gone] = False, False
        close = (apart(keep) < merge_km) & alive
        near[keep], near[:, keep] = False, False
        near[keep, keep + 1 :], near[:keep, keep] = close[keep + 1 :], close[:keep]
    return [(steps[k], rows[k]) for k in np.flatnonzero(alive)]


def cell_cascade(gates: DataFrame, az_step: float, reach_az: float = 2.0, reach_gates: int = 3, merge_km: float = 10.0, near: float = 10.0, far: float = 230.0) -> DataFrame:
    """Storm cells of each volume's lowest sweep by falling thresholds, strongest first, with centre, area and extents.

    ``gates`` (volume, elev, az, gate, range_km, dbz), radials ``az_step`` degrees
    apart; see ``find_cells``. Area is gates times a gate's size at the centre's
    range. A volume is the unit of work: its lowest sweep has as many gates as the
    radar gives, only those over the least threshold move, and volumes run beside
    each other. Rows without a place or echo are left out; of several rows of one
    place the strongest counts; a volume without a cell has no row.
    """
    lowest = gates.groupBy("volume").agg(F.min("elev").alias("_l"))
    strong = gates.where((F.col("dbz") >= CELL_STEPS[-1][0]) & F.col("range_km").between(near, far) & F.col("az").isNotNull() & F.col("gate").isNotNull())
    own = strong.join(lowest, "volume").where(F.col("elev") == F.col("_l")).select("volume", "az", "gate", "range_km", "dbz")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["az", "gate", "dbz"], kind="stable").drop_duplicates(["az", "gate"], keep="last")
        az, gate, rng, dbz = (pdf[c].to_numpy(t) for c, t in (("az", float), ("gate", np.int64), ("range_km", float), ("dbz", float)))
        found = find_cells(az, gate, rng, dbz, az_step, reach_az, reach_gates, merge_km)
        span = int(gate.max() - gate.min())
        size = (rng[gate.argmax()] - rng[gate.argmin()]) / span if span else GATE_KM
        out = []
        for step, r in found:
            a, k = _centre(r, az, rng, dbz)
            turn = az[r].max() - az[r].min()
            area = len(r) * size * k * np.radians(az_step)
            out.append((key[0], len(r), dbz[r].max(), dbz[r].mean(), step, a, k, area, az[r].min(), az[r].max(), min(turn, 360 - turn), rng[r].min(), rng[r].max(), rng[r].max() - rng[r].min()))
        out.sort(key=lambda x: (-x[2], x[5]))
        return pd.DataFrame([(v, i + 1, *rest) for i, (v, *rest) in enumerate(out)], columns=[c.split()[0] for c in CELLS.split(", ")])

    return own.groupBy("volume").applyInPandas(run, CELLS)
