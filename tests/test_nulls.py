"""Null in, null out: every Column function of wind and geometry that clamps."""

import pytest
from pyspark.sql import functions as F

from cumula.functions import thermo as T
from cumula.functions import wind as W

CASES = {
    "haversine": (W.haversine, (10.0, 20.0, 11.0, 21.0)),
    "distance_score": (W.distance_score, (10.0, 20.0, 11.0, 21.0)),
    "bearing": (W.bearing, (10.0, 20.0, 11.0, 21.0)),
    "az_diff": (W.az_diff, (10.0, 350.0)),
    "beam_height": (W.beam_height, (50.0, 0.5)),
    "unfold": (W.unfold, (5.0, 30.0, 10.0)),
    "dealias_delta": (W.dealias_delta, (35.0, 30.0)),
    "storm_relative": (W.storm_relative, (5.0, 90.0, 270.0, 20.0)),
    "tvs_threshold": (W.tvs_threshold, (50.0,)),
    "rotation_strength": (W.rotation_strength, (0.01,)),
    "bounds_area": (W.bounds_area, (1.0, 2.0, 3.0, 4.0)),
    "centered_west": (lambda x, y, h: W.centered_bounds(x, y, h, 1.5)[0], (10.0, 20.0, 2.0)),
    "overlap_fraction": (lambda *c: W.overlap_fraction(c[:4], c[4:]), (0.0, 2.0, 0.0, 2.0, 1.0, 3.0, 1.0, 3.0)),
    "edge_margin": (lambda x, y, *b: W.edge_margin(x, y, b), (1.0, 1.0, 0.0, 2.0, 0.0, 2.0)),
    "expand_west": (lambda *b: W.expand_to_aspect(*b, 0.1, 0.5, 1.5)[0], (0.0, 2.0, 0.0, 2.0)),
    "wetbulb": (T.wetbulb, (1000.0, 20.0, 10.0)),
    "wetbulb_stull": (T.wetbulb_stull, (20.0, 50.0)),
    "heat_index": (T.heat_index, (30.0, 60.0)),
    "wind_chill": (T.wind_chill, (0.0, 10.0)),
    "fosberg": (T.fosberg, (20.0, 30.0, 5.0)),
    "dewpoint_rh": (T.dewpoint_rh, (20.0, 50.0)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_null_in_null_out(spark, name):
    f, args = CASES[name]
    whole = [F.lit(a) for a in args]
    cols = [f(*whole).alias("whole")]
    for k in range(len(args)):
        some = list(whole)
        some[k] = F.lit(None).cast("double")
        cols.append(f(*some).alias(f"without_{k}"))
    row = spark.range(1).select(*cols).first()
    assert row[0] is not None and all(v is None for v in row[1:]), row
