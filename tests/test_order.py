"""Exact order statistics of large and skewed groups against sorted lists."""

import random

import pytest

from cumula.operators import areas as R


@pytest.mark.parametrize("ranked", [100_000, 50])
def test_places_in_the_order_are_exact(spark, monkeypatch, ranked):
    """With a coarse sketch and brackets in use: smooth, heavy-tailed and tied values, and tiny groups."""
    monkeypatch.setattr(R, "RANKED", ranked)
    monkeypatch.setattr(R, "SKETCH", 200)
    rnd, groups = random.Random(9), {}
    groups[1] = [rnd.random() for _ in range(4000)]
    groups[2] = [rnd.choice((0.0, 1e12, -5.0, rnd.random() ** 9)) for _ in range(3000)]
    groups[3] = [7.0] * 500
    groups[4] = [2.0, 1.0]
    rows = [(k, v) for k, values in groups.items() for v in values] + [(1, None), (5, None)]
    got = {r.key: r for r in R.field_summary_rounded(spark.createDataFrame(rows, "key long, value double").repartition(6), ["key"]).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        s = sorted(values)
        for name, q in (("p00", 0.0), ("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99), ("p100", 1.0)):
            assert got[k][name] == s[int((len(s) - 1) * q + 0.5)], (k, name)
        assert got[k]["count"] == len(s)
