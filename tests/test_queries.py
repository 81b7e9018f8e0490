"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from cumula import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    got = sorted("|".join(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted("|".join(plain(r[at[c]]) for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    larger = name in ("cell_cascade",)  # the smallest tables have too few strong gates
    assert registry.QUERIES[name](spark, sf.replace("0.001", "0.01") if larger else sf).count() > 0


@pytest.mark.parametrize(("name", "records"), [("poi_json", "items"), ("run_reports_json", "artifacts")])
def test_written_json_rows_are_bounded(spark, sf, tmp_path, monkeypatch, name, records):
    from cumula.plans import files

    monkeypatch.setattr(files, "BLOCK_RECORDS", 3, raising=False)
    monkeypatch.setattr(files, "_folder", lambda spark, name: str(tmp_path / name))
    assert registry.QUERIES[name](spark, sf).count() > 0
    (written,) = tmp_path.iterdir()
    assert spark.read.json(str(written)).selectExpr(f"max(size({records}))").first()[0] <= 3


def test_entry_runs_without_training_data_operators():
    import __spark_entry__ as e

    assert e.FLAGSHIP in registry.QUERIES
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
