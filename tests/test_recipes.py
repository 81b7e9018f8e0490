"""Catalogues of fields: what is asked for is made in the passes it needs, the rest has a reason."""

import pytest
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import parcels as PA
from cumula.operators import profile as P
from cumula.operators import recipes as R

KEYS = ["run", "grid_index"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    lv = A.levels(spark, sf).withColumn("z_m", F.when(F.col("k") == 0, 0.0).otherwise(F.col("z_m"))).where("grid_index % 7 = 0")
    sfc = A.surface(spark, sf).where("grid_index % 7 = 0").withColumns({"refc": F.col("rh") / 2, "mslp_hpa": F.col("p_hpa") + 5})
    return sfc, lv


def test_sizes_of_the_catalogues():
    assert (len(R.DERIVED), len(R.BLOCKED), len(R.DIRECT), len(R.CHANNELS), len(R.POINT_VARIABLES)) == (44, 3, 57, 39, 18)
    assert len(R.preset_channels("mesoconvective_v1")) == 10 and len(R.preset_channels("hybrid_column_v1")) == 38
    assert len(R.preset_channels("hybrid_column_v1", "rrfs-a")) == 36 and len(R.preset_channels("hybrid_column_v1", ecape=False)) == 35
    with pytest.raises(ValueError, match="none of"):
        R.preset_channels("no_such")


def test_all_recipes_at_once_equal_their_parts(tables):
    sfc, lv = tables
    native = sfc.select(*KEYS, *(F.lit(900.0).alias(f"{k}cape") for k in ("sb", "ml", "mu")))
    got = {(r.run, r.grid_index): r for r in R.make_fields(list(R.DERIVED), KEYS, sfc, lv, native, (50_000.0, 28_000.0)).collect()}
    assert len(got) == sfc.count()
    parcels = {(r.run, r.grid_index, r.kind): r for r in PA.parcel(lv, KEYS, motion="right_moving").collect()}
    winds = {(r.run, r.grid_index): r for r in P.wind_bundle(lv, KEYS).collect()}
    whole = PA.ecape_fields(lv, KEYS, native)
    names = set(whole.columns) - {*KEYS, "failures"}
    fields = {(r.run, r.grid_index): r for r in whole.collect()}
    lapse = {(r.run, r.grid_index): r.lapse for r in P.lapse_pressure(lv, KEYS).collect()}
    same = lambda a, b: (a is None) == (b is None) and (a is None or a == pytest.approx(b))
    for key, r in got.items():
        for kind in ("sb", "ml", "mu"):
            p = parcels[*key, kind]
            assert same(r[f"{kind}cape"], p.cape) and same(r[f"{kind}cin"], p.cin) and same(r[f"{kind}ecape"], p.ecape)
        for n in names:
            assert same(r[n], fields[key][n]), n
        assert same(r.srh_0_1km, winds[key].srh_0_1km) and same(r.lapse_rate_700_500, lapse.get(key)) and same(r.lifted_index, parcels[*key, "sb"].lifted_index)


def test_one_request_runs_no_more_than_it_needs(tables):
    sfc, lv = tables
    plan = R.make_fields(["vpd_2m", "heat_index_2m"], KEYS, sfc, lv)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan and "Join" not in plan
    plan = R.make_fields(["bulk_shear_0_6km"], KEYS, sfc, lv)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Join") == 1


def test_reasons(tables):
    sfc, lv = tables
    plan = R.Planner(R.DERIVED, ["t_c", "p_hpa", "q"], ["u", "v", "z_m"])
    assert {n: plan.reason(n) for n in ("vpd_2m", "wind_chill_2m", "scp", "what", "bulk_shear_0_1km", "sbcape", "temperature_advection_700mb")} == {
        "vpd_2m": None, "wind_chill_2m": "no surface column u", "scp": "needs an effective inflow layer", "what": "unknown", "bulk_shear_0_1km": None, "sbcape": "no level column p_hpa", "temperature_advection_700mb": "no level column p_hpa",
    }
    with pytest.raises(ValueError, match="no surface column t_c"):
        R.make_fields(["heat_index_2m"], KEYS, sfc.drop("t_c"))


def test_column_preset_is_one_row_a_channel(spark, tables):
    sfc, lv = tables
    names = R.preset_channels("hybrid_column_v1")
    rows = R.build_samples(names, KEYS, sfc, lv).collect()
    assert len(rows) == 38 * sfc.count() and {r.channel for r in rows} == set(names)
    by = {(r.run, r.grid_index, r.channel): r.value for r in rows}
    for r in sfc.limit(40).collect():
        key = (r.run, r.grid_index)
        assert by[*key, "t2m"] == pytest.approx(r.t_c + 273.15) and by[*key, "mslp"] == pytest.approx(r.p_hpa * 100 + 500) and by[*key, "refc"] == r.rh / 2
    at = {(r.run, r.grid_index): r for r in P.interp_pressure(lv, KEYS, 850.0, ["t_c", "z_m", "u", "q"]).collect()}
    assert at
    for key, r in at.items():
        assert by[*key, "t850"] == pytest.approx(r.t_c + 273.15) and by[*key, "z850"] == pytest.approx(r.z_m) and by[*key, "u850"] == pytest.approx(r.u)
        assert (by[*key, "rh850"] is None) == (r.q is None)
    catalog = {r.name: r for r in R.channel_catalog(spark).collect()}
    assert catalog["cape"].canonical_name == catalog["cape"].alias_of == "sbcape" and catalog["t850"].level_hpa == 850 and catalog["u10"].height_m_agl == 10


def test_series_of_few_columns_and_unknown_names(spark):
    df = spark.createDataFrame([(1, 0, 20.0, 1.0), (1, 1, 21.0, 3.5), (1, 3, None, 4.0)], "id long, fhr long, t_c double, precip double")
    got = {r.fhr: r for r in R.point_series(df, ["id"], ["precip_hourly_mm", "temperature_2m_c", "hdw"]).collect()}
    assert [got[h].precip_hourly_mm for h in (0, 1, 3)] == [1.0, 2.5, None]
    assert got[0].missing == ["hdw"] and got[3].missing == ["precip_hourly_mm", "temperature_2m_c", "hdw"]
    with pytest.raises(ValueError, match="unknown"):
        R.point_series(df, ["id"], ["nothing"])
    assert R.point_series(df.limit(0), ["id"]).collect() == []


def test_direct_products_are_selections(spark):
    df = spark.createDataFrame([(1, "u", "10m", 3.0), (1, "v", "10m", 4.0), (1, "t", "2m", 9.0), (2, "u", "10m", None)], "cell long, field string, level string, value double")
    got = sorted((r.slug, r.part, r.cell, r.value, r.reason) for r in R.direct_fields(df, ["2m_temperature_10m_winds", "visibility", "what", "2m_temperature_10m_winds"]).na.fill(-1).collect())
    want = [("2m_temperature_10m_winds", p, k, v, None) for p, k, v in ((0, 1, 9.0), (1, 1, 3.0), (1, 2, -1.0), (2, 1, 4.0))] + [("visibility", -1, -1, -1.0, "no vis at surface"), ("what", -1, -1, -1.0, "unknown")]
    assert got == sorted(want)
