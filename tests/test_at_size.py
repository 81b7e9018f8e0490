"""Queries against their SQL on small tables whose keys and places are those of large ones."""

import math

import duckdb
import pytest

from cumula import registry
from cumula.operators import places as PL
from cumula.operators import sampling as S

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture
def differs(spark, tmp_path):
    """Rows of a query that its SQL lacks and the other way round, over tables some of which are replaced (name to SQL)."""

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) > 1e-9 else "0"
        return "null" if v is None else str(v)

    def run(name, sf, **replaced):
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"create view small_{t} as select * from read_parquet('{sf}/{t}.parquet')")
            c.sql(f"copy ({replaced.get(t, f'from small_{t}')}) to '{tmp_path}/{t}.parquet' (format parquet)")
            c.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
        df, want = registry.QUERIES[name](spark, str(tmp_path)), c.sql(registry.ORACLES[name])
        order, at = sorted(df.columns), {k: i for i, k in enumerate(want.columns)}
        got = sorted("|".join(plain(r[k]) for k in order) for r in df.collect())
        sql = sorted("|".join(plain(r[at[k]]) for k in order) for r in want.fetchall())
        assert sql
        return [(a, b) for a, b in zip(got, sql, strict=False) if a != b][:3] or len(got) - len(sql)

    return run


#: Orders from 1,234,500 on, ten of each key of six digits; all ten of every seventh key are on one side only.
LATE_ORDERS = "select * replace (o_orderkey + 1234500 as o_orderkey, case when o_orderkey // 10 % 7 = 0 then 'F' else o_orderstatus end as o_orderstatus) from small_orders"


@pytest.mark.parametrize("name", ["key_diff", "diff_artifacts", "diff_fetches"])
def test_artifact_keys_of_late_orders(differs, sf, name):
    assert not differs(name, sf, orders=LATE_ORDERS)


def test_samples_of_runs_from_1000_on(differs, sf):
    late = "select * replace (o_orderkey + 292800 as o_orderkey) from small_orders union all select * replace (o_orderkey + 2952000 as o_orderkey) from small_orders"
    assert not differs("ml_samples", sf, orders=late)


def test_rotations_exactly_ten_km_apart(differs, sf):
    volume = "select * replace (l_orderkey + 150000 as l_orderkey, l_partkey + 20000 as l_partkey) from read_parquet('/root/testdata/sf0.1/lineitem.parquet') where l_orderkey between 8400 and 11999"
    assert not differs("mesocyclone_tilts", sf, lineitem=volume)


def most_rows(df, metric, kind):
    """Greatest number of rows that one exchange of a query writes or broadcasts."""

    def nodes(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            yield from nodes(p.executedPlan())
        elif name.endswith("QueryStage"):
            yield from nodes(p.plan())
        else:
            yield p
            for i in range(p.children().size()):
                yield from nodes(p.children().apply(i))

    df.collect()
    found = (p.metrics().get(metric) for p in nodes(df._jdf.queryExecution().executedPlan()) if p.nodeName().startswith(kind))
    return max((m.get().value() for m in found if m.isDefined()), default=0)


def most_shuffled(df):
    return most_rows(df, "shuffleRecordsWritten", "Exchange")


@pytest.fixture
def many(spark):
    """Values of 40 keys on 12 cells, and 400 points amid them."""
    cells = spark.range(12).selectExpr("id as grid_index", "30D + id div 4 * 0.25D as lat", "-100D + id % 4 * 0.25D as lon")
    values = cells.crossJoin(spark.range(40).withColumnRenamed("id", "run")).selectExpr("run", "grid_index", "if((run + grid_index) % 5 = 0, null, run * 1.5D + grid_index) as value").where("(run + grid_index) % 7 <> 0")
    points = spark.range(400).selectExpr("id as point_id", "30.01D + id * 37 % 101 / 101 * 0.45D as plat", "-99.99D + id * 53 % 103 / 103 * 0.7D as plon")
    return values, cells, points


@pytest.mark.parametrize("name", ["sample_box_mean", "sample_idw4"])
def test_samples_at_points_are_not_shuffled(spark, many, name):
    values, cells, points = many
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # values of many runs are too large for it
    try:
        got = getattr(S, name)(values, cells, points, ["run"], *([30.0] if name == "sample_box_mean" else []))
        assert most_shuffled(got) < 4000 < got.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_samples_of_keys_that_lack_cells(many):
    values, cells, points = many
    have = {(r.run, r.grid_index): r.value for r in values.collect()}
    weights, inside = {}, {}
    for r in S.idw_weights(cells, points).collect():
        weights.setdefault(r.point_id, []).append((r.grid_index, r.weight))
    for r in S.box_cells(cells, points, 30.0).collect():
        inside.setdefault(r.point_id, []).append(r.grid_index)
    near = {r.point_id: r.grid_index for r in S.k_nearest(cells, points, 1).collect()}
    idw = {(r.run, r.point_id): r for r in S.sample_idw4(values, cells, points, ["run"]).collect()}
    box = {(r.run, r.point_id): r for r in S.sample_box_mean(values, cells, points, ["run"], 30.0).collect()}
    for run in range(40):
        for i in range(400):
            own = [(g, w) for g, w in sorted(weights[i]) if (run, g) in have]
            valid = [(have[run, g], w) for g, w in own if have[run, g] is not None]
            assert ((run, i) in idw) == bool(own)
            if own:
                assert [tuple(c) for c in idw[run, i].contributors] == own
                assert idw[run, i].value == (pytest.approx(sum(v * w for v, w in valid) / sum(w for _, w in valid)) if valid else None)
            there = [have[run, g] for g in inside.get(i, []) if have.get((run, g)) is not None]
            assert ((run, i) in box) == ((run, near[i]) in have)
            if (run, near[i]) in have:
                assert (box[run, i].n, box[run, i].value) == (len(there), pytest.approx(sum(there) / len(there)) if there else have[run, near[i]])


@pytest.mark.parametrize("name", ["point_timeseries", "point_series", "box_soundings"])
def test_series_at_points_are_not_shuffled(spark, sf, tmp_path, name):
    """Sixty times the points over the same cells: what is worked out belongs to cells."""
    for t in TABLES:
        duckdb.sql(f"copy (select * {'replace (c_custkey + i * 150 as c_custkey) from' if t == 'customer' else 'from'} read_parquet('{sf}/{t}.parquet'){', range(60) r(i)' if t == 'customer' else ''}) to '{tmp_path}/{t}.parquet' (format parquet)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert most_shuffled(got) < got.count() / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mosaic_values_are_not_broadcast(spark, sf):
    assert most_rows(registry.QUERIES["mosaic_series"](spark, sf.replace("0.001", "0.01")), "numOutputRows", "BroadcastExchange") < 10_000


def test_few_places_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Each place of a line crowds the next two, so all wait for the first; three of an area are wanted."""
    rounds, own = [], PL.written
    monkeypatch.setattr(PL, "written", lambda df: rounds.append(0) or own(df))
    line = spark.range(40).selectExpr("1L as area_id", "id as place_id", "30D as lat", "-100D + id * 0.1D as lon", "1D - id / 100 as score")
    got = [(r["rank"], r.place_id) for r in PL.select_places(line, 20.0, 3).collect()]
    assert sorted(got) == [(1, 0), (2, 3), (3, 6)] and len(rounds) <= 7


def test_sites_at_one_place_are_looked_at_k_times(spark, monkeypatch):
    seen, own = [], S._probe
    monkeypatch.setattr(S, "_probe", lambda cells, *rest: seen.append(cells.count()) or own(cells, *rest))
    sites = spark.range(3000).selectExpr("id as grid_index", "30D + id % 10 * 0.3D as lat", "-100D as lon")
    points = spark.range(50).selectExpr("id as point_id", "30D + id * 0.05D as plat", "-100.1D as plon")
    got = {(r.point_id, r["rank"]): r.grid_index for r in S.k_nearest(sites, points, 3, km=True).collect()}
    assert len(got) == 150 and [got[0, i] for i in (1, 2, 3)] == [0, 10, 20] and max(seen) <= 30
