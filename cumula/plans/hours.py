"""Queries over forecast hours, intervals and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import windows as W
from cumula.plans.areas import _r

CELL = ["run", "grid_index"]


def window_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(W.window_reduce(A.cells(spark, sf_dir), CELL, [1, 2, 3, 4]))


WINDOW_REDUCE_SQL = f"""
with {A.CELLS_SQL} select run, grid_index, round(case when count(value) = 4 then sum(value) end, 6) as sum, round(max(value), 6) as max, round(min(value), 6) as min, round(max(value) - min(value), 6) as range, count(value) as hours
from cells where fhr in (1, 2, 3, 4) group by 1, 2
"""


def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 3-hour maximum and run maximum."""
    c = A.cells(spark, sf_dir).select(*CELL, "fhr", "value")
    t = W.trailing(c, CELL, 3, "max").withColumnRenamed("trail", "max3")
    return _r(t.join(W.run_total(c, CELL, "max").select(*CELL, "fhr", F.col("total").alias("run_max")), [*CELL, "fhr"]).drop("value"))


TRAILING_WINDOWS_SQL = f"""
with {A.CELLS_SQL}, w as (select run, grid_index, fhr, count(value) over a as n3, max(value) over a as m3, count(value) filter (where fhr >= 1) over b as n, max(value) filter (where fhr >= 1) over b as m from cells
  window a as (partition by run, grid_index order by fhr range between 2 preceding and current row), b as (partition by run, grid_index order by fhr))
select run, grid_index, fhr, round(case when n3 = 3 then m3 end, 6) as max3, round(case when n = fhr then m end, 6) as run_max from w where fhr >= 1
"""


def qpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hour precipitation: direct where a record exists, else the sum of hourly amounts."""
    c = A.cells(spark, sf_dir).where("fhr >= 1").select(*CELL, "fhr", F.abs("value").alias("value"))
    direct = c.where("grid_index % 10 = 0 and fhr = 6").select(*CELL, "fhr", (F.coalesce("value", F.lit(0.0)) * 3).alias("mm"))
    got = W.qpf(c, direct, CELL, 3)
    return _r(got.select(*CELL, "fhr", "qpf_in", "strategy", F.coalesce(F.size("hours"), F.lit(0)).alias("n_hours")))


QPF_SQL = f"""
with {A.CELLS_SQL}, c as (select run, grid_index, fhr, abs(value) as v from cells where fhr >= 1),
w as (select *, count(v) over a as n, sum(v) over a as s from c window a as (partition by run, grid_index order by fhr range between 2 preceding and current row)),
d as (select *, case when grid_index % 10 = 0 and fhr = 6 then coalesce(v, 0) * 3 end as mm from w)
select run, grid_index, fhr, round(coalesce(mm, case when n = 3 then s end) / 25.4, 6) as qpf_in, case when mm is not null then 'direct' when n = 3 then 'hourly_sum' else 'blocked' end as strategy,
  case when mm is not null then 1 when n = 3 then 3 else 0 end as n_hours from d
"""


def qpf_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(W.run_total(A.cells(spark, sf_dir).select(*CELL, "fhr", "value"), CELL, "sum").select(*CELL, "fhr", (F.col("total") / W.MM_PER_INCH).alias("total_in")))


QPF_TOTAL_SQL = f"""
with {A.CELLS_SQL}, w as (select run, grid_index, fhr, count(value) over b as n, sum(value) over b as s from cells where fhr >= 1 window b as (partition by run, grid_index order by fhr))
select run, grid_index, fhr, round(case when n = fhr then s end / 25.4, 6) as total_in from w
"""


def snapshot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest, least and range over two spans of hours."""
    return _r(W.snapshot_windows(A.cells(spark, sf_dir), CELL, {"1_3h": (1, 3), "4_6h": (4, 6), "1_6h": (1, 6)}))


SNAPSHOT_WINDOWS_SQL = f"""
with {A.CELLS_SQL}, s(span, a, b) as (values ('1_3h', 1, 3), ('4_6h', 4, 6), ('1_6h', 1, 6)),
g as (select run, grid_index, span, max(value) as hi, min(value) as lo, count(value) = any_value(b - a + 1) as ok from cells join s on fhr between a and b group by 1, 2, 3)
select run, grid_index, span, unnest(['max', 'min', 'range']) as op, round(unnest([case when ok then hi end, case when ok then lo end, case when ok then hi - lo end]), 6) as value from g
"""


def window_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the number of hours that a six-hour product lacks."""
    got = W.window_status(A.cells(spark, sf_dir), CELL, [1, 2, 3, 4, 5, 6])
    return got.groupBy("run", "status", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing")).agg(F.count("*").alias("cells"))


WINDOW_STATUS_SQL = f"""
with {A.CELLS_SQL}, g as (select run, grid_index, coalesce(string_agg(fhr::varchar, ',' order by fhr) filter (where value is null), '') as missing from cells where fhr >= 1 group by 1, 2)
select run, case when missing = '' then 'ok' else 'missing_hours' end as status, missing, count(*) as cells from g group by 1, 2, 3
"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that each order's run may make, and blockers."""
    rows = [("qpf_1h", 1, False), ("qpf_6h", 6, False), ("qpf_24h", 24, False), ("wind_0_24h", 24, True), ("t2m_24_48h_max", 48, True), ("qpf_6h", 6, False)]
    products = spark.createDataFrame(rows, "slug string, min_fhr int, needs_00z boolean")
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 4 * 6).cast("int").alias("cycle_hour"), (F.col("o_custkey") % 60).cast("int").alias("fhr"))
    return W.eligible(products, runs).groupBy("slug", "cycle_hour", "blocker").agg(F.count("*").alias("runs"), F.max("fhr").alias("latest"))


ELIGIBLE_SQL = """
with p(slug, min_fhr, z) as (values ('qpf_1h', 1, false), ('qpf_6h', 6, false), ('qpf_24h', 24, false), ('wind_0_24h', 24, true), ('t2m_24_48h_max', 48, true)),
r as (select (o_orderkey % 4 * 6)::int as cycle_hour, (o_custkey % 60)::int as fhr from orders)
select slug, cycle_hour, case when fhr < min_fhr then 'forecast hour too early' when z and cycle_hour <> 0 then 'needs a 00Z cycle' end as blocker, count(*) as runs, max(fhr) as latest from p, r group by 1, 2, 3
"""


def hourly_precip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly amounts from accumulations, with every seventh record lost."""
    c = A.cells(spark, sf_dir).where("(grid_index + fhr) % 7 <> 0").select(*CELL, "fhr", (F.col("value") + F.col("fhr") * 6).alias("value"))
    return _r(W.hourly_precip(c, CELL).select(*CELL, "fhr", "hourly"))


HOURLY_PRECIP_SQL = f"""
with {A.CELLS_SQL}, c as (select run, grid_index, fhr, value + fhr * 6 as v from cells where (grid_index + fhr) % 7 <> 0),
l as (select *, lag(fhr) over w as pf, lag(v) over w as pv from c window w as (partition by run, grid_index order by fhr))
select run, grid_index, fhr, round(greatest(case when pf = fhr - 1 then v - pv when fhr = 0 then v end, case when (pf = fhr - 1 and v - pv is not null) or (fhr = 0 and v is not null) then 0.0 end), 6) as hourly from l
"""


def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of line items, merged by part."""
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_orderkey") % 5000).alias("start"), (F.col("l_orderkey") % 5000 + F.col("l_quantity").cast("long")).alias("end"))
    return W.coalesce_ranges(li, ["part"])


COALESCE_RANGES_SQL = """
with r as (select l_partkey as part, l_orderkey % 5000 as s, l_orderkey % 5000 + l_quantity::bigint as e from lineitem),
m as (select *, case when s > max(e) over (partition by part order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as f from r),
g as (select *, sum(f) over (partition by part order by s, e rows unbounded preceding) as g from m)
select part, min(s) as start, max(e) as end, count(*) as parts from g group by part, g.g
"""


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest complete run of each model among line items read as an availability table."""
    li = A.table(spark, sf_dir, "lineitem")
    models, sources, products = (["hrrr", "gfs", "rrfs-a"], ["aws", "nomads", "google"], ["sfc", "prs", "nat", "subh"])
    at = lambda xs, e: F.get(F.array(*map(F.lit, xs)), e.cast("int"))
    a = li.select(at(models, F.col("l_suppkey") % 3).alias("model"), F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") % 4 * 6).alias("cycle"), at(sources, F.col("l_partkey") % 3).alias("source"), at(products, F.col("l_linenumber") % 4).alias("product"), (F.col("l_partkey") % 2).alias("fhr"))
    return W.latest_run(a, ["sfc", "prs"], 0, ["nomads", "aws"])


LATEST_RUN_SQL = """
with a as (select (array['hrrr','gfs','rrfs-a'])[(l_suppkey % 3)::int + 1] as model, l_shipdate::date as date, l_orderkey % 4 * 6 as cycle, (array['aws','nomads','google'])[(l_partkey % 3)::int + 1] as source,
  (array['sfc','prs','nat','subh'])[(l_linenumber % 4)::int + 1] as product, l_partkey % 2 as fhr from lineitem),
o as (select model, date, cycle, source from a where fhr = 0 and product in ('sfc', 'prs') and source in ('nomads', 'aws') group by all having count(distinct product) = 2)
select model, date, cycle, source from (select *, row_number() over (partition by model order by date desc, cycle desc, source desc) as r from o) where r = 1
"""


def flashes_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flashes with their age in minutes before the last one, in bands of six hours."""
    from cumula.functions.text import age_minutes

    f = A.flashes(spark, sf_dir)
    ref = f.agg(F.max("ts").alias("ref")).withColumn("_", F.lit(1))
    aged = f.withColumn("_", F.lit(1)).join(F.broadcast(ref), "_").withColumn("age", age_minutes(F.col("ts").cast("timestamp"), F.col("ref").cast("timestamp")))
    return _r(aged.groupBy(F.floor(F.col("age") / 360).cast("long").alias("band")).agg(F.count("*").alias("n"), F.max("age").alias("oldest")), 4)


FLASHES_BY_AGE_SQL = f"""
with {A.FLASHES_SQL}, r as (select max(ts) as ref from flashes), a as (select (epoch_us(ref) - epoch_us(ts)) / 60000000.0::double as age from flashes, r)
select floor(age / 360)::bigint as band, count(*) as n, round(max(age), 4) as oldest from a group by 1
"""

QUERIES = {f.__name__: f for f in (window_reduce, trailing_windows, qpf, qpf_total, snapshot_windows, window_status, eligible, hourly_precip, coalesce_ranges, latest_run, flashes_by_age)}
ORACLES = {
    "window_reduce": WINDOW_REDUCE_SQL, "trailing_windows": TRAILING_WINDOWS_SQL, "qpf": QPF_SQL, "qpf_total": QPF_TOTAL_SQL, "snapshot_windows": SNAPSHOT_WINDOWS_SQL, "window_status": WINDOW_STATUS_SQL,
    "eligible": ELIGIBLE_SQL, "hourly_precip": HOURLY_PRECIP_SQL, "coalesce_ranges": COALESCE_RANGES_SQL, "latest_run": LATEST_RUN_SQL, "flashes_by_age": FLASHES_BY_AGE_SQL,
}
