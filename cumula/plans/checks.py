"""Queries over operators that select, guard, write and prepare: one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula import adapters as A
from cumula.operators import compare as C
from cumula.operators import filters as P
from cumula.operators import profile as V
from cumula.operators import radar as R
from cumula.operators import windows as N
from cumula.plans.areas import _r
from cumula.shared import new_path
from cumula.sources import files as I
from cumula.sources import sinks as O


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields at three levels of every supplier's file."""
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    return s.select("file", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("level"), F.lit(m).alias("message")) for m, (f, v) in enumerate((("smoke", 8), ("smoke_column", 0), ("smoke", 8), ("t", 2)))))))


def smoke_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoke density at 8 m and its column total of every file; a file without either is an error."""
    return C.select_all(_fields(spark, sf_dir), spark.createDataFrame([("smoke", 8), ("smoke_column", 0)], "field string, level int"), ["file"])


SMOKE_PAIR_SQL = "select s_suppkey as file, unnest(['smoke', 'smoke_column']) as field, unnest([8, 0]) as level, unnest([0, 1]) as message from supplier"


def hybrid_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with all eight hybrid levels of humidity; those with a gap go."""
    lv = A.levels(spark, sf_dir).where("q is not null").select("run", "grid_index", F.lit("q").alias("field"), F.lit("hybrid").alias("level_type"), (F.col("k") + 1).alias("level"), F.col("q").alias("value"))
    return _r(I.scan_volume(lv, "q", 8).groupBy("run", "level").agg(F.count("*").alias("cells"), F.avg("value").alias("mean")), 7)


HYBRID_VOLUME_SQL = f"""
with {A.LEVELS_SQL}, w as (select run, grid_index from levels group by 1, 2 having count(q) = 8)
select run, k + 1 as level, count(*) as cells, round(avg(q), 7) as mean from levels join w using (run, grid_index) group by 1, 2
"""


def place_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written as JSON catalogues in blocks, scanned, and chosen by kind, group and tags."""
    n = A.table(spark, sf_dir, "customer").join(A.points(spark, sf_dir), F.col("c_custkey") == F.col("point_id"))
    k = F.col("c_custkey")
    item = F.struct(F.concat(F.lit("place-"), k.cast("string")).alias("slug"), F.col("c_name").alias("label"), F.when(k % 3 == 0, "city").otherwise("site").alias("kind"), F.array(F.col("c_mktsegment")).alias("groups"), F.array(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")), F.when(k % 2 == 0, "even").otherwise("odd")).alias("tags"), F.col("plat").alias("lat"), F.col("plon").alias("lon"))
    n.groupBy(F.floor(k / 1000).alias("block")).agg(F.collect_list(item).alias("items")).drop("block").write.json(path := new_path(spark, "places"))
    return P.select_places(I.scan_places(spark, path), kind="city", group="BUILDING", tags=["even"]).select("slug", "label", "lat", "lon")


PLACE_CATALOG_SQL = f"with {A.POINTS_SQL} select 'place-' || c_custkey::varchar as slug, c_name as label, plat as lat, plon as lon from customer join points on c_custkey = point_id where c_custkey % 6 = 0 and c_mktsegment = 'BUILDING'"


def level_at_800(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels within four hPa of 800, by run."""
    return _r(P.level_slice(A.levels(spark, sf_dir), 800.0, 4.0).groupBy("run").agg(F.count("*").alias("n"), F.avg("t_c").alias("t_c")))


LEVEL_AT_800_SQL = f"with {A.LEVELS_SQL} select run, count(*) as n, round(avg(t_c), 6) as t_c from levels where abs(p_hpa - 800) <= 4 group by 1"


def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose grid lacks cells."""
    return P.check_shape(A.grid(spark, sf_dir), ["run"], A.CELLS)


SHAPE_FAULTS_SQL = f"with {A.GRID_SQL} select run, count(*) as n from grid group by 1 having count(*) <> 2400"


def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels left of columns whose third level is out of order."""
    from cumula.functions.thermo import dewpoint_q

    lv = A.levels(spark, sf_dir)
    own = lv.withColumn("z", F.when((F.col("k") == 2) & (F.col("grid_index") % 3 == 0), 100.0).otherwise(F.col("z_m"))).withColumn("td", dewpoint_q(F.col("p_hpa"), F.col("q")))
    arr = own.groupBy("run", "grid_index").agg(F.array_sort(F.collect_list(F.struct("k", F.col("p_hpa").alias("p"), "z", F.col("t_c").alias("t"), "td"))).alias("a"))
    kept = arr.select("run", "grid_index", P.clean_column(F.transform("a", lambda x: F.struct(x["p"].alias("p"), x["z"].alias("z"), x["t"].alias("t"), x["td"].alias("td")))).alias("c"))
    return _r(kept.select("run", "grid_index", F.size("c").cast("long").alias("levels"), F.aggregate("c", F.lit(0.0), lambda a, x: a + x["z"]).alias("z")), 4)


CLEAN_COLUMNS_SQL = f"with {A.LEVELS_SQL} select run, grid_index, count(*) as levels, round(sum(z_m), 4) as z from levels where not (k = 2 and grid_index % 3 = 0) group by 1, 2"


def greatest_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest value of a day's hours in knots, every value standing for four hours; null where an hour lacks."""
    c = A.cells(spark, sf_dir).select("run", "grid_index", "value", F.inline(F.array(*(F.struct((F.col("fhr") * 4 + i).alias("fhr")) for i in range(1, 5)))))
    return _r(N.wind_max(c, ["run", "grid_index"], "0_24h"))


GREATEST_WIND_SQL = f"with {A.CELLS_SQL}, h as (select run, grid_index, value, fhr * 4 + i as hour from cells, (values (1), (2), (3), (4)) as t(i)) select run, grid_index, '0_24h' as span, round(case when count(value) = 24 then max(value) * {N.KT_PER_MS}::double end, 6) as max_kt from h where hour between 1 and 24 group by 1, 2"


def walk_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the way through every ten reports in order."""
    p = A.reports(spark, sf_dir).select(F.floor(F.col("report_id") / 10).alias("path"), F.col("report_id").alias("seq"), F.col("rlat").alias("lat"), F.col("rlon").alias("lon"))
    return _r(N.path_distance(p, "path").groupBy("path").agg(F.max("distance_km").alias("km")), 5)


WALK_LENGTH_SQL = f"""
with {A.REPORTS_SQL}, s as (select report_id // 10 as path, rlat as b, rlon as d, lag(rlat) over w as a, lag(rlon) over w as c from reports window w as (partition by report_id // 10 order by report_id))
select path, round(coalesce(sum(6371 * 2 * asin(sqrt(sin(radians(b - a) / 2) ** 2 + cos(radians(a)) * cos(radians(b)) * sin(radians(d - c) / 2) ** 2))), 0), 5) as km from s group by 1
"""


def lowest_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of the lowest sweep that has velocities of every volume."""
    g = A.gates(spark, sf_dir).withColumn("vel", F.when((F.col("sweep") > 0) | (F.col("volume") % 2 == 0), F.col("vel")))
    return N.lowest_sweep(g, ["volume"], F.col("vel").isNotNull()).groupBy("volume", "sweep").agg(F.count("*").alias("gates"))


LOWEST_VELOCITY_SQL = f"with {A.GATES_SQL}, l as (select *, min(elev) filter (where sweep > 0 or volume % 2 = 0) over (partition by volume) as low from gates) select volume, sweep, count(*) as gates from l where elev = low group by 1, 2"


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radials of gate arrays as rows with ranges: the pieces of every order."""
    r = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("radial")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))), lambda x: x["q"]).alias("data"))
    g = R.explode_gates(r.withColumns({"first_gate_m": F.lit(2125.0), "gate_size_m": F.lit(250.0)}))
    return _r(g.select("radial", F.col("gate").cast("long").alias("gate"), "range_km", "value"))


GATE_ROWS_SQL = "select l_orderkey as radial, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) - 1 as gate, round((2125 + 250 * (row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) - 1)) / 1000.0::double, 6) as range_km, l_quantity::double as value from lineitem"


def written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as CSV, artifacts by content and flashes as JSON, written and read back."""
    a = A.artifacts(spark, sf_dir, "l")
    O.write_artifacts(a.union(a), one := new_path(spark, "artifacts"))
    O.write_flashes(A.flashes(spark, sf_dir).select("flash_id", "source_file"), two := new_path(spark, "flashes"))
    O.write_table(V.mean_level_pressure(A.levels(spark, sf_dir), ["run"]), three := new_path(spark, "levels"))
    rows = lambda n, df: df.agg(F.lit(n).alias("written"), F.count("*").alias("rows"))
    return rows("artifacts", spark.read.parquet(one)).union(rows("flashes", spark.read.json(two))).union(rows("levels", spark.read.csv(three, header=True)))


WRITTEN_TABLES_SQL = f"""
with {A.ARTIFACTS_SQL}, {A.GRID_SQL} select 'artifacts' as written, count(*) as rows from artifacts where side = 'l'
union all select 'flashes', count(*) from events union all select 'levels', 8 * count(distinct run) from grid
"""

QUERIES = {f.__name__: f for f in (smoke_pair, hybrid_volume, place_catalog, level_at_800, shape_faults, clean_columns, greatest_wind, walk_length, lowest_velocity, gate_rows, written_tables)}
ORACLES = {
    "smoke_pair": SMOKE_PAIR_SQL, "hybrid_volume": HYBRID_VOLUME_SQL, "place_catalog": PLACE_CATALOG_SQL, "level_at_800": LEVEL_AT_800_SQL, "shape_faults": SHAPE_FAULTS_SQL, "clean_columns": CLEAN_COLUMNS_SQL,
    "greatest_wind": GREATEST_WIND_SQL, "walk_length": WALK_LENGTH_SQL, "lowest_velocity": LOWEST_VELOCITY_SQL, "gate_rows": GATE_ROWS_SQL, "written_tables": WRITTEN_TABLES_SQL,
}
