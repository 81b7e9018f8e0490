"""Readers of reports, catalogues, run records and timesteps, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumula.functions.wind import norm_lon
from cumula.operators.filters import in_bounds

POIS = "items array<struct<id:string,name:string,kind:string,lat:double,lon:double,heading:double,county:string>>"
PLACES = "items array<struct<slug:string,label:string,kind:string,groups:array<string>,tags:array<string>,lat:double,lon:double>>"
RUN_REPORT = "run_id string, kind string, artifacts array<struct<artifact_key:string,lane:string,state:string,detail:string,sha256:string,timing_ms:bigint>>"


def scan_timestep(spark: SparkSession, path: str, model: str, cycle: str, fhr: int, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One hour of a Parquet table partitioned by model, cycle and fhr, cropped to west, east, south, north.

    Both conditions reach the scan: partitions are pruned, and latitudes and
    longitudes are compared with the files' own bounds.
    """
    df = spark.read.parquet(path).where((F.col("model") == model) & (F.col("cycle") == cycle) & (F.col("fhr") == fhr))
    return df.where(in_bounds(F.col("lat"), F.col("lon"), *bounds)) if bounds else df


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Storm reports (report_id, report_type, lat, lon) of CSV files whose headers may be aliases.

    Rows with wrong coordinates go; types are lower-cased; rows without an id
    are named by file order.
    """
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}

    def first(*aliases: str) -> Column:
        own = [F.col(f"`{names[a]}`") for a in aliases if a in names]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    lat, lon = first("lat", "latitude").try_cast("double"), first("lon", "longitude").try_cast("double")
    out = raw.select(F.coalesce(first("id", "report_id"), F.concat(F.lit("report_"), F.monotonically_increasing_id().cast("string"))).alias("report_id"), F.lower(F.btrim(first("report_type", "type"))).alias("report_type"), lat.alias("lat"), lon.alias("lon"))
    return out.where("lat between -90 and 90 and lon between -360 and 360").withColumn("lon", norm_lon(F.col("lon")))


def scan_pois(spark: SparkSession, path: str) -> DataFrame:
    """Points of interest of JSON catalogues."""
    return spark.read.schema(POIS).json(path).select(F.inline("items")).orderBy("id")


def scan_places(spark: SparkSession, path: str) -> DataFrame:
    """Named places of JSON catalogues."""
    return spark.read.schema(PLACES).json(path).select(F.inline("items"))


def scan_run_reports(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of run manifests and batch reports, whichever kind a file is of, in one schema."""
    return spark.read.schema(RUN_REPORT).json(path).select("run_id", "kind", F.inline("artifacts"))


def scan_volume(levels: DataFrame, field: str, count: int) -> DataFrame:
    """Hybrid levels 1 to ``count`` of a field, for the cells that have them all."""
    own = levels.where((F.col("field") == field) & (F.col("level_type") == "hybrid") & F.col("level").between(1, count))
    whole = own.groupBy("run", "grid_index").agg(F.countDistinct("level").alias("n")).where(F.col("n") == count).drop("n")
    return own.join(whole, ["run", "grid_index"], "left_semi")
