"""Writers of grids, tables, samples and artifact records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_field_grid(long: DataFrame, fields: list[str], path: str, keys: list[str] | None = None) -> None:
    """CSV of lat, lon and one column for each field from (keys, grid_index, lat, lon, field, value); a folder for each key."""
    wide = long.groupBy(*(keys or []), "grid_index", "lat", "lon").pivot("field", fields).agg(F.first("value", ignorenulls=True)).drop("grid_index")
    (wide.write.partitionBy(*keys) if keys else wide.write).csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    """CSV of a component, overlap or statistics table."""
    df.write.csv(path, header=True)


def sample_rows(cells: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """One row for each sample and channel: its values as a row-major array of floats and their statistics.

    ``cells`` has keys, channel, y, x and value; cells that are absent are null.
    """
    at = F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int").alias("i"), F.col("value").cast("float").alias("v"))))
    g = cells.groupBy(*keys, "channel").agg(at.alias("m"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"), F.count("value").alias("count"))
    data = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.try_element_at("m", i))
    return g.select(*keys, "channel", F.lit(height).alias("height"), F.lit(width).alias("width"), data.alias("data"), "min", "mean", "max", "std", "count", (F.lit(height * width) - F.col("count")).alias("nan_count"))


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.partitionBy("split").parquet(path)


def dataset_manifest(samples: DataFrame) -> DataFrame:
    """Samples, channels and missing values of each split."""
    return samples.groupBy("split").agg(F.countDistinct("sample_id").alias("samples"), F.countDistinct("channel").alias("channels"), F.count("*").alias("rows"), F.sum("nan_count").alias("nan_count"))


def write_artifacts(records: DataFrame, path: str) -> None:
    """Artifact records with the SHA-256 of their content as identity, one row for each identity and key."""
    records.withColumn("sha256", F.sha2(F.concat_ws("/", "artifact_key", "detail"), 256)).dropDuplicates(["artifact_key", "sha256"]).write.parquet(path)


def write_flashes(flashes: DataFrame, path: str) -> None:
    flashes.write.json(path)
