"""Partitioned store of dataset tables: Parquet by keys, filters and columns pushed to the scan, a manifest of what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..errors import BackendError


def write_store(data: Dataset, path: str, keys: Sequence[str] = ("recording_id",), max_rows: int = 1_000_000, format: str = "parquet") -> None:
    """One folder a table, partitioned by those keys that it has."""
    if format == "rds":
        raise BackendError("rds needs an outside engine")
    for name, df in data.tables.items():
        by = [k for k in keys if k in df.columns]
        writer = (df.repartition(*by) if by else df).write.mode("overwrite").option("maxRecordsPerFile", max_rows)
        (writer.partitionBy(*by) if by else writer).format(format).save(f"{path}/{name}")


def query_store(spark: SparkSession, path: str, table: str, filters: dict[str, Sequence] | None = None, columns: Sequence[str] | None = None, format: str = "parquet") -> DataFrame:
    """Rows of a table whose columns have one of the given values; partitions and row groups that can't match aren't read."""
    df = spark.read.format(format).load(f"{path}/{table}")
    for c, values in (filters or {}).items():
        df = df.filter(F.col(c).isin(*values))
    return df.select(*columns) if columns else df


def store_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")


def export_bids(samples: DataFrame, path: str) -> None:
    """Tab-separated samples in a folder for each subject and recording."""
    rows = samples.select(F.concat(F.lit("sub-"), "participant_id").alias("sub"), "recording_id", "timestamp_seconds", "gaze_x", "gaze_y")
    rows.repartition("sub", "recording_id").sortWithinPartitions("timestamp_seconds").write.mode("overwrite").partitionBy("sub", "recording_id").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def import_bids(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.select(F.regexp_replace("sub", "^sub-", "").alias("participant_id"), "recording_id", *(F.col(c).try_cast("double").alias(c) for c in ("timestamp_seconds", "gaze_x", "gaze_y")))
