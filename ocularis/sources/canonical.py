"""Datasets in folders and out: canonical tables as Parquet or text, fingerprints, comparison, round trips and redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..dataset import Dataset
from ..errors import SchemaError

#: Columns that name a person or a file, in any table; fixed values.
IDENTIFYING = ("participant_id", "session_id", "source_file_set", "source_file")


def write_dataset(data: Dataset, path: str, format: str = "parquet") -> None:
    """A folder for each table. Text formats have a header."""
    for name, df in data.tables.items():
        writer = df.write.mode("overwrite").format(format)
        (writer.option("header", True) if format == "csv" else writer).save(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, tables: Sequence[str] | None = None, format: str = "parquet") -> Dataset:
    """The tables of a folder, in their canonical types; those that aren't asked for are empty."""
    wanted = set(tables or schema.TABLES)
    if unknown := wanted - set(schema.TABLES):
        raise SchemaError(f"no canonical tables {sorted(unknown)}")
    reader = spark.read.format(format)
    reader = reader.option("header", True) if format == "csv" else reader
    return Dataset({n: schema.standardize(reader.load(f"{path}/{n}"), n) if n in wanted else schema.empty_table(spark, n) for n in schema.TABLES})


def fingerprint_dataset(data: Dataset) -> DataFrame:
    """Rows, columns and an order-free hash of each table: the sum of its rows' hashes over sorted columns, exact in any partitioning."""
    out = None
    for name, df in sorted(data.tables.items()):
        columns = sorted(df.columns)
        row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)).cast("decimal(38,0)")
        one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(columns)).alias("n_columns"), "hash")
        out = one if out is None else out.unionByName(one)
    return out


def compare_datasets(left: Dataset, right: Dataset) -> DataFrame:
    """For each table of either: rows on both sides, and whether the contents are equal."""
    a, b = (fingerprint_dataset(d).select("table", F.col("n_rows").alias(f"n_{s}"), F.col("n_columns").alias(f"c_{s}"), F.col("hash").alias(f"h_{s}")) for d, s in ((left, "left"), (right, "right")))
    both = a.join(b, "table", "full")
    status = F.when(F.col("h_left").isNull(), "only_right").when(F.col("h_right").isNull(), "only_left").when(F.col("c_left") != F.col("c_right"), "columns_differ").when(F.col("n_left") != F.col("n_right"), "rows_differ").when(F.col("h_left") != F.col("h_right"), "values_differ").otherwise("equal")
    return both.select("table", "n_left", "n_right", status.alias("status"))


def roundtrip_dataset(data: Dataset, path: str, format: str = "parquet") -> DataFrame:
    """compare_datasets of a dataset and what is read back from the folder that it is written to."""
    write_dataset(data, path, format)
    spark = next(iter(data.tables.values())).sparkSession
    return compare_datasets(data, read_dataset(spark, path, list(data.tables), format))


def anonymize_dataset(data: Dataset, salt: str, columns: Sequence[str] = IDENTIFYING) -> Dataset:
    """Identifying columns as salted digests, equal values as equal ones; nulls stay."""
    hide = lambda df: df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in columns if c in df.columns})
    return Dataset({n: hide(df) for n, df in data.tables.items()}, (*data.history, ("", "anonymize", ",".join(columns))))


def schema_coverage(data: Dataset) -> DataFrame:
    """For each canonical column: whether the table has a row, and the share of its values that are there."""
    out = None
    for name, df in sorted(data.tables.items()):
        known = [c for c in schema.schema_of(name).names if c in df.columns]
        wide = df.agg(F.count("*").alias("n"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in known))
        one = wide.unpivot(["n"], known, "field", "filled_fraction").select(F.lit(name).alias("table"), "field", "n", "filled_fraction")
        out = one if out is None else out.unionByName(one)
    return out


def schema_coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("table").agg(F.max("n").alias("n_rows"), F.count("*").alias("n_fields"), F.count_if(F.col("filled_fraction") > 0).alias("n_filled"), F.avg("filled_fraction").alias("mean_filled"))


def remap_recording_ids(data: Dataset, names: DataFrame) -> Dataset:
    """Recording ids replaced by names (recording_id, new_id); those without a name stay."""
    renamed = names.select("recording_id", "new_id")
    swap = lambda df: df.join(renamed, "recording_id", "left").withColumn("recording_id", F.coalesce("new_id", "recording_id")).drop("new_id").select(*df.columns)
    return Dataset({n: swap(df) if "recording_id" in df.columns else df for n, df in data.tables.items()}, data.history)
