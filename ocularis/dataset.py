"""A dataset: the canonical tables as lazy DataFrames, with provenance. Copies are free, since no operation changes a table."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .errors import ValidationError
from .functions.columns import finite

#: Columns that point to another table's key.
REFERENCES = (("streams", "recording_id", "recordings"), ("gaze_samples", "recording_id", "recordings"), ("eye_samples", "recording_id", "recordings"), ("episodes", "recording_id", "recordings"), ("events", "recording_id", "recordings"), ("intervals", "recording_id", "recordings"), ("responses", "recording_id", "recordings"), ("biometrics", "recording_id", "recordings"), ("gaze_samples", "stream_id", "streams"), ("gaze_samples", "coordinate_space_id", "coordinate_spaces"), ("aoi_geometry", "aoi_id", "aoi_definitions"))
_ISSUE = "severity string, code string, table string, field string, message string"


@dataclass(frozen=True)
class Dataset:
    """Tables by name, and what was done to them."""

    tables: dict[str, DataFrame]
    history: tuple[tuple[str, str, str], ...] = field(default=())

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def with_table(self, name: str, df: DataFrame, action: str = "set") -> Dataset:
        now = datetime.datetime.now(datetime.UTC).isoformat()
        return replace(self, tables={**self.tables, name: schema.standardize(df, name)}, history=(*self.history, (now, action, name)))

    def append(self, name: str, df: DataFrame) -> Dataset:
        return self.with_table(name, self.tables[name].unionByName(schema.standardize(df, name), allowMissingColumns=True), "append")

    def provenance(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.history), "timestamp string, action string, component string")


def new_dataset(spark: SparkSession, **tables: DataFrame) -> Dataset:
    """All canonical tables: those given, standardised, and empty ones."""
    return Dataset({n: schema.standardize(tables[n], n) if n in tables else schema.empty_table(spark, n) for n in schema.TABLES}, ())


def validation_issues(data: Dataset) -> DataFrame:
    """Null and repeated keys, references to rows that aren't there, times that aren't finite, intervals that end before they start."""
    spark = next(iter(data.tables.values())).sparkSession
    found = spark.createDataFrame([], _ISSUE)

    def add(df: DataFrame, severity: str, code: str, table: str, col: str) -> DataFrame:
        return df.limit(1).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(table).alias("table"), F.lit(col).alias("field"), F.lit(f"{table}.{col}: {code}").alias("message"))

    for table, keys in schema.KEYS.items():
        df = data[table]
        blank = F.lit(False)
        for k in keys:
            blank = blank | F.col(k).isNull() | (F.trim(k) == "")
        found = found.unionByName(add(df.filter(blank), "error", "missing_key", table, keys[0]))
        found = found.unionByName(add(df.groupBy(*keys).count().filter("count > 1"), "error", "duplicate_key", table, keys[0]))
    for table, col, target in REFERENCES:
        lost = data[table].filter(F.col(col).isNotNull()).select(col).join(data[target].select(F.col(schema.KEYS[target][0]).alias(col)), col, "left_anti")
        found = found.unionByName(add(lost, "error", "orphan_reference", table, col))
    for table in ("gaze_samples", "eye_samples", "biometrics"):
        found = found.unionByName(add(data[table].filter(finite("timestamp_seconds").isNull()), "warning", "missing_time", table, "timestamp_seconds"))
    for table in ("intervals", "episodes"):
        found = found.unionByName(add(data[table].filter(finite("end_time") < finite("start_time")), "error", "negative_interval", table, "end_time"))
    return found


def require_valid(data: Dataset) -> Dataset:
    """data itself, or an error that lists what is wrong: an action."""
    bad = [r["message"] for r in validation_issues(data).filter("severity = 'error'").collect()]
    if bad:
        raise ValidationError("; ".join(bad))
    return data


def combine(sets: Sequence[Dataset], resolve_ids: bool = True) -> Dataset:
    """Tables bound together; recording ids of later sets get a suffix so that they stay apart."""
    tables = dict(sets[0].tables)
    for k, other in enumerate(sets[1:], 2):
        for name, df in other.tables.items():
            if resolve_ids and "recording_id" in df.columns:
                df = df.withColumn("recording_id", F.concat("recording_id", F.lit(f"_set{k}")))
            tables[name] = tables[name].unionByName(df, allowMissingColumns=True)
    for name in ("coordinate_spaces", "aoi_definitions"):
        tables[name] = tables[name].dropDuplicates(list(schema.KEYS[name]))
    return Dataset(tables, tuple(h for s in sets for h in s.history))


def convert_xy(df: DataFrame, x: str, y: str, source: str, target: str, width: float, height: float, clip: bool = False) -> DataFrame:
    """Coordinates between pixels and normalised, from the top left or the bottom left."""
    a, b = finite(x), finite(y)
    if "pixels" in source:
        a, b = a / width, b / height
    if source.endswith("bottom_left") != target.endswith("bottom_left"):
        b = 1 - b
    if clip:
        a, b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), b))
    if "pixels" in target:
        a, b = a * width, b * height
    return df.withColumns({x: a, y: b})
