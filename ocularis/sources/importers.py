"""Readers: delimited exports by column mapping, EyeLink ASC text, and a registry of formats."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError

#: Names, in lower case, that exports give to each canonical field.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "timestamp_native": ("timestamp", "time", "timestamp_ms", "recording timestamp", "timestamp [ns]", "time(sec)"),
    "gaze_x": ("gaze_x", "x", "gaze point x", "gaze x [px]", "fpogx", "bpogx"),
    "gaze_y": ("gaze_y", "y", "gaze point y", "gaze y [px]", "fpogy", "bpogy"),
    "pupil_diameter": ("pupil", "pupil_diameter", "pupil diameter", "lpd", "rpd"),
    "recording_id": ("recording", "recording_id", "recording name", "recording id"),
    "participant_id": ("participant", "participant_id", "participant name", "user", "subject"),
    "trial_id": ("trial", "trial_id", "trial index"),
    "stimulus_id": ("stimulus", "stimulus_id", "media_id", "presented stimulus name"),
}


def infer_mapping(columns: list[str]) -> dict[str, str]:
    """Canonical field to source column: the first candidate that a header has, without regard to case."""
    lower = {c.strip().lower(): c for c in columns}
    return {f: next(lower[n] for n in names if n in lower) for f, names in CANDIDATES.items() if any(n in lower for n in names)}


def mapped_samples(df: DataFrame, mapping: dict[str, str], unit_seconds: float = 1.0) -> DataFrame:
    """Samples by canonical names; values that aren't numbers become null."""
    for field in ("timestamp_native", "gaze_x", "gaze_y"):
        if field not in mapping:
            raise SchemaError(f"the mapping has no {field}")
    numeric = ("timestamp_native", "gaze_x", "gaze_y", "pupil_diameter")
    cols = [F.col(f"`{c}`").try_cast("double").alias(f) if f in numeric else F.col(f"`{c}`").cast("string").alias(f) for f, c in mapping.items()]
    return df.select(*cols).withColumn("timestamp_seconds", F.col("timestamp_native") * unit_seconds)


def read_delimited(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, delimiter: str = ",", unit_seconds: float = 1.0) -> DataFrame:
    """Samples of delimited files with a header. All columns are read as text, so no pass infers types."""
    raw = spark.read.option("header", True).option("sep", delimiter).csv(path)
    return mapped_samples(raw, mapping or infer_mapping(raw.columns), unit_seconds)


def read_gazepoint(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path)


def read_tobii(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, microseconds."""
    return read_delimited(spark, path, None, "\t", 1e-6)


def read_pupil_neon(spark: SparkSession, path: str) -> DataFrame:
    """Nanoseconds."""
    return read_delimited(spark, path, None, ",", 1e-9)


def read_eyelink_asc(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Samples, messages and episodes (fixation, saccade, blink) of ASC files; each line says what it is."""
    lines = spark.read.text(path).select(F.input_file_name().alias("source_file"), F.split(F.trim("value"), r"\s+").alias("f"), F.col("value"))
    number = lambda k: F.get("f", F.lit(k)).try_cast("double")
    samples = lines.filter(F.col("value").rlike(r"^\d")).select("source_file", (number(0) / 1000).alias("timestamp_seconds"), number(1).alias("gaze_x"), number(2).alias("gaze_y"), number(3).alias("pupil_diameter"))
    messages = lines.filter(F.col("value").startswith("MSG")).select("source_file", (number(1) / 1000).alias("timestamp_seconds"), F.array_join(F.slice("f", 3, 1_000), " ").alias("event_name"))
    kind = F.when(F.get("f", F.lit(0)) == "EFIX", "fixation").when(F.get("f", F.lit(0)) == "ESACC", "saccade").when(F.get("f", F.lit(0)) == "EBLINK", "blink")
    episodes = lines.withColumn("episode_type", kind).filter("episode_type is not null").select("source_file", "episode_type", F.get("f", F.lit(1)).alias("eye"), (number(2) / 1000).alias("start_time"), (number(3) / 1000).alias("end_time"), number(4).alias("duration_ms"))
    return {"gaze_samples": samples, "events": messages, "episodes": episodes}


@dataclass(frozen=True)
class Adapter:
    """A format: how sure it is of a header, and how it reads."""

    name: str
    detect: Callable[[list[str]], float]
    read: Callable[[SparkSession, str], DataFrame]
    priority: int = 0


_adapters: dict[str, Adapter] = {}


def register_adapter(adapter: Adapter, overwrite: bool = False) -> None:
    if adapter.name in _adapters and not overwrite:
        raise ValueError(f"adapter {adapter.name} exists")
    _adapters[adapter.name] = adapter


def unregister_adapter(name: str) -> None:
    _adapters.pop(name, None)


def supported_formats(spark: SparkSession) -> DataFrame:
    listed = sorted(_adapters.values(), key=lambda a: (-a.priority, a.name))
    return spark.createDataFrame([(a.name, a.priority) for a in listed], "name string, priority int")


def detect_format(columns: list[str], least: float = 0.55) -> str:
    """The surest format of a header; ties go by priority and name."""
    scored = sorted(((-a.detect(columns), -a.priority, a.name) for a in _adapters.values()))
    if not scored or -scored[0][0] < least:
        raise SchemaError("no format is sure of this header")
    return scored[0][2]


def read_export(spark: SparkSession, path: str, vendor: str = "auto") -> DataFrame:
    """Samples of a file in a given or detected format; detection reads the header alone."""
    if vendor == "auto":
        vendor = detect_format(spark.read.option("header", True).csv(path).columns)
    return _adapters[vendor].read(spark, path)


register_adapter(Adapter("generic", lambda c: 0.6 if {"timestamp_native", "gaze_x", "gaze_y"} <= set(infer_mapping(c)) else 0.0, read_delimited, 1))
register_adapter(Adapter("gazepoint", lambda c: 1.0 if {"fpogx", "fpogy"} & {x.lower() for x in c} else 0.0, read_gazepoint, 100))


def read_folder(spark: SparkSession, path: str, vendor: str = "generic", pattern: str = "*.csv") -> DataFrame:
    """Samples of all files of a folder, at any depth, with the file that each row comes from."""
    delimiter = "\t" if vendor == "tobii" else ","
    raw = spark.read.option("header", True).option("sep", delimiter).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path)
    units = {"tobii": 1e-6, "pupil_neon": 1e-9}
    samples = mapped_samples(raw.withColumn("_file", F.input_file_name()), {**infer_mapping(raw.columns), "source_file": "_file"}, units.get(vendor, 1.0))
    return samples


#: Columns of Gazepoint fixation exports.
GAZEPOINT_FIXATION = {"start_time": ("fpogs",), "duration": ("fpogd",), "centroid_x": ("fpogx",), "centroid_y": ("fpogy",), "fixation_id": ("fpogid",), "valid": ("fpogv",), "media_id": ("media_id",), "participant_id": ("user", "participant")}


def read_gazepoint_fixations(spark: SparkSession, path: str) -> DataFrame:
    """Fixation episodes of an export: the last row of each fixation's id within its medium, which has its whole duration; invalid rows are left out."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.strip().lower(): c for c in raw.columns}
    found = {f: next(lower[n] for n in names if n in lower) for f, names in GAZEPOINT_FIXATION.items() if any(n in lower for n in names)}
    for field in ("start_time", "duration", "fixation_id"):
        if field not in found:
            raise SchemaError(f"the export has no {field}")
    text = ("media_id", "participant_id")
    rows = raw.select(*(F.col(f"`{c}`").cast("string").alias(f) if f in text else F.col(f"`{c}`").try_cast("double").alias(f) for f, c in found.items()))
    keys = [k for k in ("participant_id", "media_id", "fixation_id") if k in found]
    kept = rows.filter(F.col("fixation_id").isNotNull() & (F.col("valid") == 1 if "valid" in found else F.lit(True)))
    last = [F.max_by(c, "duration").alias(c) for c in ("start_time", "centroid_x", "centroid_y") if c in found]
    out = kept.groupBy(*keys).agg(*last, F.max("duration").alias("_d"))
    return out.select(*keys, *(c for c in ("start_time", "centroid_x", "centroid_y") if c in found), (F.col("start_time") + F.col("_d")).alias("end_time"), (F.col("_d") * 1000).alias("duration_ms"), F.lit("fixation").alias("episode_type"))


def validate_mapping(columns: list[str], mapping: dict[str, str]) -> list[tuple[str, str]]:
    """(field, problem) of each entry that names no canonical field or no column, and of fields that samples can't do without."""
    problems = [(f, "unknown field") for f in mapping if f not in CANDIDATES] + [(f, f"no column {c}") for f, c in mapping.items() if c not in columns]
    return problems + [(f, "missing") for f in ("timestamp_native", "gaze_x", "gaze_y") if f not in mapping]


register_adapter(Adapter("tobii", lambda c: 1.0 if "recording timestamp" in {x.lower() for x in c} else 0.0, read_tobii, 90))
register_adapter(Adapter("pupil_neon", lambda c: 1.0 if "timestamp [ns]" in {x.lower() for x in c} else 0.0, read_pupil_neon, 90))
