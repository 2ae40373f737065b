"""The canonical tables: names, ordered columns and types, keys, and checks of a table against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .errors import SchemaError

VERSION = "0.1.0"

#: The columns of each canonical table, in order.
TABLES: dict[str, str] = {
    "recordings": (
        "recording_id string, participant_id string, session_id string, vendor string, vendor_family string, "
        "device_model string, firmware_version string, software_name string, software_version string, experiment_type "
        "string, nominal_sampling_rate double, screen_width_px double, screen_height_px double, recording_start string, "
        "source_timezone string, source_file_set string"
    ),
    "streams": (
        "stream_id string, recording_id string, stream_type string, source_device string, source_clock string, "
        "sampling_type string, nominal_rate_hz double, observed_rate_hz double, timestamp_unit string, value_unit "
        "string, coordinate_space_id string, processing_level string"
    ),
    "gaze_samples": (
        "recording_id string, stream_id string, sample_id string, timestamp_native double, timestamp_seconds double, "
        "gaze_x double, gaze_y double, gaze_z double, azimuth_deg double, elevation_deg double, valid boolean, "
        "confidence double, fixation_id_source string, blink_id_source string, trial_id string, stimulus_id string, "
        "coordinate_space_id string"
    ),
    "eye_samples": (
        "recording_id string, sample_id string, timestamp_native double, timestamp_seconds double, eye string, "
        "pupil_diameter double, pupil_unit string, pupil_valid boolean, eye_openness double, gaze_origin_x double, "
        "gaze_origin_y double, gaze_origin_z double, gaze_origin_valid boolean, corneal_reflection_x double, "
        "corneal_reflection_y double, detector_method string, confidence double, trial_id string, stimulus_id string"
    ),
    "episodes": (
        "episode_id string, recording_id string, episode_type string, eye string, start_time double, end_time double, "
        "duration_ms double, start_x double, start_y double, end_x double, end_y double, centroid_x double, centroid_y "
        "double, amplitude double, peak_velocity double, dispersion double, coordinate_space_id string, "
        "source_algorithm string, source_parameters string, derived_by string, trial_id string, stimulus_id string, "
        "aoi_id string"
    ),
    "events": (
        "event_id string, recording_id string, timestamp_native double, timestamp_seconds double, event_type string, "
        "event_name string, event_value string, duration double, source string, native_record string, trial_id string, "
        "stimulus_id string"
    ),
    "intervals": (
        "interval_id string, recording_id string, interval_type string, start_time double, end_time double, trial_id "
        "string, participant_id string, item_id string, stimulus_id string, condition_id string, parent_interval_id "
        "string, valid_interval boolean"
    ),
    "responses": (
        "response_id string, recording_id string, participant_id string, trial_id string, item_id string, response "
        "string, score double, response_time double, response_timestamp double, response_type string, valid_response "
        "boolean"
    ),
    "coordinate_spaces": (
        "coordinate_space_id string, space_type string, origin string, x_unit string, y_unit string, width double, "
        "height double, reference_object string, parent_space_id string, transform_to_parent string, clipping_policy "
        "string"
    ),
    "aoi_definitions": (
        "aoi_id string, aoi_name string, stimulus_id string, shape_type string, coordinate_space_id string, "
        "parent_aoi_id string, source string"
    ),
    "aoi_geometry": (
        "aoi_id string, valid_from double, valid_to double, frame_id string, x double, y double, width double, height "
        "double, polygon array<struct<x:double,y:double>>, visible boolean, coordinate_space_id string"
    ),
    "biometrics": (
        "recording_id string, stream_id string, timestamp_native double, timestamp_seconds double, channel string, "
        "value double, unit string, valid boolean, processing_level string, source_device string, trial_id string, "
        "stimulus_id string"
    ),
    "calibrations": (
        "calibration_id string, recording_id string, timestamp_seconds double, calibration_type string, eye string, "
        "point_count long, average_error double, maximum_error double, error_unit string, validation_status string, "
        "drift_offset double, source_record string"
    ),
    "features": (
        "feature_id string, recording_id string, participant_id string, trial_id string, item_id string, stimulus_id "
        "string, aoi_id string, feature_name string, value double, unit string, level string, window_start double, "
        "window_end double, observed_fraction double, method string, parameters string, derived_at string"
    ),
    "quality": (
        "quality_id string, recording_id string, trial_id string, stream_id string, metric string, value double, "
        "threshold double, status string, message string, computed_at string"
    ),
    "provenance": (
        "provenance_id string, timestamp string, action string, component string, details string, source_files string, "
        "file_hashes string, software string, software_version string, reversible boolean, warnings string"
    ),
}

#: Primary keys. The other tables have none.
KEYS: dict[str, tuple[str, ...]] = {
    "recordings": ("recording_id",),
    "streams": ("stream_id",),
    "gaze_samples": ("sample_id",),
    "eye_samples": ("recording_id", "sample_id", "eye",),
    "episodes": ("episode_id",),
    "events": ("event_id",),
    "intervals": ("interval_id",),
    "responses": ("response_id",),
    "coordinate_spaces": ("coordinate_space_id",),
    "aoi_definitions": ("aoi_id",),
    "calibrations": ("calibration_id",),
    "features": ("feature_id",),
    "quality": ("quality_id",),
    "provenance": ("provenance_id",),
}


def table_names() -> list[str]:
    return list(TABLES)


def schema_of(name: str) -> StructType:
    if name not in TABLES:
        raise SchemaError(f"no canonical table {name}")
    return StructType.fromDDL(TABLES[name])


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def standardize(df: DataFrame, name: str, keep_extra: bool = True) -> DataFrame:
    """Canonical columns first and in order, absent ones as null, others after them or dropped."""
    schema = schema_of(name)
    known = {f.name for f in schema}
    cast = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cast, *([c for c in df.columns if c not in known] if keep_extra else []))


def table_issues(df: DataFrame, name: str, strict: bool = False) -> list[tuple[str, str, str, str, str]]:
    """(severity, code, table, field, message) of missing and extra columns; needs no data."""
    known = schema_of(name).names
    missing = [("error" if strict else "warning", "missing_field", name, c, f"{name} has no column {c}") for c in known if c not in df.columns]
    return missing + [("info", "extra_field", name, c, f"{c} isn't a canonical column of {name}") for c in df.columns if c not in known]
