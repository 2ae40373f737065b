"""Readers of SMI, Pupil Core and EyeLink report exports, and the pairing of a folder's files.

Each gives tables by name. Rows that aren't what their table holds (a time that is no number) are kept in
``rejected`` with a reason, so that nothing is lost in silence. All columns are read as text in one pass;
a file may be split over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError

#: Names, in lower case, that SMI exports give to each field.
SMI = {
    "timestamp_native": ("time", "timestamp", "time [ms]", "time [us]"),
    "gaze_x": ("point of regard x [px]", "por x [px]", "mapped gaze data point x", "gaze x", "l por x [px]", "x"),
    "gaze_y": ("point of regard y [px]", "por y [px]", "mapped gaze data point y", "gaze y", "l por y [px]", "y"),
    "right_x": ("r por x [px]", "right por x [px]"),
    "right_y": ("r por y [px]", "right por y [px]"),
    "pupil_left": ("l pupil diameter [mm]", "left pupil diameter", "l diameter"),
    "pupil_right": ("r pupil diameter [mm]", "right pupil diameter", "r diameter"),
    "participant_id": ("participant", "subject", "participant_id"),
    "recording_id": ("recording", "session", "recording_id"),
    "trial_id": ("trial", "trial index"),
    "stimulus_id": ("stimulus", "stimulus name"),
}
#: Names, in lower case, that sample reports give to each field.
EYELINK = {
    "timestamp_native": ("timestamp", "sample_time", "time"),
    "gaze_x": ("average_gaze_x", "right_gaze_x", "left_gaze_x"),
    "gaze_y": ("average_gaze_y", "right_gaze_y", "left_gaze_y"),
    "pupil_diameter": ("average_pupil_size", "right_pupil_size", "left_pupil_size"),
    "recording_id": ("recording_session_label", "session_label"),
    "trial_id": ("trial_index", "trial"),
    "event_name": ("sample_message",),
}
#: The files of a Pupil Core export and their columns.
CORE_GAZE = {"timestamp_native": ("gaze_timestamp", "world_timestamp", "timestamp"), "gaze_x": ("norm_pos_x", "gaze_x", "x"), "gaze_y": ("norm_pos_y", "gaze_y", "y"), "confidence": ("confidence",), "stimulus_id": ("world_index",)}
CORE_PUPIL = {"timestamp_native": ("pupil_timestamp", "timestamp"), "eye": ("eye_id", "id", "eye"), "pupil_diameter": ("diameter_3d", "diameter"), "confidence": ("confidence",)}
CORE_FIXATIONS = {"fixation_id": ("id",), "timestamp_native": ("start_timestamp",), "duration_ms": ("duration",), "centroid_x": ("norm_pos_x",), "centroid_y": ("norm_pos_y",), "confidence": ("confidence",)}
_TEXT = ("participant_id", "recording_id", "trial_id", "stimulus_id", "event_name", "eye", "fixation_id")


def chosen(columns: Sequence[str], names: Mapping[str, Sequence[str]], needed: Sequence[str] = ("timestamp_native", "gaze_x", "gaze_y")) -> dict[str, str]:
    """Field to column: the first candidate that a header has, without regard to case and blanks; a needed field without one is an error."""
    lower = {c.strip().lower(): c for c in reversed(columns)}
    found = {f: next(lower[n] for n in candidates if n in lower) for f, candidates in names.items() if any(n in lower for n in candidates)}
    missing = [f for f in needed if f not in found]
    if missing:
        raise SchemaError(f"the export has no {', '.join(missing)}")
    return found


def _fields(found: Mapping[str, str], missing: Sequence[str] = ()) -> list[Column]:
    known = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin(*missing), F.trim(F.col(f"`{c}`"))) if missing else F.trim(F.col(f"`{c}`"))
    return [known(c).alias(f) if f in _TEXT else known(c).try_cast("double").alias(f) for f, c in found.items()]


def _split(raw: DataFrame, fields: list[Column], time: str, unit: float) -> tuple[DataFrame, DataFrame]:
    """Rows with a time, in seconds beside the native one, and the others with a reason."""
    rows = raw.select(F.input_file_name().alias("source_file"), *fields, F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns))).alias("_raw"), F.col(f"`{time}`").alias("_time"))
    bad = F.col("timestamp_native").isNull() | F.isnan("timestamp_native")
    reason = F.when(F.trim(F.coalesce("_time", F.lit(""))) == "", "no time").otherwise("time is not a number")
    return rows.filter(~bad).drop("_raw", "_time").withColumn("timestamp_seconds", F.col("timestamp_native") * unit), rows.filter(bad).select("source_file", reason.alias("reason"), F.col("_raw").alias("row"))


def read_smi(spark: SparkSession, path: str, unit_seconds: float = 1e-6) -> dict[str, DataFrame]:
    """gaze_samples, events and rejected of BeGaze text exports (a file or a folder of files with one header); microseconds.

    Lines that begin with ``##`` are the export's description. In exports with a Type column, SMP rows are samples and MSG rows events, whose text follows ``# Message:``."""
    if path.lower().endswith(".idf"):
        raise SchemaError("IDF files are read by the vendor's software alone: export them as text")
    raw = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    found = chosen(raw.columns, SMI)
    kinds = [c for c in raw.columns if c.strip().lower() == "type"]
    message = F.upper(F.trim(F.col(f"`{kinds[0]}`"))) == "MSG" if kinds else F.lit(False)
    samples, rejected = _split(raw.filter(~F.coalesce(message, F.lit(False))), _fields(found), found["timestamp_native"], unit_seconds)
    # the message is in the first column after the time, type and trial that has one
    texts = [F.when(F.col(f"`{c}`").startswith("# Message:"), F.trim(F.substring(F.col(f"`{c}`"), 11, 1_000_000))) for c in raw.columns]
    keep = {f: c for f, c in found.items() if f in ("timestamp_native", "participant_id", "recording_id", "trial_id", "stimulus_id")}
    events, lost = _split(raw.filter(message), [*_fields(keep), F.coalesce(*texts).alias("event_name")], found["timestamp_native"], unit_seconds)
    return {"gaze_samples": samples, "events": events, "rejected": rejected.unionByName(lost)}


def read_eyelink_report(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None, unit_seconds: float = 1e-3) -> dict[str, DataFrame]:
    """gaze_samples, events (rows with a message, if the report has them) and rejected of a Data Viewer sample report: tab-separated, a dot for what is missing; milliseconds."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    found = dict(mapping) if mapping else chosen(raw.columns, EYELINK)
    rows, rejected = _split(raw, _fields(found, (".",)), found["timestamp_native"], unit_seconds)
    tables = {"gaze_samples": rows.drop("event_name"), "rejected": rejected}
    if "event_name" in found:
        keys = [k for k in ("recording_id", "trial_id") if k in found]
        tables["events"] = rows.filter("event_name is not null and event_name != ''").select("source_file", *keys, "timestamp_native", "timestamp_seconds", "event_name")
    return tables


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_pupil_core(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """gaze_samples, and where the folder has their files pupil_samples and episodes, and rejected of a Pupil Core export folder; seconds, normalised coordinates from the bottom left.

    Eye 0 is the right one. Fixations last duration milliseconds from their start."""
    base = path.rstrip("/")
    if not _exists(spark, f"{base}/gaze_positions.csv"):
        raise SchemaError("the folder has no gaze_positions.csv")
    tables, rejected = {}, []
    for name, file, names, needed in (("gaze_samples", "gaze_positions.csv", CORE_GAZE, ("timestamp_native", "gaze_x", "gaze_y")), ("pupil_samples", "pupil_positions.csv", CORE_PUPIL, ("timestamp_native", "pupil_diameter")), ("episodes", "fixations.csv", CORE_FIXATIONS, ("timestamp_native", "duration_ms"))):
        if not _exists(spark, f"{base}/{file}"):
            continue
        raw = spark.read.option("header", True).csv(f"{base}/{file}")
        found = chosen(raw.columns, names, needed)
        tables[name], bad = _split(raw, _fields(found), found["timestamp_native"], 1.0)
        rejected.append(bad)
    if "eye" in tables.get("pupil_samples", tables["gaze_samples"]).columns:
        tables["pupil_samples"] = tables["pupil_samples"].withColumn("eye", F.when(F.lower("eye").isin("0", "right", "r"), "right").otherwise("left"))
    if "episodes" in tables:
        tables["episodes"] = tables["episodes"].withColumns({"start_time": F.col("timestamp_seconds"), "end_time": F.col("timestamp_seconds") + F.col("duration_ms") / 1000, "episode_type": F.lit("fixation")})
    out = rejected[0]
    for r in rejected[1:]:
        out = out.unionByName(r)
    return tables | {"rejected": out}


def pair_exports(spark: SparkSession, path: str) -> DataFrame:
    """file, export_type (gaze, fixations, user, summary or other) and pair (the name without what says the type) of every text export in a folder, at any depth. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,txt,tsv,CSV,TXT,TSV}").load(path).select(F.col("path").alias("file"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[A-Za-z]+$", "")
    named = files.withColumn("_s", F.lower(stem))
    kind = F.when(F.col("_s").rlike(r"summary|aoi[_ -]?statistics"), "summary").when(F.col("_s").rlike(r"(^|[_ -])fixations?$|[_ -]user[_ -]?fix$"), "fixations").when(F.col("_s").rlike(r"(^|[_ -])all[_ -]?gaze$"), "gaze").when(F.col("_s").rlike(r"(^|[_ -])user$"), "user").otherwise("other")
    pair = F.regexp_replace(stem, r"(?i)[_ -](all[_ -]?gaze|fixations?|user([_ -]?fix)?)$", "")
    return named.select("file", kind.alias("export_type"), F.when(kind == "summary", "summary").otherwise(pair).alias("pair"))


def audit_pairs(pairs: DataFrame) -> DataFrame:
    """A row a pair but summaries: number of files, whether it has gaze and fixations, and status complete, no_gaze, no_fixations or duplicate (two files of a kind)."""
    rows = pairs.filter("export_type != 'summary'")
    counts = rows.groupBy("pair").agg(F.count("*").alias("n_files"), F.count_if(F.col("export_type") == "gaze").alias("_g"), F.count_if(F.col("export_type") == "fixations").alias("_f"))
    status = F.when((F.col("_g") > 1) | (F.col("_f") > 1), "duplicate").when(F.col("_g") == 0, "no_gaze").when(F.col("_f") == 0, "no_fixations").otherwise("complete")
    return counts.select("pair", "n_files", (F.col("_g") > 0).alias("has_gaze"), (F.col("_f") > 0).alias("has_fixations"), status.alias("status"))
