"""Audits of pupils, AOI tables, feature windows, levels and missing data, and summaries of negative controls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import anyof, finite, ratio, share
from .reliability import summarise_within_between_variance


def trial_table(intervals: DataFrame, kind: str = "interval_type") -> DataFrame:
    return intervals.filter(F.col(kind) == "trial")


def audit_pupil_quality(df: DataFrame, by: Sequence[str], pupil: str, interpolated: str | None = None, maximum_interpolated: float = 0.2, plausible: tuple[float, float] | None = None) -> DataFrame:
    """Shares of interpolated and of implausible pupils of each group, with a status; a null flag or pupil is left out of its share."""
    burden = F.avg(F.col(interpolated).cast("double")) if interpolated else F.lit(0.0)
    y = finite(pupil)
    outside = F.avg(F.when(y.isNotNull(), (~y.between(*plausible)).cast("double"))) if plausible else F.lit(None).cast("double")
    out = df.groupBy(*by).agg(F.count("*").alias("n"), burden.alias("interpolated_fraction"), outside.alias("out_of_range_fraction"))
    bad = ~F.coalesce(F.col("interpolated_fraction") <= maximum_interpolated, F.lit(False)) | F.coalesce(F.col("out_of_range_fraction") > 0, F.lit(False))
    return out.withColumn("status", F.when(bad, "warning").otherwise("ok"))


def audit_aois(definitions: DataFrame, geometry: DataFrame, spaces: DataFrame) -> DataFrame:
    """Whether each AOI has a geometry and a registered coordinate space."""
    counts = geometry.groupBy("aoi_id").agg(F.count("*").alias("n_geometry_records"))
    known = spaces.select("coordinate_space_id").dropna().distinct().withColumn("coordinate_registered", F.lit(True))
    out = definitions.join(counts, "aoi_id", "left").join(known, "coordinate_space_id", "left").fillna({"n_geometry_records": 0}).withColumn("coordinate_registered", F.coalesce("coordinate_registered", F.lit(False)))
    return out.withColumn("status", F.when((F.col("n_geometry_records") > 0) & F.col("coordinate_registered"), "ok").otherwise("error"))


def check_process_leakage(features: DataFrame, responses: DataFrame, keys: Sequence[str], window_end: str, response_time: str, order: str, tolerance: float = 0.0) -> DataFrame:
    """Features whose window ends after the first response (by order) of their trial."""
    first = responses.groupBy(*keys).agg(F.min_by(response_time, order).alias("response_timestamp"))
    joined = features.join(first, list(keys), "left")
    late = F.coalesce(finite(window_end) > finite("response_timestamp") + tolerance, F.lit(False))
    return joined.withColumn("post_response", late).withColumn("status", F.when(late, "error").otherwise("ok"))


def check_feature_level(features: DataFrame, required: Mapping[str, Sequence[str]], level: str = "level") -> DataFrame:
    """The keys that a feature of its level lacks, null or blank, joined by commas."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    missing = F.lit("")
    for name, keys in required.items():
        lacking = F.concat_ws(",", *(F.when(blank(k), F.lit(k)) for k in keys))
        missing = F.when(F.col(level) == name, lacking).otherwise(missing)
    return features.withColumn("missing_keys", missing).withColumn("status", F.when(F.col("missing_keys") != "", "warning").otherwise("ok"))


def identify_mediation_levels(df: DataFrame, columns: Sequence[str], person: str, tolerance: float = 1e-12) -> DataFrame:
    """Whether each variable varies within persons, between them, both or neither."""
    parts = summarise_within_between_variance(df, columns, person)
    within, between = (F.coalesce(F.col(c) > tolerance, F.lit(False)) for c in ("within", "between"))
    level = F.when(within & between, "within_and_between").when(within, "within_only").when(between, "between_only").otherwise("constant_or_unidentified")
    return parts.select("variable", within.alias("has_within_variation"), between.alias("has_between_variation"), level.alias("level"))


def audit_mediation_missingness(df: DataFrame, x: str, mediator: str, outcome: str, quality: str | None = None, minimum_quality: float | None = None) -> DataFrame:
    """Counts and shares of missing and poor trials; a mediator that was observed to be zero isn't missing."""
    m = finite(mediator)
    poor = F.coalesce(finite(quality) < minimum_quality, F.lit(True)) if quality else F.lit(False)
    flags: dict[str, Column] = {
        "x_missing": F.col(x).isNull(),
        "mediator_not_observed": m.isNull(),
        "mediator_observed_zero": F.coalesce(m == 0, F.lit(False)),
        "mediator_observed_nonzero": F.coalesce(m != 0, F.lit(False)),
        "poor_quality_trial": poor,
        "response_missing": F.col(outcome).isNull(),
    }
    sums = df.agg(F.count("*").alias("_n"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    return sums.unpivot(["_n"], list(flags), "issue", "n").select("issue", "n", ratio("n", "_n").alias("proportion"))


def validate_gaze_survival_data(data: DataFrame, time: str = "analysis_time", event: str = "event_observed") -> DataFrame:
    """Rows of each issue: no time, a time that isn't positive, no indicator, an event without a time of its own."""
    t = finite(time)
    flags = {"missing_time": t.isNull(), "nonpositive_time": F.coalesce(t <= 0, F.lit(False)), "missing_indicator": F.col(event).isNull(), "event_without_time": F.coalesce(F.col(event), F.lit(False)) & finite("event_time").isNull()}
    sums = data.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    return sums.unpivot(["n_rows"], list(flags), "issue", "n").withColumn("valid", F.col("n") == 0)


def summarise_negative_controls(results: DataFrame, effect: str = "effect", control: str = "control", threshold: float = 0.0) -> DataFrame:
    """Distribution of each control's effects and how often they exceed the threshold."""
    e = finite(effect)
    return results.groupBy(control).agg(
        F.count("*").alias("n"),
        F.count(e).alias("n_finite"),
        F.avg(e).alias("mean"),
        F.stddev_samp(e).alias("sd"),
        F.median(e).alias("median"),
        F.percentile(e, F.lit(0.025)).alias("q025"),
        F.percentile(e, F.lit(0.975)).alias("q975"),
        F.avg(F.when(e.isNotNull(), (F.abs(e) > abs(threshold)).cast("double"))).alias("exceedance_rate"),
    )


def negative_control_concordance(summary: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Whether each control's mean effect is within the tolerance; null where it has none."""
    return summary.withColumn("within_tolerance", F.abs("mean") <= tolerance)


def feature_availability(features: DataFrame, available: str, decision: str) -> DataFrame:
    """Share of each feature's rows that were there in time for the decision; unknown times count as late."""
    ready = F.coalesce(finite(available) <= finite(decision), F.lit(False))
    return features.groupBy("feature_name").agg(F.count("*").alias("n"), share(ready).alias("available_fraction"), F.count_if(~ready).alias("n_late"))


def quantify_process_leakage(grouped: DataFrame, pooled: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """How much better a score is where groups may cross folds than where they may not."""
    a, b = grouped.select(*keys, F.col(score).alias("grouped")), pooled.select(*keys, F.col(score).alias("pooled"))
    return a.join(b, list(keys)).withColumn("optimism", F.col("pooled") - F.col("grouped"))


def any_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumn("any_missing", anyof([F.col(c).isNull() for c in columns]))
