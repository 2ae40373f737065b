"""Data quality of gaze samples: accuracy, precision, sampling, loss, and audits of signals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import changed, finite, ordered, ratio, run_id, share
from ..functions.ranks import joined_null_safe


def _steps(df: DataFrame, time: str, by: Sequence[str], row: str | None) -> DataFrame:
    """by, _t and _d: steps in row order, or in time order where there is no row number."""
    kept = df.select(*by, finite(time).alias("_t"), *([F.col(row).alias("_row")] if row else []))
    return kept.withColumn("_d", F.col("_t") - F.lag("_t").over(ordered(by, "_row" if row else "_t")))


def compute_gaze_accuracy(df: DataFrame, x: str, y: str, target_x: str, target_y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median radial error, mean absolute and signed error on each axis, samples and targets."""
    dx, dy = finite(x) - finite(target_x), finite(y) - finite(target_y)
    kept = df.select(*by, target_x, target_y, dx.alias("dx"), dy.alias("dy")).filter("dx is not null and dy is not null")
    return kept.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.hypot("dx", "dy")).alias("accuracy_mean"),
        F.median(F.hypot("dx", "dy")).alias("accuracy_median"),
        F.avg(F.abs("dx")).alias("mean_abs_dx"),
        F.avg(F.abs("dy")).alias("mean_abs_dy"),
        F.avg("dx").alias("bias_x"),
        F.avg("dy").alias("bias_y"),
        F.countDistinct(F.struct(target_x, target_y)).alias("n_targets"),
    )


def compute_rms_s2s(df: DataFrame, x: str, y: str, time: str, by: Sequence[str] = (), max_gap: float | None = None) -> DataFrame:
    """Root mean square, median and 95th percentile of the step between neighbours in time; a missing sample is never bridged."""
    w = ordered(by, time)
    a, b, t = finite(x), finite(y), finite(time)
    step = F.hypot(a - F.lag(a).over(w), b - F.lag(b).over(w))
    if max_gap is not None:
        step = F.when(t - F.lag(t).over(w) <= max_gap, step)
    steps = df.select(*by, step.alias("s"))
    return steps.groupBy(*by).agg(F.count("s").alias("n_steps"), F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("precision_rms_s2s"), F.median("s").alias("step_median"), F.percentile("s", F.lit(0.95)).alias("step_p95"))


def _complete(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).filter("_x is not null and _y is not null")


def compute_gaze_sd_precision(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    sx, sy = F.stddev_pop("_x"), F.stddev_pop("_y")
    return _complete(df, x, y, by).groupBy(*by).agg(F.count("*").alias("n"), sx.alias("sd_x"), sy.alias("sd_y"), F.sqrt(sx * sx + sy * sy).alias("precision_sd"))


def compute_bcea(df: DataFrame, x: str, y: str, by: Sequence[str] = (), probability: float = 0.68) -> DataFrame:
    """Area of the ellipse that holds this share of samples; the correlation of a constant axis is zero."""
    sx, sy = F.stddev_pop("_x"), F.stddev_pop("_y")
    rho = F.coalesce(F.try_divide(F.covar_pop("_x", "_y"), F.nullif(sx * sy, F.lit(0.0))), F.lit(0.0))
    k = -math.log(1 - probability)
    area = 2 * math.pi * k * sx * sy * F.sqrt(F.greatest(F.lit(0.0), 1 - rho * rho))
    return _complete(df, x, y, by).groupBy(*by).agg(F.count("*").alias("n"), sx.alias("sd_x"), sy.alias("sd_y"), rho.alias("rho"), area.alias("bcea"))


def estimate_sampling_interval(df: DataFrame, time: str, by: Sequence[str] = (), row: str | None = None) -> DataFrame:
    positive = F.when(F.col("_d") > 0, F.col("_d"))
    return _steps(df, time, by, row).groupBy(*by).agg(
        F.count("_t").alias("n"),
        F.median(positive).alias("interval_median"),
        F.avg(positive).alias("interval_mean"),
        F.min(positive).alias("interval_min"),
        F.max(positive).alias("interval_max"),
        F.count_if(F.col("_d") == 0).alias("n_duplicate"),
        F.count_if(F.col("_d") < 0).alias("n_nonmonotonic"),
    )


def estimate_sampling_jitter(df: DataFrame, time: str, by: Sequence[str] = (), row: str | None = None) -> DataFrame:
    """Standard deviation and unscaled median absolute deviation of positive steps."""
    steps = _steps(df, time, by, row).filter("_d > 0")
    group = Window.partitionBy(*by)
    return steps.withColumn("_m", F.abs(F.col("_d") - F.median("_d").over(group))).groupBy(*by).agg(F.count("*").alias("n_intervals"), F.stddev_samp("_d").alias("jitter_sd"), F.median("_m").alias("jitter_mad"))


def estimate_effective_sampling_rate(df: DataFrame, time: str, by: Sequence[str] = (), unit_seconds: float = 1.0, dropped_factor: float = 1.5, row: str | None = None) -> DataFrame:
    """Samples over the span and one median step more; steps longer than the factor allows, and samples they dropped."""
    steps = _steps(df, time, by, row).filter("_t is not null")
    group = Window.partitionBy(*by)
    typical = steps.withColumn("_m", F.median(F.when(F.col("_d") > 0, F.col("_d"))).over(group))
    long = F.col("_d") > dropped_factor * F.col("_m")
    span = (F.max("_t") - F.min("_t") + F.max("_m")) * unit_seconds
    return typical.groupBy(*by).agg(
        F.count("*").alias("n"),
        ratio(F.count("*"), span).alias("effective_hz"),
        F.count_if(long).alias("n_long_intervals"),
        F.coalesce(F.sum(F.when(long, F.round(ratio(F.col("_d"), F.col("_m"))) - 1)), F.lit(0.0)).cast("long").alias("n_dropped"),
    )


def effective_sampling_frequency(df: DataFrame, time: str, by: Sequence[str] = (), unit_seconds: float = 1.0) -> DataFrame:
    """Hz from the median step in time order, and the steps' coefficient of variation."""
    steps = _steps(df, time, by, None).filter("_d > 0")
    return steps.groupBy(*by).agg(ratio(F.lit(1.0), F.median("_d") * unit_seconds).alias("sampling_hz"), ratio(F.stddev_samp("_d"), F.avg("_d")).alias("interval_cv"))


def audit_sampling_irregularity(df: DataFrame, time: str, by: Sequence[str] = (), limit: float = 0.05, unit_seconds: float = 1.0) -> DataFrame:
    return effective_sampling_frequency(df, time, by, unit_seconds).withColumn("irregular", F.coalesce(F.col("interval_cv") > limit, F.lit(False)))


def compute_valid_sample_fraction(df: DataFrame, x: str, y: str, valid: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    missing = finite(x).isNull() | finite(y).isNull()
    invalid = ~F.coalesce(F.col(valid), F.lit(True)) if valid else F.lit(False)
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(~missing & ~invalid).alias("valid_fraction"), share(invalid).alias("invalid_fraction"), share(missing).alias("missing_fraction"))


def compute_gaze_data_loss(df: DataFrame, x: str, y: str, time: str, by: Sequence[str] = (), valid: str | None = None) -> DataFrame:
    """Share of lost samples, number of runs of loss, and the longest in samples and time."""
    lost = finite(x).isNull() | finite(y).isNull()
    if valid:
        lost = lost | ~F.coalesce(F.col(valid), F.lit(True))
    marked = df.select(*by, finite(time).alias("_t"), lost.alias("_lost"))
    w = ordered(by, "_t")
    runs = marked.withColumn("_run", run_id(changed("_lost", w), w))
    per_run = runs.groupBy(*by, "_run", "_lost").agg(F.count("*").alias("k"), (F.max("_t") - F.min("_t")).alias("d"))
    gone = F.col("_lost")
    return per_run.groupBy(*by).agg(
        F.sum("k").alias("n"),
        ratio(F.coalesce(F.sum(F.when(gone, F.col("k"))), F.lit(0)), F.sum("k")).alias("loss_fraction"),
        F.count_if(gone).alias("n_loss_runs"),
        F.coalesce(F.max(F.when(gone, F.col("k"))), F.lit(0)).alias("longest_loss_samples"),
        F.coalesce(F.max(F.when(gone, F.col("d"))), F.lit(0.0)).alias("longest_loss_time"),
    )


def joined_on(tables: Sequence[DataFrame], by: Sequence[str], drop: Sequence[str] = ("n",)) -> DataFrame:
    """Full outer join of tables with one row a group."""
    kept = [tables[0], *(t.drop(*drop) for t in tables[1:])]
    return reduce(lambda a, b: a.join(b, list(by), "full"), kept)


def summarise_spatial_quality(df: DataFrame, x: str, y: str, target_x: str, target_y: str, time: str, by: Sequence[str]) -> DataFrame:
    return joined_on([compute_gaze_accuracy(df, x, y, target_x, target_y, by), compute_rms_s2s(df, x, y, time, by), compute_gaze_sd_precision(df, x, y, by).drop("sd_x", "sd_y"), compute_bcea(df, x, y, by)], by)


def summarise_sampling_quality(df: DataFrame, time: str, by: Sequence[str], unit_seconds: float = 1.0, row: str | None = None) -> DataFrame:
    return joined_on([estimate_sampling_interval(df, time, by, row), estimate_sampling_jitter(df, time, by, row), estimate_effective_sampling_rate(df, time, by, unit_seconds, row=row)], by)


def create_gaze_quality_report(df: DataFrame, x: str, y: str, target_x: str, target_y: str, time: str, by: Sequence[str], unit_seconds: float = 1.0, maximum_accuracy: float = 1.0, maximum_rms: float = 0.5, minimum_valid: float = 0.8) -> DataFrame:
    """A row a group with all measures and flags for review."""
    report = joined_on([summarise_spatial_quality(df, x, y, target_x, target_y, time, by), summarise_sampling_quality(df, time, by, unit_seconds), compute_valid_sample_fraction(df, x, y, None, by)], by)
    return report.withColumns({"review_accuracy": F.coalesce(F.col("accuracy_mean") > maximum_accuracy, F.lit(True)), "review_precision": F.coalesce(F.col("precision_rms_s2s") > maximum_rms, F.lit(True)), "review_validity": F.coalesce(F.col("valid_fraction") < minimum_valid, F.lit(True))})


def gaze_data_quality_profile(df: DataFrame, x: str, y: str, time: str, by: Sequence[str], valid: str | None = None, target: tuple[str, str] | None = None, unit_seconds: float = 1.0) -> DataFrame:
    """Measures on valid rows alone: unlike compute_rms_s2s, a step here bridges what was dropped."""
    good = finite(x).isNotNull() & finite(y).isNotNull()
    if valid:
        good = good & F.coalesce(F.col(valid), F.lit(False))
    totals = df.groupBy(*by).agg(F.count("*").alias("n"), share(good).alias("valid_fraction"), (1 - share(good)).alias("data_loss"))
    kept = df.filter(good)
    parts = [totals, effective_sampling_frequency(kept, time, by, unit_seconds), compute_rms_s2s(kept, x, y, time, by).select(*by, F.col("precision_rms_s2s").alias("rms_s2s"))]
    if target:
        parts.append(kept.groupBy(*by).agg(F.avg(F.hypot(finite(x) - finite(target[0]), finite(y) - finite(target[1]))).alias("mean_error")))
    return joined_on(parts, by)


def estimate_calibration_error(df: DataFrame, x: str, y: str, target_x: str, target_y: str, by: Sequence[str] = ()) -> DataFrame:
    dx, dy = finite(x) - finite(target_x), finite(y) - finite(target_y)
    kept = df.select(*by, dx.alias("dx"), dy.alias("dy")).filter("dx is not null and dy is not null").withColumn("r", F.hypot("dx", "dy"))
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg("dx").alias("bias_x"), F.avg("dy").alias("bias_y"), F.avg("r").alias("mean_error"), F.median("r").alias("median_error"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms_error"), F.percentile("r", F.lit(0.95)).alias("p95_error"))


def calibration_error_model(df: DataFrame, x: str, y: str, target_x: str, target_y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean error and its covariance."""
    dx, dy = finite(x) - finite(target_x), finite(y) - finite(target_y)
    kept = df.select(*by, dx.alias("dx"), dy.alias("dy")).filter("dx is not null and dy is not null")
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg("dx").alias("mean_x"), F.avg("dy").alias("mean_y"), F.var_samp("dx").alias("var_x"), F.var_samp("dy").alias("var_y"), F.covar_samp("dx", "dy").alias("cov_xy"))


def detect_calibration_drift(df: DataFrame, dx: str, dy: str, time: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean error of each time window from the group's first time, its distance from the first window, and whether that is beyond
    max(95th percentile of the distances, two standard deviations of the samples' error distances)."""
    rows = df.select(*by, finite(time).alias("_t"), finite(dx).alias("dx"), finite(dy).alias("dy")).filter("_t is not null and dx is not null and dy is not null")
    whole = rows.groupBy(*by).agg(F.min("_t").alias("_t0"), F.stddev_samp(F.hypot("dx", "dy")).alias("_sd"))
    binned = joined_null_safe(rows, whole, by).withColumn("window", F.floor((F.col("_t") - F.col("_t0")) / width) + 1)
    means = binned.groupBy(*by, "window").agg(F.count("*").alias("n"), F.avg("dx").alias("error_x"), F.avg("dy").alias("error_y"), F.avg(F.hypot("dx", "dy")).alias("error_distance"), F.max("_sd").alias("_sd"))
    w, group = ordered(by, "window"), Window.partitionBy(*by)
    moved = means.withColumn("drift", F.hypot(F.col("error_x") - F.first("error_x").over(w), F.col("error_y") - F.first("error_y").over(w)))
    limit = F.greatest(F.percentile("drift", F.lit(0.95)).over(group), 2 * F.coalesce("_sd", F.lit(0.0)))
    return moved.withColumn("limit", limit).withColumn("flagged", F.col("drift") > F.col("limit")).drop("_sd")


def audit_recalibration(before: DataFrame, after: DataFrame, dx: str, dy: str, minimum_improvement: float | None = None) -> DataFrame:
    """Root mean square errors before and after, and the relative improvement: one row."""
    rmse = [d.agg(F.sqrt(F.avg(finite(dx) * finite(dx) + finite(dy) * finite(dy))).alias(f"rmse_{n}")) for n, d in (("before", before), ("after", after))]
    both = rmse[0].crossJoin(F.broadcast(rmse[1])).withColumn("improvement", ratio(F.col("rmse_before") - F.col("rmse_after"), "rmse_before"))
    return both if minimum_improvement is None else both.withColumn("accepted", F.coalesce(F.col("improvement") >= minimum_improvement, F.lit(False)))


def audit_sampling_rate(rates: DataFrame, expected_hz: float, tolerance_hz: float = 5.0) -> DataFrame:
    """Status of estimated rates (sampling_rate_hz)."""
    off = F.abs(F.col("sampling_rate_hz") - expected_hz)
    return rates.withColumn("expected_hz", F.lit(expected_hz)).withColumn("status", F.when(off.isNull(), "unknown").when(off <= tolerance_hz, "pass").otherwise("review"))


def audit_signal_quality(df: DataFrame, flag: Column, by: Sequence[str], minimum: float = 0.8) -> DataFrame:
    """Share of valid rows; a null flag is left out, as an unknown."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("valid_fraction")).withColumn("status", F.when(F.col("valid_fraction").isNull(), "unknown").when(F.col("valid_fraction") >= minimum, "pass").otherwise("review"))


def audit_missingness(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A row a group and column: share of null or non-finite values."""
    kinds = dict(df.dtypes)
    flag = lambda c: finite(c).isNull() if kinds[c] in ("double", "float") else F.col(c).isNull()
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), *(share(flag(c)).alias(c) for c in columns))
    return wide.unpivot([*by, "n"], list(columns), "field", "missing_fraction")


def audit_episodes(episodes: DataFrame, kind: str = "episode_type") -> DataFrame:
    return episodes.groupBy(kind).agg(
        F.count("*").alias("n"),
        F.count_if(finite("end_time") < finite("start_time")).alias("n_negative_duration"),
        F.count_if(finite("centroid_x").isNull() | finite("centroid_y").isNull()).alias("n_missing_position"),
    )


def audit_event_order(events: DataFrame, time: str, by: Sequence[str], row: str) -> DataFrame:
    steps = _steps(events, time, by, row)
    return steps.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_d") < 0).alias("n_nonmonotonic"), F.count_if(F.col("_d") == 0).alias("n_duplicate"))
