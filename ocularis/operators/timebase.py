"""Clocks: sampling rates, normalisation, audits and transforms between clocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TimebaseError
from ..functions.columns import finite, ordered, ratio

#: Seconds in a unit; fixed values.
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def align_clock(t: Column, offset: float = 0.0, slope: float = 1.0) -> Column:
    return t * slope + offset


def estimate_sampling_rate(df: DataFrame, time: str, by: Sequence[str] = (), trim: float = 0.05) -> DataFrame:
    """Hz of each group: one over the median positive step between distinct times, after a two-sided trim when there are over ten steps."""
    times = df.select(*by, finite(time).alias("t")).filter("t is not null").distinct()
    steps = times.withColumn("d", F.col("t") - F.lag("t").over(ordered(by, "t"))).filter("d > 0")
    group = Window.partitionBy(*by)
    bounded = steps.withColumns({"n": F.count("d").over(group), "lo": F.percentile("d", F.lit(trim)).over(group), "hi": F.percentile("d", F.lit(1 - trim)).over(group)})
    kept = bounded.filter((F.col("n") <= 10) | F.col("d").between(F.col("lo"), F.col("hi")))
    return kept.groupBy(*by).agg(ratio(F.lit(1.0), F.median("d")).alias("sampling_rate_hz"))


def normalize_timebase(df: DataFrame, native: str, by: Sequence[str], unit: str = "ms", origin: str = "recording_start", out: str = "timestamp_seconds") -> DataFrame:
    """Seconds from each group's first time, or from the clock's own zero."""
    if unit not in UNITS:
        raise TimebaseError(f"unknown unit {unit}")
    seconds = finite(native) * UNITS[unit]
    return df.withColumn(out, seconds - F.min(seconds).over(Window.partitionBy(*by)) if origin == "recording_start" else seconds)


def audit_timebase(df: DataFrame, time: str, by: Sequence[str], row: str) -> DataFrame:
    """Rows, missing, non-monotone and duplicate times in row order, and the positive steps in time order."""
    t = finite(time)
    kept = df.select(*by, F.col(row).alias("_row"), t.alias("_t"))
    at = ordered(by, "_row")
    seen = kept.withColumn("_back", F.col("_t") - F.lag("_t").over(at))
    by_time = ordered(by, F.col("_t").asc_nulls_last(), "_row")
    stepped = seen.withColumn("_step", F.col("_t") - F.lag("_t").over(by_time))
    positive = F.when(F.col("_step") > 0, F.col("_step"))
    return stepped.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_t").isNull()).alias("n_missing"),
        F.count_if(F.col("_back") < 0).alias("n_nonmonotonic"),
        F.count_if(F.col("_step") == 0).alias("n_duplicate"),
        F.median(positive).alias("median_interval"),
        ratio(F.lit(1.0), F.median(positive)).alias("sampling_rate_hz"),
        F.max(positive).alias("max_gap"),
    )


@dataclass(frozen=True)
class ClockTransform:
    """target = source * slope + offset, with how well markers agree."""

    method: str
    offset: float
    slope: float
    n_markers: int
    residual_sd: float | None
    max_abs_residual: float | None


def clock_fits(df: DataFrame, source: str, target: str, by: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """Slope, offset and residuals of each group's marker pairs: least squares, or the median offset."""
    x, y = finite(source), finite(target)
    pairs = df.select(*by, x.alias("_x"), y.alias("_y")).filter("_x is not null and _y is not null")
    if method == "linear":
        fit = pairs.groupBy(*by).agg(F.count("*").alias("n_markers"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("offset"))
    elif method == "offset":
        fit = pairs.groupBy(*by).agg(F.count("*").alias("n_markers"), F.lit(1.0).alias("slope"), F.median(F.col("_y") - F.col("_x")).alias("offset"))
    else:
        raise TimebaseError(f"unknown method {method}")
    joined = pairs.join(fit, list(by)) if by else pairs.crossJoin(F.broadcast(fit))  # one row
    left = joined.withColumn("_r", F.col("_y") - F.col("_x") * F.col("slope") - F.col("offset"))
    return left.groupBy(*by, "n_markers", "slope", "offset").agg(F.stddev_samp("_r").alias("residual_sd"), F.max(F.abs("_r")).alias("max_abs_residual"))


def estimate_clock_transform(df: DataFrame, source: str, target: str, method: str = "linear") -> ClockTransform:
    """The one transform of a marker table, as an object: an action."""
    row = clock_fits(df, source, target, (), method).first()
    if row is None or row["slope"] is None:
        raise TimebaseError("two different markers are needed")
    return ClockTransform(method, row["offset"], row["slope"], row["n_markers"], row["residual_sd"], row["max_abs_residual"])


def apply_clock_transform(df: DataFrame, transform: ClockTransform, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: align_clock(finite(c), transform.offset, transform.slope) for c in columns})


def audit_clock_sync(gaze: DataFrame, other: DataFrame, time: str, by: Sequence[str]) -> DataFrame:
    """Overlap in seconds of two streams of each group, and its share of their union."""
    spans = [x.groupBy(*by).agg(F.min(finite(time)).alias(f"{n}_start"), F.max(finite(time)).alias(f"{n}_end")) for n, x in (("gaze", gaze), ("other", other))]
    both = spans[0].join(spans[1], list(by), "full")
    overlap = F.greatest(F.lit(0.0), F.least("gaze_end", "other_end") - F.greatest("gaze_start", "other_start"))
    known = F.col("gaze_start").isNotNull() & F.col("other_start").isNotNull()
    union = F.greatest("gaze_end", "other_end") - F.least("gaze_start", "other_start")
    return both.withColumn("overlap_seconds", F.when(known, overlap)).withColumn("overlap_fraction", F.when(known, ratio(overlap, union)))
