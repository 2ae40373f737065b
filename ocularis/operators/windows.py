"""Process windows, preflight, drift, accessibility, anomalies and features before an action."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import anyof, changed, chi2_quantile, entropy, finite, ordered, ratio, share, trapezoid


@dataclass(frozen=True)
class WindowSpecification:
    """Windows [s, s + width) for s from start to end in steps, relative to the alignment."""

    width: float = 1000.0
    step: float = 500.0
    start: float = 0.0
    end: float = 3000.0
    min_samples: int = 5


def window_starts(time: Column, spec: WindowSpecification) -> Column:
    """The numbers of the windows that hold a time, so that a row goes to its own windows and no others."""
    last = int((spec.end - spec.start - spec.width) // spec.step)
    low = F.floor((time - spec.start - spec.width) / spec.step) + 1
    high = F.floor((time - spec.start) / spec.step)
    lo, hi = F.greatest(low, F.lit(0)), F.least(high, F.lit(last))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def extract_process_windows(df: DataFrame, by: Sequence[str], time: str, values: Sequence[str], spec: WindowSpecification, aoi: str | None = None, align: str | None = None) -> DataFrame:
    """Statistics of each value in each sliding window: mean, sd, extremes, slope, area, RMSSD; AOI switches and entropy."""
    t = finite(time) - (finite(align) if align else 0.0)
    rows = df.select(*by, t.alias("_t"), *(finite(v).alias(v) for v in values), *([F.col(aoi).alias("_aoi")] if aoi else [])).filter("_t is not null")
    placed = rows.withColumn("window_index", F.explode(window_starts(F.col("_t"), spec)))
    keys = [*by, "window_index"]
    w = ordered(keys, "_t")
    stepped = placed.withColumns({f"_d_{v}": F.col(v) - F.lag(v).over(w) for v in values} | {f"_a_{v}": trapezoid(v, "_t", w) for v in values})
    if aoi:
        stepped = stepped.withColumn("_switch", (changed("_aoi", w) & F.lag("_t").over(w).isNotNull()).cast("long"))
    stats = [F.count("*").alias("n_samples")]
    for v in values:
        d = F.col(f"_d_{v}")
        stats += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.regr_slope(v, "_t").alias(f"{v}_slope"), F.coalesce(F.sum(f"_a_{v}"), F.lit(0.0)).alias(f"{v}_auc"), F.sqrt(F.avg(d * d)).alias(f"{v}_rmssd")]
    if aoi:
        stats.append(F.sum("_switch").alias("aoi_switches"))
    out = stepped.groupBy(*keys).agg(*stats).filter(F.col("n_samples") >= spec.min_samples)
    if aoi:
        counts = placed.filter("_aoi is not null").groupBy(*keys, "_aoi").agg(F.count("*").alias("k"))
        shares = counts.withColumn("p", ratio("k", F.sum("k").over(Window.partitionBy(*keys))))
        out = out.join(shares.groupBy(*keys).agg(entropy("p", 2.718281828459045).alias("aoi_entropy")), keys, "left")
    return out.withColumn("window_start", spec.start + F.col("window_index") * spec.step)


def summarize_process_windows(windows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return windows.groupBy(*by).agg(F.count("*").alias("n_windows"), *(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))))


def preaction_process_features(df: DataFrame, by: Sequence[str], time: str, action: str, value: str, aoi: str, widths: Sequence[float] = (500.0, 1000.0, 2000.0)) -> DataFrame:
    """Mean and slope of a value and the number of AOIs in closed windows that end with the action."""
    back = finite(action) - finite(time)
    wide = F.explode(F.filter(F.array(*(F.lit(float(x)) for x in widths)), lambda x: (back >= 0) & (back <= x)))
    rows = df.select(*by, finite(time).alias("_t"), finite(value).alias("_v"), F.col(aoi).alias("_a"), wide.alias("window"))
    return rows.groupBy(*by, "window").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.regr_slope("_v", "_t").alias("slope"), F.countDistinct("_a").alias("n_aois"))


def addm_glam_proxy_features(df: DataFrame, by: Sequence[str], time: str, aoi: str, target: str, distractor: str) -> DataFrame:
    """Shares of target and distractor, the target's slope over time, and its late less early share, split at the median time."""
    rows = df.select(*by, finite(time).alias("_t"), (F.col(aoi) == target).cast("double").alias("_g"), (F.col(aoi) == distractor).cast("double").alias("_d")).filter("_t is not null and _g is not null")
    late = rows.withColumn("_late", F.col("_t") > F.median("_t").over(Window.partitionBy(*by)))
    return late.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_g").alias("target_share"), F.avg("_d").alias("distractor_share"), F.regr_slope("_g", "_t").alias("target_slope"), (F.avg(F.when(F.col("_late"), F.col("_g"))) - F.avg(F.when(~F.col("_late"), F.col("_g")))).alias("late_minus_early"))


@dataclass(frozen=True)
class PreflightSpec:
    """Limits of the preflight audit."""

    min_validity: float = 0.8
    max_missingness: float = 0.25
    min_trials: int = 5
    min_valid_trial_fraction: float = 0.7
    trial_validity: float = 0.7
    max_flags_pass: int = 0
    max_flags_caution: int = 2
    outlier_quantile: float = 0.95


def audit_biometric_preflight(df: DataFrame, by: Sequence[str], validity: str, missing: str, effort: str, spec: PreflightSpec = PreflightSpec()) -> DataFrame:
    """Flags of each group and a decision. The cut-off for effort is a quantile over all groups, one row joined back."""
    groups = df.groupBy(*by).agg(
        F.count("*").alias("n_trials"),
        F.avg(finite(validity)).alias("mean_validity"),
        F.avg(finite(missing)).alias("mean_missing"),
        share(finite(validity) >= spec.trial_validity).alias("valid_trial_fraction"),
        F.avg(finite(effort)).alias("mean_effort"),
    )
    cut = groups.agg(F.percentile("mean_effort", F.lit(spec.outlier_quantile)).alias("_cut"))
    flags = {
        "flag_validity": F.coalesce(F.col("mean_validity") < spec.min_validity, F.lit(True)),
        "flag_missing": F.coalesce(F.col("mean_missing") > spec.max_missingness, F.lit(True)),
        "flag_trials": F.col("n_trials") < spec.min_trials,
        "flag_valid_trials": F.col("valid_trial_fraction") < spec.min_valid_trial_fraction,
        "flag_effort": F.coalesce(F.col("mean_effort") > F.col("_cut"), F.lit(False)),
    }
    flagged = groups.crossJoin(F.broadcast(cut)).withColumns(flags)
    n = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    decision = F.when(n <= spec.max_flags_pass, "pass_preflight").when(n <= spec.max_flags_caution, "use_with_caution").otherwise("review_before_modelling")
    return flagged.withColumn("n_flags", n).withColumn("decision", decision).drop("_cut")


def preflight_passed(audit: DataFrame) -> DataFrame:
    return audit.filter("decision = 'pass_preflight'")


def preflight_failures(audit: DataFrame) -> DataFrame:
    return audit.filter("decision != 'pass_preflight'")


def apply_preflight_decision(df: DataFrame, audit: DataFrame, by: Sequence[str], keep: Sequence[str] = ("pass_preflight", "use_with_caution")) -> DataFrame:
    return df.join(audit.filter(F.col("decision").isin(*keep)).select(*by), list(by), "left_semi")


def audit_process_drift(df: DataFrame, item: str, batch: str, metrics: Sequence[str], quantile: float = 0.9, limits: dict[str, float] | None = None, falls: Sequence[str] = (), min_batches: int = 2, order: str | None = None, reference: Sequence | None = None) -> DataFrame:
    """First and latest finite batch mean of each metric of each item, the change, its flags and a status for review.

    A metric with a limit is flagged where the change is larger (for those in falls, where it falls by more); the others where
    it is larger than a quantile of all items' changes. Batches are ordered by their value, or by the mean of order;
    with reference batches the baseline is the mean over them. Items with too few batches are kept and named."""
    limits = limits or {}
    ranked = df.select(item, F.col(batch).alias("_b"), (finite(order) if order else F.col(batch)).alias("_o"), *(finite(m).alias(m) for m in metrics))
    place = F.avg("_o") if order else F.first("_o")
    means = ranked.groupBy(item, "_b").agg(place.alias("_o"), *(F.avg(m).alias(m) for m in metrics))
    known = lambda m: F.when(F.col(m).isNotNull(), F.col("_o"))
    base = lambda m: F.avg(F.when(F.col("_b").isin(*reference), F.col(m))) if reference else F.min_by(m, known(m))
    ends = means.groupBy(item).agg(F.count("*").alias("n_batches"), *(x for m in metrics for x in (base(m).alias(f"{m}_baseline"), F.max_by(m, known(m)).alias(f"{m}_latest"))))
    moved = ends.withColumns({f"{m}_delta": F.col(f"{m}_latest") - F.col(f"{m}_baseline") for m in metrics})
    free = [m for m in metrics if m not in limits]
    if free:
        cuts = moved.agg(*(F.percentile(F.abs(f"{m}_delta"), F.lit(quantile)).alias(f"_{m}") for m in free))
        moved = moved.crossJoin(F.broadcast(cuts))
    beyond = lambda m: F.col(f"{m}_delta") < -limits[m] if m in falls else F.abs(f"{m}_delta") > (F.lit(limits[m]) if m in limits else F.col(f"_{m}"))
    flagged = moved.withColumns({f"{m}_drift_flag": F.coalesce(beyond(m), F.lit(False)) for m in metrics}).drop(*(f"_{m}" for m in free))
    count = sum((F.col(f"{m}_drift_flag").cast("int") for m in metrics), F.lit(0))
    few = F.col("n_batches") < min_batches
    status = F.when(few, "insufficient_batches_for_drift_review").when(F.col("drift_review_count") > 0, "review_item_or_stimulus_context").otherwise("no_review_flag")
    return flagged.withColumn("insufficient_batches_flag", few).withColumn("drift_review_count", count).withColumn("drift_status", status)


def process_drift_alerts(audit: DataFrame) -> DataFrame:
    return audit.filter("drift_status = 'review_item_or_stimulus_context'")


def compare_deployment_batches(df: DataFrame, item: str, batch: str, a: object, b: object, metrics: Sequence[str]) -> DataFrame:
    """Item means of two batches and their differences."""
    kept = df.filter(F.col(batch).isin(a, b))
    stats = [x for m in metrics for x in (F.avg(F.when(F.col(batch) == a, finite(m))).alias(f"{m}_a"), F.avg(F.when(F.col(batch) == b, finite(m))).alias(f"{m}_b"))]
    return kept.groupBy(item).agg(*stats).withColumns({f"{m}_delta": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def audit_presentation_accessibility(df: DataFrame, person: str, rt: str, dwell: str, revisits: str, quantile: float = 0.9) -> DataFrame:
    """Person means as z-scores, their sum as a burden index, and whether it is in the upper quantile."""
    means = df.groupBy(person).agg(*(F.avg(finite(c)).alias(c) for c in (rt, dwell, revisits)))
    whole = means.agg(*(x for c in (rt, dwell, revisits) for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))))
    z = means.crossJoin(F.broadcast(whole))
    index = sum((F.coalesce(ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}"), F.lit(0.0)) for c in (rt, dwell, revisits)), F.lit(0.0)) / 3
    scored = z.select(person, rt, dwell, revisits, index.alias("burden_index"))
    cut = scored.agg(F.percentile("burden_index", F.lit(quantile)).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("review", F.col("burden_index") >= F.col("_cut")).drop("_cut")


def audit_process_anomalies(df: DataFrame, person: str, metrics: Sequence[str], alpha: float = 0.975, ridge: float = 1e-6) -> DataFrame:
    """Squared Mahalanobis distance of each person's means and whether it is beyond the chi-squared limit.

    The covariance, a k x k matrix, is one aggregated row; its inverse goes back as literals."""
    import numpy as np

    means = df.groupBy(person).agg(*(F.avg(finite(m)).alias(m) for m in metrics)).dropna(how="any", subset=list(metrics))
    k = len(metrics)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = means.agg(*(F.avg(m).alias(f"m{i}") for i, m in enumerate(metrics)), *(F.covar_samp(metrics[i], metrics[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if row is None or any(v is None for v in row):
        return means.withColumns({"distance": F.lit(None).cast("double"), "anomalous": F.lit(False)})
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    inverse = np.linalg.inv(cov + ridge * np.eye(k))
    centred = [F.col(m) - row[f"m{i}"] for i, m in enumerate(metrics)]
    distance = sum((float(inverse[i, j]) * centred[i] * centred[j] for i in range(k) for j in range(k)), F.lit(0.0))
    return means.withColumn("distance", distance).withColumn("anomalous", F.col("distance") > chi2_quantile(alpha, k))


def audit_pupil_fatigue_drift(df: DataFrame, person: str, order: str, pupil: str) -> DataFrame:
    """Slope of the pupil on trial order with a level for each person: both are centred within persons first."""
    group = Window.partitionBy(person)
    x, y = finite(order), finite(pupil)
    pairs = df.select(person, x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    centred = pairs.withColumns({"x": F.col("x") - F.avg("x").over(group), "y": F.col("y") - F.avg("y").over(group)})
    return centred.agg(F.count("*").alias("n"), F.countDistinct(person).alias("n_persons"), ratio(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("slope"))


def process_feature_stability(df: DataFrame, feature: str, split: str, importance: str, top: int = 20) -> DataFrame:
    """How often each feature is among the top of a split."""
    w = Window.partitionBy(split).orderBy(F.desc(importance), feature)
    ranked = df.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(feature).agg(F.count("*").alias("n_splits"), share(F.col("_r") <= top).alias("selection_rate"), F.avg(finite(importance)).alias("mean_importance"))
