"""Episodes and samples to features: fixation summaries, sequences, transitions, entropies, pupil and response features, wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import changed, entropy, finite, ordered, ratio, trapezoid
from ..functions.ranks import totalled


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all there: feature paths drop groups with a missing key."""
    return df.dropna(how="any", subset=list(keys)) if keys else df


def summarize_fixations(fixations: DataFrame, by: Sequence[str]) -> DataFrame:
    return _known(fixations, by).groupBy(*by).agg(F.count("*").alias("fixation_count"), F.sum("duration_ms").alias("total_duration_ms"), F.avg("duration_ms").alias("mean_duration_ms"), F.median("duration_ms").alias("median_duration_ms"), F.min("start_time").alias("first_time"), F.max("end_time").alias("last_time"))


def collapsed(df: DataFrame, time: str, by: Sequence[str], aoi: str) -> DataFrame:
    """Rows where the AOI changes; rows outside every AOI are left out first."""
    inside = _known(df, by).filter(F.col(aoi).isNotNull())
    w = ordered(by, time)
    return inside.withColumn("_new", changed(aoi, w)).filter("_new").drop("_new")


def scanpath_sequence(df: DataFrame, time: str, by: Sequence[str], aoi: str, collapse: bool = True, separator: str = " > ") -> DataFrame:
    """The AOIs of each group in order of time, joined."""
    rows = collapsed(df, time, by, aoi) if collapse else _known(df, by).filter(F.col(aoi).isNotNull())
    ordered_ = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(aoi).alias("a"))))
    return rows.groupBy(*by).agg(F.transform(ordered_, lambda s: s["a"]).alias("tokens")).select(*by, F.array_join("tokens", separator).alias("scanpath"), F.size("tokens").cast("long").alias("n_steps"))


def transitions(df: DataFrame, time: str, by: Sequence[str], aoi: str, include_self: bool = False) -> DataFrame:
    """A row for each step from one AOI to the next."""
    inside = _known(df, by).filter(F.col(aoi).isNotNull())
    w = ordered(by, time)
    steps = inside.select(*by, F.col(aoi).alias("from_aoi"), F.lead(aoi).over(w).alias("to_aoi")).filter("to_aoi is not null")
    return steps if include_self else steps.filter("from_aoi != to_aoi")


def transition_matrix(df: DataFrame, time: str, by: Sequence[str], aoi: str, normalize: str = "none", include_self: bool = False) -> DataFrame:
    """Counts of steps in long form, as they are or as shares of their row or of all."""
    counts = transitions(df, time, by, aoi, include_self).groupBy("from_aoi", "to_aoi").agg(F.count("*").alias("n"))
    if normalize == "none":
        return counts
    if normalize == "row":
        return counts.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy("from_aoi"))))
    return totalled(counts, _all=F.sum("n")).withColumn("share", ratio("n", "_all")).drop("_all")


def gaze_entropy(df: DataFrame, by: Sequence[str], aoi: str, base: float = 2.0) -> DataFrame:
    """Entropy of the AOIs' shares of each group's rows."""
    counts = _known(df, by).filter(F.col(aoi).isNotNull()).groupBy(*by, aoi).agg(F.count("*").alias("k"))
    shares = counts.withColumn("p", ratio("k", F.sum("k").over(Window.partitionBy(*by))))
    return shares.groupBy(*by).agg(F.sum("k").alias("n"), F.count("*").alias("n_aois"), entropy("p", base).alias("gaze_entropy"))


def transition_entropy(df: DataFrame, time: str, by: Sequence[str], aoi: str, base: float = 2.0) -> DataFrame:
    """Entropy of each AOI's next AOI, weighted by how often it is left."""
    counts = transitions(df, time, by, aoi).groupBy(*by, "from_aoi", "to_aoi").agg(F.count("*").alias("k"))
    row, whole = Window.partitionBy(*by, "from_aoi"), Window.partitionBy(*by)
    shares = counts.withColumns({"p": ratio("k", F.sum("k").over(row)), "w": ratio("k", F.sum("k").over(whole))})
    return shares.groupBy(*by).agg(F.sum("k").alias("n_transitions"), (-F.sum(F.col("w") * F.log2("p")) / F.log2(F.lit(float(base)))).alias("transition_entropy"))


def derive_gaze_features(fixations: DataFrame, by: Sequence[str], aoi: str, trial_start: str | None = None) -> DataFrame:
    """Long features of each group and AOI: counts, durations, share of dwell, first latency, revisits."""
    inside = _known(fixations, by).filter(F.col(aoi).isNotNull())
    w = ordered(by, "start_time")
    steps = inside.withColumn("_new", changed(aoi, w).cast("long"))
    zero = F.col(trial_start) if trial_start else F.min("start_time").over(Window.partitionBy(*by))
    wide = steps.withColumn("_latency", F.col("start_time") - zero).groupBy(*by, aoi).agg(
        F.count("*").cast("double").alias("fixation_count"),
        F.sum("duration_ms").alias("dwell_time_ms"),
        F.avg("duration_ms").alias("mean_fixation_ms"),
        F.stddev_samp("duration_ms").alias("sd_fixation_ms"),
        (F.min("_latency") * 1000).alias("first_latency_ms"),
        (F.sum("_new") - 1).cast("double").alias("revisit_count"),
    )
    shared = wide.withColumn("dwell_share", ratio("dwell_time_ms", F.sum("dwell_time_ms").over(Window.partitionBy(*by))))
    return shared.unpivot([*by, aoi], ["fixation_count", "dwell_time_ms", "mean_fixation_ms", "sd_fixation_ms", "first_latency_ms", "revisit_count", "dwell_share"], "feature_name", "value")


def series_features(df: DataFrame, time: str, by: Sequence[str], value: str) -> DataFrame:
    """Wide features of a signal: mean, sd, extremes, trapezoid area, slope, time of the peak, observed share."""
    w = ordered(by, "_t")
    rows = _known(df, by).select(*by, finite(time).alias("_t"), finite(value).alias("_y"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.count("_y"), F.count("*")).alias("observed_fraction"))
    seen = rows.filter("_y is not null and _t is not null").withColumn("_part", trapezoid("_y", "_t", w))
    stats = seen.groupBy(*by).agg(
        F.avg("_y").alias("mean"),
        F.stddev_samp("_y").alias("sd"),
        F.min("_y").alias("min"),
        F.max("_y").alias("peak"),
        F.coalesce(F.sum("_part"), F.lit(0.0)).alias("auc"),
        F.regr_slope("_y", "_t").alias("slope"),
        (F.min_by("_t", F.struct(-F.col("_y"), "_t")) - F.min("_t")).alias("peak_latency"),
    )
    return totals.join(stats, list(by), "left")


def derive_pupil_features(df: DataFrame, time: str, by: Sequence[str], pupil: str = "pupil_diameter") -> DataFrame:
    """series_features of the pupil in long form, with names of their own."""
    wide = series_features(df, time, by, pupil)
    names = ["mean", "sd", "min", "peak", "auc", "slope", "peak_latency", "observed_fraction"]
    return wide.select(*by, *(F.col(c).cast("double").alias(f"pupil_{c}") for c in names)).unpivot(list(by), [f"pupil_{c}" for c in names], "feature_name", "value")


def derive_biometric_features(df: DataFrame, time: str, by: Sequence[str], channel: str, value: str) -> DataFrame:
    wide = series_features(df, time, [*by, channel], value)
    names = ["mean", "sd", "min", "peak", "auc", "observed_fraction"]
    long = wide.select(*by, channel, *(F.col(c).cast("double").alias(c) for c in names)).unpivot([*by, channel], names, "statistic", "value")
    return long.select(*by, F.concat_ws("_", channel, "statistic").alias("feature_name"), "value")


def derive_rt_features(responses: DataFrame, by: Sequence[str]) -> DataFrame:
    return responses.select(*by, finite("response_time").alias("response_time"), finite("score").alias("score")).unpivot(list(by), ["response_time", "score"], "feature_name", "value")


def features_wide(features: DataFrame, ids: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """A column a feature with the mean of its finite values. Without names a first job finds them."""
    grouped = features.groupBy(*ids)
    pivoted = grouped.pivot("feature_name", list(names)) if names else grouped.pivot("feature_name")
    return pivoted.agg(F.avg(finite("value")))


def feature_dictionary(features: DataFrame, columns: Sequence[str] = ("feature_name",)) -> DataFrame:
    return features.select(*columns).distinct()


def process_ngram_features(sequences: DataFrame, key: Sequence[str], tokens: str, sizes: Sequence[int] = (1, 2, 3), separator: str = ">") -> DataFrame:
    """Counts of each n-gram of each sequence (array of string), in long form."""
    def of(n: int) -> Column:
        return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), separator))).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in sizes]
    return sequences.select(*key, F.explode(F.concat(*grams)).alias("ngram")).groupBy(*key, "ngram").agg(F.count("*").alias("n"))


def response_matrix(responses: DataFrame, person: str, item: str, value: str = "score", duplicate: str = "mean", items: Sequence[str] | None = None) -> DataFrame:
    """A row a person, a column an item in sorted order; rows without ids are dropped."""
    kept = responses.dropna(how="any", subset=[person, item])
    grouped = kept.groupBy(person)
    pivoted = grouped.pivot(item, list(items)) if items else grouped.pivot(item)
    return pivoted.agg(F.avg(finite(value)) if duplicate == "mean" else F.max(finite(value)))


def aoi_trajectory(df: DataFrame, time: str, by: Sequence[str], aoi: str, width: float) -> DataFrame:
    """Share of each AOI in each time bin."""
    binned = df.filter(F.col(aoi).isNotNull()).select(*by, F.floor(finite(time) / width).alias("bin"), F.col(aoi).alias("aoi"))
    counts = binned.groupBy(*by, "bin", "aoi").agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(*by, "bin"))))


def dynamic_aoi_model(df: DataFrame, time: str, by: Sequence[str], aoi: str, smoothing: float = 0.5) -> DataFrame:
    """Transition probabilities between AOIs, with a count added to every pair of the AOIs that occur."""
    counts = transition_matrix(df, time, by, aoi)
    states = df.select(F.col(aoi).alias("s")).dropna().distinct()
    grid = states.select(F.col("s").alias("from_aoi")).join(F.broadcast(states.select(F.col("s").alias("to_aoi"))), F.lit(True)).filter("from_aoi != to_aoi")
    full = grid.join(counts, ["from_aoi", "to_aoi"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("probability", ratio(F.col("n") + smoothing, F.sum(F.col("n") + smoothing).over(Window.partitionBy("from_aoi"))))


def irtree_transitions(df: DataFrame, time: str, by: Sequence[str], state: str) -> DataFrame:
    """from, to, step and time gap of each change of state."""
    w = ordered(by, time)
    rows = df.select(*by, F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state"), F.row_number().over(w).alias("step"), (F.lead(finite(time)).over(w) - finite(time)).alias("time_gap"))
    return rows.filter("to_state is not null")
