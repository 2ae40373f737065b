"""Evidence: recovery summaries, sensitivity grids, leakage, folds, negative controls, norms and fairness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import anyof, correlation, finite, ratio, share
from ..functions.ranks import hashed_rank, joined_null_safe, seeded_digest, totalled


def summarise_recovery(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bias, RMSE, MAE, coverage (missing limits count as not covered) and correlation of estimates with truth."""
    e = finite("estimate") - finite("truth")
    covered = finite("truth").between(finite("lower"), finite("upper"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), share(covered).alias("coverage"), F.avg(finite("upper") - finite("lower")).alias("interval_width"), correlation("estimate", "truth").alias("correlation"))


def summarise_process_validation(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """As summarise_recovery, with coverage over rows that have limits, and the rate of convergence."""
    e = finite("estimate") - finite("truth")
    known = finite("truth").isNotNull() & finite("lower").isNotNull() & finite("upper").isNotNull()
    covered = F.when(known, finite("truth").between(finite("lower"), finite("upper")).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(covered).alias("coverage"), F.stddev_samp(finite("estimate")).alias("estimate_sd"))


def validation_summary_mcse(df: DataFrame, by: Sequence[str], value: str = "estimate") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), ratio(F.stddev_samp(finite(value)), F.sqrt(F.count(finite(value)).cast("double"))).alias("mcse"))


def validation_condition_ranking(summary: DataFrame) -> DataFrame:
    """Robustness of conditions: one less the mean of min-max scaled RMSE, bias and miss of coverage."""
    scaled = {}
    for name, c in (("rmse", F.col("rmse")), ("bias", F.abs("bias")), ("coverage", F.abs(F.col("coverage") - 0.95))):
        scaled[name] = c
    whole = totalled(summary, **{f"_lo_{k}": F.min(c) for k, c in scaled.items()}, **{f"_hi_{k}": F.max(c) for k, c in scaled.items()})
    place = lambda k: F.coalesce(ratio(scaled[k] - F.col(f"_lo_{k}"), F.col(f"_hi_{k}") - F.col(f"_lo_{k}")), F.lit(0.0))
    return whole.withColumn("robustness", 1 - (place("rmse") + place("bias") + place("coverage")) / 3).drop(*(f"_{e}_{k}" for e in ("lo", "hi") for k in scaled))


def failure_taxonomy(message: Column) -> Column:
    """Type of a failure by keyword; of several the last in this list."""
    m = F.lower(message)
    kinds = [("converg", "convergence"), ("singular|identif", "identification"), ("timeout|time out", "timeout"), ("memory", "memory"), ("missing|nan", "missing_data"), ("boundary", "boundary")]
    out = F.lit("other")
    for pattern, kind in kinds:
        out = F.when(m.rlike(pattern), kind).otherwise(out)
    return F.when(message.isNull(), None).otherwise(out)


def sbc_ranks(draws: DataFrame, by: Sequence[str], draw: str, truth: str) -> DataFrame:
    """Number of posterior draws below the truth."""
    return draws.groupBy(*by).agg(F.count_if(finite(draw) < finite(truth)).alias("rank"), F.count("*").alias("n_draws"))


def sbc_bins(ranks: DataFrame, bins: int = 10) -> DataFrame:
    """Counts of ranks in bins and their distance from uniform counts."""
    placed = ranks.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("rank") * bins / (F.col("n_draws") + 1))))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    return totalled(counts, _all=F.sum("n")).withColumn("excess", F.col("n") - F.col("_all") / bins).drop("_all")


def summarise_sensitivity(df: DataFrame, effect: str, by: Sequence[str] = (), threshold: float = 0.0) -> DataFrame:
    """Median, mean and range of effects, the share of the commoner sign, and of effects beyond the threshold."""
    e = finite(effect)
    up, down = F.count_if(e > 0), F.count_if(e < 0)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.median(e).alias("median"), F.avg(e).alias("mean"), F.min(e).alias("min"), F.max(e).alias("max"), ratio(F.greatest(up, down), up + down).alias("sign_stability"), share(e > threshold).alias("beyond_threshold"))


def specification_curve(df: DataFrame, effect: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(finite(effect), key)))


def decision_leverage(df: DataFrame, effect: str, decisions: Sequence[str]) -> DataFrame:
    """Range of mean effects over the levels of each decision."""
    long = df.select(finite(effect).alias("e"), *(F.col(d).cast("string").alias(d) for d in decisions)).unpivot(["e"], list(decisions), "decision", "level")
    means = long.groupBy("decision", "level").agg(F.avg("e").alias("m"))
    return means.groupBy("decision").agg(F.count("*").alias("n_levels"), (F.max("m") - F.min("m")).alias("leverage"))


def grouped_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """A fold for each group: groups are dealt in turn in the order of a seeded hash, so that folds differ by one group at most.

    Fewer groups than folds are refused, which takes a count of at most as many groups. A null group has no fold."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    if groups.limit(folds).count() < folds:
        raise ValidationError(f"there are fewer than {folds} groups in {group}")
    ranked = hashed_rank(groups, seeded_digest(seed, group), [group])
    return joined_null_safe(df, ranked.select(group, ((F.col("rank") - 1) % folds + 1).alias("fold")), [group], "left")


def crossed_grouped_folds(df: DataFrame, groups: Sequence[str], folds: int = 5, held: int = 1, seed: int = 1) -> DataFrame:
    """Role of each row when fold ``held`` of every key is held out: assessment, analysis, or buffer between them."""
    out = df
    for k, g in enumerate(groups):
        out = grouped_folds(out, g, folds, seed + k).withColumnRenamed("fold", f"fold_{g}")
    inside = [F.col(f"fold_{g}") == held for g in groups]
    whole = inside[0]
    for c in inside[1:]:
        whole = whole & c
    return out.withColumn("role", F.when(whole, "assessment").when(anyof(inside), "buffer").otherwise("analysis"))


def audit_temporal_leakage(df: DataFrame, available: str, outcome: str, tolerance: float = 0.0, allow_equal: bool = True) -> DataFrame:
    delta = finite(available) - finite(outcome)
    return df.withColumn("delta", delta).withColumn("leak", F.coalesce(F.col("delta") > tolerance if allow_equal else F.col("delta") >= -tolerance, F.lit(True)))


def negative_control_shift(df: DataFrame, column: str, order: str, by: Sequence[str], lag: int = 1) -> DataFrame:
    return df.withColumn(f"{column}_shifted", F.lag(column, lag).over(Window.partitionBy(*by).orderBy(order)))


def negative_control_permute(df: DataFrame, outcome: str, key: str, within: Sequence[str], seed: int = 1) -> DataFrame:
    """The outcome dealt anew within strata: the k-th row by one seeded hash of the key takes the outcome of the k-th row by another."""
    rows = hashed_rank(df, seeded_digest(seed, key), [key], within, "_i")
    dealt = hashed_rank(df.select(*within, key, outcome), seeded_digest(seed + 1, key), [key], within, "_i").select(*within, "_i", F.col(outcome).alias(f"{outcome}_permuted"))
    return joined_null_safe(rows, dealt, [*within, "_i"]).drop("_i")


def placebo_window_audit(df: DataFrame, time: str, value: str, low: float, high: float, expected: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    inside = df.filter(finite(time).between(low, high))
    return inside.groupBy(*by).agg(F.count(finite(value)).alias("n"), F.avg(finite(value)).alias("mean"), (F.avg(finite(value)) - expected).alias("difference"))


def null_benchmark(observed: float, controls: DataFrame, effect: str) -> DataFrame:
    """Place of an observed effect among control effects."""
    e = finite(effect)
    return controls.agg(F.count(e).alias("n"), share(e <= observed).alias("percentile"), ratio(1 + F.count_if(F.abs(e) >= abs(observed)), 1 + F.count(e)).alias("two_sided"), ratio(observed - F.avg(e), F.stddev_samp(e)).alias("standardised"))


def fit_process_norms(df: DataFrame, metric: str, covariate: str, by: Sequence[str] = ()) -> DataFrame:
    """Line of the metric on a covariate and the residual deviation, for each group."""
    x, y = finite(covariate), finite(metric)
    pairs = df.select(*by, x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    syy, sxx, sxy = F.regr_syy("y", "x"), F.regr_sxx("y", "x"), F.regr_sxy("y", "x")
    sse = F.greatest(F.lit(0.0), syy - F.coalesce(ratio(sxy * sxy, sxx), F.lit(0.0)))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.sqrt(ratio(sse, F.count("*") - 2)).alias("residual_sd"))


def fairness_gap(df: DataFrame, variant: str, outcome: str) -> DataFrame:
    """Mean outcome of each variant and its difference from the mean of all."""
    means = df.groupBy(variant).agg(F.count("*").alias("n"), F.avg(finite(outcome)).alias("mean"))
    whole = df.agg(F.avg(finite(outcome)).alias("_g"))
    return means.crossJoin(F.broadcast(whole)).withColumn("gap", F.col("mean") - F.col("_g")).drop("_g")


def delta_adjusted_means(df: DataFrame, metric: str, deltas: Sequence[float]) -> DataFrame:
    """Mean of a metric when its missing values are the observed mean plus delta, for each delta: a pattern mixture from three sums."""
    sums = df.agg(F.count("*").alias("n"), F.count(finite(metric)).alias("k"), F.avg(finite(metric)).alias("m"))
    out = sums.withColumn("delta", F.explode(F.array(*(F.lit(float(d)) for d in deltas))))
    return out.select("delta", (F.col("m") + ratio(F.col("n") - F.col("k"), "n") * F.col("delta")).alias("estimate"))


def audit_missing_registry(registry: DataFrame, required: Sequence[str], name: str = "name") -> DataFrame:
    """Names that repeat, and rows that lack a required field."""
    again = registry.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name, F.lit("duplicate_name").alias("issue"))
    lacking = registry.filter(anyof([F.col(c).isNull() for c in required])).select(name, F.lit("incomplete").alias("issue"))
    return again.unionByName(lacking)


def snapshot_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free hash of a table: the sum of its rows' hashes, exact in any partitioning."""
    row = F.xxhash64(*(F.col(c) for c in columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("hash"))
