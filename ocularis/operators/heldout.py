"""Cross-validated regressions: every fold's model is a group of one solver run, and every row is scored by the model that hasn't seen it.

A row counts for each fold whose analysis set has it, so the rows are read once a round for all folds; nothing is fitted in a driver loop over folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounds import Table
from .regression import design, generalised, maximised
from .validation import grouped_folds

#: Probabilities are kept this far from 0 and 1 in the logarithmic loss.
CLIP = 1e-15


def _all(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def out_of_fold(df: DataFrame, groups: Sequence[str], outcome: Column | str, terms: dict[str, Column | str], keep: Sequence[str] = (), family: str = "binomial", folds: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Predictions (keep, fold, outcome, predicted) of the rows whose groups are all held out together, and the fits (fold, n_analysis, status).

    With one group every row is held out once. With several, a fold's analysis set has the rows none of whose groups is held out, and
    rows between the two sets are a buffer. Rows with a null group, and those that the regression leaves out, take no part."""
    dealt = df
    for k, g in enumerate(groups):
        dealt = grouped_folds(dealt, g, folds, seed + k).withColumnRenamed("fold", f"_fold_{k}")
    extra = {f"f{k}": f"_fold_{k}" for k in range(len(groups))} | {f"k{k}": c for k, c in enumerate(keep)}
    keyed = dealt.dropna(subset=[f"_fold_{k}" for k in range(len(groups))])
    table, names = design(keyed, [], outcome, terms, {k: c for k, c in extra.items() if k.startswith("f")} | {k: F.struct(c) for k, c in extra.items() if k.startswith("k")})
    at = [F.col(f"_w_f{k}") for k in range(len(groups))]
    every = table.df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).filter(_all([a != F.col("fold") for a in at]))
    fits = maximised(every, ["fold"], generalised([f"_t{k}" for k in range(len(names))], "_y", family), len(names))
    held = table.df.withColumn("fold", at[0].cast("int")).filter(_all([a == at[0] for a in at]))
    met = held.join(F.broadcast(fits.select("fold", "beta")), "fold", "left")
    eta = sum((F.get("beta", F.lit(k)) * F.col(f"_t{k}") for k in range(len(names))), F.lit(0.0))
    mean = {"binomial": 1 / (1 + F.exp(-eta)), "poisson": F.exp(eta), "gaussian": eta}[family]
    kept = [F.col(f"_w_k{k}")[c].alias(c) for k, c in enumerate(keep)]
    return met.select(*kept, "fold", F.col("_y").alias("outcome"), mean.alias("predicted")), fits.select("fold", F.col("n").alias("n_analysis"), "status")


def grouped_cv(df: DataFrame, groups: Sequence[str], outcome: Column | str, terms: dict[str, Column | str], family: str = "binomial", folds: int = 5, seed: int = 1) -> DataFrame:
    """A row a fold: n_analysis, n_assessment, n_buffer, status, and log_loss, brier and accuracy (binomial), or rmse and mae, of what was held out.

    A fold whose fit isn't estimated has null scores; one without rows to fit or to score is ``empty``."""
    predictions, fits = out_of_fold(df, groups, outcome, terms, (), family, folds, seed)
    predictions = Table(predictions, "heldout").df
    y, p = F.col("outcome"), F.col("predicted")
    inside = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    if family == "binomial":
        scores = {"log_loss": F.avg(-(y * F.ln(inside) + (1 - y) * F.ln(1 - inside))), "brier": F.avg((p - y) * (p - y)), "accuracy": F.avg((F.when(p >= 0.5, 1.0).otherwise(0.0) == y).cast("double"))}
    else:
        scores = {"rmse": F.sqrt(F.avg((p - y) * (p - y))), "mae": F.avg(F.abs(p - y))}
    by_fold = predictions.groupBy("fold").agg(F.count("*").alias("n_assessment"), F.count("predicted").alias("_known"), *(c.alias(k) for k, c in scores.items()))
    spark = df.sparkSession
    every = spark.range(1, folds + 1).select(F.col("id").cast("int").alias("fold"))
    joined = every.join(fits, "fold", "left").join(by_fold, "fold", "left").fillna(0, ["n_analysis", "n_assessment", "_known"])
    dealt = df
    for k, g in enumerate(groups):
        dealt = grouped_folds(dealt, g, folds, seed + k).withColumnRenamed("fold", f"_fold_{k}")
    known = _all([F.col(f"_fold_{k}").isNotNull() for k in range(len(groups))])
    table, _ = design(dealt.filter(known), [], outcome, terms)
    total = joined.crossJoin(F.broadcast(table.df.agg(F.count("*").alias("_all"))))
    status = F.when((F.col("n_analysis") == 0) | (F.col("n_assessment") == 0), "empty").otherwise(F.col("status"))
    good = F.col("_known") > 0
    return total.select("fold", "n_analysis", "n_assessment", (F.col("_all") - F.col("n_analysis") - F.col("n_assessment")).alias("n_buffer"), status.alias("status"), *(F.when(good, F.col(k)).alias(k) for k in scores))
