"""Reliability, agreement and levels of variance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, finite, ratio


def _session_means(df: DataFrame, person: str, session: str, measure: str) -> DataFrame:
    return df.groupBy(F.col(person).alias("person"), F.col(session).alias("session")).agg(F.avg(finite(measure)).alias("v")).filter("v is not null and person is not null and session is not null")


def process_icc(df: DataFrame, person: str, session: str, measure: str) -> DataFrame:
    """ICC(A,1) from two-way mean squares over persons with every session: one row."""
    cells = _session_means(df, person, session, measure)
    k = cells.agg(F.countDistinct("session").alias("k"))
    # persons and sessions have their means by aggregates of their own: a session may hold all persons
    persons = cells.groupBy("person").agg(F.count("*").alias("_c"), F.avg("v").alias("mp")).crossJoin(F.broadcast(k)).filter("_c = k")
    counted = cells.join(persons.select("person", "mp", "k"), "person")
    sessions = counted.groupBy("session").agg(F.avg("v").alias("ms"))
    whole = counted.agg(F.avg("v").alias("g"))
    parts = counted.join(sessions, "session").crossJoin(F.broadcast(whole))
    sums = parts.agg(
        F.countDistinct("person").alias("n"),
        F.max("k").alias("k"),
        F.sum(F.pow(F.col("mp") - F.col("g"), 2)).alias("ssr"),
        F.sum(F.pow(F.col("ms") - F.col("g"), 2)).alias("ssc"),
        F.sum(F.pow(F.col("v") - F.col("mp") - F.col("ms") + F.col("g"), 2)).alias("sse"),
    )
    n, kk = F.col("n"), F.col("k")
    ms = sums.withColumns({"msr": ratio("ssr", n - 1), "msc": ratio("ssc", kk - 1), "mse": ratio("sse", (n - 1) * (kk - 1))})
    return ms.select("n", "k", ratio(F.col("msr") - F.col("mse"), F.col("msr") + (kk - 1) * F.col("mse") + kk * (F.col("msc") - F.col("mse")) / n).alias("icc"))


def process_bland_altman(df: DataFrame, person: str, session: str, measure: str, a: object, b: object) -> DataFrame:
    """Bias of session b over a and limits of agreement: one row."""
    cells = _session_means(df, person, session, measure).filter(F.col("session").isin(a, b))
    pairs = cells.groupBy("person").agg(F.max(F.when(F.col("session") == a, F.col("v"))).alias("a"), F.max(F.when(F.col("session") == b, F.col("v"))).alias("b")).filter("a is not null and b is not null")
    d = F.col("b") - F.col("a")
    return pairs.agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd")).withColumns({"lower": F.col("bias") - 1.96 * F.col("sd"), "upper": F.col("bias") + 1.96 * F.col("sd")})


def average_rank(x: str, by: Sequence[str] = ()):
    """Rank with ties at their mean."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def process_temporal_stability(df: DataFrame, person: str, session: str, measure: str, method: str = "pearson") -> DataFrame:
    """Correlation of each pair of sessions over persons who have both."""
    cells = _session_means(df, person, session, measure)
    pairs = cells.select("person", F.col("session").alias("a"), F.col("v").alias("x")).join(cells.select("person", F.col("session").alias("b"), F.col("v").alias("y")), "person").filter("a < b")
    if method == "spearman":
        pairs = pairs.withColumns({"x": average_rank("x", ["a", "b"]), "y": average_rank("y", ["a", "b"])})
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("x", "y").alias("r"))


def split_half_process_reliability(df: DataFrame, person: str, trial: str, measure: str) -> DataFrame:
    """Correlation of odd and even trials over persons, and Spearman and Brown's correction: one row."""
    w = Window.partitionBy(person).orderBy(trial)
    halves = df.select(person, trial, finite(measure).alias("v")).withColumn("h", F.dense_rank().over(w) % 2)
    wide = halves.groupBy(person).agg(F.avg(F.when(F.col("h") == 1, F.col("v"))).alias("odd"), F.avg(F.when(F.col("h") == 0, F.col("v"))).alias("even"))
    r = wide.filter("odd is not null and even is not null").agg(F.count("*").alias("n"), correlation("odd", "even").alias("r"))
    return r.withColumn("spearman_brown", ratio(2 * F.col("r"), 1 + F.col("r")))


def bootstrap_person_means(df: DataFrame, person: str, measure: str, replications: int = 500, seed: int = 1) -> DataFrame:
    """Bootstrap of the mean over persons by Poisson weights: each person's weight in a replicate comes from a hash, so a replicate needs no resampling join."""
    means = df.groupBy(person).agg(F.avg(finite(measure)).alias("v")).filter("v is not null")
    draws = means.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replications))))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(person), "replicate"), F.lit(1_000_000)) + 0.5) / 1_000_000
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    per = draws.withColumn("w", weight).groupBy("replicate").agg(ratio(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))
    return per.agg(F.count("*").alias("replications"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se"), F.percentile("mean", F.lit(0.025)).alias("lower"), F.percentile("mean", F.lit(0.975)).alias("upper"))


def decompose_within_between(df: DataFrame, columns: Sequence[str], person: str, grand_mean: bool = False) -> DataFrame:
    """<c>_between and <c>_within for each column."""
    w = Window.partitionBy(person)
    between = {f"{c}_between": F.avg(finite(c)).over(w) for c in columns}
    out = df.withColumns(between).withColumns({f"{c}_within": finite(c) - F.col(f"{c}_between") for c in columns})
    if grand_mean:
        whole = df.agg(*(F.avg(finite(c)).alias(f"_{c}") for c in columns))
        out = out.crossJoin(F.broadcast(whole)).withColumns({f"{c}_between": F.col(f"{c}_between") - F.col(f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))
    return out


def center_within_participant(df: DataFrame, column: str, person: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{column}_within", finite(column) - F.avg(finite(column)).over(Window.partitionBy(person)))


def summarise_within_between_variance(df: DataFrame, columns: Sequence[str], person: str) -> DataFrame:
    """Total, within and between variance of each column and the between share, in long form."""
    parts = decompose_within_between(df, columns, person)
    long = None
    for c in columns:
        within = parts.agg(F.var_samp(finite(c)).alias("total"), F.var_samp(f"{c}_within").alias("within"))
        between = df.groupBy(person).agg(F.avg(finite(c)).alias("m")).agg(F.var_samp("m").alias("between"))
        row = within.crossJoin(F.broadcast(between)).select(F.lit(c).alias("variable"), "total", "within", "between", ratio("between", F.col("between") + F.col("within")).alias("between_share"))
        long = row if long is None else long.unionByName(row)
    return long


def check_mediation_trial_counts(df: DataFrame, person: str, trial: str, minimum: int = 2) -> DataFrame:
    return df.groupBy(person).agg(F.countDistinct(trial).alias("n_trials")).withColumn("sufficient", F.col("n_trials") >= minimum)


def fit_process_gstudy(df: DataFrame, metric: str, facets: Sequence[str]) -> DataFrame:
    """Variance of each facet's means, and what is left: moments, in long form."""
    total = df.agg(F.var_samp(finite(metric)).alias("v")).select(F.lit("total").alias("facet"), "v")
    out = total
    for f in facets:
        out = out.unionByName(df.groupBy(f).agg(F.avg(finite(metric)).alias("m")).agg(F.var_samp("m").alias("v")).select(F.lit(f).alias("facet"), "v"))
    whole = out.agg(F.sum(F.when(F.col("facet") == "total", F.col("v")).otherwise(-F.coalesce("v", F.lit(0.0)))).alias("v"))
    residual = whole.select(F.lit("residual").alias("facet"), F.greatest(F.lit(0.0), F.col("v")).alias("v"))
    return out.filter("facet != 'total'").unionByName(residual).withColumnRenamed("v", "variance")


def design_process_dstudy(components: dict[str, float], items: Sequence[int], sessions: Sequence[int], devices: Sequence[int], spark) -> DataFrame:
    """Relative and absolute error and dependability of every design."""
    grid = spark.createDataFrame([(i, s, d) for i in items for s in sessions for d in devices], "items int, sessions int, devices int")
    c = {k: components.get(k, 0.0) for k in ("person", "item", "session", "device", "residual")}
    relative = c["item"] / F.col("items") + c["session"] / F.col("sessions") + c["residual"] / (F.col("items") * F.col("sessions") * F.col("devices"))
    absolute = relative + c["device"] / F.col("devices")
    return grid.withColumns({"relative_error": relative, "absolute_error": absolute}).withColumn("dependability", ratio(F.lit(c["person"]), c["person"] + F.col("absolute_error")))


def fit_device_linking(df: DataFrame, metric: str, device: str, reference: object, ids: Sequence[str]) -> DataFrame:
    """Line from each device's values to the reference's on shared ids, with bias and limits of agreement."""
    ref = df.filter(F.col(device) == reference).select(*ids, finite(metric).alias("_r"))
    pairs = df.filter(F.col(device) != reference).select(*ids, device, finite(metric).alias("_v")).join(ref, list(ids)).filter("_r is not null and _v is not null")
    d = F.col("_v") - F.col("_r")
    return pairs.groupBy(device).agg(F.count("*").alias("n"), F.regr_slope("_r", "_v").alias("slope"), F.regr_intercept("_r", "_v").alias("intercept"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd_difference")).withColumns({"lower": F.col("bias") - 1.96 * F.col("sd_difference"), "upper": F.col("bias") + 1.96 * F.col("sd_difference")})
