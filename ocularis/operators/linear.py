"""Least squares by group from cross products, with absorbed factors, and the models that rest on it: deconvolution of events in the pupil, pupil confounds, fixation intensities.

A group's outcome and terms are taken about their means, one aggregate gives the packed cross products, and the small system is solved in the row: two passes over the rows, and
a group is one row in the shuffle. Factors with many levels (persons, items) are taken out by
alternating their means instead of by a column a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from ..functions.ranks import joined_null_safe
from ..functions.rounds import Table
from .regression import cholesky, coefficients, design, pairs


def _solved(size: int, keys: Sequence[str]):
    """The kernel over groups with means and packed cross products (terms, then the outcome last)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, lost, p = row["_n"], row["_lost"], size
                one = {k: row[k] for k in keys} | {"n": n, "status": "estimated", "beta": None, "se": None, "r_squared": None, "residual_sd": None}
                means, packed = np.array(row["_means"]), row["_sums"]
                whole = np.zeros((p + 1, p + 1))
                for v, (j, k) in zip(packed, pairs(p + 1), strict=True):
                    whole[j, k] = whole[k, j] = v
                free = n - p - 1 - lost
                if free < 0:
                    out.append(one | {"status": "insufficient_data"})
                    continue
                inverse = np.zeros((0, 0))
                if p:
                    scale = np.sqrt(np.maximum(np.diag(whole)[:p], 0)) / np.maximum(np.sqrt(n) * np.maximum(np.abs(means[:p]), 1e-300), 1e-300)
                    _, inverse = cholesky([whole[j, k] for j, k in pairs(p)], p) if np.all(scale > 1e-12) else (None, None)
                if inverse is None:
                    out.append(one | {"status": "singular"})
                    continue
                slopes = inverse @ whole[:p, p]
                rss = max(float(whole[p, p] - slopes @ whole[:p, p]), 0.0)
                sigma2 = rss / free if free else float("nan")
                intercept = means[p] - slopes @ means[:p]
                errors = [np.sqrt(sigma2 * (1 / n + means[:p] @ inverse @ means[:p])), *np.sqrt(sigma2 * np.diag(inverse))]
                finite_errors = [float(e) if np.isfinite(e) else None for e in errors]
                out.append(one | {"beta": [float(intercept), *map(float, slopes)], "se": finite_errors, "r_squared": 1 - rss / whole[p, p] if whole[p, p] > 0 else None, "residual_sd": float(np.sqrt(sigma2)) if free else None})
            schema = pa.schema([*((k, batch.schema.field(k).type) for k in keys), ("n", pa.int64()), ("status", pa.string()), ("beta", pa.list_(pa.float64())), ("se", pa.list_(pa.float64())), ("r_squared", pa.float64()), ("residual_sd", pa.float64())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def solve(rows: DataFrame, by: Sequence[str], outcome: str, terms: Sequence[str], lost: Column | None = None) -> DataFrame:
    """by, n, status, beta (intercept first), se, r_squared and residual_sd of each group of rows, which have no nulls; lost: degrees of freedom taken before, one value for all rows."""
    means = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.array(*(F.avg(c) for c in [*terms, outcome])).alias("_means"))
    met = joined_null_safe(rows, means.select(*by, "_means"), by)
    centred = [F.col(c) - F.get("_means", F.lit(k)) for k, c in enumerate([*terms, outcome])]
    sums = met.groupBy(*by).agg(F.array(*(F.sum(centred[j] * centred[k]) for j, k in pairs(len(terms) + 1))).alias("_sums"))
    both = joined_null_safe(means, sums, by).withColumn("_lost", lost if lost is not None else F.lit(0))
    kinds = dict(rows.dtypes)
    return both.mapInArrow(_solved(len(terms), list(by)), ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "n long, status string, beta array<double>, se array<double>, r_squared double, residual_sd double"]))


def fit_linear(df: DataFrame, by: Sequence[str], outcome: Column | str, terms: dict[str, Column | str]) -> DataFrame:
    """by, n, status, r_squared, residual_sd, term, estimate, std_error, z (estimate over error) and p_value (normal) of every group's least squares with intercept.

    insufficient_data: fewer rows than parameters; singular: terms that are constant or dependent in the group. Rows with a null or non-finite value take no part."""
    table, names = design(df, by, outcome, terms)
    fits = solve(table.df, by, "_y", [f"_t{k}" for k in range(1, len(names))])
    return joined_null_safe(coefficients(fits, by, names), fits.select(*by, "r_squared", "residual_sd"), by)


def without_factors(rows: DataFrame, columns: Sequence[str], factors: Sequence[str], rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """rows with columns about the means of every factor: one pass for one factor, alternating passes for several until none moves by more than tolerance of its deviation.

    Rows with the same levels move together, so the passes go over a table of the combinations of levels with their numbers and means; rows meet their whole shift once."""
    scale = rows.agg(*(F.stddev_samp(c) for c in columns)).first()
    at = range(len(columns))
    cells = rows.groupBy(*factors).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_c{j}") for j, c in enumerate(columns))).withColumns({f"_s{j}": F.lit(0.0) for j in at})
    table = Table(cells, "factors")
    for _ in range(rounds):
        now = table.df.select(*factors, "_n", *(f"_{x}{j}" for x in "cs" for j in at))
        for k, f in enumerate(factors):
            means = now.groupBy(f).agg(*((F.sum(F.col("_n") * F.col(f"_c{j}")) / F.sum("_n")).alias(f"_m{j}") for j in at))
            moved = F.greatest(F.lit(0.0), *(F.abs(F.col(f"_m{j}")) / (s or 1.0) for j, s in enumerate(scale)))
            shifted = {f"_c{j}": F.col(f"_c{j}") - F.col(f"_m{j}") for j in at} | {f"_s{j}": F.col(f"_s{j}") + F.col(f"_m{j}") for j in at} | {f"_moved{k}": moved}
            now = joined_null_safe(now, means, [f]).withColumns(shifted).drop(*(f"_m{j}" for j in at))
        new = Table(now, "factors")
        table.drop()
        table = new
        most = max((v for v in table.df.agg(*(F.max(f"_moved{k}") for k in range(len(factors)))).first() if v is not None), default=0.0)
        if len(factors) < 2 or most < tolerance:
            break
    met = joined_null_safe(rows, table.df.select(*factors, *(f"_s{j}" for j in at)), factors)
    return Table(met.withColumns({c: F.col(c) - F.col(f"_s{j}") for j, c in enumerate(columns)}).drop(*(f"_s{j}" for j in at)), "factors").df


def fit_pupil_confound_model(df: DataFrame, pupil: str, luminance: str, order: str, theta: str | None = None, factors: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Coefficients (term, estimate, std_error, ...) and the rows with ``pupil_confound_residual`` and ``pupil_confound_adjusted`` (residual plus the pupil's mean).

    Terms are luminance and trial order with their squares, theta and its product with luminance; factors (persons, items) are absorbed whatever their number of levels. Rows with a null or non-finite
    value, and null factors, take no part. Linear and quadratic terms that can't be told apart are a singular model, without residuals."""
    terms: dict[str, Column] = {"luminance": finite(luminance), "trial": finite(order), "luminance2": finite(luminance) * finite(luminance), "trial2": finite(order) * finite(order)}
    if theta:
        terms |= {"theta": finite(theta), "luminance_theta": finite(luminance) * finite(theta)}
    every = {"_y": finite(pupil)} | {f"_t{k}": c for k, c in enumerate(terms.values(), 1)}
    rows = Table(df.withColumns(every).dropna(subset=[*every, *factors]), "confounds").df
    columns = list(every)
    plain = rows.withColumns({f"_o{c}": F.col(c) for c in columns})
    clean = without_factors(plain, columns, factors) if factors else plain
    lost = sum(rows.select(f).distinct().count() - 1 for f in factors)
    fits = solve(clean, [], "_y", columns[1:], F.lit(lost))
    found = coefficients(fits, [], ["(intercept)", *terms])
    found = found.filter("term != '(intercept)'") if factors else found
    fitted = clean.crossJoin(F.broadcast(fits.select("beta"))).crossJoin(F.broadcast(rows.agg(F.avg("_y").alias("_mean"))))
    residual = F.col("_y") - sum((F.get("beta", F.lit(k)) * F.col(c) for k, c in enumerate(columns[1:], 1)), F.get("beta", F.lit(0)))
    out = fitted.withColumn("pupil_confound_residual", residual).withColumn("pupil_confound_adjusted", F.col("pupil_confound_residual") + F.col("_mean"))
    return found, out.select(*df.columns, "pupil_confound_residual", "pupil_confound_adjusted")


def pupil_kernel(since: Column, peak: float, shape: float) -> Column:
    """Response at a time since its event: (t / peak)^shape exp(shape (1 - t / peak)), 1 at the peak and 0 before the event."""
    x = since / peak
    return F.when(x > 0, F.exp(shape * (F.ln(x) + 1 - x))).otherwise(0.0)


def event_regressors(samples: DataFrame, events: DataFrame, by: Sequence[str], time: str, event_time: str, name: str, names: Sequence[str], peak: float, shape: float, support: float | None = None, normalised: bool = True) -> DataFrame:
    """samples with a column ``event__name`` a name: the sum of the responses to its events up to support (6 peaks by default) before, over the group's largest if normalised.

    Events are listed in the time bins that their support touches and meet samples by group and bin; samples of one time share one row there."""
    support = support if support is not None else 6 * peak
    t = finite(time)
    at = samples.select(*by, t.alias("_t")).dropna(subset=["_t"]).distinct().withColumn("_bin", F.floor(F.col("_t") / support))
    listed = events.select(*by, finite(event_time).alias("_e"), F.col(name).cast("string").alias("_name")).filter(F.col("_e").isNotNull() & F.col("_name").isin(*names))
    listed = listed.withColumn("_first", F.floor(F.col("_e") / support)).withColumn("_bin", F.explode(F.array(F.col("_first"), F.col("_first") + 1)))
    met = joined_null_safe(at, listed.drop("_first"), [*by, "_bin"]).filter((F.col("_t") >= F.col("_e")) & (F.col("_t") <= F.col("_e") + support))
    value = pupil_kernel(F.col("_t") - F.col("_e"), peak, shape)
    wide = met.groupBy(*by, "_t").agg(*(F.sum(F.when(F.col("_name") == n, value).otherwise(0.0)).alias(f"event__{n}") for n in names))
    if normalised:
        most = wide.groupBy(*by).agg(*(F.max(f"event__{n}").alias(f"_m_{n}") for n in names))
        wide = joined_null_safe(wide, most, by).withColumns({f"event__{n}": F.when(F.col(f"_m_{n}") > 0, F.col(f"event__{n}") / F.col(f"_m_{n}")).otherwise(0.0) for n in names}).drop(*(f"_m_{n}" for n in names))
    joined = joined_null_safe(samples.withColumn("_t", t), wide, [*by, "_t"], "left")
    return joined.withColumns({f"event__{n}": F.when(F.col("_t").isNotNull(), F.coalesce(f"event__{n}", F.lit(0.0))) for n in names}).drop("_t")


def fit_pupil_event_deconvolution(samples: DataFrame, events: DataFrame, by: Sequence[str], time: str, pupil: str, event_time: str, name: str, names: Sequence[str], peak: float = 930.0, shape: float = 10.1, least: int = 20, support: float | None = None) -> DataFrame:
    """Least squares of the pupil on the responses to the named events, for every group: fit_linear's columns, terms the intercept and the names.

    Groups with fewer samples than least, or a pupil that doesn't vary, are insufficient_data; those that lack an event of some name are singular."""
    made = event_regressors(samples.select(*by, time, pupil), events, by, time, event_time, name, names, peak, shape, support)
    known = Table(made.withColumn("_p", finite(pupil)).dropna(subset=["_p", *(f"event__{n}" for n in names)]), "deconvolution").df
    able = known.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp("_p").alias("_sd")).withColumn("_able", (F.col("n") >= least) & (F.col("_sd") > 0))
    fits = fit_linear(joined_null_safe(known, able.filter("_able").select(*by), by), by, "_p", {n: f"event__{n}" for n in names})
    none = able.filter(~F.coalesce("_able", F.lit(False))).select(*by, "n", F.lit("insufficient_data").alias("status"), F.explode(F.array(*map(F.lit, ["(intercept)", *names]))).alias("term"))
    return fits.unionByName(none, allowMissingColumns=True)


#: Terms of a fixation intensity beside its covariates.
SURFACE = ("x", "y", "x2", "y2", "xy")


def fixation_grid(df: DataFrame, by: Sequence[str], x: str, y: str, time: str, grid: int = 20, covariates: Sequence[str] = (), history: bool = False) -> DataFrame:
    """A row a cell with fixations: x_bin, y_bin (from 1, a cell has its upper bound), count, centres, and the means of the covariates and of the history term in it.

    The grid of a group spans its fixations. history is exp(-distance from the fixation before / mean distance); covariates missing in a whole cell take their mean over cells."""
    known = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y"), finite(time).alias("_time"), *(finite(c).alias(f"_c_{c}") for c in covariates)).dropna(subset=["_x", "_y", "_time"])
    if history:
        w = Window.partitionBy(*by).orderBy("_time", "_x", "_y")
        known = known.withColumn("_lag", F.sqrt(F.pow(F.col("_x") - F.lag("_x").over(w), 2) + F.pow(F.col("_y") - F.lag("_y").over(w), 2)))
    rows = Table(known, "fixations").df
    ends = rows.groupBy(*by).agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"), *([F.avg("_lag").alias("_scale")] if history else []))
    for a in "xy":
        pad = F.when(F.col(f"_{a}0") == F.col(f"_{a}1"), F.greatest(F.abs(f"_{a}0") * 0.01, F.lit(0.5))).otherwise(0.0)
        ends = ends.withColumns({f"_{a}0": F.col(f"_{a}0") - pad, f"_{a}1": F.col(f"_{a}1") + pad})
    met = joined_null_safe(rows, ends, by)
    for a in "xy":
        width = (F.col(f"_{a}1") - F.col(f"_{a}0")) / grid
        met = met.withColumns({f"{a}_bin": F.least(F.greatest(F.ceil((F.col(f"_{a}") - F.col(f"_{a}0")) / width), F.lit(1)), F.lit(grid)).cast("int"), f"_{a}w": width})
    extra = [F.avg(f"_c_{c}").alias(c) for c in covariates]
    if history:
        extra.append(F.coalesce(F.avg(F.exp(-F.col("_lag") / F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0))), F.lit(0.0)).alias("history"))
    centre = lambda a: F.first(F.col(f"_{a}0") + (F.col(f"{a}_bin") - 0.5) * F.col(f"_{a}w")).alias(f"{a}_center")
    cells = met.groupBy(*by, "x_bin", "y_bin").agg(F.count("*").alias("count"), centre("x"), centre("y"), *extra)
    if covariates:
        means = cells.groupBy(*by).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}") for c in covariates))
        cells = joined_null_safe(cells, means, by).withColumns({c: F.coalesce(c, f"_m_{c}") for c in covariates}).drop(*(f"_m_{c}" for c in covariates))
    return cells


def fit_fixation_point_process(df: DataFrame, by: Sequence[str], x: str, y: str, time: str, grid: int = 20, covariates: Sequence[str] = (), history: bool = False, least: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A gridded log-linear intensity of every group: coefficients; the cells with expected, residual and Pearson residual; and diagnostics (mean_pearson, sd_pearson, overdispersion, correlation).

    Logarithms of counts of cells that have fixations are regressed on the centres, their squares and product, the history term and the covariates. Groups with fewer fixations than least have no rows."""
    cells = Table(fixation_grid(df, by, x, y, time, grid, covariates, history), "fixation-grid").df
    able = cells.groupBy(*by).agg(F.sum("count").alias("_all")).filter(F.col("_all") >= least).select(*by)
    cells = joined_null_safe(cells, able, by) if by else cells
    a, b = F.col("x_center"), F.col("y_center")
    terms: dict[str, Column | str] = dict(zip(SURFACE, (a, b, a * a, b * b, a * b), strict=True)) | ({"history": "history"} if history else {}) | {c: c for c in covariates}
    table, names = design(cells, by, F.ln(F.col("count").cast("double")), terms)
    fits = Table(solve(table.df, by, "_y", [f"_t{k}" for k in range(1, len(names))]), "fixation-fits").df
    met = joined_null_safe(cells, fits.select(*by, "beta"), by)
    eta = sum((F.get("beta", F.lit(k)) * (F.col(c) if isinstance(c, str) else c) for k, c in enumerate(terms.values(), 1)), F.get("beta", F.lit(0)))
    found = met.withColumn("expected", F.exp(F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0)))).drop("beta")
    found = found.withColumns({"residual": F.col("count") - F.col("expected"), "pearson": (F.col("count") - F.col("expected")) / F.sqrt(F.greatest("expected", F.lit(1e-8)))})
    sums = found.groupBy(*by).agg(F.count("*").alias("n_cells"), F.avg("pearson").alias("mean_pearson"), F.stddev_samp("pearson").alias("sd_pearson"), ratio(F.sum(F.col("pearson") * F.col("pearson")), F.greatest(F.count("*") - len(names), F.lit(1))).alias("overdispersion"), F.corr(F.col("count").cast("double"), "expected").alias("correlation"))
    return coefficients(fits, by, names), found, sums


def fit_marked_gaze_process(df: DataFrame, by: Sequence[str], marks: Sequence[str], x: str, y: str, time: str) -> DataFrame:
    """Least squares of every mark on place, time and the product of the coordinates, all groups and marks in one run: by, mark and fit_linear's columns."""
    long = df.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.col(time).alias("time"), F.explode(F.array(*(F.struct(F.lit(m).alias("mark"), finite(m).alias("value")) for m in marks))).alias("_m")).select(*by, "x", "y", "time", "_m.mark", "_m.value")
    return fit_linear(long, [*by, "mark"], "value", {"x": "x", "y": "y", "time": "time", "xy": finite("x") * finite("y")})
