"""Maximum likelihood for many groups at once: logistic, Poisson, Gaussian and ridge multinomial regression, and tests built on them.

A model's rows are written once with a column a term. Each round is one aggregate over the rows of
the groups that aren't settled: log-likelihood, gradient and the packed triangle of the information,
summed per group with partial sums in every task; then each group's small system is solved in its row. So
a group of any size is a row in the shuffle, and thousands of groups take as many rounds as the slowest.

Every group ends with a status: ``estimated``; ``insufficient_data`` (fewer rows than terms or the
least number asked for); ``singular`` (the terms are linearly dependent in the group); ``separated`` (estimates run off to infinity, because
some combination of terms predicts the outcome perfectly); ``not_converged``. Only estimated groups have numbers. Rows with
a null or non-finite outcome, term or weight take no part; null group keys are a group; a group without rows isn't in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import joined_null_safe
from ..functions.rounds import Table

ROUNDS = 40
#: A round settles a group whose scaled step and relative gain of log-likelihood are below these.
STEP, GAIN = 1e-7, 1e-10
#: Least pivot of the scaled information.
PIVOT = 1e-10


@dataclass(frozen=True)
class Likelihood:
    """Of one row: columns to compute first, log-likelihood, gradient by parameter, and minus the second derivative by pairs (j >= k); each given the parameters as columns."""

    size: int
    prepare: Callable[[list[Column]], list[dict[str, Column]]]
    value: Callable[[list[Column]], Column]
    gradient: Callable[[list[Column]], list[Column]]
    information: Callable[[list[Column]], list[Column]]
    ridge: float = 0.0
    start: tuple[float, ...] | None = None


def pairs(size: int) -> list[tuple[int, int]]:
    """Places of a packed lower triangle."""
    return [(j, k) for j in range(size) for k in range(j + 1)]


def generalised(terms: Sequence[str], outcome: str, family: str, weight: str | None = None) -> Likelihood:
    """Logistic (outcome from 0 to 1), Poisson with log link, or Gaussian with unit variance; terms are columns."""
    p = len(terms)
    y, x = F.col(outcome), [F.col(t) for t in terms]
    w = F.col(weight) if weight else F.lit(1.0)

    def prepare(b):
        eta = sum((b[k] * x[k] for k in range(1, p)), b[0] * x[0])
        mu = {"binomial": 1 / (1 + F.exp(-F.col("_eta"))), "poisson": F.exp("_eta"), "gaussian": F.col("_eta")}[family]
        v = {"binomial": F.col("_mu") * (1 - F.col("_mu")), "poisson": F.col("_mu"), "gaussian": F.lit(1.0)}[family]
        return [{"_eta": eta}, {"_mu": mu}, {"_r": w * (y - F.col("_mu")), "_v": w * v}]

    def value(b):
        e = F.col("_eta")
        return w * {"binomial": y * e - F.greatest(e, F.lit(0.0)) - F.log1p(F.exp(-F.abs(e))), "poisson": y * e - F.col("_mu"), "gaussian": -(y - e) * (y - e) / 2}[family]

    return Likelihood(p, prepare, value, lambda b: [F.col("_r") * x[k] for k in range(p)], lambda b: [F.col("_v") * x[j] * x[k] for j, k in pairs(p)])


def multinomial(terms: Sequence[str], outcome: str, states: Sequence[str], reference: str, weight: str | None = None, allowed: str | None = None, ridge: float = 1e-4) -> Likelihood:
    """Ridge-penalised logits of each state against the reference; allowed: an array column of flags, one for each of the states, of those that a row could go to."""
    others = [s for s in states if s != reference]
    p, n = len(terms), len(terms) * (len(states) - 1)
    x = [F.col(t) for t in terms]
    w = F.col(weight) if weight else F.lit(1.0)
    open_ = {s: (F.get(allowed, F.lit(k)).cast("double") if allowed else F.lit(1.0)) for k, s in enumerate(states)}
    at = [(s, k) for s in range(len(others)) for k in range(p)]

    def prepare(b):
        etas = {f"_e{s}": sum((b[s * p + k] * x[k] for k in range(1, p)), b[s * p] * x[0]) for s in range(len(others))}
        top = F.greatest(F.lit(0.0), *(F.col(f"_e{s}") for s in range(len(others))))
        terms_ = {f"_x{s}": open_[o] * F.exp(F.col(f"_e{s}") - F.col("_top")) for s, o in enumerate(others)} | {"_xr": open_[reference] * F.exp(-F.col("_top"))}
        total = sum((F.col(f"_x{s}") for s in range(len(others))), F.col("_xr"))
        shares = {f"_p{s}": F.col(f"_x{s}") / F.col("_z") for s in range(len(others))}
        return [etas, {"_top": top}, terms_, {"_z": total}, shares]

    hit = lambda s: F.when(F.col(outcome) == others[s], 1.0).otherwise(0.0)

    def value(b):
        own = F.lit(0.0)
        for s in range(len(others)):
            own = F.when(F.col(outcome) == others[s], F.col(f"_e{s}")).otherwise(own)
        return w * (own - F.col("_top") - F.ln("_z"))

    def information(b):
        out = []
        for j, k in pairs(n):
            (s, a), (t, c) = at[j], at[k]
            share = F.col(f"_p{s}") * ((1 - F.col(f"_p{s}")) if s == t else -F.col(f"_p{t}"))
            out.append(w * x[a] * x[c] * share)
        return out

    return Likelihood(n, prepare, value, lambda b: [w * x[k] * (hit(s) - F.col(f"_p{s}")) for s, k in at], information, ridge)


def cholesky(triangle: Sequence[float], size: int):
    """The information as a matrix, and its inverse or None if a pivot of the scaled matrix is too small."""
    import numpy as np

    h = np.zeros((size, size))
    for v, (j, k) in zip(triangle, pairs(size), strict=True):
        h[j, k] = h[k, j] = v
    d = np.sqrt(np.diag(h))
    if not np.all(np.isfinite(h)) or not np.all(d > 0):
        return h, None
    scaled = h / np.outer(d, d)
    try:
        low = np.linalg.cholesky(scaled)
    except np.linalg.LinAlgError:
        return h, None
    if np.min(np.diag(low)) ** 2 < PIVOT:
        return h, None
    inverse = np.linalg.inv(low)
    return h, (inverse.T @ inverse) / np.outer(d, d)


_STATE = "_n long, _beta array<double>, _step array<double>, _value double, _status string, _se array<double>, _covariance array<double>, _round int"


def _solve(size: int, ridge: float, keys: Sequence[str], last: bool):
    """The kernel over rows of groups with their sums: a Newton step each, halved while it loses likelihood."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                beta, step, now = np.array(row["_beta"]), np.array(row["_step"]), row["_now"]
                sums = row["_sums"]
                g, triangle = np.array(sums[: size]), sums[size :]
                if ridge:
                    now = now - ridge * float(beta @ beta) / 2
                    g = g - ridge * beta
                    triangle = [v + (ridge if j == k else 0) for v, (j, k) in zip(triangle, pairs(size), strict=True)]
                new = {"_n": row["_n"], "_round": row["_round"] + 1, "_value": now, "_se": None, "_covariance": None, "_status": "open"}
                if row["_value"] is not None and (not math.isfinite(now) or now < row["_value"] - 1e-9 * (abs(row["_value"]) + 1)) and np.max(np.abs(step)) > 1e-12:
                    step = step / 2
                    new |= {"_beta": (beta - step).tolist(), "_step": step.tolist(), "_value": row["_value"]}
                    out.append(new)
                    continue
                h, inverse = cholesky(triangle, size)
                if inverse is None:
                    new |= {"_beta": beta.tolist(), "_step": step.tolist(), "_status": "singular" if row["_round"] == 0 else "separated"}
                    out.append(new)
                    continue
                move = inverse @ g
                scaled = np.max(np.abs(move) / (1 + np.abs(beta)))
                gain = abs(now - row["_value"]) if row["_value"] is not None else math.inf
                settled = scaled < STEP or (scaled < 1e-4 and gain < GAIN * (abs(now) + 1e-3))
                if settled:
                    new |= {"_status": "estimated", "_se": np.sqrt(np.diag(inverse)).tolist(), "_covariance": [float(inverse[j, k]) for j, k in pairs(size)]}
                elif last:
                    new["_status"] = "separated" if scaled > 1e-3 else "not_converged"
                out.append(new | {"_beta": (beta + move).tolist(), "_step": move.tolist()})
            schema = pa.schema([*((k, batch.schema.field(k).type) for k in keys), ("_n", pa.int64()), ("_beta", pa.list_(pa.float64())), ("_step", pa.list_(pa.float64())), ("_value", pa.float64()), ("_status", pa.string()), ("_se", pa.list_(pa.float64())), ("_covariance", pa.list_(pa.float64())), ("_round", pa.int32())])
            names = [{k: batch.column(k)[i].as_py() for k in keys} for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pylist([a | b for a, b in zip(names, out, strict=True)], schema=schema)

    return run


def iterated(counts: DataFrame, by: Sequence[str], size: int, sums: Callable[[DataFrame], DataFrame], least: int = 1, rounds: int = ROUNDS, ridge: float = 0.0, start: Sequence[float] = ()) -> DataFrame:
    """by, n, status, value (log-likelihood), beta, se and covariance (packed) of every group in counts (by, ``_n``).

    sums gets the open groups with their ``_beta`` and gives by, ``_now`` (log-likelihood) and ``_sums`` (gradient, then the packed information) at it."""
    by = list(by)
    zeros = F.array(*map(F.lit, start or [0.0] * size)).cast("array<double>")
    none = F.lit(None).cast("array<double>")
    state = counts.filter("_n > 0").select(*by, "_n", zeros.alias("_beta"), F.transform(zeros, lambda _: F.lit(0.0)).alias("_step"), F.lit(None).cast("double").alias("_value"), F.when(F.col("_n") < max(least, 1), "insufficient_data").otherwise("open").alias("_status"), none.alias("_se"), none.alias("_covariance"), F.lit(0).alias("_round"))
    table = Table(state, "regression-state")
    done: list[DataFrame] = [table.df.filter("_status != 'open'")]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in counts.select(*by).dtypes), _STATE])
    for k in range(rounds):
        active = table.df.filter("_status = 'open'")
        if active.isEmpty():
            break
        whole = joined_null_safe(active.select(*by, "_n", "_beta", "_step", "_value", "_round"), sums(active.select(*by, "_beta")), by)
        table = Table(whole.mapInArrow(_solve(size, ridge, by, k == rounds - 1), schema), "regression-state")
        done.append(table.df.filter("_status != 'open'"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    good = F.col("_status") == "estimated"
    return out.select(*by, F.col("_n").alias("n"), F.col("_status").alias("status"), F.when(good, F.col("_value")).alias("value"), F.when(good, F.col("_beta")).alias("beta"), F.when(good, F.col("_se")).alias("se"), F.when(good, F.col("_covariance")).alias("covariance"))


def parameters(size: int) -> list[Column]:
    return [F.get("_beta", F.lit(j)) for j in range(size)]


def maximised(rows: DataFrame, by: Sequence[str], model: Likelihood, least: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """iterated for a likelihood that is a sum over rows, which have all that the model reads and nothing null; a table."""
    beta = parameters(model.size)

    def sums(active: DataFrame) -> DataFrame:
        met = joined_null_safe(rows, active, by)
        for columns in model.prepare(beta):
            met = met.withColumns(columns)
        parts = [*model.gradient(beta), *model.information(beta)]
        return met.groupBy(*by).agg(F.sum(model.value(beta)).alias("_now"), F.array(*(F.sum(c) for c in parts)).alias("_sums"))

    return iterated(rows.groupBy(*by).agg(F.count("*").alias("_n")), by, model.size, sums, least, rounds, model.ridge, model.start or ())


def design(df: DataFrame, by: Sequence[str], outcome: Column | str, terms: dict[str, Column | str], extra: dict[str, Column | str] | None = None, intercept: bool = True, numeric: bool = True) -> tuple[Table, list[str]]:
    """The rows that have everything, as a table: keys, ``_y``, one column a term and the extra ones; and the names of the terms."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    columns = {"_y": finite(as_column(outcome)) if numeric else as_column(outcome).cast("string")}
    columns |= {f"_t{k}": finite(as_column(c)) for k, c in enumerate(terms.values(), int(intercept))}
    columns |= {f"_w_{k}": as_column(c) for k, c in (extra or {}).items()}
    rows = df.select(*by, *(c.alias(k) for k, c in columns.items())).dropna(subset=list(columns))
    if intercept:
        rows = rows.withColumn("_t0", F.lit(1.0))
    return Table(rows, "regression-rows"), (["(intercept)"] if intercept else []) + list(terms)


def coefficients(fits: DataFrame, by: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """A row for each group and term: estimate, standard error, z and two-sided p; nulls where the group isn't estimated."""
    named = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.coalesce("beta", F.array_repeat(F.lit(None).cast("double"), len(terms))).alias("estimate"), F.coalesce("se", F.array_repeat(F.lit(None).cast("double"), len(terms))).alias("std_error"))
    rows = fits.select(*by, "n", "status", F.explode(named).alias("_c")).select(*by, "n", "status", "_c.term", "_c.estimate", "_c.std_error")
    return rows.withColumn("z", F.try_divide("estimate", "std_error")).withColumn("p_value", two_sided(F.col("z")))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail of z."""
    return upper_gamma(1, z * z / 2)


def _nested(x: Column, steps: Sequence[float]) -> Column:
    """1 + x / s1 (1 + x / s2 (1 + ...)), in code that doesn't grow with the steps."""
    return F.aggregate(F.array(*map(F.lit, reversed(steps))), F.lit(1.0), lambda a, s: 1 + x / s * a) if steps else F.lit(1.0)


def upper_gamma(twice: int, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(twice / 2, x): the tail of chi-square with so many degrees of freedom at 2x, as a finite sum."""
    if twice % 2 == 0:
        return F.exp(-x) * _nested(x, [float(k) for k in range(1, twice // 2)])
    tail = erfc(F.sqrt(x))
    return tail + F.sqrt(x) * F.exp(-x) * (2 / math.sqrt(math.pi)) * _nested(x, [k + 0.5 for k in range(1, twice // 2)]) if twice > 1 else tail


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series below 2, a continued fraction above; about 13 digits."""
    powers = F.array(*(F.lit((-1) ** k / (math.factorial(k) * (2 * k + 1))) for k in range(34, -1, -1)))
    series = x * F.aggregate(powers, F.lit(0.0), lambda a, c: a * x * x + c)
    fraction = F.aggregate(F.array(*(F.lit(k / 2) for k in range(60, 0, -1))), x, lambda a, k: x + k / a)
    return F.when(x < 2, 1 - series * (2 / math.sqrt(math.pi))).otherwise(F.exp(-x * x) / (fraction * math.sqrt(math.pi)))


def fit_generalised(df: DataFrame, by: Sequence[str], outcome: Column | str, terms: dict[str, Column | str], family: str = "binomial", weight: Column | str | None = None, least: int = 1) -> DataFrame:
    """Coefficients of a generalised linear model of every group: by, n, status, term, estimate, std_error, z, p_value.

    binomial, poisson (standard errors of unit dispersion) or gaussian (unit variance)."""
    table, names = design(df, by, outcome, terms, {"weight": weight} if weight is not None else None)
    model = generalised([f"_t{k}" for k in range(len(names))], "_y", family, "_w_weight" if weight is not None else None)
    return coefficients(maximised(table.df, by, model, max(least, len(names))), by, names)


def dummies(df: DataFrame, column: str, limit: int = 64) -> dict[str, Column]:
    """Indicator terms of a column's values but the first in order; over limit values raise an error, since each is a parameter."""
    found = sorted(r[0] for r in df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct().limit(limit + 1).collect())
    if len(found) > limit:
        raise ValueError(f"{column} has over {limit} values: absorb it instead")
    return {f"{column}[{v}]": (F.col(column).cast("string") == v).cast("double") for v in found[1:]}


def fit_dif(df: DataFrame, person: str, item: str, score: str, group: str, least: int = 10) -> DataFrame:
    """Logistic test of differential functioning of every item: chisq, df and p_value of group and its product with the rest score against the rest score alone.

    The rest score is the person's sum over all other responses. Items with fewer rows than least or one group are insufficient_data; a status of either fit that isn't estimated is the item's."""
    rows = df.select(person, item, finite(score).alias("_s"), F.col(group).cast("string").alias("_g")).filter("_s is not null and _g is not null")
    total = rows.groupBy(person).agg(F.sum("_s").alias("_all"))
    scored = Table(joined_null_safe(rows, total, [person]).select(item, "_s", "_g", (F.col("_all") - F.col("_s")).alias("_rest")), "regression-dif")
    marks = dummies(scored.df, "_g")
    terms = {"rest": "_rest"} | marks | {f"rest:{k}": F.col("_rest") * c for k, c in marks.items()}
    levels = scored.df.groupBy(item).agg(F.count("*").alias("_rows"), F.countDistinct("_g").alias("_levels"))
    able = levels.filter((F.col("_rows") >= least) & (F.col("_levels") > 1)).select(item)
    usable = joined_null_safe(scored.df, able, [item])
    fits = []
    for some in ({"rest": "_rest"}, terms):
        table, names = design(usable, [item], "_s", some)
        fits.append(maximised(table.df, [item], generalised([f"_t{k}" for k in range(len(names))], "_y", "binomial"), len(names)))
    both = joined_null_safe(levels, fits[0].select(item, F.col("value").alias("_v0"), F.col("status").alias("_s0")), [item], "left")
    both = joined_null_safe(both, fits[1].select(item, F.col("value").alias("_v1"), F.col("status").alias("_s1")), [item], "left")
    status = F.when(F.col("_s0").isNull(), "insufficient_data").when(F.col("_s0") != "estimated", F.col("_s0")).otherwise(F.col("_s1"))
    chisq = F.greatest(F.lit(0.0), 2 * (F.col("_v1") - F.col("_v0")))
    df_ = len(terms) - 1
    good = F.col("status") == "estimated"
    return both.withColumn("status", status).select(item, F.col("_rows").alias("n"), "status", F.when(good, chisq).alias("chisq"), F.when(good, F.lit(df_)).alias("df"), F.when(good, upper_gamma(df_, chisq / 2)).alias("p_value"))


def fit_multinomial_transition(df: DataFrame, state: str, terms: dict[str, Column | str], by: Sequence[str] = (), weight: Column | str | None = None, allowed: Column | None = None, reference: str | None = None, ridge: float = 1e-4, states: Sequence[str] | None = None) -> DataFrame:
    """Ridge multinomial logit of the next state: by, n, status, destination, term, estimate, std_error, z, p_value, the reference's rows at zero.

    allowed: an array of flags in the order of states (by default the sorted values of state, at most 64), for structural masks; rows whose own state isn't allowed raise an error."""
    if states is None:
        states = sorted(r[0] for r in df.select(F.col(state).cast("string").alias("v")).filter("v is not null").distinct().limit(65).collect())
        if len(states) > 64:
            raise ValueError("over 64 states")
    reference = states[-1] if reference is None else reference
    if reference not in states:
        raise ValueError(f"unknown reference state: {reference}")
    extra = {k: v for k, v in (("weight", weight), ("allowed", allowed)) if v is not None}
    table, names = design(df, by, state, terms, extra, numeric=False)
    if allowed is not None:
        own = F.get("_w_allowed", F.array_position(F.array(*map(F.lit, states)), F.col("_y")).cast("int") - 1)
        if not table.df.filter(~F.coalesce(own, F.lit(False))).isEmpty():
            raise ValueError("observed transitions violate the mask")
    model = multinomial([f"_t{k}" for k in range(len(names))], "_y", states, reference, "_w_weight" if weight is not None else None, "_w_allowed" if allowed is not None else None, ridge)
    fits = maximised(table.df, by, model, len(names))
    others = [s for s in states if s != reference]
    found = coefficients(fits, by, [f"{s}\u0001{t}" for s in others for t in names])
    parts = F.split("term", "\u0001")
    rest = fits.select(*by, "n", "status", F.explode(F.array(*map(F.lit, names))).alias("term")).withColumns({"destination": F.lit(reference), "estimate": F.when(F.col("status") == "estimated", 0.0), "std_error": F.when(F.col("status") == "estimated", 0.0)})
    rest = rest.withColumns({"z": F.lit(None).cast("double"), "p_value": F.lit(None).cast("double")})
    columns = [*by, "n", "status", "destination", "term", "estimate", "std_error", "z", "p_value"]
    return found.withColumns({"destination": F.get(parts, F.lit(0)), "term": F.get(parts, F.lit(1))}).select(columns).unionByName(rest.select(columns))


def model_missing_process(df: DataFrame, by: Sequence[str], feature: str, predictors: dict[str, Column | str], least: int = 1) -> DataFrame:
    """Logistic model, for every group, of whether a feature is missing (null or not finite)."""
    return fit_generalised(df, by, finite(feature).isNull().cast("double"), predictors, "binomial", least=least)


def estimate_exposure_probability(df: DataFrame, by: Sequence[str], exposed: str, numbers: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """df's rows that have everything, with the fitted probability of exposure; categories become indicators."""
    terms: dict[str, Column | str] = {c: c for c in numbers}
    for c in categories:
        terms |= dummies(df, c)
    rows = df.dropna(subset=[exposed, *numbers, *categories])
    table, names = design(rows, by, F.col(exposed).cast("double"), terms)
    fits = maximised(table.df, by, generalised([f"_t{k}" for k in range(len(names))], "_y", "binomial"), len(names))
    met = joined_null_safe(rows, fits.select(*by, F.col("beta").alias("_b"), "status"), by)
    values = [F.lit(1.0), *(finite(c if isinstance(c, Column) else F.col(c)) for c in terms.values())]
    eta = sum((F.get("_b", F.lit(k)) * v for k, v in enumerate(values)), F.lit(0.0))
    return met.withColumn("probability", 1 / (1 + F.exp(-eta))).drop("_b")
