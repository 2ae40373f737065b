"""Regression of censored latencies: Cox's model with its checks, and accelerated failure times.

The sums over those at risk that Cox's partial likelihood needs are running sums from the last time
to the first. Rows are counted by time first, times fall into buckets of equal depth (``functions.ranks``), and a round is one aggregate by
time, one pass over the buckets and one sum per stratum; the small system of each stratum is
solved in its row. No window holds a whole stratum and no rows of a risk set meet.

Rows with a null or non-finite time, term, or a null event take no part. Strata end with the statuses of ``regression``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import bucketed, joined_null_safe, run_through
from ..functions.rounds import Table
from .regression import Likelihood, coefficients, erfc, iterated, maximised, pairs, parameters, two_sided


class Cox:
    """A fitted model: fits (by, n, status, value, beta, se, covariance), its rows and terms."""

    def __init__(self, data: DataFrame, by: Sequence[str], terms: dict[str, Column | str], time: str = "analysis_time", event: str = "event_observed", ties: str = "breslow", cluster: str | None = None) -> None:
        if ties not in ("breslow", "efron"):
            raise ValueError(f"unknown ties: {ties}")
        if cluster and ties != "breslow":
            raise ValueError("clusters need Breslow ties")
        self.by, self.ties, self.cluster, self.terms = list(by), ties, cluster, list(terms)
        self.size = len(terms)
        if not self.size:
            raise ValueError("a Cox model needs a term")
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        raw = data.select(*by, finite(time).alias("_time"), F.col(event).cast("boolean").cast("int").alias("_e"), *(finite(as_column(c)).alias(f"_r{k}") for k, c in enumerate(terms.values())), *([F.col(cluster).cast("string").alias("_cluster")] if cluster else []))
        rows = Table(raw.dropna(subset=["_time", "_e", *(f"_r{k}" for k in range(self.size))]), "cox-raw").df
        # terms about their mean, so that exponentials stay in range; the estimates don't change
        means = rows.groupBy(*by).agg(*(F.avg(f"_r{k}").alias(f"_m{k}") for k in range(self.size)))
        centred = joined_null_safe(rows, means, by).withColumns({f"_t{k}": F.col(f"_r{k}") - F.col(f"_m{k}") for k in range(self.size)})
        self.rows = Table(bucketed(centred.drop(*(f"_{x}{k}" for x in "rm" for k in range(self.size))), "_time", by), "cox-rows").df
        counts = self.rows.groupBy(*by).agg(F.count("*").alias("_n"))
        events = self.rows.groupBy(*by).agg(F.sum("_e").alias("_events"))
        able = joined_null_safe(counts, events, by).withColumn("_n", F.col("_n")).filter("_events > 0").drop("_events")
        none = joined_null_safe(counts, events, by).filter("_events = 0").select(*by, F.col("_n").alias("n"), F.lit("insufficient_data").alias("status"), F.lit(None).cast("double").alias("value"), *(F.lit(None).cast("array<double>").alias(c) for c in ("beta", "se", "covariance")))
        self.fits = iterated(able, by, self.size, self._sums, self.size + 1).unionByName(none)

    def _x(self) -> list[Column]:
        return [F.col(f"_t{k}") for k in range(self.size)]

    def _with_risk(self, active: DataFrame) -> DataFrame:
        """The rows of the active strata with their linear predictor and its exponential."""
        eta = sum((b * x for b, x in zip(parameters(self.size), self._x(), strict=True)), F.lit(0.0))
        return joined_null_safe(self.rows, active, self.by).withColumn("_eta", eta).withColumn("_h", F.exp("_eta"))

    def _times(self, met: DataFrame) -> DataFrame:
        """A row a time: events d, sums over events and, from here to the end, sums over those at risk (r0, r1_, r2_)."""
        x, two = self._x(), pairs(self.size)
        event = F.col("_e") == 1
        sums = {"_s0": F.sum("_h")} | {f"_s1_{j}": F.sum(F.col("_h") * x[j]) for j in range(self.size)} | {f"_s2_{j}_{k}": F.sum(F.col("_h") * x[j] * x[k]) for j, k in two}
        own = {"d": F.sum("_e").cast("long"), "_le": F.sum(F.when(event, F.col("_eta")).otherwise(0.0))} | {f"_x{j}": F.sum(F.when(event, x[j]).otherwise(0.0)) for j in range(self.size)}
        if self.ties == "efron":
            h = F.when(event, F.col("_h")).otherwise(0.0)
            own |= {"_e0": F.sum(h)} | {f"_e1_{j}": F.sum(h * x[j]) for j in range(self.size)} | {f"_e2_{j}_{k}": F.sum(h * x[j] * x[k]) for j, k in two}
        cells = met.groupBy(*self.by, "_bucket", "_time").agg(*(c.alias(k) for k, c in (sums | own).items()))
        return run_through(cells, "_time", [{k.replace("_s", "r", 1): (F.sum, F.col(k), True) for k in sums}], self.by)

    def _sums(self, active: DataFrame) -> DataFrame:
        at = self._times(self._with_risk(active)).filter("d > 0")
        r0, d, p = F.col("r0"), F.col("d").cast("double"), range(self.size)
        r1 = [F.col(f"r1_{j}") for j in p]
        if self.ties == "breslow":
            value = F.col("_le") - d * F.ln(r0)
            gradient = [F.col(f"_x{j}") - d * r1[j] / r0 for j in p]
            information = [d * (F.col(f"r2_{j}_{k}") / r0 - r1[j] * r1[k] / (r0 * r0)) for j, k in pairs(self.size)]
        else:
            # sums over the places of tied events, with shares of the events' own sums taken off
            each = F.transform(F.sequence(F.lit(0), F.col("d").cast("int") - 1), lambda k: F.struct((k / d).alias("f"), (r0 - k / d * F.col("_e0")).alias("s")))
            at = at.withColumn("_k", each)
            total = lambda of: F.aggregate("_k", F.lit(0.0), lambda a, k: a + of(k["f"], k["s"]))
            at = at.withColumns({"_a": total(lambda f, s: 1 / s), "_b": total(lambda f, s: f / s), "_c": total(lambda f, s: 1 / (s * s)), "_d": total(lambda f, s: f / (s * s)), "_f": total(lambda f, s: f * f / (s * s)), "_l": total(lambda f, s: F.ln(s))})
            e1 = [F.col(f"_e1_{j}") for j in p]
            value = F.col("_le") - F.col("_l")
            gradient = [F.col(f"_x{j}") - (r1[j] * F.col("_a") - e1[j] * F.col("_b")) for j in p]
            information = [F.col(f"r2_{j}_{k}") * F.col("_a") - F.col(f"_e2_{j}_{k}") * F.col("_b") - (r1[j] * r1[k] * F.col("_c") - (r1[j] * e1[k] + e1[j] * r1[k]) * F.col("_d") + e1[j] * e1[k] * F.col("_f")) for j, k in pairs(self.size)]
        return at.groupBy(*self.by).agg(F.sum(value).alias("_now"), F.array(*(F.sum(c) for c in [*gradient, *information])).alias("_sums"))

    def _fitted(self) -> DataFrame:
        return self.fits.filter("status = 'estimated'").select(*self.by, F.col("beta").alias("_beta"))

    def table(self, level: float = 0.95) -> DataFrame:
        """by, n, status, term, estimate, std_error (of clusters, if any), hazard_ratio with its interval, z and p_value."""
        from ..functions.columns import normal_quantile

        fits = joined_null_safe(self.fits.drop("se"), self._robust(), self.by, "left") if self.cluster else self.fits
        z = normal_quantile(0.5 + level / 2)
        return coefficients(fits, self.by, self.terms).withColumns({"hazard_ratio": F.exp("estimate"), "conf_low": F.exp(F.col("estimate") - z * F.col("std_error")), "conf_high": F.exp(F.col("estimate") + z * F.col("std_error"))})

    def _robust(self) -> DataFrame:
        """by and se: the sandwich with the score residuals summed over each cluster."""
        met = self._with_risk(self._fitted())
        p = range(self.size)
        share = F.col("d") / F.col("r0")
        steps = [{"_a": (F.sum, share)} | {f"_b{j}": (F.sum, share * F.col(f"r1_{j}") / F.col("r0")) for j in p}]
        at = run_through(self._times(met), "_time", steps, self.by).select(*self.by, "_bucket", "_time", "r0", "_a", *(f"r1_{j}" for j in p), *(f"_b{j}" for j in p))
        both = joined_null_safe(met, at, [*self.by, "_bucket", "_time"])
        x = self._x()
        score = [F.col("_e") * (x[j] - F.col(f"r1_{j}") / F.col("r0")) - F.col("_h") * (x[j] * F.col("_a") - F.col(f"_b{j}")) for j in p]
        clusters = both.groupBy(*self.by, "_cluster").agg(*(F.sum(s).alias(f"_u{j}") for j, s in enumerate(score)))
        meat = clusters.groupBy(*self.by).agg(*(F.sum(F.col(f"_u{j}") * F.col(f"_u{k}")).alias(f"_q{max(j, k)}_{min(j, k)}") for j, k in pairs(self.size)))
        packed = joined_null_safe(self.fits.filter("status = 'estimated'").select(*self.by, "covariance"), meat, self.by)
        place = {jk: n for n, jk in enumerate(pairs(self.size))}
        v = lambda j, k: F.get("covariance", F.lit(place[max(j, k), min(j, k)]))
        q = lambda j, k: F.col(f"_q{max(j, k)}_{min(j, k)}")
        variances = [sum((v(j, a) * q(a, b) * v(b, j) for a in p for b in p), F.lit(0.0)) for j in p]
        return packed.select(*self.by, F.array(*(F.sqrt(x) for x in variances)).alias("se"))

    def residuals(self) -> DataFrame:
        """Schoenfeld residuals: by, term, time and residual of every event of an estimated stratum."""
        met = self._with_risk(self._fitted())
        at = self._times(met).select(*self.by, "_bucket", "_time", "r0", *(f"r1_{j}" for j in range(self.size)))
        both = joined_null_safe(met.filter("_e = 1"), at, [*self.by, "_bucket", "_time"])
        each = F.array(*(F.struct(F.lit(t).alias("term"), (F.col(f"_t{j}") - F.col(f"r1_{j}") / F.col("r0")).alias("residual")) for j, t in enumerate(self.terms)))
        return both.select(*self.by, F.col("_time").alias("time"), F.explode(each).alias("_s")).select(*self.by, "_s.term", "time", "_s.residual")

    def check(self, alpha: float = 0.05) -> DataFrame:
        """Rank correlation of the residuals with time, for every term: by, term, n, rho, p_value (Student's t) and ph_flag; events at times of 0 or less, and fewer than four, give nulls."""
        rows = Table(self.residuals().filter("time > 0"), "cox-residuals").df
        keys = [*self.by, "term"]
        for c in ("time", "residual"):
            counts = rows.groupBy(*keys, c).agg(F.count("*").alias("_k"))
            ranked = run_through(bucketed(counts, c, keys), c, [{"_s": (F.sum, F.col("_k"))}], keys).select(*keys, c, (F.col("_s") - (F.col("_k") - 1) / 2).alias(f"_rank_{c}"))
            rows = joined_null_safe(rows, ranked, [*keys, c])
        sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rank_time", "_rank_residual").alias("rho"))
        good = (F.col("n") >= 4) & F.col("rho").isNotNull() & ~F.isnan("rho")
        from pyspark.sql.types import DoubleType

        tail = F.udf(lambda r, n: None if r is None else student_tail(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2), DoubleType())
        out = sums.withColumn("rho", F.when(good, F.col("rho"))).withColumn("p_value", tail("rho", "n"))
        return out.withColumn("ph_flag", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def student_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        total = d
        for m in range(1, 400):
            for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + up * d or 1e-300), 1 + up / c or 1e-300
                total *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return total

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def _accelerated(terms: Sequence[str], time: str, event: str, distribution: str) -> Likelihood:
    """Log-likelihood of ln T = x b + sigma e with censoring, in the parameters b / sigma and 1 / sigma, in which it is concave. time is ln T."""
    p = len(terms)
    x, y, d = [F.col(t) for t in terms], F.col(time), F.col(event).cast("double")
    z, u, w = F.col("_z"), F.col("_u"), F.col("_w")

    def prepare(b):
        first = [{"_z": b[p] * y - sum((b[k] * x[k] for k in range(1, p)), b[0] * x[0])}]
        # v, u, w: logarithm of the density (of the survivor's share where censored), its first and minus its second derivative by z
        if distribution == "weibull":
            return [*first, {"_h": F.exp("_z")}, {"_u": d - F.col("_h"), "_w": F.col("_h"), "_v": d * z - F.col("_h")}]
        survivor = F.when(z >= 0, erfc(F.abs(z) / math.sqrt(2)) / 2).otherwise(1 - erfc(F.abs(z) / math.sqrt(2)) / 2)
        hazard = F.when(z > 30, z).otherwise(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / F.col("_q"))
        tail = F.when(z > 30, -z * z / 2 - F.ln(z * math.sqrt(2 * math.pi))).otherwise(F.ln("_q"))
        return [*first, {"_q": survivor}, {"_m": hazard}, {"_u": F.when(d == 1, -z).otherwise(-F.col("_m")), "_w": F.when(d == 1, 1.0).otherwise(F.col("_m") * (F.col("_m") - z)), "_v": F.when(d == 1, -z * z / 2 - math.log(2 * math.pi) / 2).otherwise(tail)}]

    def value(b):
        return F.col("_v") + F.when(d == 1, F.when(b[p] > 0, F.ln(b[p])).otherwise(F.lit(-math.inf)) - y).otherwise(0.0)

    def information(b):
        out = []
        for j, k in pairs(p + 1):
            if j < p:
                out.append(w * x[j] * x[k])
            elif k < p:
                out.append(-w * x[k] * y)
            else:
                out.append(w * y * y + d / (b[p] * b[p]))
        return out

    return Likelihood(p + 1, prepare, value, lambda b: [*(-u * x[k] for k in range(p)), u * y + d / b[p]], information, start=(*[0.0] * p, 1.0))


def _by_sigma(fits: DataFrame, size: int) -> DataFrame:
    """The fits in b and ln(sigma) instead of b / sigma and 1 / sigma, standard errors by the delta method."""
    place = {jk: n for n, jk in enumerate(pairs(size))}
    v = lambda j, k: F.get("covariance", F.lit(place[max(j, k), min(j, k)]))
    last = size - 1
    tau = F.get("beta", F.lit(last))
    b = [F.get("beta", F.lit(k)) / tau for k in range(last)]
    errors = [F.sqrt(F.greatest(v(k, k) - 2 * b[k] * v(k, last) + b[k] * b[k] * v(last, last), F.lit(0.0))) / tau for k in range(last)]
    good = F.col("beta").isNotNull()
    return fits.withColumns({"_b": F.when(good, F.array(*b, -F.ln(tau))), "_e": F.when(good, F.array(*errors, F.sqrt(v(last, last)) / tau))}).drop("beta", "se").withColumnsRenamed({"_b": "beta", "_e": "se"})


def fit_accelerated(data: DataFrame, by: Sequence[str], terms: dict[str, Column | str], distribution: str, time: str = "analysis_time", event: str = "event_observed") -> DataFrame:
    """Weibull or lognormal accelerated failure times with right censoring: by, n, status, log_likelihood, term, estimate, std_error, time_ratio, z, p_value.

    Terms are the intercept, the named ones and ``ln(sigma)``, whose time_ratio is sigma itself. Times of 0 or less raise an error."""
    if distribution not in ("weibull", "lognormal"):
        raise ValueError("distribution must be 'weibull' or 'lognormal'")
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    raw = data.select(*by, finite(time).alias("_time"), F.col(event).cast("boolean").cast("int").alias("_e"), F.lit(1.0).alias("_t0"), *(finite(as_column(c)).alias(f"_t{k}") for k, c in enumerate(terms.values(), 1))).dropna(subset=["_time", "_e", *(f"_t{k}" for k in range(1, len(terms) + 1))])
    rows = Table(raw, "accelerated-raw").df
    if not rows.filter("_time <= 0").isEmpty():
        raise ValueError("accelerated failure times must be positive")
    # logarithms about their mean and over their deviation: the rounds start near
    scale = rows.groupBy(*by).agg(F.avg(F.ln("_time")).alias("_mean"), F.greatest(F.coalesce(F.stddev_samp(F.ln("_time")), F.lit(1.0)), F.lit(1e-6)).alias("_sd"), F.sum("_e").alias("_events"))
    scaled = Table(joined_null_safe(rows, scale, by).withColumn("_ln", (F.ln("_time") - F.col("_mean")) / F.col("_sd")), "accelerated-rows").df
    names = ["(intercept)", *terms, "ln(sigma)"]
    fits = _by_sigma(maximised(scaled, by, _accelerated([f"_t{k}" for k in range(len(terms) + 1)], "_ln", "_e", distribution), len(names)), len(names))
    back = joined_null_safe(coefficients(fits, by, names), scale, by)
    back = joined_null_safe(back, fits.select(*by, F.col("value").alias("_value")), by)
    term = F.col("term")
    estimate = F.when(term == "(intercept)", F.col("estimate") * F.col("_sd") + F.col("_mean")).when(term == "ln(sigma)", F.col("estimate") + F.ln("_sd")).otherwise(F.col("estimate") * F.col("_sd"))
    error = F.when(term == "ln(sigma)", F.col("std_error")).otherwise(F.col("std_error") * F.col("_sd"))
    out = back.select(*by, "n", "status", (F.col("_value") - F.col("_events") * (F.ln("_sd") + F.lit(0.0))).alias("log_likelihood"), "term", estimate.alias("estimate"), error.alias("std_error"), "_events", "_mean", "_sd")
    # densities of T rather than of the scaled logarithm: each event has 1 / sd, and t instead of the scaled logarithm's exponential
    shift = scaled.groupBy(*by).agg(F.sum(F.when(F.col("_e") == 1, F.col("_ln") - F.ln("_time")).otherwise(0.0)).alias("_shift"))
    out = joined_null_safe(out, shift, by).withColumn("log_likelihood", F.col("log_likelihood") + F.col("_shift"))
    return out.withColumns({"time_ratio": F.exp("estimate"), "z": F.try_divide("estimate", "std_error")}).withColumn("p_value", two_sided(F.col("z"))).drop("_events", "_mean", "_sd", "_shift")
