"""Column expressions that most operators use. All stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """x, with NaN and infinities as null: the numeric kernels skip what isn't finite."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def share(flag: Column) -> Column:
    """Fraction of rows with a true flag; null flags count as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def count_if(flag: Column) -> Column:
    return F.sum(F.coalesce(flag, F.lit(False)).cast("long"))


def ordered(by: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def through(w: WindowSpec) -> WindowSpec:
    """From the start of the group to the row."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def run_id(changed: Column, w: WindowSpec) -> Column:
    """Number of the run a row is in: running count of rows that begin one."""
    return F.sum(F.coalesce(changed, F.lit(True)).cast("long")).over(through(w))


def changed(x: str | Column, w: WindowSpec) -> Column:
    """Whether x differs from the row before; true for the first row. Nulls are equal."""
    c = col(x)
    return F.lag(F.lit(1)).over(w).isNull() | ~c.eqNullSafe(F.lag(c).over(w))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def every(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def anyof(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def mad(x: str, by: Sequence[str], scale: float = 1.4826) -> Column:
    """Scaled median absolute deviation as a window expression over by."""
    w = Window.partitionBy(*by)
    return scale * F.median(F.abs(col(x) - F.median(col(x)).over(w))).over(w)


def entropy(p: str | Column, base: float = 2.0) -> Column:
    """-sum(p log p) over a group; zero shares add nothing."""
    c = col(p)
    return -F.sum(F.when(c > 0, c * F.ln(c) / math.log(base)).otherwise(0.0))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; null where a side is constant."""
    a, b = finite(x), finite(y)
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def normal_cdf(z: str | Column) -> Column:
    """Standard normal distribution function; absolute error below 7.5e-8 (a polynomial in 1 / (1 + p|z|))."""
    c = col(z)
    t = 1 / (1 + 0.2316419 * F.abs(c))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-c * c / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(c >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def chi2_quantile(p: float, df: int) -> float:
    """Wilson and Hilferty's approximation, which is exact enough for screening limits (relative error below 1 % for df >= 2)."""
    z = normal_quantile(p)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def expit(z: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(z)))


def softmax(scores: Column) -> Column:
    """Array of shares of an array of scores."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def trapezoid(y: str | Column, t: str | Column, w: WindowSpec) -> Column:
    """A row's own part of the area under y: sum it over the group."""
    a, x = col(y), col(t)
    return (a + F.lag(a).over(w)) / 2 * (x - F.lag(x).over(w))


def gradient(y: str | Column, t: str | Column, w: WindowSpec) -> Column:
    """Central difference for uneven steps, one-sided at the ends."""
    a, x = col(y), col(t)
    h0, h1 = x - F.lag(x).over(w), F.lead(x).over(w) - x
    d0, d1 = ratio(a - F.lag(a).over(w), h0), ratio(F.lead(a).over(w) - a, h1)
    inner = ratio(h1 * d0 + h0 * d1, h0 + h1)
    return F.when(h0.isNull(), d1).when(h1.isNull(), d0).otherwise(inner)
