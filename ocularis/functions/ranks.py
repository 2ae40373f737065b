"""Ranks and running aggregates over a whole table without a window of the whole table.

Rows fall into a bounded number of buckets that follow the order; a window over the buckets' totals
gives what comes before each, and windows within buckets the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of rows by their order, of equal depth.
DEPTHS = 256


def joined_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """left with the other columns of right; null keys are equal. Without keys right has one row; small: right has at most 4096 rows."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    named = F.broadcast(named) if small or not on else named
    if not on:
        return left.crossJoin(named)
    test = F.lit(True)
    for c in on:
        test = test & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(named, test, how).drop(*(f"_on_{c}" for c in on))


def totalled(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates of the whole table in every row: one row is joined, and no task holds the table."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in totals.items()))))


def seeded_digest(seed: int, *keys: str) -> Column:
    """32 hex digits that depend on a seed and the keys' values as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def hashed_rank(df: DataFrame, digest: Column, ties: Sequence[str], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in its group by a hex digest and then the ties."""
    placed = df.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, 3)})
    counts = placed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_digest", *ties))
    joined = joined_null_safe(placed.withColumn("_within", within), before, [*by, "_bucket"], small=not by)
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_digest", "_bucket", "_before", "_within")


def bucketed(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """df with ``_bucket``, a number that rises with order and parts each group's rows about equally, wherever they lie: the bounds are its quantiles."""
    t = F.col(order).cast("double")
    cuts = F.expr("array(" + ", ".join(f"{k / DEPTHS}D" for k in range(1, DEPTHS)) + ")")
    bounds = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(t, cuts, 10_000)).alias("_bounds")).withColumn("_coarse", F.filter("_bounds", lambda _, k: k % 16 == 15))
    met = joined_null_safe(df, bounds, by)
    below = lambda of: F.array_size(F.filter(of, lambda b: b < t))
    placed = met.withColumn("_c", F.coalesce(below(F.col("_coarse")), F.lit(0)))
    return placed.withColumn("_bucket", F.col("_c") * 16 + F.coalesce(below(F.slice("_bounds", F.col("_c") * 16 + 1, F.lit(16))), F.lit(0))).drop("_bounds", "_coarse", "_c")


def run_through(placed: DataFrame, order: str | Sequence[str], steps: Sequence[dict], by: Sequence[str] = ()) -> DataFrame:
    """placed (bucketed) with running aggregates, by name: (F.sum, F.max or F.min, of what), or with True after them from the row to the group's end; order has no ties, or its ties
    are equal. A plain column is computed from what is there. Steps may read those before them and share one exchange and one sort."""
    w = Window.partitionBy(*by, "_bucket").orderBy(*([order] if isinstance(order, str) else order))
    joins = {F.max: F.greatest, F.min: F.least}
    for step in steps:
        plain = {k: c for k, c in step.items() if isinstance(c, Column)}
        new = {k: (*v, False)[:3] for k, v in step.items() if k not in plain}
        placed = placed.withColumns(plain) if plain else placed
        if not new:
            continue
        placed = placed.withColumns({f"_v_{k}": c for k, (_, c, _) in new.items()})
        totals = placed.groupBy(*by, "_bucket").agg(*(f(f"_v_{k}").alias(f"_t_{k}") for k, (f, *_) in new.items()))
        across = Window.partitionBy(*by).orderBy("_bucket")
        outside = {True: across.rowsBetween(1, Window.unboundedFollowing), False: across.rowsBetween(Window.unboundedPreceding, -1)}
        before = totals.select(*by, "_bucket", *(f(f"_t_{k}").over(outside[back]).alias(f"_b_{k}") for k, (f, _, back) in new.items()))
        inside = {True: w.rowsBetween(Window.currentRow, Window.unboundedFollowing), False: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)}
        within = placed.withColumns({f"_w_{k}": f(f"_v_{k}").over(inside[back]) for k, (f, _, back) in new.items()})
        joined = joined_null_safe(within, before, [*by, "_bucket"], small=not by)
        both = {k: (joins[f](f"_b_{k}", f"_w_{k}") if f in joins else F.coalesce(F.col(f"_b_{k}"), F.lit(0)) + F.coalesce(F.col(f"_w_{k}"), F.lit(0))) for k, (f, *_) in new.items()}
        placed = joined.withColumns(both).drop(*(f"_{x}_{k}" for x in "vwb" for k in new))
    return placed


def running(df: DataFrame, order: str, new: dict[str, tuple[Callable[[Column | str], Column], Column]], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """df with aggregates (F.sum or F.max, and of what) over the rows of the group up to this one, or from it on; order is a number and has no ties."""
    return run_through(bucketed(df, order, by), order, [{k: (f, c, descending) for k, (f, c) in new.items()}], by).drop("_bucket")
