"""Axes of many rows and few variables: multiblock maps, and curves taken apart into phase and amplitude.

Rows are arrays of bounded length. Every task adds up the cross products of its rows, the tasks' sums are added
by place, and the eigenvectors of the small matrix give the axes; scores are projections in the row. Axes come by falling
variance, each with the sign that makes its largest loading (the first of equally large ones) positive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import joined_null_safe
from ..functions.rounds import Table
from .alignment import bracketed

#: Most variables of a matrix whose axes are taken.
WIDEST = 1024


def cross_products(rows: DataFrame, values: str, size: int):
    """n, and the matrix of sums of products of the entries of an array column without nulls, as numpy."""
    import numpy as np

    if size > WIDEST:
        raise ValueError(f"over {WIDEST} variables")

    def run(batches):
        import pyarrow as pa

        n, total = 0, np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            n, total = n + batch.num_rows, total + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "sums"])

    parts = Table(rows.select(F.col(values).cast("array<double>").alias("x")).mapInArrow(run, "n long, sums array<double>"), "cross").df
    out = np.zeros(size * size)
    # at most WIDEST squared numbers, whatever the rows
    for r in parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], out.reshape(size, size)


def axes(matrix, most: int):
    """Singular values and directions (columns) of the rows behind a matrix of cross products."""
    import numpy as np

    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    for k in range(vectors.shape[1]):
        size = np.abs(vectors[:, k])
        first = int(np.flatnonzero(size >= size.max() - 1e-12)[0])
        vectors[:, k] *= 1.0 if vectors[first, k] >= 0 else -1.0
    return np.sqrt(np.maximum(values[order], 0)), vectors


def projected(values: str, directions) -> list[Column]:
    dot = lambda w: F.aggregate(F.zip_with(values, F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return [dot(directions[:, k]) for k in range(directions.shape[1])]


@dataclass(frozen=True)
class MultiblockMap:
    """persons (the id and PC1, PC2, ...), variables (block, variable, PC1, ...), blocks (block, mean size of the loadings) and the singular values."""

    persons: DataFrame
    variables: DataFrame
    blocks: DataFrame
    singular_values: tuple[float, ...]


def fit_multiblock_process_map(df: DataFrame, blocks: Mapping[str, Sequence[str]], id: str, components: int = 5, scaling: str = "size") -> MultiblockMap:
    """Principal axes of standardised blocks of variables that weigh alike: by the root of their number of variables (``size``), or by their own first singular value (``first_axis``).

    Missing and non-finite values take the variable's mean; variables that don't vary are left out and so are blocks without variables. Fewer than two blocks or three rows, or a variable in two blocks, raise an error."""
    import numpy as np

    if scaling not in ("size", "first_axis"):
        raise ValueError(f"unknown scaling: {scaling}")
    flat = [v for vs in blocks.values() for v in vs]
    if len(flat) != len(set(flat)):
        raise ValueError("a variable belongs to one block")
    rows = Table(df.select(F.col(id).alias("_id"), *(finite(v).alias(f"_v{k}") for k, v in enumerate(flat))), "multiblock").df
    means = rows.agg(F.count("*"), *(F.avg(f"_v{k}") for k in range(len(flat)))).first()
    filled = rows.select("_id", *(F.coalesce(f"_v{k}", F.lit(means[1 + k])).alias(f"_v{k}") for k in range(len(flat))))
    scale = filled.agg(*(F.stddev_samp(f"_v{k}") for k in range(len(flat)))).first()
    kept = {b: [k for k, v in enumerate(flat) if v in vs and scale[k]] for b, vs in blocks.items()}
    kept = {b: ks for b, ks in kept.items() if ks}
    if len(kept) < 2 or means[0] < 3:
        raise ValueError("at least two blocks with varying variables and three rows are required")
    used = [k for ks in kept.values() for k in ks]
    standard = Table(filled.select("_id", F.array(*((F.col(f"_v{k}") - means[1 + k]) / scale[k] for k in used)).alias("z")), "multiblock-z").df
    n, matrix = cross_products(standard, "z", len(used))
    weights, at = np.zeros(len(used)), 0
    for ks in kept.values():
        part = slice(at, at + len(ks))
        weights[part] = 1 / np.sqrt(len(ks)) if scaling == "size" else 1 / axes(matrix[part, part], 1)[0][0]
        at += len(ks)
    most = min(components, len(used), n - 1)
    values, directions = axes(matrix * np.outer(weights, weights), most)
    scores = projected("z", directions * weights[:, None])
    names = [f"PC{k + 1}" for k in range(most)]
    spark = df.sparkSession
    of = [b for b, ks in kept.items() for _ in ks]
    schema = ", ".join(f"{c} double" for c in names)
    variables = [(b, flat[k], *map(float, directions[i])) for i, (b, k) in enumerate(zip(of, used, strict=True))]
    sizes = [(b, *map(float, np.abs(directions[[i for i, o in enumerate(of) if o == b]]).mean(axis=0))) for b in kept]
    return MultiblockMap(standard.select(F.col("_id").alias(id), *(c.alias(k) for k, c in zip(names, scores, strict=True))), spark.createDataFrame(variables, f"block string, variable string, {schema}"), spark.createDataFrame(sizes, f"block string, {schema}"), tuple(map(float, values)))


def register_pupil_curves(df: DataFrame, id: str, time: str, pupil: str, method: str = "elastic", points: int = 101, least: int = 3) -> DataFrame:
    """id, ``raw`` and ``registered`` (arrays over an even grid of the curve's own span), peak_position and phase_shift of every curve with least samples.

    Curves are interpolated at the grid by an as-of join, so they may be of any length. The shift is that of the peak (the first largest value) to the median peak; registered values are read
    from the curve at the shifted places (``shift``), or at places shifted most in the middle and not at the ends (``elastic``). Of samples at one time the
    largest counts; samples without an id, a finite time or value take no part."""
    if method not in ("elastic", "shift"):
        raise ValueError(f"unknown method: {method}")
    known = Table(df.select(F.col(id).alias("_id"), finite(time).alias("_t"), finite(pupil).alias("_p")).dropna(), "curves").df
    spans = known.groupBy("_id").agg(F.count("*").alias("_n"), F.min("_t").alias("_a"), F.greatest(F.max("_t") - F.min("_t"), F.lit(1e-12)).alias("_span")).filter(F.col("_n") >= least)
    even = known.join(spans, "_id").select("_id", ((F.col("_t") - F.col("_a")) / F.col("_span")).alias("_u"), "_p")
    grid = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k / (points - 1))).alias("_k", "_g")
    asked = spans.select("_id", grid)
    met = bracketed(asked, even, ["_id"], "_g", "_u", ["_p"])
    a, b = F.col("previous"), F.col("following")
    share = (F.col("_g") - a["t"]) / (b["t"] - a["t"])
    # the last grid point may miss the last sample by a rounding error
    value = F.when(a.isNull(), b["_p"]).when(b.isNull() | (a["t"] == F.col("_g")), a["_p"]).otherwise(a["_p"] + share * (b["_p"] - a["_p"]))
    curves = met.select("_id", "_k", value.alias("_v")).groupBy("_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda r: r["_v"]).alias("raw"))
    peaked = Table(curves.withColumn("peak_position", (F.array_position("raw", F.array_max("raw")) - 1) / (points - 1)), "curves-raw").df
    shifted = peaked.crossJoin(F.broadcast(peaked.agg(F.median("peak_position").alias("_m")))).withColumn("phase_shift", F.col("_m") - F.col("peak_position"))
    place = lambda g: F.least(F.greatest(g - F.col("phase_shift") * (1.0 if method == "shift" else 0.75 * 4 * g * (1 - g)), F.lit(0.0)), F.lit(1.0)) * (points - 1)

    def read(k: Column) -> Column:
        x = place(k / (points - 1))
        low = F.least(F.floor(x), F.lit(points - 2)).cast("int")
        return F.get("raw", low) + (x - low) * (F.get("raw", low + 1) - F.get("raw", low))

    registered = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), read)
    return shifted.select(F.col("_id").alias(id), "raw", registered.alias("registered"), "peak_position", "phase_shift")


def decompose_pupil_phase_amplitude(curves: DataFrame, id: str, components: int = 3, points: int = 101) -> tuple[DataFrame, list[float]]:
    """id, phase_shift, peak_position and amplitude_pc1, ... (scores of the registered curves about their mean), and each axis's share of the variance. Fewer than two curves raise an error."""
    import numpy as np

    table = Table(curves.select(id, "registered", "phase_shift", "peak_position"), "amplitude").df
    means = {r["k"]: r["m"] for r in table.select(F.posexplode("registered").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect()}
    centre = F.array(*(F.lit(means.get(k, 0.0)) for k in range(points)))
    centred = table.withColumn("z", F.zip_with("registered", centre, lambda a, b: a - b))
    n, matrix = cross_products(centred, "z", points)
    if n < 2:
        raise ValueError("at least two curves are required")
    values, directions = axes(matrix, min(points, n))
    shares = (values**2 / max(float(np.trace(matrix)), 1e-12)).tolist()
    scores = projected("z", directions[:, : min(components, points, n)])
    return centred.select(id, "phase_shift", "peak_position", *(c.alias(f"amplitude_pc{k + 1}") for k, c in enumerate(scores))), shares


def compare_phases(curves: DataFrame, groups: DataFrame, id: str, group: str) -> DataFrame:
    """A row a group: number of curves, and mean and deviation of their phase shifts; curves without a group are a group."""
    met = joined_null_safe(curves.select(id, "phase_shift"), groups.select(id, group).distinct(), [id], "left")
    return met.groupBy(group).agg(F.count("*").alias("n"), F.avg("phase_shift").alias("mean_shift"), F.stddev_samp("phase_shift").alias("sd_shift"))
