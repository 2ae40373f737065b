"""Comparison and dynamics of scanpaths: distances, recurrence, change points."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import anyof, entropy, finite, ordered, ratio, run_id
from ..functions.groups import by_group
from ..functions.ranks import totalled


def levenshtein_tokens(a: Sequence, b: Sequence) -> int:
    """Edit distance of two lists of tokens, a null being unlike all; a column of the table at a time, its steps as bits of integers (Hyyrö)."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    at: dict = {}
    for k, token in enumerate(a):
        if token is not None:
            at[token] = at.get(token, 0) | 1 << k
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    more, less = full, 0
    for token in b:
        same = at.get(token, 0)
        diagonal = ((((same & more) + more) ^ more) | same | less) & full
        right, left = less | full & ~(diagonal | more), diagonal & more
        distance += bool(right & last) - bool(left & last)
        right = right << 1 | 1
        more, less = (left << 1 | ~(diagonal | right)) & full, right & diagonal
    return distance


def levenshtein_scanpath(pairs: DataFrame, a: str, b: str, normalize: bool = True) -> DataFrame:
    """levenshtein_tokens of pairs of arrays, as an Arrow function over rows; null where an array is."""
    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else float(levenshtein_tokens(i, j)) for i, j in zip(x, y, strict=True)], dtype="float64")

    longest = F.greatest(F.size(a), F.size(b))
    return pairs.withColumn("levenshtein", distance(a, b)).withColumn("levenshtein", F.when(longest == 0, 0.0).otherwise(F.col("levenshtein") / longest) if normalize else F.col("levenshtein"))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))


def ngram_jaccard_similarity(pairs: DataFrame, a: str, b: str, n: int = 2) -> DataFrame:
    """Share of distinct n-grams that both sequences have; one when neither has any."""
    x, y = ngrams(F.col(a), n), ngrams(F.col(b), n)
    union = F.size(F.array_union(x, y))
    return pairs.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union))


def transition_js_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jensen-Shannon distance (base 2) of two tables of transition counts (from_aoi, to_aoi, n): one row."""
    shares = [totalled(d.select("from_aoi", "to_aoi", "n"), _all=F.sum("n")).select("from_aoi", "to_aoi", ratio("n", "_all").alias(name)) for name, d in (("p", left), ("q", right))]
    both = shares[0].join(shares[1], ["from_aoi", "to_aoi"], "full").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((part("p") + part("q")) / 2))).alias("js_distance"))


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping of two paths (rows of coordinates) over the sum of their lengths; a row of the table at a time."""
    if not len(a) or not len(b):
        return float("nan")
    before = np.full(len(b) + 1, np.inf)
    before[0] = 0
    for point in a:
        cost = np.sqrt(((b - point) ** 2).sum(axis=1))
        now = np.full(len(b) + 1, np.inf)
        for j in range(1, len(b) + 1):
            now[j] = cost[j - 1] + min(before[j], before[j - 1], now[j - 1])
        before = now
    return float(before[-1]) / (len(a) + len(b))


def dynamic_time_warping_distance(pairs: DataFrame, ax: str, ay: str, bx: str, by: str) -> DataFrame:
    """dtw of pairs of paths in arrays, as an Arrow function over rows."""
    @F.pandas_udf("double")
    def distance(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.column_stack([a, b]), np.column_stack([c, d])) for a, b, c, d in zip(x0, y0, x1, y1, strict=True)])

    return pairs.withColumn("dtw", distance(ax, ay, bx, by))


def path_pairs(paths: DataFrame, group: Sequence[str], key: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of paths of one group (a stimulus); a group is the paths that are to be compared with each other."""
    a = paths.select(*group, F.col(key).alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = paths.select(*group, F.col(key).alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b, list(group)).filter("a < b")


def representative_scanpath(distances: DataFrame, group: Sequence[str], distance: str = "distance") -> DataFrame:
    """The medoid of each group: the path with the smallest mean distance to the others."""
    both = distances.select(*group, F.col("a").alias("path"), distance).unionByName(distances.select(*group, F.col("b").alias("path"), distance))
    means = both.groupBy(*group, "path").agg(F.avg(distance).alias("mean_distance"))
    return means.groupBy(*group).agg(F.min_by("path", F.struct("mean_distance", "path")).alias("medoid"), F.min("mean_distance").alias("mean_distance"))


def scanpath_dispersion(distances: DataFrame, group: Sequence[str], distance: str = "distance") -> DataFrame:
    both = distances.select(*group, F.col("a").alias("path"), distance).unionByName(distances.select(*group, F.col("b").alias("path"), distance))
    return both.groupBy(*group, "path").agg(F.avg(distance).alias("dispersion"))


def recurrence_points(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs (i, j), i < j, of a group's points within the radius. Points meet in grid cells of that size, so that only near ones are paired."""
    w = ordered(by, order)
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y"), F.row_number().over(w).alias("i")).filter("x is not null and y is not null")
    cells = rows.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    sent = cells.withColumn("d", around).select(*by, F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    # hypot rounds otherwise than the root of the sum, which matters for points that lie just the radius apart
    return cells.join(sent, [*by, "cx", "cy"]).filter((F.col("i") < F.col("j")) & (F.sqrt(dx * dx + dy * dy) <= radius)).select(*by, "i", "j")


def aoi_recurrence_counts(df: DataFrame, by: Sequence[str], aoi: str) -> DataFrame:
    """Recurrence rate of AOI sequences from counts alone: equal pairs are sums of n(n-1)/2, without making a pair."""
    counts = df.filter(F.col(aoi).isNotNull()).groupBy(*by, aoi).agg(F.count("*").alias("k"))
    pairs = F.sum(F.col("k") * (F.col("k") - 1) / 2)
    n = F.sum("k")
    return counts.groupBy(*by).agg(n.alias("n"), pairs.alias("recurrent_pairs"), ratio(pairs, n * (n - 1) / 2).alias("recurrence_rate"))


def recurrence_features(points: DataFrame, sizes: DataFrame, by: Sequence[str], minimum_line: int = 2) -> DataFrame:
    """Rate, determinism, laminarity, trapping time and diagonal entropy of recurrence points; sizes: by and n."""
    diagonal = points.withColumn("k", F.col("j") - F.col("i"))
    w = Window.partitionBy(*by, "k").orderBy("i")
    runs = diagonal.withColumn("_run", run_id(F.lag("i").over(w).isNull() | (F.col("i") - F.lag("i").over(w) != 1), w))
    lines = runs.groupBy(*by, "k", "_run").agg(F.count("*").alias("len"))
    v = Window.partitionBy(*by, "i").orderBy("j")
    falls = points.withColumn("_run", run_id(F.lag("j").over(v).isNull() | (F.col("j") - F.lag("j").over(v) != 1), v))
    columns = falls.groupBy(*by, "i", "_run").agg(F.count("*").alias("len"))
    long = F.col("len") >= minimum_line
    det = lines.groupBy(*by).agg(F.sum("len").alias("points"), F.sum(F.when(long, F.col("len"))).alias("in_lines"))
    lam = columns.groupBy(*by).agg(F.sum(F.when(long, F.col("len"))).alias("in_columns"), F.avg(F.when(long, F.col("len"))).alias("trapping_time"))
    kinds = lines.filter(long).groupBy(*by, "len").agg(F.count("*").alias("c"))
    ent = kinds.withColumn("p", ratio("c", F.sum("c").over(Window.partitionBy(*by)))).groupBy(*by).agg(entropy("p", 2.718281828459045).alias("diagonal_entropy"))
    out = sizes.join(det, list(by), "left").join(lam, list(by), "left").join(ent, list(by), "left")
    some = F.coalesce(F.col("points"), F.lit(0))
    return out.select(*by, "n", ratio(some, F.col("n") * (F.col("n") - 1) / 2).alias("recurrence_rate"), F.coalesce(ratio("in_lines", "points"), F.lit(0.0)).alias("determinism"), F.coalesce(ratio("in_columns", "points"), F.lit(0.0)).alias("laminarity"), F.coalesce("trapping_time", F.lit(0.0)).alias("trapping_time"), F.coalesce("diagonal_entropy", F.lit(0.0)).alias("diagonal_entropy"))


def change_scores(df: DataFrame, order: str, by: Sequence[str], channels: Sequence[str], window: int = 10) -> DataFrame:
    """Norm of the difference between the means after and before each row, over channels scaled to unit deviation."""
    group, w = Window.partitionBy(*by), ordered(by, order)
    parts = []
    for c in channels:
        sd = F.stddev_pop(finite(c)).over(group)
        z = ratio(finite(c) - F.avg(finite(c)).over(group), F.nullif(sd, F.lit(0.0)))
        parts.append(z)
    scaled = df.withColumns({f"_z{k}": F.coalesce(z, F.lit(0.0)) for k, z in enumerate(parts)})
    pre, post = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    jumps = [F.avg(f"_z{k}").over(post) - F.avg(f"_z{k}").over(pre) for k in range(len(parts))]
    full = (F.count(F.lit(1)).over(pre) == window) & (F.count(F.lit(1)).over(post) == window)
    score = F.sqrt(sum((F.pow(j, 2) for j in jumps), F.lit(0.0)))
    return scaled.withColumn("change_score", F.when(full, score)).drop(*(f"_z{k}" for k in range(len(parts))))


def detect_process_changepoints(df: DataFrame, order: str, by: Sequence[str], channels: Sequence[str], window: int = 10, quantile: float = 0.9, min_segment: int = 5) -> DataFrame:
    """Rows whose change score is in the group's upper quantile, picked by falling score at least min_segment apart."""
    scored = change_scores(df, order, by, channels, window).withColumn("_i", F.row_number().over(ordered(by, order)))
    limit = F.percentile("change_score", F.lit(quantile)).over(Window.partitionBy(*by))
    candidates = scored.withColumn("_limit", limit).filter((F.col("change_score") >= F.col("_limit")) & (F.col("change_score") > 0)).select(*by, F.col("_i").alias("position"), "change_score")

    # candidates that are min_segment or more apart never bear on each other, so that runs of nearer ones are picked by themselves
    near = ordered(by, "position")
    apart = F.coalesce(F.col("position") - F.lag("position").over(near) >= min_segment, F.lit(True))
    runs = candidates.withColumn("_run", run_id(apart, near))

    def pick(rows: list[tuple]) -> list[tuple]:
        chosen: list[int] = []
        kept = []
        for p, score in rows:
            at = bisect.bisect_left(chosen, p)
            if not ((at < len(chosen) and chosen[at] - p < min_segment) or (at and p - chosen[at - 1] < min_segment)):
                chosen.insert(at, p)
                kept.append((p, score))
        return sorted(kept)

    # the windows have brought a group's rows together, and a task goes through all of its runs, which are many and short
    placed = runs.select(*by, "_run", "position", "change_score").sortWithinPartitions(*by, "_run", F.desc("change_score"), "position")
    kinds = "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by)
    return by_group(placed, [*by, "_run"], pick, kinds + "_run long, position int, change_score double").drop("_run")


def gaze_grid_counts(df: DataFrame, by: Sequence[str], x: str, y: str, size: int = 20) -> DataFrame:
    """Points in each occupied cell of an equal-width grid over the group's range."""
    group = Window.partitionBy(*by)
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).filter("x is not null and y is not null")

    def cell(c: str) -> Column:
        lo, hi = F.min(c).over(group), F.max(c).over(group)
        return F.least(F.lit(size - 1), F.floor(F.coalesce(ratio((F.col(c) - lo) * size, hi - lo), F.lit(0.0)))).cast("long")

    return rows.withColumns({"cell_x": cell("x"), "cell_y": cell("y")}).groupBy(*by, "cell_x", "cell_y").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def scanpath_metric_ranks(metrics: DataFrame, key: Sequence[str], higher: Sequence[str]) -> DataFrame:
    """Rank of each candidate for each metric (metric, candidate, value); ties take the smallest rank."""
    up = anyof([F.col("metric") == m for m in higher])
    signed = F.when(up, -F.col("value")).otherwise(F.col("value"))
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy(*key, "metric").orderBy(signed)))


def compute_spatial_error_field(df: DataFrame, x: str, y: str, target_x: str, target_y: str, minimum: int = 3) -> DataFrame:
    """Mean bias at each target."""
    rows = df.select(target_x, target_y, (finite(x) - finite(target_x)).alias("dx"), (finite(y) - finite(target_y)).alias("dy")).filter("dx is not null and dy is not null")
    return rows.groupBy(target_x, target_y).agg(F.count("*").alias("n"), F.avg("dx").alias("bias_x"), F.avg("dy").alias("bias_y")).filter(F.col("n") >= minimum)


#: Most calibration targets that go to every row as one array.
MOST_TARGETS = 2_000


def correct_gaze_with_spatial_error(df: DataFrame, field: DataFrame, x: str, y: str, key: Sequence[str], target_x: str, target_y: str, power: float = 2.0, strength: float = 1.0) -> DataFrame:
    """Gaze less the inverse-distance-weighted bias of the calibration targets, which are one array of at most MOST_TARGETS; all is computed in the row."""
    targets = field.agg(F.sort_array(F.collect_list(F.struct(F.col(target_x).alias("tx"), F.col(target_y).alias("ty"), "bias_x", "bias_y"))).alias("_targets"))
    n = targets.select(F.size("_targets")).first()[0]
    if n > MOST_TARGETS:
        raise ValidationError(f"{n} targets; at most {MOST_TARGETS} correct a row")
    a, b = finite(x), finite(y)
    weigh = lambda t: 1 / F.pow(F.greatest(F.hypot(F.col("_x") - t["tx"], F.col("_y") - t["ty"]), F.lit(1e-9)), F.lit(power))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda acc, t: F.struct((acc["w"] + t["w"]).alias("w"), (acc["x"] + t["w"] * t["bias_x"]).alias("x"), (acc["y"] + t["w"] * t["bias_y"]).alias("y"))
    spot = df.withColumns({"_x": a, "_y": b}).crossJoin(F.broadcast(targets))
    weighed = spot.withColumn("_w", F.transform("_targets", lambda t: F.struct(weigh(t).alias("w"), t["bias_x"].alias("bias_x"), t["bias_y"].alias("bias_y"))))
    summed = weighed.withColumn("_s", F.aggregate("_w", zero, add))
    bias = lambda c: F.coalesce(ratio(F.col(f"_s.{c}"), F.col("_s.w")), F.lit(0.0))
    return summed.withColumns({f"{x}_corrected": F.col("_x") - strength * bias("x"), f"{y}_corrected": F.col("_y") - strength * bias("y")}).drop("_x", "_y", "_targets", "_w", "_s")


def screen_gaze_to_head_vectors(df: DataFrame, x: str, y: str, width_px: float, height_px: float, width_mm: float, height_mm: float, distance_mm: float) -> DataFrame:
    """Unit vectors from the eye to the point on the screen; pixels count from the top left."""
    vx = (finite(x) / width_px - 0.5) * width_mm
    vy = (0.5 - finite(y) / height_px) * height_mm
    norm = F.sqrt(vx * vx + vy * vy + distance_mm * distance_mm)
    return df.withColumns({"head_gaze_x": vx / norm, "head_gaze_y": vy / norm, "head_gaze_z": distance_mm / norm})


def transform_head_gaze_to_world(df: DataFrame, vector: Sequence[str] = ("head_gaze_x", "head_gaze_y", "head_gaze_z"), quaternion: Sequence[str] = ("qx", "qy", "qz", "qw")) -> DataFrame:
    """The vector turned by the unit quaternion."""
    a, b, c, w = (F.col(q) for q in quaternion)
    x, y, z = (F.col(v) for v in vector)
    tx, ty, tz = 2 * (b * z - c * y), 2 * (c * x - a * z), 2 * (a * y - b * x)
    return df.withColumns({"world_gaze_x": x + w * tx + b * tz - c * ty, "world_gaze_y": y + w * ty + c * tx - a * tz, "world_gaze_z": z + w * tz + a * ty - b * tx})
