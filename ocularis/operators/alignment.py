"""As-of joins without inequality joins, and what is built on them: head pose at gaze times, rays in the world.

Both tables are laid one over the other and each group's rows are put in order of time, in buckets of equal depth
(``functions.ranks``), so that a recording of any length lies over many tasks. The last point so far is a running maximum
of (time, values), the next one a running minimum from the end, carried over the bounds of the buckets. No pairs are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import bucketed, run_through


def bracketed(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """left with ``previous`` (the last row of right at or before it) and ``following`` (the first after it): structs of t and the values, null where there is none.

    Of rows of right at one time, ``previous`` is that with the largest values in their order, and ``following`` that with the smallest. Null groups are
    a group; rows of right without a finite time take no part, those of left get no partners."""
    columns = left.columns
    point = F.struct(finite(right_time).alias("t"), *(F.col(v) for v in values))
    points = right.select(*(F.col(c).alias(f"_k_{k}") for k, c in enumerate(by)), finite(right_time).alias("_t"), F.lit(0).alias("_side"), point.alias("_point")).filter("_t is not null")
    asked = left.select(*(F.col(c).alias(f"_k_{k}") for k, c in enumerate(by)), finite(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*(F.col(c) for c in columns)).alias("_row"))
    both = points.unionByName(asked.filter("_t is not null"), allowMissingColumns=True)
    keys = [f"_k_{k}" for k in range(len(by))]
    # points come before questions of the same time, so a point at the very time is the previous one
    steps = [{"previous": (F.max, F.col("_point")), "following": (F.min, F.col("_point"), True)}]
    met = run_through(bucketed(both, "_t", keys), ["_t", "_side"], steps, keys).filter("_side = 1")
    untimed = asked.filter("_t is null").select("_row", *(F.lit(None).cast(points.schema["_point"].dataType).alias(c) for c in ("previous", "following")))
    return met.select("_row", "previous", "following").unionByName(untimed).select("_row.*", "previous", "following")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """left with the values of the row of right that is nearest in a direction: backward (at or before), forward (at or after) or nearest (the earlier of two as near).

    ``gap`` is its distance, ``asof_status`` matched, outside_tolerance or unmatched; unless matched the values are null."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    met = bracketed(left, right, by, left_time, right_time, values)
    t, before, after = finite(left_time), F.col("previous"), F.col("following")
    exact = before["t"] == t
    ahead = F.when(exact, before).otherwise(after)
    near = F.when(before.isNull(), after).when(after.isNull(), before).otherwise(F.when(after["t"] - t < t - before["t"], after).otherwise(before))
    chosen = {"backward": before, "forward": ahead, "nearest": near}[direction]
    found = met.withColumn("_chosen", chosen).withColumn("gap", F.abs(F.col("_chosen.t") - t))
    status = F.when(F.col("_chosen").isNull(), "unmatched").when(F.col("gap") > (tolerance if tolerance is not None else float("inf")), "outside_tolerance").otherwise("matched")
    found = found.withColumn("asof_status", status)
    good = F.col("asof_status") == "matched"
    return found.select(*left.columns, *(F.when(good, F.col("_chosen")[v]).alias(v) for v in values), "gap", "asof_status")


def with_slerp(df: DataFrame, a: Sequence[Column], b: Sequence[Column], share: Column, names: Sequence[str]) -> DataFrame:
    """df with the spherical interpolation of two rotations, given as quaternions of any length but zero, along the shorter arc and in the sign of the first.

    Steps are columns of their own, since each is used many times."""
    size = lambda q: F.sqrt(sum((c * c for c in q), F.lit(0.0)))
    n = range(len(names))
    df = df.withColumns({"_sa": size(a), "_sb": size(b)})
    df = df.withColumns({f"_u{k}": a[k] / F.col("_sa") for k in n} | {f"_v{k}": b[k] / F.col("_sb") for k in n})
    df = df.withColumn("_dot", sum((F.col(f"_u{k}") * F.col(f"_v{k}") for k in n), F.lit(0.0)))
    df = df.withColumn("_angle", F.acos(F.least(F.abs("_dot"), F.lit(1.0))))
    angle, near = F.col("_angle"), F.col("_angle") < 1e-7
    first = F.when(near, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
    second = F.when(near, share).otherwise(F.sin(share * angle) / F.sin(angle)) * F.when(F.col("_dot") < 0, -1.0).otherwise(1.0)
    df = df.withColumns({"_f": first, "_g": second})
    turned = {c: F.col("_f") * F.col(f"_u{k}") + F.col("_g") * F.col(f"_v{k}") for k, c in enumerate(names)}
    return df.withColumns(turned).drop("_sa", "_sb", "_dot", "_angle", "_f", "_g", *(f"_{x}{k}" for x in "uv" for k in n))


def align_head_pose_to_gaze(gaze: DataFrame, pose: DataFrame, by: Sequence[str], gaze_time: str = "timestamp", pose_time: str = "timestamp", quaternion: Sequence[str] = ("qx", "qy", "qz", "qw"), position: Sequence[str] = ("px", "py", "pz"), longest_gap: float | None = None) -> DataFrame:
    """gaze with the pose at its times: rotation along the arc and position along the line between the poses about it, never beyond the first or last.

    ``pose_status``: aligned; outside (before the first or after the last pose, or no time); gap (the poses about it are more than longest_gap apart). Poses with a null,
    non-finite or zero rotation or position are left out. Quaternions and positions of rows that aren't aligned are null."""
    names = [*quaternion, *position]
    length = sum((finite(c) * finite(c) for c in quaternion), F.lit(0.0))
    whole = pose.select(*by, pose_time, *(finite(c).alias(c) for c in names)).dropna(subset=names).filter(length > 1e-300)
    met = bracketed(gaze.drop(*names), whole, by, gaze_time, pose_time, names)
    t, a, b = finite(gaze_time), F.col("previous"), F.col("following")
    exact = a["t"] == t
    apart = b["t"] - a["t"]
    inside = exact | b.isNotNull() & a.isNotNull()
    status = F.when(~F.coalesce(inside, F.lit(False)), "outside").when(F.coalesce(~exact & (apart > (longest_gap if longest_gap is not None else float("inf"))), F.lit(False)), "gap").otherwise("aligned")
    met = met.withColumn("pose_status", status).withColumn("_share", F.when(exact, 0.0).otherwise((t - a["t"]) / apart)).withColumn("_next", F.when(exact, a).otherwise(b))
    n, share = F.col("_next"), F.col("_share")
    good = F.col("pose_status") == "aligned"
    met = with_slerp(met, [a[c] for c in quaternion], [n[c] for c in quaternion], share, [f"_q{k}" for k in range(4)])
    turned = [F.col(f"_q{k}") for k in range(4)]
    moved = [a[c] + share * (n[c] - a[c]) for c in position]
    kept = [c for c in gaze.columns if c not in names]
    return met.select(*kept, *(F.when(good, v).alias(c) for c, v in zip(names, [*turned, *moved], strict=True)), "pose_status")


def rotated(vector: Sequence[Column], quaternion: Sequence[Column]) -> list[Column]:
    """A vector turned by a rotation, whose quaternion (x, y, z, w) may have any length but zero."""
    size = F.sqrt(sum((c * c for c in quaternion), F.lit(0.0)))
    x, y, z, w = (c / size for c in quaternion)
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    t = [2 * c for c in cross([x, y, z], vector)]
    back = cross([x, y, z], t)
    return [v + w * s + u for v, s, u in zip(vector, t, back, strict=True)]


def transform_head_gaze_to_world(df: DataFrame, vector: Sequence[str] = ("head_gaze_x", "head_gaze_y", "head_gaze_z"), quaternion: Sequence[str] = ("qx", "qy", "qz", "qw"), position: Sequence[str] = ("px", "py", "pz")) -> DataFrame:
    """df with a ray: direction ``world_gaze_*`` of the head's gaze turned by its pose, and ``world_origin_*``; null where any part is missing."""
    turned = rotated([finite(c) for c in vector], [finite(c) for c in quaternion])
    whole = F.lit(True)
    for c in (*vector, *quaternion, *position):
        whole = whole & finite(c).isNotNull()
    rays = {f"world_gaze_{a}": F.when(whole, v) for a, v in zip("xyz", turned, strict=True)} | {f"world_origin_{a}": F.when(whole, finite(c)) for a, c in zip("xyz", position, strict=True)}
    return df.withColumns(rays)
