"""Signals to events: filters, velocity, fixations, saccades, pursuits, microsaccades, blinks, and matching of catalogues.

Samples are rows with the columns of ``by`` (recording, and trial or eye where there is one), a time in
seconds and coordinates. Every window uses the same partitioning, so one exchange serves a chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import anyof, changed, count_if, finite, gradient, mad, ordered, ratio, run_id
from ..functions.groups import by_group


def rolling(x: str | Column, w, width: int = 5, method: str = "mean") -> Column:
    """Centred window of an odd width (an even one is rounded up), shorter at the ends, without what isn't finite."""
    half = width // 2
    frame = w.rowsBetween(-half, half)
    if not method.endswith("median"):
        return F.avg(finite(x)).over(frame)
    near = F.sort_array(F.collect_list(finite(x)).over(frame))  # width values at most; Spark's median takes no row frame
    n = F.size(near)
    return (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2


def filter_gaze(df: DataFrame, time: str, by: Sequence[str], columns: Sequence[str], method: str = "median", width: int = 5) -> DataFrame:
    if method == "none":
        return df
    w = ordered(by, time)
    return df.withColumns({c: rolling(c, w, width, "median" if method in ("median", "moving_median") else "mean") for c in columns})


def filter_pupil(df: DataFrame, time: str, by: Sequence[str], pupil: str = "pupil_diameter", method: str = "median", width: int = 5) -> DataFrame:
    """As filter_gaze, with the input kept as <pupil>_raw."""
    return filter_gaze(df.withColumn(f"{pupil}_raw", F.col(pupil)), time, by, [pupil], method, width)


def gaze_velocity(df: DataFrame, time: str, by: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """dx, dy, distance, dt and velocity from the row before in time."""
    w = ordered(by, time)
    dx = finite(x) - F.lag(finite(x)).over(w)
    dy = finite(y) - F.lag(finite(y)).over(w) if y else F.lit(0.0)
    dt = finite(time) - F.lag(finite(time)).over(w)
    with_steps = df.withColumns({"dx": dx, "dy": dy, "dt": dt})
    return with_steps.withColumn("distance", F.hypot("dx", "dy")).withColumn("velocity", F.when(F.col("dt") > 0, ratio("distance", "dt")))


def flag_gaze_outliers(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, method: str = "mad", threshold: float = 6.0, max_velocity: float | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Column outlier: far from the median in deviations, faster than a limit, or outside (x0, y0, x1, y1)."""
    group = Window.partitionBy(*by)
    if method == "mad":
        fixed = df.withColumns({"_x": finite(x), "_y": finite(y)})
        far = [F.abs(F.col(c) - F.median(c).over(group)) > threshold * F.nullif(mad(c, by), F.lit(0.0)) for c in ("_x", "_y")]
        flagged = fixed.withColumn("outlier", F.coalesce(anyof([F.coalesce(f, F.lit(False)) for f in far]), F.lit(False)))
        return flagged.drop("_x", "_y")
    if method == "velocity":
        return gaze_velocity(df, time, by, x, y).withColumn("outlier", F.coalesce(F.col("velocity") > (max_velocity or threshold), F.lit(False))).drop("dx", "dy", "dt", "distance", "velocity")
    x0, y0, x1, y1 = bounds or (0.0, 0.0, 1.0, 1.0)
    return df.withColumn("outlier", F.coalesce(~(finite(x).between(x0, x1) & finite(y).between(y0, y1)), F.lit(False)))


def interpolate_pupil(df: DataFrame, time: str, by: Sequence[str], pupil: str = "pupil_diameter", method: str = "linear", max_gap: float = 0.15, mark: str | None = "pupil_interpolated") -> DataFrame:
    """Fills inner gaps of at most max_gap seconds: on the line between the neighbours, or with the value before."""
    if method == "none":
        return df
    w = ordered(by, time)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    y, t = finite(pupil), finite(time)
    known_t = F.when(y.isNotNull(), t)
    sides = df.withColumns({"_y": y, "_y0": F.last(y, True).over(before), "_t0": F.last(known_t, True).over(before), "_y1": F.first(y, True).over(after), "_t1": F.first(known_t, True).over(after)})
    short = (F.col("_t1") - F.col("_t0") <= max_gap) & F.col("_y").isNull()
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * ratio(t - F.col("_t0"), F.col("_t1") - F.col("_t0"))
    filled = sides.withColumn("_fill", F.when(short, line if method == "linear" else F.col("_y0")))
    out = filled.withColumn(pupil, F.coalesce("_y", "_fill"))
    if mark:
        out = out.withColumn(mark, F.col("_y").isNull() & F.col("_fill").isNotNull())
    return out.drop("_y", "_y0", "_t0", "_y1", "_t1", "_fill")


def baseline_pupil(df: DataFrame, time: str, by: Sequence[str], pupil: str = "pupil_diameter", window: tuple[float, float] = (-0.2, 0.0), anchor: str | Column | None = None, method: str = "subtract", minimum_samples: int = 3, out: str | None = None) -> DataFrame:
    """Pupil relative to its mean in a closed window about the anchor (the group's first time by default)."""
    group = Window.partitionBy(*by)
    t, y = finite(time), finite(pupil)
    zero = F.min(t).over(group) if anchor is None else finite(anchor)
    inside = F.when((t - zero).between(*window), y)
    base = df.withColumns({"_m": F.avg(inside).over(group), "_s": F.stddev_samp(inside).over(group), "_n": F.count(inside).over(group)})
    m = F.when(F.col("_n") >= minimum_samples, F.col("_m"))
    forms = {"subtract": y - m, "divide": ratio(y, m), "percent": 100 * ratio(y - m, m), "zscore": ratio(y - m, F.col("_s")), "none": y}
    return base.withColumn(out or f"{pupil}_baselined", forms[method]).drop("_m", "_s", "_n")


def pupil_deconvolve(df: DataFrame, time: str, by: Sequence[str], pupil: str = "pupil_diameter", tau: float = 0.9, out: str = "pupil_phasic") -> DataFrame:
    """First-order innovation: the step plus what decay took since the sample before; gaps take the median."""
    w, group = ordered(by, time), Window.partitionBy(*by)
    y = F.coalesce(finite(pupil), F.median(finite(pupil)).over(group))
    steps = df.withColumns({"_y": y, "_dt": finite(time) - F.lag(finite(time)).over(w)})
    decay = 1 - F.exp(-F.median(F.when(F.col("_dt") > 0, F.col("_dt"))).over(group) / tau)
    before = F.lag("_y").over(w)
    return steps.withColumn(out, F.coalesce(F.col("_y") - before + decay * before, F.lit(0.0))).drop("_y", "_dt")


def _runs(df: DataFrame, label: Column, time: str, by: Sequence[str], max_gap: float | None = None) -> DataFrame:
    """df with _label and _run: a run ends where the label changes or a step is longer than max_gap."""
    w = ordered(by, time)
    marked = df.withColumn("_label", label)
    starts = changed("_label", w)
    if max_gap is not None:
        starts = starts | F.coalesce(finite(time) - F.lag(finite(time)).over(w) > max_gap, F.lit(False))
    return marked.withColumn("_run", run_id(starts, w))


def detect_blinks(df: DataFrame, time: str, by: Sequence[str], missing: Column, minimum: float = 0.05, maximum: float = 1.0) -> DataFrame:
    """Runs of missing samples whose duration is within limits."""
    runs = _runs(df, F.coalesce(missing, F.lit(True)), time, by).filter("_label")
    found = runs.groupBy(*by, "_run").agg(F.min(finite(time)).alias("start_time"), F.max(finite(time)).alias("end_time"), F.count("*").alias("n_samples"))
    lasting = found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000)
    return lasting.filter(F.col("duration_ms").between(minimum * 1000, maximum * 1000)).drop("_run").withColumn("episode_type", F.lit("blink"))


def _classified(df: DataFrame, time: str, by: Sequence[str], x: str, y: str | None, valid: Column | None) -> DataFrame:
    moved = gaze_velocity(df, time, by, x, y)
    good = finite(x).isNotNull() & (finite(y).isNotNull() if y else F.lit(True))
    return moved.withColumn("_good", good & (F.coalesce(valid, F.lit(True)) if valid is not None else F.lit(True)))


def detect_fixations_ivt(df: DataFrame, time: str, by: Sequence[str], x: str, y: str | None = None, threshold: float = 30.0, minimum: float = 0.06, max_gap: float = 0.075, valid: Column | None = None) -> DataFrame:
    """Runs of valid samples no faster than the threshold; a group's first sample is what its second is."""
    w = ordered(by, time)
    moved = _classified(df, time, by, x, y, valid)
    slow = F.coalesce(F.col("velocity") <= threshold, F.lit(False)) & F.col("_good")
    first = F.lag(F.lit(1)).over(w).isNull()
    marked = moved.withColumn("_slow", slow)
    label = F.when(first, F.coalesce(F.lead("_slow").over(w), F.lit(False)) & F.col("_good")).otherwise(F.col("_slow"))
    runs = _runs(marked, label, time, by, max_gap).filter("_label")
    spread = (F.max(finite(x)) - F.min(finite(x))) + ((F.max(finite(y)) - F.min(finite(y))) if y else F.lit(0.0))
    found = runs.groupBy(*by, "_run").agg(
        F.min(finite(time)).alias("start_time"),
        F.max(finite(time)).alias("end_time"),
        F.count("*").alias("n_samples"),
        F.avg(finite(x)).alias("centroid_x"),
        *([F.avg(finite(y)).alias("centroid_y")] if y else []),
        spread.alias("dispersion"),
        F.max("velocity").alias("peak_velocity"),
    )
    lasting = found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000)
    return lasting.filter(F.col("duration_ms") >= minimum * 1000).drop("_run").withColumn("episode_type", F.lit("fixation"))


def detect_saccades(df: DataFrame, time: str, by: Sequence[str], x: str, y: str | None = None, threshold: float = 30.0, minimum: float = 0.01, valid: Column | None = None) -> DataFrame:
    """Runs faster than the threshold, with their amplitude from first to last sample."""
    moved = _classified(df, time, by, x, y, valid)
    runs = _runs(moved, F.coalesce(F.col("velocity") > threshold, F.lit(False)) & F.col("_good"), time, by).filter("_label")
    t = finite(time)
    ends = [(F.min_by(finite(c), t), F.max_by(finite(c), t)) for c in (x, y) if c]
    apart = F.hypot(ends[0][1] - ends[0][0], ends[1][1] - ends[1][0] if y else F.lit(0.0))
    found = runs.groupBy(*by, "_run").agg(F.min(t).alias("start_time"), F.max(t).alias("end_time"), F.count("*").alias("n_samples"), apart.alias("amplitude"), F.max("velocity").alias("peak_velocity"))
    lasting = found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000)
    return lasting.filter(F.col("duration_ms") >= minimum * 1000).drop("_run").withColumn("episode_type", F.lit("saccade"))


def detect_fixations_adaptive(df: DataFrame, time: str, by: Sequence[str], x: str, y: str | None = None, minimum_velocity: float = 30.0, k: float = 6.0, minimum: float = 0.06, max_gap: float = 0.075) -> DataFrame:
    """As detect_fixations_ivt, with a threshold of its own for each group: max(minimum, median + k deviations)."""
    moved = gaze_velocity(df, time, by, x, y)
    group = Window.partitionBy(*by)
    limit = F.greatest(F.lit(minimum_velocity), F.median("velocity").over(group) + k * F.coalesce(mad("velocity", by), F.lit(0.0)))
    scaled = moved.withColumn("_limit", limit).withColumn("_ok", F.col("velocity") <= F.col("_limit"))
    w = ordered(by, time)
    label = F.when(F.lag(F.lit(1)).over(w).isNull(), F.coalesce(F.lead("_ok").over(w), F.lit(False))).otherwise(F.coalesce("_ok", F.lit(False)))
    runs = _runs(scaled, label & finite(x).isNotNull(), time, by, max_gap).filter("_label")
    found = runs.groupBy(*by, "_run").agg(F.min(finite(time)).alias("start_time"), F.max(finite(time)).alias("end_time"), F.count("*").alias("n_samples"), F.avg(finite(x)).alias("centroid_x"), F.max("_limit").alias("threshold"))
    lasting = found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000)
    return lasting.filter(F.col("duration_ms") >= minimum * 1000).drop("_run").withColumn("episode_type", F.lit("fixation"))


def detect_fixations_idt(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, dispersion: float = 1.0, minimum: float = 0.1) -> DataFrame:
    """Greedy windows whose spread, (max x - min x) + (max y - min y), stays within the limit.

    No window crosses a step that is larger than the limit, so recordings are cut there, and pieces too short for a fixation are dropped.
    The state runs through a piece; a task goes through all of its pieces, which are many and short, in one Arrow function."""
    schema = "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by) + "_piece long, start_time double, end_time double, n_samples long, centroid_x double, centroid_y double, dispersion double"
    kept = df.select(*by, finite(time).alias("_t"), finite(x).alias("_x"), finite(y).alias("_y")).filter("_t is not null and _x is not null and _y is not null")

    w = ordered(by, "_t", "_x", "_y")
    wide_step = F.abs(F.col("_x") - F.lag("_x").over(w)) + F.abs(F.col("_y") - F.lag("_y").over(w)) > dispersion
    pieces = kept.withColumn("_piece", run_id(F.coalesce(wide_step, F.lit(True)), w))
    piece = Window.partitionBy(*by, "_piece")
    lasting = pieces.withColumn("_lasts", F.max("_t").over(piece) - F.min("_t").over(piece)).filter(F.col("_lasts") >= minimum).drop("_lasts")

    def detect(rows: list[tuple]) -> list[tuple]:
        found, first = [], 0
        while first < len(rows):
            stop = first
            x0 = x1 = rows[first][1]
            y0 = y1 = rows[first][2]
            spread = 0.0
            while stop + 1 < len(rows):
                _, a, b = rows[stop + 1]
                wide = (max(x1, a) - min(x0, a)) + (max(y1, b) - min(y0, b))
                if wide > dispersion:
                    break
                x0, x1, y0, y1, spread, stop = min(x0, a), max(x1, a), min(y0, b), max(y1, b), wide, stop + 1
            if (rows[stop][0] - rows[first][0]) * 1000 >= minimum * 1000:
                part = rows[first : stop + 1]
                found.append((rows[first][0], rows[stop][0], len(part), sum(r[1] for r in part) / len(part), sum(r[2] for r in part) / len(part), spread))
                first = stop + 1
            else:
                first += 1
        return found

    # the windows have brought a group's rows together
    pieces = lasting.select(*by, "_piece", "_t", "_x", "_y").sortWithinPartitions(*by, "_piece", "_t", "_x", "_y")
    return by_group(pieces, [*by, "_piece"], detect, schema).drop("_piece").withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000).withColumn("episode_type", F.lit("fixation"))


def detect_events_ivvt(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, fixation: float = 5.0, saccade: float = 30.0, minimum: float = 0.0) -> DataFrame:
    """Fixation, pursuit and saccade runs by two speed limits, from central differences."""
    w = ordered(by, time)
    t = finite(time)
    speed = F.hypot(gradient(finite(x), t, w), gradient(finite(y), t, w))
    label = F.when(F.col("speed").isNull(), "missing").when(F.col("speed") <= fixation, "fixation").when(F.col("speed") >= saccade, "saccade").otherwise("pursuit")
    runs = _runs(df.withColumn("speed", speed), label, time, by).filter("_label != 'missing'")
    found = runs.groupBy(*by, "_run", F.col("_label").alias("event_type")).agg(F.min(t).alias("start_time"), F.max(t).alias("end_time"), F.count("*").alias("n_samples"), F.avg("speed").alias("mean_velocity"), F.max("speed").alias("peak_velocity"))
    return found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000).filter(F.col("duration_ms") >= minimum * 1000).drop("_run")


def detect_events_directional(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, slowest: float = 2.0, fastest: float = 30.0, max_turn: float = 0.7853981633974483) -> DataFrame:
    """Samples in pursuit: a speed within limits, and a direction that turns by at most max_turn radians."""
    w = ordered(by, time)
    t = finite(time)
    moved = df.withColumns({"_vx": gradient(finite(x), t, w), "_vy": gradient(finite(y), t, w)}).withColumns({"speed": F.hypot("_vx", "_vy"), "_a": F.atan2("_vy", "_vx")})
    turn = F.col("_a") - F.lag("_a").over(w)
    wrapped = F.abs(F.atan2(F.sin(turn), F.cos(turn)))
    return moved.withColumn("pursuit", F.coalesce(F.col("speed").between(slowest, fastest) & (F.coalesce(wrapped, F.lit(0.0)) <= max_turn), F.lit(False))).drop("_vx", "_vy", "_a")


def compute_pursuit_gain(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, target_x: str, target_y: str) -> DataFrame:
    """Speeds of gaze and target, their ratio, and the velocity error."""
    w = ordered(by, time)
    t = finite(time)
    gaze = F.hypot(gradient(finite(x), t, w), gradient(finite(y), t, w))
    target = F.hypot(gradient(finite(target_x), t, w), gradient(finite(target_y), t, w))
    return df.withColumns({"gaze_speed": gaze, "target_speed": target}).withColumns({"gain": ratio("gaze_speed", "target_speed"), "velocity_error": F.col("gaze_speed") - F.col("target_speed")})


def summarise_events(events: DataFrame, by: Sequence[str] = (), kind: str = "event_type") -> DataFrame:
    """Count, total and mean duration of each kind."""
    return events.groupBy(*by, kind).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms"))


def detect_microsaccades(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, multiple: float = 6.0, minimum: float = 0.006, maximum_amplitude: float = 1.0) -> DataFrame:
    """Runs outside the ellipse of multiple robust deviations of velocity, long enough and small enough."""
    w, group = ordered(by, time), Window.partitionBy(*by)
    t = finite(time)
    moved = df.withColumns({"_vx": gradient(finite(x), t, w), "_vy": gradient(finite(y), t, w)})
    sigma = lambda c: F.sqrt(F.greatest(F.lit(1e-12), F.median(F.col(c) * F.col(c)).over(group) - F.pow(F.median(c).over(group), 2)))
    outside = F.pow(F.col("_vx") / (multiple * sigma("_vx")), 2) + F.pow(F.col("_vy") / (multiple * sigma("_vy")), 2) > 1
    runs = _runs(moved.withColumn("_out", F.coalesce(outside, F.lit(False))), F.col("_out"), time, by).filter("_label")
    apart = F.hypot(F.max_by(finite(x), t) - F.min_by(finite(x), t), F.max_by(finite(y), t) - F.min_by(finite(y), t))
    found = runs.groupBy(*by, "_run").agg(F.min(t).alias("start_time"), F.max(t).alias("end_time"), apart.alias("amplitude"), F.max(F.hypot("_vx", "_vy")).alias("peak_velocity"))
    return found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000).filter((F.col("duration_ms") >= minimum * 1000) & (F.col("amplitude") <= maximum_amplitude)).drop("_run")


@dataclass(frozen=True)
class DetectorSpec:
    """One detector of a multiverse: its id, algorithm and parameters."""

    detector_id: str
    algorithm: str
    parameters: tuple[tuple[str, float], ...] = ()


def run_detector_multiverse(df: DataFrame, specs: Sequence[DetectorSpec], time: str, by: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """The episodes of every detector, tagged with its id; lazily, so that the branches share the scan."""
    run = {"ivt": detect_fixations_ivt, "adaptive_velocity": detect_fixations_adaptive, "saccades": detect_saccades, "idt": detect_fixations_idt}
    out: DataFrame | None = None
    for spec in specs:
        found = run[spec.algorithm](df, time, by, x, y, **dict(spec.parameters)).select(*by, "start_time", "end_time", "n_samples", "duration_ms", "episode_type", F.lit(spec.detector_id).alias("detector_id"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no detectors")
    return out


def summarise_detector_events(events: DataFrame) -> DataFrame:
    fixation = F.col("episode_type") == "fixation"
    long = F.when(fixation, F.col("duration_ms"))
    return events.groupBy("detector_id").agg(F.count("*").alias("n_events"), count_if(fixation).alias("n_fixations"), count_if(F.col("episode_type") == "saccade").alias("n_saccades"), F.avg(long).alias("mean_fixation_ms"), F.median(long).alias("median_fixation_ms"), F.sum(long).alias("total_fixation_ms"))


def event_overlaps(reference: DataFrame, candidate: DataFrame, by: Sequence[str], width: float, minimum_iou: float = 0.0, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Pairs of overlapping events of a group with their intersection over union.

    Both sides are cut into time bins of ``width`` and joined on group and bin; a pair is made in the bin where its overlap begins."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    a = reference.select(*by, F.col(start).alias("a_start"), F.col(end).alias("a_end")).withColumn("bin", bins("a_start", "a_end"))
    b = candidate.select(*by, F.col(start).alias("b_start"), F.col(end).alias("b_end")).withColumn("bin", bins("b_start", "b_end"))
    pairs = a.join(b, [*by, "bin"]).filter((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.floor(F.greatest("a_start", "b_start") / width) == F.col("bin")))
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    union = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    return pairs.drop("bin").withColumn("iou", F.coalesce(ratio(overlap, union), F.lit(1.0))).filter(F.col("iou") >= minimum_iou)


def match_detected_events(reference: DataFrame, candidate: DataFrame, by: Sequence[str], width: float, minimum_iou: float = 0.1, onset_tolerance: float | None = None) -> DataFrame:
    """One-to-one matches, greedily by falling overlap and then by onset difference, within each group."""
    pairs = event_overlaps(reference, candidate, by, width, minimum_iou).withColumn("onset", F.abs(F.col("a_start") - F.col("b_start")))
    if onset_tolerance is not None:
        pairs = pairs.filter(F.col("onset") <= onset_tolerance)

    def greedy(rows: list[tuple]) -> list[tuple]:
        left, right, kept = set(), set(), []
        for row in rows:
            a, b = (row[0], row[1]), (row[2], row[3])
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                kept.append(row)
        return kept

    columns = [*by, "a_start", "a_end", "b_start", "b_end", "iou", "onset"]
    placed = (pairs.repartition(*by) if by else pairs.coalesce(1)).select(*columns).sortWithinPartitions(*by, F.desc("iou"), "onset", "a_start", "b_start", "a_end", "b_end")
    return by_group(placed, by, greedy, ", ".join(f"`{c}` {dict(pairs.dtypes)[c]}" for c in columns))


def compare_event_catalogues(reference: DataFrame, candidate: DataFrame, by: Sequence[str], width: float, minimum_iou: float = 0.1) -> DataFrame:
    """Precision, recall, F1 and boundary errors of a candidate: one row."""
    matched = match_detected_events(reference, candidate, by, width, minimum_iou)
    hits = matched.agg(F.count("*").alias("n_matched"), F.avg("iou").alias("mean_iou"), F.avg(F.col("b_start") - F.col("a_start")).alias("onset_error"), F.avg(F.col("b_end") - F.col("a_end")).alias("offset_error"))
    sizes = reference.agg(F.count("*").alias("n_reference")).crossJoin(candidate.agg(F.count("*").alias("n_candidate")))
    both = hits.crossJoin(F.broadcast(sizes))
    precision, recall = ratio("n_matched", "n_candidate"), ratio("n_matched", "n_reference")
    return both.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def event_confusion_matrix(truth: DataFrame, detected: DataFrame, by: Sequence[str], step: float, start: str = "start_time", end: str = "end_time", kind: str = "event_type", none: str = "none") -> DataFrame:
    """Cross table of labels on a grid of times; a time inside two events of a catalogue is ``overlap``."""

    def labels(events: DataFrame, name: str) -> DataFrame:
        grid = events.select(*by, kind, F.explode(F.sequence(F.ceil(F.col(start) / step), F.floor(F.col(end) / step))).alias("tick"))
        return grid.groupBy(*by, "tick").agg(F.when(F.count("*") > 1, "overlap").otherwise(F.min(kind)).alias(name))

    both = labels(truth.filter(F.ceil(F.col(start) / step) <= F.floor(F.col(end) / step)), "truth").join(labels(detected.filter(F.ceil(F.col(start) / step) <= F.floor(F.col(end) / step)), "detected"), [*by, "tick"], "full")
    return both.groupBy(F.coalesce("truth", F.lit(none)).alias("truth"), F.coalesce("detected", F.lit(none)).alias("detected")).count()


def preprocess_eye(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, pupil: str, gaze_filter: str = "median", gaze_window: int = 5, max_gap: float = 0.15, pupil_window: int = 5, baseline: tuple[float, float] = (-0.2, 0.0)) -> DataFrame:
    """Filtered gaze, and interpolated, filtered and baselined pupil: one plan over one partitioning."""
    out = filter_gaze(df, time, by, [x, y], gaze_filter, gaze_window)
    out = interpolate_pupil(out, time, by, pupil, "linear", max_gap)
    out = filter_pupil(out, time, by, pupil, "median", pupil_window)
    return baseline_pupil(out, time, by, pupil, baseline)

