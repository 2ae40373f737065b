"""Areas of interest: static, dynamic and uncertain; visits, perturbations, features and compositions.

AOI tables are small (they are drawn by hand) but their size is the caller's: joins are plain joins on
the stimulus, which Spark broadcasts when its statistics allow it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import changed, finite, ordered, ratio, run_id, share
from ..functions.ranks import joined_null_safe, totalled


def in_rectangle(x: Column, y: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    return x.between(x0, x0 + width) & y.between(y0, y0 + height)


def in_ellipse(x: Column, y: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """width and height are whole axes."""
    return F.pow(ratio(x - cx, width / 2), 2) + F.pow(ratio(y - cy, height / 2), 2) <= 1


def in_polygon(x: Column, y: Column, vertices: Column, epsilon: float = 2.220446049250313e-16) -> Column:
    """Even-odd rule over an array of (x, y) structs."""
    n = F.size(vertices)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(vertices, i).alias("a"), F.get(vertices, (i + n - 1) % n).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + epsilon) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.aggregate(edges, F.lit(False), lambda inside, e: F.when(crosses(e), ~inside).otherwise(inside))


def holds(x: Column, y: Column, shape: Column, polygons: bool = False) -> Column:
    """Whether a shape (shape_type, x0, y0, width, height and, for polygons, vertices) holds the point."""
    kind, box = shape["shape_type"], [shape[c] for c in ("x0", "y0", "width", "height")]
    test = F.when(kind == "rectangle", in_rectangle(x, y, *box)).when(kind.isin("circle", "ellipse"), in_ellipse(x, y, *box))
    if polygons:
        test = test.when(kind == "polygon", in_polygon(x, y, shape["vertices"]))
    return F.coalesce(test, F.lit(False))


#: Most AOIs that go to every row as one array; a larger table is joined.
MOST_AOIS = 1_000


def assign_aois(points: DataFrame, aois: DataFrame, x: str, y: str, key: Sequence[str], stimulus: str | None = None, overlap: str = "first") -> DataFrame:
    """points with aoi_id: of the first AOI by row order (aoi_order), of the smallest, or all of them joined by pipes; null outside.

    AOIs of a stimulus become one array, which joins the points of that stimulus (or all of them, where there are no stimuli) and
    is searched in the row: no point is shuffled by its key. Stimuli with more than MOST_AOIS shapes are refused."""
    fields = ["aoi_order", "aoi_id", "shape_type", "x0", "y0", "width", "height", *(["vertices"] if "vertices" in aois.columns else [])]
    shapes = aois.groupBy(*([stimulus] if stimulus else [])).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_shapes"), F.count("*").alias("_n"))
    largest = shapes.agg(F.max("_n")).first()[0]
    if (largest or 0) > MOST_AOIS:
        raise ValidationError(f"a stimulus has {largest} AOIs; at most {MOST_AOIS} are searched in a row")
    shapes = shapes.drop("_n")
    joined = points.join(shapes, stimulus, "left") if stimulus else points.join(F.broadcast(shapes), F.lit(True), "left")
    a, b = finite(x), finite(y)
    hits = F.filter("_shapes", lambda s: a.isNotNull() & b.isNotNull() & holds(a, b, s, "vertices" in aois.columns))
    if overlap == "all":
        found = F.nullif(F.array_join(F.transform(hits, lambda s: s["aoi_id"]), "|"), F.lit(""))
    elif overlap == "smallest":
        found = F.array_min(F.transform(hits, lambda s: F.struct((s["width"] * s["height"]).alias("area"), s["aoi_order"], s["aoi_id"])))["aoi_id"]
    else:
        found = F.get(hits, F.lit(0))["aoi_id"]
    return joined.withColumn("aoi_id", found).drop("_shapes")


def build_aoi_visits(df: DataFrame, time: str, by: Sequence[str], aoi: str = "aoi_id", gap_tolerance: float = 0.075, minimum: float = 0.0, x: str | None = None, y: str | None = None) -> DataFrame:
    """Runs of one AOI whose steps are no longer than the tolerance; samples outside every AOI don't break a run.

    With coordinates a visit has its first, last and mean position too."""
    w = ordered(by, time)
    inside = df.filter(F.col(aoi).isNotNull())
    starts = changed(aoi, w) | F.coalesce(finite(time) - F.lag(finite(time)).over(w) > gap_tolerance, F.lit(False))
    runs = inside.withColumn("_run", run_id(starts, w))
    positions = []
    for name, c in (("x", x), ("y", y)):
        if c:
            positions += [F.min_by(c, time).alias(f"start_{name}"), F.max_by(c, time).alias(f"end_{name}"), F.avg(finite(c)).alias(f"centroid_{name}")]
    found = runs.groupBy(*by, "_run", aoi).agg(F.min(finite(time)).alias("start_time"), F.max(finite(time)).alias("end_time"), F.count("*").alias("n_samples"), *positions)
    lasting = found.withColumn("duration_ms", (F.col("end_time") - F.col("start_time")) * 1000)
    named = {"episode_type": F.lit("aoi_visit"), "source_algorithm": F.lit("AOI run-length encoding"), "source_parameters": F.lit(f"gap_tolerance_ms={gap_tolerance * 1000:g}")}
    return lasting.filter(F.col("duration_ms") >= minimum * 1000).drop("_run").withColumns(named)


def compare_aoi_assignments(baseline: DataFrame, perturbed: DataFrame, key: Sequence[str], aoi: str = "aoi_id") -> DataFrame:
    """Each observation's AOI in both tables and what became of it."""
    a = baseline.select(*key, F.col(aoi).alias("baseline_aoi"))
    b = perturbed.select(*key, F.col(aoi).alias("perturbed_aoi"))
    both = a.join(b, list(key))
    x, y = F.col("baseline_aoi"), F.col("perturbed_aoi")
    return both.withColumn("change", F.when(x.eqNullSafe(y), "unchanged").when(x.isNull(), "newly_assigned").when(y.isNull(), "lost").otherwise("reassigned"))


def estimate_aoi_assignment_stability(changes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Shares of each change overall and by group, by grouping sets."""
    flags = {k: share(F.col("change") == k) for k in ("unchanged", "newly_assigned", "lost", "reassigned")}
    return changes.rollup(*groups).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in flags.items()))


def estimate_fixation_assignment_probability(assignments: DataFrame, key: Sequence[str], perturbation: str, aoi: str = "aoi_id") -> DataFrame:
    """How often each observation falls in each AOI over the perturbations."""
    runs = assignments.groupBy(*key).agg(F.countDistinct(perturbation).alias("n_perturbations"))
    hits = assignments.filter(F.col(aoi).isNotNull()).groupBy(*key, aoi).agg(F.countDistinct(perturbation).alias("n_assigned"))
    return hits.join(runs, list(key)).withColumn("probability", ratio("n_assigned", "n_perturbations"))


def recompute_aoi_features(assignments: DataFrame, groups: Sequence[str], levels: DataFrame, aoi: str = "aoi_id", duration: str | None = None, time: str | None = None) -> DataFrame:
    """Counts, dwell and first time of each group and AOI: zero where the group has valid observations and none there, null where it has none at all.

    assignments has a row an observation, with ``valid``; levels lists the AOIs."""
    scaffold = assignments.groupBy(*groups).agg(F.max(F.col("valid")).alias("_any")).join(F.broadcast(levels.select(aoi)), F.lit(True))
    parts = [F.count("*").alias("n_fixations")]
    if duration:
        parts.append(F.sum(finite(duration)).alias("dwell"))
    if time:
        parts.append(F.min(finite(time)).alias("first_time"))
    found = assignments.filter(F.col("valid") & F.col(aoi).isNotNull()).groupBy(*groups, aoi).agg(*parts)
    out = scaffold.join(found, [*groups, aoi], "left")
    zero = {"n_fixations": F.when(F.col("_any"), F.coalesce("n_fixations", F.lit(0)))}
    if duration:
        zero["dwell"] = F.when(F.col("_any"), F.coalesce("dwell", F.lit(0.0)))
    return out.withColumns(zero).drop("_any")


def perturb_aois(aois: DataFrame, offsets: DataFrame) -> DataFrame:
    """Every rectangle or ellipse under every perturbation (perturbation_id, dx, dy, scale); both tables are small."""
    grid = aois.join(F.broadcast(offsets), F.lit(True))
    grow = (F.col("scale") - 1) / 2
    shift = F.when(F.col("shape_type") == "rectangle", grow).otherwise(0.0)
    return grid.withColumns({"x0": F.col("x0") + F.col("dx") - shift * F.col("width"), "y0": F.col("y0") + F.col("dy") - shift * F.col("height"), "width": F.col("width") * F.col("scale"), "height": F.col("height") * F.col("scale")})


def assign_dynamic_aoi(samples: DataFrame, keyframes: DataFrame, time: str, x: str, y: str, key: str, width: float, interpolation: str = "linear", tolerance: float = 0.0) -> DataFrame:
    """Status and AOI of samples against moving rectangles (aoi, timestamp, x0, y0, width, height).

    Keyframes are led to their successors and joined to samples by time bins; the geometry is interpolated in the row."""
    w = Window.partitionBy("aoi").orderBy("timestamp")
    geometry = ("x0", "y0", "width", "height")
    spans = keyframes.select("aoi", F.col("timestamp").alias("t0"), F.lead("timestamp").over(w).alias("t1"), *geometry, *(F.lead(c).over(w).alias(f"{c}_next") for c in geometry))
    closed = spans.withColumn("t1", F.coalesce("t1", F.col("t0") + tolerance))
    binned = closed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    placed = samples.select(key, finite(time).alias("_t"), finite(x).alias("_x"), finite(y).alias("_y")).withColumn("_bin", F.floor(F.col("_t") / width))
    last = F.col("x0_next").isNull()
    active = placed.join(binned, "_bin").filter((F.col("_t") >= F.col("t0")) & ((F.col("_t") < F.col("t1")) | (last & (F.col("_t") <= F.col("t1")))))
    f = F.when(last, 0.0).otherwise(F.coalesce(ratio(F.col("_t") - F.col("t0"), F.col("t1") - F.col("t0")), F.lit(0.0))) if interpolation == "linear" else F.lit(0.0)
    at = {c: F.col(c) + f * (F.coalesce(f"{c}_next", c) - F.col(c)) for c in geometry}
    hit = in_rectangle(F.col("_x"), F.col("_y"), at["x0"], at["y0"], at["width"], at["height"])
    found = active.withColumn("_hit", F.coalesce(hit, F.lit(False))).groupBy(key).agg(F.count_if("_hit").alias("_n"), F.min(F.when(F.col("_hit"), F.col("aoi"))).alias("_aoi"))
    joined = samples.join(found, key, "left")
    missing = finite(x).isNull() | finite(y).isNull()
    status = F.when(missing, "missing_gaze").when(F.col("_n").isNull(), "no_active_aoi").when(F.col("_n") == 0, "outside").when(F.col("_n") == 1, "assigned").otherwise("ambiguous")
    return joined.withColumns({"status": status, "aoi": F.when(status == "assigned", F.col("_aoi"))}).drop("_n", "_aoi")


def audit_dynamic_aoi_coverage(assigned: DataFrame) -> DataFrame:
    counts = assigned.groupBy("status").count()
    return totalled(counts, _all=F.sum("count")).withColumn("fraction", ratio("count", "_all")).drop("_all")


def rectangle_margin(x: Column, y: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """Distance to the border of a rectangle: positive inside, negative outside."""
    left, right, top, bottom = x - x0, x0 + width - x, y - y0, y0 + height - y
    inside = F.least(left, right, top, bottom)
    outside = F.hypot(F.greatest(-left, -right, F.lit(0.0)), F.greatest(-top, -bottom, F.lit(0.0)))
    return F.when(inside >= 0, inside).otherwise(-outside)


def assign_aois_probabilistic(points: DataFrame, aois: DataFrame, x: str, y: str, key: Sequence[str], sd: float) -> DataFrame:
    """Memberships of each point by a softmax of its margins over the standard error; outside is a class with margin zero. ambiguity: 1 - largest.

    The AOIs are one array of at most MOST_AOIS, and all is computed in the point's row."""
    shapes = aois.agg(F.sort_array(F.collect_list(F.struct("aoi_id", "x0", "y0", "width", "height"))).alias("_shapes"))
    n = shapes.select(F.size("_shapes")).first()[0]
    if n > MOST_AOIS:
        raise ValidationError(f"{n} AOIs; at most {MOST_AOIS} are compared in a row")
    spot = points.select(*key, finite(x).alias("_x"), finite(y).alias("_y")).filter("_x is not null and _y is not null").crossJoin(F.broadcast(shapes))
    margin = lambda s: rectangle_margin(F.col("_x"), F.col("_y"), s["x0"], s["y0"], s["width"], s["height"]) / sd
    scored = spot.select(*key, F.transform("_shapes", lambda s: s["aoi_id"]).alias("_ids"), F.array_append(F.transform("_shapes", margin), F.lit(0.0)).alias("_z"))
    powers = scored.select(*key, "_ids", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))).alias("_e"))
    summed = powers.select(*key, "_ids", "_e", F.aggregate("_e", F.lit(0.0), lambda a, e: a + e).alias("_s"))
    each = summed.select(*key, "_s", (1 - F.array_max("_e") / F.col("_s")).alias("ambiguity"), F.explode(F.arrays_zip(F.array_append("_ids", F.lit("__outside__")).alias("id"), F.col("_e").alias("e"))).alias("m"))
    return each.select(*key, F.col("m.id").alias("aoi_id"), (F.col("m.e") / F.col("_s")).alias("probability"), "ambiguity")


def probabilistic_aoi_assignment(memberships: DataFrame, key: Sequence[str], minimum: float = 0.5) -> DataFrame:
    """The likeliest AOI of each point if likely enough; margin: likeliest less second."""
    w = Window.partitionBy(*key).orderBy(F.desc("probability"), "aoi_id")
    ranked = memberships.withColumns({"_r": F.row_number().over(w), "_second": F.lead("probability").over(w)}).filter("_r = 1")
    return ranked.select(*key, F.when(F.col("probability") >= minimum, F.col("aoi_id")).alias("aoi_id"), "probability", (F.col("probability") - F.coalesce("_second", F.lit(0.0))).alias("margin"))


def summarise_aoi_membership(memberships: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return memberships.groupBy(*by, "aoi_id").agg(F.count("*").alias("n"), F.avg("probability").alias("mean_membership"))


def audit_aoi_separation(aois: DataFrame) -> DataFrame:
    """Overlap area and gap of each pair of rectangles of a stimulus; AOIs of one stimulus are few."""
    a, b = aois.alias("a"), aois.alias("b")
    pairs = a.join(b, (F.col("a.stimulus_id").eqNullSafe(F.col("b.stimulus_id"))) & (F.col("a.aoi_id") < F.col("b.aoi_id")))
    w = F.least(F.col("a.x0") + F.col("a.width"), F.col("b.x0") + F.col("b.width")) - F.greatest("a.x0", "b.x0")
    h = F.least(F.col("a.y0") + F.col("a.height"), F.col("b.y0") + F.col("b.height")) - F.greatest("a.y0", "b.y0")
    zero = F.lit(0.0)
    out = pairs.select(F.col("a.aoi_id").alias("aoi_a"), F.col("b.aoi_id").alias("aoi_b"), (F.greatest(w, zero) * F.greatest(h, zero)).alias("overlap_area"), F.hypot(F.greatest(-w, zero), F.greatest(-h, zero)).alias("gap"))
    return out.withColumn("status", F.when(F.col("overlap_area") > 0, "overlap").when(F.col("gap") == 0, "touching").otherwise("separate"))


#: Different rectangles of a block of summarise_aoi_separation; two blocks meet in one row.
SIDE = 2_048


def _separations(batches):
    """The kernel over pairs of blocks of different rectangles (x0, y0, width, height and how many there are, as arrays): n, overlap and gap of their pairs by status.

    ``_same``: 0 for two blocks, 1 for a block with itself, -1 to take the pairs of a block with itself away. Of missing coordinates the other rectangle's stand, as in least and greatest."""
    import numpy as np
    import pyarrow as pa

    def arrays(column, i):
        values = column[i].values
        return [values.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(5)]

    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            same = batch.column("_same")[i].as_py()
            ax, ay, aw, ah, ak = arrays(batch.column("_a"), i)
            bx, by, bw, bh, bk = arrays(batch.column("_b"), i)
            sums = {"overlap": [0, 0.0, 0.0], "touching": [0, 0.0, 0.0], "separate": [0, 0.0, 0.0]}
            for at in range(0, len(ax), 128):
                part = slice(at, at + 128)
                w = np.fmin((ax + aw)[part, None], bx + bw) - np.fmax(ax[part, None], bx)
                h = np.fmin((ay + ah)[part, None], by + bh) - np.fmax(ay[part, None], by)
                overlap = np.fmax(w, 0.0) * np.fmax(h, 0.0)
                gap = np.sqrt(np.fmax(-w, 0.0) ** 2 + np.fmax(-h, 0.0) ** 2)
                pairs = ak[part, None] * bk
                if same:
                    place = np.arange(len(ax))
                    pairs = np.where(place[part, None] < place, pairs, np.where(place[part, None] == place, bk * (bk - 1) / 2, 0.0))
                over = overlap > 0
                for status, met in (("overlap", over), ("touching", ~over & (gap == 0)), ("separate", ~over & (gap > 0))):
                    n = np.where(met, pairs, 0.0)
                    one = sums[status]
                    one[0] += int(n.sum())
                    one[1] += float((n * overlap).sum()) if status == "overlap" else 0.0
                    one[2] += float((n * gap).sum()) if status != "touching" else 0.0
            sign = -1 if same < 0 else 1
            out += [(status, sign * n, sign * o, sign * g) for status, (n, o, g) in sums.items() if n]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["status", "n", "overlap_area", "gap"])


def summarise_aoi_separation(aois: DataFrame) -> DataFrame:
    """Number, overlap area and gap of all pairs of audit_aoi_separation by status, without a row a pair.

    Equal rectangles of a stimulus are one with a number. Different ones fall into blocks of about SIDE by a hash, every two blocks of a stimulus meet in one row, and a task adds up its
    pairs of blocks: all pairs are worked out, in bounded memory. Rectangles with equal ids are no pair; missing and non-finite coordinates are null."""
    sides = ["x0", "y0", "width", "height"]
    rows = aois.filter(F.col("aoi_id").isNotNull()).select("stimulus_id", "aoi_id", *(finite(c).alias(c) for c in sides))
    shape = F.struct(*sides, F.col("_k").cast("double").alias("k"))
    different = rows.groupBy("stimulus_id", *sides).agg(F.count("*").alias("_k"))
    sized = joined_null_safe(different, different.groupBy("stimulus_id").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("_blocks")), ["stimulus_id"])
    blocks = sized.withColumn("_block", F.pmod(F.xxhash64(*sides), F.col("_blocks")).cast("int")).groupBy("stimulus_id", "_blocks", "_block").agg(F.collect_list(shape).alias("_a"))
    sent = blocks.select("stimulus_id", F.col("_block").alias("_first"), F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)).alias("_block"), F.col("_a").alias("_b"))
    met = joined_null_safe(sent, blocks.drop("_blocks"), ["stimulus_id", "_block"]).select(F.when(F.col("_first") == F.col("_block"), 1).otherwise(0).alias("_same"), "_a", "_b")
    named = rows.groupBy("stimulus_id", "aoi_id", *sides).agg(F.count("*").alias("_k")).groupBy("stimulus_id", "aoi_id").agg(F.sum("_k").alias("_n"), F.collect_list(shape).alias("_a"))
    twice = named.filter("_n > 1").select(F.lit(-1).alias("_same"), "_a", F.col("_a").alias("_b"))
    sums = met.unionByName(twice).repartition(F.xxhash64("_a", "_b")).mapInArrow(_separations, "status string, n long, overlap_area double, gap double")
    return sums.groupBy("status").agg(*(F.sum(c).alias(c) for c in ("n", "overlap_area", "gap"))).filter("n > 0")


def derive_aoi_composition(dwell: DataFrame, by: Sequence[str], aois: Sequence[str], aoi: str = "aoi_id", value: str = "dwell", zero: float = 1e-6) -> DataFrame:
    """Shares of each AOI in wide form: zeros take a small value and the rest shrink with them."""
    wide = dwell.groupBy(*by).pivot(aoi, list(aois)).agg(F.sum(finite(value)))
    filled = wide.select(*by, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in aois))
    total = sum((F.col(c) for c in aois), F.lit(0.0))
    shares = filled.select(*by, *(ratio(c, total).alias(c) for c in aois))
    n_zero = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in aois), F.lit(0))
    return shares.select(*by, *(F.when(F.col(c) == 0, F.lit(zero)).otherwise(F.col(c) * (1 - n_zero * zero)).alias(c) for c in aois))


def transform_aoi_composition(shares: DataFrame, aois: Sequence[str], method: str = "clr", reference: str | None = None) -> DataFrame:
    """Centred, additive or isometric log-ratios, as columns <method>_<k>."""
    logs = [F.ln(F.col(c)) for c in aois]
    if method == "clr":
        mean = sum(logs[1:], logs[0]) / len(aois)
        new = [x - mean for x in logs]
    elif method == "alr":
        ref = F.ln(F.col(reference or aois[-1]))
        new = [F.ln(F.col(c)) - ref for c in aois if c != (reference or aois[-1])]
    else:
        new = [math.sqrt(k / (k + 1)) * (sum(logs[1:k], logs[0]) / k - logs[k]) for k in range(1, len(aois))]
    return shares.withColumns({f"{method}_{k + 1}": c for k, c in enumerate(new)})


def aoi_balance_coordinates(shares: DataFrame, balances: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """User-defined balances of two groups of parts."""
    out = {}
    for name, (up, down) in balances.items():
        r, s = len(up), len(down)
        mean = lambda cs: sum((F.ln(F.col(c)) for c in cs[1:]), F.ln(F.col(cs[0]))) / len(cs)
        out[name] = math.sqrt(r * s / (r + s)) * (mean(list(up)) - mean(list(down)))
    return shares.withColumns(out)


def compare_aoi_compositions(shares: DataFrame, group: str, aois: Sequence[str]) -> DataFrame:
    """Pseudo-F of groups of compositions: between and within sums of squares of their isometric log-ratios, which are those of the centred ones."""
    # generated as rows, so that the optimiser doesn't repeat the shares' expressions in every log-ratio
    plain = shares.select(F.inline(F.array(F.struct(group, *aois))))
    logs = transform_aoi_composition(plain, aois, "clr")
    names = [f"clr_{k + 1}" for k in range(len(aois))]
    known = logs.dropna(subset=names).select(group, *names)
    long = known.unpivot([group], names, "_part", "_v")
    spread = F.var_pop("_v") * F.count("*")
    within = long.groupBy(group, "_part").agg(spread.alias("w")).agg(F.countDistinct(F.struct(group)).alias("n_groups"), F.sum("w").alias("within"))
    whole = long.groupBy("_part").agg(F.count("*").alias("n"), spread.alias("t")).agg(F.max("n").alias("n"), F.sum("t").alias("total"))
    both = whole.crossJoin(F.broadcast(within)).withColumn("between", F.col("total") - F.col("within"))
    return both.withColumn("pseudo_f", ratio(F.col("between") / (F.col("n_groups") - 1), F.col("within") / (F.col("n") - F.col("n_groups")))).select("n", "n_groups", "between", "within", "pseudo_f")


def composition_centroids(shares: DataFrame, group: str, aois: Sequence[str]) -> DataFrame:
    return shares.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in aois))


def degrees_per_pixel(screen_px: float, screen_size: float, distance: float) -> float:
    """Visual angle of a pixel at the middle of a screen side of a size in the units of the distance."""
    return math.degrees(2 * math.atan(screen_size / screen_px / (2 * distance)))


def convert_aoi_margin(aois: DataFrame, margin_x: str, margin_y: str, per_pixel: tuple[float, float], to: str = "degrees") -> DataFrame:
    """Margins in degrees from pixels, or back."""
    factors = per_pixel if to == "degrees" else (1 / per_pixel[0], 1 / per_pixel[1])
    return aois.withColumns({f"{margin_x}_{to}": finite(margin_x) * factors[0], f"{margin_y}_{to}": finite(margin_y) * factors[1]})


def jitter_aois(aois: DataFrame, sd: float, draws: int, seed: int = 1) -> DataFrame:
    """Every AOI displaced on both axes in every draw, by sums of twelve hashed uniforms less six, which are nearly normal and the same in every run."""
    each = aois.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def normal(axis: str) -> Column:
        u = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("aoi_id"), F.col("draw"), F.lit(axis), k), F.lit(1_000_003)) / 1_000_003.0)
        return F.aggregate(u, F.lit(-6.0), lambda a, v: a + v)

    return each.withColumns({"x0": F.col("x0") + sd * normal("x"), "y0": F.col("y0") + sd * normal("y")})


def propagate_aoi_uncertainty(memberships: DataFrame, durations: DataFrame, key: Sequence[str], by: Sequence[str], duration: str) -> DataFrame:
    """Expected dwell of each AOI and its standard deviation when each observation falls in an AOI by its membership, independently: moments in place of draws."""
    rows = memberships.join(durations.select(*key, *by, finite(duration).alias("_d")), list(key)).filter("_d is not null")
    p, d = F.col("probability"), F.col("_d")
    return rows.groupBy(*by, "aoi_id").agg(F.count("*").alias("n"), F.sum(p * d).alias("expected_dwell"), F.sqrt(F.sum(p * (1 - p) * d * d)).alias("sd_dwell"), F.sum(p).alias("expected_count"))
