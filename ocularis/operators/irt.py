"""Item response theory as column expressions and joins: probabilities, information, scores, fit, linking, selection.

Item tables (item_id, a, b and, where a family has them, c and d) are one row an item. Grids of
ability are short sequences exploded in the row, so that person by grid tables never meet a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, expit, finite, normal_cdf, normal_quantile, ordered, ratio, share, softmax
from ..functions.ranks import running, totalled

#: Of a class of equal skills: items that lie in one array, and profiles of one piece.
ITEMS_TOGETHER, PROFILES_TOGETHER = 1_000, 10_000


def probability_2pl(theta: Column, a: Column, b: Column, scale: float = 1.0) -> Column:
    return expit(scale * a * (theta - b))


def probability_3pl(theta: Column, a: Column, b: Column, c: Column, scale: float = 1.0) -> Column:
    return c + (1 - c) * probability_2pl(theta, a, b, scale)


def probability_4pl(theta: Column, a: Column, b: Column, c: Column, d: Column, scale: float = 1.0) -> Column:
    return c + (d - c) * probability_2pl(theta, a, b, scale)


def probability_grm(theta: Column, a: Column, thresholds: Column, scale: float = 1.0) -> Column:
    """Array of category probabilities of the graded response model."""
    above = F.concat(F.array(F.lit(1.0)), F.transform(thresholds, lambda t: expit(scale * a * (theta - t))), F.array(F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), F.size(thresholds)), lambda k: F.get(above, k) - F.get(above, k + 1))


def probability_gpcm(theta: Column, a: Column, steps: Column, scale: float = 1.0) -> Column:
    """Array of category probabilities of the generalised partial credit model."""
    terms = F.transform(steps, lambda s: scale * a * (theta - s))
    scores = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.aggregate(F.slice(terms, F.lit(1), k), F.lit(0.0), lambda x, y: x + y))
    return softmax(scores)


def probability_nominal(theta: Column, slopes: Column, intercepts: Column) -> Column:
    return softmax(F.zip_with(slopes, intercepts, lambda s, i: s * theta + i))


def expected_category(probabilities: Column) -> Column:
    """Sum of k times the probability of category k."""
    return F.aggregate(F.transform(probabilities, lambda p, k: p * k), F.lit(0.0), lambda x, y: x + y)


def item_information(theta: Column, a: Column, b: Column, c: Column | None = None, d: Column | None = None, scale: float = 1.0) -> Column:
    """P'^2 / (P (1 - P)), for two to four parameters."""
    lo, hi = c if c is not None else F.lit(0.0), d if d is not None else F.lit(1.0)
    q = probability_2pl(theta, a, b, scale)
    p = lo + (hi - lo) * q
    slope = scale * a * (hi - lo) * q * (1 - q)
    return F.coalesce(ratio(slope * slope, p * (1 - p)), F.lit(0.0))


def conditional_sem(information: Column) -> Column:
    return F.when(information > 0, 1 / F.sqrt(information)).otherwise(F.lit(float("inf")))


def information_gain(before: Column, after: Column) -> Column:
    return 1 / (after * after) - 1 / (before * before)


def theta_grid(low: float = -4.0, high: float = 4.0, points: int = 81) -> Column:
    step = (high - low) / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: low + k * step)


def at_grid(items: DataFrame, grid: Column) -> DataFrame:
    return items.withColumn("theta", F.explode(grid))


def test_information(items: DataFrame, grid: Column, scale: float = 1.0) -> DataFrame:
    info = item_information(F.col("theta"), F.col("a"), F.col("b"), F.col("c") if "c" in items.columns else None, F.col("d") if "d" in items.columns else None, scale)
    return at_grid(items, grid).groupBy("theta").agg(F.sum(info).alias("information")).withColumn("sem", conditional_sem(F.col("information")))


def test_characteristic_curve(items: DataFrame, grid: Column, scale: float = 1.0) -> DataFrame:
    return at_grid(items, grid).groupBy("theta").agg(F.sum(probability_2pl(F.col("theta"), F.col("a"), F.col("b"), scale)).alias("expected_score"))


def information_area(curve: DataFrame) -> DataFrame:
    """Trapezoid under an information curve of one test: a row a point of a short grid."""
    w = Window.orderBy("theta")
    part = (F.col("information") + F.lag("information").over(w)) / 2 * (F.col("theta") - F.lag("theta").over(w))
    return curve.withColumn("_p", part).agg(F.sum("_p").alias("area"))


def precision_profile(curve: DataFrame, low: float = -2.0, high: float = 2.0) -> DataFrame:
    inside = curve.filter(F.col("theta").between(low, high))
    return inside.agg(F.min("information").alias("min_information"), F.max("sem").alias("max_sem"), F.count("*").alias("n_points"))


def dtf_curve(reference: DataFrame, focal: DataFrame, grid: Column) -> DataFrame:
    """Difference of two tests' expected scores."""
    a = test_characteristic_curve(reference, grid).withColumnRenamed("expected_score", "reference")
    b = test_characteristic_curve(focal, grid).withColumnRenamed("expected_score", "focal")
    return a.join(b, "theta").withColumn("difference", F.col("focal") - F.col("reference"))


def functioning_effects(curve: DataFrame) -> DataFrame:
    w = Window.orderBy("theta")
    part = (F.col("difference") + F.lag("difference").over(w)) / 2 * (F.col("theta") - F.lag("theta").over(w))
    return curve.withColumn("_p", part).agg(F.max(F.abs("difference")).alias("max_abs"), F.avg(F.abs("difference")).alias("mean_abs"), F.sum("_p").alias("signed_area"))


def joined_probabilities(responses: DataFrame, abilities: DataFrame, items: DataFrame, person: str = "person", item: str = "item_id") -> DataFrame:
    """Long responses with the model's probability of each."""
    both = responses.join(abilities.select(person, "theta"), person).join(items, item)
    return both.withColumn("p", probability_2pl(F.col("theta"), F.col("a"), F.col("b")))


def infit_outfit(rows: DataFrame, by: str, observed: str = "response", expected: str = "p", min_variance: float = 1e-8) -> DataFrame:
    """Mean squares of residuals by item or person: weighted by variance (infit) and not (outfit)."""
    v = F.greatest(F.col(expected) * (1 - F.col(expected)), F.lit(min_variance))
    r = finite(observed) - F.col(expected)
    kept = rows.select(by, v.alias("v"), (r * r).alias("r2")).filter("r2 is not null")
    return kept.groupBy(by).agg(F.count("*").alias("n"), ratio(F.sum("r2"), F.sum("v")).alias("infit"), F.avg(F.col("r2") / F.col("v")).alias("outfit"))


def person_fit_lz(rows: DataFrame, person: str, observed: str = "response", expected: str = "p", least: float = 1e-8) -> DataFrame:
    """Standardised log-likelihood of each person's responses."""
    p = F.least(F.greatest(F.col(expected), F.lit(least)), F.lit(1 - least))
    x = finite(observed)
    logit = F.ln(p) - F.ln(1 - p)
    ll = x * F.ln(p) + (1 - x) * F.ln(1 - p)
    mean = p * F.ln(p) + (1 - p) * F.ln(1 - p)
    sums = rows.filter(x.isNotNull()).groupBy(person).agg(F.count("*").alias("n_items"), F.sum(ll).alias("l"), F.sum(mean).alias("m"), F.sum(p * (1 - p) * logit * logit).alias("v"))
    return sums.select(person, "n_items", ratio(F.col("l") - F.col("m"), F.sqrt("v")).alias("lz"))


def q3(rows: DataFrame, person: str, item: str, observed: str = "response", expected: str = "p") -> DataFrame:
    """Correlation of residuals of each pair of items over persons who answered both. Pairs are made within a person, whose responses are a test's length."""
    res = rows.select(person, item, (finite(observed) - F.col(expected)).alias("r")).filter("r is not null")
    a = res.select(person, F.col(item).alias("item_a"), F.col("r").alias("x"))
    b = res.select(person, F.col(item).alias("item_b"), F.col("r").alias("y"))
    return a.join(b, person).filter("item_a < item_b").groupBy("item_a", "item_b").agg(F.count("*").alias("n"), correlation("x", "y").alias("q3"))


def _posterior_moments(thetas: Sequence[float], prior: Sequence[float]):
    """The kernel over responses (person, signed slope, difficulty) sorted by person: sums of log-likelihoods over the grid, carried over batches, and the moments of each person's posterior."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        grid, start = np.array(thetas), np.array(prior)
        now: tuple | None = None
        total, n = None, 0

        def moments(persons, sums, counts, kind):
            w = np.exp(sums - sums.max(axis=1, keepdims=True))
            w /= w.sum(axis=1, keepdims=True)
            mean = w @ grid
            return pa.RecordBatch.from_arrays([pa.array(persons, kind), pa.array(counts, pa.int64()), pa.array(mean), pa.array(np.sqrt(np.maximum(w @ (grid * grid) - mean * mean, 0.0)))], names=["person", "n_items", "theta", "se"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                persons = part.column(0).to_pylist()
                s, d = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                logs = -np.logaddexp(0.0, s[:, None] * (d[:, None] - grid))
                cuts = [0, *(k for k in range(1, len(persons)) if persons[k] != persons[k - 1])]
                sums, counts = np.add.reduceat(logs, cuts, axis=0), np.diff([*cuts, len(persons)])
                names = [persons[k] for k in cuts]
                if now is not None and now[0] == names[0]:
                    sums[0] += total
                    counts[0] += n
                elif now is not None:
                    yield moments([now[0]], (total + start)[None], [n], kind)
                if len(names) > 1:
                    yield moments(names[:-1], sums[:-1] + start, counts[:-1], kind)
                now, total, n = (names[-1],), sums[-1], counts[-1]
        if now is not None:
            yield moments([now[0]], (total + start)[None], [n], kind)

    return run


def eap_scores(responses: DataFrame, items: DataFrame, person: str, item: str = "item_id", low: float = -4.0, high: float = 4.0, points: int = 81, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """Posterior mean and deviation of ability on a grid.

    Responses go to their person with two numbers each, far fewer than partial sums over the grid would be, and are summed there over the grid as they pass, so that a person may have any number of them."""
    thetas = [low + (high - low) * k / (points - 1) for k in range(points)]
    x = finite("response")
    rows = responses.select(person, item, x.alias("_x")).filter("_x is not null").join(items.select(item, "a", "b"), item)
    # ln p for a success and ln (1 - p) otherwise are both -ln(1 + exp(-s a (theta - b))) with s = 1 or -1
    signed = rows.select(person, (F.when(F.col("_x") > 0, 1.0).otherwise(-1.0) * F.col("a")).cast("double").alias("_s"), F.col("b").cast("double").alias("_b")).dropna(subset=["_s", "_b"])
    prior = [-(((t - mean) / sd) ** 2) / 2 for t in thetas]
    ordered_ = signed.repartition(person).sortWithinPartitions(person)
    found = ordered_.mapInArrow(_posterior_moments(thetas, prior), f"person {dict(responses.dtypes)[person]}, n_items long, theta double, se double")
    return found.withColumnRenamed("person", person)


def marginal_reliability(scores: DataFrame) -> DataFrame:
    r = 1 - ratio(F.avg(F.col("se") * F.col("se")), F.var_samp("theta"))
    return scores.agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)).alias("reliability"))


def score_uncertainty(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("se").alias("mean_se"), F.median("se").alias("median_se"), F.percentile("se", F.lit(0.95)).alias("p95_se"))


def classification_precision(scores: DataFrame, cut: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """p_above, the probability of an ability above the cut (to normal_cdf's error), and the decision, by the exact normal quantile of confidence."""
    z = ratio(F.col("theta") - cut, F.col("se"))
    limit = normal_quantile(confidence)
    return scores.withColumn("p_above", normal_cdf(z)).withColumn("decision", F.when(z >= limit, "above").when(z <= -limit, "below").otherwise("uncertain"))


def sparse_design_audit(responses: DataFrame, person: str, item: str, min_person_items: int = 3, min_item_persons: int = 10) -> DataFrame:
    """Persons and items with too few responses."""
    kept = responses.filter(finite("response").isNotNull())
    p = kept.groupBy(F.col(person).cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit("person").alias("kind"), "id", "n", (F.col("n") < min_person_items).alias("sparse"))
    i = kept.groupBy(F.col(item).cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit("item").alias("kind"), "id", "n", (F.col("n") < min_item_persons).alias("sparse"))
    return p.unionByName(i)


def extreme_score_audit(responses: DataFrame, person: str, lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    scores = responses.groupBy(person).agg(F.avg(finite("response")).alias("score"))
    return scores.agg(F.count("*").alias("n"), share(F.col("score") <= lower).alias("at_floor"), share(F.col("score") >= upper).alias("at_ceiling"))


def parameter_plausibility_audit(items: DataFrame, a: tuple[float, float] = (0.2, 4.0), b: tuple[float, float] = (-6.0, 6.0)) -> DataFrame:
    out = items.withColumns({"a_ok": F.col("a").between(*a), "b_ok": F.col("b").between(*b)})
    return out.withColumn("plausible", F.coalesce(F.col("a_ok") & F.col("b_ok"), F.lit(False)))


def mean_sigma_link(reference: DataFrame, focal: DataFrame, item: str = "item_id") -> DataFrame:
    """Slope and intercept that put focal difficulties on the reference scale: one row."""
    both = reference.select(item, F.col("b").alias("r")).join(focal.select(item, F.col("b").alias("f")), item)
    slope = ratio(F.stddev_samp("r"), F.stddev_samp("f"))
    return both.agg(F.count("*").alias("n_anchors"), slope.alias("A"), (F.avg("r") - slope * F.avg("f")).alias("B"))


def session_drift(parameters: DataFrame, item: str, session: str, parameter: str = "b") -> DataFrame:
    return parameters.groupBy(item).agg(F.min_by(parameter, session).alias("first"), F.max_by(parameter, session).alias("last"), (F.max_by(parameter, session) - F.min_by(parameter, session)).alias("change"), (F.max(parameter) - F.min(parameter)).alias("range"))


def item_selection(bank: DataFrame, theta: float, administered: DataFrame | None = None, exposure_limit: float | None = None) -> DataFrame:
    """The unused item with the most information at theta, of equal ones that with the smallest id: one row. Items without a finite information can't be it."""
    left = bank.join(administered, "item_id", "left_anti") if administered is not None else bank
    if exposure_limit is not None:
        left = left.filter(F.col("exposure") <= exposure_limit)
    scored = left.withColumn("information", finite(item_information(F.lit(theta), F.col("a"), F.col("b")))).filter("information is not null")
    return scored.agg(F.min_by("item_id", F.struct(-F.col("information"), F.col("item_id"))).alias("item_id"), F.max("information").alias("information"))


def exposure_summary(administered: DataFrame, bank: DataFrame) -> DataFrame:
    counts = administered.groupBy("item_id").agg(F.count("*").alias("n"))
    out = bank.select("item_id").join(counts, "item_id", "left").fillna(0, ["n"])
    return totalled(out, _all=F.sum("n")).withColumn("exposure", ratio("n", "_all")).drop("_all")


def content_balance_audit(administered: DataFrame, bank: DataFrame, target: DataFrame) -> DataFrame:
    counts = administered.join(bank.select("item_id", "content"), "item_id").groupBy("content").agg(F.count("*").alias("n"))
    shares = totalled(counts, _all=F.sum("n")).withColumn("observed", ratio("n", "_all")).drop("_all")
    return target.join(shares, "content", "left").fillna({"n": 0, "observed": 0.0}).withColumn("difference", F.col("observed") - F.col("target"))


def response_time_profile(responses: DataFrame, by: str, time: str) -> DataFrame:
    t = finite(time)
    return responses.groupBy(by).agg(F.count(t).alias("n"), F.avg(t).alias("mean_rt"), F.median(t).alias("median_rt"), F.stddev_samp(t).alias("sd_rt"), F.avg(F.when(t > 0, F.ln(t))).alias("mean_log_rt"))


def speed_accuracy_profile(responses: DataFrame, person: str, response: str, time: str) -> DataFrame:
    lt = F.when(finite(time) > 0, F.ln(finite(time)))
    return responses.groupBy(person).agg(F.count("*").alias("n"), F.avg(finite(response)).alias("accuracy"), F.avg(lt).alias("mean_log_rt"), correlation(finite(response), lt).alias("r"))


def missingness_pattern(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each pattern of 1 (there) and 0 (missing) over the columns."""
    pattern = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns))
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


def ez_diffusion(responses: DataFrame, by: Sequence[str], accuracy: str, time: str, scale: float = 0.1) -> DataFrame:
    """Closed-form drift, boundary and non-decision time from accuracy and the mean and variance of correct times."""
    x, t = finite(accuracy), finite(time)
    right = F.when(x == 1, t)
    sums = responses.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("raw"), F.avg(right).alias("mrt"), F.var_samp(right).alias("vrt"))
    n = F.col("n")
    pc = F.least(F.greatest(F.col("raw"), 1 / (2 * n)), 1 - 1 / (2 * n))
    status = F.when((n < 3) | F.col("vrt").isNull() | (F.col("vrt") <= 0), "insufficient_data").when(F.col("raw") == 0.5, "undefined_at_chance").otherwise("ok")
    base = sums.withColumns({"status": status, "pc": pc}).withColumn("L", F.ln(F.col("pc") / (1 - F.col("pc"))))
    inner = F.col("L") * (F.col("L") * F.col("pc") * F.col("pc") - F.col("L") * F.col("pc") + F.col("pc") - 0.5) / F.col("vrt")
    ok = F.col("status") == "ok"
    drift = F.when(ok, F.signum(F.col("pc") - 0.5) * scale * F.pow(F.greatest(inner, F.lit(0.0)), 0.25))
    out = base.withColumn("drift", drift).withColumn("boundary", F.when(ok, ratio(scale * scale * F.col("L"), "drift")))
    y = -F.col("drift") * F.col("boundary") / (scale * scale)
    mdt = F.col("boundary") / (2 * F.col("drift")) * (1 - F.exp(y)) / (1 + F.exp(y))
    return out.withColumn("nondecision", F.when(ok, F.col("mrt") - mdt)).drop("L")


def dina_ideal_response(q: DataFrame, profiles: DataFrame) -> DataFrame:
    """1 where a profile has every skill of an item, else 0, for the items and profiles that share a skill (others are 0). q: item_id, skill; profiles: profile, skill.

    Items with equal skills are a class, and so are profiles. Classes meet by skill, in the row of the first skill that both have, so no item meets a profile that has
    nothing to do with it; then profiles take the items of their classes, in pieces of classes, and no pair of an item and a profile is shuffled. Null skills and items are nobody's."""
    items, needed = _skill_classes(q.filter("item_id IS NOT NULL"), "item_id", ITEMS_TOGETHER)
    blocks = items.groupBy(F.col("_set").alias("_needed"), "_piece").agg(F.collect_list("item_id").alias("_items")).drop("_piece")
    holders, held = _skill_classes(profiles, "profile", PROFILES_TOGETHER)
    by_skill = lambda classes, *more: classes.select(*more, F.explode(more[0]).alias("skill"))
    met = by_skill(held, "_set", "_pieces").join(by_skill(needed.withColumnRenamed("_set", "_needed"), "_needed"), "skill")
    both = F.array_intersect("_needed", "_set")
    pairs = met.filter(F.get(both, F.lit(0)) == F.col("skill")).select("_set", "_pieces", "_needed", (F.size(both) == F.size("_needed")).cast("int").alias("ideal"))
    wide = pairs.join(blocks, "_needed").select("_set", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"), "_items", "ideal")
    return holders.join(wide, ["_set", "_piece"]).select(F.explode("_items").alias("item_id"), "profile", "ideal")


def _skill_classes(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """key, ``_set`` (its skills, sorted) and ``_piece``; and the classes of equal sets with their number of ``_pieces``, of about size keys each."""
    of = rows.select(key, "skill").dropna(subset=["skill"]).distinct().groupBy(key).agg(F.sort_array(F.collect_list("skill")).alias("_set"))
    classes = of.groupBy("_set").agg(F.ceil(F.count("*") / size).cast("int").alias("_pieces"))
    return of.join(classes, "_set").select(key, "_set", F.pmod(F.xxhash64(key), "_pieces").cast("int").alias("_piece")), classes


def pareto_front(items: DataFrame, key: str, objectives: Sequence[str]) -> DataFrame:
    """Items that no other is at least as good as everywhere and better somewhere; larger is better.

    Of two objectives, an item must have the largest second value of those with its first value, and a larger one than any item
    with a larger first value, which a running maximum over the distinct first values gives. Of more, each task reduces its items
    to their own front, and the fronts, which are small against the tables, are reduced together."""
    if len(objectives) == 2:
        a, b = objectives
        best = items.groupBy(F.col(a).cast("double").alias("_a")).agg(F.max(b).alias("_best"))
        reached = running(best, "_a", {"_reached": (F.max, F.col("_best"))}, descending=True)
        # the best so far is this value's own exactly where it beats all that have a larger first value
        above = reached.select("_a", "_best", "_reached").filter("_best = _reached")
        ahead = above.groupBy("_best").agg(F.max("_a").alias("_a")).select(F.col("_a"), F.col("_best").alias("_b"))
        return items.join(ahead, (F.col(a).cast("double") == F.col("_a")) & (F.col(b) == F.col("_b")), "left_semi")
    front = items.select(key, *objectives).mapInPandas(lambda parts: _fronts(parts, objectives), items.select(key, *objectives).schema)
    whole = front.coalesce(1).mapInPandas(lambda parts: _fronts(parts, objectives), front.schema)
    return items.join(whole.select(key), key, "left_semi")


def _fronts(parts, objectives: Sequence[str]):
    """The front of all parts, kept batch by batch."""
    import numpy as np
    import pandas as pd

    kept = None
    for part in parts:
        rows = part if kept is None else pd.concat([kept, part], ignore_index=True)
        v = rows[list(objectives)].to_numpy(dtype=float)
        order = np.lexsort(v.T)[::-1]
        keep: list[int] = []
        for i in order:
            chosen = v[keep]
            if not len(keep) or not np.any(np.all(chosen >= v[i], axis=1) & np.any(chosen > v[i], axis=1)):
                keep.append(i)
        kept = rows.iloc[keep]
    if kept is not None:
        yield kept


def encode_response_combinations(df: DataFrame, by: Sequence[str], option: str, selected: str, empty: str = "<none>") -> DataFrame:
    chosen = F.array_join(F.array_sort(F.collect_list(F.when(F.col(selected), F.col(option)))), "|")
    return df.groupBy(*by).agg(chosen.alias("combination")).withColumn("combination", F.when(F.col("combination") == "", empty).otherwise(F.col("combination")))


def classify_item_missingness(df: DataFrame, response: str, reached: str, inspected: str | None = None) -> DataFrame:
    kind = F.when(F.col(response).isNotNull(), "answered").when(~F.coalesce(F.col(reached), F.lit(False)), "not_reached")
    if inspected:
        kind = kind.when(~F.coalesce(F.col(inspected), F.lit(False)), "not_seen")
    return df.withColumn("missingness", kind.otherwise("omitted"))


def targeting_gap(abilities: DataFrame, items: DataFrame, low: float = -4.0, width: float = 0.5, bins: int = 16) -> DataFrame:
    """Share of persons and of information in each ability bin."""
    placed = abilities.select(F.floor((F.col("theta") - low) / width).alias("bin")).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: low + (k + 0.5) * width)
    info = test_information(items, grid).select(F.floor((F.col("theta") - low) / width).alias("bin"), "information")
    both = info.join(placed, "bin", "left").fillna(0, ["n"])
    whole = totalled(both, _n=F.sum("n"), _i=F.sum("information"))
    return whole.withColumns({"person_share": ratio("n", "_n"), "information_share": ratio("information", "_i")}).drop("_n", "_i").withColumn("gap", F.col("person_share") - F.col("information_share"))


def changepoints_by_sic(df: DataFrame, by: Sequence[str], order: str, value: str, min_segment: int = 5) -> DataFrame:
    """Best split of each series by the fall of its Schwarz criterion, from running sums."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    x = finite(value)
    rows = df.filter(x.isNotNull()).select(*by, F.row_number().over(ordered(by, order)).alias("i"), F.sum(x).over(w).alias("s"), F.sum(x * x).over(w).alias("q"), F.sum(x).over(whole).alias("all_s"), F.sum(x * x).over(whole).alias("all_q"), F.count("*").over(whole).alias("n"))
    sse = lambda q, s, k: F.greatest(q - s * s / k, F.lit(1e-12))
    n, i = F.col("n"), F.col("i")
    split = sse(F.col("q"), F.col("s"), i) + sse(F.col("all_q") - F.col("q"), F.col("all_s") - F.col("s"), n - i)
    delta = n * F.ln(sse(F.col("all_q"), F.col("all_s"), n) / n) - (n * F.ln(split / n) + 2 * F.ln(n))
    inside = rows.filter((i >= min_segment) & (n - i >= min_segment)).withColumn("delta_sic", delta)
    return inside.groupBy(*by).agg(F.max_by("i", F.struct("delta_sic", -F.col("i"))).alias("position"), F.max("delta_sic").alias("delta_sic"))


def local_dependence_pairs(pairs: DataFrame, threshold: float = 0.2, absolute: bool = True) -> DataFrame:
    """Pairs of q3 at or beyond the threshold."""
    size = F.abs("q3") if absolute else F.col("q3")
    return pairs.filter(size >= threshold).withColumn("abs_q3", F.abs("q3"))


def item_fit_residuals(rows: DataFrame, item: str, observed: str = "response", expected: str = "p", least: float = 1e-8) -> DataFrame:
    """Mean residual and root mean square of the standardised residuals of each item."""
    v = F.greatest(F.col(expected) * (1 - F.col(expected)), F.lit(least))
    r = finite(observed) - F.col(expected)
    return rows.filter(r.isNotNull()).groupBy(item).agg(F.count("*").alias("n"), F.avg(r).alias("mean_residual"), F.sqrt(F.avg(r * r / v)).alias("rms_standardized_residual"))


def mean_mean_link(reference: DataFrame, focal: DataFrame, item: str = "item_id") -> DataFrame:
    """Slope by the ratio of mean discriminations, and the intercept that aligns mean difficulties: one row."""
    both = reference.select(item, F.col("a").alias("ra"), F.col("b").alias("rb")).join(focal.select(item, F.col("a").alias("fa"), F.col("b").alias("fb")), item)
    slope = ratio(F.avg("fa"), F.avg("ra"))
    return both.agg(F.count("*").alias("n_anchors"), slope.alias("A"), (F.avg("rb") - slope * F.avg("fb")).alias("B"))


def apply_link(items: DataFrame, link: DataFrame) -> DataFrame:
    """Items on the reference scale: a / A and A b + B, of a link's one row."""
    named = link.select(F.col("A").alias("_slope"), F.col("B").alias("_shift"))
    return items.crossJoin(F.broadcast(named)).withColumns({"a": ratio("a", "_slope"), "b": F.col("_slope") * F.col("b") + F.col("_shift")}).drop("_slope", "_shift")


def anchor_audit(items: DataFrame, effects: DataFrame, max_abs_effect: float = 0.1, min_information: float | None = None) -> DataFrame:
    """Whether each item may be an anchor: its effect (item_id, effect) within the limit and enough information at zero."""
    out = items.join(effects.groupBy("item_id").agg(F.max(F.abs("effect")).alias("_e")), "item_id", "left")
    far = F.coalesce(F.col("_e") > max_abs_effect, F.lit(False))
    info = item_information(F.lit(0.0), F.col("a"), F.col("b"))
    weak = info < min_information if min_information is not None else F.lit(False)
    reason = F.when(weak, "information below review threshold").when(far, "DIF effect exceeds review threshold").otherwise("eligible")
    return out.select("item_id", (~far & ~weak).alias("eligible"), reason.alias("reason"), info.alias("information_theta0"))


def threshold_order_audit(items: DataFrame, thresholds: str = "thresholds") -> DataFrame:
    """Whether an item's thresholds rise, their smallest gap, and the places of reversals, from one."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(thresholds) - 1), lambda k: F.get(thresholds, k) - F.get(thresholds, k - 1))
    steps = F.when(F.size(thresholds) > 1, gaps).otherwise(F.array().cast("array<double>"))
    out = items.withColumn("_g", steps)
    return out.withColumns({"ordered": ~F.exists("_g", lambda g: g <= 0), "minimum_gap": F.array_min("_g"), "reversals": F.filter(F.transform("_g", lambda g, k: F.when(g <= 0, k + 1)), lambda k: k.isNotNull())}).drop("_g")


def monotonicity_audit(curves: DataFrame, by: Sequence[str], theta: str = "theta", probability: str = "p", tolerance: float = 1e-8) -> DataFrame:
    """Whether each curve never falls, and its falls."""
    step = F.col(probability) - F.lag(probability).over(ordered(by, theta))
    return curves.withColumn("_d", step).groupBy(*by).agg(F.count_if(F.col("_d") < -tolerance).alias("n_decreases"), F.least(F.lit(0.0), F.min("_d")).alias("largest_decrease")).withColumn("monotone", F.col("n_decreases") == 0)


def category_function_audit(df: DataFrame, probabilities: str, tolerance: float = 1e-8) -> DataFrame:
    """Bounds and sums of arrays of category probabilities: one row."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p)
    out = df.agg(F.max(F.abs(total - 1)).alias("max_sum_error"), F.min(F.array_min(probabilities)).alias("min_probability"), F.max(F.array_max(probabilities)).alias("max_probability"))
    return out.withColumns({"valid_bounds": (F.col("min_probability") >= -tolerance) & (F.col("max_probability") <= 1 + tolerance), "rows_sum_to_one": F.col("max_sum_error") <= tolerance})


def dif_effect_curve(items: DataFrame, grid: Column) -> DataFrame:
    """Difference of the focal (fa, fb) and the reference (a, b) probability of each item along a grid."""
    rows = items.withColumn("theta", F.explode(grid))
    r, f = probability_2pl(F.col("theta"), F.col("a"), F.col("b")), probability_2pl(F.col("theta"), F.col("fa"), F.col("fb"))
    return rows.select("item_id", "theta", r.alias("reference"), f.alias("focal"), (f - r).alias("signed_difference"), F.abs(f - r).alias("absolute_difference"))


def mantel_haenszel_dif(rows: DataFrame, item: str, stratum: str, group: str, focal: object, response: str = "response") -> DataFrame:
    """Common odds ratio of each item over strata, its delta (-2.35 ln) and chi-square with a continuity correction. Counts are all that meet."""
    x, f = finite(response), F.col(group) == focal
    cells = rows.filter(x.isNotNull() & f.isNotNull()).groupBy(item, stratum).agg(F.count_if(~f & (x > 0)).alias("a"), F.count_if(~f & (x <= 0)).alias("b"), F.count_if(f & (x > 0)).alias("c"), F.count_if(f & (x <= 0)).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    # products of four counts pass the largest long at some ten thousand responses a cell
    a, b, c, d = (F.col(k).cast("double") for k in "abcd")
    m, m1, m0, nr, nf = a + b + c + d, a + c, b + d, a + b, c + d
    both = cells.filter((nr > 0) & (nf > 0))
    sums = both.groupBy(item).agg(F.count("*").alias("n_strata"), F.sum(n).alias("n"), ratio(F.sum(a * d / m), F.sum(b * c / m)).alias("odds_ratio"), F.sum("a").alias("_a"), F.sum(nr * m1 / m).alias("_e"), F.sum(F.when(n > 1, nr * nf * m1 * m0 / (m * m * (m - 1)))).alias("_v"))
    corrected = F.greatest(F.abs(F.col("_a") - F.col("_e")) - 0.5, F.lit(0.0))
    return sums.select(item, "n_strata", "n", "odds_ratio", (-2.35 * F.ln("odds_ratio")).alias("delta"), ratio(corrected * corrected, "_v").alias("chi_square"))


def classical_item_statistics(responses: DataFrame, person: str, item: str, response: str = "response") -> DataFrame:
    """Proportion of success of each item, and the correlation of its responses with the persons' other responses."""
    rows = responses.select(person, item, finite(response).alias("x")).filter("x is not null")
    totals = Window.partitionBy(person)
    rest = rows.withColumn("rest", F.sum("x").over(totals) - F.col("x"))
    return rest.groupBy(item).agg(F.count("*").alias("n"), F.avg("x").alias("p"), correlation("x", "rest").alias("item_rest"))


def newton_abilities(responses: DataFrame, items: DataFrame, person: str, item: str = "item_id", rounds: int = 6, prior_sd: float | None = 1.0, bound: float = 6.0) -> DataFrame:
    """Abilities by Newton steps on the 2PL likelihood with a normal prior (MAP), or without one (ML, within the bounds): each round sums gradients and informations by person."""
    data = responses.select(person, item, finite("response").alias("_x")).filter("_x is not null").join(items.select(item, "a", "b"), item).drop(item)
    # a person's responses are a test's length: they stay in one row, so that the rounds are one pass within it
    packed = data.groupBy(person).agg(F.collect_list(F.struct(F.col("_x").alias("x"), "a", "b")).alias("_r"))
    precision = 0.0 if prior_sd is None else 1 / (prior_sd * prior_sd)

    def step(theta: Column) -> Column:
        p = lambda r: probability_2pl(theta, r["a"], r["b"])
        sums = F.aggregate("_r", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), lambda acc, r: F.struct((acc["g"] + r["a"] * (r["x"] - p(r))).alias("g"), (acc["h"] + r["a"] * r["a"] * p(r) * (1 - p(r))).alias("h")))
        moved = theta + (sums["g"] - precision * theta) / F.greatest(sums["h"] + precision, F.lit(1e-6))
        return F.least(F.greatest(moved, theta - 1, F.lit(-bound)), theta + 1, F.lit(bound))

    out = packed.withColumn("theta", F.lit(0.0))
    for _ in range(rounds):
        out = out.select(F.inline(F.array(F.struct(person, "_r", step(F.col("theta")).alias("theta")))))
    return out.select(person, F.size("_r").alias("n_items"), "theta")
