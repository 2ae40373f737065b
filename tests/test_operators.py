"""Operators on small literal tables with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ocularis.errors import ValidationError
from ocularis.functions import ranks
from ocularis.operators import aoi, events, features, irt, reliability, scanpaths, survival, timebase, trials, validation, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ivt_first_sample_and_gap(spark):
    rows = [("r", t / 100, x, 0.0) for t, x in [(0, 0.0), (1, 0.1), (2, 0.2), (3, 9.0), (4, 9.1), (5, 9.2), (30, 9.3), (31, 9.3)]]
    got = events.detect_fixations_ivt(frame(spark, rows, "g string, t double, x double, y double"), "t", ["g"], "x", "y", 30.0, 0.01).orderBy("start_time").collect()
    assert [(round(r["start_time"], 2), r["n_samples"]) for r in got] == [(0.0, 3), (0.04, 2), (0.3, 2)]


def test_idt(spark):
    rows = [("r", float(t), float(x), 0.0) for t, x in enumerate([0, 0.2, 0.1, 5, 5.1, 5.2, 9])]
    got = events.detect_fixations_idt(frame(spark, rows, "g string, t double, x double, y double"), "t", ["g"], "x", "y", 1.0, 1.5).orderBy("start_time").collect()
    assert [(r["start_time"], r["end_time"], r["n_samples"]) for r in got] == [(0.0, 2.0, 3), (3.0, 5.0, 3)]


def test_rolling_median_skips_missing(spark):
    rows = [("r", 0, 1.0), ("r", 1, None), ("r", 2, 3.0), ("r", 3, float("nan")), ("r", 4, 10.0)]
    got = events.filter_gaze(frame(spark, rows, "g string, t long, x double"), "t", ["g"], ["x"], "median", 3).orderBy("t").collect()
    assert [r["x"] for r in got] == [1.0, 2.0, 3.0, 6.5, 10.0]


def test_interpolation_is_bounded(spark):
    rows = [("r", float(t), x) for t, x in [(0, 1.0), (1, None), (2, 3.0), (10, None), (20, 5.0), (21, None)]]
    got = events.interpolate_pupil(frame(spark, rows, "g string, t double, pupil_diameter double"), "t", ["g"], max_gap=5.0).orderBy("t").collect()
    assert [r["pupil_diameter"] for r in got] == [1.0, 2.0, 3.0, None, 5.0, None]
    assert [r["pupil_interpolated"] for r in got] == [False, True, False, False, False, False]


def test_matching_is_one_to_one(spark):
    a = frame(spark, [("r", 0.0, 10.0), ("r", 20.0, 30.0)], "g string, start_time double, end_time double")
    b = frame(spark, [("r", 1.0, 10.0), ("r", 0.0, 9.5), ("r", 26.0, 40.0)], "g string, start_time double, end_time double")
    got = events.match_detected_events(a, b, ["g"], 5.0, 0.1).orderBy("a_start").collect()
    assert [(r["a_start"], r["b_start"]) for r in got] == [(0.0, 0.0), (20.0, 26.0)]
    row = events.compare_event_catalogues(a, b, ["g"], 5.0).first()
    assert row["recall"] == 1 and row["precision"] == pytest.approx(2 / 3)


def test_confusion_matrix(spark):
    a = frame(spark, [("r", 0.0, 2.0, "fix")], "g string, start_time double, end_time double, event_type string")
    b = frame(spark, [("r", 1.0, 3.0, "sac")], "g string, start_time double, end_time double, event_type string")
    got = {(r["truth"], r["detected"]): r["count"] for r in events.event_confusion_matrix(a, b, ["g"], 1.0).collect()}
    assert got == {("fix", "none"): 1, ("fix", "sac"): 2, ("none", "sac"): 1}


def test_trials_and_assignment(spark):
    marks = frame(spark, [("r", 0.0, "TRIAL_START"), ("r", 5.0, "trial_end x"), ("r", 6.0, "TRIAL_START"), ("r", 7.0, "TRIAL_START"), ("r", 9.0, "TRIAL_END")], "g string, t double, event_name string")
    found = trials.build_trials(marks, "t", ["g"])
    assert [(r["start_time"], r["end_time"]) for r in found.orderBy("start_time").collect()] == [(0.0, 5.0), (7.0, 9.0)]
    points = frame(spark, [("r", k, float(k)) for k in range(11)], "g string, id long, t double")
    got = trials.assign_trials(points, found.withColumn("at", F.col("trial_index")), "t", ["g"], "id", "trial_index", "at", 2.0).orderBy("id").collect()
    assert [r["trial_index"] for r in got] == [1, 1, 1, 1, 1, 1, None, 3, 3, 3, None]


def test_aoi_shapes(spark):
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    shapes = frame(spark, [("r", 1, "rectangle", 0.0, 0.0, 4.0, 4.0, None), ("e", 2, "circle", 5.0, 5.0, 4.0, 2.0, None), ("p", 3, "polygon", 0.0, 0.0, 10.0, 10.0, tri)], "aoi_id string, aoi_order int, shape_type string, x0 double, y0 double, width double, height double, vertices array<struct<x:double,y:double>>")
    points = frame(spark, [(1, 1.0, 1.0), (2, 5.0, 5.9), (3, 6.0, 3.0), (4, 9.0, 9.0), (5, None, 1.0)], "id int, x double, y double")
    first = {r["id"]: r["aoi_id"] for r in aoi.assign_aois(points, shapes, "x", "y", ["id"]).collect()}
    every = {r["id"]: r["aoi_id"] for r in aoi.assign_aois(points, shapes, "x", "y", ["id"], overlap="all").collect()}
    assert first == {1: "r", 2: "e", 3: "p", 4: None, 5: None} and every[1] == "r|p"


def test_perturbed_boxes(spark):
    boxes = frame(spark, [("left", 1, "rectangle", 0.0, 0.0, 100.0, 40.0), ("right", 2, "rectangle", 110.0, 0.0, 100.0, 40.0)], "aoi_id string, aoi_order int, shape_type string, x0 double, y0 double, width double, height double")
    points = frame(spark, [(k, 5.0 * k, 20.0) for k in range(45)] + [(99, None, 20.0)], "id int, x double, y double")
    for scale, reach in ((1.0, 0.0), (1.2, 10.0), (0.5, -25.0)):
        moved = aoi.perturb_aois(boxes, frame(spark, [("p", 3.0, 0.0, scale)], "perturbation_id string, dx double, dy double, scale double"))
        got = {r["id"]: r["aoi_id"] for r in aoi.assign_aois(points, moved, "x", "y", ["id"], overlap="all").collect()}
        for k in range(45):
            inside = [n for n, x0 in (("left", 3.0), ("right", 113.0)) if x0 - reach <= 5.0 * k <= x0 + 100 + reach]
            assert got[k] == ("|".join(inside) or None)
        assert got[99] is None


def test_dynamic_aoi(spark):
    keys = frame(spark, [("a", 0.0, 0.0, 0.0, 2.0, 2.0), ("a", 10.0, 10.0, 0.0, 2.0, 2.0)], "aoi string, timestamp double, x0 double, y0 double, width double, height double")
    points = frame(spark, [(1, 5.0, 6.0, 1.0), (2, 5.0, 0.5, 1.0), (3, 20.0, 1.0, 1.0), (4, 5.0, None, 1.0)], "id int, t double, x double, y double")
    got = {r["id"]: r["status"] for r in aoi.assign_dynamic_aoi(points, keys, "t", "x", "y", "id", 3.0).collect()}
    assert got == {1: "assigned", 2: "outside", 3: "no_active_aoi", 4: "missing_gaze"}


def test_structural_zero_and_null(spark):
    rows = [("p", True, "a", 2.0), ("p", True, None, 1.0), ("q", False, None, 1.0)]
    levels = frame(spark, [("a",), ("b",)], "aoi_id string")
    got = {(r["g"], r["aoi_id"]): r["n_fixations"] for r in aoi.recompute_aoi_features(frame(spark, rows, "g string, valid boolean, aoi_id string, d double"), ["g"], levels, duration="d").collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 0, ("q", "a"): None, ("q", "b"): None}


def test_sequences_and_entropy(spark):
    rows = frame(spark, [("r", k, a) for k, a in enumerate("aabbc")] + [(None, 9, "a")], "g string, t int, aoi string")
    got = features.scanpath_sequence(rows, "t", ["g"], "aoi").collect()
    assert [(r["scanpath"], r["n_steps"]) for r in got] == [("a > b > c", 3)]
    assert features.gaze_entropy(rows, ["g"], "aoi").first()["gaze_entropy"] == pytest.approx(1.5219280948873621)


def test_distances(spark):
    pairs = frame(spark, [(["a", "b", "c"], ["a", "c"]), ([], ["a"]), (["a"], []), (["x", "y"], ["x", "y"])], "a array<string>, b array<string>")
    assert [r["levenshtein"] for r in scanpaths.levenshtein_scanpath(pairs, "a", "b", False).collect()] == [1.0, 1.0, 1.0, 0.0]
    paths = frame(spark, [([0.0, 1.0], [0.0, 0.0], [0.0, 1.0, 1.0], [0.0, 0.0, 0.0])], "ax array<double>, ay array<double>, bx array<double>, by array<double>")
    assert scanpaths.dynamic_time_warping_distance(paths, "ax", "ay", "bx", "by").first()["dtw"] == 0


def test_survival_reaches_zero(spark):
    data = frame(spark, [(1.0, True), (2.0, False), (3.0, True), (3.0, True)], "analysis_time double, event_observed boolean")
    got = survival.estimate_gaze_survival(data).orderBy("time").collect()
    assert [r["survival"] for r in got] == pytest.approx([0.75, 0.0])
    assert survival.estimate_gaze_latency_quantiles(survival.estimate_gaze_survival(data)).first()["q50"] == 3.0


def test_reliability(spark):
    rows = [(p, s, float(p * 10 + s)) for p in range(4) for s in range(3)]
    icc = reliability.process_icc(frame(spark, rows, "p int, s int, v double"), "p", "s", "v").first()
    assert icc["n"] == 4 and 0.98 < icc["icc"] < 1
    got = reliability.decompose_within_between(frame(spark, [("a", 1.0), ("a", 3.0), ("b", None)], "p string, v double"), ["v"], "p").orderBy("p", "v").collect()
    assert [r["v_within"] for r in got] == [-1.0, 1.0, None]


def test_windows_hold_their_samples(spark):
    rows = frame(spark, [("p", float(t), float(t)) for t in range(0, 3000, 100)], "p string, t double, v double")
    got = windows.extract_process_windows(rows, ["p"], "t", ["v"], windows.WindowSpecification()).orderBy("window_start").collect()
    assert [(r["window_start"], r["n_samples"]) for r in got] == [(s, 10) for s in (0.0, 500.0, 1000.0, 1500.0, 2000.0)]
    assert got[1]["v_mean"] == 950 and got[1]["v_slope"] == pytest.approx(1)


def test_irt_forms(spark):
    row = spark.range(1).select(irt.probability_2pl(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("p"), irt.probability_grm(F.lit(0.3), F.lit(1.2), F.array(F.lit(-1.0), F.lit(1.0))).alias("g"), irt.probability_gpcm(F.lit(0.3), F.lit(1.2), F.array(F.lit(-1.0), F.lit(1.0))).alias("c"), irt.expected_category(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).alias("e")).first()
    assert row["p"] == 0.5 and sum(row["g"]) == pytest.approx(1) and sum(row["c"]) == pytest.approx(1) and len(row["c"]) == 3 and row["e"] == pytest.approx(1.3)


def test_clock(spark):
    pairs = frame(spark, [(float(x), 2.0 * x + 3) for x in range(5)], "a double, b double")
    fit = timebase.estimate_clock_transform(pairs, "a", "b")
    assert (fit.slope, fit.offset) == pytest.approx((2, 3)) and fit.max_abs_residual == pytest.approx(0, abs=1e-9)


def test_folds_and_leakage(spark):
    rows = frame(spark, [(p, i) for p in range(20) for i in range(10)], "p int, i int")
    got = validation.crossed_grouped_folds(rows, ["p", "i"])
    roles = {r["role"]: r["count"] for r in got.groupBy("role").count().collect()}
    assert sum(roles.values()) == 200 and got.filter("role = 'analysis' and (fold_p = 1 or fold_i = 1)").count() == 0
    leak = validation.audit_temporal_leakage(frame(spark, [(1.0, 2.0), (3.0, 2.0), (2.0, 2.0)], "a double, o double"), "a", "o")
    assert [r["leak"] for r in leak.collect()] == [False, True, False]


def test_normal_cdf(spark):
    from ocularis.functions.columns import chi2_quantile, normal_cdf

    got = spark.range(1).select(normal_cdf(F.lit(1.96)).alias("p")).first()["p"]
    assert got == pytest.approx(0.5 * math.erfc(-1.96 / math.sqrt(2)), abs=1e-7)
    assert chi2_quantile(0.975, 3) == pytest.approx(9.3484, rel=0.01)


def test_pareto_of_three_objectives_and_of_two(spark):
    r = random.Random(3)
    rows = [(k, float(r.randint(0, 9)), float(r.randint(0, 9)), float(r.randint(0, 9))) for k in range(200)]

    def front(n):
        better = lambda p, q: all(a >= b for a, b in zip(p, q, strict=True)) and p != q
        return sorted(k for k, *v in rows if not any(better(w[:n], v[:n]) for _, *w in rows))

    items = frame(spark, rows, "id int, a double, b double, c double").repartition(3)
    for n in (2, 3):
        assert sorted(x["id"] for x in irt.pareto_front(items, "id", ["a", "b", "c"][:n]).collect()) == front(n)


def test_hashed_ranks_and_running_sums(spark):
    rows = [("a" if k % 3 else None, k, float(k * k % 97)) for k in range(300)]
    df = frame(spark, rows, "g string, k int, v double").repartition(4)
    ranked = ranks.hashed_rank(df, ranks.seeded_digest(1, "k"), ["k"], ["g"]).collect()
    assert {g: sorted(r["rank"] for r in ranked if r["g"] == g) for g in ("a", None)} == {"a": list(range(1, 201)), None: list(range(1, 101))}
    got = {r["k"]: (r["s"], r["m"]) for r in ranks.running(df, "k", {"s": (F.sum, F.col("v")), "m": (F.max, F.col("v"))}, ["g"], descending=True).collect()}
    for g, k, _ in rows:
        later = [v for h, j, v in rows if h == g and j >= k]
        assert got[k] == (sum(later), max(later))


def test_fewer_groups_than_folds_are_refused(spark):
    df = frame(spark, [("a",), ("b",), ("b",), (None,)], "g string")
    with pytest.raises(ValidationError):
        validation.grouped_folds(df, "g", 3)
    assert sorted((r["g"], r["fold"]) for r in validation.grouped_folds(df.filter("g is not null"), "g", 2).distinct().collect()) in ([("a", 1), ("b", 2)], [("a", 2), ("b", 1)])


def test_drift_keeps_items_of_one_batch(spark):
    rows = [("x", 1, 1.0), ("x", 2, None), ("x", 3, 5.0), ("y", 1, 2.0), ("y", 2, 2.1), ("z", 2, 9.0)]
    got = {r["item"]: r for r in windows.audit_process_drift(frame(spark, rows, "item string, b int, m double"), "item", "b", ["m"], limits={"m": 1.0}).collect()}
    assert (got["x"]["m_baseline"], got["x"]["m_latest"], got["x"]["n_batches"], got["x"]["drift_status"]) == (1.0, 5.0, 3, "review_item_or_stimulus_context")
    assert got["y"]["drift_status"] == "no_review_flag" and got["z"]["drift_status"] == "insufficient_batches_for_drift_review"
