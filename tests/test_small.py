"""Operators without a query, on tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from ocularis.operators import aoi, events, features, quality, reliability, scanpaths, timebase, validation, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_adaptive_threshold_lies_above_a_noisy_recordings_own_speed(spark):
    still = [("calm", k / 8, 0.25 * (k % 2) + (50.0 if k >= 40 else 0.0)) for k in range(80)]
    noisy = [("noisy", k / 8, 1.0 * (k % 2)) for k in range(80)]
    got = events.detect_fixations_adaptive(frame(spark, still + noisy, "g string, t double, x double"), "t", ["g"], "x", None, 1.0, 3.0, 0.06, 0.2).collect()
    assert sorted((r["g"], r["start_time"], r["n_samples"]) for r in got) == [("calm", 0.0, 40), ("calm", 41 / 8, 39), ("noisy", 0.0, 80)]


def test_bootstrap_of_equal_persons_has_no_spread(spark):
    rows = [(p, 5.0) for p in range(20) for _ in range(3)]
    got = reliability.bootstrap_person_means(frame(spark, rows, "p int, m double"), "p", "m", 100).first()
    assert got["mean"] == pytest.approx(5) and got["se"] == pytest.approx(0) and got["replications"] == 100
    spread = frame(spark, [(p, float(p)) for p in range(100)], "p int, m double")
    a, b = (reliability.bootstrap_person_means(spread.repartition(n), "p", "m", 300).first() for n in (1, 4))
    assert list(a) == pytest.approx(list(b)) and a["mean"] == pytest.approx(49.5, abs=1) and a["se"] == pytest.approx(29.0 / 10, rel=0.2)


def test_dependability_of_designs(spark):
    got = {(r["items"], r["devices"]): r for r in reliability.design_process_dstudy({"person": 4.0, "item": 2.0, "device": 1.0, "residual": 3.0}, [1, 4], [1], [1, 2], spark).collect()}
    assert got[4, 2]["relative_error"] == pytest.approx(2 / 4 + 3 / 8) and got[4, 2]["absolute_error"] == pytest.approx(0.875 + 0.5)
    assert got[4, 2]["dependability"] == pytest.approx(4 / (4 + 1.375)) and got[1, 1]["dependability"] == pytest.approx(4 / 10)


def test_medoid_and_dispersion(spark):
    pairs = frame(spark, [("s", 1, 2, 1.0), ("s", 1, 3, 2.0), ("s", 2, 3, 4.0)], "g string, a int, b int, distance double")
    assert scanpaths.representative_scanpath(pairs, ["g"]).first()["medoid"] == 1
    assert {r["path"]: r["dispersion"] for r in scanpaths.scanpath_dispersion(pairs, ["g"]).collect()} == {1: 1.5, 2: 2.5, 3: 3.0}
    paths = frame(spark, [("s", k, [float(k)]) for k in (1, 2, 3)] + [("z", 9, [0.0])], "g string, k int, x array<double>")
    assert sorted((r["a"], r["b"]) for r in scanpaths.path_pairs(paths, ["g"], "k", ["x"]).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_ranks_of_metrics(spark):
    rows = [("lev", "a", 0.2), ("lev", "b", 0.1), ("lev", "c", 0.2), ("sim", "a", 0.9), ("sim", "b", 0.1), ("sim", "c", 0.5)]
    got = {(r["metric"], r["candidate"]): r["rank"] for r in scanpaths.scanpath_metric_ranks(frame(spark, rows, "metric string, candidate string, value double"), [], ["sim"]).collect()}
    assert got == {("lev", "b"): 1, ("lev", "a"): 2, ("lev", "c"): 2, ("sim", "a"): 1, ("sim", "c"): 2, ("sim", "b"): 3}


def test_shares_of_statuses(spark):
    got = {r["status"]: (r["count"], r["fraction"]) for r in aoi.audit_dynamic_aoi_coverage(frame(spark, [("assigned",)] * 3 + [("outside",)], "status string")).collect()}
    assert got == {"assigned": (3, 0.75), "outside": (1, 0.25)}


def test_snapshot_hash_ignores_order(spark):
    rows = [(k, str(k * k)) for k in range(50)]
    hashes = [validation.snapshot_hash(frame(spark, r, "a int, b string").repartition(n), ["a", "b"]).first() for r, n in ((rows, 1), (rows[::-1], 5), ([*rows[1:], (0, "1")], 2))]
    assert hashes[0] == hashes[1] != hashes[2]


def test_window_summary(spark):
    w = frame(spark, [("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, m double")
    got = {r["g"]: (r["n_windows"], r["m_mean"]) for r in windows.summarize_process_windows(w, ["m"], ["g"]).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 2.0)}


def test_preflight_splits_groups(spark):
    rows = [("good", 0.9, 0.1, 1.0)] * 6 + [("bad", 0.1, 0.9, 1.0)] * 2
    audit = windows.audit_biometric_preflight(frame(spark, rows, "g string, v double, m double, e double"), ["g"], "v", "m", "e")
    assert [r["g"] for r in windows.preflight_passed(audit).collect()] == ["good"] and [r["g"] for r in windows.preflight_failures(audit).collect()] == ["bad"]


def test_clock_transform_of_markers(spark):
    rows = [(float(k), 3.0 + 2.0 * k) for k in range(5)]
    found = timebase.estimate_clock_transform(frame(spark, rows, "s double, t double"), "s", "t")
    assert (found.slope, found.offset, found.n_markers) == (pytest.approx(2), pytest.approx(3), 5)
    moved = timebase.apply_clock_transform(frame(spark, rows, "s double, t double"), found, ["s"]).orderBy("t").collect()
    assert [r["s"] for r in moved] == pytest.approx([r["t"] for r in moved])
    assert timebase.clock_fits(frame(spark, rows, "s double, t double"), "s", "t", (), "offset").first()["offset"] == pytest.approx(5)


def test_sampling_summaries(spark):
    rows = [("g", k * 0.01, 0.0) for k in range(11)]
    df = frame(spark, rows, "g string, t double, x double")
    assert quality.effective_sampling_frequency(df, "t", ["g"]).first()["sampling_hz"] == pytest.approx(100)
    assert quality.audit_sampling_irregularity(df, "t", ["g"]).count() == 1
    assert quality.summarise_sampling_quality(df, "t", ["g"]).first()["interval_median"] == pytest.approx(0.01)


def test_shares_of_all_transitions(spark):
    df = frame(spark, [("r", k, a) for k, a in enumerate("abab")], "g string, t int, a string")
    got = {(r["from_aoi"], r["to_aoi"]): r["share"] for r in features.transition_matrix(df, "t", ["g"], "a", "all").collect()}
    assert got == {("a", "b"): pytest.approx(2 / 3), ("b", "a"): pytest.approx(1 / 3)}


def test_jitter_is_nearly_normal_and_the_same_every_time(spark):
    one = frame(spark, [("a", 10.0, 20.0, 5.0, 5.0)], "aoi_id string, x0 double, y0 double, width double, height double")
    a, b = (aoi.jitter_aois(one, 2.0, 2_000).agg(F.avg("x0"), F.stddev_samp("x0"), F.corr("x0", "y0")).first() for _ in range(2))
    assert a == b and a[0] == pytest.approx(10, abs=0.2) and a[1] == pytest.approx(2, rel=0.1) and abs(a[2]) < 0.1


def test_degrees_of_a_pixel():
    assert aoi.degrees_per_pixel(1000, 500.0, 1000.0) == pytest.approx(math.degrees(2 * math.atan(0.00025)))
