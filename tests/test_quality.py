"""Quality measures against closed forms on two short paths: one between two points 5 apart, one up a line in steps of 2 with a gap."""

import math

import pytest

from ocularis.operators import quality

BACK_AND_FORTH = [("P", 5 * k, 3.0 * (k % 2), 4.0 * (k % 2), 0.0, 0.0, True) for k in range(6)]
UP_A_LINE = [("Q", 20 * k, 7.0, 2.0 * k, 4.0, 0.0, True) for k in range(3)] + [("Q", 60, float("nan"), None, 4.0, 0.0, False)] + [("Q", 20 * k, 7.0, 2.0 * k, 4.0, 0.0, True) for k in (4, 5)]


@pytest.fixture(scope="module")
def gaze(spark):
    return spark.createDataFrame(BACK_AND_FORTH + UP_A_LINE, "g string, t long, x double, y double, tx double, ty double, valid boolean")


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def test_accuracy(gaze):
    got = by_group(quality.compute_gaze_accuracy(gaze, "x", "y", "tx", "ty", ["g"]))
    assert got["P"]["accuracy_mean"] == got["P"]["accuracy_median"] == 2.5 and got["P"]["n_targets"] == 1
    assert got["Q"]["accuracy_mean"] == pytest.approx(sum(math.hypot(3, y) for y in (0, 2, 4, 8, 10)) / 5) and got["Q"]["n"] == 5
    assert got["Q"]["mean_abs_dx"] == 3 and got["Q"]["mean_abs_dy"] == pytest.approx(4.8)


def test_rms_never_bridges_a_gap(gaze):
    got = by_group(quality.compute_rms_s2s(gaze, "x", "y", "t", ["g"]))
    assert (got["P"]["n_steps"], got["Q"]["n_steps"]) == (5, 3)
    assert got["P"]["precision_rms_s2s"] == 5 and got["Q"]["precision_rms_s2s"] == 2


def test_sd_and_bcea(gaze):
    sd = by_group(quality.compute_gaze_sd_precision(gaze, "x", "y", ["g"]))
    assert (sd["P"]["sd_x"], sd["P"]["sd_y"], sd["P"]["precision_sd"]) == (1.5, 2, 2.5) and sd["Q"]["sd_x"] == 0
    area = by_group(quality.compute_bcea(gaze, "x", "y", ["g"]))
    assert area["P"]["rho"] == pytest.approx(1) and area["P"]["bcea"] == pytest.approx(0, abs=1e-6) and area["Q"]["bcea"] == 0


def test_bcea_of_a_square(spark):
    rows = [("a", x, y) for x in (0.0, 2.0) for y in (0.0, 2.0)]
    got = quality.compute_bcea(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).first()
    assert got["bcea"] == pytest.approx(2 * math.pi * -math.log(0.32))


def test_rate_and_loss(gaze):
    rate = by_group(quality.estimate_effective_sampling_rate(gaze.filter("valid"), "t", ["g"], 1e-3))
    assert rate["P"]["effective_hz"] == pytest.approx(200) and rate["Q"]["effective_hz"] == pytest.approx(5 / 0.12)
    loss = by_group(quality.compute_gaze_data_loss(gaze, "x", "y", "t", ["g"], "valid"))
    assert loss["Q"]["loss_fraction"] == pytest.approx(1 / 6) and loss["Q"]["n_loss_runs"] == 1 and loss["P"]["loss_fraction"] == 0
    valid = by_group(quality.compute_valid_sample_fraction(gaze, "x", "y", "valid", ["g"]))
    assert valid["Q"]["valid_fraction"] == pytest.approx(5 / 6)


def test_empty(gaze):
    assert quality.compute_bcea(gaze.limit(0), "x", "y", ["g"]).count() == 0
