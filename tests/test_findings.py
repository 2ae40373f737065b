"""A small case for each finding of a review that its code would have failed before."""

import math
import re
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from ocularis.functions.rounds import Table
from ocularis.operators import aoi, events, irt, latent, linear, scanpaths


def test_mantel_haenszel_of_many_responses(spark):
    # products of four counts of 200,000 each exceed a long
    rows = spark.range(800_000).select(F.lit(1).alias("item"), F.lit("k").alias("stratum"), F.when(F.col("id") % 2 == 0, "F").otherwise("R").alias("g"), ((F.col("id") % 4 < 2) != (F.col("id") % 10 == 0)).cast("int").alias("response"))
    got = irt.mantel_haenszel_dif(rows, "item", "stratum", "g", "F").first()
    n = {(g, x): sum(1 for i in range(20) if ("F" if i % 2 == 0 else "R") == g and int((i % 4 < 2) ^ (i % 10 == 0)) == x) * 40_000 for g in "RF" for x in (1, 0)}
    a, b, c, d = n["R", 1], n["R", 0], n["F", 1], n["F", 0]
    t = a + b + c + d
    gap, v = max(abs(a - (a + b) * (a + c) / t) - 0.5, 0), (a + b) * (c + d) * (a + c) * (b + d) / (t * t * (t - 1))
    assert got["n"] == t and got["odds_ratio"] == pytest.approx(a * d / (b * c)) and got["chi_square"] == pytest.approx(gap * gap / v)


def test_decisions_at_the_quantile(spark):
    for confidence in (0.8, 0.9, 0.95):
        limit = NormalDist().inv_cdf(confidence)
        rows = [(s * (limit + d), 1.0, ("above" if s > 0 else "below") if d > 0 else "uncertain") for s in (1, -1) for d in (1e-9, -1e-9)] + [(1.0, 0.0, "uncertain")]
        got = irt.classification_precision(spark.createDataFrame(rows, "theta double, se double, want string"), 0.0, confidence).collect()
        assert [r["decision"] for r in got] == [r["want"] for r in got]


def test_equal_items_go_by_the_smallest_id(spark):
    bank = spark.createDataFrame([(7, 1.0, 0.4), (3, 1.0, 0.4), (9, 1.0, 0.4), (1, 0.5, 0.4), (2, None, 0.4), (4, float("nan"), 0.4)], "item_id long, a double, b double")
    assert tuple(irt.item_selection(bank, 0.4).first()) == (3, 0.25)
    assert irt.item_selection(bank, 0.4, bank.select("item_id").filter("item_id = 3")).first()["item_id"] == 7


def test_points_just_the_radius_apart(spark):
    pairs = [(11.77, 6.56, 14.17, 8.36), (6.4, 4.69, 8.8, 6.49), (6.8, 5.59, 8.6, 7.99), (4.63, 3.0, 6.43, 5.4), (15.56, 6.6, 16.4, 9.48), (2.55, 5.34, 4.95, 7.14)]
    rows = [(g, t, x, y) for g, (a, b, c, d) in enumerate(pairs) for t, (x, y) in enumerate(((a, b), (c, d)))]
    want = [g for g, (a, b, c, d) in enumerate(pairs) if math.sqrt((a - c) * (a - c) + (b - d) * (b - d)) <= 3.0]
    got = scanpaths.recurrence_points(spark.createDataFrame(rows, "g int, t int, x double, y double"), ["g"], "t", "x", "y", 3.0)
    assert sorted(r["g"] for r in got.collect()) == want


def grouped_in_pandas(df):
    return "FlatMapGroupsInPandas" in df._jdf.queryExecution().toString()


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    yield
    spark.conf.set(name, before)


def test_many_short_pieces_of_fixations(spark, tiny_batches):
    # a group of the function is a task and not a piece; pieces go on in the next batch
    rows = [(g, float(t), 100.0 * (t // 4) + t % 4 * 0.1, 0.0) for g in [*range(20), None] for t in range(12)]
    found = events.detect_fixations_idt(spark.createDataFrame(rows, "g int, t double, x double, y double"), "t", ["g"], "x", "y", 1.0, 2.5)
    assert not grouped_in_pandas(found)
    got = sorted((-1 if r["g"] is None else r["g"], r["start_time"], r["end_time"], r["n_samples"], round(r["centroid_x"], 6)) for r in found.collect())
    assert got == [(g, 4.0 * k, 4.0 * k + 3, 4, 100.0 * k + 0.15) for g in range(-1, 20) for k in range(3)]


def test_many_short_runs_of_changes(spark, tiny_batches):
    rows = [(g, t, float((t // 6 + g) % 2) * (1 + t % 5)) for g in range(5) for t in range(60)]
    df = spark.createDataFrame(rows, "g int, t int, x double")
    found = scanpaths.detect_process_changepoints(df, "t", ["g"], ["x"], 3, 0.6, 4)
    assert not grouped_in_pandas(found)
    scored = {(r["g"], r["t"] + 1): r["change_score"] for r in scanpaths.change_scores(df, "t", ["g"], ["x"], 3).collect() if r["change_score"] is not None}
    want = []
    for g in range(5):
        own = sorted((s, -p) for (h, p), s in scored.items() if h == g)
        at = 0.6 * (len(own) - 1)
        low = own[int(at)][0]
        limit = low + (own[min(int(at) + 1, len(own) - 1)][0] - low) * (at - int(at))
        chosen: list[int] = []
        for s, p in sorted(own, reverse=True):
            if s >= limit and s > 0 and all(abs(-p - c) >= 4 for c in chosen):
                chosen.append(-p)
        want += [(g, c) for c in chosen]
    assert sorted((r["g"], r["position"]) for r in found.collect()) == sorted(want)


def test_many_groups_of_matched_events(spark, tiny_batches):
    span = "g int, start_time double, end_time double"
    a = spark.createDataFrame([(g, 10.0 * k, 10.0 * k + 4) for g in [*range(9), None] for k in range(5)], span)
    b = spark.createDataFrame([(g, 10.0 * k + d, 10.0 * k + 4) for g in [*range(9), None] for k in range(5) for d in (1, 2)], span)
    for by, n in ((["g"], 45), ([], 5)):
        left, right = (x.filter("g is not null") if by else x.filter("g = 0").drop("g") for x in (a, b))
        found = events.match_detected_events(left, right, by, 7.0)
        assert not grouped_in_pandas(found)
        got = found.collect()
        assert len(got) == n and all(r["b_start"] - r["a_start"] == 1 for r in got)


def test_separation_of_equal_and_many_rectangles(spark, monkeypatch):
    # no row a pair: equal rectangles are one with a number, blocks meet in one row
    monkeypatch.setattr(aoi, "SIDE", 4)
    rows = [(g, f"p{k % 55}", k * 7 % 13 * 10.0 if k % 9 else None, k * 5 % 11 * 4.0, 30.0, 8.0) for g in ("a", "b", None) for k in range(60)]
    boxes = spark.createDataFrame(rows, "stimulus_id string, aoi_id string, x0 double, y0 double, width double, height double")
    want = aoi.audit_aoi_separation(boxes).groupBy("status").agg(F.count("*"), F.sum("overlap_area"), F.sum("gap"))
    found = aoi.summarise_aoi_separation(boxes)
    assert "aoi_id <" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(s, n, pytest.approx(o), pytest.approx(g)) for s, n, o, g in sorted(map(tuple, want.collect()))]


def test_hidden_states_of_many_pieces_at_once(spark, monkeypatch):
    # kernels go through all pieces of a chunk together; a chunk's size changes nothing
    rows = [(g, float(t), math.sin(g * 7.1 + t * t * 0.37) + (t // 5 % 2) * 2) for g in range(9) for t in range(2 + g * 4)]
    pieces, centre, scale = latent.sequence_pieces(spark.createDataFrame(rows, "g int, t double, x double"), "g", "t", ["x"], 8)
    fit = latent.States(("x",), tuple(centre), tuple(scale), (0.6, 0.4), ((0.8, 0.2), (0.3, 0.7)), ((-0.8,), (0.9,)), ((0.7,), (0.6,)), (0.0,), True)
    found = []
    for size in (1, 40, 1 << 18):
        monkeypatch.setattr(latent, "CHUNK", size)
        shares = {(r["g"], r["t"]): r["probabilities"] for r in latent.posteriors(fit, pieces, "g", "t").collect()}
        states = {(r["g"], r["t"]): r["state"] for r in latent.paths(fit, pieces, "g", "t").collect()}
        found.append((sorted(states.items()), shares))
    assert len(found[0][1]) == len(rows)
    for states, shares in found[1:]:
        assert states == found[0][0] and all(shares[k] == pytest.approx(v) for k, v in found[0][1].items())


def test_factors_are_absorbed_over_their_combinations(spark, monkeypatch):
    # the passes write a row a combination of levels, and rows once
    written = []
    monkeypatch.setattr(linear, "Table", lambda df, what: written.append(df.count()) or Table(df, what))
    rows = [(k % 3, k % 4 if k % 7 else 0, float(k * k % 17), float(k % 5)) for k in range(240)]
    got = linear.without_factors(spark.createDataFrame(rows, "f int, g int, y double, x double"), ["y", "x"], ["f", "g"])
    assert written.count(240) == 1 and max(written[:-1]) == 12
    for factor in "fg":
        assert all(abs(v) < 1e-8 for r in got.groupBy(factor).agg(F.avg("y"), F.avg("x")).collect() for v in r[1:])


def test_calibration_rounds_keep_responses_in_place(spark, monkeypatch):
    # a round writes rows of items and not of persons; long persons and many items go by plain rows, with the same results
    from ocularis.operators import calibration

    written = []
    monkeypatch.setattr(calibration, "Table", lambda df, what: written.append((what, df.count())) or Table(df, what))
    rows = [(p if p % 50 else None, f"i{k}", float(math.sin(p * 12.9 + k * 78.2) + (p % 7 - 3) * (0.3 + k * 0.1) > k * 0.2 - 0.6)) for p in range(200) for k in range(6) if (p + k) % 5]
    df = spark.createDataFrame(rows, "person int, item string, response double")
    found = []
    for long, items, chunk in ((100_000, 1_000_000, 1 << 17), (8, 1_000_000, 12), (100_000, 3, 1 << 17)):
        for name, value in (("LONG", long), ("ITEMS", items), ("CHUNK", chunk)):
            monkeypatch.setattr(calibration, name, value, raising=False)
        written.clear()
        fit = calibration.calibrate(df, "person", "item", rounds=3)
        found.append((fit.log_likelihoods, {r["item"]: tuple(r)[1:] for r in fit.items.collect()}))
        if items > 6:
            assert max(n for what, n in written if what not in ("calibration-rows", "calibration-used", "calibration-persons")) <= 7
    for likelihoods, fitted in found[1:]:
        assert likelihoods == pytest.approx(found[0][0]) and all(v[1] == "estimated" and v == pytest.approx(fitted[k]) for k, v in found[0][1].items())


def test_calibration_rounds_read_chunks_of_persons(spark, monkeypatch):
    # a round reads a row a chunk and not a row a person, and a task gives a row an item for all of its chunks; a chunk's size changes nothing
    import numpy as np

    from ocularis.operators import calibration

    written = {}
    monkeypatch.setattr(calibration, "Table", lambda df, what: written.setdefault(what, Table(df, what)) if what == "calibration-persons" else Table(df, what))
    rows = [(f"p{p}" if p % 40 else None, f"i{k}", float(math.sin(p * 7.7 + k * 3.1) + (p % 9 - 4) * (0.2 + k * 0.1) > k * 0.3 - 0.8)) for p in range(240) for k in range(5) if (p + k) % 6]
    df = spark.createDataFrame(rows, "person string, item string, response double")
    found = []
    for chunk, most in ((1 << 17, 1), (100, 16), (1, 235)):
        monkeypatch.setattr(calibration, "CHUNK", chunk)
        written.clear()
        fit = calibration.calibrate(df, "person", "item", rounds=3)
        found.append((fit.log_likelihoods, {r["item"]: tuple(r)[1:] for r in fit.items.collect()}))
        chunks = written["calibration-persons"].df
        assert chunks.count() <= most

        class Known:
            value = np.array([[1.0] * 5, [0.0] * 5])

        thetas, weights = calibration.grid()
        sums = [r for b in calibration._scored(thetas, weights, "item", Known, False)(chunks.toArrow().to_batches()) for r in b.to_pylist()]
        assert sorted(r["item"] for r in sums[:-1]) == [0, 1, 2, 3, 4] and sums[-1]["item"] is None
        assert sum(sum(r["_s"][: len(thetas)]) for r in sums[:-1]) == pytest.approx(len(rows))
    for likelihoods, fitted in found[1:]:
        assert likelihoods == pytest.approx(found[0][0]) and all(v[1] == "estimated" and v == pytest.approx(fitted[k]) for k, v in found[0][1].items())


def test_ideal_responses_without_shuffled_pairs(spark, monkeypatch):
    # classes of equal skills in pieces, and no exchange of pairs of an item and a profile
    needs = [(i, s) for i in range(40) for s in range(9) if (i % 4, s) in ((0, 1), (0, 3), (1, 3), (2, 8)) or i % 4 == 3 and s < 3] + [(None, 3), (0, None), (41, None), (3, 0)]
    holds = [(p, s) for p in range(50) for s in range(8) if p % 3 == 0 or (p + s) % 4 < 2] + [(None, 3), (None, 1), (7, None), (51, None), (1, 2), (1, 2)]
    want = {}
    for i in {i for i, s in needs if i is not None and s is not None}:
        a = {s for j, s in needs if j == i} - {None}
        for p in {p for p, _ in holds}:
            b = {s for o, s in holds if o == p} - {None}
            if a & b:
                want[i, p] = int(a <= b)
    q, profiles = spark.createDataFrame(needs, "item_id int, skill int"), spark.createDataFrame(holds, "profile int, skill int")
    for items, together in ((1_000, 10_000), (3, 2)):
        monkeypatch.setattr(irt, "ITEMS_TOGETHER", items, raising=False)
        monkeypatch.setattr(irt, "PROFILES_TOGETHER", together, raising=False)
        found = irt.dina_ideal_response(q, profiles)
        rows = found.collect()
        assert len(rows) == len(want) and {(r["item_id"], r["profile"]): r["ideal"] for r in rows} == want
        assert not re.search(r"hashpartitioning\(item_id#\w+, profile#", found._jdf.queryExecution().executedPlan().toString())
