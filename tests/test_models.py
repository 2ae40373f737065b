"""Fitted models against plain solvers written with numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocularis.operators import regression


def newton(x, y, family="binomial", weights=None, rounds=60):
    """beta, standard errors and log-likelihood of a generalised linear model."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        eta = x @ b
        mu = {"binomial": 1 / (1 + np.exp(-eta)), "poisson": np.exp(eta), "gaussian": eta}[family]
        v = {"binomial": mu * (1 - mu), "poisson": mu, "gaussian": np.ones(len(y))}[family]
        h = (x * (w * v)[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (w * (y - mu)))
    ll = {"binomial": y * eta - np.logaddexp(0, eta), "poisson": y * eta - np.exp(eta), "gaussian": -((y - eta) ** 2) / 2}[family]
    return b, np.sqrt(np.diag(np.linalg.inv(h))), float((w * ll).sum())


def made(seed=1, groups=6, n=80):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for _ in range(n):
            a, b = r.normal(size=2)
            p = 1 / (1 + math.exp(-(0.3 * g - 1 + 0.8 * a - 0.5 * b)))
            rows.append((f"g{g}" if g else None, float(r.random() < p), int(r.poisson(math.exp(0.2 + 0.3 * a))), float(a), float(b), float(r.integers(1, 4))))
    return rows


COLUMNS = "g string, y double, c int, a double, b double, w double"


@pytest.mark.parametrize(("family", "outcome", "weight"), [("binomial", "y", None), ("poisson", "c", None), ("gaussian", "y", None), ("binomial", "y", "w")])
def test_regressions_of_many_groups(spark, family, outcome, weight):
    rows = made()
    spoiled = [*rows, ("g1", None, None, 1.0, 1.0, 1.0), ("g1", 1.0, 1, float("nan"), 1.0, 1.0), ("g2", 1.0, 1, 1.0, None, 1.0)]
    fit = regression.fit_generalised(spark.createDataFrame(spoiled, COLUMNS), ["g"], outcome, {"a": "a", "b": "b"}, family, weight).collect()
    assert len(fit) == 6 * 3
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        b, se, _ = newton([[1, r[3], r[4]] for r in own], [r[1] if outcome == "y" else r[2] for r in own], family, [r[5] for r in own] if weight else None)
        got = {r["term"]: r for r in fit if r["g"] == g}
        for k, term in enumerate(("(intercept)", "a", "b")):
            assert got[term]["status"] == "estimated" and got[term]["n"] == len(own)
            assert got[term]["estimate"] == pytest.approx(b[k], abs=1e-6) and got[term]["std_error"] == pytest.approx(se[k], abs=1e-6)
            assert got[term]["p_value"] == pytest.approx(math.erfc(abs(b[k] / se[k]) / math.sqrt(2)), abs=1e-7)


def test_statuses_instead_of_numbers(spark):
    rows = [("separated", float(k > 5), float(k), float(k % 3)) for k in range(12)]
    rows += [("half", float(k > 5 or k % 2), float(k > 5), float(k % 5)) for k in range(12)]
    rows += [("singular", float(k % 2), float(k), 2.0 * k + 1) for k in range(12)] + [("constant", float(k % 2), 3.0, float(k)) for k in range(12)]
    rows += [("few", 1.0, 1.0, 2.0), ("few", 0.0, 2.0, 1.0), ("empty", None, 1.0, 1.0)]
    rows += [("fine", float(k % 3 == 0 or k % 7 == 0), float(k % 5), float(k * k % 11)) for k in range(40)]
    fit = regression.fit_generalised(spark.createDataFrame(rows, "g string, y double, a double, b double"), ["g"], "y", {"a": "a", "b": "b"})
    status = {r["g"]: (r["status"], r["estimate"] is None, r["p_value"] is None) for r in fit.collect()}
    assert status == {"separated": ("separated", True, True), "half": ("separated", True, True), "singular": ("singular", True, True), "constant": ("singular", True, True), "few": ("insufficient_data", True, True), "fine": ("estimated", False, False)}
    assert regression.fit_generalised(spark.createDataFrame([], "g string, y double, a double"), ["g"], "y", {"a": "a"}).count() == 0
    assert regression.fit_generalised(spark.createDataFrame([], "g string, y double, a double"), [], "y", {"a": "a"}).count() == 0


def test_steps_are_halved_where_newton_overshoots(spark):
    rows = [(1, 0.0, -1.0)] * 3 + [(1, 1.0, 40.0)] * 2 + [(1, 0.0, 41.0), (1, 1.0, -0.5)] + [(1, 0.0, 0.1)] * 30
    fit = {r["term"]: r["estimate"] for r in regression.fit_generalised(spark.createDataFrame(rows, "g int, y double, a double"), ["g"], "y", {"a": "a"}).collect()}
    x, y = np.array([[1, r[2]] for r in rows]), np.array([r[1] for r in rows])
    mu = 1 / (1 + np.exp(-(x @ [fit["(intercept)"], fit["a"]])))
    assert np.abs(x.T @ (y - mu)).max() < 1e-5


def test_tails():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    x = [0.0, 1e-4, 0.3, 1.0, 1.99, 2.0, 2.5, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for r in df.select("x", regression.erfc(F.col("x")).alias("e"), regression.two_sided(F.col("x")).alias("p"), *(regression.upper_gamma(k, F.col("x")).alias(f"q{k}") for k in (2, 3, 4, 5))).collect():
        v = r["x"]
        assert r["e"] == pytest.approx(math.erfc(v), rel=1e-9) and r["p"] == pytest.approx(math.erfc(v / math.sqrt(2)), rel=1e-9)
        assert r["q2"] == pytest.approx(math.exp(-v)) and r["q4"] == pytest.approx(math.exp(-v) * (1 + v))
        root = math.sqrt(v)
        assert r["q3"] == pytest.approx(math.erfc(root) + 2 / math.sqrt(math.pi) * root * math.exp(-v), rel=1e-9)
        assert r["q5"] == pytest.approx(math.erfc(root) + 2 / math.sqrt(math.pi) * root * math.exp(-v) * (1 + v / 1.5), rel=1e-9)


def test_functioning_of_items(spark):
    r = random.Random(4)
    rows = []
    for p in range(90):
        g, theta = ("a", "b", None)[p % 7 % 3] if p % 30 == 29 else ("a", "b")[p % 2], r.gauss(0, 1)
        for i in range(6):
            rows.append((p, f"i{i}", float(r.random() < 1 / (1 + math.exp(-(theta - 0.3 * i + (1.5 if i == 2 and g == "b" else 0))))), g))
    rows += [(0, "rare", 1.0, "a"), (1, "rare", 0.0, "b"), (0, "one", 1.0, "a")]
    got = {x["item"]: x for x in regression.fit_dif(spark.createDataFrame(rows, "person int, item string, score double, grp string"), "person", "item", "score", "grp").collect()}
    assert got["rare"]["status"] == got["one"]["status"] == "insufficient_data" and got["rare"]["chisq"] is None
    kept = [x for x in rows if x[3] is not None]
    total = {}
    for p, _, s, _ in kept:
        total[p] = total.get(p, 0) + s
    for i in range(6):
        own = [(total[p] - s, s, float(g == "b")) for p, item, s, g in kept if item == f"i{i}"]
        y = [s for _, s, _ in own]
        chisq = 2 * (newton([[1, t, g, t * g] for t, _, g in own], y)[2] - newton([[1, t] for t, *_ in own], y)[2])
        assert got[f"i{i}"]["chisq"] == pytest.approx(chisq, abs=1e-6) and got[f"i{i}"]["df"] == 2 and got[f"i{i}"]["p_value"] == pytest.approx(math.exp(-chisq / 2), abs=1e-7)
    assert got["i2"]["p_value"] < 0.05


def plain_multinomial(x, y, w, allowed, states, reference, ridge):
    """Coefficients by state, by Newton's method with numeric second derivatives left out: the exact block Hessian."""
    others = [k for k in range(len(states)) if k != reference]
    p = x.shape[1]
    b = np.zeros((len(others), p))
    for _ in range(60):
        eta = np.zeros((len(y), len(states)))
        eta[:, others] = x @ b.T
        eta[~allowed] = -np.inf
        q = np.exp(eta - eta.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        g = np.concatenate([x.T @ (w * ((y == k) - q[:, k])) for k in others]) - ridge * b.ravel()
        h = np.block([[(x * (w * q[:, j] * ((j == k) - q[:, k]))[:, None]).T @ x for k in others] for j in others]) + ridge * np.eye(b.size)
        b = b + np.linalg.solve(h, g).reshape(b.shape)
    return {states[k]: b[i] for i, k in enumerate(others)}, np.sqrt(np.diag(np.linalg.inv(h))).reshape(b.shape)


def test_multinomial_transitions_with_masks(spark):
    r = np.random.default_rng(3)
    states = ["a", "b", "c", "d"]
    rows = []
    for k in range(400):
        x = r.normal(size=2)
        allowed = [True, k % 3 != 0, True, k % 5 != 1]
        eta = np.array([0.2, 0.5 * x[0], -0.4 * x[1], 0.1 + x[0]])
        q = np.where(allowed, np.exp(eta), 0)
        rows.append((k % 2, str(r.choice(states, p=q / q.sum())), float(x[0]), float(x[1]), float(r.random()), allowed))
    df = spark.createDataFrame(rows, "g int, s string, x double, z double, w double, ok array<boolean>")
    fit = regression.fit_multinomial_transition(df, "s", {"x": "x", "z": "z"}, ["g"], "w", F.col("ok"), "b", 0.01).collect()
    assert len(fit) == 2 * 4 * 3 and all(x["estimate"] == 0 and x["std_error"] == 0 for x in fit if x["destination"] == "b")
    for g in (0, 1):
        own = [t for t in rows if t[0] == g]
        want, se = plain_multinomial(np.array([[1, t[2], t[3]] for t in own]), np.array([states.index(t[1]) for t in own]), np.array([t[4] for t in own]), np.array([t[5] for t in own]), states, 1, 0.01)
        for i, s in enumerate("acd"):
            for j, term in enumerate(("(intercept)", "x", "z")):
                one = next(t for t in fit if (t["g"], t["destination"], t["term"]) == (g, s, term))
                assert one["estimate"] == pytest.approx(want[s][j], abs=1e-6) and one["std_error"] == pytest.approx(se[i, j], abs=1e-6)
    with pytest.raises(ValueError, match="mask"):
        regression.fit_multinomial_transition(df.withColumn("s", F.lit("b")), "s", {"x": "x"}, ["g"], None, F.col("ok"), "a", states=states)
    with pytest.raises(ValueError, match="reference"):
        regression.fit_multinomial_transition(df, "s", {"x": "x"}, reference="q")


def test_missing_features_and_exposure(spark):
    r = random.Random(2)
    rows = [(k % 2, None if r.random() < 1 / (1 + math.exp(-0.3 * (k % 9 - 4))) else (float("nan") if k % 11 == 0 else 1.0), float(k % 9), ("p", "q", "r", None)[k % 4]) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, f double, x double, c string")
    fit = {(t["g"], t["term"]): t["estimate"] for t in regression.model_missing_process(df, ["g"], "f", {"x": "x"}).collect()}
    for g in (0, 1):
        own = [t for t in rows if t[0] == g]
        b, _, _ = newton([[1, t[2]] for t in own], [float(t[1] is None or math.isnan(t[1])) for t in own])
        assert [fit[g, "(intercept)"], fit[g, "x"]] == pytest.approx(list(b), abs=1e-6)
    seen = df.withColumn("seen", F.col("f").isNotNull())
    got = regression.estimate_exposure_probability(seen, [], "seen", ["x"], ["c"]).collect()
    own = [t for t in rows if t[3]]
    b, _, _ = newton([[1, t[2], t[3] == "q", t[3] == "r"] for t in own], [float(t[1] is not None) for t in own])
    assert len(got) == len(own)
    for t in got:
        assert t["probability"] == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1] * t["x"] + b[2] * (t["c"] == "q") + b[3] * (t["c"] == "r")))), abs=1e-6)


def plain_cox(t, e, x, ties):
    """beta, information, and per event time (t, sums at risk) of Cox's partial likelihood."""
    t, e, x = np.asarray(t, float), np.asarray(e, int), np.asarray(x, float)
    x = x - x.mean(axis=0)
    b = np.zeros(x.shape[1])
    for _ in range(40):
        h = np.exp(x @ b)
        g, info, ll = np.zeros(len(b)), np.zeros((len(b), len(b))), 0.0
        for s in np.unique(t[e == 1]):
            risk, tied = t >= s, (t == s) & (e == 1)
            d = tied.sum()
            for k in range(d):
                f = k / d if ties == "efron" else 0.0
                w = h * risk - f * h * tied
                mean = (w @ x) / w.sum()
                info += (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
                g -= mean
                ll -= math.log(w.sum())
            g += x[tied].sum(axis=0)
            ll += (x[tied] @ b).sum()
        b = b + np.linalg.solve(info, g)
    return b, info, ll, x


def latencies(seed=5, n=150):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, c = float(r.normal()), float(r.integers(0, 2))
        t = float(np.ceil(r.exponential(20 * math.exp(-0.5 * a + 0.3 * c))))
        rows.append((("s", None)[k % 2], min(t, 30.0), t <= 30, a, c, f"p{k % 20}"))
    return rows


LATENCIES = "s string, analysis_time double, event_observed boolean, a double, c double, p string"


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_cox_regressions_by_stratum(spark, ties):
    from ocularis.operators import hazards

    rows = latencies()
    spoiled = [*rows, ("s", None, True, 0.0, 0.0, "p"), ("s", 1.0, None, 0.0, 0.0, "p"), ("s", 1.0, True, float("nan"), 0.0, "p"), ("none", 3.0, False, 1.0, 0.0, "p"), ("none", 4.0, False, 0.0, 1.0, "p")]
    model = hazards.Cox(spark.createDataFrame(spoiled, LATENCIES), ["s"], {"a": "a", "c": "c"}, ties=ties)
    table = model.table().collect()
    values = {r["s"]: r["value"] for r in model.fits.collect()}
    for s in ("s", None):
        own = [r for r in rows if r[0] == s]
        b, info, ll, _ = plain_cox([r[1] for r in own], [r[2] for r in own], [r[3:5] for r in own], ties)
        se = np.sqrt(np.diag(np.linalg.inv(info)))
        assert values[s] == pytest.approx(ll, abs=1e-6)
        for k, term in enumerate("ac"):
            one = next(r for r in table if r["s"] == s and r["term"] == term)
            assert (one["estimate"], one["std_error"], one["hazard_ratio"]) == pytest.approx((b[k], se[k], math.exp(b[k])), abs=1e-6)
    assert {r["status"] for r in table if r["s"] == "none"} == {"insufficient_data"}


def test_cox_clusters_and_proportionality(spark):
    from ocularis.operators import hazards

    rows = latencies(7)
    model = hazards.Cox(spark.createDataFrame(rows, LATENCIES), [], {"a": "a", "c": "c"}, cluster="p")
    t, e = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], int)
    b, info, _, x = plain_cox(t, e, [r[3:5] for r in rows], "breslow")
    h = np.exp(x @ b)
    scores, residuals = np.zeros_like(x), []
    for s in np.unique(t[e == 1]):
        risk, tied = t >= s, (t == s) & (e == 1)
        w = h * risk
        mean = (w @ x) / w.sum()
        scores[tied] += x[tied] - mean
        scores -= (tied.sum() * w / w.sum())[:, None] * (x - mean)
        residuals += [(s, *(x[i] - mean)) for i in np.flatnonzero(tied)]
    sums = {}
    for r, u in zip(rows, scores, strict=True):
        sums[r[5]] = sums.get(r[5], 0) + u
    v = np.linalg.inv(info)
    se = np.sqrt(np.diag(v @ sum(np.outer(u, u) for u in sums.values()) @ v))
    assert [r["std_error"] for r in sorted(model.table().collect(), key=lambda r: r["term"])] == pytest.approx(list(se), abs=1e-7)
    got = model.residuals().collect()
    assert np.allclose(sorted((r["time"], round(r["residual"], 7)) for r in got if r["term"] == "a"), sorted((s, round(a, 7)) for s, a, _ in residuals), atol=1e-6)
    rank = lambda v: np.array([(np.sum(v < q) + (np.sum(v <= q) + 1)) / 2 for q in v])
    for r in model.check().collect():
        own = np.array([[q["time"], q["residual"]] for q in got if q["term"] == r["term"]])
        rho = np.corrcoef(rank(own[:, 0]), rank(own[:, 1]))[0, 1]
        assert r["rho"] == pytest.approx(rho, abs=1e-9) and r["n"] == len(own)
        assert r["p_value"] == pytest.approx(hazards.student_tail(rho * math.sqrt((len(own) - 2) / (1 - rho * rho)), len(own) - 2), abs=1e-9)
    with pytest.raises(ValueError, match="ties"):
        hazards.Cox(spark.createDataFrame(rows, LATENCIES), [], {"a": "a"}, ties="exact")


def test_students_tail():
    from ocularis.operators.hazards import student_tail

    # closed forms for one, two and four degrees of freedom
    for t in (0.0, 0.1, 1.0, 3.0, -7.0, 40.0):
        assert student_tail(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-10)
        assert student_tail(t, 2) == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t), abs=1e-10)
        s = abs(t) / math.sqrt(4 + t * t)
        assert student_tail(t, 4) == pytest.approx(1 - s * (3 - s * s) / 2, abs=1e-10)


@pytest.mark.parametrize("distribution", ["weibull", "lognormal"])
def test_accelerated_failure_times(spark, distribution):
    from ocularis.operators import hazards

    rows = latencies(9, 200)
    fit = hazards.fit_accelerated(spark.createDataFrame(rows, LATENCIES), ["s"], {"a": "a", "c": "c"}, distribution).collect()
    for s in ("s", None):
        own = [r for r in rows if r[0] == s]
        y, d, x = np.log([r[1] for r in own]), np.array([r[2] for r in own], float), np.array([[1, r[3], r[4]] for r in own])

        def ll(p, y=y, d=d, x=x):
            z = (y - x @ p[:3]) / math.exp(p[3])
            if distribution == "weibull":
                return float((d * (z - p[3] - y) - np.exp(z)).sum())
            q = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in z])
            return float(np.where(d == 1, -z * z / 2 - math.log(math.sqrt(2 * math.pi)) - p[3] - y, np.log(q)).sum())

        got = {r["term"]: r for r in fit if r["s"] == s}
        p = np.array([got[k]["estimate"] for k in ("(intercept)", "a", "c", "ln(sigma)")])
        assert got["a"]["status"] == "estimated" and got["a"]["log_likelihood"] == pytest.approx(ll(p), abs=1e-6)
        step = 1e-4
        assert all(ll(p + step * u) < ll(p) > ll(p - step * u) and abs(ll(p + step * u) - ll(p - step * u)) / (2 * step) < 1e-4 for u in np.eye(4))
        hessian = np.array([[(ll(p + 1e-3 * (u + v)) - ll(p + 1e-3 * (u - v)) - ll(p - 1e-3 * (u - v)) + ll(p - 1e-3 * (u + v))) / 4e-6 for u in np.eye(4)] for v in np.eye(4)])
        se = np.sqrt(np.diag(np.linalg.inv(-hessian)))
        assert [got[k]["std_error"] for k in ("(intercept)", "a", "c", "ln(sigma)")] == pytest.approx(list(se), rel=1e-3)
    with pytest.raises(ValueError, match="positive"):
        hazards.fit_accelerated(spark.createDataFrame([("s", 0.0, True, 1.0, 1.0, "p")], LATENCIES), ["s"], {"a": "a"}, distribution)


def planted(persons=700, items=8, seed=3):
    r = np.random.default_rng(seed)
    a, b = np.linspace(0.7, 1.8, items), np.linspace(-1.5, 1.5, items)[::-1]
    rows = []
    for p in range(persons):
        theta = r.normal()
        rows += [(p, f"i{k}", float(r.random() < 1 / (1 + math.exp(-a[k] * (theta - b[k]))))) for k in range(items) if r.random() < 0.9]
    return rows, a, b


def plain_calibration(rows, items, rounds, rasch=False):
    """Slopes, intercepts and log-likelihoods of EM in numpy."""
    t = np.linspace(-4, 4, 21)
    w = np.exp(-t * t / 2) / np.exp(-t * t / 2).sum()
    persons = sorted({p for p, _, _ in rows})
    y = np.full((len(persons), len(items)), np.nan)
    at, of = {p: k for k, p in enumerate(persons)}, {i: k for k, i in enumerate(items)}
    for p, i, s in rows:
        y[at[p], of[i]] = s
    there = ~np.isnan(y)
    share = np.nanmean(y, axis=0)
    a, d, found = np.ones(len(items)), np.log(share / (1 - share)), []
    for _ in range(rounds):
        eta = a[:, None] * t + d[:, None]
        log = np.where(there, np.nan_to_num(y), 0) @ -np.logaddexp(0, -eta) + np.where(there, 1 - np.nan_to_num(y), 0) @ -np.logaddexp(0, eta) + np.log(w)
        top = log.max(axis=1, keepdims=True)
        q = np.exp(log - top)
        found.append(float((top[:, 0] + np.log(q.sum(axis=1))).sum()))
        q /= q.sum(axis=1, keepdims=True)
        n, r = there.T.astype(float) @ q, np.where(there, np.nan_to_num(y), 0).T @ q
        for k in range(len(items)):
            for _ in range(30):
                p = 1 / (1 + np.exp(-(a[k] * t + d[k])))
                e, v = r[k] - n[k] * p, n[k] * p * (1 - p)
                if rasch:
                    d[k] += e.sum() / v.sum()
                else:
                    step = np.linalg.solve([[(v * t * t).sum(), (v * t).sum()], [(v * t).sum(), v.sum()]], [(e * t).sum(), e.sum()])
                    a[k], d[k] = a[k] + step[0], d[k] + step[1]
    return a, d, found


def test_calibration_finds_planted_items(spark):
    from ocularis.operators import calibration

    rows, a, b = planted()
    spoiled = [*rows, *[(p, "easy", 1.0) for p in range(20)], (1, "rare", 0.0), (2, "rare", 1.0), (3, "i0", None), (4, "i1", float("nan")), (5, None, 1.0)]
    found = calibration.calibrate(spark.createDataFrame(spoiled, "person int, item string, response double"), "person", "item", tolerance=1e-7, rounds=14)
    items = {r["item"]: r for r in found.items.collect()}
    assert items["easy"]["status"] == "extreme" and items["rare"]["status"] == "insufficient_data" and items["easy"]["a"] is None
    ll = found.log_likelihoods
    assert all(later >= earlier - 1e-7 for earlier, later in zip(ll, ll[1:], strict=False))
    for k in range(8):
        one = items[f"i{k}"]
        assert abs(one["a"] - a[k]) < 3.5 * one["a_se"] and abs(one["b"] - b[k]) < 3.5 * one["b_se"] and one["a_se"] < 0.5
    pa, pd, pl = plain_calibration(rows, [f"i{k}" for k in range(8)], len(ll))
    assert ll == pytest.approx(pl, abs=1e-5)
    pa, pd, _ = plain_calibration(rows, [f"i{k}" for k in range(8)], len(ll) - found.converged)
    assert [items[f"i{k}"]["a"] for k in range(8)] == pytest.approx(list(pa), abs=1e-5)
    assert [items[f"i{k}"]["b"] for k in range(8)] == pytest.approx(list(-pd / pa), abs=1e-5)


def test_rasch_calibration_and_empty_tables(spark):
    from ocularis.operators import calibration

    rows, _, _ = planted(150, 4)
    schema = "person int, item string, response double"
    found = calibration.calibrate(spark.createDataFrame(rows, schema), "person", "item", rasch=True, tolerance=1e-6, rounds=12)
    _, d, _ = plain_calibration(rows, [f"i{k}" for k in range(4)], len(found.log_likelihoods) - found.converged, rasch=True)
    items = {r["item"]: r for r in found.items.collect()}
    assert [items[f"i{k}"]["b"] for k in range(4)] == pytest.approx(list(-d), abs=1e-5) and all(r["a"] == 1 and r["a_se"] is None for r in items.values())
    none = calibration.calibrate(spark.createDataFrame([], schema), "person", "item")
    assert none.items.count() == 0 and none.converged and none.log_likelihoods == []


@pytest.mark.parametrize("method", ["stocking_lord", "haebara"])
def test_links_are_the_least_of_a_grid(spark, method):
    from ocularis.operators import calibration

    r = np.random.default_rng(6)
    ra, rb = r.uniform(0.6, 2, 9), r.normal(size=9)
    fa, fb = ra * 1.3 * np.exp(r.normal(0, 0.1, 9)), (rb - 0.5) / 1.3 + r.normal(0, 0.1, 9)
    reference = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(ra, rb, strict=True))] + [(20, None, 1.0), (30, 1.0, 1.0)], "i int, a double, b double")
    focal = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(fa, fb, strict=True))] + [(20, 1.0, 1.0), (31, 1.0, 1.0)], "i int, a double, b double")
    got = calibration.curve_link(reference, focal, "i", method).first()
    t, w = (np.array(x) for x in calibration.grid(nodes=41))
    curve = lambda a, b: 1 / (1 + np.exp(-a[:, None] * (t - b[:, None])))

    def loss(A, B):
        gap = curve(ra, rb) - curve(fa / A, A * fb + B)
        return float((w * (gap.sum(axis=0) ** 2 if method == "stocking_lord" else (gap**2).sum(axis=0))).sum())

    assert got["n_anchors"] == 9 and got["loss"] == pytest.approx(loss(got["A"], got["B"]), abs=1e-10)
    near = [loss(got["A"] + i * h, got["B"] + j * h) for h in (1e-4, 1e-3, 0.05, 0.3) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert min(near) >= got["loss"] - 1e-12
    assert calibration.curve_link(reference.limit(1), focal, "i", method).first()["A"] is None


def test_running_sums_where_one_value_lies_far_out(spark):
    from ocularis.functions import ranks

    values = [float(k) for k in range(3000)] + [1e12, -1e15]
    df = spark.createDataFrame([(v, k % 7) for k, v in enumerate(values)], "t double, v long")
    placed = ranks.bucketed(df, "t").groupBy("_bucket").count().collect()
    assert max(r["count"] for r in placed) < 60
    steps = [{"s": (F.sum, F.col("v")), "r": (F.sum, F.col("v"), True)}, {"x": F.col("s") - F.col("v")}, {"y": (F.max, F.col("x"))}]
    order, total = sorted(zip(values, [k % 7 for k in range(len(values))], strict=True)), sum(k % 7 for k in range(len(values)))
    got = {r["t"]: (r["s"], r["r"], r["y"]) for r in ranks.run_through(ranks.bucketed(df, "t"), "t", steps).collect()}
    s = 0
    for t, v in order:
        assert got[t] == (s + v, total - s, s)
        s += v


def test_out_of_fold_scores(spark):
    from ocularis.operators import heldout

    rows = [(f"p{k % 17}" if k % 40 else None, f"i{k % 7}", r[1], r[3], r[4], k) for k, r in enumerate(made(8, 5, 60))]
    df = spark.createDataFrame(rows, "p string, i string, y double, a double, b double, k int")
    for groups, folds in ((["p"], 4), (["p", "i"], 3)):
        predictions, fits = heldout.out_of_fold(df, groups, "y", {"a": "a", "b": "b"}, ["k"], folds=folds)
        got = {r["k"]: (r["fold"], r["predicted"]) for r in predictions.collect()}
        from ocularis.operators.validation import grouped_folds

        deal = df
        for n, g in enumerate(groups):
            deal = grouped_folds(deal, g, folds, 1 + n).withColumnRenamed("fold", f"f{n}")
        of = {r["k"]: tuple(r[f"f{n}"] for n in range(len(groups))) for r in deal.collect() if all(r[f"f{n}"] is not None for n in range(len(groups)))}
        table = {r["fold"]: r for r in heldout.grouped_cv(df, groups, "y", {"a": "a", "b": "b"}, folds=folds).collect()}
        assert set(got) == {k for k, f in of.items() if len(set(f)) == 1}
        for f in range(1, folds + 1):
            train = [rows[k] for k, own in of.items() if f not in own]
            test = [k for k, own in of.items() if set(own) == {f}]
            b, _, _ = newton([[1, r[3], r[4]] for r in train], [r[2] for r in train])
            p = np.array([1 / (1 + math.exp(-(b[0] + b[1] * rows[k][3] + b[2] * rows[k][4]))) for k in test])
            y = np.array([rows[k][2] for k in test])
            assert [got[k] for k in test] == [(f, pytest.approx(q, abs=1e-7)) for q in p]
            one = table[f]
            assert (one["n_analysis"], one["n_assessment"], one["n_buffer"], one["status"]) == (len(train), len(test), len(of) - len(train) - len(test), "estimated")
            assert one["log_loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-7)
            assert one["brier"] == pytest.approx(np.mean((p - y) ** 2), abs=1e-7) and one["accuracy"] == pytest.approx(np.mean((p >= 0.5) == y))
    gaussian = heldout.grouped_cv(df, ["p"], "a", {"b": "b"}, "gaussian", folds=3).collect()
    assert all(r["rmse"] > 0 and r["mae"] <= r["rmse"] for r in gaussian)
    perfect = df.withColumn("y", (F.col("a") > 0).cast("double"))
    assert {(r["status"], r["log_loss"]) for r in heldout.grouped_cv(perfect, ["p"], "y", {"a": "a"}, folds=3).collect()} == {("separated", None)}


def test_as_of_joins_by_plain_search(spark):
    from ocularis.operators import alignment

    r = random.Random(3)
    left = [(k, r.choice(["a", "b", None, "only"]), r.choice([None, float("nan"), *[float(r.randrange(60)) for _ in range(20)]])) for k in range(300)]
    right = [(r.choice(["a", "b", None, "other"]), r.choice([None, *[float(r.randrange(60)) for _ in range(9)]]), r.randrange(1000), "x" * k) for k in range(120)]
    # one group is long and its times lie far apart
    left += [(1000 + k, "long", float(k % 4000) ** 2) for k in range(3000)]
    right += [("long", float(k) ** 2 + 0.5 * (k % 3), k, "y") for k in range(0, 4000, 3)]
    a = spark.createDataFrame(left, "k int, g string, t double").repartition(3)
    b = spark.createDataFrame(right, "g string, t double, v int, w string").repartition(2)
    points = {}
    for g, t, v, w in right:
        if t is not None:
            points.setdefault(g, []).append((t, v, w))

    def plain(g, t, direction, tolerance):
        own = sorted(points.get(g, []))
        if t is None or math.isnan(t):
            return None, None, "unmatched"
        before = max((p for p in own if p[0] <= t), default=None)
        after = min((p for p in own if p[0] > t), default=None)
        exact = before is not None and before[0] == t
        one = {"backward": before, "forward": before if exact else after, "nearest": before if after is None else after if before is None else after if after[0] - t < t - before[0] else before}[direction]
        if one is None:
            return None, None, "unmatched"
        gap = abs(one[0] - t)
        return (one[1], gap, "matched") if gap <= tolerance else (None, gap, "outside_tolerance")

    for direction, tolerance in (("backward", 3.0), ("forward", 100.0), ("nearest", 1.0)):
        got = {x["k"]: (x["v"], x["gap"], x["asof_status"]) for x in alignment.as_of(a, b, ["g"], "t", "t", ["v", "w"], direction, tolerance).collect()}
        assert len(got) == len(left)
        for k, g, t in left:
            assert got[k] == plain(g, t, direction, tolerance), (k, g, t, direction)
    assert alignment.as_of(a.limit(0), b, ["g"], "t", "t", ["v"]).count() == 0
    assert {x["asof_status"] for x in alignment.as_of(a, b.limit(0), ["g"], "t", "t", ["v"]).collect()} == {"unmatched"}
    with pytest.raises(ValueError, match="direction"):
        alignment.as_of(a, b, ["g"], "t", "t", ["v"], "sideways")


def test_head_pose_and_rays(spark):
    from ocularis.operators import alignment

    half = math.sqrt(0.5)
    pose = [("r", 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0), ("r", 1.0, 0.0, 0.0, -half, -half, 10.0, 0.0, -4.0), ("r", 5.0, 0.0, 0.0, half, half, 10.0, 0.0, 0.0), ("r", 0.5, 0.0, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0), ("r", 0.6, None, 0.0, 0.0, 1.0, 9.0, 9.0, 9.0)]
    gaze = [("r", t, 1.0, 0.0, 0.0) for t in (-0.1, 0.0, 0.5, 1.0, 2.0, 5.0, 5.1)] + [("r", None, 1.0, 0.0, 0.0), ("q", 0.5, 1.0, 0.0, 0.0)]
    p = spark.createDataFrame(pose, "g string, timestamp double, qx double, qy double, qz double, qw double, px double, py double, pz double")
    a = spark.createDataFrame(gaze, "g string, timestamp double, head_gaze_x double, head_gaze_y double, head_gaze_z double")
    found = alignment.transform_head_gaze_to_world(alignment.align_head_pose_to_gaze(a, p, ["g"], longest_gap=3.0))
    got = {(x["g"], x["timestamp"]): x for x in found.collect()}
    assert {k: x["pose_status"] for k, x in got.items()} == {("r", -0.1): "outside", ("r", 0.0): "aligned", ("r", 0.5): "aligned", ("r", 1.0): "aligned", ("r", 2.0): "gap", ("r", 5.0): "aligned", ("r", 5.1): "outside", ("r", None): "outside", ("q", 0.5): "outside"}
    # a quarter turn about z, half of it at half the time
    for t, angle, px in ((0.0, 0.0, 0.0), (0.5, math.pi / 4, 5.0), (1.0, math.pi / 2, 10.0)):
        x = got["r", t]
        assert (x["world_gaze_x"], x["world_gaze_y"], x["world_gaze_z"], x["world_origin_x"], x["pz"]) == pytest.approx((math.cos(angle), math.sin(angle), 0.0, px, -4.0 * px / 10), abs=1e-12)
        assert x["qx"] ** 2 + x["qy"] ** 2 + x["qz"] ** 2 + x["qw"] ** 2 == pytest.approx(1)
    assert got["r", 2.0]["qw"] is None and got["r", 2.0]["world_gaze_x"] is None


def plain_mixture(z, shares, means, variances, rounds):
    """EM in numpy from given parameters: parameters and the log-likelihood of each round."""
    shares, means, variances = (np.array(v, float) for v in (shares, means, variances))
    found = []
    for _ in range(rounds):
        logs = np.log(shares) - np.log(2 * np.pi * variances).sum(axis=1) / 2 - ((z[:, None] - means) ** 2 / (2 * variances)).sum(axis=2)
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        found.append(total.sum())
        r = np.exp(logs - total[:, None])
        w = r.sum(axis=0)
        shares, means = w / len(z), (r.T @ z) / w[:, None]
        variances = np.maximum((r.T @ (z * z)) / w[:, None] - means**2, 1e-4)
    return shares, means, variances, found


def test_mixtures_find_planted_classes(spark):
    from ocularis.operators import latent

    r = np.random.default_rng(4)
    truth = [int(r.integers(0, 3)) for _ in range(600)]
    rows = [(k, c, float(r.normal((-4, 0, 5)[c], 0.8)), float(r.normal((2, -3, 1)[c], 1.0))) for k, c in enumerate(truth)]
    spoiled = [*rows, (1000, 0, None, 1.0), (1001, 0, float("nan"), 1.0)]
    df = spark.createDataFrame(spoiled, "id int, truth int, x double, y double").repartition(3)
    fit = latent.fit_mixture(df, ["x", "y"], 3, "id", starts=3, tries=3)
    assert fit.converged and fit.n == 600 and all(b >= a - 1e-7 for a, b in zip(fit.log_likelihoods, fit.log_likelihoods[1:], strict=False))
    found = fit.classified(df).collect()
    assert len(found) == 602 and all(x["class"] is None and x["probabilities"] is None for x in found if x["id"] >= 1000)
    known = [x for x in found if x["id"] < 1000]
    assert sum(x["class"] == x["truth"] + 1 for x in known) > 590 and all(abs(sum(x["probabilities"]) - 1) < 1e-9 for x in known)
    z = (np.array([x[2:] for x in rows]) - fit.centre) / np.array(fit.scale)
    shares, means, variances, ll = plain_mixture(z, fit.shares, fit.means, fit.variances, 2)
    assert ll[0] == pytest.approx(fit.log_likelihoods[-1], abs=1e-6)
    assert np.allclose(shares, fit.shares, atol=1e-4) and np.allclose(means, fit.means, atol=1e-3) and np.allclose(variances, fit.variances, atol=1e-3)
    summary = {(x["class"], x["variable"]): x for x in fit.summary(spark).collect()}
    assert summary[1, "x"]["mean"] == pytest.approx(-4, abs=0.2) and summary[3, "y"]["sd"] == pytest.approx(1, abs=0.2)
    table = {x["classes"]: x["bic"] for x in latent.compare_mixtures(df, ["x", "y"], [2, 3], "id").collect()}
    assert min(table, key=table.get) == 3
    with pytest.raises(ValueError, match="vary"):
        latent.fit_mixture(df.withColumn("x", F.lit(1.0)), ["x"], 2, "id")
    with pytest.raises(ValueError, match="few"):
        latent.fit_mixture(df.limit(5).filter("x = x"), ["y"], 3, "id")


def walks(seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for s, n in (("a", 400), ("b", 30), ("c", 1), ("d", 7), ("e", 160)):
        state = int(r.integers(0, 2))
        for t in range(n):
            state = state if r.random() < 0.9 else 1 - state
            rows.append((s, float(t), float(r.normal((-1, 2)[state], 0.7)), float(r.normal((1, 0)[state], 1.0))))
    return rows


def plain_states(sequences, model):
    """Log-likelihood, posteriors and Viterbi paths by loops in the log domain."""
    initial, transition, means, sds = (np.array(v, float) for v in model)
    out, total, best = {}, 0.0, {}
    for s, x in sequences.items():
        b = np.exp(-(((x[:, None] - means) / sds) ** 2).sum(axis=2) / 2 - np.log(sds * math.sqrt(2 * math.pi)).sum(axis=1))
        a, c, scale = [initial * b[0]], [np.ones(len(initial))], []
        for t in range(1, len(x)):
            a.append((a[-1] @ transition) * b[t] / a[-1].sum())
        for t in range(len(x) - 1, 0, -1):
            v = transition @ (b[t] * c[0])
            c.insert(0, v / v.sum())
        total += sum(math.log(v.sum()) for v in a)
        g = np.array(a) * np.array(c)
        out[s] = g / g.sum(axis=1, keepdims=True)
        v, backs = np.log(initial) + np.log(b[0]), []
        for t in range(1, len(x)):
            each = v[:, None] + np.log(transition)
            backs.append(each.argmax(axis=0))
            v = each.max(axis=0) + np.log(b[t])
        path = [int(v.argmax())]
        for back in reversed(backs):
            path.insert(0, int(back[path[0]]))
        best[s] = path
    return total, out, best


def test_hidden_states_over_pieces(spark):
    from itertools import product

    from ocularis.operators import latent

    rows = walks()
    spoiled = [*rows, (None, 1.0, 0.0, 0.0), ("a", None, 0.0, 0.0), ("b", 99.0, None, 1.0)]
    df = spark.createDataFrame(spoiled, "s string, t double, x double, y double").repartition(3)
    fits = []
    for piece in (2048, 40):
        fit, pieces = latent.fit_states(df, "s", "t", ["x", "y"], 2, rounds=4, piece=piece)
        assert (pieces.filter("_last > 0").count() > 10) == (piece == 40)
        ll = fit.log_likelihoods
        assert all(b >= a - 1e-3 for a, b in zip(ll, ll[1:], strict=False)) and ll[-1] > ll[0]
        fits.append(fit)
        sequences = {}
        for s, _, *x in rows:
            sequences.setdefault(s, []).append((np.array(x) - fit.centre) / np.array(fit.scale))
        sequences = {s: np.array(x) for s, x in sequences.items()}
        model = latent._model(fit)
        total, gamma, best = plain_states(sequences, model)
        assert latent._step(pieces, "s", model)[0] == pytest.approx(total, abs=1e-6)
        got = {(r["s"], r["t"]): r["probabilities"] for r in latent.posteriors(fit, pieces, "s", "t").collect()}
        assert len(got) == len(rows) and all(np.allclose(got[s, float(t)], g[t], atol=1e-8) for s, g in gamma.items() for t in range(len(g)))
        found = {(r["s"], r["t"]): r["state"] for r in latent.paths(fit, pieces, "s", "t").collect()}
        assert all([found[s, float(t)] - 1 for t in range(len(p))] == p for s, p in best.items())
        means = {r["s"]: r["state_1_occupancy"] for r in latent.occupancy(fit, pieces, "s", "t").collect()}
        assert all(means[s] == pytest.approx(g[:, 0].mean(), abs=1e-8) for s, g in gamma.items())
        # the short sequence's path is the best of all
        initial, transition, mean, sd = (np.array(v) for v in model)
        x = sequences["d"]
        score = lambda p: math.log(initial[p[0]]) + sum(math.log(transition[a, b]) for a, b in zip(p, p[1:], strict=False)) + sum(float(-(((x[t] - mean[k]) / sd[k]) ** 2).sum() / 2 - np.log(sd[k]).sum()) for t, k in enumerate(p))  # noqa: B023,E731
        assert best["d"] == list(max(product(range(2), repeat=7), key=score))
    assert fits[0].log_likelihoods == pytest.approx(fits[1].log_likelihoods, abs=1e-5)
    assert sum(r["probability"] for r in latent.transition_summary(fits[0], spark).collect()) == pytest.approx(2)


def plain_linear(x, y):
    """Coefficients, standard errors, residuals of least squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ b
    free = len(y) - np.linalg.matrix_rank(x)
    return b, np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * (rest @ rest) / free), rest


def test_least_squares_by_group(spark):
    from ocularis.operators import linear

    rows = made(3, 4, 50)
    spoiled = [*rows, ("few", 1.0, 1, 0.5, 0.5, 1.0), *[("flat", float(k), 1, 2.0, float(k), 1.0) for k in range(9)], *[("twice", float(k), 1, float(k), 2.0 * k, 1.0) for k in range(9)]]
    df = spark.createDataFrame(spoiled, COLUMNS).withColumn("a", F.col("a") + 1e6)
    fit = linear.fit_linear(df, ["g"], "b", {"a": F.col("a"), "c": "c"}).collect()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        b, se, rest = plain_linear([[1, r[3], r[2]] for r in own], [r[4] for r in own])
        got = {r["term"]: r for r in fit if r["g"] == g}
        assert [got[t]["estimate"] for t in ("a", "c")] == pytest.approx(list(b[1:]), abs=1e-6) and [got[t]["std_error"] for t in ("a", "c")] == pytest.approx(list(se[1:]), rel=1e-4)
        assert got["a"]["residual_sd"] == pytest.approx(math.sqrt(rest @ rest / (len(own) - 3)), rel=1e-6)
    status = {r["g"]: r["status"] for r in fit}
    assert status["few"] == "insufficient_data" and status["flat"] == status["twice"] == "singular"


def test_confounds_with_absorbed_factors(spark):
    from ocularis.operators import linear

    r = np.random.default_rng(5)
    rows = [(f"p{int(r.integers(0, 9))}", f"i{int(r.integers(0, 6))}", float(r.normal()), float(k % 17), float(r.normal()), float(r.normal(3, 1))) for k in range(240)]
    df = spark.createDataFrame([*rows, ("p1", "i1", None, 1.0, 1.0, 1.0), (None, "i1", 1.0, 1.0, 1.0, 1.0)], "p string, i string, lum double, ord double, th double, pupil double")
    found, adjusted = linear.fit_pupil_confound_model(df, "pupil", "lum", "ord", "th", ["p", "i"])
    persons, items = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    x = np.array([[lu, o, lu * lu, o * o, th, lu * th, 1, *(p == q for q in persons[1:]), *(i == q for q in items[1:])] for p, i, lu, o, th, _ in rows], float)
    b, se, rest = plain_linear(x, [q[5] for q in rows])
    got = {q["term"]: q for q in found.collect()}
    names = ("luminance", "trial", "luminance2", "trial2", "theta", "luminance_theta")
    assert [got[k]["estimate"] for k in names] == pytest.approx(list(b[:6]), abs=1e-6) and [got[k]["std_error"] for k in names] == pytest.approx(list(se[:6]), rel=1e-5)
    kept = adjusted.collect()
    assert len(kept) == len(rows) and adjusted.columns == [*df.columns, "pupil_confound_residual", "pupil_confound_adjusted"]
    assert sorted(q["pupil_confound_residual"] for q in kept) == pytest.approx(sorted(rest), abs=1e-6)
    plain, _ = linear.fit_pupil_confound_model(df, "pupil", "lum", "ord")
    b, _, _ = plain_linear([[1, lu, o, lu * lu, o * o] for _, _, lu, o, *_ in [*rows, (None, "i1", 1.0, 1.0, 1.0, 1.0)]], [*(q[5] for q in rows), 1.0])
    assert {q["term"]: q["estimate"] for q in plain.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in zip(("(intercept)", *names[:4]), b, strict=True)}


def test_responses_to_events(spark):
    from ocularis.operators import linear

    r = np.random.default_rng(8)
    kernel = lambda t: (t / 900.0) ** 10.1 * math.exp(10.1 * (1 - t / 900.0)) if t > 0 else 0.0
    events = {"a": {"cue": [100.0, 2500.0], "stim": [900.0]}, "b": {"cue": [0.0], "stim": [1500.0, 1600.0]}}
    rows, wide = [], {}
    for g, named in events.items():
        t = np.arange(0, 6000, 40.0)
        x = {n: np.array([sum(kernel(v - e) for e in at) for v in t]) for n, at in named.items()}
        x = {n: v / v.max() for n, v in x.items()}
        y = 3 + 0.8 * x["cue"] - 0.3 * x["stim"] + r.normal(0, 0.05, len(t))
        wide[g] = (np.column_stack([np.ones(len(t)), x["cue"], x["stim"]]), y)
        rows += [(g, float(v), float(p)) for v, p in zip(t, y, strict=True)]
    rows += [("few", float(k), 1.0 + k) for k in range(5)] + [("still", float(k), 2.0) for k in range(40)] + [("none", float(k), float(k)) for k in range(40)] + [("a", None, 1.0), ("a", 1.0, None)]
    at = [(g, e, n) for g, named in events.items() for n, times in named.items() for e in times] + [("a", None, "cue"), ("a", 5.0, "other"), ("none", 1.0, "cue")]
    samples, marks = spark.createDataFrame(rows, "g string, t double, p double"), spark.createDataFrame(at, "g string, e double, n string")
    fit = linear.fit_pupil_event_deconvolution(samples, marks, ["g"], "t", "p", "e", "n", ["cue", "stim"], 900.0).collect()
    for g, (x, y) in wide.items():
        b, se, _ = plain_linear(x, y)
        got = {q["term"]: q for q in fit if q["g"] == g}
        assert [got[k]["estimate"] for k in ("(intercept)", "cue", "stim")] == pytest.approx(list(b), abs=1e-6) and got["cue"]["std_error"] == pytest.approx(se[1], rel=1e-5)
    assert {q["g"]: q["status"] for q in fit} == {"a": "estimated", "b": "estimated", "few": "insufficient_data", "still": "insufficient_data", "none": "singular"}


def test_fixation_intensities(spark):
    from ocularis.operators import linear

    r = np.random.default_rng(2)
    rows = [(("s", None)[k % 2], float(r.normal(5, 2)), float(r.normal(3, 1)), float(k), None if k % 9 == 0 else float(r.normal())) for k in range(500)] + [("few", 1.0, 1.0, 1.0, 1.0), ("s", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, t double, c double")
    found, cells, checks = linear.fit_fixation_point_process(df, ["g"], "x", "y", "t", 6, ["c"], True)
    table, sums = {(q["g"], q["term"]): q for q in found.collect()}, {q["g"]: q for q in checks.collect()}
    got = cells.collect()
    assert {q["g"] for q in got} == {"s", None}
    for g in ("s", None):
        own = [q for q in rows if q[0] == g and q[1] is not None]
        p = np.array([[q[1], q[2]] for q in own])
        low, high = p.min(axis=0), p.max(axis=0)
        bins = np.clip(np.ceil((p - low) / ((high - low) / 6)), 1, 6).astype(int)
        lag = np.concatenate([[np.nan], np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1))])
        h = np.exp(-lag / np.nanmean(lag))
        grid = {}
        for b, q, v in zip(map(tuple, bins.tolist()), own, h, strict=True):
            grid.setdefault(b, []).append((q[4], v))
        keys = sorted(grid)
        mean = lambda v: float(np.mean(v)) if len(v) else float("nan")
        c = np.array([mean([a for a, _ in grid[b] if a is not None]) for b in keys])
        c = np.where(np.isnan(c), np.nanmean(c), c)
        history = [mean([v for _, v in grid[b] if not math.isnan(v)]) for b in keys]
        at = low + (np.array(keys) - 0.5) * (high - low) / 6
        n = np.array([len(grid[b]) for b in keys], float)
        x = np.column_stack([np.ones(len(keys)), at, at**2, at[:, 0] * at[:, 1], np.nan_to_num(history), c])
        b, _, rest = plain_linear(x, np.log(n))
        terms = ("(intercept)", "x", "y", "x2", "y2", "xy", "history", "c")
        assert [table[g, k]["estimate"] for k in terms] == pytest.approx(list(b), abs=1e-6)
        mine = {(q["x_bin"], q["y_bin"]): q for q in got if q["g"] == g}
        expected = np.exp(np.log(n) - rest)
        assert [mine[k]["count"] for k in keys] == list(n) and [mine[k]["expected"] for k in keys] == pytest.approx(list(expected), rel=1e-6)
        pearson = (n - expected) / np.sqrt(expected)
        assert sums[g]["overdispersion"] == pytest.approx((pearson**2).sum() / (len(keys) - 8), rel=1e-6) and sums[g]["correlation"] == pytest.approx(np.corrcoef(n, expected)[0, 1], abs=1e-8)
    marked = linear.fit_marked_gaze_process(df, ["g"], ["c"], "x", "y", "t").collect()
    own = [q for q in rows if q[0] == "s" and q[4] is not None and q[1] is not None]
    b, _, _ = plain_linear([[1, q[1], q[2], q[3], q[1] * q[2]] for q in own], [q[4] for q in own])
    assert [next(q["estimate"] for q in marked if q["g"] == "s" and q["term"] == k) for k in ("(intercept)", "x", "y", "time", "xy")] == pytest.approx(list(b), abs=1e-6)


def signed(vectors):
    """Columns with their largest entry positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[top, range(vectors.shape[1])])


@pytest.mark.parametrize("scaling", ["size", "first_axis"])
def test_multiblock_maps(spark, scaling):
    from ocularis.operators import components

    r = np.random.default_rng(7)
    base = r.normal(size=(60, 2))
    x = np.column_stack([base[:, 0] + r.normal(0, 0.3, 60), base[:, 0] * 2 + r.normal(0, 0.5, 60), base[:, 1] + r.normal(0, 0.3, 60), base.sum(axis=1) * 5, r.normal(size=60)])
    rows = [(f"p{k}", *map(float, v), 1.0) for k, v in enumerate(x)]
    rows[3] = (*rows[3][:2], None, *rows[3][3:])
    rows[9] = (*rows[9][:5], float("nan"), rows[9][6])
    found = components.fit_multiblock_process_map(spark.createDataFrame(rows, "id string, a double, b double, c double, d double, e double, f double").repartition(3), {"one": ["a", "b"], "two": ["c", "d", "e", "f"], "three": ["id"][:0]}, "id", 3, scaling)
    x[3, 1] = np.delete(x[:, 1], 3).mean()
    x[9, 4] = np.delete(x[:, 4], 9).mean()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    for part in (slice(0, 2), slice(2, 5)):
        z[:, part] /= math.sqrt(z[:, part].shape[1]) if scaling == "size" else np.linalg.svd(z[:, part])[1][0]
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    v = signed(vt[:3].T)
    assert found.singular_values == pytest.approx(tuple(s[:3]))
    assert np.allclose([[q[f"PC{k}"] for k in (1, 2, 3)] for q in found.variables.collect()], v, atol=1e-8)
    got = {q["id"]: [q[f"PC{k}"] for k in (1, 2, 3)] for q in found.persons.collect()}
    assert np.allclose([got[f"p{k}"] for k in range(60)], z @ v, atol=1e-8)
    sizes = {q["block"]: q["PC1"] for q in found.blocks.collect()}
    assert sizes == {"one": pytest.approx(np.abs(v[:2, 0]).mean()), "two": pytest.approx(np.abs(v[2:, 0]).mean())}
    with pytest.raises(ValueError, match="two blocks"):
        components.fit_multiblock_process_map(spark.createDataFrame(rows, "id string, a double, b double, c double, d double, e double, f double"), {"one": ["a"], "two": ["f"]}, "id")


@pytest.mark.parametrize("method", ["elastic", "shift"])
def test_phase_and_amplitude_of_curves(spark, method):
    from ocularis.operators import components

    r = np.random.default_rng(3)
    curves, rows = {}, []
    for c in range(12):
        n = 400 if c == 0 else int(r.integers(8, 30))
        t = np.sort(r.uniform(10, 10 + 5 * (c + 1), n))
        y = np.sin(3 * (t - t[0]) / (t[-1] - t[0]) + 0.2 * c) * (1 + 0.1 * c) + r.normal(0, 0.02, n)
        curves[f"c{c}"] = (t, y)
        rows += [(f"c{c}", float(a), float(b)) for a, b in zip(t, y, strict=True)]
    rows += [("short", 1.0, 1.0), ("short", 2.0, 1.0), ("c1", None, 9.0), ("c1", 20.0, float("nan")), (None, 1.0, 1.0)]
    grid = np.linspace(0, 1, 41)
    found = components.register_pupil_curves(spark.createDataFrame(rows, "id string, t double, p double").repartition(3), "id", "t", "p", method, 41)
    got = {q["id"]: q for q in found.collect()}
    assert set(got) == set(curves)
    raw = {c: np.interp(grid, (t - t[0]) / (t[-1] - t[0]), y) for c, (t, y) in curves.items()}
    peak = {c: grid[int(v.argmax())] for c, v in raw.items()}
    middle = float(np.median(list(peak.values())))
    registered = {}
    for c, v in raw.items():
        move = (middle - peak[c]) * (1 if method == "shift" else 0.75 * 4 * grid * (1 - grid))
        registered[c] = np.interp(np.clip(grid - move, 0, 1), grid, v)
        assert np.allclose(got[c]["raw"], v, atol=1e-9) and got[c]["phase_shift"] == pytest.approx(middle - peak[c]) and np.allclose(got[c]["registered"], registered[c], atol=1e-9)
    scores, shares = components.decompose_pupil_phase_amplitude(found, "id", 2, 41)
    names = sorted(registered)
    m = np.array([registered[c] for c in names])
    m = m - m.mean(axis=0)
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    mine = {q["id"]: (q["amplitude_pc1"], q["amplitude_pc2"]) for q in scores.collect()}
    assert np.allclose([mine[c] for c in names], m @ signed(vt[:2].T), atol=1e-8) and shares[:3] == pytest.approx(list(s[:3] ** 2 / (s**2).sum()), abs=1e-9)
    groups = spark.createDataFrame([(c, "ab"[k % 2]) for k, c in enumerate(names[:-1])], "id string, g string")
    table = {q["g"]: q["n"] for q in components.compare_phases(found, groups, "id", "g").collect()}
    assert table == {"a": 6, "b": 5, None: 1}
