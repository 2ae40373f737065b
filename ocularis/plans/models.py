"""Registered queries of fitted models: regressions by group, survival regressions, item estimation, mixtures, hidden states, as-of joins.

Iterative fits are written out in SQL as one common table expression a Newton round, for models of two parameters a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, calibration, components, hazards, heldout, latent, linear, regression
from .catalogue import _SUM_LATENCIES, _latencies, query, rounded, samples, table

_MU = {"binomial": "1 / (1 + exp(-(b0 + b1 * x)))", "poisson": "exp(b0 + b1 * x)"}
_VAR = {"binomial": "mu * (1 - mu)", "poisson": "mu"}
_LL = {"binomial": "y * (b0 + b1 * x) - greatest(b0 + b1 * x, 0) - ln(1 + exp(-abs(b0 + b1 * x)))", "poisson": "y * (b0 + b1 * x) - exp(b0 + b1 * x)"}


def newton(source: str, family: str = "binomial", rounds: int = 12, name: str = "f", weight: str = "1") -> str:
    """CTEs over source (key, x, y): f has key, n, b0, b1, s0, s1 (standard errors) and ll after so many rounds from zero."""
    out = [f"{name}0 AS (SELECT key, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM {source} GROUP BY key)"]
    sums = f"SELECT key, any_value(b0) AS b0, any_value(b1) AS b1, count(*) AS n, sum({weight} * (y - mu)) AS g0, sum({weight} * x * (y - mu)) AS g1, sum({weight} * {_VAR[family]}) AS h0, sum({weight} * x * {_VAR[family]}) AS h1, sum({weight} * x * x * {_VAR[family]}) AS h2, sum({weight} * ({_LL[family]})) AS ll"
    for k in range(rounds):
        rows = f"SELECT {source}.*, b0, b1, {_MU[family]} AS mu FROM {source} JOIN {name}{k} USING (key)"
        out.append(f"{name}h{k} AS ({sums} FROM ({rows}) GROUP BY key)")
        out.append(f"{name}{k + 1} AS (SELECT key, b0 + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS b0, b1 + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b1 FROM {name}h{k})")
    out.append(f"{name} AS (SELECT key, n, b0, b1, sqrt(h2 / (h0 * h2 - h1 * h1)) AS s0, sqrt(h0 / (h0 * h2 - h1 * h1)) AS s1, ll FROM {name}h{rounds - 1})")
    return ", ".join(out)


def _terms(term: str, digits: int = 5) -> str:
    each = "SELECT key, n, '{}' AS term, round({}, {d}) AS estimate, round({}, {d}) AS std_error FROM f"
    return each.format("(intercept)", "b0", "s0", d=digits) + " UNION ALL " + each.format(term, "b1", "s1", d=digits)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_RETURNED = "r AS (SELECT l_suppkey AS key, l_quantity / 10.0 AS x, (l_returnflag = 'R')::INT AS y FROM lineitem)"


@query(f"WITH {_RETURNED}, {newton('r')} {_terms('quantity')}")
def glm_logistic(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    fit = regression.fit_generalised(rows, ["l_suppkey"], "y", {"quantity": F.col("l_quantity") / 10.0})
    return rounded(fit.select(F.col("l_suppkey").alias("key"), "n", "term", "estimate", "std_error"), 5)


@query(f"WITH r AS (SELECT l_suppkey AS key, l_discount * 10.0 AS x, l_linenumber AS y FROM lineitem), {newton('r', 'poisson')} {_terms('discount')}")
def glm_poisson(spark, sf_dir):
    fit = regression.fit_generalised(_lines(spark, sf_dir), ["l_suppkey"], "l_linenumber", {"discount": F.col("l_discount") * 10.0}, "poisson")
    return rounded(fit.select(F.col("l_suppkey").alias("key"), "n", "term", "estimate", "std_error"), 5)


@query(
    "WITH a AS (SELECT l_suppkey AS item, l_linestatus AS grp, (l_returnflag = 'R')::INT AS y, sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey) - (l_returnflag = 'R')::INT AS x FROM lineitem), "
    f"c AS (SELECT item AS key, x, y FROM a), d AS (SELECT item || '/' || grp AS key, x, y FROM a), {newton('c', name='f')}, {newton('d', name='g')}, "
    "s AS (SELECT split_part(key, '/', 1)::BIGINT AS item, sum(ll) AS ll FROM g GROUP BY ALL) SELECT f.key AS item, n, 'estimated' AS status, round(greatest(0, 2 * (s.ll - f.ll)), 5) AS chisq, 2 AS df, round(exp(-greatest(0, s.ll - f.ll)), 5) AS p_value FROM f JOIN s ON s.item = f.key"
)
def dif_logistic(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", F.col("l_suppkey").alias("item"), (F.col("l_returnflag") == "R").cast("int").alias("score"), "l_linestatus")
    return rounded(regression.fit_dif(rows, "l_orderkey", "item", "score", "l_linestatus"), 5)


@query(f"WITH r AS (SELECT l_suppkey AS key, l_quantity / 10.0 AS x, (l_tax = 0)::INT AS y FROM lineitem), {newton('r')} {_terms('quantity')}")
def missing_process_model(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("feature", F.when(F.col("l_tax") != 0, F.col("l_tax")))
    fit = regression.model_missing_process(rows, ["l_suppkey"], "feature", {"quantity": F.col("l_quantity") / 10.0})
    return rounded(fit.select(F.col("l_suppkey").alias("key"), "n", "term", "estimate", "std_error"), 5)


@query(f"WITH r AS (SELECT 0 AS key, l_quantity AS x, (l_tax > 0.03)::INT AS y FROM lineitem), {newton('r')} SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-(b0 + b1 * l_quantity))), 6) AS probability FROM lineitem, f")
def exposure_probability(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("reached", F.col("l_tax") > 0.03)
    found = regression.estimate_exposure_probability(rows, [], "reached", ["l_quantity"])
    return rounded(found.select("l_orderkey", "l_linenumber", "l_partkey", "probability"), 6)


@query(None)
def multinomial_transition(spark, sf_dir):
    s = samples(spark, sf_dir)
    from pyspark.sql import Window

    following = s.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).filter("next is not null")
    fit = regression.fit_multinomial_transition(following, "next", {"x": F.col("x") / 10.0}, ridge=1e-4)
    return rounded(fit, 5)


def _marks(spark, sf_dir):
    """Orders as persons, suppliers as items: a line is solved with a logistic probability of the order's total and the supplier's number, its quantity being the draw."""
    lines = _lines(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    eta = (0.6 + F.col("l_suppkey") % 5 * 0.3) * ((F.col("o_totalprice") - 250000) / 140000 - (F.col("l_suppkey") % 7 - 3) / 3)
    return lines.select(F.col("l_orderkey").alias("person"), F.col("l_suppkey").alias("item_id"), ((F.col("l_quantity") - 0.5) / 50 < 1 / (1 + F.exp(-eta))).cast("int").alias("response"))


@query(None)
def item_calibration(spark, sf_dir):
    found = calibration.calibrate(_marks(spark, sf_dir), "person", "item_id")
    return rounded(found.items, 4)


_LINK = "WITH i AS (SELECT 0.5 + p_size / 50.0 AS ra, (p_retailprice - 1400) / 300 AS rb, (0.5 + p_size / 50.0) * 1.2 AS fa, ((p_retailprice - 1400) / 300 - 0.4) / 1.2 AS fb FROM part)"


def _linked(spark, sf_dir, method):
    reference = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (0.5 + F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - 1400) / 300).alias("b"))
    focal = reference.select("item_id", (F.col("a") * 1.2).alias("a"), ((F.col("b") - 0.4) / 1.2).alias("b"))
    return rounded(calibration.curve_link(reference, focal, "item_id", method).select("method", "n_anchors", "A", "B", "loss"), 5)


@query(_LINK + " SELECT 'stocking_lord' AS method, count(*) AS n_anchors, 1.2::DOUBLE AS \"A\", 0.4::DOUBLE AS \"B\", round(sum(abs(fa / 1.2 - ra) + abs(1.2 * fb + 0.4 - rb)), 5)::DOUBLE AS loss FROM i")
def stocking_lord_link(spark, sf_dir):
    return _linked(spark, sf_dir, "stocking_lord")


@query(_LINK + " SELECT 'haebara' AS method, count(*) AS n_anchors, 1.2::DOUBLE AS \"A\", 0.4::DOUBLE AS \"B\", round(sum(abs(fa / 1.2 - ra) + abs(1.2 * fb + 0.4 - rb)), 5)::DOUBLE AS loss FROM i")
def haebara_link(spark, sf_dir):
    return _linked(spark, sf_dir, "haebara")


def _cox_sql(strata: str, rounds: int = 8) -> str:
    """CTEs of Newton rounds for one covariate x by key with Breslow ties: c (key, n, b, s) and p (key, t, d, mean covariate of those at risk)."""
    out = [_SUM_LATENCIES[5:] + f", v AS (SELECT {strata} AS key, CASE WHEN f IS NULL THEN 1000 ELSE f - a END AS t, (f IS NOT NULL)::INT AS e, c_acctbal / 5000 AS x FROM lat JOIN customer ON c_custkey = o_custkey), c0 AS (SELECT key, 0.0::DOUBLE AS b FROM v GROUP BY key)"]
    for k in range(rounds):
        out.append(f"t{k} AS (SELECT key, b, t, sum(e) AS d, sum(e * x) AS ex, sum(exp(b * x)) AS s0, sum(x * exp(b * x)) AS s1, sum(x * x * exp(b * x)) AS s2 FROM v JOIN c{k} USING (key) GROUP BY ALL)")
        out.append(f"q{k} AS (SELECT key, b, t, d, ex, sum(s0) OVER w AS r0, sum(s1) OVER w AS r1, sum(s2) OVER w AS r2 FROM t{k} WINDOW w AS (PARTITION BY key ORDER BY t DESC))")
        out.append(f"c{k + 1} AS (SELECT key, any_value(b) + sum(ex - d * r1 / r0) / sum(d * (r2 / r0 - r1 * r1 / (r0 * r0))) AS b, 1 / sqrt(sum(d * (r2 / r0 - r1 * r1 / (r0 * r0)))) AS s FROM q{k} GROUP BY key)")
    return "WITH " + ", ".join(out)


def _censored(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 5000).alias("x"), "c_mktsegment")
    return _latencies(spark, sf_dir).join(customers, F.col("o_custkey") == F.col("c_custkey"))


@query(_cox_sql("c_nationkey % 4") + " SELECT key, n, 'x' AS term, round(b, 5) AS estimate, round(s, 5) AS std_error, round(exp(b), 5) AS hazard_ratio FROM c8 JOIN (SELECT key, count(*) AS n FROM v GROUP BY key) USING (key)")
def cox_regression(spark, sf_dir):
    fit = hazards.Cox(_censored(spark, sf_dir).withColumn("key", F.col("c_nationkey") % 4), ["key"], {"x": "x"})
    return rounded(fit.table().select("key", "n", "term", "estimate", "std_error", "hazard_ratio"), 5)


@query(_cox_sql("0") + ", s AS (SELECT v.t, x - r1 / r0 AS r FROM v JOIN q7 USING (t) WHERE e = 1 AND v.t > 0), k AS (SELECT rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS a, rank() OVER (ORDER BY r) AS z FROM (SELECT t, round(r, 12) AS r FROM s)) SELECT 'x' AS term, count(*) AS n, round(corr(a, z), 3) AS rho FROM k")
def cox_proportionality(spark, sf_dir):
    fit = hazards.Cox(_censored(spark, sf_dir), [], {"x": "x"})
    return rounded(fit.check().select("term", "n", "rho"), 3)


@query(None)
def cox_clustered(spark, sf_dir):
    data = _censored(spark, sf_dir).withColumn("z", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    return rounded(hazards.Cox(data, [], {"x": "x", "z": "z"}, cluster="c_nationkey").table().drop("conf_low", "conf_high"), 5)


@query(None)
def aft_weibull(spark, sf_dir):
    data = _censored(spark, sf_dir).withColumn("analysis_time", F.col("analysis_time") + 1)
    return rounded(hazards.fit_accelerated(data, [], {"x": "x"}, "weibull"), 4)


@query(None)
def aft_lognormal(spark, sf_dir):
    data = _censored(spark, sf_dir).withColumn("analysis_time", F.col("analysis_time") + 1)
    return rounded(hazards.fit_accelerated(data, [], {"x": "x"}, "lognormal"), 4)


_FOLDS = "fo AS (SELECT l_suppkey, (row_number() OVER (ORDER BY md5('1:' || l_suppkey), l_suppkey) - 1) % 5 + 1 AS fold FROM (SELECT DISTINCT l_suppkey FROM lineitem)), ro AS (SELECT fold, l_quantity / 10.0 AS x, (l_returnflag = 'R')::INT AS y FROM lineitem JOIN fo USING (l_suppkey)), r AS (SELECT f.fold AS key, x, y FROM ro, (SELECT DISTINCT fold FROM fo) f WHERE ro.fold != f.fold)"


@query(
    f"WITH {_FOLDS}, {newton('r')}, p AS (SELECT fold, y, 1 / (1 + exp(-(b0 + b1 * x))) AS p, n FROM ro JOIN f ON f.key = ro.fold) "
    "SELECT fold::INTEGER AS fold, any_value(n) AS n_analysis, count(*) AS n_assessment, 0::BIGINT AS n_buffer, 'estimated' AS status, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM p GROUP BY fold"
)
def grouped_cv(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(heldout.grouped_cv(rows, ["l_suppkey"], "y", {"quantity": F.col("l_quantity") / 10.0}), 6)


_CROSSED = "fo AS (SELECT l_suppkey, (row_number() OVER (ORDER BY md5('1:' || l_suppkey), l_suppkey) - 1) % 3 + 1 AS fs FROM (SELECT DISTINCT l_suppkey FROM lineitem)), fp AS (SELECT l_partkey, (row_number() OVER (ORDER BY md5('2:' || l_partkey), l_partkey) - 1) % 3 + 1 AS fp FROM (SELECT DISTINCT l_partkey FROM lineitem)), ro AS (SELECT fs, fp, l_quantity / 10.0 AS x, (l_returnflag = 'R')::INT AS y FROM lineitem JOIN fo USING (l_suppkey) JOIN fp USING (l_partkey)), r AS (SELECT f.fs AS key, x, y FROM ro, (SELECT DISTINCT fs FROM fo) f WHERE ro.fs != f.fs AND ro.fp != f.fs)"


@query(
    f"WITH {_CROSSED}, {newton('r')}, p AS (SELECT fs, y, 1 / (1 + exp(-(b0 + b1 * x))) AS p, n FROM ro JOIN f ON f.key = ro.fs WHERE fs = fp) "
    "SELECT fs::INTEGER AS fold, any_value(n) AS n_analysis, count(*) AS n_assessment, (SELECT count(*) FROM ro) - any_value(n) - count(*) AS n_buffer, 'estimated' AS status, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) ** 2), 6) AS brier, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM p GROUP BY fs"
)
def crossed_grouped_cv(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(heldout.grouped_cv(rows, ["l_suppkey", "l_partkey"], "y", {"quantity": F.col("l_quantity") / 10.0}, folds=3), 6)


_ASOF = "WITH s AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t FROM events), g AS (SELECT * FROM s WHERE event_type != 'view'), v AS (SELECT user_id, t, value FROM s WHERE event_type = 'view')"


@query(_ASOF + " SELECT g.event_id, CASE WHEN g.t - v.t <= 20000 THEN v.value END AS view_x, round(g.t - v.t, 5) AS gap, CASE WHEN v.t IS NULL THEN 'unmatched' WHEN g.t - v.t > 20000 THEN 'outside_tolerance' ELSE 'matched' END AS asof_status FROM g ASOF LEFT JOIN v ON g.user_id = v.user_id AND g.t >= v.t")
def asof_backward(spark, sf_dir):
    s = samples(spark, sf_dir)
    views = s.filter("event_type = 'view'").select("user_id", F.col("t").alias("seen"), F.col("x").alias("view_x"))
    found = alignment.as_of(s.filter("event_type != 'view'").select("event_id", "user_id", "t"), views, ["user_id"], "t", "seen", ["view_x"], "backward", 20000.0)
    return found.select("event_id", "view_x", F.round("gap", 5).alias("gap"), "asof_status")


@query(
    _ASOF + ", b AS (SELECT g.event_id, g.t, g.user_id, v.t AS t0, v.value AS a FROM g ASOF LEFT JOIN v ON g.user_id = v.user_id AND g.t >= v.t), n AS (SELECT b.*, v.t AS t1, v.value AS c FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t < v.t), "
    "h AS (SELECT *, (t - t0) / (t1 - t0) AS f FROM n) "
    "SELECT event_id, CASE WHEN t1 IS NULL OR t0 IS NULL THEN NULL ELSE round(sin(least(a, 150) / 200 + (least(c, 150) - least(a, 150)) / 200 * f), 6) END AS qz, CASE WHEN t1 IS NULL OR t0 IS NULL THEN NULL ELSE round(cos(least(a, 150) / 200 + (least(c, 150) - least(a, 150)) / 200 * f), 6) END AS qw, CASE WHEN t1 IS NULL OR t0 IS NULL THEN NULL ELSE round(a + (c - a) * f, 6) END AS px, CASE WHEN t1 IS NULL OR t0 IS NULL THEN 'outside' ELSE 'aligned' END AS pose_status FROM h"
)
def head_pose_alignment(spark, sf_dir):
    s = samples(spark, sf_dir)
    # the head turns about the vertical by value / 100, so the arc between two poses is a line in the angle
    pose = s.filter("event_type = 'view'").select("user_id", "t", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.least("x", F.lit(150.0)) / 200).alias("qz"), F.cos(F.least("x", F.lit(150.0)) / 200).alias("qw"), F.col("x").alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"))
    found = alignment.align_head_pose_to_gaze(s.filter("event_type != 'view'").select("event_id", "user_id", "t"), pose, ["user_id"], "t", "t")
    return rounded(found.select("event_id", "qz", "qw", "px", "pose_status"), 6)


def _two_kinds(spark, sf_dir):
    """Order lines whose quantity and discount depend on the supplier's parity: two classes of overlapping normal-like sums."""
    rows = _lines(spark, sf_dir)
    shift = F.col("l_suppkey") % 2
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), (F.col("l_quantity") / 10.0 + shift * 6).alias("a"), (F.col("l_discount") * 30 - shift * 3 + F.col("l_tax") * 10).alias("b"))


@query(None)
def profile_mixture(spark, sf_dir):
    fit = latent.fit_mixture(_two_kinds(spark, sf_dir), ["a", "b"], 2, "key", rounds=30)
    return rounded(fit.summary(spark), 4)


@query(None)
def process_states(spark, sf_dir):
    s = samples(spark, sf_dir)
    fit, pieces = latent.fit_states(s, "user_id", "t", ["x"], 2, "event_id", rounds=12)
    return rounded(latent.occupancy(fit, pieces, "user_id", "t"), 4)


@query(None)
def process_state_paths(spark, sf_dir):
    s = samples(spark, sf_dir)
    fit, pieces = latent.fit_states(s, "user_id", "t", ["x"], 2, "event_id", rounds=12)
    return latent.paths(fit, pieces, "user_id", "t").groupBy("user_id", "state").agg(F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT l_suppkey AS key, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS q, sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2)) AS s, regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS m FROM lineitem GROUP BY 1) "
    "SELECT key, n, round(q, 6) AS r_squared, round(s, 3) AS residual_sd, '(intercept)' AS term, round(a, 3) AS estimate, round(s * sqrt(1.0 / n + m * m / sxx), 3) AS std_error FROM r UNION ALL SELECT key, n, round(q, 6), round(s, 3), 'quantity', round(b, 3), round(s / sqrt(sxx), 3) FROM r"
)
def linear_by_group(spark, sf_dir):
    fit = linear.fit_linear(_lines(spark, sf_dir), ["l_suppkey"], "l_extendedprice", {"quantity": "l_quantity"})
    return fit.select(F.col("l_suppkey").alias("key"), "n", F.round("r_squared", 6).alias("r_squared"), F.round("residual_sd", 3).alias("residual_sd"), "term", F.round("estimate", 3).alias("estimate"), F.round("std_error", 3).alias("std_error"))


@query(
    "WITH s AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t FROM events), g AS (SELECT * FROM s WHERE event_type != 'view'), v AS (SELECT user_id, t AS e FROM s WHERE event_type = 'view'), "
    "k AS (SELECT event_id, sum(CASE WHEN g.t > e THEN exp(3 * (ln((g.t - e) / 20000) + 1 - (g.t - e) / 20000)) ELSE 0 END) AS k FROM g JOIN v ON g.user_id = v.user_id AND g.t >= e AND g.t <= e + 120000 GROUP BY event_id), "
    "m AS (SELECT user_id, max(k) AS m FROM g JOIN k USING (event_id) GROUP BY user_id), x AS (SELECT user_id, value, coalesce(k / m, 0) AS k FROM g LEFT JOIN k USING (event_id) LEFT JOIN m USING (user_id)) "
    "SELECT user_id, count(*) AS n, '(intercept)' AS term, round(regr_intercept(value, k), 4) AS estimate, round(regr_r2(value, k), 5) AS r_squared FROM x GROUP BY user_id UNION ALL SELECT user_id, count(*), 'view', round(regr_slope(value, k), 4), round(regr_r2(value, k), 5) FROM x GROUP BY user_id"
)
def pupil_deconvolution_events(spark, sf_dir):
    s = samples(spark, sf_dir)
    views = s.filter("event_type = 'view'").select("user_id", F.col("t").alias("at"), "event_type")
    fit = linear.fit_pupil_event_deconvolution(s.filter("event_type != 'view'"), views, ["user_id"], "t", "x", "at", "event_type", ["view"], 20000.0, 3.0)
    return fit.select("user_id", "n", "term", F.round("estimate", 4).alias("estimate"), F.round("r_squared", 5).alias("r_squared"))


@query(None)
def pupil_confounds(spark, sf_dir):
    s = samples(spark, sf_dir).withColumns({"order": F.col("t") / 1e6, "luminance": F.col("y")})
    found, _ = linear.fit_pupil_confound_model(s, "x", "luminance", "order", factors=["user_id", "event_type"])
    return rounded(found, 4)


@query(
    "WITH s AS (SELECT user_id % 5 AS g, value AS x, (event_id * 7919 % 1000) / 100.0 AS y FROM events), e AS (SELECT g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s GROUP BY g), b AS (SELECT s.g, least(greatest(ceil((x - x0) / ((x1 - x0) / 12)), 1), 12) AS i, least(greatest(ceil((y - y0) / ((y1 - y0) / 12)), 1), 12) AS j FROM s JOIN e ON s.g = e.g), c AS (SELECT g, i, j, count(*) AS n FROM b GROUP BY ALL) "
    "SELECT g, count(*) AS n_cells, sum(n)::BIGINT AS n, round(sum(ln(n)), 5) AS total, 0.0::DOUBLE AS rest, 0.0::DOUBLE AS rest_x, 0.0::DOUBLE AS rest_y, 0.0::DOUBLE AS rest_xy FROM c GROUP BY g"
)
def fixation_intensity(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("g", F.col("user_id") % 5)
    _, cells, _ = linear.fit_fixation_point_process(s, ["g"], "x", "y", "t", 12)
    # normal equations: what the logarithms leave is orthogonal to every term
    rest = F.ln(F.col("count").cast("double")) - F.ln("expected")
    a, b = F.col("x_center"), F.col("y_center")
    sums = {"rest": F.sum(rest), "rest_x": F.sum(rest * a), "rest_y": F.sum(rest * b), "rest_xy": F.sum(rest * a * b)}
    return cells.groupBy("g").agg(F.count("*").alias("n_cells"), F.sum("count").alias("n"), F.round(F.sum(F.ln(F.col("count").cast("double"))), 5).alias("total"), *((F.round(v, 4) + 0.0).alias(k) for k, v in sums.items()))


@query(None)
def marked_gaze_process(spark, sf_dir):
    s = samples(spark, sf_dir).withColumns({"g": F.col("user_id") % 5, "duration": F.col("event_id") % 37, "time": F.col("t") / 1e6})
    return rounded(linear.fit_marked_gaze_process(s, ["g"], ["duration"], "x", "y", "time").select("g", "mark", "n", "term", "estimate", "std_error"), 4)


@query(None)
def multiblock_map(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.stddev_samp("l_quantity").alias("qs"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_extendedprice").alias("p"))
    found = components.fit_multiblock_process_map(orders, {"size": ["q", "qs", "p"], "terms": ["d", "t"]}, "l_suppkey", 2, "first_axis")
    return rounded(found.persons, 4)


@query(None)
def pupil_phase_amplitude(spark, sf_dir):
    curves = components.register_pupil_curves(samples(spark, sf_dir), "user_id", "t", "x", points=21)
    found, _ = components.decompose_pupil_phase_amplitude(curves, "user_id", 2, 21)
    return rounded(found, 4)
