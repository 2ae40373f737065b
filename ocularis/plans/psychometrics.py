"""Registered queries of item response theory, recovery, sensitivity and negative controls, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import irt, validation
from .catalogue import _GRID, _ITEMS, _RESP, _S, _U, _items, _responses, query, rounded, samples, table

_PART_P = f"WITH {_ITEMS}, t AS (SELECT item_id, a, b, b + 0.5 AS theta, 0.1 + a / 20 AS c, 0.9 + a / 50 AS d FROM i)"


def _at_half(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).withColumns({"theta": F.col("b") + 0.5, "c": 0.1 + F.col("a") / 20, "d": 0.9 + F.col("a") / 50})


@query(_PART_P + ", q AS (SELECT *, 1 / (1 + exp(-a * (theta - b))) AS q FROM t) SELECT item_id, round(c + (1 - c) * q, 7) AS p3, round(c + (d - c) * q, 7) AS p4, round((a * (d - c) * q * (1 - q)) ** 2 / ((c + (d - c) * q) * (1 - c - (d - c) * q)), 7) AS information, round(1 / sqrt((a * (d - c) * q * (1 - q)) ** 2 / ((c + (d - c) * q) * (1 - c - (d - c) * q))), 6) AS sem FROM q")
def item_probabilities(spark, sf_dir):
    i = _at_half(spark, sf_dir)
    theta, a, b, c, d = (F.col(k) for k in ("theta", "a", "b", "c", "d"))
    info = irt.item_information(theta, a, b, c, d)
    return i.select("item_id", F.round(irt.probability_3pl(theta, a, b, c), 7).alias("p3"), F.round(irt.probability_4pl(theta, a, b, c, d), 7).alias("p4"), F.round(info, 7).alias("information"), F.round(irt.conditional_sem(info), 6).alias("sem"))


@query(_PART_P + ", e AS (SELECT item_id, 1 / (1 + exp(-a * (theta - b + 1))) AS g1, 1 / (1 + exp(-a * (theta - b))) AS g2, exp(0) AS n0, exp(0.5 * theta + 0.2) AS n1, exp(a * theta - 0.4) AS n2, exp(a * (theta - b)) AS k1, exp(a * (theta - b) + a * (theta - b - 1)) AS k2 FROM t) SELECT item_id, round(1 - g1, 7) AS g0, round(g1 - g2, 7) AS g1, round(g2, 7) AS g2, round((n1 + 2 * n2) / (n0 + n1 + n2), 6) AS nominal_score, round((k1 + 2 * k2) / (1 + k1 + k2), 6) AS partial_score FROM e")
def category_probabilities(spark, sf_dir):
    i = _at_half(spark, sf_dir)
    theta, a, b = F.col("theta"), F.col("a"), F.col("b")
    graded = irt.probability_grm(theta, a, F.array(b - 1, b))
    nominal = irt.probability_nominal(theta, F.array(F.lit(0.0), F.lit(0.5), a), F.array(F.lit(0.0), F.lit(0.2), F.lit(-0.4)))
    partial = irt.probability_gpcm(theta, a, F.array(b, b + 1))
    return i.select("item_id", *(F.round(F.get(graded, F.lit(k)), 7).alias(f"g{k}") for k in range(3)), F.round(irt.expected_category(nominal), 6).alias("nominal_score"), F.round(irt.expected_category(partial), 6).alias("partial_score"))


_INFO = f"WITH {_ITEMS}, {_GRID}, p AS (SELECT theta, a, 1 / (1 + exp(-a * (theta - b))) AS p FROM i, g), c AS (SELECT theta, sum(a * a * p * (1 - p)) AS information FROM p GROUP BY theta)"


@query(_INFO + " SELECT round(sum(part), 3) AS area FROM (SELECT (information + lag(information) OVER w) / 2 * (theta - lag(theta) OVER w) AS part FROM c WINDOW w AS (ORDER BY theta))")
def information_area(spark, sf_dir):
    return rounded(irt.information_area(irt.test_information(_items(spark, sf_dir), irt.theta_grid())), 3)


@query(_INFO + " SELECT round(min(information), 4) AS min_information, round(max(1 / sqrt(information)), 6) AS max_sem, count(*) AS n_points FROM c WHERE theta BETWEEN -2.00001 AND 2.00001")
def precision_profile(spark, sf_dir):
    found = irt.precision_profile(irt.test_information(_items(spark, sf_dir), irt.theta_grid()), -2.00001, 2.00001)
    return found.select(F.round("min_information", 4).alias("min_information"), F.round("max_sem", 6).alias("max_sem"), "n_points")


_DTF = f"WITH {_ITEMS}, {_GRID}, d AS (SELECT theta, sum(1 / (1 + exp(-a * (theta - b)))) AS r, sum(1 / (1 + exp(-a * (theta - b - 0.3)))) AS f FROM i, g GROUP BY theta)"


def _dtf(spark, sf_dir) -> DataFrame:
    i = _items(spark, sf_dir)
    return irt.dtf_curve(i, i.withColumn("b", F.col("b") + 0.3), irt.theta_grid())


@query(_DTF + " SELECT round(theta, 4)::DOUBLE AS theta, round(r, 4) AS reference, round(f, 4) AS focal, round(f - r, 4) AS difference FROM d")
def dtf_curve(spark, sf_dir):
    return rounded(_dtf(spark, sf_dir), 4)


@query(_DTF + " SELECT round(max(abs(f - r)), 4) AS max_abs, round(avg(abs(f - r)), 4) AS mean_abs, round(sum(part), 3) AS signed_area FROM (SELECT *, ((f - r) + lag(f - r) OVER w) / 2 * (theta - lag(theta) OVER w) AS part FROM d WINDOW w AS (ORDER BY theta))")
def functioning_effects(spark, sf_dir):
    found = irt.functioning_effects(_dtf(spark, sf_dir))
    return found.select(F.round("max_abs", 4).alias("max_abs"), F.round("mean_abs", 4).alias("mean_abs"), F.round("signed_area", 3).alias("signed_area"))


_EAP = _RESP + f", {_GRID}, l AS (SELECT person, g.theta, count(*) AS n, sum(-ln(1 + exp((CASE WHEN response = 1 THEN a ELSE -a END) * (b - g.theta)))) - g.theta * g.theta / 2 AS l FROM p, g GROUP BY person, g.theta), w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY person)) AS w FROM l), e AS (SELECT person, sum(w * theta) / sum(w) AS theta, sqrt(sum(w * theta * theta) / sum(w) - (sum(w * theta) / sum(w)) ** 2) AS se FROM w GROUP BY person)"


def _scores(spark, sf_dir) -> DataFrame:
    return irt.eap_scores(_responses(spark, sf_dir), _items(spark, sf_dir), "person")


@query(_EAP + " SELECT count(*) AS n, round(least(1, greatest(0, 1 - avg(se * se) / var_samp(theta * 3))), 6) AS reliability FROM e")
def marginal_reliability(spark, sf_dir):
    scored = irt.marginal_reliability(_scores(spark, sf_dir).withColumn("theta", F.col("theta") * 3.0))
    return rounded(scored, 6)


@query(_EAP + " SELECT round(avg(se), 6) AS mean_se, round(median(se), 6) AS median_se, round(quantile_cont(se, 0.95), 6) AS p95_se FROM e")
def score_uncertainty(spark, sf_dir):
    return rounded(irt.score_uncertainty(_scores(spark, sf_dir)), 6)


@query(_EAP + " SELECT person, CASE WHEN theta / se >= 1.2815515655 THEN 'above' WHEN theta / se <= -1.2815515655 THEN 'below' ELSE 'uncertain' END AS decision FROM e")
def classification(spark, sf_dir):
    return irt.classification_precision(_scores(spark, sf_dir), 0.0, 0.9).select("person", "decision")


@query("SELECT 'person' AS kind, l_orderkey::VARCHAR AS id, count(*) AS n, count(*) < 3 AS sparse FROM lineitem GROUP BY l_orderkey UNION ALL SELECT 'item', l_partkey::VARCHAR, count(*), count(*) < 25 FROM lineitem GROUP BY l_partkey")
def sparse_design(spark, sf_dir):
    return irt.sparse_design_audit(_responses(spark, sf_dir), "person", "item_id", 3, 25)


@query(_RESP + ", s AS (SELECT person, avg(response) AS s FROM p GROUP BY person) SELECT count(*) AS n, round(avg((s <= 0.02)::INT), 6) AS at_floor, round(avg((s >= 0.98)::INT), 6) AS at_ceiling FROM s")
def extreme_scores(spark, sf_dir):
    return rounded(irt.extreme_score_audit(_responses(spark, sf_dir), "person"), 6)


@query(f"WITH {_ITEMS} SELECT item_id, a BETWEEN 0.6 AND 1.4 AS a_ok, b BETWEEN -1.5 AND 1 AS b_ok, a BETWEEN 0.6 AND 1.4 AND b BETWEEN -1.5 AND 1 AS plausible FROM i")
def parameter_plausibility(spark, sf_dir):
    return irt.parameter_plausibility_audit(_items(spark, sf_dir), (0.6, 1.4), (-1.5, 1.0)).select("item_id", "a_ok", "b_ok", "plausible")


@query(f"WITH {_ITEMS} SELECT count(*) AS n_anchors, round(stddev_samp(b) / stddev_samp(b * 1.25 + a), 7) AS \"A\", round(avg(b) - stddev_samp(b) / stddev_samp(b * 1.25 + a) * avg(b * 1.25 + a), 7) AS \"B\" FROM i")
def mean_sigma(spark, sf_dir):
    i = _items(spark, sf_dir)
    return rounded(irt.mean_sigma_link(i, i.withColumn("b", F.col("b") * 1.25 + F.col("a"))), 7)


_SESSIONS = "WITH m AS (SELECT l_suppkey AS item, l_linenumber AS s, avg(l_discount) AS b FROM lineitem GROUP BY ALL)"


@query(_SESSIONS + " SELECT item, round(arg_min(b, s), 7) AS \"first\", round(arg_max(b, s), 7) AS \"last\", round(arg_max(b, s) - arg_min(b, s), 7) AS change, round(max(b) - min(b), 7) AS range FROM m GROUP BY item")
def session_drift(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("s")).agg(F.avg("l_discount").alias("b"))
    return rounded(irt.session_drift(m, "item", "s"), 7)


@query(f"WITH {_ITEMS}, u AS (SELECT item_id, a * a / (1 + exp(-a * (0.4 - b))) * (1 - 1 / (1 + exp(-a * (0.4 - b)))) AS f FROM i WHERE item_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)) SELECT arg_max(item_id, f) AS item_id, round(max(f), 7) AS information FROM u")
def item_selected(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("item_id"))
    return rounded(irt.item_selection(_items(spark, sf_dir), 0.4, used), 7)


@query("WITH n AS (SELECT p_partkey AS item_id, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) SELECT item_id, n, round(n / sum(n) OVER (), 9) AS exposure FROM n")
def exposure(spark, sf_dir):
    return rounded(irt.exposure_summary(_responses(spark, sf_dir), _items(spark, sf_dir)), 9)


@query("WITH c AS (SELECT p_type AS content, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), t AS (SELECT p_type AS content, count(*) / (SELECT count(*) FROM part) AS target FROM part GROUP BY 1) SELECT t.content, round(target, 7) AS target, coalesce(n, 0) AS n, round(coalesce(n / sum(n) OVER (), 0), 7) AS observed, round(coalesce(n / sum(n) OVER (), 0) - target, 7) AS difference FROM t LEFT JOIN c ON c.content = t.content")
def content_balance(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    bank = part.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("content"))
    whole = part.agg(F.count("*").alias("w"))
    target = bank.groupBy("content").agg(F.count("*").alias("k")).crossJoin(F.broadcast(whole)).select("content", (F.col("k") / F.col("w")).alias("target"))
    return rounded(irt.content_balance_audit(_responses(spark, sf_dir), bank, target), 7)


@query("SELECT l_suppkey, count(*) AS n, round(avg((l_quantity > 25)::INT), 7) AS accuracy, round(avg(ln(l_extendedprice)), 7) AS mean_log_rt, round(corr((l_quantity > 25)::INT, ln(l_extendedprice)), 6) AS r FROM lineitem GROUP BY l_suppkey")
def speed_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", (F.col("l_quantity") > 25).cast("int"))
    found = irt.speed_accuracy_profile(rows, "l_suppkey", "x", "l_extendedprice")
    return found.select("l_suppkey", "n", F.round("accuracy", 7).alias("accuracy"), F.round("mean_log_rt", 7).alias("mean_log_rt"), F.round("r", 6).alias("r"))


@query("SELECT (l_quantity > 10)::INT::VARCHAR || (l_discount > 0.03)::INT::VARCHAR || (l_tax > 0.02)::INT::VARCHAR AS pattern, count(*) AS n FROM lineitem GROUP BY 1")
def missing_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 10, 1).alias("q"), F.when(F.col("l_discount") > 0.03, 1).alias("d"), F.when(F.col("l_tax") > 0.02, 1).alias("t"))
    return irt.missingness_pattern(rows, ["q", "d", "t"])


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, avg((l_quantity > 20)::INT) AS raw, avg(l_extendedprice / 40000) FILTER (l_quantity > 20) AS m, var_samp(l_extendedprice / 40000) FILTER (l_quantity > 20) AS v FROM lineitem GROUP BY 1), p AS (SELECT *, least(greatest(raw, 1 / (2 * n)), 1 - 1 / (2 * n)) AS pc FROM s), l AS (SELECT *, ln(pc / (1 - pc)) AS l FROM p), d AS (SELECT *, sign(pc - 0.5) * 0.1 * greatest(l * (l * pc * pc - l * pc + pc - 0.5) / v, 0) ** 0.25 AS drift FROM l)
SELECT l_suppkey, round(drift, 7) AS drift, round(0.01 * l / drift, 7) AS boundary, round(m - (0.01 * l / drift) / (2 * drift) * (1 - exp(-drift * (0.01 * l / drift) / 0.01)) / (1 + exp(-drift * (0.01 * l / drift) / 0.01)), 6) AS nondecision FROM d""")
def ez_diffusion(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") > 20).cast("int").alias("x"), (F.col("l_extendedprice") / 40000).alias("rt"))
    found = irt.ez_diffusion(rows, ["l_suppkey"], "x", "rt")
    return found.select("l_suppkey", F.round("drift", 7).alias("drift"), F.round("boundary", 7).alias("boundary"), F.round("nondecision", 6).alias("nondecision"))


@query(f"WITH {_S}, e AS (SELECT event_id % 500 AS item_id, user_id AS profile, floor(t / 3600)::BIGINT % 24 AS skill FROM s), q AS (SELECT DISTINCT item_id, skill FROM e), h AS (SELECT DISTINCT profile, skill FROM e), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1) SELECT item_id, profile, (count(*) = any_value(n))::INT AS ideal FROM q JOIN h USING (skill) JOIN n USING (item_id) GROUP BY ALL")
def dina_ideal(spark, sf_dir):
    s = samples(spark, sf_dir).select((F.col("event_id") % 500).alias("item_id"), F.col(_U).alias("profile"), (F.floor(F.col("t") / 3600) % 24).alias("skill"))
    return irt.dina_ideal_response(s, s)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN 'answered' WHEN l_linenumber > 4 THEN 'not_reached' WHEN l_discount <= 0.05 THEN 'not_seen' ELSE 'omitted' END AS missingness FROM lineitem")
def item_missingness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 10, 1).alias("x"), (F.col("l_linenumber") <= 4).alias("reached"), (F.col("l_discount") > 0.05).alias("seen"))
    return irt.classify_item_missingness(rows, "x", "reached", "seen").select("l_orderkey", "l_linenumber", "missingness")


@query("SELECT l_orderkey, coalesce(string_agg(l_linenumber::VARCHAR, '|' ORDER BY l_linenumber) FILTER (l_quantity > 25), '<none>') AS combination FROM lineitem GROUP BY l_orderkey")
def response_combinations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("o"), (F.col("l_quantity") > 25).alias("s"))
    return irt.encode_response_combinations(rows, ["l_orderkey"], "o", "s")


@query(f"WITH {_ITEMS}, m AS (SELECT unnest(range(0, 16)) AS bin), g AS (SELECT bin, -4 + (bin + 0.5) * 0.5 AS theta FROM m), f AS (SELECT bin, sum(a * a / (1 + exp(-a * (theta - b))) * (1 - 1 / (1 + exp(-a * (theta - b))))) AS f FROM i, g GROUP BY bin), t AS (SELECT floor(((o_totalprice - 150000) / 75000 + 4) / 0.5)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1) SELECT f.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 7) AS person_share, round(f / sum(f) OVER (), 7) AS information_share, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER () - f / sum(f) OVER (), 7) AS gap FROM f LEFT JOIN t ON t.bin = f.bin")
def targeting(spark, sf_dir):
    abilities = table(spark, sf_dir, "orders").select(((F.col("o_totalprice") - 150000) / 75000).alias("theta"))
    return rounded(irt.targeting_gap(abilities, _items(spark, sf_dir)).drop("information"), 7)


@query(f"""WITH {_S}, r AS (SELECT user_id, row_number() OVER w AS i, sum(x) OVER w AS s, sum(x * x) OVER w AS q, sum(x) OVER g AS st, sum(x * x) OVER g AS qt, count(*) OVER g AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY user_id)), d AS (SELECT *, n * ln(greatest(qt - st * st / n, 1e-12) / n) - (n * ln((greatest(q - s * s / i, 1e-12) + greatest(qt - q - (st - s) ** 2 / (n - i), 1e-12)) / n) + 2 * ln(n)) AS d FROM r WHERE i >= 5 AND n - i >= 5)
SELECT user_id, arg_max(i, d) AS "position", round(max(d), 5) AS delta_sic FROM d GROUP BY user_id""")
def sic_changepoints(spark, sf_dir):
    found = irt.changepoints_by_sic(samples(spark, sf_dir), [_U], "t", "x")
    return rounded(found.withColumn("position", F.col("position").cast("long")))


_REC = "WITH r AS (SELECT l_returnflag AS k, l_quantity AS e, 20 + l_linenumber AS t, l_quantity - 8 AS lo, l_quantity + 8 AS hi FROM lineitem)"


def _recovery(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), "l_linenumber", q.alias("estimate"), (20.0 + F.col("l_linenumber")).alias("truth"), (q - 8).alias("lower"), (q + 8).alias("upper"))


@query(_REC + " SELECT k, count(*) AS n, round(avg(e - t), 7) AS bias, round(sqrt(avg((e - t) ** 2)), 7) AS rmse, round(avg((t BETWEEN lo AND hi)::INT), 7) AS coverage, round(stddev_samp(e), 7) AS estimate_sd FROM r GROUP BY k")
def process_validation(spark, sf_dir):
    return rounded(validation.summarise_process_validation(_recovery(spark, sf_dir), ["k"]), 7)


@query(_REC + " SELECT k, count(*) AS n, round(stddev_samp(e) / sqrt(count(*)), 7) AS mcse FROM r GROUP BY k")
def validation_mcse(spark, sf_dir):
    return rounded(validation.validation_summary_mcse(_recovery(spark, sf_dir), ["k"]), 7)


@query(_REC + ", s AS (SELECT k, sqrt(avg((e - t) ** 2)) AS r, abs(avg(e - t)) AS b, abs(avg((t BETWEEN lo AND hi)::INT) - 0.95) AS c FROM r GROUP BY k) SELECT k, round(1 - (coalesce((r - min(r) OVER ()) / nullif(max(r) OVER () - min(r) OVER (), 0), 0) + coalesce((b - min(b) OVER ()) / nullif(max(b) OVER () - min(b) OVER (), 0), 0) + coalesce((c - min(c) OVER ()) / nullif(max(c) OVER () - min(c) OVER (), 0), 0)) / 3, 6) AS robustness FROM s")
def condition_ranking(spark, sf_dir):
    ranked = validation.validation_condition_ranking(validation.summarise_recovery(_recovery(spark, sf_dir), ["k"]))
    return rounded(ranked.select("k", "robustness"), 6)


_RANKS = "WITH k AS (SELECT l_orderkey, count(*) FILTER (l_quantity < 26) AS rank, count(*) AS n_draws FROM lineitem GROUP BY 1)"


def _ranks(spark, sf_dir) -> DataFrame:
    return validation.sbc_ranks(table(spark, sf_dir, "lineitem").withColumn("truth", F.lit(26.0)), ["l_orderkey"], "l_quantity", "truth")


@query(_RANKS + " SELECT * FROM k")
def sbc_ranks(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(_RANKS + ", b AS (SELECT least(9, floor(rank * 10 / (n_draws + 1)))::BIGINT AS bin, count(*) AS n FROM k GROUP BY 1) SELECT bin, n, round(n - sum(n) OVER () / 10, 4) AS excess FROM b")
def sbc_bins(spark, sf_dir):
    return rounded(validation.sbc_bins(_ranks(spark, sf_dir)).withColumn("bin", F.col("bin").cast("long")), 4)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def specification_curve(spark, sf_dir):
    ranked = validation.specification_curve(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", ["o_orderpriority"])
    return ranked.select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("WITH l AS (SELECT 'o_orderstatus' AS decision, o_orderstatus AS level, avg(o_totalprice) AS m FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 2) SELECT decision, count(*) AS n_levels, round(max(m) - min(m), 4) AS leverage FROM l GROUP BY decision")
def decision_leverage(spark, sf_dir):
    return rounded(validation.decision_leverage(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"]), 4)


@query("WITH m AS (SELECT o_orderpriority || ' ' || CASE o_orderkey % 5 WHEN 0 THEN 'did not Converge' WHEN 1 THEN 'singular matrix' WHEN 2 THEN 'timeout in memory' WHEN 3 THEN 'NaN at a boundary' ELSE 'unclear' END AS s FROM orders), k AS (SELECT CASE WHEN lower(s) LIKE '%boundary%' THEN 'boundary' WHEN lower(s) LIKE '%missing%' OR lower(s) LIKE '%nan%' THEN 'missing_data' WHEN lower(s) LIKE '%memory%' THEN 'memory' WHEN lower(s) LIKE '%timeout%' THEN 'timeout' WHEN lower(s) LIKE '%singular%' THEN 'identification' WHEN lower(s) LIKE '%converg%' THEN 'convergence' ELSE 'other' END AS kind FROM m) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def failure_kinds(spark, sf_dir):
    texts = F.array(*map(F.lit, ("did not Converge", "singular matrix", "timeout in memory", "NaN at a boundary", "unclear")))
    said = F.concat_ws(" ", "o_orderpriority", F.get(texts, (F.col("o_orderkey") % 5).cast("int")))
    return table(spark, sf_dir, "orders").groupBy(validation.failure_taxonomy(said).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders), 4) AS gap FROM orders GROUP BY o_orderpriority")
def fairness(spark, sf_dir):
    return rounded(validation.fairness_gap(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 4)


@query(f"WITH {_S} SELECT event_type, count(x) AS n, round(avg(x), 7) AS mean, round(avg(x) - 20, 7) AS difference FROM s WHERE t BETWEEN 500000 AND 1500000 GROUP BY event_type")
def placebo_window(spark, sf_dir):
    return rounded(validation.placebo_window_audit(samples(spark, sf_dir), "t", "x", 500000.0, 1500000.0, 20.0, ["event_type"]), 7)


@query("SELECT count(*) AS n, round(avg((o_totalprice <= 200000)::INT), 7) AS percentile, round((1 + count(*) FILTER (abs(o_totalprice) >= 200000)) / (1 + count(*)), 7) AS two_sided, round((200000 - avg(o_totalprice)) / stddev_samp(o_totalprice), 7) AS standardised FROM orders")
def null_benchmark(spark, sf_dir):
    return rounded(validation.null_benchmark(200000.0, table(spark, sf_dir, "orders"), "o_totalprice"), 7)


@query("WITH f AS (SELECT o_orderkey, (SELECT 1) AS x, o_custkey FROM orders), c AS (SELECT o_custkey, (row_number() OVER (ORDER BY md5('1:' || o_custkey), o_custkey) - 1) % 5 + 1 AS fc FROM (SELECT DISTINCT o_custkey FROM orders)), p AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY md5('2:' || o_orderpriority), o_orderpriority) - 1) % 5 + 1 AS fp FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, CASE WHEN fc = 1 AND fp = 1 THEN 'assessment' WHEN fc = 1 OR fp = 1 THEN 'buffer' ELSE 'analysis' END AS role FROM orders JOIN c USING (o_custkey) JOIN p USING (o_orderpriority)")
def crossed_folds(spark, sf_dir):
    return validation.crossed_grouped_folds(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "role")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - l_linenumber * 5, 6) AS delta, l_quantity - l_linenumber * 5 > 1 AS leak FROM lineitem")
def temporal_leakage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_linenumber") * 5)
    return rounded(validation.audit_temporal_leakage(rows, "l_quantity", "o", 1.0).select("l_orderkey", "l_linenumber", "delta", "leak"), 6)


@query("SELECT p_name AS name, 'duplicate_name' AS issue FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT p_name, 'incomplete' FROM part WHERE p_size <= 2")
def missing_registry(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 2, F.col("p_size")).alias("size"))
    return validation.audit_missing_registry(rows, ["size"])
