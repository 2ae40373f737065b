"""Registered queries of detector agreement, audits, episodes, pupil frequency, linking and functioning, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, aoi, audits, banks, episodes, events, irt, scanpaths, survival
from .catalogue import _COMP, _GRID, _ITEMS, _RESP, _S, _SUM_LATENCIES, _TYPES, _U, _composition, _items, _latencies, _modelled, _responses, query, rounded, samples, table
from .process import _MEMBERS, _members, _spans, _spans_sql

#: Fixations of two limits of speed; those of the tighter lie within those of the looser, one to one where at least half of both agrees.
_TWO = f"WITH {_S}, p AS {_spans_sql(0.001)}, q AS {_spans_sql(0.004)}, o AS (SELECT p.user_id, p.a AS a0, p.b AS a1, q.a AS b0, q.b AS b1, coalesce((least(p.b, q.b) - greatest(p.a, q.a)) / nullif(greatest(p.b, q.b) - least(p.a, q.a), 0), 1) AS iou FROM p JOIN q ON p.user_id = q.user_id AND p.a <= q.b AND q.a <= p.b), m AS (SELECT * FROM o WHERE iou > 0.5)"


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return tuple(_spans(spark, sf_dir, v).select(_U, "start_time", "end_time", "duration_ms", "episode_type") for v in (0.001, 0.004))


@query(_TWO + " SELECT user_id, round(a0, 4) AS a_start, round(b0, 4) AS b_start, round(iou, 6) AS iou, round(b0 - a0, 4) AS onset_error, round(b1 - a1, 4) AS offset_error FROM m")
def detector_matches(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    found = agreement.detector_matches(a, b, [_U], "episode_type", 100000.0, 0.5000001)
    return found.select(_U, *(F.round(c, 4).alias(c) for c in ("a_start", "b_start")), F.round("iou", 6).alias("iou"), *(F.round(c, 4).alias(c) for c in ("onset_error", "offset_error")))


@query(_TWO + " SELECT 'fixation' AS episode_type, count(*) AS n, round(avg(b0 - a0), 3) AS mean_onset_error, round(stddev_samp(b0 - a0), 3) AS sd_onset_error, round(max(abs(b0 - a0)), 3) AS max_abs_onset_error, round(avg(b1 - a1), 3) AS mean_offset_error, round(stddev_samp(b1 - a1), 3) AS sd_offset_error, round(max(abs(b1 - a1)), 3) AS max_abs_offset_error FROM m")
def boundary_errors(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    return rounded(agreement.event_boundary_error(agreement.detector_matches(a, b, [_U], "episode_type", 100000.0, 0.5000001), "episode_type"), 3)


_SCORED = "t AS (SELECT count(*) AS tp, avg(iou) AS mean_iou, avg(abs(b0 - a0)) AS mean_abs_onset_error, avg(abs(b1 - a1)) AS mean_abs_offset_error, (SELECT count(*) FROM p) AS truth_events, (SELECT count(*) FROM q) AS detected_events FROM m)"


@query(_TWO + f", {_SCORED} SELECT 'loose' AS detector, tp, truth_events, detected_events, detected_events - tp AS fp, truth_events - tp AS fn, round(tp / detected_events, 6) AS precision, round(tp / truth_events, 6) AS recall, round(2 * tp / (truth_events + detected_events), 6) AS f1, round(mean_iou, 6) AS mean_iou, round(mean_abs_onset_error, 3) AS mean_abs_onset_error, round(mean_abs_offset_error, 3) AS mean_abs_offset_error FROM t")
def detectors_compared(spark, sf_dir):
    a, b = _both(spark, sf_dir)
    found = agreement.compare_event_detectors(a, {"loose": b}, [_U], "episode_type", 100000.0, 0.5000001)
    return found.select("detector", "tp", "truth_events", "detected_events", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou")), *(F.round(c, 3).alias(c) for c in ("mean_abs_onset_error", "mean_abs_offset_error")))


def _multiverse(spark, sf_dir) -> DataFrame:
    specs = [events.DetectorSpec(k, "ivt", (("threshold", v), ("minimum", 60.0), ("max_gap", 20000.0))) for k, v in (("a_strict", 0.001), ("b_loose", 0.004))]
    return events.run_detector_multiverse(samples(spark, sf_dir), specs, "t", [_U], "x")


@query(_TWO + f", {_SCORED} SELECT 'a_strict' AS detector_a, 'b_loose' AS detector_b, tp AS matched_events, truth_events - tp AS unmatched_reference, detected_events - tp AS unmatched_candidate, detected_events - truth_events AS event_count_difference, round(2 * tp / (truth_events + detected_events), 6) AS f1 FROM t")
def detector_disagreement(spark, sf_dir):
    pairs = agreement.estimate_detector_agreement(_multiverse(spark, sf_dir), ["a_strict", "b_loose"], [_U], "episode_type", 100000.0, 0.5000001)
    return rounded(agreement.summarise_detector_disagreement(pairs).select("detector_a", "detector_b", "matched_events", "unmatched_reference", "unmatched_candidate", "event_count_difference", "f1"), 6)


_PROPAGATED = _TWO + ", e AS (SELECT 'a_strict' AS detector_id, user_id, (b - a) * 1000 AS ms FROM p UNION ALL SELECT 'b_loose', user_id, (b - a) * 1000 FROM q), f AS (SELECT detector_id, user_id, count(*) AS n, sum(ms) AS s, avg(ms) AS m FROM e GROUP BY ALL)"


@query(_PROPAGATED + " SELECT detector_id, user_id, n AS fixation_count, round(s, 2) AS total_duration_ms, round(m, 2) AS mean_duration_ms FROM f")
def detector_features(spark, sf_dir):
    return rounded(agreement.propagate_detector_to_features(_multiverse(spark, sf_dir), [_U]), 2)


@query(_PROPAGATED + ", l AS (SELECT user_id, 'fixation_count' AS feature_name, n::DOUBLE AS v FROM f UNION ALL SELECT user_id, 'mean_duration_ms', m FROM f) SELECT user_id, feature_name, count(v) AS n_detectors, round(max(v) - min(v), 2) AS range, round(stddev_samp(v), 2) AS sd, round(stddev_samp(v) / nullif(abs(avg(v)), 0), 6) AS cv FROM l GROUP BY ALL")
def detector_sensitivity(spark, sf_dir):
    made = agreement.propagate_detector_to_features(_multiverse(spark, sf_dir), [_U])
    found = agreement.detector_feature_sensitivity(made, [_U], ["fixation_count", "mean_duration_ms"])
    return found.select(_U, "feature_name", "n_detectors", F.round("range", 2).alias("range"), F.round("sd", 2).alias("sd"), F.round("cv", 6).alias("cv"))


@query("SELECT user_id, count(*) AS n, round(avg((event_id % 6 = 0)::INT), 7) AS interpolated_fraction, round(avg((value NOT BETWEEN 0.5 AND 90)::INT), 7) AS out_of_range_fraction, CASE WHEN avg((event_id % 6 = 0)::INT) > 0.2 OR avg((value NOT BETWEEN 0.5 AND 90)::INT) > 0 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY user_id")
def pupil_quality(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("filled", F.col("event_id") % 6 == 0)
    return rounded(audits.audit_pupil_quality(e, [_U], "value", "filled", plausible=(0.5, 90.0)), 7)


@query("WITH d AS (SELECT DISTINCT p_brand AS aoi_id, CASE WHEN p_brand LIKE '%1' THEN 'none' ELSE 'screen' END AS sp FROM part), g AS (SELECT p_brand AS aoi_id, count(*) AS n FROM part WHERE p_size > 25 AND p_brand != 'Brand#7' GROUP BY 1) SELECT d.aoi_id, coalesce(n, 0) AS n_geometry_records, sp = 'screen' AS coordinate_registered, CASE WHEN coalesce(n, 0) > 0 AND sp = 'screen' THEN 'ok' ELSE 'error' END AS status FROM d LEFT JOIN g ON d.aoi_id = g.aoi_id")
def aoi_audit(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("aoi_id", F.col("p_brand"))
    definitions = part.select("aoi_id", F.when(F.col("p_brand").endswith("1"), "none").otherwise("screen").alias("coordinate_space_id")).distinct()
    spaces = spark.createDataFrame([("screen",)], "coordinate_space_id string")
    return audits.audit_aois(definitions, part.filter("p_size > 25 and p_brand != 'Brand#7'"), spaces).select("aoi_id", "n_geometry_records", "coordinate_registered", "status")


@query("WITH f AS (SELECT l_orderkey, arg_min(l_quantity, l_linenumber * 1000 + l_quantity) AS r FROM lineitem GROUP BY 1) SELECT l.l_orderkey, l_linenumber, round(r, 4) AS response_timestamp, l_discount * 400 > r + 1 AS post_response, CASE WHEN l_discount * 400 > r + 1 THEN 'error' ELSE 'ok' END AS status FROM lineitem l JOIN f ON f.l_orderkey = l.l_orderkey")
def process_leakage(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    found = audits.check_process_leakage(l.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 400).alias("window_end")), l.select("l_orderkey", (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("at"), "l_quantity"), ["l_orderkey"], "window_end", "l_quantity", "at", 1.0)
    return rounded(found.select("l_orderkey", "l_linenumber", "response_timestamp", "post_response", "status"), 4)


@query("WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'trial' ELSE 'response' END AS level, CASE WHEN o_orderkey % 5 != 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS p FROM orders), m AS (SELECT *, CASE WHEN level = 'trial' THEN concat_ws(',', CASE WHEN c IS NULL THEN 'c' END, CASE WHEN trim(p) = '' THEN 'p' END) ELSE concat_ws(',', CASE WHEN trim(p) = '' THEN 'p' END) END AS k FROM f) SELECT o_orderkey, k AS missing_keys, CASE WHEN k != '' THEN 'warning' ELSE 'ok' END AS status FROM m")
def feature_levels(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 2 == 0, "trial").otherwise("response").alias("level"), F.when(key % 5 != 0, F.col("o_custkey")).alias("c"), F.when(key % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("p"))
    return audits.check_feature_level(rows, {"trial": ["c", "p"], "response": ["p"]}).select("o_orderkey", "missing_keys", "status")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def trial_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("interval_type", F.when(F.col("o_orderstatus") == "F", "trial").otherwise("pause"))
    return audits.trial_table(o).select("o_orderkey", "o_custkey")


@query("SELECT 'l_quantity' AS variable, true AS has_within_variation, true AS has_between_variation, 'within_and_between' AS level UNION ALL SELECT 'own', false, var_samp(l_suppkey) > 0, CASE WHEN var_samp(l_suppkey) > 0 THEN 'between_only' ELSE 'constant_or_unidentified' END FROM lineitem UNION ALL SELECT 'same', false, false, 'constant_or_unidentified'")
def mediation_levels(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumns({"own": F.col("l_suppkey").cast("double"), "same": F.lit(3.0)})  # noqa: E741
    return audits.identify_mediation_levels(l, ["l_quantity", "own", "same"], "l_suppkey", 1e-9)


@query("WITH f AS (SELECT CASE WHEN l_linenumber != 7 THEN l_quantity END AS x, CASE WHEN l_linenumber > 1 THEN greatest(0, l_discount - 0.05) END AS m, CASE WHEN l_tax > 0.01 THEN l_tax END AS y, 1 - l_tax * 5 AS q FROM lineitem), s AS (SELECT count(*) AS n, count(*) FILTER (x IS NULL) AS a, count(*) FILTER (m IS NULL) AS b, count(*) FILTER (m = 0) AS c, count(*) FILTER (m != 0) AS d, count(*) FILTER (q < 0.7) AS e, count(*) FILTER (y IS NULL) AS f FROM f) SELECT issue, k AS n, round(k / n, 7) AS proportion FROM (SELECT n, unnest(['x_missing', 'mediator_not_observed', 'mediator_observed_zero', 'mediator_observed_nonzero', 'poor_quality_trial', 'response_missing']) AS issue, unnest([a, b, c, d, e, f]) AS k FROM s)")
def mediation_missingness(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("x"), F.when(F.col("l_linenumber") > 1, F.greatest(F.lit(0.0), F.col("l_discount") - 0.05)).alias("m"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("y"), (1 - F.col("l_tax") * 5).alias("q"))
    return rounded(audits.audit_mediation_missingness(rows, "x", "m", "y", "q", 0.7), 7)


@query(_SUM_LATENCIES + ", s AS (SELECT count(*) AS n, count(*) FILTER (coalesce(f - a, 1000) <= 0) AS z FROM lat) SELECT issue, n AS n_rows, k AS n, k = 0 AS valid FROM (SELECT n, unnest(['missing_time', 'nonpositive_time', 'missing_indicator', 'event_without_time']) AS issue, unnest([0, z, 0, 0])::BIGINT AS k FROM s)")
def survival_validation(spark, sf_dir):
    return audits.validate_gaze_survival_data(_latencies(spark, sf_dir)).select("issue", "n_rows", "n", "valid")


_CONTROLS = "WITH r AS (SELECT l_returnflag AS control, l_discount - 0.05 AS effect FROM lineitem), s AS (SELECT control, count(*) AS n, count(effect) AS n_finite, avg(effect) AS mean, stddev_samp(effect) AS sd, median(effect) AS median, quantile_cont(effect, 0.025) AS q025, quantile_cont(effect, 0.975) AS q975, avg((abs(effect) > 0.035)::INT) AS exceedance_rate FROM r GROUP BY control)"


@query(_CONTROLS + " SELECT control, n, n_finite, round(mean, 8) AS mean, round(sd, 8) AS sd, round(median, 6) AS median, round(q025, 6) AS q025, round(q975, 6) AS q975, round(exceedance_rate, 7) AS exceedance_rate, abs(mean) <= 0.0001 AS within_tolerance FROM s")
def negative_controls(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("control"), (F.col("l_discount") - 0.05).alias("effect"))
    found = audits.negative_control_concordance(audits.summarise_negative_controls(r, threshold=0.035), 0.0001)
    return found.select("control", "n", "n_finite", *(F.round(c, 8).alias(c) for c in ("mean", "sd")), *(F.round(c, 6).alias(c) for c in ("median", "q025", "q975")), F.round("exceedance_rate", 7).alias("exceedance_rate"), "within_tolerance")


@query("SELECT l_returnflag AS feature_name, count(*) AS n, round(avg((l_quantity <= l_linenumber * 6)::INT), 7) AS available_fraction, count(*) FILTER (l_quantity > l_linenumber * 6) AS n_late FROM lineitem GROUP BY 1")
def features_available(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feature_name"), "l_quantity", (F.col("l_linenumber") * 6).alias("at"))  # noqa: E741
    return rounded(audits.feature_availability(l, "l_quantity", "at"), 7)


@query("WITH g AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS s FROM orders GROUP BY 1) SELECT g.k, round(g.s, 4) AS grouped, round(p.s, 4) AS pooled, round(p.s - g.s, 4) AS optimism FROM g JOIN p ON g.k = p.k")
def leakage_optimism(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderpriority"))
    mean = lambda d: d.groupBy("k").agg(F.avg("o_totalprice").alias("score"))
    return rounded(audits.quantify_process_leakage(mean(o.filter("o_orderstatus = 'F'")), mean(o), ["k"]), 4)


#: Change points where a recording's samples turn to errors, counted in rows.
_EPISODES = f"WITH {_S}, r AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, coalesce(event_type = 'error' AND lag(event_type) OVER w != 'error', false)::INT AS nw FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), e AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) + 1 AS episode_id FROM r)"


def _episodes(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    s = samples(spark, sf_dir)
    w = Window.partitionBy(_U).orderBy("t")
    marks = s.withColumns({"position": F.row_number().over(w), "_b": F.lag("event_type").over(w)}).filter("event_type = 'error' and _b != 'error'").select(_U, "position")
    return episodes.segment_process_episodes(s, "t", [_U], marks)


@query(_EPISODES + " SELECT user_id, episode_id::BIGINT AS episode_id, count(*) AS n_observations, min(i) AS start_index, max(i) AS end_index FROM e GROUP BY ALL")
def process_episodes(spark, sf_dir):
    return episodes.summarise_episodes(_episodes(spark, sf_dir), [_U]).withColumns({c: F.col(c).cast("long") for c in ("start_index", "end_index")})


@query(_EPISODES + ", k AS (SELECT user_id, episode_id, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, episode_id FROM e)) SELECT user_id, episode_id::BIGINT AS episode_id, ['orientation', 'initial_encoding', 'option_inspection', 'comparison', 'reconsideration', 'commitment'][CASE WHEN n > 2 AND episode_id = n THEN 6 WHEN n > 1 THEN round_even((episode_id - 1) * 5 / (n - 1), 0)::INT + 1 ELSE 1 END] AS episode_label FROM k")
def episode_labels(spark, sf_dir):
    return episodes.label_process_episodes(episodes.summarise_episodes(_episodes(spark, sf_dir), [_U]), [_U]).select(_U, "episode_id", "episode_label")


@query(_EPISODES + " SELECT event_type, episode_id::BIGINT AS episode_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 7) AS proportion FROM e GROUP BY event_type, episode_id")
def episode_structure(spark, sf_dir):
    return rounded(episodes.compare_episode_structure(_episodes(spark, sf_dir), "event_type"), 7)


@query(f"WITH {_S}, n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS i, x - avg(x) OVER g AS cx, stddev_pop(x) OVER g AS sx, y - avg(y) OVER g AS cy, stddev_pop(y) OVER g AS sy FROM s WHERE event_type IN ('click', 'view') WINDOW g AS (PARTITION BY user_id, event_type)), z AS (SELECT user_id, event_type, i, coalesce(cx / nullif(sx, 0), cx) AS a, coalesce(cy / nullif(sy, 0), cy) AS b FROM n) SELECT p.user_id, p.i, q.i AS j FROM z p JOIN z q ON p.user_id = q.user_id AND p.event_type = 'click' AND q.event_type = 'view' AND sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2) <= 0.35")
def cross_recurrence(spark, sf_dir):
    s = samples(spark, sf_dir)
    found = episodes.cross_recurrence(s.filter("event_type = 'click'"), s.filter("event_type = 'view'"), [_U], "t", ["x", "y"], 0.35)
    return found.select(_U, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query(f"WITH {_S}, o AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM s), pt AS (SELECT a.user_id, a.i, b.i AS j FROM o a JOIN o b ON a.user_id = b.user_id AND a.i < b.i AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3.0), n AS (SELECT user_id, count(*) AS n FROM o GROUP BY 1), w AS (SELECT user_id, n, unnest(range(0, greatest(0, n - 20) + 1, 10)) AS st FROM n), c AS (SELECT w.user_id, st, n, count(pt.i) AS k FROM w LEFT JOIN pt ON pt.user_id = w.user_id AND pt.i > st AND pt.j <= st + 20 GROUP BY ALL) SELECT user_id, st + 1 AS start, st + least(20, n) AS \"end\", k AS recurrent_pairs, round(k / nullif(least(20, n) * (least(20, n) - 1) / 2, 0), 7) AS recurrence_rate FROM c")
def windowed_recurrence(spark, sf_dir):
    s = samples(spark, sf_dir)
    found = episodes.windowed_recurrence(scanpaths.recurrence_points(s, [_U], "t", "x", "y", 3.0), s.groupBy(_U).agg(F.count("*").alias("n")), [_U], 20, 10)
    return rounded(found, 7)


@query(f"WITH {_S}, d AS (SELECT user_id, (x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0) AS v FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN sqrt(avg(v * v)) END, 7) AS pupil_velocity_activity FROM d GROUP BY user_id")
def pupil_velocity(spark, sf_dir):
    return rounded(episodes.pupil_velocity_activity(samples(spark, sf_dir), "t", [_U], "x"), 7)


_BAND = "round(CASE WHEN n >= 8 THEN sum(pw) FILTER (fr BETWEEN {lo} AND {hi} AND fr <= 0.5) END, 3)"


@query(f"WITH {_S}, o AS (SELECT user_id, x - avg(x) OVER g AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER g AS n FROM s WINDOW g AS (PARTITION BY user_id)), f AS (SELECT user_id, n, k, ((sum(v * cos(2 * pi() * k * i / n))) ** 2 + (sum(v * sin(2 * pi() * k * i / n))) ** 2) / n AS pw, k / n AS fr FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM o) GROUP BY user_id, n, k), b AS (SELECT user_id, n, {_BAND.format(lo=0.05, hi=0.2)} AS l, {_BAND.format(lo=0.2, hi=0.45)} AS h FROM f GROUP BY user_id, n) SELECT user_id, n, l AS pupil_low_frequency_power, h AS pupil_high_frequency_power FROM b")
def pupil_frequency(spark, sf_dir):
    found = episodes.pupil_frequency_features(samples(spark, sf_dir), "t", [_U], "x", 1.0, (0.05, 0.2), (0.2, 0.45))
    return rounded(found.select(_U, F.col("n").cast("long").alias("n"), "pupil_low_frequency_power", "pupil_high_frequency_power"), 3)


@query(_RESP + ", q AS (SELECT x.l_linenumber AS item_a, y.l_linenumber AS item_b, count(*) AS n, corr(x.response - x.p, y.response - y.p) AS q3 FROM p x JOIN p y ON x.person = y.person AND x.l_linenumber < y.l_linenumber GROUP BY ALL) SELECT item_a, item_b, n, round(q3, 6) AS q3, round(abs(q3), 6) AS abs_q3 FROM q WHERE abs(q3) >= 0.02")
def local_dependence(spark, sf_dir):
    return rounded(irt.local_dependence_pairs(irt.q3(_modelled(spark, sf_dir), "person", "l_linenumber"), 0.02), 6)


@query(_RESP + " SELECT item_id, count(*) AS n, round(avg(response - p), 6) AS mean_residual, round(sqrt(avg((response - p) ** 2 / greatest(p * (1 - p), 1e-8))), 5) AS rms_standardized_residual FROM p GROUP BY item_id")
def item_residuals(spark, sf_dir):
    found = irt.item_fit_residuals(_modelled(spark, sf_dir), "item_id")
    return found.select("item_id", "n", F.round("mean_residual", 6).alias("mean_residual"), F.round("rms_standardized_residual", 5).alias("rms_standardized_residual"))


_LINK = f"WITH {_ITEMS}, k AS (SELECT count(*) AS n, avg(a * 1.5) / avg(a) AS s, avg(b) - avg(a * 1.5) / avg(a) * avg(b + 0.5) AS c FROM i)"


def _link(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    i = _items(spark, sf_dir)
    focal = i.withColumns({"a": F.col("a") * 1.5, "b": F.col("b") + 0.5})
    return focal, irt.mean_mean_link(i, focal)


@query(_LINK + " SELECT n AS n_anchors, round(s, 8) AS \"A\", round(c, 8) AS \"B\" FROM k")
def mean_mean(spark, sf_dir):
    return rounded(_link(spark, sf_dir)[1], 8)


@query(_LINK + " SELECT item_id, round(a * 1.5 / s, 7) AS a, round(s * (b + 0.5) + c, 7) AS b FROM i, k")
def link_applied(spark, sf_dir):
    return rounded(irt.apply_link(*_link(spark, sf_dir)), 7)


@query(f"WITH {_ITEMS}, e AS (SELECT l_partkey AS item_id, max(abs(l_discount - 0.05)) AS e FROM lineitem GROUP BY 1), f AS (SELECT i.item_id, coalesce(e > 0.049, false) AS far, a * a / (1 + exp(a * b)) * (1 - 1 / (1 + exp(a * b))) AS f FROM i LEFT JOIN e ON e.item_id = i.item_id) SELECT item_id, NOT far AND f >= 0.1 AS eligible, CASE WHEN f < 0.1 THEN 'information below review threshold' WHEN far THEN 'DIF effect exceeds review threshold' ELSE 'eligible' END AS reason, round(f, 7) AS information_theta0 FROM f")
def anchors(spark, sf_dir):
    effects = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), (F.col("l_discount") - 0.05).alias("effect"))
    return rounded(irt.anchor_audit(_items(spark, sf_dir), effects, 0.049, 0.1), 7)


@query("WITH t AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, list_transform(range(2, len(q) + 1), lambda k: q[k] - q[k - 1]) AS g FROM t) SELECT l_orderkey, len(list_filter(g, lambda x: x <= 0)) = 0 AS ordered, list_min(g) AS minimum_gap, array_to_string(list_filter(range(1, len(g) + 1), lambda k: g[k] <= 0), ',') AS reversals FROM g")
def threshold_order(spark, sf_dir):
    q = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"])
    found = irt.threshold_order_audit(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(q.alias("thresholds")))
    return found.select("l_orderkey", "ordered", "minimum_gap", F.array_join(F.transform("reversals", lambda k: k.cast("string")), ",").alias("reversals"))


@query("WITH d AS (SELECT l_orderkey, l_discount - lag(l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount) AS d FROM lineitem) SELECT l_orderkey, count(*) FILTER (d < -1e-8) AS n_decreases, round(least(0, min(d)), 6) AS largest_decrease, count(*) FILTER (d < -1e-8) = 0 AS monotone FROM d GROUP BY 1")
def monotonicity(spark, sf_dir):
    return rounded(irt.monotonicity_audit(table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_quantity", "l_discount")), ["l_orderkey"], "at", "l_discount"), 6)


@query(f"WITH {_ITEMS}, e AS (SELECT 1 - 1 / (1 + exp(-a * 1.5)) AS g0, 1 / (1 + exp(-a * 1.5)) - 1 / (1 + exp(-a * 0.5)) AS g1, 1 / (1 + exp(-a * 0.5)) AS g2 FROM i) SELECT true AS valid_bounds, true AS rows_sum_to_one, round(min(least(g0, g1, g2)), 7) AS min_probability, round(max(greatest(g0, g1, g2)), 7) AS max_probability FROM e")
def category_audit(spark, sf_dir):
    p = irt.probability_grm(F.col("b") + 0.5, F.col("a"), F.array(F.col("b") - 1, F.col("b")))
    found = irt.category_function_audit(_items(spark, sf_dir).withColumn("probabilities", p), "probabilities")
    return rounded(found.select("valid_bounds", "rows_sum_to_one", "min_probability", "max_probability"), 7)


@query(f"WITH {_ITEMS}, g AS (SELECT unnest(range(0, 9)) - 4.0 AS theta), c AS (SELECT item_id, theta, 1 / (1 + exp(-a * (theta - b))) AS r, 1 / (1 + exp(-a * 1.2 * (theta - b - 0.2))) AS f FROM i, g) SELECT item_id, theta::DOUBLE AS theta, round(r, 7) AS reference, round(f, 7) AS focal, round(f - r, 7) AS signed_difference, round(abs(f - r), 7) AS absolute_difference FROM c")
def dif_curves(spark, sf_dir):
    i = _items(spark, sf_dir).withColumns({"fa": F.col("a") * 1.2, "fb": F.col("b") + 0.2})
    return rounded(irt.dif_effect_curve(i, irt.theta_grid(-4.0, 4.0, 9)), 7)


#: Items are line numbers, strata the orders' priorities, groups their status.
_CELLS_MH = "WITH c AS (SELECT l_linenumber AS item, o_orderpriority AS k, count(*) FILTER (o_orderstatus != 'F' AND l_quantity > 25) AS a, count(*) FILTER (o_orderstatus != 'F' AND l_quantity <= 25) AS b, count(*) FILTER (o_orderstatus = 'F' AND l_quantity > 25) AS c, count(*) FILTER (o_orderstatus = 'F' AND l_quantity <= 25) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), n AS (SELECT *, a + b + c + d AS n, a + c AS m1, b + d AS m0, a + b AS nr, c + d AS nf FROM c), s AS (SELECT item, count(*) AS n_strata, sum(n)::BIGINT AS n, sum(a * d / n) / sum(b * c / n) AS o, sum(a) AS sa, sum(nr * m1 / n) AS se, sum(nr * nf * m1 * m0 / (n * n * (n - 1))) AS sv FROM n WHERE nr > 0 AND nf > 0 GROUP BY item)"


@query(_CELLS_MH + " SELECT item, n_strata, n, round(o, 7) AS odds_ratio, round(-2.35 * ln(o), 7) AS delta, round(greatest(abs(sa - se) - 0.5, 0) ** 2 / sv, 6) AS chi_square FROM s")
def mantel_haenszel(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_linenumber").alias("item"), "o_orderpriority", "o_orderstatus", (F.col("l_quantity") > 25).cast("int").alias("response"))
    found = irt.mantel_haenszel_dif(rows, "item", "o_orderpriority", "o_orderstatus", "F")
    return found.select("item", "n_strata", "n", F.round("odds_ratio", 7).alias("odds_ratio"), F.round("delta", 7).alias("delta"), F.round("chi_square", 6).alias("chi_square"))


@query("WITH r AS (SELECT l_linenumber AS item, (l_quantity > 25)::INT AS x, sum((l_quantity > 25)::INT) OVER (PARTITION BY l_orderkey) - (l_quantity > 25)::INT AS rest FROM lineitem) SELECT item, count(*) AS n, round(avg(x), 7) AS p, round(corr(x, rest), 6) AS item_rest FROM r GROUP BY item")
def item_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("item"), (F.col("l_quantity") > 25).cast("int").alias("response"))
    found = irt.classical_item_statistics(rows, "l_orderkey", "item")
    return found.select("item", "n", F.round("p", 7).alias("p"), F.round("item_rest", 6).alias("item_rest"))


def _map_sql(rounds: int = 6) -> str:
    """Newton rounds for every person's ability with a standard normal prior: t has person and theta."""
    out = [_RESP, "t0 AS (SELECT person, 0.0::DOUBLE AS theta, count(*) AS n FROM p GROUP BY person)"]
    for k in range(rounds):
        out.append(f"m{k} AS (SELECT p.person, any_value(t{k}.theta) AS theta, any_value(t{k}.n) AS n, sum(a * (response - 1 / (1 + exp(-a * (t{k}.theta - b))))) AS g, sum(a * a / (1 + exp(-a * (t{k}.theta - b))) / (1 + exp(a * (t{k}.theta - b)))) AS h FROM p JOIN t{k} ON p.person = t{k}.person GROUP BY p.person)")
        out.append(f"t{k + 1} AS (SELECT person, n, theta + greatest(-1, least(1, (g - theta) / (h + 1))) AS theta FROM m{k})")
    return ", ".join(out) + f", t AS (SELECT * FROM t{rounds})"


@query(_map_sql() + " SELECT person, n::INTEGER AS n_items, round(theta, 5) AS theta FROM t")
def map_scores(spark, sf_dir):
    return rounded(irt.newton_abilities(_responses(spark, sf_dir), _items(spark, sf_dir), "person"))


@query(_map_sql() + " SELECT n::INTEGER AS n_items, count(*) AS persons, round(min(theta), 4) AS lowest, round(max(theta), 4) AS highest FROM t GROUP BY n")
def map_extremes(spark, sf_dir):
    found = irt.newton_abilities(_responses(spark, sf_dir), _items(spark, sf_dir), "person")
    return rounded(found.groupBy("n_items").agg(F.count("*").alias("persons"), F.min("theta").alias("lowest"), F.max("theta").alias("highest")), 4)


_FIVE = ", ".join(f"ln({k}) - (" + " + ".join(f"ln({x})" for x in _TYPES) + f") / 5 AS z{i}" for i, k in enumerate(_TYPES))


@query(_COMP + f", zz AS (SELECT user_id % 3 AS g, {_FIVE} FROM c), w AS (SELECT g, count(*) AS n, " + " + ".join(f"var_pop(z{i}) * count(*)" for i in range(5)) + " AS w FROM zz GROUP BY g), t AS (SELECT count(*) AS n, " + " + ".join(f"var_pop(z{i}) * count(*)" for i in range(5)) + " AS t FROM zz), b AS (SELECT t.n, (SELECT count(*) FROM w) AS n_groups, t - (SELECT sum(w) FROM w) AS between_, (SELECT sum(w) FROM w) AS within_ FROM t) SELECT n, n_groups, round(between_, 5) AS \"between\", round(within_, 4) AS within, round(between_ / (n_groups - 1) / (within_ / (n - n_groups)), 6) AS pseudo_f FROM b")
def composition_compared(spark, sf_dir):
    found = aoi.compare_aoi_compositions(_composition(spark, sf_dir).withColumn("g", F.col(_U) % 3), "g", _TYPES)
    return found.select("n", "n_groups", F.round("between", 5).alias("between"), F.round("within", 4).alias("within"), F.round("pseudo_f", 6).alias("pseudo_f"))


@query(_COMP + " SELECT user_id % 3 AS g, count(*) AS n, " + ", ".join(f"round(avg({k}), 8) AS {k}" for k in _TYPES) + " FROM c GROUP BY 1")
def composition_centroids(spark, sf_dir):
    return rounded(aoi.composition_centroids(_composition(spark, sf_dir).withColumn("g", F.col(_U) % 3), "g", _TYPES), 8)


@query("SELECT p_partkey, round(p_size * degrees(2 * atan(300.0 / 1920 / 1200)), 8) AS mx_degrees, round(p_retailprice * degrees(2 * atan(200.0 / 1080 / 1200)), 7) AS my_degrees FROM part")
def margins_in_degrees(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("mx"), F.col("p_retailprice").alias("my"))
    found = aoi.convert_aoi_margin(part, "mx", "my", (aoi.degrees_per_pixel(1920, 300.0, 600.0), aoi.degrees_per_pixel(1080, 200.0, 600.0)))
    return found.select("p_partkey", F.round("mx_degrees", 8).alias("mx_degrees"), F.round("my_degrees", 7).alias("my_degrees"))


@query(_MEMBERS + " SELECT p_brand, aoi_id, count(*) AS n, round(sum(p * p_retailprice), 4) AS expected_dwell, round(sqrt(sum(p * (1 - p) * p_retailprice * p_retailprice)), 5) AS sd_dwell, round(sum(p), 6) AS expected_count FROM pr JOIN part USING (p_partkey) GROUP BY p_brand, aoi_id")
def aoi_uncertainty(spark, sf_dir):
    found = aoi.propagate_aoi_uncertainty(_members(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_partkey"], ["p_brand"], "p_retailprice")
    return found.select("p_brand", "aoi_id", "n", F.round("expected_dwell", 4).alias("expected_dwell"), F.round("sd_dwell", 5).alias("sd_dwell"), F.round("expected_count", 6).alias("expected_count"))


@query(_SUM_LATENCIES + ", d AS (SELECT coalesce(f - a, 1000) AS t, f IS NOT NULL AS e FROM lat), c AS (SELECT t, count(*) AS n, count(*) FILTER (e) AS d FROM d GROUP BY t), r AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM c), k AS (SELECT t, exp(sum(ln(1 - d / n)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS s FROM r WHERE d > 0 AND d < n) SELECT round(min(t) FILTER (s <= 0.75 + 1e-12), 4) AS q25, round(min(t) FILTER (s <= 0.5 + 1e-12), 4) AS q50, round(min(t) FILTER (s <= 0.25 + 1e-12), 4) AS q75 FROM k")
def latency_quantiles(spark, sf_dir):
    return rounded(survival.estimate_gaze_latency_quantiles(survival.estimate_gaze_survival(_latencies(spark, sf_dir))), 4)


@query(f"WITH {_ITEMS}, {_GRID}, p AS (SELECT theta, a, 1 / (1 + exp(-a * (theta - b))) AS p FROM i, g), c AS (SELECT theta, sum(a * a * p * (1 - p)) AS f FROM p GROUP BY theta) SELECT count(*) AS n_points, round(avg((f >= 250)::INT), 6) AS fraction_target_met, round(min(f), 4) AS minimum_information, round(max(1 / sqrt(f)), 6) AS maximum_sem FROM c WHERE theta BETWEEN -2.00001 AND 2.00001")
def bank_coverage(spark, sf_dir):
    found = banks.bank_coverage(irt.test_information(_items(spark, sf_dir), irt.theta_grid()), 250.0, -2.00001, 2.00001)
    return found.select("n_points", F.round("fraction_target_met", 6).alias("fraction_target_met"), F.round("minimum_information", 4).alias("minimum_information"), F.round("maximum_sem", 6).alias("maximum_sem"))


@query("WITH d AS (SELECT DISTINCT l_orderkey AS person, l_linenumber AS item, l_linenumber <= 5 AS adm FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS person, l_linenumber AS item FROM lineitem WHERE l_quantity > 20) SELECT count(*) AS n_pairs, round(avg((s.person IS NOT NULL)::INT), 7) AS observed_fraction, count(*) FILTER (s.person IS NULL AND NOT adm) AS structural_missing, count(*) FILTER (s.person IS NULL AND adm) AS unexpected_missing FROM d LEFT JOIN s ON s.person = d.person AND s.item = d.item")
def missing_by_design(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_linenumber").alias("item"), F.when(F.col("l_quantity") > 20, 1).alias("response"))  # noqa: E741
    design = l.select("person", "item", (F.col("item") <= 5).alias("administered")).distinct()
    return rounded(banks.missing_by_design_audit(l, design, "person", "item"), 7)


_PROFILE = f"WITH {_ITEMS}, c AS (SELECT l_partkey AS item_id, count(*) AS n, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1)"


def _profile(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))  # noqa: E741
    return banks.channel_profile(l, "item_id", ["quantity", "discount"])


@query(_PROFILE + " SELECT item_id, n, round(quantity, 8) AS quantity, round(discount, 8) AS discount FROM c")
def item_profiles(spark, sf_dir):
    return rounded(_profile(spark, sf_dir), 8)


@query(_PROFILE + " SELECT 'quantity' AS channel, round(corr(quantity, a), 7) AS correlation_discrimination, round(corr(quantity, b), 7) AS correlation_difficulty FROM c JOIN i USING (item_id) UNION ALL SELECT 'discount', round(corr(discount, a), 7), round(corr(discount, b), 7) FROM c JOIN i USING (item_id)")
def process_alignment(spark, sf_dir):
    return rounded(banks.process_alignment(_items(spark, sf_dir), _profile(spark, sf_dir), ["quantity", "discount"]), 7)


#: Parts need their brand as a skill where they are dear, and their type where they are large.
_Q = "WITH q AS (SELECT p_partkey AS item_id, p_brand AS skill FROM part WHERE p_retailprice > 1000 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size > 30)"


def _q(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").withColumn("item_id", F.col("p_partkey"))
    return part, part.filter("p_retailprice > 1000").select("item_id", F.col("p_brand").alias("skill")).unionByName(part.filter("p_size > 30").select("item_id", F.col("p_type").alias("skill")))


@query(_Q + ", s AS (SELECT p_partkey AS item_id, coalesce(string_agg(skill, '|' ORDER BY skill), '') AS s, count(skill) AS n FROM part LEFT JOIN q ON item_id = p_partkey GROUP BY 1) SELECT item_id, n AS n_attributes, n = 0 AS no_attribute, count(*) OVER (PARTITION BY s) > 1 AS duplicate FROM s")
def qmatrix_items(spark, sf_dir):
    part, q = _q(spark, sf_dir)
    return banks.qmatrix_item_audit(q, part).withColumn("n_attributes", F.col("n_attributes").cast("long"))


@query(_Q + ", l AS (SELECT item_id, skill, count(*) OVER (PARTITION BY item_id) AS k FROM q) SELECT skill, count(*) AS n_items, bool_or(k = 1) AS pure, false AS unmeasured FROM l GROUP BY skill")
def qmatrix_attributes(spark, sf_dir):
    q = _q(spark, sf_dir)[1]
    return banks.qmatrix_attribute_audit(q, q)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN round(1 - l_tax, 6) ELSE round(l_discount, 6) END AS p FROM lineitem")
def dina_probability(spark, sf_dir):
    ideal = table(spark, sf_dir, "lineitem").withColumn("ideal", (F.col("l_quantity") > 25).cast("int"))
    return rounded(banks.dina_probability(ideal, F.col("l_tax"), F.col("l_discount")).select("l_orderkey", "l_linenumber", "p"), 6)


@query(_MEMBERS + ", cu AS (SELECT p_partkey, count(*) AS n, max(p) AS m, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM pr GROUP BY 1) SELECT p_partkey, n AS n_profiles, round(m, 7) AS max_probability, round(h, 7) AS entropy, round(h / ln(n), 7) AS normalized_entropy FROM cu")
def classification_uncertainty(spark, sf_dir):
    return rounded(banks.classification_uncertainty(_members(spark, sf_dir), "p_partkey"), 7)


@query("SELECT p_name AS testlet, count(*) AS n_items, count(*) = 1 AS singleton, count(*) >= 15 AS meets_minimum FROM part GROUP BY 1")
def testlets(spark, sf_dir):
    return banks.testlet_audit(table(spark, sf_dir, "part").withColumn("testlet", F.col("p_name")), "testlet", 15)


def _stability_sql(k: int, test: str) -> str:
    return f"SELECT {k} AS \"set\", count(*) AS n_anchors, round(stddev_samp(b) / stddev_samp(b * 1.25 + a), 7) AS \"A\", round(avg(b) - stddev_samp(b) / stddev_samp(b * 1.25 + a) * avg(b * 1.25 + a), 7) AS \"B\" FROM i WHERE {test}"


@query(f"WITH {_ITEMS} " + _stability_sql(1, "a < 1") + " UNION ALL " + _stability_sql(2, "a >= 1"))
def link_stability(spark, sf_dir):
    i = _items(spark, sf_dir)
    found = banks.link_stability(i, i.withColumn("b", F.col("b") * 1.25 + F.col("a")), [i.filter("a < 1"), i.filter("a >= 1")])
    return rounded(found, 7)
