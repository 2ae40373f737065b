"""Registered queries: operators bound to the relational tables, with DuckDB SQL for each that SQL can express.

``events`` are samples: user_id is the recording, ts the clock (seconds since 2024), value a gaze
coordinate and event_type the area of interest. ``lineitem`` gives planes of points and item by batch
tables, ``orders`` persons, sessions and latencies. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aoi, events, features, irt, quality, reliability, scanpaths, survival, timebase, trials, validation, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Samples as common table expressions of the SQL.
_S = "s AS (SELECT event_id, user_id, event_type, value AS x, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t, (event_id * 7919 % 1000) / 100.0 AS y FROM events)"
_U = "user_id"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, x, y and t."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("x"), (micros / 1_000_000.0 - 1704067200.0).alias("t"), (F.col("event_id") * 7919 % 1000 / 100.0).alias("y"))


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(F.col(c) + 0.0, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_S} SELECT user_id, event_id, round(abs(x - lag(x) OVER w), 5) AS distance, round(t - lag(t) OVER w, 5) AS dt, round(abs(x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0), 5) AS velocity FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def gaze_velocity(spark, sf_dir):
    return rounded(events.gaze_velocity(samples(spark, sf_dir), "t", [_U], "x").select(_U, "event_id", "distance", "dt", "velocity"))


@query(f"WITH {_S} SELECT event_id, round(median(x) OVER w, 5) AS x FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def filter_gaze_median(spark, sf_dir):
    return rounded(events.filter_gaze(samples(spark, sf_dir), "t", [_U], ["x"], "median", 5).select("event_id", "x"))


@query(f"WITH {_S} SELECT event_id, round(avg(x) OVER w, 5) AS x FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def filter_gaze_mean(spark, sf_dir):
    return rounded(events.filter_gaze(samples(spark, sf_dir), "t", [_U], ["x"], "mean", 7).select("event_id", "x"))


@query(f"WITH {_S}, m AS (SELECT *, median(x) OVER (PARTITION BY user_id) AS m FROM s), d AS (SELECT *, 1.4826 * median(abs(x - m)) OVER (PARTITION BY user_id) AS k FROM m) SELECT event_id, coalesce(abs(x - m) > 2 * nullif(k, 0), false) AS outlier FROM d")
def gaze_outliers_mad(spark, sf_dir):
    flagged = events.flag_gaze_outliers(samples(spark, sf_dir).withColumn("zero", F.lit(0.0)), "t", [_U], "x", "zero", "mad", 2.0)
    return flagged.select("event_id", "outlier")


_IVT = f"""WITH {_S}, v AS (SELECT *, coalesce(abs(x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0) <= 0.002, false) AS slow, lag(t) OVER w AS tb FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
l AS (SELECT *, CASE WHEN tb IS NULL THEN coalesce(lead(slow) OVER w, false) ELSE slow END AS lab FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, CASE WHEN tb IS NULL OR lab != lag(lab) OVER w OR t - tb > 20000 THEN 1 ELSE 0 END AS st FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM b)"""


@query(_IVT + " SELECT user_id, round(min(t), 5) AS start_time, round(max(t), 5) AS end_time, count(*) AS n_samples, round(avg(x), 5) AS centroid_x, round(max(x) - min(x), 5) AS dispersion, round((max(t) - min(t)) * 1000, 3) AS duration_ms FROM r WHERE lab GROUP BY user_id, run HAVING (max(t) - min(t)) * 1000 >= 60000")
def fixations_ivt(spark, sf_dir):
    found = events.detect_fixations_ivt(samples(spark, sf_dir), "t", [_U], "x", None, 0.002, 60.0, 20000.0)
    return rounded(found.select(_U, "start_time", "end_time", "n_samples", "centroid_x", "dispersion", F.round("duration_ms", 3).alias("duration_ms")))


@query(f"""WITH {_S}, v AS (SELECT *, coalesce(abs(x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0) > 0.005, false) AS lab, lag(t) OVER w AS tb FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, CASE WHEN tb IS NULL OR lab != lag(lab) OVER w THEN 1 ELSE 0 END AS st FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, round(min(t), 5) AS start_time, count(*) AS n_samples, round(abs(arg_max(x, t) - arg_min(x, t)), 5) AS amplitude FROM r WHERE lab GROUP BY user_id, run HAVING (max(t) - min(t)) * 1000 >= 10""")
def saccades(spark, sf_dir):
    return rounded(events.detect_saccades(samples(spark, sf_dir), "t", [_U], "x", None, 0.005).select(_U, "start_time", "n_samples", "amplitude"))


@query(f"""WITH {_S}, v AS (SELECT *, x > 40 AS lab, lag(t) OVER w AS tb, lag(x > 40) OVER w AS lb FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), r AS (SELECT *, sum(CASE WHEN tb IS NULL OR lab != lb THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM v)
SELECT user_id, round(min(t), 5) AS start_time, round(max(t), 5) AS end_time, count(*) AS n_samples FROM r WHERE lab GROUP BY user_id, run HAVING max(t) - min(t) BETWEEN 0.05 AND 100000""")
def blinks(spark, sf_dir):
    return rounded(events.detect_blinks(samples(spark, sf_dir), "t", [_U], F.col("x") > 40, 0.05, 100000.0).select(_U, "start_time", "end_time", "n_samples"))


@query(f"""WITH {_S}, g AS (SELECT *, CASE WHEN event_id % 5 != 0 THEN x END AS p FROM s), b AS (SELECT *, last_value(p IGNORE NULLS) OVER a AS p0, last_value(CASE WHEN p IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, first_value(p IGNORE NULLS) OVER z AS p1, first_value(CASE WHEN p IS NOT NULL THEN t END IGNORE NULLS) OVER z AS t1 FROM g WINDOW a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(p, CASE WHEN t1 - t0 <= 100000 THEN p0 + (p1 - p0) * (t - t0) / (t1 - t0) END), 4) AS p FROM b""")
def interpolate_pupil(spark, sf_dir):
    gaps = samples(spark, sf_dir).withColumn("p", F.when(F.col("event_id") % 5 != 0, F.col("x")))
    return rounded(events.interpolate_pupil(gaps, "t", [_U], "p", "linear", 100000.0).select("event_id", "p"), 4)


@query(f"WITH {_S}, b AS (SELECT *, t - min(t) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id)), m AS (SELECT *, avg(CASE WHEN d BETWEEN 0 AND 200000 THEN x END) OVER w AS m, count(CASE WHEN d BETWEEN 0 AND 200000 THEN x END) OVER w AS k FROM b WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round(CASE WHEN k >= 3 THEN x - m END, 5) AS p FROM m")
def baseline_pupil(spark, sf_dir):
    return rounded(events.baseline_pupil(samples(spark, sf_dir), "t", [_U], "x", (0.0, 200000.0), None, "subtract", 3, "p").select("event_id", "p"))


@query(None)
def fixations_idt(spark, sf_dir):
    return rounded(events.detect_fixations_idt(samples(spark, sf_dir), "t", [_U], "x", "y", 15.0, 60.0))


_VISITS = f"""WITH {_S}, v AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR event_type != lag(event_type) OVER w OR t - lag(t) OVER w > 40000 THEN 1 ELSE 0 END AS st FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM v), visits AS (SELECT user_id, event_type, min(t) AS start_time, max(t) AS end_time, count(*) AS n_samples, arg_min(x, t) AS start_x, arg_max(x, t) AS end_x, avg(x) AS centroid_x FROM r GROUP BY user_id, event_type, run)"""


def _visits(spark, sf_dir) -> DataFrame:
    return aoi.build_aoi_visits(samples(spark, sf_dir), "t", [_U], "event_type", 40000.0)


@query(_VISITS + " SELECT user_id, event_type, round(start_time, 5) AS start_time, round(end_time, 5) AS end_time, n_samples, round(start_x, 5) AS start_x, round(end_x, 5) AS end_x, round(centroid_x, 5) AS centroid_x FROM visits")
def aoi_visits(spark, sf_dir):
    found = aoi.build_aoi_visits(samples(spark, sf_dir), "t", [_U], "event_type", 40000.0, x="x")
    return rounded(found.select(_U, "event_type", "start_time", "end_time", "n_samples", "start_x", "end_x", "centroid_x"))


_COLLAPSED = f"WITH {_S}, c AS (SELECT *, lag(event_type) OVER w AS pe FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), k AS (SELECT * FROM c WHERE pe IS NULL OR pe != event_type)"


@query(_COLLAPSED + " SELECT user_id, string_agg(event_type, ' > ' ORDER BY t) AS scanpath, count(*) AS n_steps FROM k GROUP BY user_id")
def scanpath_sequence(spark, sf_dir):
    return features.scanpath_sequence(samples(spark, sf_dir), "t", [_U], "event_type")


_TRANSITIONS = f"WITH {_S}, n AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY t) AS b FROM s), tr AS (SELECT * FROM n WHERE b IS NOT NULL AND a != b)"


@query(_TRANSITIONS + ", c AS (SELECT a, b, count(*) AS n FROM tr GROUP BY a, b) SELECT a AS from_aoi, b AS to_aoi, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM c")
def transition_matrix(spark, sf_dir):
    return rounded(features.transition_matrix(samples(spark, sf_dir), "t", [_U], "event_type", "row"), 6)


@query(f"WITH {_S}, c AS (SELECT user_id, event_type, count(*) AS k FROM s GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, sum(k)::BIGINT AS n, count(*) AS n_aois, round(-sum(p * log2(p)), 5) AS gaze_entropy FROM p GROUP BY user_id")
def gaze_entropy(spark, sf_dir):
    return rounded(features.gaze_entropy(samples(spark, sf_dir), [_U], "event_type"))


@query(_TRANSITIONS + ", c AS (SELECT user_id, a, b, count(*) AS k FROM tr GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY user_id, a) AS p, k / sum(k) OVER (PARTITION BY user_id) AS w FROM c) SELECT user_id, sum(k)::BIGINT AS n_transitions, round(-sum(w * log2(p)) + 0.0, 5) AS transition_entropy FROM p GROUP BY user_id")
def transition_entropy(spark, sf_dir):
    return rounded(features.transition_entropy(samples(spark, sf_dir), "t", [_U], "event_type"))


@query(_TRANSITIONS + ", c AS (SELECT a, b, count(*) AS n FROM tr GROUP BY a, b), st AS (SELECT DISTINCT event_type AS e FROM s), g AS (SELECT x.e AS a, y.e AS b FROM st x, st y WHERE x.e != y.e), f AS (SELECT g.a, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b) SELECT a AS from_aoi, b AS to_aoi, n, round((n + 0.5) / sum(n + 0.5) OVER (PARTITION BY a), 6) AS probability FROM f")
def dynamic_aoi_model(spark, sf_dir):
    return rounded(features.dynamic_aoi_model(samples(spark, sf_dir), "t", [_U], "event_type"), 6)


@query(_VISITS + " SELECT user_id, count(*) AS fixation_count, round(sum((end_time - start_time) * 1000), 2) AS total_duration_ms, round(avg((end_time - start_time) * 1000), 2) AS mean_duration_ms, round(median((end_time - start_time) * 1000), 2) AS median_duration_ms, round(min(start_time), 5) AS first_time, round(max(end_time), 5) AS last_time FROM visits GROUP BY user_id")
def summarize_fixations(spark, sf_dir):
    found = features.summarize_fixations(_visits(spark, sf_dir), [_U])
    ms = ("total_duration_ms", "mean_duration_ms", "median_duration_ms")
    return rounded(found.withColumns({c: F.round(c, 2) for c in ms}))


@query(_VISITS + """, o AS (SELECT *, (end_time - start_time) * 1000 AS ms, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS nw, start_time - min(start_time) OVER (PARTITION BY user_id) AS lat FROM visits WINDOW w AS (PARTITION BY user_id ORDER BY start_time)), f AS (SELECT user_id, event_type, count(*)::DOUBLE AS c, sum(ms) AS d, min(lat) * 1000 AS l, (sum(nw) - 1)::DOUBLE AS r, avg(ms) AS m, stddev_samp(ms) AS sd FROM o GROUP BY ALL)
SELECT user_id, event_type, 'fixation_count' AS feature_name, round(c, 2) AS value FROM f UNION ALL SELECT user_id, event_type, 'dwell_time_ms', round(d, 2) FROM f UNION ALL SELECT user_id, event_type, 'first_latency_ms', round(l, 2) FROM f UNION ALL SELECT user_id, event_type, 'revisit_count', round(r, 2) FROM f UNION ALL SELECT user_id, event_type, 'dwell_share', round(d / nullif(sum(d) OVER (PARTITION BY user_id), 0), 2) FROM f UNION ALL SELECT user_id, event_type, 'mean_fixation_ms', round(m, 2) FROM f UNION ALL SELECT user_id, event_type, 'sd_fixation_ms', round(sd, 2) FROM f""")
def gaze_features(spark, sf_dir):
    return rounded(features.derive_gaze_features(_visits(spark, sf_dir), [_U], "event_type"), 2)


@query(f"WITH {_S}, p AS (SELECT *, (x + lag(x) OVER w) / 2 * (t - lag(t) OVER w) AS part FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS sd, round(max(x), 5) AS peak, round(coalesce(sum(part), 0), 1) AS auc, round(CASE WHEN count(*) > 1 THEN regr_slope(x, t) END * 1000000, 3) AS slope FROM p GROUP BY user_id")
def pupil_features(spark, sf_dir):
    wide = features.series_features(samples(spark, sf_dir), "t", [_U], "x")
    return wide.select(_U, "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("peak", 5).alias("peak"), F.round("auc", 1).alias("auc"), F.round(F.col("slope") * 1000000, 3).alias("slope"))


_PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query("SELECT o_custkey, " + ", ".join(f"round(avg(CASE WHEN o_orderpriority = '{k}' THEN o_totalprice END), 4) AS {v}" for k, v in _PRIORITIES.items()) + " FROM orders GROUP BY o_custkey")
def features_wide(spark, sf_dir):
    long = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("feature_name"), F.col("o_totalprice").alias("value"))
    return rounded(features.features_wide(long, ["o_custkey"], list(_PRIORITIES)).withColumnsRenamed(_PRIORITIES), 4)


@query(f"WITH {_S}, g AS (SELECT user_id, list(event_type ORDER BY t) AS l FROM s GROUP BY user_id), n AS (SELECT user_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || '>' || l[i + 1])) AS ngram FROM g) SELECT user_id, ngram, count(*) AS n FROM n GROUP BY ALL")
def process_ngrams(spark, sf_dir):
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: s["event_type"])
    return features.process_ngram_features(samples(spark, sf_dir).groupBy(_U).agg(tokens.alias("tokens")), [_U], "tokens", [2])


@query(f"WITH {_S} SELECT user_id, event_type AS from_state, lead(event_type) OVER w AS to_state, row_number() OVER w AS step, round(lead(t) OVER w - t, 5) AS time_gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t) QUALIFY lead(event_type) OVER w IS NOT NULL")
def irtree_transitions(spark, sf_dir):
    return rounded(features.irtree_transitions(samples(spark, sf_dir), "t", [_U], "event_type").withColumn("step", F.col("step").cast("long")))


@query(f"WITH {_S}, b AS (SELECT user_id, floor(t / 86400)::BIGINT AS bin, event_type AS aoi, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, bin, aoi, n, round(n / sum(n) OVER (PARTITION BY user_id, bin), 6) AS share FROM b")
def aoi_trajectory(spark, sf_dir):
    return rounded(features.aoi_trajectory(samples(spark, sf_dir), "t", [_U], "event_type", 86400.0), 6)


_TRIALS = f"""WITH {_S}, st AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx, row_number() OVER (PARTITION BY user_id ORDER BY t) AS trial_index FROM s WHERE event_type = 'signup'), e AS (SELECT user_id, t FROM s WHERE event_type = 'purchase'),
m AS (SELECT st.user_id, trial_index, st.t AS start_time, st.nx, min(e.t) AS en FROM st JOIN e ON e.user_id = st.user_id AND e.t >= st.t GROUP BY ALL), trials AS (SELECT user_id, trial_index, start_time, en AS end_time FROM m WHERE en <= coalesce(nx, en))"""


def _trials(spark, sf_dir) -> DataFrame:
    return trials.build_trials(samples(spark, sf_dir), "t", [_U], "event_type", ["signup"], ["purchase"])


@query(_TRIALS + " SELECT user_id, trial_index, round(start_time, 5) AS start_time, round(end_time, 5) AS end_time FROM trials")
def build_trials(spark, sf_dir):
    return rounded(_trials(spark, sf_dir).withColumn("trial_index", F.col("trial_index").cast("long")))


@query(_TRIALS + " SELECT event_id, min(trial_index) AS trial_index FROM s LEFT JOIN trials ON trials.user_id = s.user_id AND t BETWEEN start_time AND end_time GROUP BY event_id")
def assign_trials(spark, sf_dir):
    spans = _trials(spark, sf_dir).withColumns({"trial_index": F.col("trial_index").cast("long"), "at": F.col("trial_index")})
    return trials.assign_trials(samples(spark, sf_dir), spans, "t", [_U], "event_id", "trial_index", "at", 43200.0).select("event_id", "trial_index")


@query(f"WITH {_S}, r AS (SELECT *, sum(CASE WHEN pe IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t) AS pe FROM s)) SELECT user_id, event_type, round(min(t), 5) AS start_time, round(max(t), 5) AS end_time, count(*) AS n_samples FROM r GROUP BY user_id, event_type, run")
def stimulus_intervals(spark, sf_dir):
    return rounded(trials.build_stimulus_intervals(samples(spark, sf_dir), "t", [_U], "event_type"))


_RECTS = [("a", 1, 0.0, 900.0, 20.0, 200.0), ("b", 2, 10.0, 1000.0, 30.0, 300.0), ("c", 3, 30.0, 1200.0, 15.0, 400.0)]
_RECT_SQL = "r(aoi_id, o, x0, y0, w, h) AS (VALUES ('a', 1, 0.0, 900.0, 20.0, 200.0), ('b', 2, 10.0, 1000.0, 30.0, 300.0), ('c', 3, 30.0, 1200.0, 15.0, 400.0))"


def _rectangles(spark) -> DataFrame:
    return spark.createDataFrame(_RECTS, "aoi_id string, aoi_order int, x0 double, y0 double, width double, height double").withColumn("shape_type", F.lit("rectangle"))


@query(f"WITH {_RECT_SQL} SELECT p_partkey, (SELECT arg_min(aoi_id, o) FROM r WHERE p_size BETWEEN x0 AND x0 + w AND p_retailprice BETWEEN y0 AND y0 + h) AS aoi_id FROM part")
def aoi_assign_first(spark, sf_dir):
    return aoi.assign_aois(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), _rectangles(spark), "p_size", "p_retailprice", ["p_partkey"]).select("p_partkey", "aoi_id")


@query(f"WITH {_RECT_SQL} SELECT p_partkey, (SELECT string_agg(aoi_id, '|' ORDER BY o) FROM r WHERE p_size BETWEEN x0 AND x0 + w AND p_retailprice BETWEEN y0 AND y0 + h) AS aoi_id FROM part")
def aoi_assign_all(spark, sf_dir):
    return aoi.assign_aois(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), _rectangles(spark), "p_size", "p_retailprice", ["p_partkey"], None, "all").select("p_partkey", "aoi_id")


@query(f"WITH {_RECT_SQL}, m AS (SELECT p_partkey, aoi_id, least(p_size - x0, x0 + w - p_size, p_retailprice - y0, y0 + h - p_retailprice) AS i, greatest(x0 - p_size, p_size - x0 - w, 0) AS dx, greatest(y0 - p_retailprice, p_retailprice - y0 - h, 0) AS dy FROM part, r), z AS (SELECT p_partkey, aoi_id, CASE WHEN i >= 0 THEN i ELSE -sqrt(dx * dx + dy * dy) END / 50.0 AS z FROM m UNION ALL SELECT p_partkey, '__outside__', 0.0 FROM part), e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY p_partkey)) AS e FROM z) SELECT p_partkey, aoi_id, round(e / sum(e) OVER (PARTITION BY p_partkey), 6) AS probability FROM e")
def aoi_assign_probabilistic(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(aoi.assign_aois_probabilistic(points, _rectangles(spark), "p_size", "p_retailprice", ["p_partkey"], 50.0).drop("ambiguity"), 6)


@query(f"WITH {_RECT_SQL}, a AS (SELECT p_partkey, (SELECT arg_min(aoi_id, o) FROM r WHERE p_size BETWEEN x0 AND x0 + w AND p_retailprice BETWEEN y0 AND y0 + h) AS x, (SELECT arg_min(aoi_id, o) FROM r WHERE p_size BETWEEN x0 + 2 - w * 0.05 AND x0 + 2 + w * 1.05 AND p_retailprice BETWEEN y0 - h * 0.05 AND y0 + h * 1.05) AS y FROM part) SELECT CASE WHEN x IS NOT DISTINCT FROM y THEN 'unchanged' WHEN x IS NULL THEN 'newly_assigned' WHEN y IS NULL THEN 'lost' ELSE 'reassigned' END AS change, count(*) AS n FROM a GROUP BY 1")
def aoi_perturbation_changes(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    moved = aoi.perturb_aois(_rectangles(spark), spark.createDataFrame([("p", 2.0, 0.0, 1.1)], "perturbation_id string, dx double, dy double, scale double"))
    both = [aoi.assign_aois(points, r, "p_size", "p_retailprice", ["p_partkey"]) for r in (_rectangles(spark), moved)]
    return aoi.compare_aoi_assignments(both[0], both[1], ["p_partkey"]).groupBy("change").agg(F.count("*").alias("n"))


_TYPES = ["click", "view", "error", "signup", "purchase"]
_SUM = " + ".join(_TYPES)
_LNS = "(" + " + ".join(f"ln({k})" for k in _TYPES) + ") / 5"
_COMP = f"WITH {_S}, d AS (SELECT user_id, " + ", ".join(f"coalesce(sum(CASE WHEN event_type = '{k}' THEN x END), 0) AS {k}" for k in _TYPES) + f" FROM s GROUP BY user_id), z AS (SELECT *, {_SUM} AS tot, " + " + ".join(f"({k} = 0)::INT" for k in _TYPES) + " AS k FROM d), c AS (SELECT user_id, " + ", ".join(f"CASE WHEN {k} = 0 THEN 1e-6 ELSE {k} / nullif(tot, 0) * (1 - k * 1e-6) END AS {k}" for k in _TYPES) + " FROM z)"


def _composition(spark, sf_dir) -> DataFrame:
    return aoi.derive_aoi_composition(samples(spark, sf_dir), [_U], _TYPES, "event_type", "x")


@query(_COMP + " SELECT user_id, " + ", ".join(f"round(ln({k}) - {_LNS}, 5) AS clr_{i}" for i, k in enumerate(_TYPES, 1)) + " FROM c")
def aoi_composition_clr(spark, sf_dir):
    return rounded(aoi.transform_aoi_composition(_composition(spark, sf_dir), _TYPES, "clr").drop(*_TYPES))


@query(_COMP + " SELECT user_id, " + ", ".join(f"round(sqrt({k}.0 / {k + 1}) * ((" + " + ".join(f"ln({x})" for x in _TYPES[:k]) + f") / {k} - ln({_TYPES[k]})), 5) AS ilr_{k}" for k in range(1, 5)) + " FROM c")
def aoi_composition_ilr(spark, sf_dir):
    return rounded(aoi.transform_aoi_composition(_composition(spark, sf_dir), _TYPES, "ilr").drop(*_TYPES))


@query(_COMP + " SELECT user_id, round(ln(click) - ln(purchase), 5) AS alr_1, round(ln(view) - ln(purchase), 5) AS alr_2, round(ln(error) - ln(purchase), 5) AS alr_3, round(ln(signup) - ln(purchase), 5) AS alr_4 FROM c")
def aoi_composition_alr(spark, sf_dir):
    return rounded(aoi.transform_aoi_composition(_composition(spark, sf_dir), _TYPES, "alr").drop(*_TYPES))


@query(_COMP + " SELECT user_id, round(sqrt(6.0 / 5) * ((ln(click) + ln(view)) / 2 - (ln(error) + ln(signup) + ln(purchase)) / 3), 5) AS active FROM c")
def aoi_balances(spark, sf_dir):
    return rounded(aoi.aoi_balance_coordinates(_composition(spark, sf_dir), {"active": (["click", "view"], ["error", "signup", "purchase"])}).drop(*_TYPES))


@query(f"WITH {_S}, d AS (SELECT user_id, t - lag(t) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, count(*) AS n, round(median(d), 5) AS interval_median, round(avg(d), 5) AS interval_mean, round(min(d), 5) AS interval_min, round(max(d), 5) AS interval_max FROM d GROUP BY user_id")
def sampling_interval(spark, sf_dir):
    return rounded(quality.estimate_sampling_interval(samples(spark, sf_dir), "t", [_U]).drop("n_duplicate", "n_nonmonotonic"))


@query(f"WITH {_S}, d AS (SELECT user_id, t - lag(t) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)), m AS (SELECT *, abs(d - median(d) OVER (PARTITION BY user_id)) AS m FROM d WHERE d > 0) SELECT user_id, count(*) AS n_intervals, round(stddev_samp(d), 4) AS jitter_sd, round(median(m), 4) AS jitter_mad FROM m GROUP BY user_id")
def sampling_jitter(spark, sf_dir):
    return rounded(quality.estimate_sampling_jitter(samples(spark, sf_dir), "t", [_U]), 4)


@query(f"WITH {_S}, d AS (SELECT user_id, t - lag(t) OVER w AS d FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, round(1 / median(d), 8) AS sampling_hz, round(stddev_samp(d) / avg(d), 5) AS interval_cv FROM d WHERE d > 0 GROUP BY user_id")
def sampling_frequency(spark, sf_dir):
    found = quality.effective_sampling_frequency(samples(spark, sf_dir), "t", [_U])
    return found.select(_U, F.round("sampling_hz", 8).alias("sampling_hz"), F.round("interval_cv", 5).alias("interval_cv"))


_D = f"WITH {_S}, d AS (SELECT DISTINCT user_id, t FROM s), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM d), b AS (SELECT user_id, d, count(*) OVER w AS n, quantile_cont(d, 0.05) OVER w AS lo, quantile_cont(d, 0.95) OVER w AS hi FROM g WHERE d > 0 WINDOW w AS (PARTITION BY user_id))"


@query(_D + " SELECT user_id, round(1 / median(d), 8) AS sampling_rate_hz FROM b WHERE n <= 10 OR d BETWEEN lo AND hi GROUP BY user_id")
def sampling_rate(spark, sf_dir):
    return rounded(timebase.estimate_sampling_rate(samples(spark, sf_dir), "t", [_U]), 8)


@query(f"WITH {_S} SELECT event_id, round(t - min(t) OVER (PARTITION BY user_id), 5) AS seconds FROM s")
def normalize_timebase(spark, sf_dir):
    return rounded(timebase.normalize_timebase(samples(spark, sf_dir), "t", [_U], "s", out="seconds").select("event_id", "seconds"))


@query("SELECT l_returnflag, count(*) AS n_markers, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS \"offset\" FROM lineitem GROUP BY l_returnflag")
def clock_transform(spark, sf_dir):
    fit = timebase.clock_fits(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.select("l_returnflag", "n_markers", F.round("slope", 5).alias("slope"), F.round("offset", 3).alias("offset"))


@query(f"WITH {_S}, a AS (SELECT user_id, min(t) AS a0, max(t) AS a1 FROM s WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id, min(t) AS b0, max(t) AS b1 FROM s WHERE event_type = 'view' GROUP BY user_id) SELECT user_id, CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN round(greatest(0, least(a1, b1) - greatest(a0, b0)), 4) END AS overlap_seconds, CASE WHEN a0 IS NOT NULL AND b0 IS NOT NULL THEN round(greatest(0, least(a1, b1) - greatest(a0, b0)) / nullif(greatest(a1, b1) - least(a0, b0), 0), 6) END AS overlap_fraction FROM a FULL JOIN b USING (user_id)")
def clock_sync(spark, sf_dir):
    s = samples(spark, sf_dir)
    both = timebase.audit_clock_sync(s.filter("event_type = 'click'"), s.filter("event_type = 'view'"), "t", [_U])
    return both.select(_U, F.round("overlap_seconds", 4).alias("overlap_seconds"), F.round("overlap_fraction", 6).alias("overlap_fraction"))


_PLANE_SQL = _P = "WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 500 AS tx, l_tax * 500 AS ty, l_orderkey * 10 + l_linenumber AS o FROM lineitem)"


def _plane(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 500).alias("tx"), (F.col("l_tax") * 500).alias("ty"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))


@query(_P + " SELECT k, count(*) AS n, round(avg(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS accuracy_mean, round(median(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS accuracy_median, round(avg(abs(x-tx)), 5) AS mean_abs_dx, round(avg(abs(y-ty)), 5) AS mean_abs_dy, round(avg(x-tx), 5) AS bias_x, round(avg(y-ty), 5) AS bias_y, count(DISTINCT (tx, ty)) AS n_targets FROM p GROUP BY k")
def gaze_accuracy(spark, sf_dir):
    return rounded(quality.compute_gaze_accuracy(_plane(spark, sf_dir), "x", "y", "tx", "ty", ["k"]))


@query(_P + " SELECT k, count(*) AS n, round(stddev_pop(x), 5) AS sd_x, round(stddev_pop(y), 5) AS sd_y, round(sqrt(var_pop(x) + var_pop(y)), 5) AS precision_sd FROM p GROUP BY k")
def gaze_sd_precision(spark, sf_dir):
    return rounded(quality.compute_gaze_sd_precision(_plane(spark, sf_dir), "x", "y", ["k"]))


@query(_P + ", a AS (SELECT k, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy, covar_pop(x, y) AS c FROM p GROUP BY k) SELECT k, n, round(c / (sx * sy), 5) AS rho, round(2 * pi() * -ln(0.32) * sx * sy * sqrt(1 - (c / (sx * sy)) * (c / (sx * sy))), 3) AS bcea FROM a")
def gaze_bcea(spark, sf_dir):
    found = quality.compute_bcea(_plane(spark, sf_dir), "x", "y", ["k"])
    return found.select("k", "n", F.round("rho", 5).alias("rho"), F.round("bcea", 3).alias("bcea"))


@query(_P + ", u AS (SELECT k, o, avg(x) AS x, avg(y) AS y FROM p GROUP BY k, o), d AS (SELECT k, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM u WINDOW w AS (PARTITION BY k ORDER BY o)) SELECT k, count(d) AS n_steps, round(sqrt(avg(d * d)), 5) AS precision_rms_s2s, round(median(d), 5) AS step_median, round(quantile_cont(d, 0.95), 5) AS step_p95 FROM d GROUP BY k")
def gaze_rms_s2s(spark, sf_dir):
    once = _plane(spark, sf_dir).groupBy("k", "o").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(quality.compute_rms_s2s(once, "x", "y", "o", ["k"]))


@query(_P + " SELECT k, count(*) AS n, round(avg(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS mean_error, round(sqrt(avg((x-tx)*(x-tx)+(y-ty)*(y-ty))), 5) AS rms_error, round(quantile_cont(sqrt((x-tx)*(x-tx)+(y-ty)*(y-ty)), 0.95), 5) AS p95_error FROM p GROUP BY k")
def calibration_error(spark, sf_dir):
    return rounded(quality.estimate_calibration_error(_plane(spark, sf_dir), "x", "y", "tx", "ty", ["k"]).select("k", "n", "mean_error", "rms_error", "p95_error"))


@query(_P + " SELECT k, round(avg(x-tx), 5) AS mean_x, round(avg(y-ty), 5) AS mean_y, round(var_samp(x-tx), 4) AS var_x, round(var_samp(y-ty), 4) AS var_y, round(covar_samp(x-tx, y-ty), 4) AS cov_xy FROM p GROUP BY k")
def calibration_model(spark, sf_dir):
    found = quality.calibration_error_model(_plane(spark, sf_dir), "x", "y", "tx", "ty", ["k"])
    return found.select("k", *(F.round(c, 5).alias(c) for c in ("mean_x", "mean_y")), *(F.round(c, 4).alias(c) for c in ("var_x", "var_y", "cov_xy")))


@query(f"""WITH {_S}, l AS (SELECT *, event_id % 7 = 0 OR event_id % 11 < 3 AS lost FROM s), r AS (SELECT *, sum(CASE WHEN pl IS DISTINCT FROM lost THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(lost) OVER (PARTITION BY user_id ORDER BY t) AS pl FROM l)), k AS (SELECT user_id, run, lost, count(*) AS k, max(t) - min(t) AS d FROM r GROUP BY ALL)
SELECT user_id, sum(k)::BIGINT AS n, round(coalesce(sum(k) FILTER (lost), 0) / sum(k), 6) AS loss_fraction, count(*) FILTER (lost) AS n_loss_runs, coalesce(max(k) FILTER (lost), 0) AS longest_loss_samples, round(coalesce(max(d) FILTER (lost), 0), 6) AS longest_loss_time FROM k GROUP BY user_id""")
def gaze_data_loss(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("ok", ~((F.col("event_id") % 7 == 0) | (F.col("event_id") % 11 < 3)))
    return rounded(quality.compute_gaze_data_loss(s, "x", "y", "t", [_U], "ok"), 6)


@query(f"""WITH {_S}, g AS (SELECT *, floor((t - min(t) OVER u) / 604800)::BIGINT + 1 AS win, stddev_samp(sqrt(x * x + y * y)) OVER u AS sd FROM s WINDOW u AS (PARTITION BY user_id)), b AS (SELECT user_id, win, count(*) AS n, avg(x) AS ex, avg(y) AS ey, avg(sqrt(x * x + y * y)) AS ed, max(sd) AS sd FROM g GROUP BY ALL), f AS (SELECT *, sqrt((ex - first_value(ex) OVER w) ** 2 + (ey - first_value(ey) OVER w) ** 2) AS drift FROM b WINDOW w AS (PARTITION BY user_id ORDER BY win)), l AS (SELECT *, greatest(quantile_cont(drift, 0.95) OVER (PARTITION BY user_id), 2 * coalesce(sd, 0)) AS lim FROM f)
SELECT user_id, win AS "window", n, round(ed, 5) AS error_distance, round(drift, 5) AS drift, round(lim, 5) AS "limit", drift > lim AS flagged FROM l""")
def calibration_drift(spark, sf_dir):
    return rounded(quality.detect_calibration_drift(samples(spark, sf_dir), "x", "y", "t", 604800.0, [_U]).drop("error_x", "error_y"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN event_id % 4 = 0 THEN NULL WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction FROM events GROUP BY event_type")
def signal_quality(spark, sf_dir):
    flag = F.when(F.col("event_id") % 4 != 0, F.col("value") > 10)
    return rounded(quality.audit_signal_quality(table(spark, sf_dir, "events"), flag, ["event_type"]).drop("status"), 6)


@query("""WITH o AS (SELECT o_custkey, epoch(o_orderdate) / 86400 AS t, o_orderstatus, o_orderkey FROM orders), tr AS (SELECT o_custkey, min(t) AS a, min(t) + 1000 AS b FROM o GROUP BY 1), e AS (SELECT o.o_custkey, t FROM o JOIN tr USING (o_custkey) WHERE o_orderstatus = 'F' AND t BETWEEN a AND b), f AS (SELECT o_custkey, min(t) AS f FROM e GROUP BY 1)
SELECT tr.o_custkey, round(f - a, 5) AS event_time, round(coalesce(f - a, b - a), 5) AS analysis_time, f IS NOT NULL AS event_observed, CASE WHEN f IS NULL THEN 'trial_end' ELSE 'event' END AS censoring_reason FROM tr LEFT JOIN f ON f.o_custkey = tr.o_custkey""")
def survival_data(spark, sf_dir):
    return rounded(_latencies(spark, sf_dir).select("o_custkey", "event_time", "analysis_time", "event_observed", "censoring_reason"))


_SUM_LATENCIES = "WITH o AS (SELECT o_custkey, epoch(o_orderdate) / 86400 AS t, o_orderstatus FROM orders), tr AS (SELECT o_custkey, min(t) AS a FROM o GROUP BY 1), fi AS (SELECT o.o_custkey, min(t) AS f FROM o JOIN tr USING (o_custkey) WHERE o_orderstatus = 'F' AND t BETWEEN a AND a + 1000 GROUP BY 1), lat AS (SELECT tr.o_custkey, a, f FROM tr LEFT JOIN fi ON tr.o_custkey = fi.o_custkey)"


def _latencies(spark, sf_dir) -> DataFrame:
    days = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("double")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", days.alias("t"))
    spans = o.groupBy("o_custkey").agg(F.min("t").alias("a")).withColumn("b", F.col("a") + 1000)
    return survival.prepare_gaze_survival_data(spans, o.filter("o_orderstatus = 'F'"), ["o_custkey"], "a", "b", "t")


@query("""WITH o AS (SELECT o_custkey, epoch(o_orderdate) / 86400 AS t, o_orderstatus FROM orders), tr AS (SELECT o_custkey, min(t) AS a FROM o GROUP BY 1), f AS (SELECT o.o_custkey, min(t) AS f FROM o JOIN tr USING (o_custkey) WHERE o_orderstatus = 'F' AND t BETWEEN a AND a + 1000 GROUP BY 1), d AS (SELECT coalesce(f - a, 1000) AS t, f IS NOT NULL AS e FROM tr LEFT JOIN f USING (o_custkey)), c AS (SELECT t, count(*) AS n, count(*) FILTER (e) AS d FROM d GROUP BY t), r AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM c)
SELECT round(t, 5) AS time, n::BIGINT AS n_at_risk, d AS n_events, round(s, 6) AS survival FROM (SELECT *, exp(sum(ln(1 - d / n)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS s FROM r) WHERE d > 0""")
def kaplan_meier(spark, sf_dir):
    return survival.estimate_gaze_survival(_latencies(spark, sf_dir)).select(F.round("time", 5).alias("time"), "n_at_risk", "n_events", F.round("survival", 6).alias("survival"))


@query(f"""WITH {_S}, w AS (SELECT user_id, unnest(range(greatest(0, floor((t - 172800) / 86400)::BIGINT + 1), least(28, floor(t / 86400)::BIGINT) + 1)) AS window_index, x, t FROM s), d AS (SELECT *, x - lag(x) OVER v AS d, (x + lag(x) OVER v) / 2 * (t - lag(t) OVER v) AS a FROM w WINDOW v AS (PARTITION BY user_id, window_index ORDER BY t))
SELECT user_id, window_index, count(*) AS n_samples, round(avg(x), 8) AS x_mean, round(stddev_samp(x), 8) AS x_sd, round(min(x), 8) AS x_min, round(max(x), 8) AS x_max, round(coalesce(sum(a), 0), 0) AS x_auc, round(sqrt(avg(d * d)), 8) AS x_rmssd FROM d GROUP BY ALL HAVING count(*) >= 3""")
def process_windows(spark, sf_dir):
    spec = windows.WindowSpecification(172800.0, 86400.0, 0.0, 30 * 86400.0, 3)
    w = windows.extract_process_windows(samples(spark, sf_dir), [_U], "t", ["x"], spec)
    return w.select(_U, "window_index", "n_samples", *(F.round(f"x_{c}", 8).alias(f"x_{c}") for c in ("mean", "sd", "min", "max")), F.round("x_auc", 0).alias("x_auc"), F.round("x_rmssd", 8).alias("x_rmssd"))


@query("""WITH m AS (SELECT l_suppkey AS item, year(l_shipdate) AS b, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL), e AS (SELECT item, count(*) AS n_batches, arg_min(q, b) AS q0, arg_max(q, b) AS q1, arg_max(d, b) - arg_min(d, b) AS dd FROM m GROUP BY item), c AS (SELECT quantile_cont(abs(q1 - q0), 0.9) AS c FROM e), f AS (SELECT *, abs(q1 - q0) > c AS qf, dd < -0.01 AS df, n_batches < 7 AS few FROM e, c)
SELECT item, n_batches, round(q0, 5) AS quantity_baseline, round(q1, 5) AS quantity_latest, round(q1 - q0, 5) AS quantity_delta, round(dd, 5) AS discount_delta, qf AS quantity_drift_flag, df AS discount_drift_flag, few AS insufficient_batches_flag, qf::INT + df::INT AS drift_review_count, CASE WHEN few THEN 'insufficient_batches_for_drift_review' WHEN qf OR df THEN 'review_item_or_stimulus_context' ELSE 'no_review_flag' END AS drift_status FROM f""")
def process_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.year("l_shipdate").alias("b"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return rounded(windows.audit_process_drift(rows, "item", "b", ["quantity", "discount"], limits={"discount": 0.01}, falls=["discount"], min_batches=7).drop("discount_baseline", "discount_latest"))


@query("SELECT l_suppkey, count(*) AS n_trials, round(avg(1 - l_discount * 5), 6) AS mean_validity, round(avg(l_tax), 6) AS mean_missing, round(avg(CASE WHEN 1 - l_discount * 5 >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS valid_trial_fraction FROM lineitem GROUP BY l_suppkey")
def preflight(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("v", 1 - F.col("l_discount") * 5)
    audit = windows.audit_biometric_preflight(rows, ["l_suppkey"], "v", "l_tax", "l_quantity")
    return rounded(audit.select("l_suppkey", "n_trials", "mean_validity", "mean_missing", "valid_trial_fraction"), 6)


_CELLS = "WITH c AS (SELECT o_custkey AS p, year(o_orderdate) AS s, avg(o_totalprice) AS v FROM orders GROUP BY ALL)"


def _sessions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p"), F.year("o_orderdate").alias("s"), F.col("o_totalprice").alias("v"))


@query(_CELLS + ", f AS (SELECT *, count(*) OVER (PARTITION BY p) AS c FROM c), k AS (SELECT count(DISTINCT s) AS k FROM c), g AS (SELECT f.*, k FROM f, k WHERE c = k), m AS (SELECT *, avg(v) OVER (PARTITION BY p) AS mp, avg(v) OVER (PARTITION BY s) AS ms, avg(v) OVER () AS gm FROM g), q AS (SELECT count(DISTINCT p) AS n, max(k) AS k, sum((mp - gm) ** 2) AS r, sum((ms - gm) ** 2) AS cc, sum((v - mp - ms + gm) ** 2) AS e FROM m), w AS (SELECT n, k, r / (n - 1) AS msr, cc / (k - 1) AS msc, e / ((n - 1) * (k - 1)) AS mse FROM q WHERE n > 1) SELECT n, k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 5) AS icc FROM w")
def icc(spark, sf_dir):
    return rounded(reliability.process_icc(_sessions(spark, sf_dir), "p", "s", "v").filter("n > 1"))


@query(_CELLS + ", d AS (SELECT a.s AS first, b.s AS second, b.v - a.v AS d FROM c a JOIN c b ON a.p = b.p AND b.s = a.s + 1) SELECT first, second, count(*) AS n, round(avg(d), 3) AS bias, round(stddev_samp(d), 3) AS sd, round(avg(d) - 1.96 * stddev_samp(d), 3) AS lower, round(avg(d) + 1.96 * stddev_samp(d), 3) AS upper FROM d GROUP BY ALL")
def bland_altman(spark, sf_dir):
    cells = _sessions(spark, sf_dir)
    years = [r[0] for r in cells.select("s").distinct().filter("s is not null").orderBy("s").collect()]
    found = [reliability.process_bland_altman(cells, "p", "s", "v", a, a + 1).select(F.lit(a).alias("first"), F.lit(a + 1).alias("second"), "*") for a in years if a + 1 in years]
    return rounded(reduce(DataFrame.unionByName, found), 3)


@query(_CELLS + " SELECT a.s AS a, b.s AS b, count(*) AS n, round(corr(a.v, b.v), 5) AS r FROM c a JOIN c b ON a.p = b.p AND a.s < b.s GROUP BY ALL")
def temporal_stability(spark, sf_dir):
    return rounded(reliability.process_temporal_stability(_sessions(spark, sf_dir), "p", "s", "v"))


@query("WITH h AS (SELECT o_custkey, o_totalprice AS v, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 2 AS h FROM orders), w AS (SELECT o_custkey, avg(v) FILTER (h = 1) AS o, avg(v) FILTER (h = 0) AS e FROM h GROUP BY 1), r AS (SELECT count(*) AS n, corr(o, e) AS r FROM w WHERE o IS NOT NULL AND e IS NOT NULL) SELECT n, round(r, 5) AS r, round(2 * r / (1 + r), 5) AS spearman_brown FROM r")
def split_half(spark, sf_dir):
    return rounded(reliability.split_half_process_reliability(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER w, 7) AS o_totalprice_between, round(o_totalprice - avg(o_totalprice) OVER w, 7) AS o_totalprice_within FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def within_between(spark, sf_dir):
    parts = reliability.decompose_within_between(table(spark, sf_dir, "orders"), ["o_totalprice"], "o_custkey")
    return rounded(parts.select("o_orderkey", "o_totalprice_between", "o_totalprice_within"), 7)


#: Items are parts: discrimination from their size, difficulty from their price.
_ITEMS = "i AS (SELECT p_partkey AS item_id, 0.5 + p_size / 50.0 AS a, (p_retailprice - 1400) / 300 AS b FROM part)"
_GRID = "g AS (SELECT unnest(range(0, 81)) * 0.1 - 4 AS theta)"


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (0.5 + F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - 1400) / 300).alias("b"))


@query(f"WITH {_ITEMS}, {_GRID}, p AS (SELECT theta, a, 1 / (1 + exp(-a * (theta - b))) AS p FROM i, g) SELECT round(theta, 4) AS theta, round(sum(a * a * p * (1 - p)), 4) AS information, round(1 / sqrt(sum(a * a * p * (1 - p))), 6) AS sem FROM p GROUP BY theta")
def test_information(spark, sf_dir):
    out = irt.test_information(_items(spark, sf_dir), irt.theta_grid())
    return out.select(F.round("theta", 4).alias("theta"), F.round("information", 4).alias("information"), F.round("sem", 6).alias("sem"))


@query(f"WITH {_ITEMS}, {_GRID} SELECT round(theta, 4) AS theta, round(sum(1 / (1 + exp(-a * (theta - b)))), 4) AS expected_score FROM i, g GROUP BY theta")
def characteristic_curve(spark, sf_dir):
    return rounded(irt.test_characteristic_curve(_items(spark, sf_dir), irt.theta_grid()).withColumn("theta", F.round("theta", 4)), 4)


#: Persons are orders, whose price is their ability; a line of an order is a response to its part: more than 25 of it or not.
_RESP = f"WITH {_ITEMS}, r AS (SELECT l_orderkey AS person, l_partkey AS item_id, l_linenumber, (l_quantity > 25)::INT AS response, (o_totalprice - 150000) / 75000 AS theta FROM lineitem JOIN orders ON o_orderkey = l_orderkey), p AS (SELECT r.*, a, b, 1 / (1 + exp(-a * (theta - b))) AS p FROM r JOIN i USING (item_id))"


def _responses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_partkey").alias("item_id"), "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("response"))


def _modelled(spark, sf_dir) -> DataFrame:
    abilities = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("person"), ((F.col("o_totalprice") - 150000) / 75000).alias("theta"))
    return irt.joined_probabilities(_responses(spark, sf_dir), abilities, _items(spark, sf_dir))


@query(_RESP + " SELECT item_id, count(*) AS n, round(sum((response - p) ** 2) / sum(greatest(p * (1 - p), 1e-8)), 5) AS infit, round(avg((response - p) ** 2 / greatest(p * (1 - p), 1e-8)), 4) AS outfit FROM p GROUP BY item_id")
def item_fit(spark, sf_dir):
    found = irt.infit_outfit(_modelled(spark, sf_dir), "item_id")
    return found.select("item_id", "n", F.round("infit", 5).alias("infit"), F.round("outfit", 4).alias("outfit"))


@query(_RESP + " SELECT person, count(*) AS n_items, round((sum(response * ln(p) + (1 - response) * ln(1 - p)) - sum(p * ln(p) + (1 - p) * ln(1 - p))) / sqrt(sum(p * (1 - p) * ln(p / (1 - p)) ** 2)), 4) AS lz FROM p GROUP BY person")
def person_fit(spark, sf_dir):
    return rounded(irt.person_fit_lz(_modelled(spark, sf_dir), "person"), 4)


@query(_RESP + " SELECT x.l_linenumber AS item_a, y.l_linenumber AS item_b, count(*) AS n, round(corr(x.response - x.p, y.response - y.p), 5) AS q3 FROM p x JOIN p y ON x.person = y.person AND x.l_linenumber < y.l_linenumber GROUP BY ALL")
def q3_residuals(spark, sf_dir):
    return rounded(irt.q3(_modelled(spark, sf_dir), "person", "l_linenumber"))


@query(_RESP + f", {_GRID}, l AS (SELECT person, g.theta, count(*) AS n, sum(-ln(1 + exp((CASE WHEN response = 1 THEN a ELSE -a END) * (b - g.theta)))) - g.theta * g.theta / 2 AS l FROM p, g GROUP BY person, g.theta), w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY person)) AS w FROM l) SELECT person, max(n) AS n_items, round(sum(w * theta) / sum(w), 5) AS theta, round(sqrt(sum(w * theta * theta) / sum(w) - (sum(w * theta) / sum(w)) ** 2), 5) AS se FROM w GROUP BY person")
def eap_scores(spark, sf_dir):
    return rounded(irt.eap_scores(_responses(spark, sf_dir), _items(spark, sf_dir), "person"))


@query("SELECT o_custkey, count(*) AS n, round(avg(ln(o_totalprice)), 5) AS mean_log_rt, round(median(o_totalprice), 3) AS median_rt FROM orders GROUP BY o_custkey")
def response_times(spark, sf_dir):
    return irt.response_time_profile(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice").select("o_custkey", "n", F.round("mean_log_rt", 5).alias("mean_log_rt"), F.round("median_rt", 3).alias("median_rt"))


@query("SELECT p_partkey FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_size >= x.p_size AND y.p_retailprice >= x.p_retailprice AND (y.p_size > x.p_size OR y.p_retailprice > x.p_retailprice))")
def pareto_items(spark, sf_dir):
    return irt.pareto_front(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY md5('1:' || c_custkey), c_custkey) - 1) % 5 + 1 AS fold FROM customer")
def grouped_folds(spark, sf_dir):
    return validation.grouped_folds(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "fold")


@query(f"WITH {_S} SELECT event_id, lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS x_shifted FROM s")
def control_shift(spark, sf_dir):
    return validation.negative_control_shift(samples(spark, sf_dir), "x", "event_id", [_U]).select("event_id", "x_shifted")


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('1:' || event_id), event_id) AS i FROM events), d AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY md5('2:' || event_id), event_id) AS i FROM events) SELECT event_id, value AS value_permuted FROM r JOIN d USING (event_type, i)")
def control_permute(spark, sf_dir):
    return validation.negative_control_permute(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"]).select("event_id", "value_permuted")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity - 25), 5) AS bias, round(sqrt(avg((l_quantity - 25) ** 2)), 5) AS rmse, round(avg(CASE WHEN 25 BETWEEN l_quantity - 10 AND l_quantity + 10 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM lineitem GROUP BY l_returnflag")
def parameter_recovery(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", q.alias("estimate"), F.lit(25.0).alias("truth"), (q - 10).alias("lower"), (q + 10).alias("upper"))
    return rounded(validation.summarise_recovery(rows, ["l_returnflag"]).select("l_returnflag", "n", "bias", "rmse", F.round("coverage", 6).alias("coverage")), 6).withColumns({"bias": F.round("bias", 5), "rmse": F.round("rmse", 5)})


@query("SELECT l_linenumber, count(*) AS n, round(median(l_discount - 0.05), 6) AS median, round(greatest(count(*) FILTER (l_discount - 0.05 > 0), count(*) FILTER (l_discount - 0.05 < 0)) / count(*) FILTER (l_discount - 0.05 != 0), 6) AS sign_stability FROM lineitem GROUP BY l_linenumber")
def sensitivity_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("e", F.col("l_discount") - 0.05)
    return rounded(validation.summarise_sensitivity(rows, "e", ["l_linenumber"]).select("l_linenumber", "n", "median", "sign_stability"), 6)


@query("WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_linenumber != 3) AS k, avg(l_quantity) FILTER (l_linenumber != 3) AS m FROM lineitem) SELECT d AS delta, round(m + (n - k) / n * d, 6) AS estimate FROM c, (VALUES (-1.0::DOUBLE), (0.0), (1.0)) v(d)")
def delta_adjusted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    return rounded(validation.delta_adjusted_means(rows, "q", [-1.0, 0.0, 1.0]), 6)


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY l_returnflag")
def process_norms(spark, sf_dir):
    fit = validation.fit_process_norms(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return fit.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(f"WITH {_S}, c AS (SELECT user_id, event_type, count(*) AS k FROM s GROUP BY ALL) SELECT user_id, sum(k)::BIGINT AS n, round(sum(k * (k - 1) / 2), 1) AS recurrent_pairs, round(sum(k * (k - 1) / 2) / nullif(sum(k) * (sum(k) - 1) / 2, 0), 6) AS recurrence_rate FROM c GROUP BY user_id")
def aoi_recurrence(spark, sf_dir):
    return rounded(scanpaths.aoi_recurrence_counts(samples(spark, sf_dir), [_U], "event_type"), 6)


@query(f"WITH {_S}, o AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM s) SELECT a.user_id, a.i::BIGINT AS i, b.i::BIGINT AS j FROM o a JOIN o b ON a.user_id = b.user_id AND a.i < b.i AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.7")
def gaze_recurrence(spark, sf_dir):
    return scanpaths.recurrence_points(samples(spark, sf_dir), [_U], "t", "x", "y", 0.7).select(_U, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query(None)
def process_changepoints(spark, sf_dir):
    return rounded(scanpaths.detect_process_changepoints(samples(spark, sf_dir), "t", [_U], ["x", "y"], 5))


_PAIRS = "WITH u AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, sf_dir) -> DataFrame:
    u = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("a"))
    return u.join(u.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])


@query(_PAIRS + ", g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || chr(1) || a[i + 1])) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || chr(1) || b[i + 1])) AS y FROM p) SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM g")
def ngram_jaccard(spark, sf_dir):
    return rounded(scanpaths.ngram_jaccard_similarity(_turns(spark, sf_dir), "a", "b").select("conv_id", "turn", "jaccard"), 6)


@query(None)
def levenshtein_turns(spark, sf_dir):
    return rounded(scanpaths.levenshtein_scanpath(_turns(spark, sf_dir), "a", "b").select("conv_id", "turn", "levenshtein"), 6)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits, dwell and entropies of every recording in one table."""
    s = samples(spark, sf_dir)
    visits = aoi.build_aoi_visits(s, "t", [_U], "event_type", 40000.0)
    parts = [features.summarize_fixations(visits, [_U]), features.gaze_entropy(s, [_U], "event_type"), features.transition_entropy(s, "t", [_U], "event_type")]
    return parts[0].join(parts[1], [_U], "full").join(parts[2], [_U], "full")
