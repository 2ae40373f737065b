"""Agreement of event detectors with annotations and with each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from .events import match_detected_events


def detector_matches(truth: DataFrame, detected: DataFrame, by: Sequence[str], kind: str, width: float, minimum_iou: float = 0.5) -> DataFrame:
    """One-to-one matches of events of one kind with their overlap and the errors of both boundaries."""
    keys = [*by, kind]
    matched = match_detected_events(truth, detected, keys, width, minimum_iou)
    return matched.select(*keys, "a_start", "a_end", "b_start", "b_end", "iou", (F.col("b_start") - F.col("a_start")).alias("onset_error"), (F.col("b_end") - F.col("a_end")).alias("offset_error"))


def event_boundary_error(matches: DataFrame, kind: str) -> DataFrame:
    """Mean, spread and largest error of both boundaries for each kind of event."""
    parts = []
    for c in ("onset_error", "offset_error"):
        parts += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}"), F.max(F.abs(c)).alias(f"max_abs_{c}")]
    return matches.groupBy(kind).agg(F.count("*").alias("n"), *parts)


def benchmark_event_detector(truth: DataFrame, detected: DataFrame, by: Sequence[str], kind: str, width: float, minimum_iou: float = 0.5) -> DataFrame:
    """Hits, false alarms, misses, precision, recall, F1 and mean errors of a detector against annotations: one row."""
    matches = detector_matches(truth, detected, by, kind, width, minimum_iou)
    hits = matches.agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"), F.avg(F.abs("onset_error")).alias("mean_abs_onset_error"), F.avg(F.abs("offset_error")).alias("mean_abs_offset_error"))
    sizes = truth.agg(F.count("*").alias("truth_events")).crossJoin(F.broadcast(detected.agg(F.count("*").alias("detected_events"))))
    both = hits.crossJoin(F.broadcast(sizes)).withColumns({"fp": F.col("detected_events") - F.col("tp"), "fn": F.col("truth_events") - F.col("tp")})
    scored = both.withColumns({"precision": ratio("tp", "detected_events"), "recall": ratio("tp", "truth_events")})
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare_event_detectors(truth: DataFrame, detectors: Mapping[str, DataFrame], by: Sequence[str], kind: str, width: float, minimum_iou: float = 0.5) -> DataFrame:
    """A row of benchmark_event_detector for each named detector."""
    out = None
    for name, detected in detectors.items():
        one = benchmark_event_detector(truth, detected, by, kind, width, minimum_iou).withColumn("detector", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no detectors")
    return out


def estimate_detector_agreement(events: DataFrame, ids: Sequence[str], by: Sequence[str], kind: str, width: float, minimum_iou: float = 0.1) -> DataFrame:
    """A row of benchmark_event_detector for each pair of detectors of a multiverse (column detector_id), without a gold standard."""
    names = sorted(ids)
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pair = [events.filter(F.col("detector_id") == x).drop("detector_id") for x in (a, b)]
            one = benchmark_event_detector(pair[0], pair[1], by, kind, width, minimum_iou).withColumns({"detector_a": F.lit(a), "detector_b": F.lit(b)})
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("agreement needs two detectors")
    return out.withColumnsRenamed({"truth_events": "reference_events", "detected_events": "candidate_events", "tp": "matched_events"}).drop("fp", "fn")


def summarise_detector_disagreement(agreement: DataFrame) -> DataFrame:
    """The events of each pair of detectors that the other hasn't."""
    counts = {"unmatched_reference": F.col("reference_events") - F.col("matched_events"), "unmatched_candidate": F.col("candidate_events") - F.col("matched_events"), "event_count_difference": F.col("candidate_events") - F.col("reference_events")}
    return agreement.withColumns(counts)


def propagate_detector_to_features(events: DataFrame, by: Sequence[str], duration: str = "duration_ms") -> DataFrame:
    """Fixation counts and durations of each group under each detector."""
    return events.groupBy("detector_id", *by).agg(F.count("*").alias("fixation_count"), F.sum(finite(duration)).alias("total_duration_ms"), F.avg(finite(duration)).alias("mean_duration_ms"))


def detector_feature_sensitivity(features: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Range and spread of each feature of a group over the detectors, in long form."""
    long = features.select("detector_id", *by, *(finite(n).alias(n) for n in names)).unpivot(["detector_id", *by], list(names), "feature_name", "value")
    return long.groupBy(*by, "feature_name").agg(F.count("value").alias("n_detectors"), (F.max("value") - F.min("value")).alias("range"), F.stddev_samp("value").alias("sd"), ratio(F.stddev_samp("value"), F.abs(F.avg("value"))).alias("cv"))
