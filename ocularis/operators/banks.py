"""Item banks, designs, process profiles and cognitive-diagnosis tables as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, entropy, finite, ratio, share
from .irt import mean_sigma_link


def bank_coverage(curve: DataFrame, target_information: float = 5.0, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """Share of an information curve's points in the target region that have enough, with the least information and the largest error: one row."""
    inside = curve.filter(F.col("theta").between(low, high))
    return inside.agg(F.count("*").alias("n_points"), share(F.col("information") >= target_information).alias("fraction_target_met"), F.min("information").alias("minimum_information"), F.max("sem").alias("maximum_sem"))


def missing_by_design_audit(responses: DataFrame, design: DataFrame, person: str, item: str, response: str = "response") -> DataFrame:
    """Observed, structurally and unexpectedly missing responses, from the designed pairs (person, item, administered): one row."""
    seen = responses.filter(finite(response).isNotNull()).select(person, item).distinct().withColumn("_seen", F.lit(True))
    both = design.join(seen, [person, item], "left")
    missing = F.col("_seen").isNull()
    return both.agg(F.count("*").alias("n_pairs"), share(~missing).alias("observed_fraction"), F.count_if(missing & ~F.col("administered")).alias("structural_missing"), F.count_if(missing & F.col("administered")).alias("unexpected_missing"))


def channel_profile(df: DataFrame, by: str, channels: Sequence[str]) -> DataFrame:
    """Rows and means of process channels of each item or person."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(finite(c)).alias(c) for c in channels))


def process_alignment(items: DataFrame, profile: DataFrame, channels: Sequence[str], item: str = "item_id") -> DataFrame:
    """Correlation of each channel's item means with discrimination and difficulty."""
    joined = items.select(item, "a", "b").join(profile.select(item, *channels), item)
    long = joined.unpivot(["a", "b"], list(channels), "channel", "_v")
    return long.groupBy("channel").agg(correlation("_v", "a").alias("correlation_discrimination"), correlation("_v", "b").alias("correlation_difficulty"))


def qmatrix_item_audit(q: DataFrame, items: DataFrame) -> DataFrame:
    """Attributes of each item (q: item_id, skill), and whether another item has just the same."""
    sets = items.select("item_id").join(q.groupBy("item_id").agg(F.array_sort(F.collect_set("skill")).alias("_s")), "item_id", "left")
    named = sets.withColumn("_s", F.coalesce("_s", F.array().cast("array<string>")))
    same = F.count("*").over(Window.partitionBy("_s"))
    return named.select("item_id", F.size("_s").alias("n_attributes"), (F.size("_s") == 0).alias("no_attribute"), (same > 1).alias("duplicate"))


def qmatrix_attribute_audit(q: DataFrame, skills: DataFrame) -> DataFrame:
    """Items of each attribute, and whether one of them needs it alone."""
    loads = q.distinct().withColumn("_k", F.count("*").over(Window.partitionBy("item_id")))
    counts = loads.groupBy("skill").agg(F.count("*").alias("n_items"), F.max(F.col("_k") == 1).alias("pure"))
    out = skills.select("skill").distinct().join(counts, "skill", "left")
    return out.select("skill", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("pure", F.lit(False)).alias("pure"), F.col("n_items").isNull().alias("unmeasured"))


def dina_probability(ideal: DataFrame, slip: Column | float = 0.1, guess: Column | float = 0.2) -> DataFrame:
    """Probability of success of each ideal response: one less slips, or a guess."""
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ideal.withColumn("p", F.when(F.col("ideal") == 1, 1 - wrap(slip)).otherwise(wrap(guess)))


def classification_uncertainty(profiles: DataFrame, case: str, probability: str = "probability") -> DataFrame:
    """Largest probability of a case's profiles, their entropy and its share of the largest possible."""
    out = profiles.groupBy(case).agg(F.count("*").alias("n_profiles"), F.max(probability).alias("max_probability"), entropy(probability, 2.718281828459045).alias("entropy"))
    return out.withColumn("normalized_entropy", ratio("entropy", F.ln("n_profiles")))


def testlet_audit(items: DataFrame, testlet: str = "testlet", minimum: int = 2) -> DataFrame:
    """Items of each testlet, and whether they are enough."""
    return items.groupBy(testlet).agg(F.count("*").alias("n_items")).withColumns({"singleton": F.col("n_items") == 1, "meets_minimum": F.col("n_items") >= minimum})


def link_stability(reference: DataFrame, focal: DataFrame, anchor_sets: Sequence[DataFrame], item: str = "item_id") -> DataFrame:
    """mean_sigma_link over each of several sets of anchors, in order: column set."""
    out = None
    for k, anchors in enumerate(anchor_sets, 1):
        kept = reference.join(anchors.select(item), item, "left_semi")
        one = mean_sigma_link(kept, focal, item).withColumn("set", F.lit(k))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no anchor sets")
    return out
