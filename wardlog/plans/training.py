"""Train-and-detect: features, forest, scores, explanations, evaluation, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wardlog.constants import FEATURES
from wardlog.operators import forest as trees
from wardlog.operators.alerts import consolidate, ml_hits
from wardlog.operators.features import feature_vector, ip_features
from wardlog.operators.statistics import attach, confusion, explain, medians, roc_auc
from wardlog.plans.reports import baseline_sources, labelled
from wardlog.session import materialise

MIN_SAMPLES = 10


@dataclass
class Training:
    forest: trees.Forest
    detections: DataFrame
    alerts: DataFrame
    summary: DataFrame
    evaluation: DataFrame
    features: DataFrame
    medians: DataFrame


def train_and_detect(events: DataFrame, rule_alerts: DataFrame, window: int = 60,
                     threshold: float = 0.6, n_trees: int = 100, seed: int = 42, as_of: Column | None = None,
                     hours: int = 0) -> Training:
    """Each expensive step is checkpointed once: the features, the raw scores, the medians, the sources of rule alerts.

    Rule alerts count as the basis of the evaluation if seen in the last `hours` before `as_of` (by default all do).
    """
    if window < 1:
        raise ValueError(f"a window of {window} seconds")
    features = materialise(feature_vector(ip_features(events, window)))
    forest = trees.train(features, ("src_ip", "bucket"), trees=n_trees, seed=seed)
    scored = materialise(trees.with_raw_scores(forest, features))
    trees.fit_bounds(forest, scored)
    found = trees.normalise(forest, scored, threshold)
    middle = materialise(medians(features, FEATURES))
    explained = explain(found, middle, FEATURES)
    detections = explained.select(
        "src_ip", F.col("bucket").alias("epoch"), F.lit("isolation_forest").alias("algo"),
        F.round("anomaly_score", 4).alias("anomaly_score"), "label",
        F.map_from_arrays(F.array(*[F.lit(c) for c in FEATURES]), F.col("features"))
        .alias("feature_vector"), "top_features")
    basis = materialise(baseline_sources(rule_alerts, as_of, hours))     # small, and behind it lie all rules
    with_truth = labelled(found, basis)
    pairs = with_truth.select(F.col("anomaly_score").alias("score"), F.col("y").alias("label"))
    summary = found.agg(
        F.count("*").alias("samples"), F.count_if(F.col("anomaly_score") >= threshold)
        .alias("anomalies"), F.round(F.avg("anomaly_score"), 4).alias("score_mean"))
    summary = attach(summary, basis.agg(F.count("*").alias("basis_ips")))
    rates = confusion(pairs, threshold).withColumn("_one", F.lit(1))
    evaluation = roc_auc(pairs).withColumn("_one", F.lit(1)).join(rates, "_one").drop("_one")
    return Training(forest, detections, consolidate(ml_hits(detections, threshold)), summary,
                    evaluation, features, middle)
