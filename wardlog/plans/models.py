"""Behaviour models as versioned artefacts: trained and published by one job, read and used by others.

A version is a folder of small tables (forest nodes, bounds of the training scores, medians and deviations, scaler, centres),
written completely before one pointer file names it. So a scoring job sees the old model or the new one, never
half of one. Detections are stored per algorithm and replaced with each training; summaries are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.constants import FEATURES
from wardlog.operators import clusters
from wardlog.operators import forest as trees
from wardlog.operators.features import feature_vector, ip_features
from wardlog.operators.statistics import attach, explain
from wardlog.plans import training
from wardlog.plans.reports import training_events
from wardlog.session import materialise
from wardlog.sources import tables
from wardlog.sources.commits import Folder

STATS = "feature STRING, baseline DOUBLE, std DOUBLE"
CENTRES = "cluster INT, centre ARRAY<DOUBLE>"
SCALER = "mean ARRAY<DOUBLE>, std ARRAY<DOUBLE>, window INT, k INT, silhouette DOUBLE"
FOREST, KMEANS = "isolation_forest", "kmeans"
POINTER = "current"
#: One row per training run, what a model page shows.
SUMMARY = ("version STRING, algo STRING, window INT, hours INT, events BIGINT, oldest BIGINT, newest BIGINT, samples BIGINT, "
           "anomalies BIGINT, score_mean DOUBLE, basis_ips BIGINT, auc DOUBLE, k INT, silhouette DOUBLE")
DETECTION = ("src_ip STRING, epoch BIGINT, algo STRING, anomaly_score DOUBLE, label INT, cluster INT, distance DOUBLE, "
             "feature_vector MAP<STRING, DOUBLE>, top_features ARRAY<STRUCT<feature: STRING, value: DOUBLE, baseline: DOUBLE, "
             "deviation: DOUBLE, abs_deviation: DOUBLE>>")


@dataclass
class Model:
    """What scoring needs; `centres` is empty where no clusters were asked for."""

    version: str
    window: int
    forest: trees.Forest
    stats: list[tuple[str, float, float]]
    mean: list[float]
    std: list[float]
    centres: list[list[float]]
    k: int | None = None
    silhouette: float | None = None

    def save(self, spark: SparkSession, root: str) -> None:
        """Write the version, then name it."""
        path = f"{root}/{self.version}"
        self.forest.save(spark, path)
        for name, rows, columns in (
                ("stats", self.stats, STATS), ("centres", list(enumerate(self.centres)), CENTRES),
                ("scaler", [(self.mean, self.std, self.window, self.k, self.silhouette)], SCALER)):
            spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        Folder(spark, root).write(POINTER, self.version)

    @staticmethod
    def load(spark: SparkSession, root: str, version: str | None = None) -> "Model":
        version = version or Folder(spark, root).read(POINTER)
        if version is None:
            raise ValueError(f"no model is published in {root}")
        path = f"{root}/{version}"
        read = lambda name, columns: spark.read.schema(columns).parquet(f"{path}/{name}").collect()
        scaler = read("scaler", SCALER)[0]
        centres = sorted(read("centres", CENTRES), key=lambda r: r.cluster)
        return Model(version, scaler.window, trees.Forest.load(spark, path), [tuple(r) for r in read("stats", STATS)],
                     scaler["mean"], scaler["std"], [r.centre for r in centres], scaler.k, scaler.silhouette)

    def detections(self, features: DataFrame, threshold: float = 0.6) -> DataFrame:
        """Scores, labels and explanations of feature rows (src_ip, bucket, the features, `features`)."""
        spark = features.sparkSession
        labelled = trees.predict(self.forest, features, threshold)
        explained = explain(labelled, spark.createDataFrame(self.stats, STATS), FEATURES)
        return _as_detections(explained, FOREST, F.round("anomaly_score", 4), F.col("label"))

    def clustered(self, features: DataFrame) -> DataFrame:
        """The nearest centre of each row in standardised units, and the distance to it."""
        literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        units = literal([1.0 / s if s else 0.0 for s in self.std])
        scaled = F.zip_with(F.zip_with("features", literal(self.mean), lambda a, b: a - b), units, lambda a, b: a * b)
        away = lambda centre: F.aggregate(F.zip_with("_scaled", literal(centre), lambda a, b: (a - b) * (a - b)),
                                          F.lit(0.0), lambda total, x: total + x)
        nearest = F.array_min(F.array(*[F.struct(away(c).alias("d"), F.lit(i).alias("cluster"))
                                        for i, c in enumerate(self.centres)]))
        near = features.withColumn("_scaled", scaled).withColumn("_near", nearest)
        return _as_detections(near, KMEANS, F.lit(None), F.lit(None), F.col("_near.cluster"), F.sqrt("_near.d"))


def _as_detections(rows: DataFrame, algo: str, score: Column, label: Column, cluster: Column | None = None,
                   distance: Column | None = None) -> DataFrame:
    types = dict(part.split(" ", 1) for part in DETECTION.split("feature_vector")[0].rstrip(", ").split(", "))
    vector = F.map_from_arrays(F.array(*[F.lit(c) for c in FEATURES]), F.col("features"))
    told = F.col("top_features") if "top_features" in rows.columns else F.lit(None).cast(
        DETECTION.split("top_features ")[1])
    values = {"src_ip": F.col("src_ip"), "epoch": F.col("bucket"), "algo": F.lit(algo), "anomaly_score": score, "label": label,
              "cluster": F.lit(None) if cluster is None else cluster, "distance": F.lit(None) if distance is None else distance}
    return rows.select(*[v.cast(types[n]).alias(n) for n, v in values.items()], vector.alias("feature_vector"),
                       told.alias("top_features"))


def run_training(events: DataFrame, rule_alerts: DataFrame, out: str, version: str, as_of: Column, hours: int = 24,
                 window: int = 60, threshold: float = 0.6, n_trees: int = 100, k: int | None = None,
                 also_kmeans: bool = True, seed: int = 42) -> DataFrame:
    """Train on the events of the last `hours` (0: all) and publish the model, its detections and alerts.

    Writes `{out}/models/{version}` and the pointer to it, `{out}/detections` (a partition per algorithm, replaced),
    `{out}/ml_alerts` (replaced) and a row per algorithm to `{out}/model_runs`. Returns those rows. Rule alerts in the same
    range are the basis of the evaluation, `basis_ips` the number of their sources.
    """
    spark = events.sparkSession
    recent = training_events(events, as_of, hours)
    made = training.train_and_detect(recent, rule_alerts, window, threshold, n_trees, seed, as_of=as_of, hours=hours)
    model = Model(version, window, made.forest, [tuple(r) for r in made.medians.collect()], [], [], [])
    if also_kmeans:
        found = clusters.cluster(made.features, k=k, seed=seed)
        model.mean, model.std = (list(map(float, x)) for x in (found.scaler.mean, found.scaler.std))
        model.centres = [list(map(float, c)) for c in found.model.clusterCenters()]
        model.k, model.silhouette = found.k, found.silhouette
    model.save(spark, f"{out}/models")
    results = model.detections(made.features, threshold)
    if also_kmeans:
        results = results.unionByName(model.clustered(made.features))
    tables.replace_partition(results, f"{out}/detections", "algo")
    made.alerts.write.mode("overwrite").parquet(f"{out}/ml_alerts")
    span = recent.agg(F.count("*").alias("events"), F.min("epoch").alias("oldest"), F.max("epoch").alias("newest"))
    row = attach(attach(made.summary, span), made.evaluation.select("auc"))
    algos = [(FOREST, None, None)] + ([(KMEANS, model.k, model.silhouette)] if also_kmeans else [])
    what = spark.createDataFrame([(version, window, hours, *a) for a in algos],
                                 "version STRING, window INT, hours INT, algo STRING, k INT, silhouette DOUBLE")
    names = [part.split(" ")[0] for part in SUMMARY.split(", ")]
    told = materialise(attach(what, row).select(*names))
    told.write.mode("append").parquet(f"{out}/model_runs")
    return told


def run_scoring(events: DataFrame, out: str, threshold: float = 0.6) -> DataFrame:
    """Detections of new events by the published model, with its window, explanations and clusters."""
    model = Model.load(events.sparkSession, f"{out}/models")
    features = materialise(feature_vector(ip_features(events, model.window)))
    found = model.detections(features, threshold)
    return found.unionByName(model.clustered(features)) if model.centres else found
