"""Queries: behaviour features, statistics, forest, clusters, connection records."""

import uuid

from pyspark.sql import functions as F

from wardlog.catalog.base import (DAY, alerts, events, query, table, with_alerts,
                                  with_ev)
from wardlog.constants import (CATEGORICAL_COLUMNS, CONNECTION_COLUMNS, FEATURES, ML_RULE_NAME,
                               SPECIAL_CHARS)
from wardlog.operators import alerts as alert_ops
from wardlog.operators import clusters, forest
from wardlog.operators import statistics as stats
from wardlog.operators.features import feature_vector, ip_features
from wardlog.plans import models, reports
from wardlog.session import materialise, shared_folder
from wardlog.sources import connections
from wardlog.sources.commits import Folder

_STRIPPED = "txt"
for _c in SPECIAL_CHARS:
    _STRIPPED = f"replace({_STRIPPED}, '{_c if _c != chr(39) else chr(39) * 2}', '')"

FEATURES_SQL = f"""
seen AS (SELECT *, CAST(floor(epoch / {DAY}) * {DAY} AS BIGINT) AS bucket,
           coalesce(url, '') || ' ' || coalesce(raw, '') AS txt FROM ev),
gap AS (SELECT *, epoch - lag(epoch) OVER (PARTITION BY src_ip, bucket ORDER BY epoch) AS g
        FROM seen),
status AS (SELECT src_ip, bucket, sum(n) AS total, sum(n * log2(n)) AS nlogn FROM (
             SELECT src_ip, bucket, status_code, count(*) AS n FROM seen
             WHERE status_code IS NOT NULL GROUP BY ALL) GROUP BY ALL),
feat AS (
  SELECT src_ip, bucket, CAST(count(*) AS DOUBLE) AS events,
    CAST(count(DISTINCT dst_port) AS DOUBLE) AS uniq_dst_ports,
    round(count(*) FILTER (WHERE outcome = 'failed' OR status_code >= 400) / count(*), 4)
      AS fail_ratio,
    coalesce(round(count(*) FILTER (WHERE status_code >= 400)
      / nullif(count(*) FILTER (WHERE log_type = 'web'), 0), 4), 0.0) AS error_ratio,
    coalesce(round(avg(length(url)), 2), 0.0) AS url_avg_len,
    round(sum(length(txt) - length({_STRIPPED})) / sum(length(txt)), 6) AS special_char_ratio,
    CAST(count(DISTINCT nullif(user_agent, '')) AS DOUBLE) AS uniq_uas,
    CAST(count(DISTINCT dst_ip) AS DOUBLE) AS uniq_dst_ips,
    coalesce(round(avg(g), 3), 0.0) AS interval_mean,
    CASE WHEN count(g) >= 2 THEN round(sqrt(sum((g - m) * (g - m)) / (count(g) - 1)), 3)
      ELSE 0.0 END AS interval_std,
    coalesce(round(greatest(log2(any_value(s.total)) - any_value(s.nlogn) / any_value(s.total),
      0.0), 4), 0.0) AS status_entropy,
    CAST(count(DISTINCT username) AS DOUBLE) AS uniq_usernames
  FROM (SELECT *, round(avg(g) OVER (PARTITION BY src_ip, bucket), 3) AS m FROM gap)
  LEFT JOIN status s USING (src_ip, bucket)
  GROUP BY src_ip, bucket)"""


def _features(spark, sf, least=1):
    return ip_features(events(spark, sf), DAY, least)


@query("ip_features", with_ev(FEATURES_SQL, f"""
SELECT src_ip, bucket, {', '.join(FEATURES)} FROM feat"""))
def features(spark, sf):
    return _features(spark, sf)


@query("ip_features_minimum", with_ev(FEATURES_SQL, """
SELECT src_ip, count(*) AS windows, CAST(sum(events) AS DOUBLE) AS events FROM feat
WHERE events >= 3 GROUP BY src_ip"""))
def features_minimum(spark, sf):
    return _features(spark, sf, 3).groupBy("src_ip").agg(
        F.count("*").alias("windows"), F.sum("events").alias("events"))


@query("tumbling_buckets", with_ev("""
SELECT CAST(floor(epoch / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS events FROM ev
GROUP BY ALL"""))
def buckets(spark, sf):
    from wardlog.functions.timewin import floor_to
    return events(spark, sf).groupBy(floor_to(F.col("epoch"), 3600).alias("bucket")).agg(
        F.count("*").alias("events"))


@query("feature_vector", with_ev(FEATURES_SQL, f"""
SELECT src_ip, bucket, round({' + '.join(f'{i + 1} * {c}' for i, c in enumerate(FEATURES))}, 2)
  AS weighted FROM feat"""))
def vector(spark, sf):
    """Order-sensitive digest of the vector column."""
    weighted = sum((F.get("features", F.lit(i)) * (i + 1) for i in range(len(FEATURES))),
                   F.lit(0.0))
    return feature_vector(_features(spark, sf)).select(
        "src_ip", "bucket", F.round(weighted, 2).alias("weighted"))


_USED = tuple(FEATURES)


@query("feature_medians", with_ev(FEATURES_SQL, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median({c}) AS baseline, round(stddev_pop({c}) + 1e-9, 6) AS std "
    "FROM feat" for c in _USED)))
def medians(spark, sf):
    return stats.medians(_features(spark, sf), _USED).select(
        "feature", "baseline", F.round("std", 6).alias("std"))


@query("anomaly_explanation", with_ev(FEATURES_SQL, "med AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{c}' AS feature, median({c}) AS b, stddev_pop({c}) + 1e-9 AS s FROM feat"
    for i, c in enumerate(_USED)) + ")", "long AS (" + " UNION ALL ".join(
        f"SELECT src_ip, bucket, '{c}' AS feature, {c} AS v FROM feat" for c in _USED) + ")", """
dev AS (SELECT l.src_ip, l.bucket, l.feature, round((v - b) / s, 2) AS deviation,
   row_number() OVER (PARTITION BY l.src_ip, l.bucket ORDER BY abs((v - b) / s) DESC, i) AS n
   FROM long l JOIN med USING (feature))""", """
SELECT src_ip, bucket, feature, deviation, CAST(n AS INTEGER) AS place FROM dev WHERE n <= 3"""))
def explanation(spark, sf):
    found = _features(spark, sf)
    told = stats.explain(found, stats.medians(found, _USED), _USED, 3)
    return told.select("src_ip", "bucket", F.posexplode("top_features").alias("p", "e")).select(
        "src_ip", "bucket", "e.feature", "e.deviation", (F.col("p") + 1).alias("place"))


# ------------------------------------------------------------------------- scores and labels

SCORED_SQL = """
scored AS (SELECT value / (SELECT max(value) FROM events) AS score,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"""


def _scored(spark, sf):
    source = table(spark, sf, "events")
    top = source.agg(F.max("value").alias("top"))
    return stats.attach(source, top).select(
        (F.col("value") / F.col("top")).alias("score"),
        (F.col("event_type") == "error").cast("int").alias("label"))


@query("threshold_labels", "WITH " + SCORED_SQL + """
SELECT label, score >= 0.05 AS flagged, count(*) AS events FROM scored GROUP BY ALL""")
def threshold_labels(spark, sf):
    return _scored(spark, sf).groupBy("label", (F.col("score") >= 0.05).alias("flagged")).agg(
        F.count("*").alias("events"))


@query("score_histogram", "WITH " + SCORED_SQL + """
SELECT CAST(b AS INTEGER) AS bin, printf('%.1f~%.1f', b / 10, (b + 1) / 10) AS range,
  (SELECT count(*) FROM scored WHERE least(9, floor(score * 10)) = b) AS count
FROM range(10) r(b)""")
def histogram(spark, sf):
    return stats.score_histogram(_scored(spark, sf))


@query("roc_auc", "WITH " + SCORED_SQL + """
, ranked AS (SELECT label, (rank() OVER (ORDER BY score)
    + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS r FROM scored)
SELECT count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_positive,
  round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
  / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM ranked""")
def auc(spark, sf):
    return stats.roc_auc(_scored(spark, sf)).withColumn("auc", F.round("auc", 6))


@query("roc_curve", "WITH " + SCORED_SQL + """
, c AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS q FROM scored GROUP BY score),
w AS (SELECT score, sum(p) OVER d AS tp, sum(q) OVER d AS fp, row_number() OVER d - 1 AS n,
   sum(p) OVER () AS ap, sum(q) OVER () AS aq, count(*) OVER () AS m FROM c
   WINDOW d AS (ORDER BY score DESC))
SELECT round(score, 6) AS score, round(fp / aq, 6) AS fpr, round(tp / ap, 6) AS tpr
FROM w WHERE n % greatest(CAST(floor(m / 30) AS BIGINT), 1) = 0""")
def curve(spark, sf):
    return stats.roc_curve(_scored(spark, sf)).select(
        *[F.round(c, 6).alias(c) for c in ("score", "fpr", "tpr")])


_THRESHOLDS = (0.01, 0.05, 0.1, 0.2, 0.5)


@query("threshold_sweep", "WITH " + SCORED_SQL + """
, t AS (SELECT unnest([0.01, 0.05, 0.1, 0.2, 0.5])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
   count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
   count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM t, scored GROUP BY threshold)
SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def sweep(spark, sf):
    return stats.threshold_sweep(_scored(spark, sf), _THRESHOLDS).select(
        "threshold", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in (
            "precision", "recall", "f1")])


@query("confusion_rates", "WITH " + SCORED_SQL + """
, c AS (SELECT count(*) FILTER (WHERE score >= 0.1 AND label = 1) AS tp,
   count(*) FILTER (WHERE score >= 0.1 AND label = 0) AS fp,
   count(*) FILTER (WHERE score < 0.1 AND label = 1) AS fn FROM scored)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def rates(spark, sf):
    return stats.confusion(_scored(spark, sf), 0.1).select(
        F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("baseline_labels", with_alerts("""
SELECT y, count(*) AS events FROM (SELECT CASE WHEN src_ip IN (
  SELECT src_ip FROM alerts WHERE rule_id = 8 AND last_seen >= 1706659200 - 240 * 3600)
  THEN 1 ELSE 0 END AS y FROM ev) GROUP BY y"""))
def labels(spark, sf):
    """Events of sources that have a rule alert in the last ten days; ML alerts do not count."""
    from wardlog.catalog.base import as_of
    made = alerts(spark, sf).withColumn("source_type", F.when(F.col("rule_id") == 8, F.lit(None))
                                        .otherwise("ml"))
    return reports.baseline_labels(events(spark, sf), made, as_of(), 240).groupBy("y").agg(
        F.count("*").alias("events"))


@query("training_summary", "WITH " + SCORED_SQL + """
SELECT count(*) AS samples, count(*) FILTER (WHERE score >= 0.1) AS anomalies,
  round(avg(score), 4) AS score_mean FROM scored""")
def summary(spark, sf):
    return _scored(spark, sf).agg(
        F.count("*").alias("samples"), F.count_if(F.col("score") >= 0.1).alias("anomalies"),
        F.round(F.avg("score"), 4).alias("score_mean"))


@query("training_run", with_alerts("""
recent AS (SELECT * FROM ev WHERE epoch >= 1706659200 - 240 * 3600)""", """
SELECT 'isolation_forest' AS algo, (SELECT count(*) FROM recent) AS events, (SELECT min(epoch) FROM recent) AS oldest,
  (SELECT max(epoch) FROM recent) AS newest,
  (SELECT count(*) FROM (SELECT DISTINCT src_ip, floor(epoch / 3600) FROM recent)) AS samples,
  (SELECT count(DISTINCT src_ip) FROM alerts WHERE last_seen >= 1706659200 - 240 * 3600) AS basis_ips"""))
def training_run(spark, sf):
    """The training job over the last ten days: what it records of its range, samples and basis."""
    from wardlog.catalog.base import as_of
    out = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    told = models.run_training(events(spark, sf), alerts(spark, sf), out, "v1", as_of(), hours=240, window=3600,
                               n_trees=20, also_kmeans=False)
    Folder(spark, out).delete("")
    return told.select("algo", "events", "oldest", "newest", "samples", "basis_ips")


ML_SQL = """
det AS (SELECT src_ip, epoch, score, row_number() OVER (ORDER BY score DESC, src_ip, epoch) AS n
  FROM (SELECT *, round(value / max(value) OVER (), 4) AS score FROM ev) WHERE score >= 0.1),
top AS (SELECT *, lag(epoch) OVER (PARTITION BY src_ip ORDER BY epoch) AS prev FROM det
  WHERE n <= 50),
part AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch - prev > 864000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY src_ip ORDER BY epoch) AS s FROM top)"""


@query("ml_alerts", with_ev(ML_SQL, f"""
SELECT '{ML_RULE_NAME}' AS title, src_ip, count(*) AS count, min(epoch) AS first_seen,
  max(epoch) AS last_seen, first(CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'mid'
  ELSE 'low' END ORDER BY epoch) AS severity, 'ml' AS source_type FROM part GROUP BY src_ip, s"""))
def ml_alerts(spark, sf):
    """The fifty highest scores, merged within ten days."""
    source = events(spark, sf)
    scored = stats.attach(source, source.agg(F.max("value").alias("top"))).select(
        "src_ip", "epoch", F.round(F.col("value") / F.col("top"), 4).alias("anomaly_score"),
        F.array().cast("array<struct<feature:string,deviation:double,abs_deviation:double>>")
        .alias("top_features"))
    return alert_ops.consolidate(alert_ops.ml_hits(scored, 0.1), gap=864000).select(
        "title", "src_ip", "count", "first_seen", "last_seen", "severity", "source_type")


# ------------------------------------------------------------------------- forest and clusters

def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


@query("forest_scores")
def forest_scores(spark, sf):
    """Isolation forest over the embeddings (seeded; no SQL counterpart)."""
    rows = _vectors(spark, sf)
    model = forest.train(rows, ("vec_id",))
    scored = materialise(forest.with_raw_scores(model, rows))
    return forest.normalise(forest.fit_bounds(model, scored), scored).select(
        "vec_id", F.round("anomaly_score", 4).alias("anomaly_score"), "label")


@query("forest_nodes")
def forest_nodes(spark, sf):
    """The forest itself, as a table."""
    return forest.train(_vectors(spark, sf), ("vec_id",)).frame(spark)


@query("forest_on_behaviour")
def behaviour_forest(spark, sf):
    """Features of sources and days, scored, with the three features that stand out most."""
    found = materialise(feature_vector(_features(spark, sf)))
    model = forest.train(found, ("src_ip", "bucket"))
    scored = materialise(forest.with_raw_scores(model, found))
    told = stats.explain(forest.normalise(forest.fit_bounds(model, scored), scored),
                         stats.medians(found, FEATURES), FEATURES)
    return told.select("src_ip", "bucket", F.round("anomaly_score", 4).alias("anomaly_score"),
                       "label", F.array_join("top_features.feature", ",").alias("features"))


@query("standardised_vectors", """
WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) AS d FROM embeddings),
s AS (SELECT d, avg(x) AS m, stddev_samp(x) AS s FROM l GROUP BY d)
SELECT vec_id, round(sum((x - m) / s * (x - m) / s), 4) AS squares
FROM l JOIN s USING (d) GROUP BY vec_id""")
def standardised(spark, sf):
    from pyspark.ml.functions import vector_to_array
    scaled = clusters.standardise(_vectors(spark, sf))
    return scaled.select("vec_id", F.round(F.aggregate(
        vector_to_array("scaled"), F.lit(0.0), lambda t, x: t + x * x), 4).alias("squares"))


@query("kmeans_clusters")
def kmeans(spark, sf):
    """Four clusters and each row's distance to its centre."""
    made = clusters.cluster(_vectors(spark, sf), k=4)
    return made.rows.select("vec_id", "cluster", F.round("distance", 4).alias("distance"))


@query("forest_shape", """
SELECT CAST(t AS INTEGER) AS tree, least(256, (SELECT count(*) FROM embeddings)) AS sampled,
  true AS binary, true AS shallow FROM range(100) r(t)""")
def forest_shape(spark, sf):
    """Per tree: its leaves hold the sample, it is binary, no node lies deeper than the limit."""
    nodes = forest.train(_vectors(spark, sf), ("vec_id",)).frame(spark)
    leaf = F.col("feature") < 0
    trees = nodes.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("size")).otherwise(0)).alias("sampled"),
        (F.count("*") == 2 * F.count_if(leaf) - 1).alias("binary"))
    level = nodes.where("node = 0").select("tree", "node")
    edges = nodes.where(~leaf).select("tree", F.col("node").alias("up"), F.explode(F.array("left", "right")).alias("node"))
    for _ in range(9):          # one step further down than a tree may reach
        level = edges.join(level.withColumnRenamed("node", "up"), ["tree", "up"]).select("tree", "node")
    deep = level.select("tree").distinct().withColumn("deep", F.lit(True))
    return trees.join(deep, "tree", "left").select(
        "tree", "sampled", "binary", F.coalesce(~F.col("deep"), F.lit(True)).alias("shallow"))


@query("forest_score_range", "SELECT vec_id, true AS in_range FROM embeddings")
def forest_score_range(spark, sf):
    return forest_scores(spark, sf).select("vec_id", F.col("anomaly_score").between(0, 1).alias("in_range"))


@query("kmeans_nearest", "SELECT vec_id, true AS nearest, true AS at_mean FROM embeddings")
def kmeans_nearest(spark, sf):
    """Each row sits with its nearest centre, and centres are the means of their rows."""
    from pyspark.ml.functions import vector_to_array
    made = clusters.cluster(_vectors(spark, sf), k=4)
    rows = made.rows.select("vec_id", "cluster", "distance", vector_to_array("scaled").alias("x"))
    size = len(made.model.clusterCenters()[0])
    means = rows.groupBy("cluster").agg(F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(size)]).alias("mean"))
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(made.model.clusterCenters())],
                                    "cluster int, centre array<double>")
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v))
    compared = means.join(centres, "cluster").select("cluster", (gap("mean", "centre") < 1e-2).alias("at_mean"))
    others = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in made.model.clusterCenters()])
    least = F.array_min(F.transform(others, lambda c: gap(F.col("x"), c)))
    return rows.join(compared, "cluster").select(
        "vec_id", (F.abs(F.col("distance") - least) < 1e-6).alias("nearest"), "at_mean")


@query("kmeans_chosen_k")
def chosen_k(spark, sf):
    """The number of clusters with the best silhouette, and how the rows divide."""
    made = clusters.cluster(_vectors(spark, sf), k_range=(3, 8))
    return made.rows.groupBy("cluster").agg(F.count("*").alias("rows")).withColumn(
        "k", F.lit(made.k)).withColumn("silhouette", F.lit(made.silhouette))


@query("kmeans_silhouettes", """
SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM embeddings) AS rows, true AS agrees, true AS no_better
FROM range(3, 9) r(k)""")
def kmeans_silhouettes(spark, sf):
    """Every k of the range: its silhouette is the one Spark's evaluator gives, and none is better than the chosen one."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    scaled = materialise(clusters.fitted_scaler(_vectors(spark, sf))[1])
    models = clusters.fitted(scaled, list(range(3, 9)))
    scores = clusters.silhouettes(scaled, models)
    chosen = clusters.cluster(_vectors(spark, sf), k_range=(3, 8)).silhouette
    judge = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster")
    told = []
    for k, model in models.items():
        found = clusters.with_distance(model, scaled)
        told.append((k, found.count(), abs(judge.evaluate(found) - scores[k]) < 1e-6, round(scores[k], 4) <= chosen))
    return spark.createDataFrame(told, "k int, rows bigint, agrees boolean, no_better boolean")


@query("kmeans_furthest", """
SELECT least(count(*), 10) AS outliers, true AS furthest FROM embeddings""")
def kmeans_furthest(spark, sf):
    """No other row is further from its centre than an outlier is."""
    rows = materialise(clusters.cluster(_vectors(spark, sf), k=4).rows.select("vec_id", "distance"))
    top = clusters.outliers(rows, 10, "vec_id")
    rest = rows.join(top.select("vec_id"), "vec_id", "left_anti").agg(F.max("distance").alias("rest"))
    found = top.agg(F.count("*").alias("outliers"), F.min("distance").alias("least"))
    return stats.attach(found, rest).select("outliers", F.coalesce(F.col("least") >= F.col("rest"), F.lit(True)).alias("furthest"))


@query("kmeans_outliers")
def kmeans_outliers(spark, sf):
    made = clusters.cluster(_vectors(spark, sf), k=4)
    return clusters.outliers(made.rows, 10, "vec_id").select("vec_id", "cluster",
                                                   F.round("distance", 3).alias("distance"))


# ------------------------------------------------------------------------- connection records

_CONNECTION = {
    "protocol_type": "l_returnflag", "service": "l_linestatus",
    "duration": "l_linenumber", "src_bytes": "l_extendedprice", "dst_bytes": "l_quantity",
    "serror_rate": "l_discount", "rerror_rate": "l_tax",
}


def _connections(spark, sf):
    """lineitem as connection records: text columns, some of them not numbers."""
    source = table(spark, sf, "lineitem")
    columns = []
    for name in CONNECTION_COLUMNS:
        if name == "flag":
            value = F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string"))
        elif name == "hot":
            value = F.when(F.col("l_linenumber") > 3, "n/a").otherwise("2")
        elif name in _CONNECTION:
            value = F.col(_CONNECTION[name]).cast("string")
        else:
            value = F.lit("0")
        columns.append(value.alias(name))
    label = F.when(F.col("l_returnflag") == "R", " Normal ").otherwise("neptune")
    return source.select(*columns, label.alias("label"), F.lit(None).cast("string")
                         .alias("difficulty"))


_CODES = """
enc AS (SELECT dense_rank() OVER (ORDER BY l_returnflag) - 1 AS protocol_type,
  dense_rank() OVER (ORDER BY l_linestatus) - 1 AS service, CAST(l_suppkey % 5 AS INTEGER) AS flag,
  CASE WHEN l_linenumber > 3 THEN 0 ELSE 2 END AS hot, l_quantity AS dst_bytes,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS y FROM lineitem)"""


@query("encoded_connections", "WITH " + _CODES + """
SELECT CAST(protocol_type AS DOUBLE) AS protocol_type, CAST(service AS DOUBLE) AS service,
  CAST(flag AS DOUBLE) AS flag, CAST(hot AS DOUBLE) AS hot, y, count(*) AS rows,
  sum(dst_bytes) AS dst_bytes FROM enc GROUP BY ALL""")
def encoded(spark, sf):
    rows = _connections(spark, sf)
    return (connections.encode(rows, connections.fit_encoders(rows))
            .groupBy(*CATEGORICAL_COLUMNS, "hot", "y")
            .agg(F.count("*").alias("rows"), F.sum("dst_bytes").alias("dst_bytes")))


@query("connection_profile", "WITH " + _CODES + """
SELECT count(*) AS samples, 41 AS features, count(*) FILTER (WHERE y = 0) AS normal,
  CAST(sum(y) AS BIGINT) AS attack, round(sum(y) / count(*), 4) AS attack_ratio FROM enc""")
def profile(spark, sf):
    return connections.profile(_connections(spark, sf).withColumn(
        "y", connections.binary_label()))


@query("normal_connections", "WITH " + _CODES + """
SELECT flag, count(*) AS rows FROM enc WHERE y = 0 GROUP BY flag""")
def normal(spark, sf):
    rows = _connections(spark, sf)
    kept = connections.normal_only(connections.encode(rows, connections.fit_encoders(rows)))
    return kept.groupBy(F.col("flag").cast("int").alias("flag")).agg(F.count("*").alias("rows"))


