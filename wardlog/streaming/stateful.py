"""Alert sessions and behaviour features on streams, with Spark's own windows and state.

Rules run per micro-batch with the batch plans (`ingest.Ingest`), which spread a source over its seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlog.operators.features import features_of, value_counts


def session_alerts(hits: DataFrame, gap: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Streaming alerts: hits of one rule and source merged while at most `gap` seconds apart.

    hits: rule_name, src_ip, severity, ts (timestamp). Emitted once the session is closed.
    """
    return (hits.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", f"{gap} seconds").alias("w"), "rule_name", "src_ip")
            .agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"),
                 F.max("ts").alias("last_seen"),
                 F.min_by("severity", "ts").alias("severity"))
            .select("rule_name", "src_ip", "severity", "count", "first_seen", "last_seen"))


def feature_stream(events: DataFrame, window: int = 60, delay: str = "10 minutes", min_events: int = 1) -> DataFrame:
    """The twelve features per source and window, once the window is closed: what `ip_features` gives of its events.

    Two stateful aggregates one after the other, as in the batch plan: values are counted per window, so a busy source is
    spread over its values and distinct counts are exact; features are read off the counts when those are final.
    """
    length = f"{window} seconds"
    timed = events.withColumn("_t", F.timestamp_seconds("epoch")).withWatermark("_t", delay)
    counts = value_counts(timed, window, F.window("_t", length))
    found = features_of(counts, F.window(F.window_time("bucket"), length), min_events)
    return found.withColumn("bucket", F.unix_seconds(F.col("bucket.start")))
