"""Alerts: hits of one rule and source merge while they are at most a gap apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlog.constants import (ALERT_STATUS, MAX_SAMPLES, MERGE_GAP_SECONDS, ML_EVIDENCE,
                               ML_MESSAGE, ML_NO_FEATURES, ML_RULE_NAME, OPEN_STATUS,
                               SAMPLE_CHARS)
from wardlog.functions.text import clip
from wardlog.functions import timewin
from wardlog.operators.timeline import chunked
from wardlog.session import materialise

KEY = ("rule_name", "_ip")
HIT_NEEDS = (*KEY, "epoch", "seq", "rule_id", "severity", "src_ip", "dst_ip", "url", "category",
             "matched_text", "count")     # of a hit in an alert
UNTIMED = 0      # number of the alert of hits without a time; others count from 1
SLOT = 6 * 3600  # seconds; slots are no longer however long the gap is, so a busy source stays with many tasks


def is_open(status: Column) -> Column:
    return status.isin(*OPEN_STATUS)


def _null_safe(df: DataFrame) -> DataFrame:
    return df.withColumn("_ip", F.coalesce("src_ip", F.lit("")))


def _slot(epoch: Column, length: int) -> Column:
    return epoch if length == 1 else F.floor(epoch / length)


def _slots(hits: DataFrame, length: int = 1) -> DataFrame:
    """One row per (rule, source, slot of `length` seconds) holding all an alert needs, combined map-side: `epoch` and
    `_until` are the times of its first and last hit. Hits of a slot no longer than the gap are always of one alert."""
    first = F.struct("epoch", "seq", "rule_id", "severity", "src_ip", "dst_ip",
                     F.nullif(F.coalesce("url", F.lit("")), F.lit("")).alias("url"), "category")
    last = F.struct("epoch", "seq", "matched_text", "count")
    # their texts make this a sorted aggregate: a number in front decides most comparisons
    slots = hits.withColumns({"_first": first, "_last": last, "epoch": _slot(F.col("epoch"), length)}).groupBy("epoch", *KEY).agg(
        F.count("*").alias("n"), F.min("_first").alias("first"), F.max("_last").alias("last"))
    return slots.withColumns({"_slot": F.col("epoch"), "epoch": F.col("first.epoch"), "_until": F.col("last.epoch")})


def local_sessions(slots: DataFrame, gap: int, status_changes: DataFrame | None = None,
                   length: int = 1) -> DataFrame:
    """Add the time chunk and `_local`, the number of the alert within its key and chunk.

    A slot opens an alert when no slot of its key lies in the `gap` seconds before it, or when the
    last status change between the two closed the earlier one. A change takes effect after the
    hits of its own second, so with changes a slot has to be one second long. Number 0 continues the last alert of
    the chunk before.
    """
    rows = slots.withColumn("_kind", F.lit(0)).withColumn("_status", F.lit("new"))
    if status_changes is not None:
        changes = _null_safe(status_changes).select(
            *KEY, "epoch", F.lit(1).alias("_kind"), F.col("status").alias("_status"))
        rows = rows.unionByName(changes, allowMissingColumns=True)
    in_order = Window.partitionBy(*KEY, "_chunk").orderBy("epoch", "_kind")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = in_order.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.max(F.when(F.col("_kind") == 0, F.col("_until"))).over(near)
    opens = (previous.isNull() | (F.col("epoch") - previous > gap)
             | ~is_open(F.lag("_status").over(in_order)))
    counted = F.col("_own") & (F.col("_kind") == 0)
    return (chunked(rows, gap + length - 1).withColumn("_opens", F.coalesce(opens, F.lit(True)))
            .withColumn("_local", F.count_if(counted & F.col("_opens")).over(upto))
            .where(counted).drop("_own", "_kind", "_status", "_opens"))


def number_sessions(parts: DataFrame) -> DataFrame:
    """Stitch the chunks: `session` is the running number of the alert within its key.

    `parts` has a few rows per key and chunk (alerts are at least a gap apart).
    """
    in_order = Window.partitionBy(*KEY).orderBy("_chunk", "_local").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("session", F.count_if(F.col("_local") > 0).over(in_order))


def _samples(hits: DataFrame, local: DataFrame, numbered: DataFrame, keep: int, length: int) -> DataFrame:
    """Distinct lines of an alert by first arrival, the newest `keep` of them, clipped for display.

    The texts are shuffled twice: to the numbers of their slots' alerts, and by alert and line.
    """
    said = hits.select(*KEY, "epoch", "seq", F.trim("raw").alias("sample")).where(F.col("sample") != "")
    alert_of = local.select(*KEY, "_slot", "_chunk", "_local").join(
        numbered.select(*KEY, "_chunk", "_local", "session"), [*KEY, "_chunk", "_local"]).select(*KEY, "_slot", "session")
    timed = (said.where(F.col("epoch").isNotNull()).withColumn("_slot", _slot(F.col("epoch"), length))
             .join(alert_of, [*KEY, "_slot"]).drop("_slot"))
    untimed = said.where(F.col("epoch").isNull()).withColumn("session", F.lit(UNTIMED))
    lines = timed.unionByName(untimed).groupBy(*KEY, "session", "sample").agg(F.min(F.struct("epoch", "seq")).alias("at"))
    newest = Window.partitionBy(*KEY, "session").orderBy(F.desc("at"), F.desc("sample"))
    return (lines.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep)
            .groupBy(*KEY, "session")
            .agg(F.array_sort(F.collect_list(F.struct("at", "sample"))).alias("s"))
            .select(*KEY, "session", F.transform("s", lambda s: clip(s["sample"], SAMPLE_CHARS)).alias("samples"),
                    F.transform("s", lambda s: F.struct(
                        s["at"]["epoch"].alias("epoch"), s["at"]["seq"].alias("seq"), F.xxhash64(s["sample"]).alias("line"),
                        clip(s["sample"], SAMPLE_CHARS).alias("text"))).alias("said")))


def consolidate(hits: DataFrame, gap: int = MERGE_GAP_SECONDS, max_samples: int = MAX_SAMPLES,
                status_changes: DataFrame | None = None, samples: bool = True,
                for_merging: bool = False, stored: bool = False) -> DataFrame:
    """Hits to alerts: counts, first and last seen, first target, last evidence, samples.

    Hits whose time could not be read form one alert per rule and source, without first and last seen.

    Without samples this is one pass over the hits. Samples need the hits again, so they are
    checkpointed first, unless they are `stored`; hand in a stored table with `samples=False` where only counts matter.
    `for_merging` adds what is needed to put alerts together: numbers of the first and last hit, arrivals of the samples.
    """
    hits = _null_safe(hits)
    if samples and not stored:
        hits = materialise(hits.select(*HIT_NEEDS, "raw"))
    length = min(max(gap, 1), SLOT) if status_changes is None else 1
    slots = _slots(hits, length)
    local = local_sessions(slots.where(F.col("epoch").isNotNull()), gap, status_changes, length)
    untimed = slots.where(F.col("epoch").isNull()).select(
        *KEY, F.lit(UNTIMED).alias("session"), F.col("n").alias("count"), F.col("first").alias("f"),
        F.col("last").alias("l"))
    numbered = number_sessions(local.groupBy(*KEY, "_chunk", "_local").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")))
    alerts = numbered.groupBy(*KEY, "session").agg(
        F.sum("n").alias("count"), F.min("first").alias("f"), F.max("last").alias("l"))
    alerts = alerts.unionByName(untimed)
    if samples:
        alerts = alerts.join(_samples(hits, local, numbered, max_samples, length),
                             [*KEY, "session"], "left")
    columns = [
        F.xxhash64("rule_name", "_ip", "session").alias("alert_id"),
        F.col("rule_name").alias("title"), F.col("f.rule_id").alias("rule_id"),
        F.col("f.severity").alias("severity"), F.col("f.src_ip").alias("src_ip"),
        F.col("f.dst_ip").alias("dst_ip"), F.col("f.url").alias("url"),
        F.lit("new").alias("status"), "count", F.col("f.epoch").alias("first_seen"),
        F.col("l.epoch").alias("last_seen"), F.col("l.matched_text").alias("last_matched"),
        F.col("l.count").alias("last_count"),
        F.when(F.col("f.category") == "ml", "ml").otherwise("rule").alias("source_type")]
    if samples:
        columns.append(F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
    if for_merging:
        columns += [F.col("f.seq").alias("first_seq"), F.col("l.seq").alias("last_seq"),
                    F.coalesce("said", F.array().cast(alerts.schema["said"].dataType)).alias("said")]
    return alerts.select(*columns)


def with_rule_id(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule ids by rule name (the rule set is configuration and its size is checked on load)."""
    ids = rules.select(F.col("name").alias("title"), F.col("id").alias("_id"))
    return (alerts.join(F.broadcast(ids), "title", "left")
            .withColumn("rule_id", F.coalesce("_id", "rule_id")).drop("_id"))


def apply_status(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """New status for the alerts named in `updates` (alert_id, status); unknown values ignored."""
    valid = updates.where(F.col("status").isin(*ALERT_STATUS)).groupBy("alert_id").agg(
        F.max("status").alias("_new"))
    return (alerts.join(valid, "alert_id", "left")
            .withColumn("status", F.coalesce("_new", "status")).drop("_new")
            .select(*alerts.columns))


def severity_summary(alerts: DataFrame) -> DataFrame:
    severity = F.lower(F.coalesce("severity", F.lit("mid")))
    return alerts.agg(*[F.count_if(severity == s).alias(s) for s in ("high", "mid", "low", "info")],
                      F.count("*").alias("total"))


def tiles(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"),
                      F.count_if(F.col("status") == "new").alias("new"),
                      F.count_if(F.col("severity") == "high").alias("high"))


def search(alerts: DataFrame, *, severity: str = "", status: str = "", src_ip: str = "",
           keyword: str = "", page: int = 1, size: int = 50) -> DataFrame:
    """One page of alerts, newest first."""
    from wardlog.functions.text import contains_ci
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if status:
        alerts = alerts.where(F.col("status") == status)
    if src_ip:
        alerts = alerts.where(contains_ci(F.col("src_ip"), src_ip))
    if keyword:
        alerts = alerts.where(contains_ci(F.col("title"), keyword))
    return (alerts.orderBy(F.desc("last_seen"), F.desc("alert_id"))
            .offset((max(page, 1) - 1) * size).limit(size))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.75, "mid").otherwise("low")


def ml_hits(detections: DataFrame, threshold: float = 0.6, limit: int = 50) -> DataFrame:
    """The highest scores at or above the threshold, as hits ready to be consolidated.

    `detections`: src_ip, epoch, anomaly_score, top_features. `limit` is the report's top-k.
    """
    parts = F.transform(F.slice("top_features", 1, 3), lambda c: F.concat(
        c["feature"], F.when(c["deviation"] > 0, "↑").otherwise("↓"),
        F.round(c["abs_deviation"], 2).cast("string"), F.lit("σ")))
    text = F.when(F.size("top_features") > 0, F.array_join(parts, "、")).otherwise(ML_NO_FEATURES)
    source = F.coalesce("src_ip", F.lit("unknown"))
    score = F.col("anomaly_score")
    return (detections.where(score >= threshold)
            .orderBy(F.desc("anomaly_score"), "src_ip", "epoch").limit(limit)
            .select(
                F.lit(None).cast("int").alias("rule_id"), F.lit(ML_RULE_NAME).alias("rule_name"),
                F.lit("ml").alias("category"), score_band(score).alias("severity"),
                F.col("epoch").alias("seq"), "epoch", source.alias("src_ip"),
                F.lit(None).cast("string").alias("dst_ip"),
                F.lit(None).cast("string").alias("url"),
                F.format_string(ML_EVIDENCE, source, score.cast("string"),
                                timewin.iso(F.col("epoch")), text).alias("raw"),
                F.format_string(ML_MESSAGE, score.cast("string")).alias("matched_text"),
                F.lit(None).cast("bigint").alias("count"),
                F.lit(None).cast("bigint").alias("prior_fails"),
                F.lit(None).cast("int").alias("window_s")))


def alert_context(alerts: DataFrame, events: DataFrame, limit: int = 10) -> DataFrame:
    """Per alert: its samples plus the newest lines of its source, and counts over all its lines."""
    sources = alerts.where(F.col("src_ip").isNotNull()).select("src_ip").distinct()
    newest = Window.partitionBy("src_ip").orderBy(F.desc("seq"))
    recent = (events.join(sources, "src_ip", "left_semi")
              .select("src_ip", "seq", "raw")
              .withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit)
              .groupBy("src_ip")
              .agg(F.array_sort(F.collect_list(F.struct("_rank", F.trim("raw").alias("raw"))))
                   .alias("lines")))
    outcome = F.try_element_at("detail", F.lit("event"))
    counted = events.join(sources, "src_ip", "left_semi").groupBy("src_ip").agg(
        F.count("*").alias("events"), F.count_if(outcome == "failed").alias("failed"),
        F.count_distinct(F.nullif("username", F.lit(""))).alias("users"))
    own = F.filter(F.slice("samples", 1, limit), lambda s: s != "")
    extra = F.filter(F.coalesce(F.col("lines.raw"), F.array().cast("array<string>")),
                     lambda s: s != "")
    return (alerts.join(recent, "src_ip", "left").join(counted, "src_ip", "left")
            .withColumn("context", F.slice(F.array_union(own, extra), 1, limit))
            .select("alert_id", "title", "severity", "src_ip", "url", "count", "first_seen",
                    "last_seen", "context", F.coalesce("events", F.lit(0)).alias("events"),
                    F.coalesce("failed", F.lit(0)).alias("failed"),
                    F.coalesce("users", F.lit(0)).alias("users")))
