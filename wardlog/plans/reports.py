"""Dashboard counters, series, top lists and report contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlog.constants import (BRIEF_COUNT, BRIEF_HEAD, BRIEF_SOURCE, BRIEF_TARGET,
                               REPORT_TARGET, SEVERITY_LABELS, SEVERITY_RANK, SUMMARY_LINE,
                               SUMMARY_NONE)
from wardlog.functions import timewin
from wardlog.functions.text import contains_ci, label_of

LOWEST = 9


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(severity, F.lit(""))), F.lit(LOWEST))


def search_events(events: DataFrame, *, log_type: str = "", src_ip: str = "", keyword: str = "",
                  date_from: str = "", date_to: str = "", page: int = 1, size: int = 100
                  ) -> DataFrame:
    """One page of events, newest first, under the filters that are given."""
    if log_type:
        events = events.where(F.col("log_type") == log_type)
    if src_ip:
        events = events.where(contains_ci(F.col("src_ip"), src_ip))
    if keyword:
        test = F.lit(False)
        for name in ("url", "raw", "user_agent", "username"):
            test = test | contains_ci(F.col(name), keyword)
        events = events.where(test)
    if date_from:
        events = events.where(F.col("ts") >= F.lit(f"{date_from} 00:00:00").cast("timestamp_ntz"))
    if date_to:
        events = events.where(F.col("ts") <= F.lit(f"{date_to} 23:59:59").cast("timestamp_ntz"))
    return events.orderBy(F.desc("seq")).offset((max(page, 1) - 1) * size).limit(size)


def training_events(events: DataFrame, as_of: Column, hours: int = 24, limit: int | None = None
                    ) -> DataFrame:
    """Events of the last `hours` (0: all); oldest first only when a limit is asked for."""
    if hours > 0:
        events = events.where(F.col("ts") >= timewin.days_before(as_of, hours / 24))
    return events.orderBy("ts", "seq").limit(limit) if limit else events


def overview(events: DataFrame, sources: DataFrame, alerts: DataFrame, as_of: Column) -> DataFrame:
    """One row of counters; three aggregates of one row each, put side by side."""
    from wardlog.operators.statistics import attach
    of_events = events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("ts") >= timewin.day_start(as_of)).alias("today_events"))
    of_sources = sources.agg(F.count("*").alias("sources"),
                             F.count_if(F.col("status") == "running").alias("active_sources"))
    of_alerts = alerts.agg(
        F.count("*").alias("total_alerts"), F.count_if(F.col("status") == "new")
        .alias("new_alerts"), F.count_if(F.col("severity") == "high").alias("high_alerts"))
    return attach(attach(of_events, of_sources), of_alerts)


def hourly_series(alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Alerts per hour of first sight, the last `hours` hours, empty hours included."""
    end = timewin.floor_to(timewin.epoch_of(as_of), 3600)
    spine = alerts.sparkSession.range(hours).select(
        (end - (F.lit(hours - 1) - F.col("id")) * 3600).alias("hour"))
    seen = F.coalesce("first_seen", "last_seen")
    counts = (alerts.where((seen >= end - (hours - 1) * 3600) & (seen < end + 3600))
              .groupBy(timewin.floor_to(seen, 3600).alias("hour")).agg(F.count("*").alias("n")))
    return spine.join(counts, "hour", "left").select(
        "hour", F.date_format(timewin.ts_of(F.col("hour")), "MM-dd HH:00").alias("label"),
        F.coalesce("n", F.lit(0)).alias("count"))


def top_sources(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return (alerts.where(F.col("src_ip").isNotNull()).groupBy("src_ip")
            .agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "src_ip").limit(limit))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def weighted_sources(alerts: DataFrame) -> DataFrame:
    """Source addresses weighted by how many hits their alerts merged."""
    return alerts.where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(
        F.greatest(F.coalesce(F.sum("count"), F.lit(1)), F.lit(1)).alias("weight"))


def posture(alerts: DataFrame, findings: DataFrame, exploited: DataFrame, detections: DataFrame,
            threshold: float = 0.6) -> DataFrame:
    from wardlog.operators.statistics import attach
    of_alerts = alerts.agg(
        F.count("*").alias("alerts"), F.count_if(F.col("status") == "new").alias("new_alerts"),
        F.count_distinct("src_ip").alias("attack_ips"))
    row = attach(of_alerts, findings.agg(F.count("*").alias("scan_findings")))
    row = attach(row, exploited.agg(F.count("*").alias("exploited")))
    return attach(row, detections.agg(
        F.count_if(F.col("anomaly_score") >= threshold).alias("ml_anomalies")))


def daily_counts(alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Counts over alerts seen in the last `hours`."""
    recent = _recent(alerts, as_of, hours)
    severity = F.coalesce("severity", F.lit("info"))
    return recent.agg(
        F.count("*").alias("alerts"),
        *[F.count_if(severity == s).alias(s) for s in ("critical", "high", "mid", "low")],
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_distinct(F.nullif("src_ip", F.lit(""))).alias("source_ips"))


def _recent(alerts: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return alerts.where(F.col("last_seen") >= timewin.epoch_of(as_of) - hours * 3600)


def daily_rules(alerts: DataFrame, as_of: Column, hours: int = 24, limit: int = 10) -> DataFrame:
    return (_recent(alerts, as_of, hours).groupBy("title").agg(F.count("*").alias("alerts"))
            .orderBy(F.desc("alerts"), "title").limit(limit))


def daily_samples(alerts: DataFrame, as_of: Column, hours: int = 24, limit: int = 8) -> DataFrame:
    """The latest alerts, one line each."""
    latest = _recent(alerts, as_of, hours).orderBy(
        F.desc("last_seen"), "title", "src_ip", "first_seen").limit(limit)
    def part(test: Column, form: str, value: Column) -> Column:
        return F.when(test, F.format_string(form, value)).otherwise("")

    line = F.concat(
        F.format_string(BRIEF_HEAD, "severity", "title"),
        part(F.coalesce("src_ip", F.lit("")) != "", BRIEF_SOURCE, F.col("src_ip")),
        part(F.coalesce("url", F.lit("")) != "", BRIEF_TARGET, F.substring("url", 1, 80)),
        part(F.col("count") > 1, BRIEF_COUNT, F.col("count")))
    return latest.select("last_seen", line.alias("line"))


def findings_summary(findings: DataFrame, *keys: str) -> DataFrame:
    """total, by_severity and by_type maps, both from one grouping-sets pass."""
    sets = findings.withColumn("_d", F.explode(F.array(
        F.struct(F.lit("severity").alias("d"), F.col("severity").alias("v")),
        F.struct(F.lit("type").alias("d"), F.col("vuln_type").alias("v")))))
    counts = sets.groupBy(*keys, "_d.d", "_d.v").agg(F.count("*").alias("n"))

    def as_map(which):
        return F.map_from_entries(F.array_sort(F.collect_list(
            F.when((F.col("d") == which) & F.col("v").isNotNull(), F.struct("v", "n")))))

    return counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("d") == "type", F.col("n")).otherwise(0)).alias("total"),
        as_map("severity").alias("by_severity"), as_map("type").alias("by_type"))


def by_severity_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "finding_id")


def risk_of(findings: DataFrame, *keys: str) -> DataFrame:
    """The worst severity present; `info` where none of the known ones is."""
    known = F.col("severity").isin(*SEVERITY_RANK)
    return findings.groupBy(*keys).agg(F.coalesce(
        F.min_by(F.when(known, F.col("severity")), severity_rank(F.col("severity"))),
        F.lit("info")).alias("risk"))


def summary_line(findings: DataFrame, *keys: str) -> DataFrame:
    """One sentence per key: how many of each severity, and the risk."""
    labels = label_of(SEVERITY_LABELS, F.col("severity"), "")
    name = F.when(labels == "", F.col("severity")).otherwise(labels)
    counts = findings.groupBy(*keys, "severity").agg(F.count("*").alias("n"))
    part = F.struct(severity_rank(F.col("severity")).alias("rank"),
                    F.concat(name, F.lit(" "), F.col("n").cast("string")).alias("text"),
                    F.col("severity").alias("severity"))
    per_key = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(part)).alias("parts"))
    worst = F.get("parts", F.lit(0))
    risk = F.when(worst["rank"] < LOWEST, worst["severity"]).otherwise("info")
    sentence = F.when(F.col("total").isNotNull(), F.format_string(
        SUMMARY_LINE, "total", F.array_join(F.col("parts.text"), "、"),
        label_of(SEVERITY_LABELS, risk, SEVERITY_LABELS["info"])))
    return per_key.select(*keys, F.coalesce("total", F.lit(0)).alias("total"),
                          F.coalesce(sentence, F.lit(SUMMARY_NONE)).alias("line"))


def scan_report_context(tasks: DataFrame, targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Per task: its target, totals by severity and type.

    The finding rows themselves stay a table (`by_severity_order` of the task's findings) and are
    not packed into one row.
    """
    totals = findings_summary(findings, "task_id")
    name = F.coalesce("name", F.lit(""))
    url = F.coalesce("url", F.lit(""))
    return (tasks.join(targets, "target_id", "left").join(totals, "task_id", "left")
            .select("task_id", F.format_string(REPORT_TARGET, name, url).alias("target"),
                    F.coalesce("total", F.lit(0)).alias("findings"),
                    *[F.coalesce(F.try_element_at("by_severity", F.lit(s)), F.lit(0)).alias(s)
                      for s in ("critical", "high", "mid", "low")], "by_type"))


def stratified_cases(alerts: DataFrame, limit: int, id_column: str = "alert_id") -> DataFrame:
    """Cases for review: newest per severity, at most two of one title, `limit` in all."""
    per_severity = max(2, (limit + 3) // 4) * 4
    order = ("critical", "high", "mid", "low")
    newest = Window.partitionBy("severity").orderBy(F.desc(id_column))
    drawn = (alerts.where(F.col("severity").isin(*order))
             .withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= per_severity))
    rank = severity_rank(F.col("severity"))
    of_title = Window.partitionBy("title").orderBy(rank, "_r")
    return (drawn.withColumn("_t", F.row_number().over(of_title)).where(F.col("_t") <= 2)
            .orderBy(rank, "_r").limit(limit).drop("_r", "_t"))


def latest_per(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The newest record of each key, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_x")).select(
        *keys, *[f"_x.{c}" for c in rest])


def probe_status_summary(paths: DataFrame) -> DataFrame:
    """Counts over stored directory-probe responses (`status`)."""
    status = F.col("status")
    return paths.agg(F.count_if(status == 200).alias("accessible"),
                     F.count_if(status == 403).alias("forbidden"),
                     F.count_if(status.isin(301, 302)).alias("redirect"),
                     F.count("*").alias("total"))


def baseline_sources(alerts: DataFrame, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """Sources with a rule alert in range (ML alerts do not count)."""
    known = alerts.where(F.coalesce("source_type", F.lit("rule")) == "rule")
    if as_of is not None and hours > 0:
        known = known.where(F.col("last_seen") >= timewin.epoch_of(
            timewin.days_before(as_of, hours / 24)))
    return known.where(F.col("src_ip") != "").select("src_ip").distinct()


def labelled(records: DataFrame, sources: DataFrame) -> DataFrame:
    """`y` = 1 where the source of a record is among the given ones."""
    return records.join(sources.withColumn("_hit", F.lit(1)), "src_ip", "left").withColumn(
        "y", F.coalesce("_hit", F.lit(0))).drop("_hit")


def baseline_labels(records: DataFrame, alerts: DataFrame, as_of: Column | None = None,
                    hours: int = 24) -> DataFrame:
    """`y` = 1 where the source has a rule alert in range (ML alerts do not count)."""
    return labelled(records, baseline_sources(alerts, as_of, hours))
