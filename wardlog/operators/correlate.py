"""Findings of a web scan against attack events and alerts: path prefix, class, recent window.

Findings are reduced to their distinct (path, class). Events are first reduced to those carrying
an attack class, then to one row per class and candidate prefix, where the candidate prefixes are
the lengths that occur among the findings' paths; what is left is an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlog.constants import FINDING_CLASS, SIGNATURE_LABELS
from wardlog.functions import timewin
from wardlog.functions.signatures import explode_classes
from wardlog.functions.text import label_of, url_host, url_path
from wardlog.operators.statistics import attach

CLASSES = tuple(dict.fromkeys(c for c in FINDING_CLASS.values() if c))


def class_of(vuln_type: Column) -> Column:
    """Signature class of a finding type; NULL where logs cannot show it."""
    known = {k: v for k, v in FINDING_CLASS.items() if v}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.coalesce(vuln_type, F.lit(""))))


def is_correlatable(vuln_type: Column) -> Column:
    return class_of(vuln_type).isNotNull()


def attack_label(vuln_type: Column) -> Column:
    return label_of(SIGNATURE_LABELS, class_of(vuln_type), "—")


def targets(findings: DataFrame) -> DataFrame:
    """Findings with `path` (as compared) and `class`; those that cannot correlate are left out."""
    return (findings.withColumn("path", url_path(F.col("url")))
            .withColumn("class", class_of(F.col("vuln_type")))
            .where(F.col("class").isNotNull() & (F.col("path") != ""))
            .withColumn("_prefix", F.lower("path")))


def _match(findings: DataFrame, rows: DataFrame, mode: str) -> DataFrame:
    """rows x distinct (path, class), matched on class and path; `rows` has `url`."""
    wanted = targets(findings).select("_prefix", "class").distinct()
    classed = explode_classes(rows, F.col("url"), "class", CLASSES)
    if mode == "exact":
        keyed = classed.withColumn("_prefix", F.lower(url_path(F.col("url"))))
        return keyed.join(wanted, ["_prefix", "class"])
    lengths = wanted.agg(F.collect_set(F.length("_prefix")).alias("_sizes"))   # one row
    keyed = (attach(classed, lengths).withColumn("_size", F.explode(F.filter(
        "_sizes", lambda n: n <= F.length("url"))))
        .withColumn("_prefix", F.lower(F.substring(F.col("url"), F.lit(1), F.col("_size"))))
        .drop("_size", "_sizes"))
    return keyed.join(wanted, ["_prefix", "class"])


def _newest(matched: DataFrame, order: list[Column], limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_prefix", "class").orderBy(*order))
    return matched.withColumn("rank", rank).where(F.col("rank") <= limit)


def _recent_events(events: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return (events.where((F.col("log_type") == "web")
                         & (F.col("epoch") >= timewin.epoch_of(as_of) - hours * 3600))
            .select("seq", "epoch", "src_ip", "method", "url", "status_code"))


def _recent_alerts(alerts: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return (alerts.where(F.col("url").isNotNull()
                         & (F.col("last_seen") >= timewin.epoch_of(as_of) - hours * 3600))
            .select("alert_id", "title", "severity", "src_ip", "count", "first_seen",
                    "last_seen", "status", "url"))


def _per_finding(findings: DataFrame, by_target: DataFrame) -> DataFrame:
    return targets(findings).select("finding_id", "_prefix", "class").join(
        by_target, ["_prefix", "class"]).drop("_prefix", "class")


def event_counts(findings: DataFrame, events: DataFrame, as_of: Column, hours: int = 24,
                 mode: str = "prefix", sources: int = 5) -> DataFrame:
    """Per finding the number of its attack events and its first `sources` sources.

    Events are counted per path, class and source before anything is joined to findings.
    """
    counted = _match(findings, _recent_events(events, as_of, hours), mode).groupBy(
        "_prefix", "class", "src_ip").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("_prefix", "class").orderBy("src_ip"))
    first = (counted.where(F.col("src_ip") != "").withColumn("rank", rank)
             .where(F.col("rank") <= sources).groupBy("_prefix", "class")
             .agg(F.array_sort(F.collect_list("src_ip")).alias("sources")))
    totals = counted.groupBy("_prefix", "class").agg(F.sum("n").alias("events"))
    return _per_finding(findings, totals.join(first, ["_prefix", "class"], "left"))


def alert_counts(findings: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 24,
                 mode: str = "prefix") -> DataFrame:
    """Per finding the number of its alerts."""
    return _per_finding(findings, _match(findings, _recent_alerts(alerts, as_of, hours), mode)
                        .groupBy("_prefix", "class").agg(F.count("*").alias("alerts")))


def related_events(findings: DataFrame, events: DataFrame, as_of: Column, hours: int = 24,
                   limit: int = 8, mode: str = "prefix") -> DataFrame:
    """Newest attack events per finding (all of them are examined, `limit` are reported)."""
    recent = _recent_events(events, as_of, hours)
    top = _newest(_match(findings, recent, mode), [F.desc("epoch"), F.desc("seq")], limit)
    own = targets(findings).select("finding_id", "_prefix", "class")
    return own.join(top, ["_prefix", "class"]).drop("_prefix")


def related_alerts(findings: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 24,
                   limit: int = 8, mode: str = "prefix") -> DataFrame:
    recent = _recent_alerts(alerts, as_of, hours)
    order = [F.desc("last_seen"), F.asc("title"), F.asc("src_ip"), F.asc("alert_id")]
    top = _newest(_match(findings, recent, mode), order, limit)
    own = targets(findings).select("finding_id", "_prefix", "class")
    return own.join(top, ["_prefix", "class"]).drop("_prefix")


def findings_for_urls(urls: DataFrame, findings: DataFrame, limit: int = 5) -> DataFrame:
    """For each row of `urls` (which has `url`), the newest findings on exactly the same path."""
    newest = Window.partitionBy("path").orderBy(F.desc("finding_id"))
    known = (findings.withColumn("path", url_path(F.col("url"))).where(F.col("path") != "")
             .withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)
             .select("path", "rank", "finding_id", "vuln_type",
                     F.col("severity").alias("finding_severity"),
                     F.col("url").alias("finding_url"), "param", "task_id",
                     attack_label(F.col("vuln_type")).alias("attack_label")))
    return urls.withColumn("path", url_path(F.col("url"))).join(known, "path")


def closure(findings: DataFrame, events: DataFrame, alerts: DataFrame, as_of: Column,
            hours: int = 24, mode: str = "prefix") -> DataFrame:
    """Per finding: can it correlate, related events and alerts, sources, is it being exploited.

    Counts are of everything that matches; the newest five URLs are a sample.
    """
    newest = related_events(findings, events, as_of, hours, limit=5, mode=mode).groupBy(
        "finding_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("_sample"))
    none = F.array().cast("array<string>")
    return (findings.join(event_counts(findings, events, as_of, hours, mode), "finding_id", "left")
            .join(newest, "finding_id", "left")
            .join(alert_counts(findings, alerts, as_of, hours, mode), "finding_id", "left")
            .select("finding_id", "task_id", "vuln_type",
                    is_correlatable(F.col("vuln_type")).alias("correlatable"),
                    class_of(F.col("vuln_type")).alias("pattern"),
                    attack_label(F.col("vuln_type")).alias("label"),
                    F.coalesce("events", F.lit(0)).alias("events"),
                    F.coalesce("alerts", F.lit(0)).alias("alerts"),
                    F.coalesce("sources", none).alias("sources"),
                    F.coalesce(F.col("_sample.url"), none).alias("sample"),
                    (F.col("events").isNotNull() | F.col("alerts").isNotNull()).alias("closed")))


def closure_totals(summaries: DataFrame, *keys: str) -> DataFrame:
    return summaries.groupBy(*keys).agg(
        F.count("*").alias("findings"), F.count_if("correlatable").alias("correlatable"),
        F.count_if(F.col("correlatable") & F.col("closed")).alias("exploited"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"))


def exploited(findings: DataFrame, events: DataFrame, as_of: Column, hours: int = 24,
              mode: str = "prefix") -> DataFrame:
    """Findings with at least one matching attack event."""
    recent = (events.where((F.col("log_type") == "web")
                           & (F.col("epoch") >= timewin.epoch_of(as_of) - hours * 3600))
              .select("url").distinct())
    hit = _match(findings, recent, mode).select("_prefix", "class").distinct()
    return targets(findings).join(hit, ["_prefix", "class"], "left_semi").drop(
        "_prefix", "path", "class")


def task_bundle(tasks: DataFrame, target_rows: DataFrame, findings: DataFrame,
                info: DataFrame) -> DataFrame:
    """Task with its target, number of findings and the info documents by kind.

    Findings and documents belong to one scan task each, so both are combined per task.
    """
    found = findings.groupBy("task_id").agg(F.count("*").alias("findings"))
    kinds = info.groupBy("task_id", "kind").agg(F.max("content").alias("content")).groupBy(
        "task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("kind", "content")))).alias("info"))
    return (tasks.join(target_rows.select("target_id", F.col("name").alias("target_name"),
                                          F.col("url").alias("target_url")), "target_id", "left")
            .join(found, "task_id", "left").join(kinds, "task_id", "left")
            .withColumn("findings", F.coalesce("findings", F.lit(0))))


def unreported_tasks(tasks: DataFrame, reports: DataFrame, limit: int = 10) -> DataFrame:
    """The newest finished tasks that have no report yet."""
    open_tasks = tasks.where("status = 'done'").join(
        reports.select("task_id").distinct(), "task_id", "left_anti")
    return open_tasks.orderBy(F.desc("task_id")).limit(limit)


def allowed_hosts(rows: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is on the allow list (`hosts.host`)."""
    allow = hosts.select(F.lower("host").alias("_host")).distinct()
    return (rows.withColumn("_host", url_host(F.col(url)))
            .join(allow, "_host", "left_semi").drop("_host"))
