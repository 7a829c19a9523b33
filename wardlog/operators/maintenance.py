"""Retention and cascading deletes, as what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlog.functions import timewin

DEFAULT_DAYS = 30


def retention_days(setting: str | None) -> int:
    """Configured days; 30 where nothing valid is configured."""
    try:
        return int(setting) if setting else DEFAULT_DAYS
    except ValueError:
        return DEFAULT_DAYS


def retained(events: DataFrame, as_of: Column, setting: str | None = None) -> DataFrame:
    """Events that stay: those not older than the cut-off, and those whose time is not known.

    On a table partitioned by `event_date` whole partitions are skipped.
    """
    cutoff = timewin.days_before(as_of, retention_days(setting))
    kept, untimed = events.where(F.col("ts") >= cutoff), events.where(F.col("ts").isNull())
    if "event_date" in events.columns:
        kept = kept.where(F.col("event_date") >= cutoff.cast("date"))
        untimed = untimed.where(F.col("event_date").isNull())
    return kept.unionByName(untimed)


def drop_target(target_ids: DataFrame, targets: DataFrame, tasks: DataFrame, findings: DataFrame,
                info: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the given targets; a target with a running task stays."""
    busy = tasks.where("status = 'running'").select("target_id")
    gone = target_ids.select("target_id").distinct().join(busy, "target_id", "left_anti")
    gone_tasks = tasks.join(gone, "target_id", "left_semi").select("task_id")
    return {
        "targets": targets.join(gone, "target_id", "left_anti"),
        "tasks": tasks.join(gone, "target_id", "left_anti"),
        "findings": findings.join(gone_tasks, "task_id", "left_anti"),
        "info": info.join(gone_tasks, "task_id", "left_anti"),
    }
