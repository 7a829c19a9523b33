"""Batch import: lines to events, detection, alerts, with run counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from wardlog import schema
from wardlog.constants import MAX_SAMPLES, MERGE_GAP_SECONDS
from wardlog.operators.alerts import with_rule_id
from wardlog.plans.upkeep import STORED_ALERT, current, refreshed, updated_alerts
from wardlog.session import materialise, step
from wardlog.sources import logs, tables
from wardlog.sources.commits import DAY, UNTIMED, CommitLog, Folder, Record, day_of, days_between
from wardlog.sources.rules import Rule, rules_frame

REJECTED = "rejected"   # the day of lines that are no events
LARGEST = 1 << 61       # arrival numbers of all runs of a source stay below it
TABLES = {"events": schema.EVENT + ", ts_fallback BOOLEAN", "hits": schema.HIT + ", live BOOLEAN, known BOOLEAN"}
PUBLISHED = [c.split()[0] for c in STORED_ALERT.split("first_seq")[0].split(", ") if c]


@dataclass
class ImportResult:
    parsed: int
    rejected: int
    matched: int
    alerts: int


def log_of(spark: SparkSession, out: str, source_id: int) -> CommitLog:
    return CommitLog(spark, f"{out}/sources/{source_id}", TABLES)


def _numbered(events: DataFrame, record: Record, days=None) -> DataFrame:
    """Arrival numbers of all runs of a source in one sequence: those of a run begin at its base."""
    bases = {r["commit"]: r["base"] for r in record.runs.values()}
    if not bases:
        return events
    base = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair])
    return events.withColumn("seq", F.col("seq") + F.try_element_at(base, F.col("commit")))


def import_lines(lines: DataFrame, rules: list[Rule], out: str, *, year: int | Column,
                 source_id: int = 0, run: int | str = 0, source_type: str = "auto",
                 now: Column | None = None, gap: int = MERGE_GAP_SECONDS) -> ImportResult:
    """`lines` has `seq` and `value`. Writes events, rejected lines, hits and alerts of a source under `out`.

    `run` names what is imported (a file, a day: any number or text). Importing it again replaces its events. A run
    reads its own events and the stored ones around their times, and changes the hits and alerts that these
    reach (see `upkeep`). Two runs give what one run of both gives, but for status, alerts that were closed in
    between, and samples that the earlier run had pushed out; a run that is repeated changes nothing. Alerts whose
    status in `{out}/alerts` is not open any more keep their hits and take up no others. The counts of matched events and
    alerts are what the run added.

    Arrival numbers of runs do not clash: a run begins behind the largest number of those before it. They may be sparse;
    their sum over all runs stays below 2**61. Events are written once and read back, so text is parsed a
    single time. A run takes effect with its record; one that is interrupted before can be repeated. Lines whose time
    cannot be read get `now`, if it is given; otherwise they have alerts of their own.
    """
    spark = lines.sparkSession
    log, run = log_of(spark, out, source_id), str(run)
    before = log.record()
    commit, old = before.commit + 1, before.runs.get(run)
    seen = Observation("import")
    parsed = logs.parse(lines, source_type, year=year, now=now, keep=("seq",)).observe(
        seen, F.count_if(F.col("log_type").isNotNull()).alias("parsed"),
        F.count_if(F.col("log_type").isNull() & (F.col("raw") != "")).alias("rejected"),
        F.min("seq").alias("least"), F.max("seq").alias("most"))
    # one pass over the text: rejected lines land in folders of their own
    rows = parsed.where(F.col("raw") != "")
    day = F.when(F.col("log_type").isNull(), REJECTED).otherwise(day_of(F.col("epoch")))
    with step(spark):
        folders = log.write("events", rows, commit, day=day)
    counts = seen.get
    record = Record(commit, None, {t: {h: list(f) for h, f in before.files.get(t, {}).items()} for t in TABLES},
                    dict(before.runs))
    if old:     # the folders of the replaced run no longer count
        record.files["events"] = {h: left for h, found in record.files["events"].items()
                                  if (left := [f for f in found if f[0] != old["commit"]])}
        record.garbage.append(f"events/commit={old['commit']}")
    for h, found in folders.items():
        record.files["events"].setdefault(h, []).extend(found)
    record.runs[run] = _range_of(record.runs, old, counts["least"], counts["most"], commit)

    def touched(of: Record, number: int | None) -> set[str]:
        return {h for h, found in of.files.get("events", {}).items() if h != REJECTED and any(f[0] == number for f in found)}

    gone = touched(before, old["commit"]) if old else set()
    fresh = touched(record, commit)
    added = _numbered(log.read("events", record, fresh, {commit}), record)
    changed = added if not old else added.unionByName(
        _numbered(log.read("events", before, gone, {old["commit"]}), before))
    timed = sorted(int(h) for h in fresh | gone if h != UNTIMED)
    with_untimed = lambda days, untimed: [*days, *([UNTIMED] if untimed else [])]
    stored = lambda days, untimed=False: current(log.read("hits", before, with_untimed(days, untimed)))
    replaced = F.col("seq").between(old["base"] + old["least"], old["base"] + old["most"]) if old else None
    known = [int(h) for h in before.files.get("events", {}) if h not in (UNTIMED, REJECTED)]
    stored_before = None if old else F.lit(False) if not known else (     # a run begins behind all numbers before it
        (F.col("seq") < record.runs[run]["base"] + record.runs[run]["least"])
        & F.col("epoch").between(min(known) * DAY, (max(known) + 1) * DAY - 1))
    with step(spark):
        changes = refreshed(
            changed, added, timed, rules, lambda days: _numbered(log.read("events", record, days), record), stored,
            [int(h) for h in record.files["events"] if h not in (UNTIMED, REJECTED)], replaced, stored_before)
        for day, found in log.write("hits", changes, commit).items():
            record.files["hits"].setdefault(day, []).extend(found)
    with step(spark):
        alerts = _alerts_after(log, before, record, rules, out, source_id, gap)
    log.finish(record, before, compact=False)
    with step(spark):
        result = _publish(log, record, before, alerts, out, source_id, counts)
    spark.createDataFrame(
        [(source_id, run, result.parsed, result.rejected, result.matched, result.alerts)],
        "source_id INT, run STRING, processed BIGINT, rejected BIGINT, matched BIGINT, alerts BIGINT"
    ).write.mode("append").parquet(f"{out}/runs")
    return result


def _range_of(runs: dict[str, dict], old: dict | None, least: int | None, most: int | None, commit: int) -> dict:
    """Where a run's arrival numbers lie. Imported again, it keeps its place if its numbers fit in it."""
    least, most = least or 0, most or 0
    if old and old["least"] <= least and most <= old["most"]:
        return {**old, "commit": commit}
    top = max([r["base"] + r["most"] + 1 for r in runs.values()], default=0)
    base = top - least if runs else 0
    if not -LARGEST < base + least <= base + most < LARGEST:
        raise ValueError("arrival numbers of the source are used up; give lines denser numbers")
    return {"commit": commit, "base": base, "least": least, "most": most}


def _alerts_after(log: CommitLog, before: Record, record: Record, rules: list[Rule], out: str, source_id: int,
                  gap: int) -> DataFrame:
    """The alerts of a commit, written to its folder; status is what readers have made of it."""
    spark, folder = log.spark, f"alerts/commit={record.commit}"
    stored = tables.read_or_empty(spark, f"{log.root}/alerts/commit={before.commit}", STORED_ALERT)
    status = tables.read_or_empty(spark, f"{out}/alerts", "alert_id BIGINT, status STRING, source_id INT").where(
        F.col("source_id") == source_id).select("alert_id", F.col("status").alias("_status"))
    stored = stored.join(status, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).select(*stored.columns)
    changes = log.read("hits", record, None, {record.commit})

    def hits(spans: DataFrame) -> DataFrame:
        ends = spans.agg(F.min("_a"), F.max("_b")).first()
        reach = [str(h) for h in (days_between(*ends) if ends[0] is not None else ())]
        return current(log.read("hits", record, [h for h in record.files["hits"] if h in set(reach) or h == UNTIMED]))

    made = updated_alerts(stored, changes, hits, record.commit, gap, MAX_SAMPLES)
    named = with_rule_id(made, rules_frame(spark, rules)).select(*stored.columns)
    named.write.mode("overwrite").parquet(f"{log.root}/{folder}")
    record.garbage.append(f"alerts/commit={before.commit}")
    return spark.read.schema(STORED_ALERT).parquet(f"{log.root}/{folder}")


def _publish(log: CommitLog, record: Record, before: Record, alerts: DataFrame, out: str, source_id: int, counts: dict) -> ImportResult:
    total = Observation("alerts")
    shown = alerts.select(*PUBLISHED).withColumn("source_id", F.lit(source_id)).observe(
        total, F.count("*").alias("alerts"), F.coalesce(F.sum("count"), F.lit(0)).alias("matched"))
    tables.replace_partition(shown, f"{out}/alerts", "source_id")
    known = tables.read_or_empty(log.spark, f"{log.root}/alerts/commit={before.commit}", STORED_ALERT).agg(
        F.count("*").alias("alerts"), F.coalesce(F.sum("count"), F.lit(0)).alias("matched")).first()
    after = total.get
    return ImportResult(counts["parsed"], counts["rejected"], after["matched"] - known["matched"],
                        after["alerts"] - known["alerts"])


def stored_events(spark: SparkSession, out: str, source_id: int = 0) -> DataFrame:
    log = log_of(spark, out, source_id)
    record = log.record()
    return _numbered(log.read("events", record, [h for h in record.files.get("events", {}) if h != REJECTED]), record)


def stored_hits(spark: SparkSession, out: str, source_id: int = 0) -> DataFrame:
    log = log_of(spark, out, source_id)
    return current(log.read("hits", log.record()))


def set_status(spark: SparkSession, out: str, updates: DataFrame) -> None:
    """New status of alerts (alert_id, status), of whatever sources."""
    from wardlog.operators.alerts import apply_status
    shown = tables.read(spark, f"{out}/alerts")
    with step(spark):
        tables.replace_partition(materialise(apply_status(shown, updates)), f"{out}/alerts", "source_id")


def rejected_lines(spark: SparkSession, out: str) -> DataFrame:
    """(source_id, seq, raw) of all sources."""
    parts = []
    for source in Folder(spark, f"{out}/sources").names():
        log = log_of(spark, out, int(source))
        parts.append(log.read("events", log.record(), [REJECTED]).select(F.lit(int(source)).alias("source_id"), "seq", "raw"))
    found = spark.createDataFrame([], "source_id INT, seq BIGINT, raw STRING")
    for part in parts:
        found = found.unionByName(part)
    return found
