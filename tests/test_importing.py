"""The import job: runs that meet stored events, hits and alerts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from test_streaming import LINE_RULES, probe, said, shuffled_lines
from wardlog.operators.alerts import consolidate
from wardlog.plans import importing, upkeep
from wardlog.plans.detection import detect
from wardlog.session import materialise
from wardlog.sources.commits import Folder
from wardlog.sources.rules import Rule

ONE = [Rule(1, "probe", "regex", "scan_event", "any")]
LINES = "seq BIGINT, value STRING"


def run(spark, out, rows, name, rules=ONE, **more):
    return importing.import_lines(spark.createDataFrame(rows, LINES), rules, str(out), year=2024, run=name, **more)


def alerts(spark, out):
    rows = spark.read.parquet(f"{out}/alerts").collect()
    return sorted((r.status, r["count"], str(r.first_seen)[-4:], len(r.samples)) for r in rows)


def test_closed_alerts_stay_closed_and_absorb_nothing(spark, tmp_path):
    first = run(spark, tmp_path, [probe(0, "10:00:00"), probe(1, "10:00:30")], "a")
    assert (first.alerts, first.matched) == (1, 2)
    one = spark.read.parquet(f"{tmp_path}/alerts").first()
    importing.set_status(spark, str(tmp_path), spark.createDataFrame([(one.alert_id, "closed")], "alert_id bigint, status string"))
    second = run(spark, tmp_path, [probe(0, "10:01:00"), probe(1, "10:00:10")], "b")
    assert (second.alerts, second.matched) == (1, 2)
    rows = {r.status: r for r in spark.read.parquet(f"{tmp_path}/alerts").collect()}
    assert rows["closed"].alert_id == one.alert_id and rows["closed"]["count"] == 2
    assert (rows["new"]["count"], rows["new"].last_seen - rows["new"].first_seen) == (2, 50)
    # an open one keeps its number and status, and goes on
    importing.set_status(spark, str(tmp_path), spark.createDataFrame([(rows["new"].alert_id, "confirmed")], "alert_id bigint, status string"))
    third = run(spark, tmp_path, [probe(0, "10:05:00")], "c")
    again = {r.status: r for r in spark.read.parquet(f"{tmp_path}/alerts").collect()}
    assert (third.alerts, third.matched) == (0, 1) and set(again) == {"closed", "confirmed"}
    assert again["confirmed"].alert_id == rows["new"].alert_id and again["confirmed"]["count"] == 3
    # the same run once more changes nothing, also not where its alert is closed
    assert (repeat := run(spark, tmp_path, [probe(0, "10:00:00"), probe(1, "10:00:30")], "a")).matched == repeat.alerts == 0
    # and a run that has fewer lines now takes back what its lost lines said
    shorter = run(spark, tmp_path, [probe(1, "10:00:10")], "b")
    assert shorter.matched == -1
    last = {r.status: r for r in spark.read.parquet(f"{tmp_path}/alerts").collect()}
    assert last["closed"]["count"] == 2 and last["confirmed"]["count"] == 2 and last["confirmed"].alert_id == rows["new"].alert_id


def test_any_run_names_and_numbers(spark, tmp_path):
    far = (1 << 52) + 5          # sparse numbers, as those of many splits are
    run(spark, tmp_path, [probe(0, "10:00:00"), probe(far, "10:00:00")], 20241010)
    run(spark, tmp_path, [probe(0, "10:00:00"), probe(far, "10:00:00")], -7)
    run(spark, tmp_path, [probe(5, "10:00:00"), (6, "noise"), (7, "2024-13-45T00:00:00,9.9.9.9,2.2.2.2,22,tcp,open")], "Monday's file")
    events = importing.stored_events(spark, str(tmp_path))
    assert events.select("seq").distinct().count() == events.count() == 6
    shown = spark.read.parquet(f"{tmp_path}/alerts").collect()
    assert sorted((r["count"], r.first_seen is None) for r in shown) == [(1, True), (5, False)]
    assert [r.raw for r in importing.rejected_lines(spark, str(tmp_path)).collect()] == ["noise"]
    with pytest.raises(ValueError):
        run(spark, tmp_path, [probe(0, "10:00:00"), probe(1 << 61, "10:00:00")], "too far")
    assert importing.stored_events(spark, str(tmp_path)).count() == 6


def test_a_run_reads_what_is_near(spark, tmp_path):
    run(spark, tmp_path, [probe(i, "10:00:00", f"2024-01-{i + 1:02}") for i in range(20)], "past")
    from wardlog.sources.commits import CommitLog
    read, original = [], CommitLog.read
    try:
        CommitLog.read = lambda self, table, record, days=None, commits=None: (
            read.append((table, days if days is None else sorted(map(str, days)), commits)), original(self, table, record, days, commits))[1]
        count = [Rule(2, "count", "aggregate", "scan_event", threshold=1, time_window=3600, count_mode="count")]
        run(spark, tmp_path, [probe(0, "10:00:00", "2024-02-01")], "now", count)
    finally:
        CommitLog.read = original
    days = {d for table, found, commits in read if commits is None for d in found or ["all"]}
    assert days and days <= {"19753", "19754", "19755", "untimed"}      # 2024-02-01 is day 19754


@pytest.mark.parametrize("seed", [1])
def test_runs_in_any_order_give_what_one_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = shuffled_lines(rng, 120)
    rng.shuffle(lines)
    for i in range(3):
        run(spark, tmp_path, lines[i * 40:i * 40 + 40], f"r{i}", LINE_RULES, gap=60)
    events, hits = (f(spark, str(tmp_path)) for f in (importing.stored_events, importing.stored_hits))
    assert said(hits) == said(detect(events, LINE_RULES))
    columns = ["title", "src_ip", "count", "first_seen", "last_seen", "last_matched", "last_count", "samples", "dst_ip", "url"]
    told = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert told(spark.read.parquet(f"{tmp_path}/alerts")) == told(consolidate(detect(events, LINE_RULES), gap=60))
    # replaced by other lines, the runs are as if the first had never been
    run(spark, tmp_path, lines[:17], "r0", LINE_RULES, gap=60)
    events, hits = (f(spark, str(tmp_path)) for f in (importing.stored_events, importing.stored_hits))
    assert events.count() == 97 and said(hits) == said(detect(events, LINE_RULES))
    shown = spark.read.parquet(f"{tmp_path}/alerts")
    assert told(shown.drop("samples").withColumn("samples", F.lit(0))) == told(
        consolidate(detect(events, LINE_RULES), gap=60).drop("samples").withColumn("samples", F.lit(0)))


def on_disk(spark):
    """Shuffle files and checkpoints."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {n for n in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n} | set(
        Folder(spark, spark.sparkContext.getCheckpointDir()).names())


def test_a_run_leaves_nothing_but_its_tables_on_disk(spark, tmp_path):
    rules = [*ONE, Rule(2, "count", "aggregate", "scan_event", threshold=2, time_window=60, count_mode="count")]
    kept = materialise(spark.range(3))
    before = on_disk(spark)
    run(spark, tmp_path, [probe(i, f"10:00:{i:02}") for i in range(20)], "a", rules)
    one = spark.read.parquet(f"{tmp_path}/alerts").first()
    importing.set_status(spark, str(tmp_path), spark.createDataFrame([(one.alert_id, "closed")], "alert_id bigint, status string"))
    run(spark, tmp_path, [probe(i, f"10:00:{i:02}") for i in range(20)], "b", rules)
    for _ in range(40):         # files go in the background
        if not (left := on_disk(spark) - before):
            break
        time.sleep(0.25)
    assert not left and kept.count() == 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_hits_of_new_events_are_not_compared_with_stored_ones(spark, tmp_path, monkeypatch):
    rules = [*ONE, Rule(2, "count", "aggregate", "scan_event", threshold=2, time_window=60, count_mode="count")]
    compared, original = [], upkeep._differences
    monkeypatch.setattr(upkeep, "_differences", lambda fresh, old, stored: (
        compared.append(sorted(r.seq for r in fresh.collect()) if fresh is not None else []), original(fresh, old, stored))[1])
    run(spark, tmp_path, [probe(i, f"10:00:{i:02}") for i in range(10)], "a", rules)
    run(spark, tmp_path, [probe(i, f"10:00:{i:02}", "2024-04-01") for i in range(10)], "far", rules)
    run(spark, tmp_path, [probe(i, f"10:00:{i:02}") for i in range(5, 15)], "near", rules)
    # the third run makes some hits of the first say something else, its own are new
    assert compared == [[], [], list(range(1, 10))]
    events, hits = (f(spark, str(tmp_path)) for f in (importing.stored_events, importing.stored_hits))
    assert said(hits) == said(detect(events, rules)) and hits.count() == 30 + 9 + 19
    # a run that is replaced is compared, also where its numbers stay
    run(spark, tmp_path, [probe(i, f"10:00:{i:02}", "2024-04-01") for i in range(8)], "far", rules)
    events, hits = (f(spark, str(tmp_path)) for f in (importing.stored_events, importing.stored_hits))
    assert len(compared[3]) == 8 + 7 and said(hits) == said(detect(events, rules))
