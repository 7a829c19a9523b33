import random
import tempfile
import time

from pyspark.sql import functions as F

import brute
from test_windows import BASE, random_events
from wardlog.constants import FEATURES
from wardlog.operators.features import ip_features
from wardlog.sources import fixtures
from wardlog.plans.detection import detect
from wardlog.sources.rules import Rule, builtin_rules
from wardlog.streaming import feed
from wardlog.sources.commits import CommitLog, Record
from wardlog.streaming.ingest import Ingest, SourceProgress, read_line_stream
from wardlog.streaming.stateful import feature_stream, session_alerts

def test_micro_batches_equal_batch(spark):
    """Files dropped in time order give the hits of one batch over everything; rules reload."""
    sf = "/root/testdata/sf0.001"
    lines = fixtures.log_lines(spark, sf).where("seq < 600")
    ordered = spark.createDataFrame(lines.orderBy("seq").collect(), lines.schema)
    folder, out = (tempfile.mkdtemp(prefix="wardlog-in-"), tempfile.mkdtemp(prefix="wardlog-out-"))
    for part in range(3):
        ordered.where((F.col("seq") >= part * 200) & (F.col("seq") < part * 200 + 200)).coalesce(
            1).write.mode("append").parquet(folder)
    rules = builtin_rules(window=3 * 86400, threshold=2)
    calls = []

    def current():
        calls.append(1)
        return rules

    ingest = Ingest(spark, out, current, fixtures.YEAR, delay=10 ** 9)
    query = ingest.start(read_line_stream(spark, folder, 1), tempfile.mkdtemp(), available_now=True)
    query.awaitTermination(600)
    assert query.exception() is None and len(calls) == 3
    everything = ingest.events()
    assert everything.count() == 600
    want = {(h.rule_id, h.seq, h["count"], h.prior_fails)
            for h in detect(everything, rules).collect()}
    got = {(h.rule_id, h.seq, h["count"], h.prior_fails) for h in ingest.hits().collect()}
    assert got == want and any(h[0] == 3 for h in got)
    assert ingest.progress().agg(F.sum("parsed"), F.sum("hits")).first()[:] == (600, len(got))
    # a repeated batch replaces its own partition
    ingest.process(ordered.where("seq >= 400"), 2)
    assert ingest.hits().count() == len(got)


def probe(seq, clock, day="2024-03-01", ip="1.1.1.1"):
    return seq, f"{day}T{clock},{ip},2.2.2.2,22,tcp,open"


def test_late_lines_are_examined_and_listed(spark):
    out = tempfile.mkdtemp(prefix="wardlog-late-")
    rules = [Rule(1, "count", "aggregate", "scan_event", threshold=2, time_window=60, count_mode="count")]
    ingest = Ingest(spark, out, lambda: rules, 2024, delay=60)
    ddl = "seq BIGINT, value STRING"
    ingest.process(spark.createDataFrame([probe(0, "09:57:30"), probe(1, "10:00:00")], ddl), 0)
    ingest.process(spark.createDataFrame([probe(2, "09:59:30"), probe(3, "09:58:00")], ddl), 1)
    assert [r.seq for r in ingest.late().collect()] == [3]
    assert sorted(r.seq for r in ingest.events().collect()) == [0, 1, 2, 3]
    # the late line of 09:59:30 completes a hit on the stored line of 10:00:00
    assert {(r.seq, r["count"]) for r in ingest.hits().collect()} == {(1, 2), (3, 2)}
    # a date far ahead is stored, but does not make everything after it late
    ingest.process(spark.createDataFrame([probe(4, "10:00:00", "2999-01-01"), probe(5, "10:01:00")], ddl), 2)
    assert [r.seq for r in ingest.late().collect()] == [3] and ingest.events().count() == 6
    assert [tuple(r) for r in ingest.progress().orderBy("batch").select("parsed", "late", "hits").collect()] == [
        (2, 0, 0), (2, 1, 2), (2, 0, 1)]


LINE_RULES = [
    Rule(1, "count", "aggregate", "scan_event", threshold=3, time_window=120, count_mode="count"),
    Rule(2, "ports", "aggregate", "scan_event", threshold=3, time_window=300, count_mode="distinct", distinct_field="dst_port"),
    Rule(3, "login", "composite", "ssh_success", "ssh_failed", threshold=2, time_window=400),
    Rule(4, "path", "regex", "sensitive_path", "url")]


def shuffled_lines(rng, n):
    lines = []
    for seq in range(n):
        second = rng.randrange(4000)
        ip, clock = f"10.0.0.{rng.randrange(3)}", f"{second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}"
        kind = rng.randrange(4)
        lines.append((seq, f"Mar  1 {clock} host sshd[9]: {rng.choice(['Accepted', 'Failed', 'Failed'])} password for eva from {ip} port 5000 ssh2"
                      if kind < 2 else f"2024-03-01T{clock},{ip},2.2.2.2,{rng.randrange(20, 26)},tcp,open" if kind == 2 else
                      f'{ip} - - [01/Mar/2024:{clock} +0000] "GET {rng.choice(["/a", "/.env", "/b"])} HTTP/1.1" 200 5 "-" "x"'))
    return lines


def said(hits):
    return sorted((h.rule_id, h.seq, h["count"] or 0, h.prior_fails or 0, h.matched_text) for h in hits.collect())


def test_any_batches_give_the_hits_of_one(spark):
    """Lines in random order, in batches of random size, with hits that late lines add, change and take back."""
    rng = random.Random(11)
    lines = shuffled_lines(rng, 160)
    rng.shuffle(lines)
    ingest = Ingest(spark, tempfile.mkdtemp(), lambda: LINE_RULES, 2024)
    at, batch = 0, 0
    while at < len(lines):
        size = rng.choice((5, 30, 60))
        ingest.process(spark.createDataFrame(lines[at:at + size], "seq BIGINT, value STRING"), batch)
        at, batch = at + size, batch + 1
    found = said(ingest.hits())
    assert found == said(detect(ingest.events(), LINE_RULES)) and {h[0] for h in found} == {1, 2, 3, 4}
    ingest.process(spark.createDataFrame(lines[:9], "seq BIGINT, value STRING"), batch - 1)      # committed: not repeated
    assert ingest.events().count() == 160


def test_many_batches_leave_few_folders(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path), {"events": "seq BIGINT, epoch BIGINT"})
    listed = []
    for n in range(40):
        before = log.record(n - 1)
        record = Record(n, None, {"events": {d: list(f) for d, f in before.files.get("events", {}).items()}})
        rows = spark.createDataFrame([(n, n)], "seq bigint, epoch bigint").coalesce(1)
        for day, found in log.write("events", rows, n).items():
            record.files["events"].setdefault(day, []).extend(found)
        log.finish(record, before)
        listed.append(len(record.files["events"]["0"]))
    assert max(listed) <= 17 and len([n for n in log.folder.names() if n.startswith("record-")]) == 2
    assert sorted((r.seq, r.commit) for r in log.read("events", log.record()).collect()) == [(n, n) for n in range(40)]


def test_progress_of_a_source(spark):
    listener, folder = SourceProgress(), tempfile.mkdtemp()
    spark.streams.addListener(listener)
    spark.createDataFrame([probe(0, "10:00:00")], "seq BIGINT, value STRING").write.mode("append").parquet(folder)
    ingest = Ingest(spark, tempfile.mkdtemp(), lambda: [], 2024)
    query = ingest.start(read_line_stream(spark, folder), tempfile.mkdtemp(), available_now=True)
    query.awaitTermination(120)
    for _ in range(50):
        if listener.status.get(str(query.id)) == "finished":
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.rows[str(query.id)] == 1 and listener.status[str(query.id)] == "finished"


def run_memory(stream, name, mode="append"):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    return stream.sparkSession.sql(f"select * from {name}").collect()


def test_sessions_and_features_on_a_stream(spark):
    folder = tempfile.mkdtemp(prefix="wardlog-hits-")
    rows = [("A", "1.1.1.1", "high", BASE + s) for s in (0, 300, 601, 10_000_000)]
    (spark.createDataFrame(rows, "rule_name string, src_ip string, severity string, epoch bigint")
     .withColumn("ts", F.timestamp_seconds("epoch")).write.mode("append").parquet(folder))
    hits = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    got = run_memory(session_alerts(hits), "sessions")
    assert sorted(r["count"] for r in got) == [1, 2]
    events = tempfile.mkdtemp(prefix="wardlog-ev-")
    data = [r | {"epoch": BASE + i} for i, r in enumerate(random_events(3, n=120))]
    brute.make_events(spark, data + [data[0] | {"epoch": BASE + 10 ** 6}]).write.mode(
        "append").parquet(events)
    stream = spark.readStream.schema(spark.read.parquet(events).schema).parquet(events)
    rows = run_memory(feature_stream(stream), "features")
    assert sum(r.events for r in rows) == sum(1 for r in data if r["src_ip"])
    # all twelve, as in the batch plan over the events of the closed windows
    told = lambda rows: sorted(tuple(r[c] for c in ("src_ip", "bucket", *FEATURES)) for r in rows)
    assert told(rows) == told(ip_features(brute.make_events(spark, data)).collect())


def test_tail(spark):
    table = spark.range(1, 701).withColumnRenamed("id", "seq")
    assert [r.seq for r in feed.snapshot_after(table, 695).collect()] == [696, 697, 698, 699, 700]
    assert [r.seq for r in feed.snapshot_after(table, 0, 2).collect()] == [699, 700]
    assert feed.snapshot_after(table).first().seq == 201
    assert feed.latest_seq(table).first().latest == 700
