import random

import pytest
from pyspark.sql import functions as F

import brute
from wardlog.operators import alerts as alert_ops
from wardlog.operators.sequence import select_apart
from wardlog.operators.windowed import windowed_hits
from wardlog.plans.detection import detect
from wardlog.sources.rules import Rule, builtin_rules

BASE = 1789179240


def random_events(seed, n=400, span=2000, ips=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["failed", "failed", "failed", "success", "scan", "web"])
        hot = rng.random() < 0.6
        row = {"seq": i, "epoch": BASE + rng.randrange(span),
               "src_ip": "10.0.0.1" if hot else rng.choice([f"10.0.0.{x}" for x in range(2, 2 + ips)]
                                                           + [None, ""]),
               "raw": f"line {rng.randrange(30)}"}
        if kind in ("failed", "success"):
            row |= {"log_type": "ssh", "detail": {"event": kind}, "username": "root"}
        elif kind == "scan":
            row |= {"log_type": "scan", "detail": {}, "dst_port": rng.choice([None, *range(12)])}
        else:
            row |= {"log_type": "web", "detail": {}, "status_code": rng.choice([200, 404])}
        rows.append(row)
    return rows


def failed(r):
    return (r.get("detail") or {}).get("event") == "failed"


def success(r):
    return (r.get("detail") or {}).get("event") == "success"


@pytest.mark.parametrize("seed,span,window", [(1, 300, 20), (2, 3000, 60), (3, 400000, 50000),
                                              (4, 400000, 100000)])
def test_count_matches_model(spark, seed, span, window):
    rows = random_events(seed, span=span)
    rules = [Rule(1, "a", "aggregate", "ssh_failed", threshold=3, time_window=window),
             Rule(2, "b", "aggregate", "web_error", threshold=2, time_window=window // 2)]
    got = windowed_hits(brute.make_events(spark, rows), rules).collect()
    assert {(r.seq, r["count"]) for r in got if r.rule_id == 1} == brute.trailing_count(
        rows, failed, window, 3)
    assert {(r.seq, r["count"]) for r in got if r.rule_id == 2} == brute.trailing_count(
        rows, lambda r: r.get("status_code") == 404, window // 2, 2)


@pytest.mark.parametrize("seed,span,window", [(5, 60, 10), (6, 2000, 90), (7, 300000, 40000)])
def test_distinct_matches_model(spark, seed, span, window):
    rows = random_events(seed, n=600, span=span)
    rule = Rule(1, "d", "aggregate", "scan_event", threshold=3, time_window=window,
                count_mode="distinct", distinct_field="dst_port")
    got = windowed_hits(brute.make_events(spark, rows), [rule]).collect()
    assert {(r.seq, r["count"]) for r in got} == brute.trailing_count(
        rows, lambda r: r["log_type"] == "scan", window, 3, lambda r: r.get("dst_port"))


@pytest.mark.parametrize("seed,span,window,block", [(8, 200, 30, 4), (9, 1500, 60, 16384),
                                                    (10, 100, 100, 3), (11, 300000, 30000, 5)])
def test_sequence_matches_model(spark, seed, span, window, block):
    rows = random_events(seed, n=500, span=span)
    rule = Rule(1, "s", "composite", "ssh_success", "ssh_failed", threshold=3, time_window=window)
    got = windowed_hits(brute.make_events(spark, rows), [rule], block=block).collect()
    assert {(r.seq, r.prior_fails) for r in got} == brute.sequences(
        rows, success, failed, window, 3)


def test_crowded_seconds_are_split(spark):
    """Time stamps cut to the day: hundreds of events share a second, which is split by arrival."""
    rows = [r | {"epoch": r["epoch"] - r["epoch"] % 86400} for r in random_events(12, n=500,
                                                                             span=400000)]
    window = 100000
    rules = [Rule(1, "a", "aggregate", "ssh_failed", threshold=3, time_window=window),
             Rule(2, "d", "aggregate", "scan_event", threshold=3, time_window=window,
                  count_mode="distinct", distinct_field="dst_port"),
             Rule(3, "s", "composite", "ssh_success", "ssh_failed", threshold=3,
                  time_window=window)]
    want = ({(1, *x) for x in brute.trailing_count(rows, failed, window, 3)}
            | {(2, *x) for x in brute.trailing_count(
                rows, lambda r: r["log_type"] == "scan", window, 3, lambda r: r.get("dst_port"))}
            | {(3, *x) for x in brute.sequences(rows, success, failed, window, 3)})
    for stretch in (10, 10 ** 6):
        got = windowed_hits(brute.make_events(spark, rows), rules, stretch=stretch).collect()
        assert {(r.rule_id, r.seq, r["count"] or r.prior_fails) for r in got} == want


@pytest.mark.parametrize("distance,block", [(1, 2), (3, 3), (3, 7), (5, 64)])
def test_greedy_selection_across_blocks(spark, distance, block):
    rng = random.Random(distance * block)
    values = sorted({rng.randrange(1, 400) for _ in range(220)})
    points = spark.createDataFrame([("g", v) for v in values], "_g string, a bigint")
    got = [r.a for r in select_apart(points, distance, block).orderBy("a").collect()]
    assert got == brute.greedy_apart(values, distance)


def test_builtin_boundaries(spark):
    """Fifth failure fires; a failure 305 s later does not; 20 ports fire; flags without SYN."""
    def ssh(seq, at, ip, event="failed", user="zhang"):
        return {"seq": seq, "epoch": BASE + at, "src_ip": ip, "log_type": "ssh",
                "detail": {"event": event}, "username": user, "raw": f"r{seq}"}

    def scan(seq, at, ip, port, flags=None):
        return {"seq": seq, "epoch": BASE + at, "src_ip": ip, "log_type": "scan",
                "dst_port": port, "detail": {"flags": flags} if flags else {}, "raw": f"r{seq}"}

    rows = [ssh(i, i, "1.1.1.1", user="root") for i in range(5)]
    rows += [ssh(10 + i, t, "2.2.2.2", user="root") for i, t in enumerate([0, 1, 2, 3, 305])]
    rows += [ssh(20 + i, i, "3.3.3.3") for i in range(3)]
    rows += [ssh(30, 0, "4.4.4.4"), ssh(31, 1, "4.4.4.4"), ssh(32, 2, "4.4.4.4"),
             ssh(33, 3, "4.4.4.4", "success"), ssh(34, 0, "5.5.5.5", "success")]
    rows += [scan(100 + i, i, "6.6.6.6", 1000 + i) for i in range(20)]
    rows += [scan(130 + i, i, "7.7.7.7", 80) for i in range(25)]
    rows += [scan(160 + i, i, "8.8.8.8", 80, "FIN") for i in range(9)]
    rows += [scan(169, 9, "8.8.8.8", 80, "FIN|PSH")]
    rows += [scan(180 + i, i, "9.9.9.9", 80, "SYN") for i in range(15)]
    hits = detect(brute.make_events(spark, rows), builtin_rules()).collect()
    found = {(h.rule_id, h.src_ip, h.seq) for h in hits}
    assert (1, "1.1.1.1", 4) in found and not [h for h in hits if h.src_ip == "2.2.2.2"]
    assert (2, "3.3.3.3", 22) in found
    assert [(h.seq, h.prior_fails) for h in hits if h.rule_id == 3] == [(33, 3)]
    assert [h.seq for h in hits if h.rule_id == 4] == [119]
    assert [h.seq for h in hits if h.rule_id == 5] == [169]
    assert next(h for h in hits if h.seq == 4).matched_text == "src_ip=1.1.1.1 在 300s 内命中 5 次"


def hit_frame(spark, hits):
    return spark.createDataFrame(
        [(1, rule, "ssh", "high", seq, epoch, ip, None, None, line, f"m{seq}", 5, None, 60)
         for rule, ip, epoch, seq, line in hits],
        "rule_id INT, rule_name STRING, category STRING, severity STRING, seq BIGINT, "
        "epoch BIGINT, src_ip STRING, dst_ip STRING, url STRING, raw STRING, "
        "matched_text STRING, count BIGINT, prior_fails BIGINT, window_s INT")


@pytest.mark.parametrize("seed,span", [(1, 5000), (2, 400000), (3, 900)])
def test_alerts_match_model(spark, seed, span):
    rng = random.Random(seed)
    hits = [(rng.choice("AB"), rng.choice(["1.1.1.1", "2.2.2.2", None]),
             BASE + rng.randrange(span), i, f"line {i}") for i in range(300)]
    changes = [("A", "1.1.1.1", BASE + rng.randrange(span), rng.random() < 0.4)
               for _ in range(40)]
    changes = list({(c[2]): c for c in changes}.values())
    frame = spark.createDataFrame(
        [(r, ip, t, "confirmed" if still else "closed") for r, ip, t, still in changes],
        "rule_name STRING, src_ip STRING, epoch BIGINT, status STRING")
    for closing, table in (((), None), (changes, frame)):
        got = alert_ops.consolidate(hit_frame(spark, hits), status_changes=table).collect()
        assert {(a.title, a.src_ip, a.first_seen, a.last_seen, a["count"], tuple(a.samples))
                for a in got} == brute.merge(hits, 300, closing)


@pytest.mark.parametrize("gap", [0, 7, 5_000, 100_000])
def test_alerts_of_any_gap_match_model(spark, gap):
    """Hits are put together by slots as long as the gap, over several chunks of time; lines come back in later ones."""
    rng = random.Random(gap)
    hits = [("A", "1.1.1.1", BASE + rng.randrange(60 * max(gap, 5)), i, f"line {rng.randrange(150)}") for i in range(400)]
    got = alert_ops.consolidate(hit_frame(spark, hits), gap).collect()
    assert {(a.title, a.src_ip, a.first_seen, a.last_seen, a["count"], tuple(a.samples)) for a in got} == brute.merge(hits, gap)


def test_hits_no_further_apart_than_the_gap_are_one_slot(spark):
    hits = hit_frame(spark, [("A", "1", 30_000 + i, i, "x") for i in range(290)])
    slots = alert_ops._slots(alert_ops._null_safe(hits), 300).collect()
    assert [(s.n, s.epoch, s._until) for s in slots] == [(290, 30_000, 30_289)]


def test_gap_is_inclusive(spark):
    merged = alert_ops.consolidate(hit_frame(spark, [("A", "1", BASE, 0, "x"),
                                                     ("A", "1", BASE + 300, 1, "y")]))
    split = alert_ops.consolidate(hit_frame(spark, [("A", "1", BASE, 0, "x"),
                                                    ("A", "1", BASE + 301, 1, "y")]))
    assert merged.count() == 1 and split.count() == 2
    row = merged.first()
    assert row.last_matched == "m1" and row.samples == ["x", "y"] and row.last_count == 5


def test_samples_keep_newest(spark):
    hits = [("A", "1", BASE + i, i, f"line {i}") for i in range(6)]
    got = alert_ops.consolidate(hit_frame(spark, hits), max_samples=3).first()
    assert got.samples == ["line 3", "line 4", "line 5"] and got["count"] == 6


def test_summary_and_status(spark):
    alerts = alert_ops.consolidate(hit_frame(spark, [("A", "1", BASE, 0, "x"),
                                                     ("B", "1", BASE, 1, "y")]))
    assert alert_ops.severity_summary(alerts).first().asDict() == {
        "high": 2, "mid": 0, "low": 0, "info": 0, "total": 2}
    updates = alerts.where("title = 'A'").select("alert_id", F.lit("closed").alias("status"))
    assert {(a.title, a.status) for a in alert_ops.apply_status(alerts, updates).collect()} == {
        ("A", "closed"), ("B", "new")}
