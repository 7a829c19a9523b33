"""Slow per-event models the plans are compared with: plain quadratic scans over sorted lists."""

from wardlog import schema
from wardlog.functions import timewin
from pyspark.sql import functions as F

EVENT_NAMES = [p.split()[0] for p in schema.EVENT.split(", ") if p]


def make_events(spark, rows):
    """Rows of dicts; `epoch` and `seq` are needed, the rest defaults to NULL."""
    names = ["seq", "epoch", "log_type", "src_ip", "dst_ip", "src_port", "dst_port", "proto",
             "method", "url", "status_code", "user_agent", "username", "detail", "raw"]
    ddl = ("seq BIGINT, epoch BIGINT, log_type STRING, src_ip STRING, dst_ip STRING, "
           "src_port INT, dst_port INT, proto STRING, method STRING, url STRING, "
           "status_code INT, user_agent STRING, username STRING, detail MAP<STRING,STRING>, "
           "raw STRING")
    frame = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)
    return frame.withColumn("ts", timewin.ts_of(F.col("epoch")))


def in_order(rows):
    return sorted(rows, key=lambda r: (r["epoch"], r["seq"]))


def trailing_count(rows, passes, window, threshold, value=None):
    """{(seq, count)}: for every passing event, what precedes it within the window, itself too."""
    out = set()
    ordered = [r for r in in_order(rows) if passes(r) and r["src_ip"]]
    for i, row in enumerate(ordered):
        seen = [r for r in ordered[:i + 1]
                if r["src_ip"] == row["src_ip"] and row["epoch"] - r["epoch"] <= window]
        n = len(seen) if value is None else len({value(r) for r in seen} - {None})
        if n >= threshold:
            out.add((row["seq"], n))
    return out


def sequences(rows, trigger, precondition, window, threshold):
    out = set()
    for ip in {r["src_ip"] for r in rows if r["src_ip"]}:
        pending = []
        for row in in_order([r for r in rows if r["src_ip"] == ip]):
            if trigger(row):
                live = [t for t in pending if row["epoch"] - t <= window]
                if len(live) >= threshold:
                    out.add((row["seq"], len(live)))
                    pending = []
            elif precondition(row):
                pending.append(row["epoch"])
    return out


def greedy_apart(values, distance):
    chosen = []
    for v in sorted(set(values)):
        if not chosen or v - chosen[-1] >= distance:
            chosen.append(v)
    return chosen


def merge(hits, gap, closing=()):
    """hits: (rule, ip, epoch, seq, line). closing: (rule, ip, epoch, is_open) status changes."""
    alerts = {}
    for rule, ip, epoch, seq, line in sorted(hits, key=lambda h: (h[2], h[3])):
        mine = alerts.setdefault((rule, ip), [])
        if mine:
            last = mine[-1]
            changes = sorted(c for c in closing
                             if c[:2] == (rule, ip) and last["last"] <= c[2] < epoch)
            still_open = changes[-1][3] if changes else True
            if epoch - last["last"] <= gap and still_open:
                last["n"] += 1
                last["last"] = epoch
                if line not in last["lines"]:
                    last["lines"].append(line)
                continue
        mine.append({"first": epoch, "last": epoch, "n": 1, "lines": [line]})
    return {(k[0], k[1], a["first"], a["last"], a["n"], tuple(a["lines"][-10:]))
            for k, found in alerts.items() for a in found}
