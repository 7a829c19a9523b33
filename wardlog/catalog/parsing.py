"""Queries: scans and parsers, checked by round trip against the columns the lines came from."""

from pyspark.sql import functions as F

from wardlog.catalog.base import AS_OF_TEXT, as_of, events, query, with_ev
from wardlog.functions import timewin
from wardlog.sources import fixtures, logs


def _parsed(spark, sf, source_type="auto"):
    return logs.parse(fixtures.log_lines(spark, sf), source_type, year=fixtures.YEAR, keep=("seq",))


def _detail(key):
    return F.coalesce(F.try_element_at("detail", F.lit(key)), F.lit(""))


@query("parse_ssh_login", with_ev("""
SELECT seq, epoch, src_ip, src_port, dst_port, proto, username, outcome AS event FROM ev
WHERE log_type = 'ssh' AND NOT (event_type = 'error' AND k % 3 = 2)"""))
def ssh_login(spark, sf):
    return _parsed(spark, sf, "sshd").where(
        F.col("log_type").isNotNull() & (_detail("reason") == "")).select(
        "seq", "epoch", "src_ip", "src_port", "dst_port", "proto", "username",
        _detail("event").alias("event"))


@query("parse_ssh_invalid_user", with_ev("""
SELECT seq, epoch, src_ip, src_port, username, outcome AS event, 'invalid_user' AS reason FROM ev
WHERE event_type = 'error' AND k % 3 = 2"""))
def ssh_invalid(spark, sf):
    return _parsed(spark, sf, "ssh").where(_detail("reason") == "invalid_user").select(
        "seq", "epoch", "src_ip", "src_port", "username", _detail("event").alias("event"),
        _detail("reason").alias("reason"))


@query("parse_web_access", with_ev("""
SELECT seq, epoch, src_ip, method, url, status_code, CAST(100 + k AS VARCHAR) AS size,
       '-' AS referer, user_agent FROM ev WHERE log_type = 'web'"""))
def web_access(spark, sf):
    return logs.accepted(_parsed(spark, sf, "nginx")).select(
        "seq", "epoch", "src_ip", "method", "url", "status_code", _detail("size").alias("size"),
        _detail("referer").alias("referer"), "user_agent")


@query("parse_port_probe", with_ev("""
SELECT seq, epoch, src_ip, dst_ip, dst_port, proto, 'open' AS state, flags FROM ev
WHERE log_type = 'scan'"""))
def port_probe(spark, sf):
    return logs.accepted(_parsed(spark, sf, "nmap")).select(
        "seq", "epoch", "src_ip", "dst_ip", "dst_port", "proto", _detail("state").alias("state"),
        _detail("flags").alias("flags"))


@query("parse_auto_detect", with_ev("""
SELECT seq, epoch, log_type, src_ip, coalesce(dst_ip, '') AS dst_ip,
       coalesce(dst_port, 0) AS dst_port, coalesce(url, '') AS url,
       coalesce(status_code, 0) AS status_code, coalesce(user_agent, '') AS user_agent,
       coalesce(username, '') AS username, raw FROM ev"""))
def auto(spark, sf):
    none = {"dst_ip": "", "dst_port": 0, "url": "", "status_code": 0, "user_agent": "",
            "username": ""}
    return logs.accepted(_parsed(spark, sf)).na.fill(none).select(
        "seq", "epoch", "log_type", "src_ip", *none, "raw")


ALIASES = ("ssh", "SSHD", "web", "http", "apache", "nginx", "scan", "nmap", "auto", "syslog")


@query("parse_by_source_type", with_ev(
    """want AS (SELECT *, ['ssh', 'ssh', 'web', 'web', 'web', 'web', 'scan', 'scan', 'auto',
  'none'][CAST(seq % 10 AS INTEGER) + 1] AS want FROM ev)""",
    """SELECT log_type, want, count(*) AS lines,
       count(*) FILTER (WHERE want = 'auto' OR want = log_type) AS parsed
FROM want GROUP BY log_type, want"""))
def by_alias(spark, sf):
    """Every line is declared as one of ten source types, most of them wrong."""
    source = events(spark, sf).select("seq", F.col("raw").alias("value"),
                                      F.col("log_type").alias("true_type"))
    kind = F.element_at(F.array(*[F.lit(a) for a in ALIASES]), (F.col("seq") % 10 + 1).cast("int"))
    want = F.element_at(F.array(*[F.lit(a) for a in (
        "ssh", "ssh", "web", "web", "web", "web", "scan", "scan", "auto", "none")]),
        (F.col("seq") % 10 + 1).cast("int"))
    declared = source.withColumn("source_type", kind).withColumn("want", want)
    parsed = logs.parse(declared, F.col("source_type"), year=fixtures.YEAR,
                        keep=("seq", "true_type", "want"))
    return parsed.groupBy(F.col("true_type").alias("log_type"), "want").agg(
        F.count("*").alias("lines"), F.count("log_type").alias("parsed"))


@query("quarantine_lines", with_ev("""
SELECT seq, trim(left(raw, 24)) AS raw FROM ev WHERE k % 7 = 3"""))
def quarantined(spark, sf):
    """Truncated and blank lines among the good ones: the former are kept aside, the latter not."""
    source = events(spark, sf).select("seq", F.when(F.col("k") % 7 == 3, F.substring("raw", 1, 24))
                                      .when(F.col("k") % 7 == 4, F.lit("   "))
                                      .otherwise(F.col("raw")).alias("value"))
    return logs.quarantine(logs.parse(source, year=fixtures.YEAR, keep=("seq",)), "seq")


@query("parse_iso_times", """
SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN -1
       ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events""")
def iso_times(spark, sf):
    text = F.date_format("ts", timewin.ISO)
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    return fixtures.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.coalesce(timewin.epoch_of(timewin.parse_iso(broken)), F.lit(-1)).alias("epoch"))


@query("time_cut_offs", f"""
SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 7 DAY) AS last_week,
       count(*) FILTER (WHERE ts >= date_trunc('day', TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 1 HOUR))
       AS today,
       count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00'
                        AND TIMESTAMP '2024-01-12 12:00:00') AS in_range,
       count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-12 12:00:00') AS open_start FROM events""")
def cut_offs(spark, sf):
    low = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    high = F.lit("2024-01-12 12:00:00").cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    earlier = timewin.days_before(as_of(), 1 / 24)
    return fixtures.table(spark, sf, "events").agg(
        F.count_if(ts >= timewin.days_before(as_of(), 7)).alias("last_week"),
        F.count_if(ts >= timewin.day_start(earlier)).alias("today"),
        F.count_if(timewin.in_range(ts, low, high)).alias("in_range"),
        F.count_if(timewin.in_range(ts, None, high)).alias("open_start"))


@query("training_range", with_ev(f"""
SELECT count(*) AS events, min(epoch) AS oldest, max(epoch) AS newest FROM ev
WHERE t >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 72 HOUR"""))
def training_range(spark, sf):
    from wardlog.plans.reports import training_events
    return training_events(events(spark, sf), as_of(), 72).agg(
        F.count("*").alias("events"), F.min("epoch").alias("oldest"),
        F.max("epoch").alias("newest"))


@query("import_counts", with_ev("""
SELECT count(*) AS processed, count(*) FILTER (WHERE k % 7 <> 3 AND k % 7 <> 4) AS parsed,
       count(*) FILTER (WHERE k % 7 = 3) AS rejected FROM ev"""))
def import_counts(spark, sf):
    """What an import job records: lines seen, parsed and set aside."""
    source = events(spark, sf).select("seq", F.when(F.col("k") % 7 == 3, F.substring("raw", 1, 24))
                                      .when(F.col("k") % 7 == 4, F.lit("   "))
                                      .otherwise(F.col("raw")).alias("value"))
    parsed = logs.parse(source, year=fixtures.YEAR, keep=("seq",))
    return parsed.agg(F.count("*").alias("processed"), F.count("log_type").alias("parsed"),
                      F.count_if(F.col("log_type").isNull() & (F.col("raw") != ""))
                      .alias("rejected"))
