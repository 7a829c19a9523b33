"""Queries: correlation, geolocation, dashboards, quality evaluation, tail, maintenance."""

from pyspark.sql import functions as F

from wardlog.catalog.base import (AS_OF_EPOCH, AS_OF_TEXT, GAP, HITS, alerts, as_of, events, hits, query,
                                  quoted, rule, sql_class, table, with_alerts, with_ev)
from wardlog.constants import (ADDRESS_RANGES, CATEGORY_LABELS, EXPECTED_RULES, FINDING_CLASS, SEVERITY_ALIASES,
                               SEVERITY_LABELS, SIGNATURE_LABELS, UNKNOWN_LABEL)
from wardlog.functions import text
from wardlog.operators import correlate, geo, maintenance, quality
from wardlog.operators.alerts import consolidate
from wardlog.plans import detection, reports
from wardlog.sources.fixtures import FINDING_TYPES
from wardlog.sources import tables
from wardlog.streaming import feed

HOURS = 240

# ------------------------------------------------------------------------------ findings

FINDINGS_SQL = f"""
urls AS (SELECT url, min(seq) AS first_seq FROM ev WHERE url IS NOT NULL GROUP BY url),
ranked AS (SELECT url, first_seq, row_number() OVER (ORDER BY url) - 1 AS r,
  CASE WHEN rtrim(regexp_extract(url, '^([^?]*)', 1), '/') = '' THEN '/'
       ELSE rtrim(regexp_extract(url, '^([^?]*)', 1), '/') END AS path FROM urls),
findings AS (
  SELECT first_seq * 10 + v AS finding_id, first_seq % 7 AS task_id, r.url, path,
    [{', '.join(quoted(t) for t in FINDING_TYPES)}][v + 1] AS vuln_type,
    ['critical', 'high', 'mid', 'low', 'info'][CAST((first_seq + v) % 5 AS INTEGER) + 1] AS severity
  FROM ranked r, range(5) t(v))"""


def _findings(spark, sf):
    """Every distinct requested URL is a finding of each of five types."""
    urls = events(spark, sf).where("url is not null").groupBy("url").agg(
        F.min("seq").alias("first_seq"))
    kinds = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(t).alias("t"))
                      for i, t in enumerate(FINDING_TYPES)])
    severities = F.array(*[F.lit(s) for s in ("critical", "high", "mid", "low", "info")])
    return urls.select("url", "first_seq", F.explode(kinds).alias("k")).select(
        (F.col("first_seq") * 10 + F.col("k.v")).alias("finding_id"),
        (F.col("first_seq") % 7).alias("task_id"), F.lit(1).alias("target_id"), "url",
        F.col("k.t").alias("vuln_type"),
        F.element_at(severities, ((F.col("first_seq") + F.col("k.v")) % 5 + 1).cast("int"))
        .alias("severity"), F.lit("id").alias("param"))


_CLASS_OF = "CASE vuln_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in FINDING_CLASS.items() if v) + " END"
_CLASS_TEST = "CASE " + _CLASS_OF + " " + " ".join(
    f"WHEN '{c}' THEN {sql_class('e.url', c)}" for c in correlate.CLASSES) + " ELSE false END"
_LABEL_OF = "CASE " + _CLASS_OF + " " + " ".join(
    f"WHEN '{k}' THEN {quoted(v)}" for k, v in SIGNATURE_LABELS.items()) + " ELSE '—' END"

RELATED_SQL = f"""
cls AS (SELECT finding_id, path, vuln_type, {_CLASS_OF} AS class FROM findings),
matched AS (SELECT f.finding_id, f.vuln_type, e.seq, e.epoch, e.src_ip, e.url,
    row_number() OVER (PARTITION BY f.finding_id ORDER BY e.epoch DESC, e.seq DESC) AS rank
  FROM findings f JOIN ev e ON e.log_type = 'web' AND starts_with(lower(e.url), lower(f.path))
    AND e.epoch >= {AS_OF_EPOCH - HOURS * 3600} AND ({_CLASS_TEST}))"""


@query("related_events", with_ev(FINDINGS_SQL, RELATED_SQL, """
SELECT finding_id, seq, epoch, src_ip, url, CAST(rank AS INTEGER) AS rank FROM matched
WHERE rank <= 8"""))
def related(spark, sf):
    return correlate.related_events(_findings(spark, sf), events(spark, sf), as_of(), HOURS).select(
        "finding_id", "seq", "epoch", "src_ip", "url", "rank")


@query("related_events_exact", with_ev(FINDINGS_SQL, RELATED_SQL, """
SELECT m.finding_id, count(*) AS events FROM matched m JOIN findings f USING (finding_id)
WHERE CASE WHEN rtrim(regexp_extract(m.url, '^([^?]*)', 1), '/') = '' THEN '/'
  ELSE rtrim(regexp_extract(m.url, '^([^?]*)', 1), '/') END = f.path GROUP BY m.finding_id"""))
def related_exact(spark, sf):
    return correlate.event_counts(_findings(spark, sf), events(spark, sf), as_of(), HOURS,
                                  mode="exact").select("finding_id", "events")


ALERT_MATCH_SQL = f"""
near AS (SELECT f.finding_id, e.title, e.src_ip, e.first_seen, e.last_seen, e.count,
    row_number() OVER (PARTITION BY f.finding_id ORDER BY e.last_seen DESC, e.title, e.src_ip)
    AS rank
  FROM findings f JOIN alerts e ON starts_with(lower(e.url), lower(f.path))
    AND e.last_seen >= {AS_OF_EPOCH - HOURS * 3600} AND ({_CLASS_TEST}))"""


@query("related_alerts", with_alerts(FINDINGS_SQL, ALERT_MATCH_SQL, """
SELECT finding_id, title, src_ip, first_seen, last_seen, count, CAST(rank AS INTEGER) AS rank
FROM near WHERE rank <= 8"""))
def related_alerts(spark, sf):
    return correlate.related_alerts(_findings(spark, sf), alerts(spark, sf), as_of(), HOURS).select(
        "finding_id", "title", "src_ip", "first_seen", "last_seen", "count", "rank")


@query("findings_for_urls", with_ev(FINDINGS_SQL, f"""
known AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY finding_id DESC) AS rank,
  {_LABEL_OF} AS attack_label FROM findings)""", """
SELECT u.url, k.finding_id, k.vuln_type, k.attack_label FROM ranked u JOIN known k
  ON k.path = u.path AND k.rank <= 5"""))
def findings_for(spark, sf):
    urls = events(spark, sf).where("url is not null").select("url").distinct()
    return correlate.findings_for_urls(urls, _findings(spark, sf)).select(
        "url", "finding_id", "vuln_type", "attack_label")


CLOSURE_SQL = f"""
closure AS (SELECT f.finding_id, f.task_id, f.vuln_type, ({_CLASS_OF}) IS NOT NULL AS correlatable,
   {_LABEL_OF} AS label, coalesce(e.n, 0) AS events, coalesce(a.n, 0) AS alerts,
   coalesce(e.sources, '') AS sources, coalesce(e.sample, '') AS sample, e.n IS NOT NULL OR a.n IS NOT NULL AS closed
 FROM findings f
 LEFT JOIN (SELECT finding_id, count(*) AS n, array_to_string(list_sort(list_distinct(
     list(src_ip)))[1:5], ',') AS sources, string_agg(url, ' ' ORDER BY rank)
     FILTER (WHERE rank <= 5) AS sample FROM matched GROUP BY finding_id) e
   USING (finding_id)
 LEFT JOIN (SELECT finding_id, count(*) AS n FROM near GROUP BY finding_id) a
   USING (finding_id))"""


def _closure(spark, sf):
    return correlate.closure(_findings(spark, sf), events(spark, sf), alerts(spark, sf), as_of(),
                             HOURS)


@query("closure_per_finding", with_alerts(FINDINGS_SQL, RELATED_SQL, ALERT_MATCH_SQL, CLOSURE_SQL,
                                          "SELECT * FROM closure"))
def closure(spark, sf):
    return _closure(spark, sf).drop("pattern").withColumns({
        "sources": F.array_join("sources", ","), "sample": F.array_join("sample", " ")})


@query("closure_per_task", with_alerts(FINDINGS_SQL, RELATED_SQL, ALERT_MATCH_SQL, CLOSURE_SQL, """
SELECT task_id, count(*) AS findings, count(*) FILTER (WHERE correlatable) AS correlatable,
  count(*) FILTER (WHERE correlatable AND closed) AS exploited,
  CAST(sum(events) AS BIGINT) AS events, CAST(sum(alerts) AS BIGINT) AS alerts
FROM closure GROUP BY task_id"""))
def closure_task(spark, sf):
    return correlate.closure_totals(_closure(spark, sf), "task_id")


@query("exploited_findings", with_ev(FINDINGS_SQL, RELATED_SQL, """
SELECT DISTINCT finding_id, vuln_type FROM matched"""))
def exploited(spark, sf):
    return correlate.exploited(_findings(spark, sf), events(spark, sf), as_of(), HOURS).select(
        "finding_id", "vuln_type")


@query("finding_classes", with_ev(FINDINGS_SQL, f"""
SELECT vuln_type, coalesce({_CLASS_OF}, '') AS class, {_LABEL_OF} AS label,
  ({_CLASS_OF}) IS NOT NULL AS correlatable, count(*) AS findings FROM findings GROUP BY ALL"""))
def classes(spark, sf):
    kind = F.col("vuln_type")
    return _findings(spark, sf).groupBy("vuln_type").agg(F.count("*").alias("findings")).select(
        "vuln_type", F.coalesce(correlate.class_of(kind), F.lit("")).alias("class"),
        correlate.attack_label(kind).alias("label"),
        correlate.is_correlatable(kind).alias("correlatable"), "findings")


@query("url_paths", """
SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id,
  rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS p FROM pages)""")
def paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_path(F.col("url")).alias("path"))


TASKS_SQL = """
targets AS (SELECT n_nationkey AS target_id, n_name AS name, 'http://' || lower(n_name) AS url
  FROM nation),
tasks AS (SELECT s_suppkey AS task_id, s_nationkey AS target_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'running' ELSE 'done' END AS status FROM supplier),
info AS (SELECT l_suppkey AS task_id, l_returnflag AS kind, max(l_linestatus) AS content
  FROM lineitem GROUP BY ALL),
found AS (SELECT ps AS task_id, count(*) AS n FROM (SELECT l_suppkey AS ps FROM lineitem
  WHERE l_quantity > 45) GROUP BY ps)"""


def _scan_tables(spark, sf):
    """Suppliers as scan tasks on nations as targets; line items as findings and documents."""
    targets = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("target_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("http://"), F.lower("n_name")).alias("url"))
    tasks = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("task_id"), F.col("s_nationkey").alias("target_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "running").otherwise("done").alias("status"))
    lines = table(spark, sf, "lineitem")
    info = lines.select(F.col("l_suppkey").alias("task_id"), F.col("l_returnflag").alias("kind"),
                        F.col("l_linestatus").alias("content"))
    findings = lines.where("l_quantity > 45").select(
        F.col("l_suppkey").alias("task_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"),
        F.when(F.col("l_linenumber") == 1, "critical").when(F.col("l_linenumber") <= 3, "high")
        .when(F.col("l_linenumber") <= 5, "mid").otherwise("low").alias("severity"),
        F.when(F.col("l_returnflag") == "A", "sqli").when(F.col("l_returnflag") == "N", "xss")
        .otherwise("cve_match").alias("vuln_type"))
    return targets, tasks, info, findings


def _counts_text(column):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query("task_bundle", "WITH " + TASKS_SQL + """
SELECT t.task_id, g.name AS target_name, g.url AS target_url, coalesce(f.n, 0) AS findings,
  coalesce((SELECT string_agg(kind || '=' || content, ',' ORDER BY kind) FROM info i
   WHERE i.task_id = t.task_id), '') AS info
FROM tasks t LEFT JOIN targets g USING (target_id) LEFT JOIN found f USING (task_id)""")
def bundle(spark, sf):
    targets, tasks, info, findings = _scan_tables(spark, sf)
    joined = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")
    return correlate.task_bundle(tasks, targets, findings, info).select(
        "task_id", "target_name", "target_url", "findings",
        F.coalesce(joined, F.lit("")).alias("info"))


@query("unreported_tasks", "WITH " + TASKS_SQL + """
SELECT task_id FROM tasks WHERE status = 'done'
  AND task_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
ORDER BY task_id DESC LIMIT 10""")
def unreported(spark, sf):
    reports_table = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("task_id"))
    return correlate.unreported_tasks(_scan_tables(spark, sf)[1], reports_table).select("task_id")


@query("scan_report_context", "WITH " + TASKS_SQL + """
, f AS (SELECT l_suppkey AS task_id, l_linenumber AS n, l_returnflag AS r FROM lineitem WHERE l_quantity > 45)
SELECT t.task_id, g.name || '（' || g.url || '）' AS target, count(f.n) AS findings,
  count(*) FILTER (WHERE n = 1) AS critical, count(*) FILTER (WHERE n IN (2, 3)) AS high,
  count(*) FILTER (WHERE n IN (4, 5)) AS mid, count(*) FILTER (WHERE n > 5) AS low,
  concat_ws(',', 'cve_match=' || nullif(count(*) FILTER (WHERE r NOT IN ('A', 'N')), 0),
    'sqli=' || nullif(count(*) FILTER (WHERE r = 'A'), 0), 'xss=' || nullif(count(*) FILTER (WHERE r = 'N'), 0)) AS by_type
FROM tasks t JOIN targets g USING (target_id) LEFT JOIN f USING (task_id) GROUP BY ALL""")
def report_context(spark, sf):
    targets, tasks, _, findings = _scan_tables(spark, sf)
    made = reports.scan_report_context(tasks, targets, findings)
    return made.withColumn("by_type", F.coalesce(_counts_text("by_type"), F.lit("")))


@query("cascade_delete", "WITH " + TASKS_SQL + """
, gone AS (SELECT target_id FROM targets WHERE target_id < 5 AND target_id NOT IN (
   SELECT target_id FROM tasks WHERE status = 'running')),
left_tasks AS (SELECT * FROM tasks WHERE target_id NOT IN (SELECT target_id FROM gone))
SELECT (SELECT count(*) FROM targets WHERE target_id NOT IN (SELECT target_id FROM gone))
  AS targets, (SELECT count(*) FROM left_tasks) AS tasks,
  (SELECT count(*) FROM lineitem WHERE l_quantity > 45 AND l_suppkey NOT IN (
    SELECT task_id FROM tasks WHERE target_id IN (SELECT target_id FROM gone))) AS findings""")
def cascade(spark, sf):
    from wardlog.operators.statistics import attach
    targets, tasks, info, findings = _scan_tables(spark, sf)
    kept = maintenance.drop_target(targets.where("target_id < 5"), targets, tasks, findings, info)
    row = kept["targets"].agg(F.count("*").alias("targets"))
    for name in ("tasks", "findings"):
        row = attach(row, kept[name].agg(F.count("*").alias(name)))
    return row


@query("retention", with_ev(f"""
stored AS (SELECT CASE WHEN k % 9 <> 4 THEN t END AS t FROM ev)""", f"""
SELECT coalesce(strftime(t, '%Y-%m-%d'), 'unknown') AS day, count(*) AS events FROM stored
WHERE t IS NULL OR t >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 14 DAY GROUP BY ALL"""))
def retention(spark, sf):
    """Events of an event table in which every ninth number has lost its time."""
    dated = events(spark, sf).withColumn("ts", F.when(F.col("k") % 9 != 4, F.col("ts"))).withColumn(
        tables.EVENT_DATE, F.to_date("ts"))
    return maintenance.retained(dated, as_of(), "14").groupBy(F.coalesce(
        F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")).alias("day")).agg(F.count("*").alias("events"))


# ------------------------------------------------------------------------------ geolocation

_BITS = {c: int(c.split("/")[1]) for c, *_ in ADDRESS_RANGES}
_RANGE_ROWS = ", ".join(
    f"({quoted(c.split('/')[0])}, {_BITS[c]}, {quoted(label)}, {quoted(p or '')}, '{cat}')"
    for c, label, p, cat in ADDRESS_RANGES)


def _number(column):
    return " + ".join(f"CAST(split_part({column}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}"
                      for i in range(4))


GEO_SQL = f"""
ranges AS (SELECT *, {_number('net')} AS lo
  FROM (VALUES {_RANGE_ROWS}) v(net, bits, label, province, category)),
located AS (SELECT w.*, coalesce(r.label, {quoted(UNKNOWN_LABEL)}) AS label,
    coalesce(r.province, '') AS province, coalesce(r.category, 'unknown') AS category
  FROM (SELECT *, {_number('src_ip')} AS n FROM weights) w
  LEFT JOIN ranges r ON n BETWEEN r.lo AND r.lo + CAST(pow(2, 32 - r.bits) AS BIGINT) - 1)"""
EVENT_WEIGHTS = "weights AS (SELECT src_ip, count(*) AS weight FROM ev GROUP BY src_ip)"


def _located(spark, sf):
    weights = events(spark, sf).groupBy("src_ip").agg(F.count("*").alias("weight"))
    return geo.locate(weights, geo.builtin_ranges(spark))


@query("ip_locations", with_ev(EVENT_WEIGHTS, GEO_SQL, """
SELECT src_ip, weight, label, province, category FROM located"""))
def locations(spark, sf):
    return _located(spark, sf).withColumn("province", F.coalesce("province", F.lit("")))


@query("source_categories", with_ev(EVENT_WEIGHTS, GEO_SQL, "SELECT category, CASE category "
       + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in CATEGORY_LABELS.items())
       + """ END AS category_label, CAST(sum(weight) AS BIGINT) AS weight
FROM located GROUP BY category"""))
def categories(spark, sf):
    return geo.category_weights(_located(spark, sf))


@query("source_provinces", with_ev(EVENT_WEIGHTS, GEO_SQL, """
SELECT province, CAST(sum(weight) AS BIGINT) AS weight FROM located
WHERE category = 'domestic' AND province <> '' GROUP BY province"""))
def provinces(spark, sf):
    return geo.province_weights(_located(spark, sf))


@query("source_overview", with_ev(EVENT_WEIGHTS, GEO_SQL, """
SELECT CAST(sum(weight) AS BIGINT) AS total,
  CAST(sum(weight) FILTER (WHERE category = 'domestic' AND province <> '') AS BIGINT) AS located,
  CAST(sum(weight) FILTER (WHERE category = 'unknown') AS BIGINT) AS unknown FROM located"""))
def source_overview(spark, sf):
    return geo.overview(_located(spark, sf))


@query("foreign_sources", with_ev(EVENT_WEIGHTS, GEO_SQL, """
SELECT src_ip, label, weight FROM located WHERE category IN ('overseas', 'unknown', 'reserved')
ORDER BY weight DESC, src_ip LIMIT 6"""))
def foreign(spark, sf):
    return geo.foreign_sources(_located(spark, sf))


# ------------------------------------------------------------------------------ dashboards

@query("top_error_burst_sources", with_ev(f"""
burst AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY epoch, seq)
   - count(*) OVER (PARTITION BY src_ip ORDER BY epoch RANGE BETWEEN UNBOUNDED PRECEDING
     AND {rule(13).window + 1} PRECEDING) AS cnt FROM ev WHERE status_code >= 400)""", f"""
alert AS (SELECT src_ip, sum(CASE WHEN prev IS NULL OR epoch - prev > {GAP} THEN 1 ELSE 0 END)
   AS alerts FROM (SELECT *, lag(epoch) OVER (PARTITION BY src_ip ORDER BY epoch) AS prev
     FROM burst WHERE cnt >= {rule(13).limit}) GROUP BY src_ip)""", """
SELECT src_ip, CAST(alerts AS BIGINT) AS alerts FROM alert ORDER BY alerts DESC, src_ip LIMIT 10"""))
def error_bursts(spark, sf):
    """Which sources produced consolidated error bursts? From text lines to the top list."""
    from wardlog.catalog.parsing import _parsed
    from wardlog.sources import logs
    parsed = logs.accepted(_parsed(spark, sf))
    bursts = detection.detect(parsed, [rule(13)])
    return reports.top_sources(consolidate(bursts, gap=GAP, samples=False))


@query("dashboard_counters", with_alerts(f"""
SELECT (SELECT count(*) FROM ev) AS total_events,
  (SELECT count(*) FROM ev WHERE t >= TIMESTAMP '2024-01-20 00:00:00') AS today_events,
  (SELECT count(*) FROM supplier) AS sources,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS active_sources,
  count(*) AS total_alerts, count(*) FILTER (WHERE status = 'new') AS new_alerts,
  count(*) FILTER (WHERE severity = 'high') AS high_alerts FROM alerts"""))
def dashboard(spark, sf):
    now = F.lit("2024-01-20 15:30:00").cast("timestamp_ntz")
    return reports.overview(events(spark, sf), _scan_tables(spark, sf)[1], alerts(spark, sf), now)


@query("hourly_alerts", with_alerts(f"""
spine AS (SELECT {AS_OF_EPOCH} - 3600 * i AS hour FROM range(48) r(i))""", """
SELECT hour, strftime(make_timestamp(hour * 1000000), '%m-%d %H:00') AS label,
  (SELECT count(*) FROM alerts a WHERE CAST(floor(a.first_seen / 3600) * 3600 AS BIGINT) = hour)
  AS count FROM spine"""))
def hourly(spark, sf):
    return reports.hourly_series(alerts(spark, sf), as_of(), 48)


@query("top_sources", with_alerts("""
SELECT src_ip, count(*) AS alerts FROM alerts GROUP BY src_ip ORDER BY alerts DESC, src_ip LIMIT 10
"""))
def top_sources(spark, sf):
    return reports.top_sources(alerts(spark, sf))


@query("severity_distribution", with_alerts("""
SELECT severity, count(*) AS alerts FROM alerts GROUP BY severity"""))
def severities(spark, sf):
    return reports.severity_distribution(alerts(spark, sf))


@query("weighted_sources", with_alerts("""
SELECT src_ip, CAST(sum(count) AS BIGINT) AS weight FROM alerts GROUP BY src_ip"""))
def weights(spark, sf):
    return reports.weighted_sources(alerts(spark, sf))


@query("posture", with_alerts(FINDINGS_SQL, RELATED_SQL, """
SELECT (SELECT count(*) FROM alerts) AS alerts,
  (SELECT count(*) FROM alerts WHERE status = 'new') AS new_alerts,
  (SELECT count(DISTINCT src_ip) FROM alerts) AS attack_ips,
  (SELECT count(*) FROM findings) AS scan_findings,
  (SELECT count(DISTINCT finding_id) FROM matched) AS exploited,
  (SELECT count(*) FROM events WHERE value >= 60) AS ml_anomalies"""))
def posture(spark, sf):
    findings = _findings(spark, sf)
    detections = events(spark, sf).select((F.col("value") / 100).alias("anomaly_score"))
    return reports.posture(alerts(spark, sf), findings, correlate.exploited(
        findings, events(spark, sf), as_of(), HOURS), detections)


_RECENT = f"recent AS (SELECT * FROM alerts WHERE last_seen >= {AS_OF_EPOCH - HOURS * 3600})"


@query("daily_counts", with_alerts(_RECENT, """
SELECT count(*) AS alerts, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'mid')
  AS mid, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE status = 'new') AS new, count(DISTINCT src_ip) AS source_ips
FROM recent"""))
def daily(spark, sf):
    return reports.daily_counts(alerts(spark, sf), as_of(), HOURS)


@query("daily_rules", with_alerts(_RECENT, """
SELECT title, count(*) AS alerts FROM recent GROUP BY title ORDER BY alerts DESC, title LIMIT 10"""))
def daily_rules(spark, sf):
    return reports.daily_rules(alerts(spark, sf), as_of(), HOURS)


@query("daily_samples", with_alerts(_RECENT, """
SELECT last_seen, '[' || severity || '] ' || title || ' 来源 ' || src_ip
  || CASE WHEN coalesce(url, '') <> '' THEN ' 目标 ' || left(url, 80) ELSE '' END
  || CASE WHEN count > 1 THEN '（合并计数 ' || CAST(count AS VARCHAR) || ' 次）' ELSE '' END AS line
FROM recent ORDER BY last_seen DESC, title, src_ip, first_seen LIMIT 8"""))
def daily_lines(spark, sf):
    return reports.daily_samples(alerts(spark, sf), as_of(), HOURS)


_SCAN = """
f AS (SELECT l_suppkey AS task_id, l_orderkey * 10 + l_linenumber AS finding_id,
  CASE WHEN l_linenumber = 1 THEN 'critical' WHEN l_linenumber <= 3 THEN 'high'
       WHEN l_linenumber <= 5 THEN 'mid' ELSE 'low' END AS severity,
  CASE l_returnflag WHEN 'A' THEN 'sqli' WHEN 'N' THEN 'xss' ELSE 'cve_match' END AS vuln_type
  FROM lineitem WHERE l_quantity > 45)"""


def _scan_findings(spark, sf):
    return _scan_tables(spark, sf)[3]


@query("findings_summary", "WITH " + _SCAN + """
SELECT task_id, count(*) AS total,
  (SELECT string_agg(severity || '=' || CAST(n AS VARCHAR), ',' ORDER BY severity) FROM (
    SELECT severity, count(*) AS n FROM f i WHERE i.task_id = f.task_id GROUP BY severity))
  AS by_severity,
  (SELECT string_agg(vuln_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY vuln_type) FROM (
    SELECT vuln_type, count(*) AS n FROM f i WHERE i.task_id = f.task_id GROUP BY vuln_type))
  AS by_type FROM f GROUP BY task_id""")
def scan_summary(spark, sf):
    return reports.findings_summary(_scan_findings(spark, sf), "task_id").select(
        "task_id", "total", _counts_text("by_severity").alias("by_severity"), _counts_text("by_type").alias("by_type"))


@query("severity_order", "WITH " + _SCAN + """
, o AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'mid' THEN 2
  ELSE 3 END AS rank FROM f)
SELECT finding_id, severity, rank FROM o ORDER BY rank, finding_id LIMIT 25""")
def severity_order(spark, sf):
    return reports.by_severity_order(_scan_findings(spark, sf)).limit(25).select(
        "finding_id", "severity", reports.severity_rank(F.col("severity")).alias("rank"))


@query("overall_risk", "WITH " + _SCAN + """
SELECT task_id, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'mid' THEN 2
  ELSE 3 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'mid' ELSE 'low' END AS risk
FROM f GROUP BY task_id""")
def risk(spark, sf):
    return reports.risk_of(_scan_findings(spark, sf), "task_id")


_ZH = "CASE severity " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY_LABELS.items()) + " END"


@query("summary_line", "WITH " + _SCAN + f"""
, c AS (SELECT task_id, severity, {_ZH} AS zh, count(*) AS n, CASE severity WHEN 'critical' THEN 0
   WHEN 'high' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END AS rank FROM f GROUP BY ALL)
SELECT task_id, CAST(sum(n) AS BIGINT) AS total, '共发现 ' || CAST(sum(n) AS VARCHAR) || ' 个问题（'
  || string_agg(zh || ' ' || CAST(n AS VARCHAR), '、' ORDER BY rank) || '），整体风险：'
  || first(zh ORDER BY rank) AS line FROM c GROUP BY task_id""")
def line(spark, sf):
    return reports.summary_line(_scan_findings(spark, sf), "task_id")


@query("stratified_cases", with_ev("""
a AS (SELECT seq AS alert_id, ['critical', 'high', 'mid', 'low'][k % 4 + 1] AS severity, k % 4 AS r,
   'rule ' || CAST(k % 9 AS VARCHAR) AS title FROM ev)""", """
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY alert_id DESC) AS n
   FROM a) WHERE n <= 12)""", """
e AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY r, n) AS m FROM d)""", """
SELECT alert_id, severity, title FROM e WHERE m <= 2 ORDER BY r, n LIMIT 10"""))
def cases(spark, sf):
    names = F.array(*[F.lit(s) for s in ("critical", "high", "mid", "low")])
    rows = events(spark, sf).select(
        F.col("seq").alias("alert_id"), F.element_at(names, F.col("k") % 4 + 1).alias("severity"),
        F.concat(F.lit("rule "), (F.col("k") % 9).cast("string")).alias("title"))
    return reports.stratified_cases(rows, 10)


@query("latest_record", """
SELECT o_custkey AS custkey, o_orderkey AS id, o_orderstatus AS status FROM (SELECT *,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1
""")
def latest(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col(
        "o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return reports.latest_per(rows, ["custkey"])


@query("feed_tail", with_ev("""
SELECT seq, log_type FROM ev WHERE seq > 100 ORDER BY seq DESC LIMIT 100"""))
def tail(spark, sf):
    return feed.snapshot_after(events(spark, sf).select("seq", "log_type"), 100, 100)


# ------------------------------------------------------------------------------ quality

SEGMENT_SQL = """
seg AS (SELECT *, ['normal', 'edge', 'burst', 'attack'][CAST(user_id % 4 AS INTEGER) + 1]
  AS segment FROM ev)"""


def _segment():
    return F.element_at(F.array(*[F.lit(s) for s in ("normal", "edge", "burst", "attack")]),
                        (F.col("user_id") % 4 + 1).cast("int"))


def _segments(spark, sf):
    own = events(spark, sf)
    lines = own.select("seq", _segment().alias("segment"))
    found = hits(spark, sf).join(lines, "seq")
    return quality.segment_hits(found, lines), found


_SEG_HITS = """
seg_hits AS (SELECT s.segment, h.rule_name FROM hits h JOIN seg s USING (seq))"""


@query("segment_hits", with_alerts(SEGMENT_SQL, _SEG_HITS, """
SELECT segment, (SELECT count(*) FROM seg s WHERE s.segment = h.segment) AS lines,
  count(*) AS hits, count(DISTINCT rule_name) AS rules FROM seg_hits h GROUP BY segment"""))
def segment_hits(spark, sf):
    return _segments(spark, sf)[0].withColumn("rules", F.size("rules").cast("bigint"))


@query("false_positive_rates", with_alerts(SEGMENT_SQL, _SEG_HITS, """
n AS (SELECT segment, count(*) AS lines, (SELECT count(*) FROM seg_hits h
  WHERE h.segment = seg.segment) AS hits FROM seg GROUP BY segment)""", """
SELECT round(sum(hits) FILTER (WHERE segment = 'normal') / sum(lines) FILTER (
    WHERE segment = 'normal'), 6) AS fp_rate_normal,
  round(sum(hits) FILTER (WHERE segment = 'burst') / sum(lines) FILTER (WHERE segment = 'burst'), 6)
    AS fp_rate_burst,
  round(sum(hits) FILTER (WHERE segment IN ('normal', 'edge')) / sum(lines) FILTER (
    WHERE segment IN ('normal', 'edge')), 6) AS fp_rate_combined,
  CAST(sum(lines) FILTER (WHERE segment IN ('normal', 'edge')) AS BIGINT) AS combined_lines,
  CAST(sum(hits) FILTER (WHERE segment IN ('normal', 'edge')) AS BIGINT) AS combined_hits
FROM n"""))
def fp_rates(spark, sf):
    rates = quality.false_positive_rates(_segments(spark, sf)[0])
    return rates.select(*[F.round(c, 6).alias(c) if c.startswith("fp") else c
                          for c in rates.columns])


_KEYWORDS = ("SQL 注入", "暴力破解", "XSS", "错误响应")


@query("rule_recall", with_alerts(SEGMENT_SQL, _SEG_HITS, f"""
want AS (SELECT DISTINCT segment, unnest([{', '.join(quoted(k) for k in _KEYWORDS)}]) AS keyword
  FROM seg)""", """
chk AS (SELECT w.*, EXISTS (SELECT 1 FROM seg_hits h WHERE h.segment = w.segment
  AND contains(h.rule_name, w.keyword)) AS found FROM want w)""", """
SELECT segment AS scenario, count(*) AS expected, count(*) FILTER (WHERE found) AS hit,
  coalesce(string_agg(CASE WHEN NOT found THEN keyword END, ',' ORDER BY keyword), '') AS missed
FROM chk GROUP BY segment"""))
def recall(spark, sf):
    fired = _segments(spark, sf)[1].select(F.col("segment").alias("scenario"), "rule_name")
    expected = events(spark, sf).select(_segment().alias("scenario")).distinct().select(
        "scenario", F.explode(F.array(*[F.lit(k) for k in _KEYWORDS])).alias("keyword"))
    return quality.rule_recall(fired, expected).withColumn("missed", F.array_join("missed", ","))


_SCENARIO = "CASE log_type WHEN 'ssh' THEN 'ssh_bruteforce' WHEN 'scan' THEN 'port_scan' ELSE 'web_attack' END"


@query("expected_rules", with_ev(HITS, f"""
want(scenario, keyword) AS (VALUES {', '.join(f"('{s}', {quoted(k)})" for s, k in EXPECTED_RULES)})""", f"""
fired AS (SELECT DISTINCT {_SCENARIO} AS scenario, rule_name FROM hits JOIN ev USING (seq))""", """
chk AS (SELECT w.*, EXISTS (SELECT 1 FROM fired f WHERE f.scenario = w.scenario
  AND contains(f.rule_name, w.keyword)) AS found FROM want w)""", """
SELECT scenario, count(*) AS expected, count(*) FILTER (WHERE found) AS hit,
  coalesce(string_agg(CASE WHEN NOT found THEN keyword END, ',' ORDER BY keyword), '') AS missed
FROM chk GROUP BY scenario"""))
def expected(spark, sf):
    """The fixed expectations per attack scenario, scenarios being the kinds of lines."""
    kind = F.col("log_type")
    scenario = F.when(kind == "ssh", "ssh_bruteforce").when(kind == "scan", "port_scan").otherwise("web_attack")
    lines = events(spark, sf).select("seq", scenario.alias("scenario"))
    fired = hits(spark, sf).join(lines, "seq").select("scenario", "rule_name")
    return quality.rule_recall(fired, quality.expected_rules(spark)).withColumn("missed", F.array_join("missed", ","))


_LEVEL = "CASE " + " ".join(f"WHEN contains(low, {quoted(a)}) THEN '{v}'"
                            for a, v in SEVERITY_ALIASES) + " END"
OUTPUT_SQL = f"""
o AS (SELECT conv_id, turn, text AS output, lower(trim(text)) AS low,
  ['critical', 'high', 'mid', 'low'][CAST(conv_id % 4 AS INTEGER) + 1] AS rule_severity,
  CASE WHEN role = 'user' THEN 'v1' ELSE 'v2' END AS variant FROM conversations),
lv AS (SELECT *, {_LEVEL} AS level FROM o),
ds AS (SELECT *, abs(list_position(['critical', 'high', 'mid', 'low', 'info'], level)
  - list_position(['critical', 'high', 'mid', 'low', 'info'], rule_severity)) AS d FROM lv)"""


def _outputs(spark, sf):
    severities = F.array(*[F.lit(s) for s in ("critical", "high", "mid", "low")])
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("output"),
        F.element_at(severities, (F.col("conv_id") % 4 + 1).cast("int")).alias("rule_severity"),
        F.when(F.col("role") == "user", "v1").otherwise("v2").alias("variant"))


@query("severity_levels", "WITH " + OUTPUT_SQL + """
SELECT coalesce(level, '') AS level, coalesce(d, -1) AS distance, count(*) AS outputs FROM ds
GROUP BY ALL""")
def levels(spark, sf):
    level = quality.severity_level(F.col("output"))
    distance = quality.severity_distance(level, F.col("rule_severity"))
    return _outputs(spark, sf).groupBy(
        F.coalesce(level, F.lit("")).alias("level"),
        F.coalesce(distance, F.lit(-1)).alias("distance")).agg(F.count("*").alias("outputs"))


_AGREE = """count(*) AS total, count(*) FILTER (WHERE d = 0) AS strict,
  count(*) FILTER (WHERE d <= 1) AS loose, count(*) FILTER (WHERE d IS NULL) AS unrecognized,
  round(count(*) FILTER (WHERE d = 0) / count(*), 4) AS strict_rate,
  round(count(*) FILTER (WHERE d <= 1) / count(*), 4) AS loose_rate"""


@query("severity_agreement", "WITH " + OUTPUT_SQL + f"""
SELECT variant, {_AGREE} FROM ds GROUP BY variant""")
def agreement(spark, sf):
    return quality.agreement(_outputs(spark, sf), "variant")


_REQUIRED = ("the", "and")


@query("section_usability", "WITH " + OUTPUT_SQL + """
SELECT variant, count(*) AS total, count(*) FILTER (WHERE trim(output) <> ''
  AND contains(output, 'the') AND contains(output, 'and')) AS usable,
  round(count(*) FILTER (WHERE trim(output) <> '' AND contains(output, 'the')
  AND contains(output, 'and')) / count(*), 4) AS rate FROM o GROUP BY variant""")
def usability(spark, sf):
    return quality.usability(_outputs(spark, sf), _REQUIRED, "variant")


@query("variant_comparison", "WITH " + OUTPUT_SQL + """
, r AS (SELECT variant, round(count(*) FILTER (WHERE d = 0) / count(*), 4) AS s,
   round(count(*) FILTER (WHERE d <= 1) / count(*), 4) AS l,
   round(count(*) FILTER (WHERE contains(output, 'the') AND contains(output, 'and')) / count(*), 4)
   AS u FROM ds GROUP BY variant)
SELECT 'v1' AS label_a, 'v2' AS label_b, a.s AS strict_rate_a, b.s AS strict_rate_b,
  a.l AS loose_rate_a, b.l AS loose_rate_b, a.u AS usability_rate_a, b.u AS usability_rate_b,
  round(b.s - a.s, 4) AS delta_strict, round(b.l - a.l, 4) AS delta_loose,
  round(b.u - a.u, 4) AS delta_usability FROM r a, r b
WHERE a.variant = 'v1' AND b.variant = 'v2'""")
def variants(spark, sf):
    return quality.compare_variants(_outputs(spark, sf), _REQUIRED)


def _replies(spark, sf):
    """Conversation turns wrapped the way replies arrive: fenced, bare, incomplete, or not JSON."""
    payload = F.to_json(F.struct(
        F.col("rule_severity").alias("severity_assessment"),
        F.col("output").alias("analysis"),
        F.when(F.col("turn") % 3 == 1, " ").otherwise("fix").alias("recommendation")))
    form = F.col("conv_id") % 4
    return _outputs(spark, sf).withColumn("reply_text", F.when(
        form == 0, F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
        .when(form == 1, F.concat(F.lit("see: "), payload, F.lit(" end")))
        .when(form == 2, payload).otherwise(F.concat(F.lit("{not json "), F.col("variant"))))


@query("structured_usability", "WITH " + OUTPUT_SQL + """
SELECT variant, count(*) AS total, count(*) FILTER (WHERE conv_id % 4 <> 3 AND turn % 3 <> 1)
  AS usable, round(count(*) FILTER (WHERE conv_id % 4 <> 3 AND turn % 3 <> 1) / count(*), 4) AS rate
FROM o GROUP BY variant""")
def structured(spark, sf):
    rows = _replies(spark, sf).drop("output").withColumnRenamed("reply_text", "output")
    return quality.structured_usability(rows, quality.REVIEW_FIELDS, "variant")


@query("parsed_replies", "WITH " + OUTPUT_SQL + """
SELECT conv_id, turn, conv_id % 4 = 3 AS parse_error,
  CASE WHEN conv_id % 4 = 3 THEN '' ELSE rule_severity || chr(10) || output || chr(10)
    || CASE WHEN turn % 3 = 1 THEN ' ' ELSE 'fix' END END AS flat FROM o""")
def replies(spark, sf):
    parsed = quality.parse_reply(_replies(spark, sf).drop("raw"), "reply_text")
    return parsed.select("conv_id", "turn", "parse_error",
                         quality.flatten_reply(F.col("reply")).alias("flat"))


@query("run_summary", """
WITH r AS (SELECT o_orderpriority AS model, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok'
  END AS status, o_orderkey % 900 AS p, o_custkey % 300 AS c, o_totalprice / 1e5 AS e FROM orders)
SELECT model, count(*) AS calls, count(*) FILTER (WHERE status = 'ok') AS succeeded,
  round(count(*) FILTER (WHERE status = 'ok') / count(*), 4) AS success_rate,
  round(avg(p + c) FILTER (WHERE status = 'ok'), 1) AS avg_tokens,
  round(avg(e) FILTER (WHERE status = 'ok'), 2) AS avg_elapsed,
  round(sum(p + c) FILTER (WHERE status = 'ok') / 1000000 * 1.5, 4) AS cost
FROM r GROUP BY model""")
def runs(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"),
        (F.col("o_orderkey") % 900).alias("prompt_tokens"),
        (F.col("o_custkey") % 300).alias("completion_tokens"),
        (F.col("o_totalprice") / 1e5).alias("elapsed"))
    tokens = rows.where("status = 'ok'").groupBy("model").agg(quality.cost(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))).alias("cost"))
    return quality.run_summary(rows, "model").join(tokens, "model")


@query("markdown_headings", """
SELECT doc_id, unnest(regexp_extract_all('# ' || replace(text, chr(10) || chr(10),
  chr(10) || '## '), '(?m)^#{1,6}\\s*(.+)$', 1)) AS heading FROM documents""")
def headings(spark, sf):
    """Documents with their paragraphs turned into sections."""
    marked = F.concat(F.lit("# "), F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n## ")))
    return table(spark, sf, "documents").select(
        "doc_id", F.explode(quality.headings(marked)).alias("heading"))
