"""Queries: event filters, signatures, the fifteen rules, alerts."""

import uuid

from pyspark.sql import functions as F

from wardlog.catalog.base import (AS_OF_EPOCH, DAY, GAP, HITS, SEQUENCE_SQL, SQL_FILTERS, alerts, events, hits, query, quoted, rule,
                                  rules, sql_class, sql_count_hits, sql_decoded, sql_matches,
                                  sql_text, table, with_alerts, with_ev)
from wardlog.constants import SIGNATURE_LABELS, SIGNATURES
from wardlog.functions import filters, signatures
from wardlog.functions.text import clip, decode_once, field_text
from wardlog.operators import alerts as alert_ops
from wardlog.plans import detection, importing, reports
from wardlog.session import materialise, shared_folder
from wardlog.sources import fixtures, logs, tables
from wardlog.sources.commits import Folder
from wardlog.sources.rules import (Rule, builtin_rules, reset_builtin, rule_problems,
                                   rules_frame)

# ------------------------------------------------------------------------------ event filters

for _name, _test in SQL_FILTERS.items():
    @query(f"filter_{_name}", with_ev(f"""
SELECT src_ip, count(*) AS events FROM ev WHERE {_test} GROUP BY src_ip"""))
    def _filter(spark, sf, name=_name):
        return events(spark, sf).where(filters.event_filter(name)).groupBy("src_ip").agg(
            F.count("*").alias("events"))


@query("failure_predicate", with_ev("""
SELECT log_type, count(*) FILTER (WHERE coalesce(outcome = 'failed', false)
       OR coalesce(status_code >= 400, false)) AS failures, count(*) AS events
FROM ev GROUP BY log_type"""))
def failures(spark, sf):
    return events(spark, sf).groupBy("log_type").agg(
        F.count_if(filters.is_failure()).alias("failures"), F.count("*").alias("events"))


@query("field_text", with_ev(f"""
SELECT log_type, CAST(sum(length({sql_text('url')})) AS BIGINT) AS url_chars,
       CAST(sum(length({sql_text('any')})) AS BIGINT) AS any_chars,
       CAST(sum(length(coalesce({sql_text('user_agent')}, ''))) AS BIGINT) AS agent_chars
FROM ev GROUP BY log_type"""))
def texts(spark, sf):
    return events(spark, sf).groupBy("log_type").agg(
        F.sum(F.length(field_text("url"))).alias("url_chars"),
        F.sum(F.length(field_text("any"))).alias("any_chars"),
        F.sum(F.length(field_text("user_agent"))).alias("agent_chars"))


@query("event_search", with_ev("""
SELECT seq, epoch, src_ip, raw FROM ev WHERE log_type = 'web' AND contains(src_ip, '10.0.')
  AND (contains(lower(url), 'union_') OR contains(lower(raw), 'curl'))
  AND t >= TIMESTAMP '2024-01-05 00:00:00' AND t <= TIMESTAMP '2024-01-25 23:59:59'
ORDER BY seq DESC LIMIT 100"""))
def event_search(spark, sf):
    return reports.search_events(events(spark, sf), log_type="web", src_ip="10.0.", keyword="CURL",
                                 date_from="2024-01-05", date_to="2024-01-25").select(
        "seq", "epoch", "src_ip", "raw")


# ------------------------------------------------------------------------------ signatures

for _name in SIGNATURES:
    @query(f"signature_{_name}", with_ev(f"""
SELECT log_type, src_ip, count(*) AS events FROM ev WHERE {sql_class(sql_text('any'), _name)}
GROUP BY log_type, src_ip"""))
    def _signature(spark, sf, name=_name):
        return (signatures.of_class(events(spark, sf), field_text("any"), name)
                .groupBy("log_type", "src_ip").agg(F.count("*").alias("events")))


@query("url_decode_once", with_ev(f"""
SELECT url, {sql_decoded('url')} AS decoded, count(*) AS events FROM ev
WHERE url IS NOT NULL GROUP BY url"""))
def decoded(spark, sf):
    return (events(spark, sf).where("url is not null").groupBy("url")
            .agg(F.count("*").alias("events")).withColumn("decoded", decode_once(F.col("url"))))


_FIRST = "CASE " + " ".join(
    f"WHEN {sql_class('url', n)} THEN '{n}'" for n in SIGNATURES) + " ELSE '' END"
_ORDERED = "CASE " + " ".join(
    f"WHEN {sql_class('raw', n)} THEN '{n}'" for n in ("traversal", "xss", "sqli")) + " ELSE '' END"


@query("first_matching_class", with_ev(f"""
SELECT {_FIRST} AS first_class, {_ORDERED} AS ordered_class, count(*) AS events
FROM ev WHERE url IS NOT NULL GROUP BY ALL"""))
def first_class(spark, sf):
    own = signatures.with_first_class(events(spark, sf).where("url is not null"), F.col("url"),
                                      "first_class")
    return (signatures.with_first_class(own, F.col("raw"), "ordered_class",
                                        ("traversal", "xss", "sqli"))
            .groupBy("first_class", "ordered_class").agg(F.count("*").alias("events")))


@query("all_matching_classes", with_ev("""
hit AS (""" + " UNION ALL ".join(
    f"SELECT src_ip, '{n}' AS class FROM ev WHERE {sql_class(sql_text('any'), n)}"
    for n in SIGNATURES) + ")", """
SELECT src_ip, class, count(*) AS events FROM hit GROUP BY src_ip, class"""))
def every_class(spark, sf):
    return (signatures.explode_classes(events(spark, sf), field_text("any"), "class")
            .groupBy("src_ip", "class").agg(F.count("*").alias("events")))


_CUSTOM = r"shadow|id=\d{5,}|angelo"


@query("custom_pattern", with_ev(f"""
SELECT seq, url FROM ev WHERE url IS NOT NULL AND {sql_matches(sql_text('url'), _CUSTOM)}"""))
def custom(spark, sf):
    text = field_text("url")
    both = (signatures.custom_match(text, _CUSTOM) | signatures.custom_match(text, "("))
    return events(spark, sf).where(F.col("url").isNotNull() & both).select("seq", "url")


@query("class_labels", with_ev(f"""
SELECT {_FIRST} AS class, CASE {_FIRST} """ + " ".join(
    f"WHEN '{k}' THEN {quoted(v)}" for k, v in SIGNATURE_LABELS.items()) + """ ELSE '—' END AS label,
       count(*) AS events FROM ev WHERE url IS NOT NULL GROUP BY ALL"""))
def labels(spark, sf):
    own = events(spark, sf).where("url is not null")
    return (signatures.with_first_class(own, F.col("url"), "class").groupBy("class")
            .agg(F.count("*").alias("events"))
            .withColumn("label", signatures.class_label(F.col("class"))))


_CLASSES = ("sqli", "xss", "traversal", "cmdi", "sensitive_path", "double_encode", "other")
_LABELLED = "['" + "', '".join(_CLASSES) + "'][k % 7 + 1]"


@query("signature_audit", with_ev(f"""
labelled AS (SELECT url, {_LABELLED} AS cls FROM ev WHERE url IS NOT NULL)""", """
SELECT url, cls, CASE WHEN cls = 'other' THEN 'no signature for this class'
       ELSE 'not matched by its signature' END AS reason, count(*) AS requests
FROM labelled WHERE NOT (CASE cls """ + " ".join(
    f"WHEN '{n}' THEN {sql_class('url', n)}" for n in _CLASSES[:-1])
    + " ELSE false END) GROUP BY url, cls"))
def audit(spark, sf):
    """Requests labelled with a class that often is not theirs."""
    cls = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), F.col("k") % 7 + 1)
    requests = events(spark, sf).where("url is not null").withColumn("cls", cls)
    return signatures.audit_requests(requests).groupBy("url", "cls", "reason").agg(
        F.count("*").alias("requests"))


@query("evidence_clip", """
SELECT doc_id, CASE WHEN length(trim(text)) > 200 THEN left(trim(text), 200) || '…'
       ELSE trim(text) END AS clipped FROM documents""")
def clipped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clip(F.col("text"), 200).alias("clipped"))


# ------------------------------------------------------------------------------ rules

_RULE_NAMES = {
    1: "ssh_brute_force", 2: "ssh_user_enumeration", 3: "login_after_brute_force",
    4: "port_diversity", 5: "stealth_flags", 6: "scanner_agent", 7: "sensitive_path",
    8: "sql_injection", 9: "xss", 10: "path_traversal", 11: "command_injection",
    12: "double_encoding", 13: "error_burst", 14: "request_rate", 15: "short_agent_post",
}

def _rule_sql(r: Rule) -> str:
    if r.rule_type == "regex":
        if r.pattern in SQL_FILTERS:
            return with_ev(f"SELECT seq, epoch, src_ip FROM ev WHERE {SQL_FILTERS[r.pattern]}")
        test = sql_class(sql_text(r.match_field), r.pattern)
        return with_ev(f"SELECT seq, epoch, src_ip FROM ev WHERE coalesce({test}, false)")
    if r.rule_type == "composite":
        body = SEQUENCE_SQL.format(window=r.window, limit=r.limit)
        return with_ev(body, "SELECT seq, epoch, src_ip, prior AS prior_fails FROM walk "
                             "WHERE prior > 0")
    if r.count_mode == "distinct":
        return with_ev("own AS (SELECT seq, epoch, src_ip, dst_port FROM ev "
                       f"WHERE {SQL_FILTERS[r.pattern]})", f"""
SELECT a.seq, a.epoch, a.src_ip, count(DISTINCT b.dst_port) AS count
FROM own a JOIN own b ON a.src_ip = b.src_ip AND b.epoch BETWEEN a.epoch - {r.window} AND a.epoch
  AND (b.epoch < a.epoch OR b.seq <= a.seq)
GROUP BY a.seq, a.epoch, a.src_ip HAVING count(DISTINCT b.dst_port) >= {r.limit}""")
    return with_ev(f"SELECT seq, epoch, src_ip, cnt AS count FROM ("
                   f"{sql_count_hits(SQL_FILTERS[r.pattern], r.window, r.limit)})")


for _number, _name in _RULE_NAMES.items():
    @query(f"rule_{_name}", _rule_sql(rule(_number)))
    def _rule(spark, sf, number=_number):
        r = rule(number)
        extra = {"aggregate": ["count"], "composite": ["prior_fails"]}.get(r.rule_type, [])
        return detection.detect(events(spark, sf), [r]).select("seq", "epoch", "src_ip", *extra)


@query("rule_fan_out", with_ev(
    SEQUENCE_SQL.format(window=rule(3).window, limit=rule(3).limit),
    "SELECT * FROM (" + "\nUNION ALL ".join(
        f"SELECT {n} AS rule_id, {quoted(rule(n).name)} AS rule_name, '{rule(n).severity}' AS "
        "severity, count(*) AS hits, count(DISTINCT src_ip) AS sources FROM ("
        + (f"SELECT src_ip FROM ev WHERE {SQL_FILTERS[rule(n).pattern]}"
           if rule(n).rule_type == "regex" and rule(n).pattern in SQL_FILTERS
           else f"SELECT src_ip FROM ev WHERE "
                f"{sql_class(sql_text(rule(n).match_field), rule(n).pattern)}"
           if rule(n).rule_type == "regex"
           else "SELECT src_ip FROM walk WHERE prior > 0" if n == 3
           else f"SELECT a.src_ip FROM ev a JOIN ev b ON a.src_ip = b.src_ip AND a.log_type = "
                f"'scan' AND b.log_type = 'scan' AND b.epoch BETWEEN a.epoch - {rule(n).window} "
                f"AND a.epoch AND (b.epoch < a.epoch OR b.seq <= a.seq) GROUP BY a.seq, a.src_ip "
                f"HAVING count(DISTINCT b.dst_port) >= {rule(n).limit}" if n == 4
           else f"SELECT src_ip FROM ("
                f"{sql_count_hits(SQL_FILTERS[rule(n).pattern], rule(n).window, rule(n).limit)})")
        + ")" for n in _RULE_NAMES) + ") WHERE hits > 0"))
def fan_out(spark, sf):
    """All fifteen rules in one job."""
    return detection.detect(events(spark, sf), rules()).groupBy(
        "rule_id", "rule_name", "severity").agg(
        F.count("*").alias("hits"), F.count_distinct("src_ip").alias("sources"))


@query("hit_records", with_ev(HITS, """
SELECT seq, rule_id, rule_name, category, severity, matched_text, coalesce(cnt, -1) AS count
FROM hits"""))
def hit_records(spark, sf):
    return hits(spark, sf).select("seq", "rule_id", "rule_name", "category", "severity",
                                  "matched_text", F.coalesce("count", F.lit(-1)).alias("count"))


@query("rule_dry_run", with_ev(f"""
SELECT seq, NOT (k % 7 = 3) AS parsed,
       NOT (k % 7 = 3) AND {sql_class(sql_text('url'), 'traversal')} AS matched,
       NOT (k % 7 = 3) AND {SQL_FILTERS['ssh_failed']} AS counted FROM ev"""))
def dry_run(spark, sf):
    """The same lines against a signature rule and a count rule."""
    source = events(spark, sf).select("seq", F.when(F.col("k") % 7 == 3, F.substring("raw", 1, 24))
                                      .otherwise(F.col("raw")).alias("value"))
    parsed = logs.parse(source, year=fixtures.YEAR, keep=("seq",))
    one = detection.dry_run(parsed, rule(10)).select("seq", "parsed", "matched")
    two = detection.dry_run(parsed, rule(1)).select("seq", "counted")
    return one.join(two, "seq")


@query("run_counters", with_alerts("""
SELECT (SELECT count(*) FROM ev) AS processed, (SELECT count(*) FROM hits) AS matched,
       (SELECT count(*) FROM alerts) AS alerts"""))
def counters(spark, sf):
    made = alerts(spark, sf).agg(F.count("*").alias("alerts"), F.sum("count").alias("matched"))
    seen = events(spark, sf).agg(F.count("*").alias("processed"))
    from wardlog.operators.statistics import attach
    return attach(seen, made)


_PATTERNS = ("sqli", "", "ssh_failed", "a(b", r"\d+")


def _rule_table(spark, sf):
    """Rules derived from the part table, many of them faulty."""
    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("name"),
        F.lit("custom").alias("category"),
        pick(("high", "mid", "low", "info", "urgent"), F.col("p_size") % 5).alias("severity"),
        pick(("regex", "aggregate", "composite", "macro"), F.col("p_partkey") % 4)
        .alias("rule_type"),
        pick(_PATTERNS, F.floor(F.col("p_partkey") / 4) % 5).alias("pattern"),
        F.lit("any").alias("match_field"), F.col("p_size").alias("threshold"),
        F.lit(60).alias("time_window"), F.lit("src_ip").alias("group_field"),
        (F.col("p_size") % 2 == 0).alias("enabled"))


@query("rule_validity", """
WITH r AS (SELECT p_partkey AS id, ['high','mid','low','info','urgent'][p_size % 5 + 1] AS severity,
  ['regex','aggregate','composite','macro'][CAST(p_partkey % 4 AS INTEGER) + 1] AS rule_type,
  ['sqli','','ssh_failed','a(b','\\d+'][CAST(floor(p_partkey / 4) % 5 AS INTEGER) + 1] AS pattern,
  p_size AS threshold FROM part)
SELECT CAST(id AS INTEGER) AS id, concat_ws('; ',
  CASE WHEN severity = 'urgent' THEN 'unknown severity' END,
  CASE WHEN rule_type = 'macro' THEN 'unknown rule type' END,
  CASE WHEN rule_type = 'aggregate' AND pattern = '' THEN 'aggregate rule without event filter' END,
  CASE WHEN rule_type = 'regex' AND pattern = '' THEN 'regex rule without pattern' END,
  CASE WHEN rule_type = 'regex' AND pattern = 'a(b' THEN 'pattern does not compile' END,
  CASE WHEN rule_type IN ('aggregate','composite') AND threshold < 1
       THEN 'threshold and window must be positive' END) AS problems FROM r""")
def validity(spark, sf):
    return rule_problems(_rule_table(spark, sf)).select(
        "id", F.array_join("problems", "; ").alias("problems"))


@query("enabled_rules", """
SELECT ['regex','aggregate','composite','macro'][CAST(p_partkey % 4 AS INTEGER) + 1] AS rule_type,
       count(*) AS rules FROM part WHERE p_size % 2 = 0 GROUP BY ALL""")
def enabled(spark, sf):
    return _rule_table(spark, sf).where("enabled").groupBy("rule_type").agg(
        F.count("*").alias("rules"))


@query("rule_reset", f"""
WITH cur AS (SELECT CAST(s_suppkey AS INTEGER) + 1 AS id,
    CASE WHEN s_suppkey < 10 THEN 'builtin' ELSE 'custom' END AS kind,
    CASE WHEN s_suppkey < 10 THEN [{', '.join(quoted(r.name) for r in rules()[:10])}]
         [CAST(s_suppkey AS INTEGER) + 1] ELSE s_name END AS name, 'info' AS severity,
    CAST(s_nationkey AS INTEGER) AS threshold FROM supplier),
seed AS (SELECT * FROM (VALUES {', '.join(
    f"({quoted(r.name)}, '{r.severity}', {r.threshold or -1})"
    for r in builtin_rules())})
    AS t(name, severity, threshold))
SELECT coalesce(c.name, s.name) AS name,
       CASE WHEN s.name IS NOT NULL THEN s.severity ELSE c.severity END AS severity,
       CASE WHEN s.name IS NOT NULL THEN s.threshold ELSE c.threshold END AS threshold,
       CASE WHEN s.name IS NOT NULL THEN true ELSE false END AS enabled
FROM (SELECT * FROM cur) c FULL OUTER JOIN seed s ON c.name = s.name AND c.kind = 'builtin'""")
def reset(spark, sf):
    """A rule table derived from suppliers: ten altered built-ins, the rest custom rules."""
    names = F.array(*[F.lit(r.name) for r in rules()])
    builtin = F.col("s_suppkey") < 10
    seed = rules_frame(spark, rules()).limit(0)
    current = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1).cast("int").alias("id"),
        F.when(builtin, F.get(names, F.col("s_suppkey").cast("int"))).otherwise(F.col("s_name"))
        .alias("name"), F.lit("info").alias("severity"),
        F.col("s_nationkey").alias("threshold"), builtin.alias("is_builtin"),
        F.lit(False).alias("enabled"))
    return reset_builtin(spark, seed.unionByName(current, allowMissingColumns=True)).select(
        "name", "severity", F.coalesce("threshold", F.lit(-1)).alias("threshold"), "enabled")


# ------------------------------------------------------------------------------ alerts

@query("alerts_consolidated", with_alerts("""
SELECT title, rule_id, severity, src_ip, coalesce(dst_ip, '') AS dst_ip, coalesce(url, '') AS url,
       status, count, first_seen, last_seen, last_matched, coalesce(last_count, -1) AS last_count
FROM alerts"""))
def consolidated(spark, sf):
    return alerts(spark, sf).select(
        "title", "rule_id", "severity", "src_ip", F.coalesce("dst_ip", F.lit("")).alias("dst_ip"),
        F.coalesce("url", F.lit("")).alias("url"), "status", "count", "first_seen", "last_seen",
        "last_matched", F.coalesce("last_count", F.lit(-1)).alias("last_count"))


@query("alert_samples", with_alerts("""
firsts AS (SELECT rule_name, src_ip, session, raw, min(epoch * 1000000000 + seq) AS first_at FROM sessions GROUP BY ALL)""", """
ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_name, src_ip, session
             ORDER BY first_at DESC) AS n FROM firsts)""", """
SELECT a.title, a.src_ip, a.first_seen, string_agg(CASE WHEN length(raw) > 300
  THEN left(raw, 300) || '…' ELSE raw END, chr(10) ORDER BY first_at) AS samples
FROM alerts a JOIN ranked r ON r.rule_name = a.title AND r.src_ip = a.src_ip
  AND r.session = a.session WHERE n <= 3 GROUP BY ALL"""))
def samples(spark, sf):
    made = alert_ops.consolidate(hits(spark, sf), gap=GAP, max_samples=3)
    return made.select("title", "src_ip", "first_seen",
                       F.array_join("samples", "\n").alias("samples"))


@query("untimed_alerts", with_ev(HITS, """
SELECT rule_name AS title, src_ip, count(*) AS count FROM hits WHERE seq % 5 = 0
GROUP BY rule_name, src_ip"""))
def untimed(spark, sf):
    """Every fifth hit loses its time; those still end in alerts."""
    found = hits(spark, sf).withColumn("epoch", F.when(F.col("seq") % 5 != 0, F.col("epoch")))
    return alert_ops.consolidate(found, gap=GAP).where(F.col("first_seen").isNull()).select(
        "title", "src_ip", "count")


@query("alerts_status_aware", with_alerts(f"""
changes AS (SELECT rule_name, src_ip, min(epoch) + 60 AS at FROM hits GROUP BY rule_name, src_ip),
broken AS (SELECT g.*, CASE WHEN prev IS NULL OR g.epoch - prev > {GAP}
     OR (prev <= c.at AND c.at < g.epoch) THEN 1 ELSE 0 END AS opens
   FROM gaps g JOIN changes c USING (rule_name, src_ip)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY rule_name, src_ip ORDER BY epoch, seq) AS s
   FROM broken)""", """
SELECT rule_name AS title, src_ip, count(*) AS count, min(epoch) AS first_seen,
       max(epoch) AS last_seen FROM numbered GROUP BY rule_name, src_ip, s"""))
def status_aware(spark, sf):
    """The first alert of every rule and source is closed a minute after it opened."""
    found = materialise(hits(spark, sf).drop("raw", "prior_fails", "window_s", "group_value"))   # used twice
    changes = found.groupBy("rule_name", "src_ip").agg((F.min("epoch") + 60).alias("epoch")
                                                       ).withColumn("status", F.lit("closed"))
    return alert_ops.consolidate(found, gap=GAP, status_changes=changes, samples=False).select(
        "title", "src_ip", "count", "first_seen", "last_seen")


@query("alert_status_update", with_alerts("""
SELECT title, CASE WHEN count > 1 THEN 'confirmed' ELSE status END AS status, count(*) AS alerts
FROM alerts GROUP BY ALL"""))
def status_update(spark, sf):
    made = materialise(alerts(spark, sf))   # used three times
    updates = made.where("count > 1").select("alert_id", F.lit("confirmed").alias("status"))
    invalid = made.where("count <= 1").select("alert_id", F.lit("solved").alias("status"))
    return alert_ops.apply_status(made, updates.unionByName(invalid)).groupBy(
        "title", "status").agg(F.count("*").alias("alerts"))


@query("alert_severity_summary", with_alerts("""
SELECT count(*) FILTER (WHERE severity = 'high') AS high,
       count(*) FILTER (WHERE severity = 'mid') AS mid,
       count(*) FILTER (WHERE severity = 'low') AS low,
       count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM alerts"""))
def severity_summary(spark, sf):
    return alert_ops.severity_summary(alerts(spark, sf))


@query("alert_tiles", with_alerts("""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'new') AS new,
       count(*) FILTER (WHERE severity = 'high') AS high FROM alerts"""))
def tiles(spark, sf):
    return alert_ops.tiles(alerts(spark, sf))


@query("alert_search", with_alerts("""
SELECT last_seen, count(*) AS alerts FROM (
  SELECT last_seen FROM alerts WHERE severity = 'high' AND status = 'new'
    AND contains(src_ip, '113.') AND contains(lower(title), 'sql')
  ORDER BY last_seen DESC LIMIT 50) GROUP BY last_seen"""))
def alert_search(spark, sf):
    return alert_ops.search(alerts(spark, sf), severity="high", status="new", src_ip="113.",
                            keyword="sql").groupBy("last_seen").agg(F.count("*").alias("alerts"))


@query("alert_rule_ids", with_alerts("""
SELECT title, rule_id, count(*) AS alerts FROM alerts GROUP BY title, rule_id"""))
def rule_ids(spark, sf):
    named = alert_ops.with_rule_id(alerts(spark, sf).drop("rule_id").withColumn(
        "rule_id", F.lit(None).cast("int")), rules_frame(spark, rules()))
    return named.groupBy("title", "rule_id").agg(F.count("*").alias("alerts"))


@query("alert_context", with_alerts("""
counts AS (SELECT src_ip, count(*) AS events, count(*) FILTER (WHERE outcome = 'failed') AS failed,
             count(DISTINCT username) AS users FROM ev GROUP BY src_ip)""", """
SELECT a.title, a.src_ip, a.first_seen, a.count, c.events, c.failed, c.users
FROM alerts a JOIN counts c USING (src_ip)"""))
def context(spark, sf):
    made = alert_ops.consolidate(hits(spark, sf), gap=GAP)
    return alert_ops.alert_context(made, events(spark, sf)).select(
        "title", "src_ip", "first_seen", "count", "events", "failed", "users")


_CUT = AS_OF_EPOCH - 15 * DAY      # the first run ends here


@query("import_runs", with_ev(HITS, f"""
told AS (SELECT *, CASE WHEN epoch < {_CUT} AND severity = 'high' THEN 'closed' ELSE 'new' END AS status FROM hits)""", f"""
marked AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER w <= {GAP} THEN 0 ELSE 1 END AS opens FROM told
  WINDOW w AS (PARTITION BY rule_name, src_ip, status ORDER BY epoch, seq))""", """
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY rule_name, src_ip, status ORDER BY epoch, seq) AS n FROM marked)""", """
SELECT rule_name AS title, src_ip, status, count(*) AS count, min(epoch) AS first_seen, max(epoch) AS last_seen,
       last(matched_text ORDER BY epoch, seq) AS last_matched
FROM numbered GROUP BY rule_name, src_ip, status, n"""))
def import_runs(spark, sf):
    """All lines imported in two runs; between them an analyst closes the alerts of high severity."""
    out = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    lines = events(spark, sf).select("epoch", "seq", F.col("raw").alias("value"))

    def run(name, rows):
        importing.import_lines(rows.drop("epoch"), rules(), out, year=fixtures.YEAR, run=name, gap=GAP)

    run("first half", lines.where(F.col("epoch") < _CUT))
    shown = tables.read(spark, f"{out}/alerts")
    importing.set_status(spark, out, shown.where("severity = 'high'").select("alert_id", F.lit("closed").alias("status")))
    run("second half", lines.where(F.col("epoch") >= _CUT))
    made = materialise(tables.read(spark, f"{out}/alerts").select(
        "title", "src_ip", "status", "count", "first_seen", "last_seen", "last_matched"))
    Folder(spark, out).delete("")
    return made
