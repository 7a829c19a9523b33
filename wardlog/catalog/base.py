"""Shared pieces of the registered queries: inputs, parameters, and the same inputs in SQL.

Windows are hours to days and thresholds small because the driver's events are sparse: 30 days,
a few events per source and day. All of them are arguments of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.constants import SIGNATURES
from wardlog.operators.alerts import consolidate
from wardlog.plans.detection import detect
from wardlog.session import prepare
from wardlog.sources import fixtures
from wardlog.sources.rules import Rule, builtin_rules

Query = Callable[[SparkSession, str], DataFrame]
AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF_EPOCH = 1706659200
DAY = 86400
RULE_WINDOW = 2 * DAY
RULE_THRESHOLD = 3
GAP = 6 * 3600

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL it has to agree with."""
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.security_events(spark, sf)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fixtures.table(spark, sf, name)


def rules() -> list[Rule]:
    return builtin_rules(window=RULE_WINDOW, threshold=RULE_THRESHOLD)


def rule(number: int) -> Rule:
    return next(r for r in rules() if r.id == number)


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return detect(events(spark, sf), rules())


def alerts(spark: SparkSession, sf: str, samples: bool = False) -> DataFrame:
    return consolidate(hits(spark, sf), gap=GAP, samples=samples)


# ---------------------------------------------------------------------------- the inputs in SQL

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


EV = f"""
base AS (
  SELECT event_id AS seq, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
         date_trunc('second', ts) AS t
  FROM events),
typed AS (
  SELECT *, CASE WHEN event_type IN ('error', 'signup') THEN 'ssh'
                 WHEN event_type = 'purchase' THEN 'scan' ELSE 'web' END AS log_type
  FROM base),
fields AS (
  SELECT *,
    {sql_list(fixtures.PREFIXES)}[CAST(user_id % 6 AS INTEGER) + 1]
      || CAST(user_id % 250 AS VARCHAR) AS src_ip,
    CASE WHEN log_type = 'scan' THEN '192.168.1.' || CAST(k % 20 AS VARCHAR) END AS dst_ip,
    CASE WHEN log_type = 'ssh' THEN 40000 + k END AS src_port,
    CASE log_type WHEN 'ssh' THEN 22 WHEN 'scan' THEN 1000 + k END AS dst_port,
    CASE WHEN log_type <> 'web' THEN 'tcp' END AS proto,
    CASE WHEN event_type = 'click' THEN 'POST' WHEN log_type = 'web' THEN 'GET' END AS method,
    CASE WHEN log_type = 'web' THEN {sql_list(fixtures.URLS)}[k % 12 + 1] END AS url,
    CASE WHEN log_type = 'web' THEN CASE WHEN k % 5 = 0 THEN 404 WHEN k % 7 = 0 THEN 500
         ELSE 200 END END AS status_code,
    CASE WHEN log_type = 'web' THEN {sql_list(fixtures.AGENTS)}[k % 5 + 1] END AS user_agent,
    CASE WHEN log_type = 'ssh' THEN {sql_list(fixtures.USERS)}[k % 4 + 1] END AS username,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'success' END AS outcome,
    CASE WHEN log_type = 'scan' THEN ['', 'FIN', 'SYN'][k % 3 + 1] ELSE '' END AS flags
  FROM typed),
ev AS (
  SELECT *, CASE log_type
    WHEN 'ssh' THEN strftime(t, '%b') || ' ' || lpad(CAST(day(t) AS VARCHAR), 2, ' ') || ' '
      || strftime(t, '%H:%M:%S') || ' server sshd[' || CAST(k AS VARCHAR) || ']: '
      || CASE WHEN event_type = 'signup' THEN 'Accepted password for '
              WHEN k % 3 = 0 THEN 'Failed password for '
              WHEN k % 3 = 1 THEN 'Failed password for invalid user '
              ELSE 'Invalid user ' END
      || username || ' from ' || src_ip || ' port ' || CAST(src_port AS VARCHAR)
      || CASE WHEN event_type = 'error' AND k % 3 = 2 THEN '' ELSE ' ssh2' END
    WHEN 'scan' THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || ',' || src_ip || ',' || dst_ip || ','
      || CAST(dst_port AS VARCHAR) || ',tcp,open' || CASE WHEN flags <> '' THEN ',' || flags
         ELSE '' END
    ELSE src_ip || ' - - [' || strftime(t, '%d/%b/%Y:%H:%M:%S') || ' +0800] "' || method || ' '
      || url || ' HTTP/1.1" ' || CAST(status_code AS VARCHAR) || ' ' || CAST(100 + k AS VARCHAR)
      || ' "-" "' || user_agent || '"' END AS raw
  FROM fields)"""


def with_ev(*parts: str) -> str:
    """A statement over `ev`: further common table expressions, then the select."""
    *tables, select = parts
    return "WITH RECURSIVE " + ",\n".join([EV, *tables]) + "\n" + select


def sql_text(field: str) -> str:
    columns = {"url": ("url", "raw"), "user_agent": ("user_agent",)}.get(
        field, ("url", "raw", "user_agent", "username"))
    return "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in columns) + ")"


def sql_decoded(text: str) -> str:
    return f"url_decode(replace({text}, '+', ' '))"


def sql_matches(text: str, pattern: str) -> str:
    p = quoted(pattern)
    return (f"(regexp_matches({text}, {p}, 'i') OR "
            f"regexp_matches({sql_decoded(text)}, {p}, 'i'))")


def sql_class(text: str, name: str) -> str:
    return sql_matches(text, SIGNATURES[name])


SQL_FILTERS = {
    "ssh_failed": "coalesce(outcome = 'failed', false)",
    "ssh_failed_uncommon_user":
        "coalesce(outcome = 'failed' AND username NOT IN ('root', 'admin'), false)",
    "ssh_success": "coalesce(outcome = 'success', false)",
    "scan_event": "log_type = 'scan'",
    "abnormal_tcp_flags": "flags = 'FIN'",
    "web_error": "coalesce(status_code >= 400, false)",
    "short_ua_post": "coalesce(method = 'POST' AND length(trim(user_agent)) < 5, false)",
    "any_event": "true",
}


def sql_count_hits(test: str, window: int, threshold: int) -> str:
    """Trailing counts with ties settled by seq."""
    return f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY epoch, seq)
        - count(*) OVER (PARTITION BY src_ip ORDER BY epoch
            RANGE BETWEEN UNBOUNDED PRECEDING AND {window + 1} PRECEDING) AS cnt
      FROM ev WHERE {test}) WHERE cnt >= {threshold}"""


SEQUENCE_SQL = """
pre AS (SELECT src_ip, seq, epoch, outcome,
          sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (
            PARTITION BY src_ip ORDER BY epoch, seq) AS a
        FROM ev WHERE outcome IS NOT NULL),
trig AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY epoch, seq) AS n,
           (SELECT count(*) FROM pre p WHERE p.src_ip = pre.src_ip AND p.outcome = 'failed'
              AND p.epoch < pre.epoch - {window}) AS b
         FROM pre WHERE outcome = 'success'),
walk AS (
  SELECT src_ip, seq, epoch, n, a, b, CAST(CASE WHEN a - b >= {limit} THEN a ELSE 0 END AS BIGINT)
           AS r, CAST(CASE WHEN a - b >= {limit} THEN a - b ELSE 0 END AS BIGINT) AS prior
  FROM trig WHERE n = 1
  UNION ALL
  SELECT t.src_ip, t.seq, t.epoch, t.n, t.a, t.b,
         CAST(CASE WHEN t.a - greatest(t.b, w.r) >= {limit} THEN t.a ELSE w.r END AS BIGINT),
         CAST(CASE WHEN t.a - greatest(t.b, w.r) >= {limit} THEN t.a - greatest(t.b, w.r)
              ELSE 0 END AS BIGINT)
  FROM walk w JOIN trig t ON t.src_ip = w.src_ip AND t.n = w.n + 1)"""


def sql_distinct_hits(test: str, window: int, threshold: int) -> str:
    """Trailing counts of distinct ports: `seq` and `cnt`."""
    return f"""
    SELECT a.seq, count(DISTINCT b.dst_port) AS cnt FROM ev a JOIN ev b ON a.src_ip = b.src_ip
      AND b.epoch BETWEEN a.epoch - {window} AND a.epoch AND (b.epoch < a.epoch OR b.seq <= a.seq)
    WHERE {test.replace("log_type", "a.log_type")} AND {test.replace("log_type", "b.log_type")}
    GROUP BY a.seq HAVING count(DISTINCT b.dst_port) >= {threshold}"""


def _rule_hits(r: Rule) -> str:
    """Hits of a rule: the event with `cnt`, and the evidence."""
    prior = "CAST(NULL AS BIGINT) AS prior"
    matched = (f"'src_ip=' || src_ip || ' 在 {r.window}s 内命中 ' || CAST(cnt AS VARCHAR) "
               "|| ' 次'")
    if r.rule_type == "regex":
        text = sql_text(r.match_field)
        test = SQL_FILTERS.get(r.pattern) or sql_class(text, r.pattern)
        source = f"SELECT *, CAST(NULL AS BIGINT) AS cnt, {prior} FROM ev WHERE coalesce({test}, false)"
        matched = (f"CASE WHEN length(trim({text})) > 200 THEN left(trim({text}), 200) || '…' "
                   f"ELSE trim({text}) END")
    elif r.rule_type == "composite":
        source = ("SELECT ev.*, CAST(NULL AS BIGINT) AS cnt, walk.prior FROM ev JOIN walk USING (seq) "
                  "WHERE walk.prior > 0")
        matched = "'src_ip=' || src_ip || ' 先失败 ' || CAST(prior AS VARCHAR) || ' 次后登录成功'"
    elif r.count_mode == "distinct":
        source = (f"SELECT ev.*, d.cnt, {prior} FROM ev JOIN ("
                  f"{sql_distinct_hits(SQL_FILTERS[r.pattern], r.window, r.limit)}) d USING (seq)")
    else:
        source = f"SELECT *, {prior} FROM ({sql_count_hits(SQL_FILTERS[r.pattern], r.window, r.limit)})"
    return (f"SELECT seq, epoch, src_ip, dst_ip, url, raw, cnt, {r.id} AS rule_id, "
            f"{quoted(r.name)} AS rule_name, '{r.category}' AS category, "
            f"'{r.severity}' AS severity, {matched} AS matched_text FROM ({source})")


def _alert_hits() -> str:
    sequence = SEQUENCE_SQL.format(window=rule(3).window, limit=rule(3).limit)
    return sequence.strip() + ",\nhits AS (" + "\nUNION ALL ".join(map(_rule_hits, rules())) + ")"


HITS = _alert_hits()
SESSIONS = f"""
gaps AS (SELECT *, lag(epoch) OVER (PARTITION BY rule_name, src_ip ORDER BY epoch, seq) AS prev
         FROM hits),
sessions AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR epoch - prev > {GAP} THEN 1 ELSE 0 END)
    OVER (PARTITION BY rule_name, src_ip ORDER BY epoch, seq) AS session FROM gaps)"""
ALERTS = """
alerts AS (
  SELECT rule_name AS title, rule_id, src_ip, session, first(severity ORDER BY epoch, seq) AS severity,
         first(dst_ip ORDER BY epoch, seq) AS dst_ip, first(url ORDER BY epoch, seq) AS url,
         count(*) AS count, min(epoch) AS first_seen, max(epoch) AS last_seen,
         last(matched_text ORDER BY epoch, seq) AS last_matched,
         last(cnt ORDER BY epoch, seq) AS last_count, 'new' AS status
  FROM sessions GROUP BY rule_name, rule_id, src_ip, session)"""


def with_alerts(*parts: str) -> str:
    return with_ev(HITS, SESSIONS.strip(), ALERTS.strip(), *parts)
