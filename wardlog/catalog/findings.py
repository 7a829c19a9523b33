"""Queries: findings out of stored responses, and their closure by attack events."""

from pyspark.sql import functions as F

from wardlog.catalog.base import as_of, events, query, quoted, with_ev
from wardlog.catalog.exposing import _ADVISORY, _FIXED, _HEADERS, _LISTED, _NUMBERS, _REASON, _WEAK, PAGES, PROBES, TECH, _probes
from wardlog.catalog.reporting import _CLASS_OF, HOURS, RELATED_SQL
from wardlog.constants import (ADVISORIES, ADVISORY_TITLES, DATABASE_ERRORS, FINDING_TEXTS, LEAKED_FILES,
                               SENSITIVE_FILES, SEVERITY_RANK)
from wardlog.operators import correlate
from wardlog.operators.pages import site_root
from wardlog.plans import findings
from wardlog.sources import fixtures

# which requested URL a page that shows an error or a system file answers
_ASKED = {4: 6, 5: 8, 10: 0, 11: 5}


def _scanned(spark, sf):
    """Pages as answers: those with an error or a system file answer a value sent to a parameter."""
    rows = fixtures.responses(spark, sf)
    kind = F.col("page_id") % 12
    asked = F.create_map(*[F.lit(x) for k, i in _ASKED.items() for x in (k, fixtures.URLS[i])])
    sent = F.try_element_at(asked, kind.cast("int"))
    return rows.withColumns({
        "url": F.when(sent.isNull(), F.col("url")).otherwise(F.concat(site_root(F.col("url")), sent)),
        "param": F.when(sent.isNotNull(), "id"),
        "payload": F.when(sent.isNull(), None).when(kind % 6 == 4, "1'").otherwise("../etc/passwd")})


def _cases(of, pairs):
    return f"CASE {of} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs) + " END"


def _snippet(needle):
    start = f"greatest(strpos(body, {needle}) - 50, 1)"
    return (f"trim(replace(substr(body, {start}, strpos(body, {needle}) + length({needle}) + 50 - {start}), chr(10), ' '))")


_PATTERN = "CASE listed " + " ".join(
    f"WHEN {quoted(path)} THEN CASE " + " ".join(
        f"WHEN regexp_matches(body, {quoted(x)}) THEN regexp_extract(body, {quoted(x)})" for x in patterns) + " END"
    for path, _, _, archive, patterns in SENSITIVE_FILES if not archive) + " END"
_LEAKED = "CASE " + " ".join(f"WHEN regexp_matches(body, {quoted(p)}) THEN {{{i}}}" for i, (p, _, _) in enumerate(LEAKED_FILES)) + " END"
_ERROR = "coalesce(" + ", ".join(f"nullif(regexp_extract(body, {quoted(p)}, 0, 'i'), '')" for p in DATABASE_ERRORS) + ")"
_BUMPED = "CASE severity WHEN 'low' THEN 'mid' WHEN 'mid' THEN 'high' ELSE 'critical' END"
_TEXT = [_cases("kind", [(k, t[i]) for k, t in FINDING_TEXTS.items()]) for i in range(3)]
_PART = ("coalesce(CAST(length({0}) AS VARCHAR) || ':' || {0}, '-')")
_KEY = "sha256(" + " || ".join(_PART.format(c) for c in ("vuln_type", "url", "param", "subject")) + ")"

FOUND_SQL = TECH + "," + PROBES.removeprefix(PAGES) + f""",
{_HEADERS}
audit AS (SELECT root, header, severity, purpose, value, lower(trim(value)) AS low FROM (
  SELECT DISTINCT root, v FROM p) s CROSS JOIN wanted LEFT JOIN hv ON hv.v = s.v AND name = lower(header)),
asked AS (SELECT *, CASE page_id % 12 {" ".join(f"WHEN {k} THEN {quoted(fixtures.URLS[i])}" for k, i in _ASKED.items())} END AS sent FROM p),
bodies AS (SELECT root, regexp_extract(coalesce(root || sent, url), '^([^?#]*)', 1) AS url, body,
  CASE WHEN sent IS NOT NULL THEN 'id' END AS param,
  CASE WHEN sent IS NULL THEN NULL WHEN page_id % 6 = 4 THEN '1''' ELSE '../etc/passwd' END AS payload,
  {_LEAKED.format(*[quoted(n) for _, n, _ in LEAKED_FILES])} AS leak,
  {_LEAKED.format(*[quoted(s) for _, _, s in LEAKED_FILES])} AS severity,
  {_LEAKED.format(*[f"regexp_extract(body, {quoted(p)})" for p, _, _ in LEAKED_FILES])} AS matched,
  {_ERROR} AS error FROM asked),
files AS (SELECT *, {_cases("listed", [(p, n) for p, n, *_ in SENSITIVE_FILES])} AS name,
    {_cases("listed", [(p, s) for p, _, s, *_ in SENSITIVE_FILES])} AS severity, {_PATTERN} AS matched
  FROM (SELECT *, {_LISTED} AS listed FROM probes WHERE status IN (200, 206))),
old AS (SELECT root, {_ADVISORY} AS component, regexp_extract(version, '([0-9]+(\\.[0-9]+)*)', 1) AS number, version,
  {_FIXED} AS fixed_in FROM tech JOIN p USING (page_id) WHERE version <> ''),
cve AS (SELECT DISTINCT *, {_cases("component", [(c, s) for c, _, _, _, s in ADVISORIES])} AS severity,
    {_cases("component", [(c, f"{v}，{ADVISORY_TITLES[v]}") for c, _, _, v, _ in ADVISORIES])} AS detail
  FROM old WHERE component IS NOT NULL AND {_NUMBERS.format('number')} < {_NUMBERS.format('fixed_in')}),
raw AS (
  SELECT root AS site, 'security_headers' AS vuln_type, 'missing' AS kind, root AS url, NULL AS param,
    header || '/missing' AS subject, header AS about, severity, NULL AS payload, '响应头中没有 ' || header AS evidence,
    '：' || purpose AS detail FROM audit WHERE value IS NULL
  UNION ALL SELECT root, 'security_headers', 'weak', root, NULL, header || '/weak', header, 'mid', NULL,
    header || ': ' || value, '：' || {_REASON} FROM audit WHERE value IS NOT NULL AND ({_WEAK})
  UNION ALL SELECT root, 'cve_match', 'cve_match', root, NULL, component, component, severity, component || ' ' || version,
    component || ' ' || version || ' < ' || fixed_in, '：' || detail FROM cve
  UNION ALL SELECT root, 'path_traversal', 'path_traversal', url, param, leak, leak, severity, payload,
    {_snippet('matched')}, '' FROM bodies WHERE leak IS NOT NULL
  UNION ALL SELECT root, 'sqli', 'sqli', url, param, 'error', error, 'high', payload, {_snippet('error')}, ''
    FROM bodies WHERE error IS NOT NULL
  UNION ALL SELECT root, 'sensitive_file', 'sensitive_file', root || '/' || path, NULL, listed, name || '（/' || path || '）',
    CASE WHEN path <> listed THEN {_BUMPED} ELSE severity END, path,
    substr(trim(replace(substr(body, greatest(strpos(body, matched) - 30, 1), strpos(body, matched) + length(matched) + 60
      - greatest(strpos(body, matched) - 30, 1)), chr(10), ' ')), 1, 200), '' FROM files WHERE matched IS NOT NULL),
own AS (SELECT {_KEY} AS finding_key, site, vuln_type, url, param, subject, severity, payload, evidence,
    replace({_TEXT[0]}, '%s', about) AS title, replace({_TEXT[1]}, '%s', about) || detail AS description,
    replace({_TEXT[2]}, '%s', about) AS fix FROM (
  SELECT *, row_number() OVER (PARTITION BY site, vuln_type, url, param, subject
    ORDER BY CAST({_cases("severity", [(s, str(r)) for s, r in SEVERITY_RANK.items()])} AS INTEGER), evidence, payload, about) AS first
  FROM raw WHERE site <> '') WHERE first = 1)"""


@query("scan_findings", FOUND_SQL + "\nSELECT * FROM own")
def scan_findings(spark, sf):
    """Every finding of the stored pages and path probes, with its lasting key and texts."""
    return findings.findings_of(_scanned(spark, sf), _probes(spark, sf))


_OWN_SQL = FOUND_SQL.removeprefix("\n").removeprefix("WITH ") + """,
findings AS (SELECT finding_key AS finding_id, vuln_type, url,
  CASE WHEN rest = '' THEN '/' ELSE rest END AS path
  FROM (SELECT *, rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS rest FROM own))"""


@query("own_findings_closure", with_ev(_OWN_SQL, RELATED_SQL, f"""
SELECT f.vuln_type, count(*) AS findings, count(*) FILTER (WHERE ({_CLASS_OF}) IS NOT NULL) AS correlatable,
  count(*) FILTER (WHERE m.n IS NOT NULL) AS exploited, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS events
FROM findings f LEFT JOIN (SELECT finding_id, count(*) AS n FROM matched GROUP BY finding_id) m USING (finding_id)
GROUP BY f.vuln_type""".replace("CASE vuln_type", "CASE f.vuln_type")))
def own_findings_closure(spark, sf):
    """How many of the findings that the pages show are under attack, by type."""
    own = findings.findings_of(_scanned(spark, sf), _probes(spark, sf)).select(
        F.col("finding_key").alias("finding_id"), F.col("site").alias("task_id"), "vuln_type", "severity", "url", "param")
    counted = own.join(correlate.event_counts(own, events(spark, sf), as_of(), HOURS), "finding_id", "left")
    return counted.groupBy("vuln_type").agg(
        F.count("*").alias("findings"), F.count_if(correlate.is_correlatable(F.col("vuln_type"))).alias("correlatable"),
        F.count("events").alias("exploited"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
