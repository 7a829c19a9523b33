"""Queries over stored web responses."""

from pyspark.sql import functions as F

from wardlog.catalog.base import query, quoted, sql_list, table
from wardlog.constants import (ADVISORIES, DATABASE_ERRORS, FINGERPRINT_HEADERS, LEAKED_FILES, MIN_HSTS_SECONDS,
                               SECURITY_HEADERS, SENSITIVE_FILES, TECHNOLOGIES, WEAK_VALUES)
from wardlog.functions import text
from wardlog.operators import correlate, exposure, pages
from wardlog.sources import fixtures


def _sql_text(value: str) -> str:
    return " || chr(10) || ".join(quoted(part) for part in value.split("\n"))


_FRAGMENTS = "[" + ", ".join(_sql_text(f) for f in fixtures.FRAGMENTS) + "]"
_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]*)', 1))"
PAGES = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
  html || {_FRAGMENTS}[CAST(page_id % 6 AS INTEGER) + 1] AS body, page_id % 4 AS v FROM pages),
"""
_HREF = r"""'(?i)<a\b[^>]*?href\s*=\s*["'']([^"'']+)["'']'"""
LINKS = PAGES + f"""
h AS (SELECT page_id, root, unnest(regexp_extract_all(body, {_HREF}, 1)) AS href FROM p),
links AS (SELECT page_id, root || CASE WHEN starts_with(href, '/') THEN split_part(href, '#', 1)
    ELSE '/' || replace(replace(split_part(href, '#', 1), '../', ''), './', '') END AS link
  FROM h WHERE NOT starts_with(href, 'http') AND NOT starts_with(href, 'javascript:'))"""


@query("page_links", LINKS + """
SELECT page_id, link, count(*) AS times FROM links GROUP BY ALL""")
def page_links(spark, sf):
    return pages.links(fixtures.responses(spark, sf)).groupBy("page_id", "link").agg(
        F.count("*").alias("times"))


@query("link_parameters", LINKS + """
SELECT page_id, split_part(link, '?', 1) AS url, unnest(CASE WHEN contains(link, 'lang')
    THEN ['id', 'lang', 'id'] ELSE ['q'] END) AS param,
  CASE WHEN contains(link, 'lang') THEN 'id=2,lang=zh' ELSE 'q=a b c' END AS params
FROM links WHERE contains(link, '?')""")
def link_parameters(spark, sf):
    found = pages.link_parameters(pages.links(fixtures.responses(spark, sf)))
    return found.select("page_id", "url", "param", _joined("params").alias("params"))


def _joined(column):
    return F.array_join(F.transform(F.map_entries(F.col(column)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")


@query("form_parameters", PAGES.rstrip().rstrip(",") + """
SELECT page_id, root || '/search' AS url, 'POST' AS method, unnest(['q', 'msg', 'cat']) AS param,
  'q=test,msg=hi,cat=2' AS params FROM p WHERE page_id % 6 = 1""")
def form_parameters(spark, sf):
    return pages.form_parameters(fixtures.responses(spark, sf)).select(
        "page_id", "url", "method", "param", _joined("params").alias("params"))


@query("first_parameter_targets", LINKS + """
SELECT page_id, method, url, param FROM (
  SELECT DISTINCT page_id, 'GET' AS method, split_part(link, '?', 1) AS url, unnest(
    CASE WHEN contains(link, 'lang') THEN ['id', 'lang'] ELSE ['q'] END) AS param
  FROM links WHERE contains(link, '?')
  UNION ALL SELECT page_id, 'POST', root || '/search', unnest(['q', 'msg', 'cat']) FROM p
  WHERE page_id % 6 = 1)""")
def first_targets(spark, sf):
    rows = fixtures.responses(spark, sf)
    every = pages.link_parameters(pages.links(rows)).unionByName(pages.form_parameters(rows))
    return pages.first_targets(every).select("page_id", "method", "url", "param")


@query("robots_rules", PAGES.rstrip().rstrip(",") + """
SELECT page_id, '/admin,/tmp' AS disallow, '/pub' AS allow, 'http://h/s.xml' AS sitemaps FROM p
WHERE page_id % 6 = 3""")
def robots(spark, sf):
    parsed = fixtures.responses(spark, sf).select("page_id", pages.robots(F.col("body")).alias("r"))
    return parsed.where(F.size("r.disallow") > 0).select("page_id", *[
        F.array_join(f"r.{c}", ",").alias(c) for c in ("disallow", "allow", "sitemaps")])


@query("same_origin_links", PAGES + f"""
h AS (SELECT page_id, root, unnest(regexp_extract_all(body, {_HREF}, 1)) AS href FROM p)
SELECT page_id, count(*) AS links, count(*) FILTER (WHERE NOT contains(href, 'other.example'))
  AS same FROM h WHERE NOT starts_with(href, 'javascript:') GROUP BY page_id""")
def same_origin(spark, sf):
    rows = fixtures.responses(spark, sf).select(
        "page_id", pages.site_root(F.col("url")).alias("root"), F.explode(F.regexp_extract_all(
            "body", F.lit("(?i)" + pages.LINK_PATTERN), F.lit(1))).alias("href"))
    link = pages.absolute(F.col("href"), F.col("root"))
    return rows.where(~F.col("href").startswith("javascript:")).groupBy("page_id").agg(
        F.count("*").alias("links"), F.count_if(text.same_origin(link, F.col("root")))
        .alias("same"))


@query("allowed_hosts", f"""
WITH a AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE starts_with(url, 'https'))
SELECT page_id, url FROM pages WHERE {_HOST} IN (SELECT host FROM a)""")
def allowed(spark, sf):
    """Pages on a host that is also served over https."""
    rows = table(spark, sf, "pages").select("page_id", "url")
    hosts = rows.where(F.col("url").startswith("https")).select(
        text.url_host(F.col("url")).alias("host"))
    return correlate.allowed_hosts(rows, hosts)


@query("target_urls", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN rtrim(url, '/')
  WHEN 1 THEN 'http://' || rtrim(regexp_replace(url, '^https?://', ''), '/')
  ELSE '' END AS target FROM pages""")
def target_urls(spark, sf):
    raw = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), F.col("url"), F.lit(" ")))
           .when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?://", ""))
           .otherwise(F.lit("  ")))
    return table(spark, sf, "pages").select("page_id", text.normalise_target(raw).alias("target"))


# ------------------------------------------------------------------------------ headers

_HEADERS = """hv(v, name, value) AS (VALUES (0, 'server', 'nginx/1.24.0 (Ubuntu)'), (0, 'x-frame-options', 'ALLOWALL'),
  (0, 'strict-transport-security', 'max-age=3600'), (1, 'server', 'Apache/2.4.57'), (1, 'x-powered-by', 'PHP/8.1.2'),
  (1, 'content-security-policy', 'default-src *; script-src ''unsafe-inline'''), (1, 'x-frame-options', 'DENY'),
  (2, 'server', 'openresty/1.21.4'), (2, 'x-content-type-options', 'sniff'), (2, 'referrer-policy', 'unsafe-url'),
  (3, 'via', '1.1 cache'), (3, 'x-content-type-options', 'nosniff'),
  (3, 'strict-transport-security', 'max-age=31536000; includeSubDomains'), (3, 'referrer-policy', 'no-referrer'),
  (3, 'x-frame-options', 'SAMEORIGIN'), (3, 'content-security-policy', 'default-src ''self''')),
wanted(header, severity, purpose) AS (VALUES """ + ", ".join(
    f"({quoted(h)}, '{s}', {quoted(p)})" for h, s, p in SECURITY_HEADERS) + "),"
_WEAK = f"""CASE header WHEN 'X-Frame-Options' THEN low IN ('allowall', 'allow-all', '*') OR starts_with(low, 'allow-from')
  WHEN 'Content-Security-Policy' THEN regexp_matches(low, '(default|script)-src\\s+\\*') OR contains(low, 'unsafe-inline')
    OR contains(low, 'unsafe-eval')
  WHEN 'X-Content-Type-Options' THEN low <> 'nosniff'
  WHEN 'Strict-Transport-Security' THEN
    coalesce(TRY_CAST(regexp_extract(low, 'max-age\\s*=\\s*(\\d+)', 1) AS BIGINT), 0) < {MIN_HSTS_SECONDS}
  ELSE low IN ('unsafe-url', 'no-referrer-when-downgrade', '') END"""
_REASON = "CASE header " + " ".join(
    f"WHEN {quoted(h)} THEN replace({quoted(t)}, '%s', "
    + ("substr(trim(value), 1, 60)" if h == "Content-Security-Policy" else "trim(value)") + ")" for h, t in WEAK_VALUES.items()) + " END"
AUDIT = PAGES + _HEADERS + f"""
checked AS (SELECT page_id, header, severity, purpose, value, lower(trim(value)) AS low
  FROM (SELECT page_id, v FROM p) s CROSS JOIN wanted LEFT JOIN hv ON hv.v = s.v AND name = lower(header)),
audit AS (SELECT page_id, header, 'missing' AS kind, severity, CAST(NULL AS VARCHAR) AS value, purpose AS reason
    FROM checked WHERE value IS NULL
  UNION ALL SELECT page_id, header, 'weak', 'mid', value, {_REASON} FROM checked WHERE value IS NOT NULL AND ({_WEAK}))"""


@query("header_audit", AUDIT + "\nSELECT * FROM audit")
def header_audit(spark, sf):
    return exposure.header_audit(fixtures.responses(spark, sf))


@query("weak_header_values", AUDIT + "\nSELECT page_id, header FROM audit WHERE kind = 'weak'")
def weak_headers(spark, sf):
    return exposure.header_audit(fixtures.responses(spark, sf)).where("kind = 'weak'").select(
        "page_id", "header")


@query("header_rollup", AUDIT + """
SELECT page_id, coalesce(string_agg(header, ',' ORDER BY header) FILTER (WHERE kind = 'missing'), '')
  AS missing, coalesce(string_agg(header, ',' ORDER BY header) FILTER (WHERE kind = 'weak'), '')
  AS weak, count(*) AS total FROM audit GROUP BY page_id""")
def rollup(spark, sf):
    made = exposure.header_rollup(exposure.header_audit(fixtures.responses(spark, sf)))
    return made.select("page_id", F.array_join("missing", ",").alias("missing"),
                       F.array_join("weak", ",").alias("weak"), "total")


@query("fingerprint_headers", PAGES + _HEADERS + f"""
shown(header) AS (VALUES {", ".join(f"({quoted(h)})" for h in FINGERPRINT_HEADERS)})
SELECT page_id, header, value FROM p JOIN hv ON hv.v = p.v JOIN shown ON name = lower(header)""")
def fingerprint(spark, sf):
    return exposure.fingerprint_headers(fixtures.responses(spark, sf))


# ------------------------------------------------------------------------------ technologies

_HEADER_TEXT = """['Server: nginx/1.24.0 (Ubuntu)' || chr(10) || 'X-Frame-Options: ALLOWALL',
  'server: Apache/2.4.57' || chr(10) || 'x-powered-by: PHP/8.1.2', 'Server: openresty/1.21.4',
  'Via: 1.1 cache'][CAST(v AS INTEGER) + 1]"""


def _tech_sql(name, body, head, version):
    tests = ([f"regexp_matches(body, {quoted(body)}, 'i')"] if body else []) + (
        [f"regexp_matches(ht, {quoted(head)}, 'i')"] if head else [])
    groups = version.replace(r"\(", "").count("(") - version.count("(?:") if version else 0
    found = "coalesce(" + ", ".join(
        [f"nullif(regexp_extract(body || chr(10) || ht, {quoted(version)}, {i}, 'i'), '')"
         for i in range(1, groups + 1)] + ["''"]) + ")"
    return (f"SELECT page_id, {quoted(name)} AS name, {found} AS version FROM ht "
            f"WHERE {' OR '.join(tests)}")


TECH = PAGES + f"ht AS (SELECT *, {_HEADER_TEXT} AS ht FROM p),\ntech AS (" + "\nUNION ALL ".join(
    _tech_sql(n, b, h, v) for n, _, b, h, v in TECHNOLOGIES) + ")"


@query("technologies", TECH + "\nSELECT * FROM tech")
def technologies(spark, sf):
    return exposure.technologies(fixtures.responses(spark, sf)).select(
        "page_id", "name", F.coalesce("version", F.lit("")).alias("version"))


_ADVISORY = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(name), '{p}') THEN {quoted(c)}" for c, p, *_ in ADVISORIES) + " END"
_FIXED = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(name), '{p}') THEN '{f}'" for c, p, f, *_ in ADVISORIES) + " END"
_NUMBERS = ("list_resize(CAST(string_split({0}, '.') AS BIGINT[]), 6, 0)")


@query("vulnerable_components", TECH + f""",
v2 AS (SELECT page_id, {_ADVISORY} AS component, regexp_extract(version, '([0-9]+(\\.[0-9]+)*)', 1)
  AS number, version, {_FIXED} AS fixed_in FROM tech WHERE version <> '')
SELECT DISTINCT page_id, component, version, fixed_in FROM v2 WHERE component IS NOT NULL
  AND {_NUMBERS.format('number')} < {_NUMBERS.format('fixed_in')}""")
def vulnerable(spark, sf):
    found = exposure.technologies(fixtures.responses(spark, sf))
    return exposure.vulnerable_components(found).select("page_id", "component", "version",
                                                        "fixed_in")


@query("version_order", """
WITH v AS (SELECT l_linenumber AS a, CAST(l_quantity AS INTEGER) AS b,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey % 3 AS INTEGER) END AS c FROM lineitem)
SELECT a, count(*) AS versions, count(*) FILTER (WHERE a < 4 OR (a = 4 AND (b < 25 OR (b = 25
  AND coalesce(c, 0) < 1)))) AS below FROM v GROUP BY a""")
def versions(spark, sf):
    """Banners built from line items, compared with 4.25.1."""
    banner = F.concat(F.lit("nginx/"), F.col("l_linenumber").cast("string"), F.lit("."),
                      F.col("l_quantity").cast("int").cast("string"),
                      F.when(F.col("l_suppkey") % 2 == 0, F.concat(
                          F.lit("."), (F.col("l_suppkey") % 3).cast("string"))).otherwise(""),
                      F.lit(" (Ubuntu)"))
    below = exposure.version_lt(exposure.parse_version(banner),
                                exposure.parse_version(F.lit("4.25.1")))
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("a")).agg(
        F.count("*").alias("versions"), F.count_if(below).alias("below"))


# ------------------------------------------------------------------------------ content

_PATHS = (".env", ".ENV", "db.sql", "db.sql.", "phpinfo.php", "admin", ".git/config", "index.html")
_STARTS = ("SECRET_KEY=abc\n", "INSERT INTO t VALUES (1)\n", "[core]\n", "")


def _probes(spark, sf):
    """Pages as answers to path probes: path, status and the first line depend on the page."""
    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    n = F.col("page_id")
    return fixtures.responses(spark, sf).select(
        "host", "url", "headers", n.alias("seq"), pick(_PATHS, n % len(_PATHS)).alias("path"),
        F.when(n % 5 == 4, 404).when(n % 7 == 6, 403).when(n % 11 == 10, 301).otherwise(200)
        .alias("status"),
        F.concat(pick(_STARTS, F.floor(n / 8) % len(_STARTS)), F.col("body")).alias("body"))


PROBES = PAGES + f"""
probes AS (SELECT host, root, page_id AS seq, {sql_list(_PATHS)}[CAST(page_id % 8 AS INTEGER) + 1] AS path,
  CASE WHEN page_id % 5 = 4 THEN 404 WHEN page_id % 7 = 6 THEN 403 WHEN page_id % 11 = 10 THEN 301
    ELSE 200 END AS status,
  [{', '.join(_sql_text(s) for s in _STARTS)}][CAST(floor(page_id / 8) % 4 AS INTEGER) + 1] || body
    AS body FROM p)"""
_LISTED = "CASE path WHEN '.ENV' THEN '.env' WHEN 'db.sql.' THEN 'db.sql' ELSE path END"
_CONTENT = "CASE listed " + " ".join(
    f"WHEN {quoted(p)} THEN " + " OR ".join(
        f"regexp_matches(body, {quoted(x)})" for x in pats)
    for p, _, _, archive, pats in SENSITIVE_FILES if not archive and p in _PATHS) + " ELSE false END"


@query("sensitive_files", PROBES + f""",
l AS (SELECT *, {_LISTED} AS listed FROM probes WHERE status IN (200, 206))
SELECT host, path, listed AS listed_path, path <> listed AS is_variant,
  CASE listed WHEN '.env' THEN 'critical' WHEN 'db.sql' THEN 'critical' WHEN '.git/config' THEN
    'high' ELSE 'mid' END AS severity, count(*) AS pages FROM l WHERE {_CONTENT} GROUP BY ALL""")
def sensitive(spark, sf):
    return exposure.sensitive_files(_probes(spark, sf)).groupBy(
        "host", "path", "listed_path", "is_variant", "severity").agg(F.count("*").alias("pages"))


_LEAK = "CASE " + " ".join(
    f"WHEN regexp_matches(body, {quoted(p)}) THEN {quoted(n)}" for p, n, _ in LEAKED_FILES) + " END"


@query("leaked_files", PAGES.rstrip().rstrip(",") + f"""
SELECT page_id, {_LEAK} AS name, regexp_extract(body, 'root:.*?:0:0:') AS matched FROM p
WHERE ({_LEAK}) IS NOT NULL""")
def leaked(spark, sf):
    found = fixtures.responses(spark, sf).select("page_id", exposure.leaked_file(F.col("body"))
                                                 .alias("f"))
    return found.where(F.col("f").isNotNull()).select("page_id", "f.name", "f.matched")


@query("database_errors", PAGES.rstrip().rstrip(",") + """
SELECT page_id, CASE WHEN regexp_matches(body, 'you have an error in your sql syntax', 'i')
  THEN 'You have an error in your SQL syntax' ELSE 'mysqli_fetch_array' END AS error FROM p
WHERE """ + " OR ".join(f"regexp_matches(body, {quoted(p)}, 'i')" for p in DATABASE_ERRORS))
def database_errors(spark, sf):
    found = fixtures.responses(spark, sf).select("page_id", exposure.database_error(F.col("body"))
                                                 .alias("error"))
    return found.where(F.col("error").isNotNull())


@query("severity_bump", """
SELECT l_linenumber AS n, ['info','low','mid','high','critical','none','x'][l_linenumber] AS severity,
  ['low','mid','high','critical','critical','none','x'][l_linenumber] AS bumped, count(*) AS rows
FROM lineitem GROUP BY ALL""")
def bumped(spark, sf):
    names = F.array(*[F.lit(s) for s in ("info", "low", "mid", "high", "critical", "none", "x")])
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("n"), F.element_at(names, F.col("l_linenumber"))
        .alias("severity"))
    return rows.groupBy("n", "severity").agg(F.count("*").alias("rows")).withColumn(
        "bumped", exposure.bump(F.col("severity")))


@query("evidence_snippets", """
SELECT doc_id, CASE WHEN strpos(text, 'the') = 0 THEN '' ELSE trim(replace(substr(text,
  greatest(strpos(text, 'the') - 50, 1), strpos(text, 'the') + 53 - greatest(
  strpos(text, 'the') - 50, 1)), chr(10), ' ')) END AS snippet FROM documents""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(
        F.col("text"), F.lit("the")).alias("snippet"))


_TITLE = "regexp_extract(body, '(?is)<title.*?</title>')"
BASELINE = """
base AS (SELECT host, arg_min(body, seq) AS body FROM probes GROUP BY host)"""


def _baselines(probes):
    return probes.groupBy("host").agg(F.min_by("body", "seq").alias("body"))


@query("real_paths", PROBES + "," + BASELINE + f"""
SELECT p.host, count(*) AS paths FROM probes p JOIN base b USING (host)
WHERE status IN (200, 301, 403) AND NOT (status = 200 AND length(p.body) = length(b.body)
  AND {_TITLE.replace('body', 'p.body')} = {_TITLE.replace('body', 'b.body')}) GROUP BY p.host""")
def real_paths(spark, sf):
    """Probe answers that do not look like the first page of their host."""
    probes = _probes(spark, sf)
    return pages.real_paths(probes, _baselines(probes)).groupBy("host").agg(
        F.count("*").alias("paths"))


_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_GRAMS = ("list_distinct(list_transform(range(1, greatest(len({0}) - 2, 1) + 1), "
          "lambda i: array_to_string({0}[i:i + 2], ' ')))")


@query("baseline_similarity", PROBES + "," + BASELINE + f""",
w AS (SELECT p.host, p.seq, status, {_WORDS.format('p.body')} AS a, {_WORDS.format('b.body')} AS b
  FROM probes p JOIN base b USING (host)),
g AS (SELECT host, seq, status, {_GRAMS.format('a')} AS a, {_GRAMS.format('b')} AS b FROM w),
s AS (SELECT *, len(list_intersect(a, b)) AS c FROM g)
SELECT host, seq, round(c / (len(a) + len(b) - c), 6) AS similarity,
  c / (len(a) + len(b) - c) >= 0.98 AND status = 200 AS is_copy FROM s""")
def similarity(spark, sf):
    probes = _probes(spark, sf)
    return pages.near_baseline(probes, _baselines(probes)).select(
        "host", "seq", F.round("similarity", 6).alias("similarity"), "is_copy")


@query("path_listing", PROBES + """
SELECT host, '/' || path AS path, last(status ORDER BY seq) AS status,
  CAST(last(length(body) ORDER BY seq) AS INTEGER) AS size FROM probes GROUP BY host, path""")
def listing(spark, sf):
    return pages.path_listing(_probes(spark, sf))


@query("probe_status_summary", PROBES + """
SELECT count(*) FILTER (WHERE status = 200) AS accessible,
  count(*) FILTER (WHERE status = 403) AS forbidden,
  count(*) FILTER (WHERE status IN (301, 302)) AS redirect, count(*) AS total FROM probes""")
def status_summary(spark, sf):
    from wardlog.plans.reports import probe_status_summary
    return probe_status_summary(_probes(spark, sf))
