"""The driver's tables seen as security data, by plain arithmetic on their columns.

`events` becomes normalised events and, rendered back, raw lines in the three formats; `pages`
becomes stored responses. Spark and SQL can both compute these, which makes results comparable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.functions import timewin
from wardlog.functions.text import url_host
from wardlog.session import spread

YEAR = 2024
# tables whose rows are costly to evaluate, and the key that spreads them evenly
SPREAD_BY = {"events": "event_id", "pages": "page_id"}
PREFIXES = ("10.0.0.", "203.0.113.", "45.155.205.", "113.108.20.", "171.208.33.", "8.8.8.")
USERS = ("root", "admin", "alice", "bob")
AGENTS = ("Mozilla/5.0 (X11; Linux x86_64)", "curl/8.4.0", "-", "", "sqlmap/1.7")
URLS = (
    "/catalog?name=D%27Angelo+boots", "/jobs?title=trade+union+officer", "/orders/view.php?id=998877665544",
    "/files/get?name=minutes-2025-11.odt", "/v2/accounts?offset=40&limit=20", "/blog/2024/../2023/intro",
    "/stock.php?sku=77+union+all+select+login,hash+from+staff--",
    "/forum/find?text=%3Cscript%20src%3D%2F%2Fcdn.invalid%2Fa.js%3E", "/static?name=../../../etc/shadow",
    "/tools/trace?to=198.51.100.7%3Bcat+/etc/shadow", "/.svn/entries",
    "/stock.php?sku=5%2527%2520or%25207%253D7",
)
FINDING_TYPES = ("sqli", "xss", "path_traversal", "sensitive_file", "security_headers")


# appended to every sixth page: links, a form, libraries, a robots file, an error, a leaked file
FRAGMENTS = (
    '<a href="/product.php?id=1&lang=zh&token=9&id=2">p</a><a href="../up/./x?q=a%20b+c#f">r</a>'
    '<a href="https://other.example.com/x?y=1">o</a><a href="javascript:void(0)">j</a>',
    '<form action="/search?cat=2" method="post"><input name="q"><input type="submit" name="go">'
    "<textarea name=msg value='hi'></textarea><select NAME=\"csrf_token\"></select></form>",
    '<script src="/js/jquery-1.12.4.min.js"></script><link href="/css/bootstrap-3.4.1.css">'
    '<img src="/wp-content/a.png"><meta content="WordPress 6.1">',
    "\nUser-agent: *\nDisallow: /admin\n disallow : /admin\nAllow: /pub\n# Disallow: /no\n"
    "Sitemap: http://h/s.xml\nDisallow: /tmp\n",
    "<b>Warning: mysqli_fetch_array() expects parameter</b> You have an error in your SQL syntax;",
    "<pre>root:x:0:0:root:/root:/bin/bash</pre>",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD_BY[name]) if name in SPREAD_BY else df


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", "value", k.alias("k"),
        timewin.floor_epoch(F.col("ts")).alias("epoch"),
    ).withColumn("ts", timewin.ts_of(F.col("epoch")))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events without going through text."""
    kind = F.col("event_type")
    is_ssh, is_scan = kind.isin("error", "signup"), kind == "purchase"
    is_web = ~is_ssh & ~is_scan
    k = F.col("k")
    flags = _pick(("", "FIN", "SYN"), k % 3)
    base = _columns(spark, sf_dir).select(
        "seq", "ts", "epoch", "k", "event_type", "value", "user_id",
        F.when(is_ssh, "ssh").when(is_scan, "scan").otherwise("web").alias("log_type"),
        F.concat(_pick(PREFIXES, F.col("user_id") % 6), (F.col("user_id") % 250).cast("string"))
        .alias("src_ip"),
        F.when(is_scan, F.concat(F.lit("192.168.1."), (k % 20).cast("string"))).alias("dst_ip"),
        F.when(is_ssh, 40000 + k).alias("src_port"),
        F.when(is_ssh, 22).when(is_scan, 1000 + k).alias("dst_port"),
        F.when(is_ssh | is_scan, "tcp").alias("proto"),
        F.when(kind == "click", "POST").when(is_web, "GET").alias("method"),
        F.when(is_web, _pick(URLS, k % 12)).alias("url"),
        F.when(is_web, F.when(k % 5 == 0, 404).when(k % 7 == 0, 500).otherwise(200))
        .alias("status_code"),
        F.when(is_web, _pick(AGENTS, k % 5)).alias("user_agent"),
        F.when(is_ssh, _pick(USERS, k % 4)).alias("username"),
        F.when(is_ssh, F.create_map(F.lit("event"), F.when(kind == "error", "failed")
                                    .otherwise("success")))
        .when(is_scan & (flags != ""), F.create_map(F.lit("state"), F.lit("open"),
                                                    F.lit("flags"), flags))
        .when(is_scan, F.create_map(F.lit("state"), F.lit("open")))
        .otherwise(F.create_map(F.lit("referer"), F.lit("-"), F.lit("size"),
                                (100 + k).cast("string"))).alias("detail"),
        flags.alias("_flags"))
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    clock = F.date_format("ts", "HH:mm:ss")
    head = F.concat(F.date_format("ts", "MMM"), F.lit(" "), day, F.lit(" "), clock,
                    F.lit(" server sshd["), k.cast("string"), F.lit("]: "))
    tail = F.concat(F.col("username"), F.lit(" from "), F.col("src_ip"), F.lit(" port "),
                    F.col("src_port").cast("string"))
    failed = (F.when(k % 3 == 0, F.concat(F.lit("Failed password for "), tail, F.lit(" ssh2")))
              .when(k % 3 == 1, F.concat(F.lit("Failed password for invalid user "), tail,
                                         F.lit(" ssh2")))
              .otherwise(F.concat(F.lit("Invalid user "), tail)))
    ssh = F.concat(head, F.when(kind == "error", failed).otherwise(
        F.concat(F.lit("Accepted password for "), tail, F.lit(" ssh2"))))
    scan = F.concat_ws(",", F.date_format("ts", timewin.ISO), "src_ip", "dst_ip",
                       F.col("dst_port").cast("string"), F.lit("tcp"), F.lit("open"),
                       F.nullif("_flags", F.lit("")))
    web = F.concat("src_ip", F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
                   F.lit(" +0800] \""), "method", F.lit(" "), "url", F.lit(" HTTP/1.1\" "),
                   F.col("status_code").cast("string"), F.lit(" "), (100 + k).cast("string"),
                   F.lit(" \"-\" \""), "user_agent", F.lit("\""))
    raw = F.when(F.col("log_type") == "ssh", ssh).when(F.col("log_type") == "scan", scan)
    # a plain column, so that plans which do not need the line never make it
    return base.withColumn("raw", raw.otherwise(web)).drop("_flags")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines with their arrival number; what the parsers are run on."""
    return security_events(spark, sf_dir).select("seq", F.col("raw").alias("value"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored responses: the page, and headers synthesised from the page number."""
    variant = F.col("page_id") % 4
    headers = (
        F.when(variant == 0, F.create_map(*map(F.lit, (
            "Server", "nginx/1.24.0 (Ubuntu)", "X-Frame-Options", "ALLOWALL",
            "Strict-Transport-Security", "max-age=3600"))))
        .when(variant == 1, F.create_map(*map(F.lit, (
            "server", "Apache/2.4.57", "x-powered-by", "PHP/8.1.2", "content-security-policy",
            "default-src *; script-src 'unsafe-inline'", "x-frame-options", "DENY"))))
        .when(variant == 2, F.create_map(*map(F.lit, (
            "Server", "openresty/1.21.4", "X-Content-Type-Options", "sniff", "Referrer-Policy",
            "unsafe-url"))))
        .otherwise(F.create_map(*map(F.lit, (
            "Via", "1.1 cache", "X-Content-Type-Options", "nosniff",
            "Strict-Transport-Security", "max-age=31536000; includeSubDomains",
            "Referrer-Policy", "no-referrer", "X-Frame-Options", "SAMEORIGIN",
            "Content-Security-Policy", "default-src 'self'")))))
    return table(spark, sf_dir, "pages").select(
        "page_id", url_host(F.col("url")).alias("host"), "url", F.lit(200).alias("status_code"),
        headers.alias("headers"),
        F.concat("html", _pick(FRAGMENTS, F.col("page_id") % len(FRAGMENTS))).alias("body"))
