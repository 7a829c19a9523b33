"""Work that grows with the rows: frames that run, lines made only where needed, signatures as their patterns say."""

import random
import re

from pyspark.sql import functions as F

from wardlog.constants import SIGNATURE_PARTS, SIGNATURES
from wardlog.functions import timewin
from wardlog.functions.signatures import decode_once, has_class
from wardlog.operators.alerts import consolidate
from wardlog.operators.timeline import chunked, previous, trailing
from wardlog.plans.detection import detect, regex_hits
from wardlog.sources import fixtures
from wardlog.sources.rules import builtin_rules


def _slots(spark, n=400, span=500_000):
    rng = random.Random(5)
    times = sorted(rng.sample(range(span), n))
    return [(rng.choice("ab"), t, rng.randrange(3)) for t in times]


def test_trailing_sums_use_running_frames(spark):
    rows = _slots(spark)
    made = trailing(spark.createDataFrame(rows, "g string, epoch bigint, n bigint"), ["g"],
                    {"short": ("n", 700), "long": ("n", 170_000)})
    # a frame that moves at both ends is added up anew for every row
    assert not re.findall(r"RangeFrame, -?\d+", made._jdf.queryExecution().optimizedPlan().toString())
    for r in made.collect():
        for name, window in (("short", 700), ("long", 170_000)):
            assert r[name] == sum(n for g, t, n in rows if g == r.g and r.epoch - window <= t < r.epoch)


def test_previous_slot_within_window(spark):
    rows = _slots(spark)
    made = previous(spark.createDataFrame(rows, "g string, epoch bigint, n bigint"), ["g"], 2_000, "prev")
    for r in made.collect():
        assert r.prev == max((t for g, t, _ in rows if g == r.g and r.epoch - 2_000 <= t < r.epoch), default=None)


def test_lines_are_made_only_where_needed(spark, sf):
    counted = fixtures.security_events(spark, sf).groupBy("src_ip", "epoch").agg(F.count("*"))
    assert "date_format" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_signatures_match_as_their_patterns(spark):
    texts = [*fixtures.URLS, "", "/a?q=1+or+1=1", "/A/.ENV+x", "x;+id", "%3bcat", "--+", "a.bak?x", "on+load =1", "100%",
             "javascript%3A", "web.config", "boot.ini", "$(id)", "a|cat", "Sqlmap", "%2573qlmap", "%73qlmap", "<svg+onx=1>"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in SIGNATURES.items():
        plain = F.lower("t").rlike("(?U)" + pattern.lower()) | F.lower(decode_once(F.col("t"))).rlike("(?U)" + pattern.lower())
        rows = frame.select("t", has_class(F.col("t"), name).alias("got"), plain.alias("want")).collect()
        assert [r.t for r in rows if r.got] == [r.t for r in rows if r.want], name


def test_signatures_are_not_tested_inside_the_generator(spark, sf):
    rules = [r for r in builtin_rules() if r.rule_type == "regex"]
    plan = regex_hits(fixtures.security_events(spark, sf), rules)._jdf.queryExecution().optimizedPlan().toString()
    inside = [line for line in plan.split("\n") if "Generate explode" in line]
    assert inside and not [line for line in inside if "RLIKE" in line or "Contains(" in line]


def test_few_slots_are_copied_for_long_windows(spark):
    slots = spark.range(0, 40 * 86_400, 1_000).select(F.lit("a").alias("g"), F.col("id").alias("epoch"))
    made = chunked(slots, 2 * 86_400).agg(F.count_if("_own").alias("own"), F.count_if(~F.col("_own")).alias("copies")).first()
    assert made.own == slots.count() and made.copies <= 0.3 * made.own


def test_every_alternative_of_a_signature_is_found(spark):
    texts = {
        "sqli": ["union/**/all select", "sleep (", "pg_sleep(", "benchmark*(", "dbms_pipe.receive_message",
                 "waitfor delay", "or 1=1", "and ('1'='1", "information_schema", "concat(", "updatexml (", "extractvalue(",
                 "x --", "x--+", "x# ", ";--", "' or 1", "'or '2", "admin' --"],
        "xss": ["<script", "</script", "<img x onx=", "<svg onx =", "javascript :", "onerror =", "onload=", "onclick=",
                "onmouseover=", "onfocus=", "alert (", "prompt(", "confirm(", "document.cookie", "eval(", "String.fromCharCode"],
        "traversal": ["../", "..\\", "..%2f", "..%5c", "%2e%2e%2f", "%2e%2e/", "/etc/passwd", "/etc/shadow",
                      "/windows/win.ini", "boot.ini", "%252e%252e"],
        "cmdi": ["; id", "|cat", "&& ls", "$(x)", "`x`", "%0acat", "%3b id", "/bin/sh"],
        "sensitive_path": ["/.git/", "/.svn/", "/.hg/", "/.env", "/.htaccess", "/.ssh/", "web.config", "/phpmyadmin", "/adminer",
                           "/pma/", "a.bak", "a.old?", "a.orig", "a.swp", "a.sql", "a.zip", "a.tar.gz", "a.rar", "/db.tar",
                           "/www.gz", "/wp-config.php", "/config.php"],
        "double_encode": ["%2527", "%252d"],
    }
    for name, rows in texts.items():
        frame = spark.createDataFrame([(t,) for t in rows], "t string")
        plain = F.lower("t").rlike("(?U)" + SIGNATURES[name].lower()) | F.lower(decode_once(F.col("t"))).rlike(
            "(?U)" + SIGNATURES[name].lower())
        missed = frame.where(plain & ~has_class(F.col("t"), name)).collect()
        assert not missed and frame.where(plain).count() == len(rows), (name, missed)


def test_alternatives_are_searched_one_by_one(spark):
    rng = random.Random(11)
    bits = ["union", "select", "/**/", " ", "+", "%20", "(", "sleep", "concat", "=", "or", "and", "1", "'", "--", "#", ";", "admin",
            "<", "<img", "on", "load", "onclick", "script", "alert", "document.", "cookie", "..", "/", "\\", "%2f", "%2e", "%25",
            "2e", "27", "etc", "passwd", "id", "ls", "|", "&&", "$(", ")", "`", "%0a", "%3b", "/bin/", "sh", ".git", ".env", "config",
            "web", ".php", ".bak", ".zip", "/db", "?", " ", "\n", "%", "%%32%35", "Nmap", "É", "%4fr"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(3_000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in SIGNATURES.items():
        whole = "(?U)" + pattern.lower()
        plain = F.lower("t").rlike(whole) | F.lower(decode_once(F.col("t"))).rlike(whole)
        made = frame.select("t", has_class(F.col("t"), name).alias("got"))
        assert made.withColumn("want", plain).where("got <> want").collect() == [], name
        if len(SIGNATURE_PARTS[name]) > 1:   # a pattern of many alternatives is tried at every character
            assert whole not in made._jdf.queryExecution().optimizedPlan().toString(), name


def _optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_generators_get_numbers_only(spark, sf):
    """Arrays of structs, compacted, were made row by row by an interpreter."""
    seen = fixtures.security_events(spark, sf)
    rules = builtin_rules(window=172_800, threshold=3)
    for kind in ("regex", "aggregate"):
        own = [r for r in rules if r.rule_type == kind and r.count_mode != "distinct"]
        plan = _optimized(detect(seen, own))
        assert "Generate explode" in plan and "lambda" not in plan, kind


def test_each_matching_rule_gives_a_hit_with_its_own_text(spark, sf):
    seen = fixtures.security_events(spark, sf).where("seq < 400")
    rules = [r for r in builtin_rules() if r.rule_type == "regex"]
    apart = [regex_hits(seen, [r]).select("seq", "rule_id", "matched_text").collect() for r in rules]
    together = regex_hits(seen, rules).select("seq", "rule_id", "matched_text").collect()
    assert len({r.rule_id for r in together}) > 3
    assert sorted(together) == sorted(row for rows in apart for row in rows)


def test_slots_of_hits_are_sorted_by_time_first(spark):
    hits = spark.createDataFrame([("r", "1.1.1.1", 5, 1)], "rule_name string, src_ip string, epoch bigint, seq bigint").selectExpr(
        "*", "1 as rule_id", "'low' as severity", "'' as dst_ip", "'' as url", "'' as category", "'m' as matched_text",
        "cast(1 as bigint) as count")
    plan = consolidate(hits, samples=False)._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.split("\n") if "SortAggregate(key=" in line][-1]
    assert first.split("key=[")[1].startswith("epoch#")


def test_whole_seconds_of_times_without_a_calendar(spark):
    frame = spark.sql("""SELECT explode(array(timestamp_ntz'1969-12-31 23:59:59.4', timestamp_ntz'1970-01-01 00:00:00.9',
        timestamp_ntz'1900-01-01 00:00:00.1', timestamp_ntz'2024-02-29 12:34:56.999999', null)) AS ts""")
    assert [r.e for r in frame.select(timewin.floor_epoch(F.col("ts")).alias("e")).collect()] == [
        -1, 0, -2_208_988_800, 1_709_210_096, None]


def test_a_dot_alone_starts_no_search(spark):
    """Every line has an address; a pattern behind nothing but a dot would be searched in all of them."""
    assert all(more for parts in SIGNATURE_PARTS.values() for _, first, *more in parts if first == ".")
    frame = spark.createDataFrame([("GET /a%2Ebak?x",), ("/dump.tar",), ("/www%2egz 10.0.0.1",), ("/x.rar ",), ("/x.rarer",), ("10.0.0.1",)],
                                  "t string")
    assert [r.m for r in frame.select(has_class(F.col("t"), "sensitive_path").alias("m")).collect()] == [True] * 4 + [False] * 2
