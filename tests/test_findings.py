"""Findings of stored responses, and what becomes of them from scan to scan."""

from wardlog.plans.findings import Findings, findings_of
from wardlog.sources import commits

RESPONSE = "url string, headers map<string, string>, body string, param string, payload string"
PROBE = "url string, path string, status int, headers map<string, string>, body string"
GOOD = {"X-Frame-Options": "DENY", "Content-Security-Policy": "default-src 'self'", "X-Content-Type-Options": "nosniff",
        "Strict-Transport-Security": "max-age=31536000", "Referrer-Policy": "no-referrer"}


def _scan(spark, responses, probes=()):
    return spark.createDataFrame(list(responses), RESPONSE), spark.createDataFrame(list(probes), PROBE)


def _by_type(df):
    return sorted((r.vuln_type, r.subject, r.url, r.param, r.severity) for r in df.collect())


def test_findings_of_all_kinds(spark):
    weak = {**GOOD, "Referrer-Policy": "unsafe-url"}
    body = "<script src='/js/jquery-1.12.4.min.js'></script>"
    error = "x" * 300 + " You have an error in your SQL syntax; near"
    responses, probes = _scan(spark, [
        ("http://a.example/", weak, body, None, None), ("http://a.example/again", weak, body, None, None),
        ("http://a.example/i?id=1", GOOD, error, "id", "1'"), ("http://a.example/i?id=2", GOOD, error, "id", "2'"),
        ("http://b.example/f", GOOD, "root:x:0:0:root", "name", "../etc/passwd"), ("no site", {}, body, None, None),
        (None, None, None, None, None), ("http://c.example/", GOOD, None, None, None)],
        [("http://a.example/.ENV", ".ENV", 200, {}, "DB_PASSWORD=abc"), ("http://a.example/.env", ".env", 404, {}, "DB_PASSWORD=a"),
         (None, ".env", 200, {}, "DB_PASSWORD=abc")])
    found = findings_of(responses, probes)
    assert _by_type(found) == sorted([
        ("security_headers", "Referrer-Policy/weak", "http://a.example", None, "mid"),
        ("cve_match", "jQuery", "http://a.example", None, "mid"),
        ("sqli", "error", "http://a.example/i", "id", "high"),
        ("path_traversal", "/etc/passwd 账户文件", "http://b.example/f", "name", "critical"),
        ("sensitive_file", ".env", "http://a.example/.ENV", None, "critical")],)
    told = {r.vuln_type: r for r in found.collect()}
    assert told["sqli"].payload == "1'" and "You have an error" in told["sqli"].evidence
    assert told["cve_match"].evidence == "jQuery 1.12.4 < 3.5.0" and "CVE-2020-11022" in told["cve_match"].description
    assert all(r.title and r.description and r.fix and "%s" not in r.title + r.description + r.fix for r in told.values())
    assert found.select("finding_key").distinct().count() == 5


def test_status_lasts_over_scans(spark, tmp_path):
    missing = {k: v for k, v in GOOD.items() if k not in ("Referrer-Policy", "X-Frame-Options")}
    first = _scan(spark, [("http://a.example/", missing, "", None, None), ("http://b.example/", missing, "", None, None)])
    table = Findings(spark, str(tmp_path / "findings"))
    assert table.record_scan("t1", *first) == 4 and table.record_scan("t1", *first) == 0

    def states():
        return {(r.site[7], r.subject.split("/")[0]): (r.status, r.first_task) for r in table.states().collect()}

    ignored = table.states().where("site = 'http://a.example' and subject like 'X-Frame%'")
    assert table.set_status(ignored, "ignored", "analyst") == 1 and table.set_status(ignored, "ignored", "analyst") == 0
    # a site that was not scanned keeps its findings; what is not seen any more on a scanned one is gone
    assert table.record_scan("t2", *_scan(spark, [("http://a.example/", GOOD, "", None, None)])) == 1
    assert states() == {("a", "X-Frame-Options"): ("ignored", "t1"), ("a", "Referrer-Policy"): ("gone", "t1"),
                        ("b", "X-Frame-Options"): ("open", "t1"), ("b", "Referrer-Policy"): ("open", "t1")}
    worse = {**missing, "X-Content-Type-Options": "other"}
    assert table.record_scan("t3", *_scan(spark, [("http://a.example/", worse, "", None, None)])) == 2
    assert states()[("a", "Referrer-Policy")] == ("open", "t1") and states()[("a", "X-Frame-Options")] == ("ignored", "t1")
    assert states()[("a", "X-Content-Type-Options")] == ("open", "t3")


def test_empty_scans_and_many_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FAN", 2)
    table = Findings(spark, str(tmp_path / "findings"))
    assert table.record_scan("t0", *_scan(spark, [])) == 0 and table.states().count() == 0
    for i in range(3):        # more commits than a bucket keeps folders
        value = {**GOOD, "Referrer-Policy": "unsafe-url" if i % 2 else "no-referrer-when-downgrade"}
        assert table.record_scan(f"t{i}", *_scan(spark, [("http://a.example/", value, "", None, None)])) == 1
    only = table.states().collect()
    assert len(only) == 1 and only[0].first_task == "t0" and only[0].changed_task == "t2"
