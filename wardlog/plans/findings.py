"""Findings out of stored responses, and a table of findings that keep their status from scan to scan.

A finding is named by what it is about (type, url, parameter, subject), not by when or in which response it was seen, so
the same weakness has the same key in every scan. The table is a log of changed states: a scan reads the states of the
buckets its sites are in, and writes only what is new, different or gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.constants import ADVISORY_TITLES, FINDING_TEXTS
from wardlog.functions.text import label_of, once, snippet
from wardlog.operators import exposure
from wardlog.operators.pages import site_root
from wardlog.plans.reports import severity_rank
from wardlog.session import materialise
from wardlog.sources.commits import CommitLog, Record

BUCKETS = 256
OPEN, GONE = "open", "gone"
#: What a scan tells of a finding, and what names it.
TOLD = ("severity", "payload", "title", "evidence", "description", "fix")
KEYS = ("site", "vuln_type", "url", "param", "subject")
STATE = ("finding_key STRING, site STRING, vuln_type STRING, url STRING, param STRING, subject STRING, severity STRING, "
         "payload STRING, title STRING, evidence STRING, description STRING, fix STRING, status STRING, "
         "first_task STRING, changed_task STRING")


def finding_key() -> Column:
    """Lasting name of a finding. Lengths in front of the parts keep different parts from reading alike."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
             for c in KEYS if c != "site"]
    return F.sha2(F.concat(*parts), 256)


def _texts(kind: Column, subject: Column) -> list[Column]:
    templates = [F.create_map(*[F.lit(x) for k, t in FINDING_TEXTS.items() for x in (k, t[i])]) for i in range(3)]
    return [F.replace(F.try_element_at(t, kind), F.lit("%s"), subject).alias(name)
            for t, name in zip(templates, ("title", "description", "fix"))]


def _as_findings(rows: DataFrame, vuln_type: str, kind: Column, subject: Column, about: Column, url: Column,
                 evidence: Column, param: Column | None = None, payload: Column | None = None,
                 detail: Column | None = None) -> DataFrame:
    """`subject` is part of the key, `about` is what the texts name, `detail` ends the description."""
    title, description, fix = _texts(kind, about)
    if detail is not None:
        description = F.concat(description, F.lit("："), detail).alias("description")
    optional = [(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in (("param", param), ("payload", payload))]
    return rows.select("site", F.lit(vuln_type).alias("vuln_type"), url.alias("url"), subject.alias("subject"), "severity",
                       *optional, evidence.alias("evidence"), title, description, fix)


def _header_findings(sites: DataFrame) -> DataFrame:
    audit = exposure.header_audit(sites).withColumnRenamed("page_id", "site")
    evidence = F.when(F.col("kind") == "missing", F.concat(F.lit("响应头中没有 "), "header")).otherwise(
        F.concat("header", F.lit(": "), "value"))
    return _as_findings(audit, "security_headers", F.col("kind"), F.concat("header", F.lit("/"), "kind"), F.col("header"),
                        F.col("site"), evidence, detail=F.col("reason"))


def _component_findings(sites: DataFrame) -> DataFrame:
    found = exposure.vulnerable_components(exposure.technologies(sites)).withColumnRenamed("page_id", "site")
    version = F.concat("component", F.lit(" "), "version")
    detail = F.concat("cve", F.lit("，"), label_of(ADVISORY_TITLES, F.col("cve"), ""))
    return _as_findings(found, "cve_match", F.lit("cve_match"), F.col("component"), F.col("component"), F.col("site"),
                        F.concat(version, F.lit(" < "), "fixed_in"), payload=version, detail=detail)


def _body_findings(responses: DataFrame) -> DataFrame:
    """System files and database errors in bodies: one pass over them."""
    leak, error = exposure.leaked_file(F.col("body")), exposure.database_error(F.col("body"))
    read = once(responses, _leak=leak, _error=error).where(F.col("_leak").isNotNull() | F.col("_error").isNotNull())
    leaked = read.where(F.col("_leak").isNotNull()).withColumn("severity", F.col("_leak.severity"))
    failed = read.where(F.col("_error").isNotNull()).withColumn("severity", F.lit("high"))
    url, name = F.regexp_extract("url", "^([^?#]*)", 1), F.col("_leak.name")
    sent = {"param": F.col("param"), "payload": F.col("payload")}
    return _as_findings(
        leaked, "path_traversal", F.lit("path_traversal"), name, name, url,
        snippet(F.col("body"), F.col("_leak.matched")), **sent).unionByName(_as_findings(
            failed, "sqli", F.lit("sqli"), F.lit("error"), F.col("_error"), url,
            snippet(F.col("body"), F.col("_error")), **sent))


def _file_findings(probes: DataFrame) -> DataFrame:
    asked = probes.withColumn("host", site_root(F.col("url")))
    found = exposure.sensitive_files(asked).withColumnRenamed("host", "site")
    path = F.regexp_replace("path", "^/", "")
    return _as_findings(found, "sensitive_file", F.lit("sensitive_file"), F.col("listed_path"),
                        F.concat("name", F.lit("（/"), path, F.lit("）")), F.concat("site", F.lit("/"), path),
                        F.col("evidence"), payload=path)


def findings_of(responses: DataFrame, probes: DataFrame) -> DataFrame:
    """finding_key, KEYS, TOLD: one row per finding.

    `responses` has url, headers, body and, where a value was sent to a parameter, `param` and `payload`; `probes` has url,
    path, status, headers, body. Headers and components are findings of the site, contents of the url without
    its query. Of responses that show one finding the worst severity, then the least evidence is told.
    A response whose url has no scheme and authority belongs to no site and is not examined.
    """
    rows = responses.withColumn("site", site_root(F.col("url"))).where(F.col("site") != "")
    for name in ("param", "payload"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    sites = rows.withColumn("page_id", F.col("site"))
    every = _header_findings(sites).unionByName(_component_findings(sites)).unionByName(
        _body_findings(rows)).unionByName(_file_findings(probes.where(site_root(F.col("url")) != "")))
    told = F.struct(severity_rank(F.col("severity")).alias("rank"), "evidence", *[c for c in TOLD if c != "evidence"])
    merged = every.groupBy(*KEYS).agg(F.min(told).alias("_t"))
    return merged.select(finding_key().alias("finding_key"), *KEYS, *[f"_t.{c}" for c in TOLD])


def bucket_of(site: Column) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(BUCKETS)).cast("string")


class Findings:
    """The findings table under `root`. `record_scan` and `set_status` write one commit each."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.log = CommitLog(spark, root, {"findings": STATE}, bucket_of(F.col("site")))

    def states(self, buckets: list[str] | None = None) -> DataFrame:
        """The newest state of each finding."""
        rest = [c for c in self.log.read("findings", Record()).columns if c not in ("finding_key", "commit")]
        return self.log.read("findings", self.log.record(), buckets).groupBy("finding_key").agg(
            F.max_by(F.struct(*rest), "commit").alias("_s")).select("finding_key", "_s.*")

    def _commit(self, changes: DataFrame) -> int:
        """Write changed states and publish them; returns how many there are."""
        changes = materialise(changes)
        before = self.log.record()
        record = Record(before.commit + 1, files={t: {d: list(f) for d, f in days.items()}
                                                  for t, days in before.files.items()})
        written = self.log.write("findings", changes, record.commit)
        table = record.files.setdefault("findings", {})
        for day, folders in written.items():
            table[day] = table.get(day, []) + folders
        self.log.finish(record, before)
        return changes.count()

    def record_scan(self, task: str, responses: DataFrame, probes: DataFrame) -> int:
        """Take in a scan; returns the number of states that changed.

        New findings are `open`. A finding that is seen again keeps its status, except that a `gone` one is `open` again. An
        open finding of a scanned site that is not seen any more is `gone`; other sites and other statuses (what an
        analyst decided) stay. Doing a scan again changes nothing.
        """
        site = site_root(F.col("url")).alias("site")
        scanned = materialise(responses.select(site).union(probes.select(site)).where("site <> ''").distinct())
        buckets = [r[0] for r in scanned.select(bucket_of(F.col("site"))).distinct().collect()]   # BUCKETS at most
        old = self.states(sorted(buckets)).join(scanned, "site", "left_semi")
        new = findings_of(responses, probes)
        both = old.alias("o").join(new.alias("n"), F.col("o.finding_key") == F.col("n.finding_key"), "full_outer")
        seen, known = F.col("n.finding_key").isNotNull(), F.col("o.finding_key").isNotNull()
        status = (F.when(~known, OPEN).when(seen & (F.col("o.status") == GONE), OPEN)
                  .when(~seen & (F.col("o.status") == OPEN), GONE).otherwise(F.col("o.status")))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in TOLD]
        unlike = F.array_contains(F.array(*same), False)
        changed = ~known | (status != F.col("o.status")) | (seen & unlike)
        kept = ("finding_key", *KEYS, *TOLD)
        rows = both.where(changed).select(
            *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in kept], status.alias("status"),
            F.coalesce("o.first_task", F.lit(task)).alias("first_task"), F.lit(task).alias("changed_task"))
        return self._commit(rows)

    def set_status(self, keys: DataFrame, status: str, task: str) -> int:
        """Give the findings named by `keys` (finding_key, site) a status; unknown keys are left out."""
        wanted = materialise(keys.select("finding_key", "site").distinct())
        buckets = [r[0] for r in wanted.select(bucket_of(F.col("site"))).distinct().collect()]
        rows = self.states(sorted(buckets)).join(wanted, ["finding_key", "site"], "left_semi")
        return self._commit(rows.where(F.col("status") != status).withColumns(
            {"status": F.lit(status), "changed_task": F.lit(task)}))
