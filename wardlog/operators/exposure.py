"""Analysis of stored responses: headers, technologies, versions, advisories, leaked content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardlog.constants import (ADVISORIES, ARCHIVE_MAGIC, DATABASE_ERRORS, FINGERPRINT_HEADERS,
                               LEAKED_FILES, MIN_HSTS_SECONDS, PATH_VARIANTS, SECURITY_HEADERS,
                               SENSITIVE_FILES, TECHNOLOGIES, WEAK_VALUES)
from wardlog.functions.text import once

SEVERITY_STEPS = ("info", "low", "mid", "high", "critical")


def lower_keys(headers: Column) -> Column:
    """Header map with lower-case names; of names that only differ in case the last one."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(
        F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def header(name: str, table: str = "_headers") -> Column:
    """Header value by name in any case; NULL when absent or empty."""
    return F.nullif(F.try_element_at(F.col(table), F.lit(name.lower())), F.lit(""))


def with_headers(responses: DataFrame) -> DataFrame:
    return responses.withColumn("_headers", lower_keys(F.col("headers")))


def _is_weak(name: str, low: Column) -> Column:
    if name == "X-Frame-Options":
        return low.isin("allowall", "allow-all", "*") | low.startswith("allow-from")
    if name == "Content-Security-Policy":
        return (low.rlike(r"default-src\s+\*|script-src\s+\*") | low.contains("unsafe-inline")
                | low.contains("unsafe-eval"))
    if name == "X-Content-Type-Options":
        return low != "nosniff"
    if name == "Strict-Transport-Security":
        # an age of more digits than a number holds is long enough; no age at all is not
        age = F.nullif(F.regexp_extract(low, r"max-age\s*=\s*(\d+)", 1), F.lit(""))
        return age.isNull() | F.coalesce(age.try_cast("decimal(38,0)") < MIN_HSTS_SECONDS,
                                         F.lit(False))
    return low.isin("unsafe-url", "no-referrer-when-downgrade", "")


def weak_reason(name: str, value: Column) -> Column:
    """Why a security header's value gives no protection; NULL when it does."""
    text = F.trim(F.coalesce(value, F.lit("")))
    shown = F.substring(text, 1, 60) if name == "Content-Security-Policy" else text
    return F.when(_is_weak(name, F.lower(text)), F.format_string(WEAK_VALUES[name], shown))


def header_audit(responses: DataFrame) -> DataFrame:
    """page_id, header, kind (missing or weak), severity, value, reason."""
    checks = []
    for name, severity, purpose in SECURITY_HEADERS:
        value = header(name)
        reason = weak_reason(name, value)
        checks.append(F.when(value.isNull(), F.struct(
            F.lit(name).alias("header"), F.lit("missing").alias("kind"),
            F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("value"),
            F.lit(purpose).alias("reason"))).when(reason.isNotNull(), F.struct(
                F.lit(name).alias("header"), F.lit("weak").alias("kind"),
                F.lit("mid").alias("severity"), value.alias("value"), reason.alias("reason"))))
    return (with_headers(responses)
            .select("page_id", F.explode_outer(F.array_compact(F.array(*checks))).alias("c"))
            .where(F.col("c").isNotNull()).select("page_id", "c.*"))


def header_rollup(audit: DataFrame) -> DataFrame:
    """page_id, missing, weak, total (at most one entry per security header)."""
    def names(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("header"))))
    return audit.groupBy("page_id").agg(names("missing").alias("missing"),
                                        names("weak").alias("weak"), F.count("*").alias("total"))


def fingerprint_headers(responses: DataFrame) -> DataFrame:
    """page_id, header, value of the headers that tell what serves the page."""
    entries = [F.when(header(n).isNotNull(), F.struct(
        F.lit(n).alias("header"), header(n).alias("value"))) for n in FINGERPRINT_HEADERS]
    return (with_headers(responses)
            .select("page_id", F.explode_outer(F.array_compact(F.array(*entries))).alias("h"))
            .where(F.col("h").isNotNull()).select("page_id", "h.*"))


def _header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(
        e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def _first_group(text: Column, pattern: str) -> Column:
    """First non-empty group of the first match; NULL without one."""
    groups = pattern.replace(r"\(", "").count("(") - pattern.count("(?:")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + pattern, i), F.lit(""))
                        for i in range(1, groups + 1)])


def technologies(responses: DataFrame) -> DataFrame:
    """page_id, name, category, version, place (content or header), in signature order."""
    ready = (responses.withColumn("_b", F.coalesce("body", F.lit("")))
             .withColumn("_h", _header_text(F.col("headers"))))
    everything = F.concat(F.col("_b"), F.lit("\n"), F.col("_h"))
    found = []
    for index, (name, category, body, head, version) in enumerate(TECHNOLOGIES):
        in_body = F.col("_b").rlike("(?i)" + body) if body else F.lit(False)
        in_head = F.col("_h").rlike("(?i)" + head) if head else F.lit(False)
        number = _first_group(everything, version) if version else F.lit(None).cast("string")
        found.append(F.when(in_body | in_head, F.struct(
            F.lit(index).alias("rank"), F.lit(name).alias("name"),
            F.lit(category).alias("category"), number.alias("version"),
            F.when(in_body, "content").otherwise("header").alias("place"))))
    return (ready.select("page_id", F.explode_outer(F.array_compact(F.array(*found))).alias("t"))
            .where(F.col("t").isNotNull()).select("page_id", "t.*"))


def parse_version(text: Column) -> Column:
    """First dotted number as an array of integers; NULL without one."""
    number = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1), F.lit(""))
    return F.transform(F.split(number, r"\."), lambda p: p.try_cast("bigint"))


def version_lt(current: Column, fixed: Column) -> Column:
    """Segment-wise comparison, the shorter one padded with zeros."""
    size = F.greatest(F.size(current), F.size(fixed))

    def padded(v):
        return F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), size - F.size(v)))

    return padded(current) < padded(fixed)


def advisory_of(name: Column) -> Column:
    """The first advisory whose pattern occurs in a component name, as a struct."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(pattern), F.struct(
        F.lit(component).alias("component"), F.lit(fixed).alias("fixed_in"),
        F.lit(cve).alias("cve"), F.lit(severity).alias("severity")))
        for component, pattern, fixed, cve, severity in ADVISORIES])


def vulnerable_components(found: DataFrame) -> DataFrame:
    """page_id, component, version, fixed_in, cve, severity: versions below the fixed one."""
    below = version_lt(parse_version(F.col("version")), parse_version(F.col("_a.fixed_in")))
    return (found.where(F.col("version").isNotNull()).withColumn("_a", advisory_of(F.col("name")))
            .where(F.col("_a").isNotNull() & F.coalesce(below, F.lit(False)))
            .select("page_id", "_a.component", "version", "_a.fixed_in", "_a.cve", "_a.severity")
            .dropDuplicates(["page_id", "component", "version"]))


def bump(severity: Column) -> Column:
    """One step up; an unknown severity stays."""
    steps = dict(zip(SEVERITY_STEPS, (*SEVERITY_STEPS[1:], SEVERITY_STEPS[-1])))
    pairs = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, severity), severity)


def _evidence(body: Column, pattern: Column) -> Column:
    """30 characters before to 60 after the first match, on one line, 200 at most."""
    at = F.regexp_instr(body, pattern)
    start = F.greatest(at - 30, F.lit(1))
    cut = F.substring(body, start, at + F.length(F.regexp_substr(body, pattern)) + 60 - start)
    return F.substring(F.trim(F.replace(cut, F.lit("\n"), F.lit(" "))), 1, 200)


def sensitive_files(responses: DataFrame) -> DataFrame:
    """Responses (host, path, status, headers, body) whose path and content show a sensitive file.

    A path spelt as a known variant counts as the listed one, one severity step higher. Only the
    patterns of the response's own path are tried.
    """
    variants = F.create_map(*[F.lit(x) for kv in PATH_VARIANTS for x in kv])
    asked = F.regexp_replace("path", "^/", "")
    ready = (with_headers(responses.where(F.col("status").isin(200, 206)))
             .withColumn("_asked", asked)
             .withColumn("_listed", F.coalesce(F.try_element_at(variants, F.col("_asked")),
                                               F.col("_asked"))))
    kind = header("content-type")
    cases = []
    for path, name, severity, archive, patterns in SENSITIVE_FILES:
        pattern, proof = F.lit(None).cast("string"), F.lit(None).cast("string")
        if archive:
            proof = F.when(F.col("body").startswith(ARCHIVE_MAGIC), "ZIP magic").when(
                F.lower(kind).contains("zip"), F.concat(F.lit("Content-Type: "), kind))
        else:
            pattern = F.coalesce(*[F.when(F.col("body").rlike(p), F.lit(p)) for p in patterns])
        cases.append(F.when(F.col("_listed") == path, F.struct(
            F.lit(name).alias("name"), F.lit(severity).alias("severity"),
            pattern.alias("pattern"), proof.alias("proof"))))
    found = once(ready, _f=F.coalesce(*cases)).where(
        F.col("_f.pattern").isNotNull() | F.col("_f.proof").isNotNull())
    is_variant = F.col("_asked") != F.col("_listed")
    return found.select(
        "host", "path", F.col("_listed").alias("listed_path"), "_f.name",
        F.when(is_variant, bump(F.col("_f.severity"))).otherwise(F.col("_f.severity"))
        .alias("severity"), is_variant.alias("is_variant"),
        F.coalesce("_f.proof", _evidence(F.col("body"), F.col("_f.pattern"))).alias("evidence"))


def leaked_file(body: Column, exclude: Column | None = None) -> Column:
    """First signature of a system file in a body (name, severity, matched), other than the
    baseline's."""
    cases = []
    for pattern, name, severity in LEAKED_FILES:
        hit = body.rlike(pattern)
        if exclude is not None:
            hit = hit & ~F.coalesce(exclude == name, F.lit(False))
        cases.append(F.when(hit, F.struct(
            F.lit(name).alias("name"), F.lit(severity).alias("severity"),
            F.regexp_substr(body, F.lit(pattern)).alias("matched"))))
    return F.coalesce(*cases)


def database_error(body: Column, patterns: Sequence[str] = DATABASE_ERRORS) -> Column:
    """Text of the first database error pattern that occurs; NULL without one.

    One alternation decides whether any occurs, so clean pages are searched once.
    """
    any_of = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.when(body.rlike(any_of), F.coalesce(
        *[F.regexp_substr(body, F.lit("(?i)" + p)) for p in patterns]))
