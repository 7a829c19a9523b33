"""Links, parameters and forms of stored pages; robots files; path listings; near-copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlog.constants import (BASELINE_SIMILARITY, EXISTS_CODES, FIELD_PATTERN, FORM_PATTERN,
                               LINK_PATTERN, SKIP_INPUT_TYPES, SKIP_PARAMS)
from wardlog.functions.text import decode_once, once, same_origin, url_scheme

DEFAULT_VALUE = "test"


def site_root(url: Column) -> Column:
    """scheme://authority of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, p: F.when(
        p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    trailing = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    joined = F.concat(F.array_join(kept, "/"), trailing)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def absolute(href: Column, root: Column) -> Column:
    """Resolve a reference against the site root, fragment cut."""
    ref = F.regexp_extract(href, r"^([^#]*)", 1)
    path = F.regexp_extract(ref, r"^([^?]*)", 1)
    query = F.regexp_extract(ref, r"(\?.*)$", 1)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    clean = F.when(rooted.rlike(r"/\.{1,2}(/|$)"), _without_dots(rooted)).otherwise(rooted)
    return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(url_scheme(root), F.lit(":"), ref))
            .when(ref == "", F.concat(root, F.lit("/")))
            .otherwise(F.concat(root, clean, query)))


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, link: same-origin links of each page, in page order."""
    skip = r"^(javascript:|mailto:|#)"
    found = pages.select("page_id", site_root(F.col("url")).alias("root"), F.posexplode(
        F.regexp_extract_all("body", F.lit("(?i)" + LINK_PATTERN), F.lit(1))
    ).alias("position", "href"))
    return (found.where(~F.col("href").rlike(skip))
            .withColumn("link", absolute(F.col("href"), F.col("root")))
            .where(same_origin(F.col("link"), F.col("root")))
            .select("page_id", "position", "link"))


def query_pairs(url: Column) -> Column:
    """Query parameters as (name, value) structs in order, decoded, blanks kept."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        decode_once(F.regexp_extract(p, r"^([^=]*)", 1)).alias("name"),
        decode_once(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value")))


def _last_values(pairs: Column) -> Column:
    """Map of parameters; of a repeated name the last value, at its first place."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(pairs, lambda p: p["name"] == n), -1)["value"]))


def link_parameters(found_links: DataFrame, source: str = "link") -> DataFrame:
    """One row per query parameter of each link, with all original values of that link."""
    pairs = F.filter(query_pairs(F.col("link")), lambda p: ~p["name"].isin(*SKIP_PARAMS))
    return (found_links.withColumn("_p", pairs).where(F.size("_p") > 0)
            .withColumn("params", _last_values(F.col("_p")))
            .select("page_id", "position", F.regexp_extract("link", r"^([^?]*)", 1).alias("url"),
                    "params", F.posexplode("_p").alias("field", "_pair"))
            .select("page_id", F.lit(source).alias("source"), "position", "field", "url",
                    F.lit("GET").alias("method"), F.col("_pair.name").alias("param"), "params"))


def attribute(text: Column, name: str) -> Column:
    """Value of a tag attribute, quoted or not; '' when absent."""
    both = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return F.concat(*[F.regexp_extract(text, both, i) for i in (1, 2, 3)])


def form_parameters(pages: DataFrame) -> DataFrame:
    """One row per named field of each form: address, method, field, all default values."""
    pattern = F.lit("(?is)" + FORM_PATTERN)
    field = F.lit("(?i)" + FIELD_PATTERN)
    forms = (pages.select("page_id", site_root(F.col("url")).alias("root"), F.posexplode(
        F.arrays_zip(F.regexp_extract_all("body", pattern, F.lit(1)).alias("attrs"),
                     F.regexp_extract_all("body", pattern, F.lit(2)).alias("inner")))
        .alias("position", "form"))
        .select("page_id", "root", "position", "form.attrs", "form.inner"))
    method = F.upper(F.coalesce(F.nullif(attribute(F.col("attrs"), "method"), F.lit("")),
                                F.lit("GET")))
    forms = (forms.withColumn("action", attribute(F.col("attrs"), "action"))
             .withColumn("method", method)
             .where(~F.col("action").rlike("^(javascript:|#)")
                    & F.col("method").isin("GET", "POST"))
             .withColumn("target", absolute(
                 F.coalesce(F.nullif("action", F.lit("")), F.lit("/")), F.col("root")))
             .where(same_origin(F.col("target"), F.col("root"))))
    tags = F.transform(F.arrays_zip(
        F.regexp_extract_all("inner", field, F.lit(1)).alias("tag"),
        F.regexp_extract_all("inner", field, F.lit(2)).alias("attrs")), lambda t: F.struct(
        F.lower(t["tag"]).alias("tag"), F.lower(attribute(t["attrs"], "type")).alias("type"),
        attribute(t["attrs"], "name").alias("name"),
        F.coalesce(F.nullif(attribute(t["attrs"], "value"), F.lit("")), F.lit(DEFAULT_VALUE))
        .alias("value")))
    usable = F.filter(tags, lambda t: (t["name"] != "") & ~t["name"].isin(*SKIP_PARAMS)
                      & ~((t["tag"] == "input") & t["type"].isin(*SKIP_INPUT_TYPES)))
    own = F.transform(usable, lambda t: F.struct(t["name"].alias("name"),
                                                 t["value"].alias("value")))
    # a form's own fields come first, then what its address carries
    pairs = F.concat(F.col("_own"), query_pairs(F.col("target")))
    names = F.array_distinct(F.transform("_all", lambda p: p["name"]))
    first = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter("_all", lambda p: p["name"] == n), 1)["value"]))
    return (forms.withColumn("_own", own).where(F.size("_own") > 0)
            .withColumn("_all", pairs).withColumn("params", first)
            .select("page_id", "position", "target", "method", "params",
                    F.posexplode(F.map_keys("params")).alias("field", "param"))
            .select("page_id", F.lit("form").alias("source"), "position", "field",
                    F.regexp_extract("target", r"^([^?]*)", 1).alias("url"), "method", "param",
                    "params"))


def first_targets(parameters: DataFrame) -> DataFrame:
    """The first of each (page, method, url, param): links before forms, in page order."""
    order = F.struct(F.when(F.col("source") == "link", 0).otherwise(1).alias("o"), "position",
                     "field")
    return parameters.groupBy("page_id", "method", "url", "param").agg(
        F.min_by(F.struct("source", "position", "field", "params"), order).alias("_f")).select(
        "page_id", "method", "url", "param", "_f.source", "_f.position", "_f.field", "_f.params")


def robots(text: Column) -> Column:
    """Struct of disallow, allow and sitemap values, each in order without repeats."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~x.startswith("#") & x.contains(":"))
    entries = F.transform(kept, lambda x: F.struct(
        F.lower(F.trim(F.regexp_extract(x, r"^([^:]*)", 1))).alias("field"),
        F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))

    def values(field):
        return F.array_distinct(F.transform(F.filter(
            entries, lambda e: (e["field"] == field) & (e["value"] != "")), lambda e: e["value"]))

    return F.struct(values("disallow").alias("disallow"), values("allow").alias("allow"),
                    values("sitemap").alias("sitemaps"))


def title_element(body: Column) -> Column:
    """The title element of a page; an unclosed one up to 120 characters; '' if none."""
    closed = F.regexp_extract(body, r"(?is)(<title.*?</title>)", 1)
    opened = F.regexp_extract(body, r"(?is)(<title.{0,114})", 1)
    return F.when(closed != "", closed).otherwise(opened)


def real_paths(responses: DataFrame, baselines: DataFrame) -> DataFrame:
    """Stored probe responses that exist and do not look like the host's known-absent page.

    responses: host, path, status, body; baselines: host, body, one per host.
    """
    base = baselines.groupBy("host").agg(F.max(F.struct(
        F.length("body").alias("size"), title_element(F.col("body")).alias("title"))).alias("_b"))
    exists = responses.where(F.col("status").isin(*EXISTS_CODES))
    copies = ((F.col("status") == 200) & (F.length("body") == F.col("_b.size"))
              & (title_element(F.col("body")) == F.col("_b.title")))
    return (exists.join(base, "host", "left")
            .where(~F.coalesce(copies, F.lit(False))).drop("_b"))


def path_listing(responses: DataFrame) -> DataFrame:
    """host, path, status, size: the last response of each path; sort with `listing_order`."""
    path = F.concat(F.lit("/"), F.trim(F.col("path"), F.lit("/")))
    return (responses.withColumn("path", path).groupBy("host", "path")
            .agg(F.max_by(F.struct("status", F.length("body").alias("size")), F.col("seq"))
                 .alias("_l")).select("host", "path", "_l.status", "_l.size"))


def listing_order() -> list[Column]:
    return [F.col("host"), (F.col("status") != 200).asc(), F.col("path")]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"),
                    lambda w: w != "")


def with_shingles(df: DataFrame, name: str, size: int = 3) -> DataFrame:
    """Distinct word shingles of the whole `body`; a shorter text is one shingle.

    The words are a column of their own: an expression inside a lambda would be evaluated again
    for every shingle.
    """
    words = F.col("_words")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))),
                        lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    ready = once(df, _words=words_of(F.col("body")))
    return once(ready, **{name: F.array_distinct(grams)}).drop("_words")


def near_baseline(responses: DataFrame, baselines: DataFrame,
                  limit: float = BASELINE_SIMILARITY) -> DataFrame:
    """Adds `similarity` to the host's known-absent page and `is_copy`.

    Jaccard similarity of word shingles over whole bodies; each response meets one baseline only.
    """
    base = with_shingles(baselines.groupBy("host").agg(F.max("body").alias("body")),
                         "_base").drop("body")
    common = F.size(F.array_intersect("_own", "_base"))
    every = F.size("_own") + F.size("_base") - common
    return (with_shingles(responses, "_own").join(base, "host", "left")
            .withColumn("similarity", F.coalesce(F.try_divide(common, every), F.lit(0.0)))
            .withColumn("is_copy", (F.col("similarity") >= limit)
                        & (F.col("status") == 200) & F.col("_base").isNotNull())
            .drop("_own", "_base"))

