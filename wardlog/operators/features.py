"""Behaviour features per source address and tumbling window.

Every distinct count, the status histogram and the seconds of a window come from one expanded
aggregate: events become (dimension, value) rows, are combined map-side per value, and a second
aggregate reads all features off the value counts. A hot source is spread over its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardlog.constants import FEATURES, SPECIAL_CHARS
from wardlog.functions import timewin
from wardlog.functions.filters import is_failure

_SUMS = ("fail", "web", "err", "urls", "url_chars", "special", "chars")


def value_counts(events: DataFrame, window: int, bucket: Column | None = None) -> DataFrame:
    """(src_ip, bucket, dim, value) -> n, with the additive sums on the `sec` rows.

    The bucket is the second a window begins with, or what is given (on streams the window itself).
    """
    if bucket is None:
        bucket = timewin.floor_to(F.col("epoch"), window)
    web = F.col("log_type") == "web"
    url = F.nullif("url", F.lit(""))
    text = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("raw", F.lit("")))
    base = (events.where((F.col("src_ip") != "") & F.col("epoch").isNotNull())
            .select("src_ip", bucket.alias("bucket"), "epoch",
                    F.nullif("dst_port", F.lit(0)).cast("string").alias("port"),
                    F.nullif("dst_ip", F.lit("")).alias("dst"),
                    F.nullif("user_agent", F.lit("")).alias("ua"),
                    F.nullif("username", F.lit("")).alias("user"),
                    F.when(web, F.col("status_code").cast("string")).alias("status"),
                    is_failure().cast("int").alias("fail"), web.cast("int").alias("web"),
                    F.coalesce((web & (F.col("status_code") >= 400)).cast("int"), F.lit(0))
                    .alias("err"),
                    F.when(url.isNotNull(), 1).otherwise(0).alias("urls"),
                    F.coalesce(F.length(url), F.lit(0)).alias("url_chars"),
                    (F.length(text) - F.length(F.translate(text, SPECIAL_CHARS, "")))
                    .alias("special"), F.length(text).alias("chars")))

    def entry(dim: str, value: Column, sums: bool = False) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.alias("value"),
                        *[(F.col(s) if sums else F.lit(0)).alias(s) for s in _SUMS])

    entries = F.array(entry("sec", F.col("epoch").cast("string"), True),
                      *[entry(d, F.col(d)) for d in ("port", "dst", "ua", "user", "status")])
    wanted = F.filter(entries, lambda e: e["value"].isNotNull())
    return (base.select("src_ip", "bucket", F.explode(wanted).alias("e"))
            .select("src_ip", "bucket", "e.*").groupBy("src_ip", "bucket", "dim", "value")
            .agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in _SUMS]))


def ip_features(events: DataFrame, window: int = 60, min_events: int = 1) -> DataFrame:
    """src_ip, bucket and the twelve features, rounded as published."""
    return features_of(value_counts(events, window), F.col("bucket"), min_events)


def features_of(counts: DataFrame, bucket: Column, min_events: int = 1) -> DataFrame:
    """Features of value counts, per source and bucket."""
    dim, n = F.col("dim"), F.col("n")
    status_n = F.when(dim == "status", n)
    seconds = F.collect_list(F.when(dim == "sec", F.col("value").cast("bigint")))
    wide = counts.groupBy("src_ip", bucket.alias("bucket")).agg(
        F.sum(F.when(dim == "sec", n)).alias("events"),
        *[F.count_if(dim == d).alias(name) for d, name in (
            ("port", "uniq_dst_ports"), ("dst", "uniq_dst_ips"), ("ua", "uniq_uas"),
            ("user", "uniq_usernames"))],
        F.coalesce(F.sum(status_n), F.lit(0)).alias("_statuses"),
        F.coalesce(F.sum(status_n * F.log2(status_n)), F.lit(0.0)).alias("_nlogn"),
        # at most one entry per second of the window
        F.array_sort(seconds).alias("_secs"),
        *[F.sum(s).alias(f"_{s}") for s in _SUMS]).where(F.col("events") >= min_events)

    gaps = F.col("events") - 1
    span = F.array_max("_secs") - F.array_min("_secs")
    squares = F.aggregate(
        "_secs", F.struct(F.get("_secs", F.lit(0)).alias("prev"),
                          F.lit(0).cast("bigint").alias("sum")),
        lambda s, x: F.struct(x.alias("prev"), (s["sum"] + (x - s["prev"]) * (x - s["prev"]))
                              .alias("sum")), lambda s: s["sum"])
    mean = F.when(gaps >= 1, F.round(span / gaps, 3)).otherwise(0.0)
    spread = squares - 2 * mean * span + gaps * mean * mean
    columns = {
        "fail_ratio": F.round(F.col("_fail") / F.col("events"), 4),
        "error_ratio": F.when(F.col("_web") > 0, F.round(F.col("_err") / F.col("_web"), 4))
        .otherwise(0.0),
        "url_avg_len": F.when(F.col("_urls") > 0, F.round(F.col("_url_chars") / F.col("_urls"), 2))
        .otherwise(0.0),
        "special_char_ratio": F.when(F.col("_chars") > 0,
                                     F.round(F.col("_special") / F.col("_chars"), 6))
        .otherwise(0.0),
        "interval_mean": mean,
        "interval_std": F.when(gaps >= 2, F.round(
            F.sqrt(F.greatest(spread, F.lit(0.0)) / (gaps - 1)), 3)).otherwise(0.0),
        "status_entropy": F.when(F.col("_statuses") > 0, F.round(F.greatest(
            F.log2("_statuses") - F.col("_nlogn") / F.col("_statuses"), F.lit(0.0)), 4))
        .otherwise(0.0),
    }
    return wide.withColumns(columns).select(
        "src_ip", "bucket", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def feature_vector(features: DataFrame, columns=FEATURES, name: str = "features") -> DataFrame:
    """The twelve columns as one array in fixed order."""
    return features.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))
