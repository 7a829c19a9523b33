"""Log lines to events.

A line is matched once per format at most: the match is rewritten to `kind SEP group1 SEP ...`
and split, so picking eight fields costs one regex pass and not eight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.constants import (PORT_PROBE, SOURCE_TYPE_ALIASES, SSH_INVALID_USER, SSH_LOGIN,
                               WEB_ACCESS)
from wardlog.functions import timewin
from wardlog.functions.text import once

# U+FDD0 is a code point reserved for internal use by programs; in input it is treated like an
# undecodable character.
SEP = "﷐"
UNDECODABLE = "�"

# kind -> (format, number of groups, source type)
FORMATS = {
    "login": (SSH_LOGIN, 5, "ssh"),
    "invalid": (SSH_INVALID_USER, 4, "ssh"),
    "web": (WEB_ACCESS, 8, "web"),
    "probe": (PORT_PROBE, 7, "scan"),
}


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text scan; bytes that are not UTF-8 become replacement characters.

    `seq` numbers the lines of a split in their order and splits in the order they are read, without a
    shuffle. It settles ties within a second; a producer that knows the arrival can supply its own.
    """
    return spark.read.text(paths).select(F.monotonically_increasing_id().alias("seq"), "value")


def _groups(line: Column, kind: str) -> Column:
    pattern, count, _ = FORMATS[kind]
    replacement = SEP.join([kind] + [f"${i}" for i in range(1, count + 1)])
    return F.nullif(F.regexp_replace(line, pattern + r"[\s\S]*$", replacement), line)


def _syslog_time(text: Column, year: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(text), r"\s+", " ")
    return timewin.parse(F.concat_ws(" ", year.cast("string"), squeezed), "yyyy MMM d HH:mm:ss")


def _access_time(text: Column) -> Column:
    """Wall-clock digits; the offset has to be there and is ignored."""
    text = F.trim(text)
    digits = F.when(text.rlike(r"^\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} (?:[+-]\d{2}:?\d{2}|Z)$"),
                    F.regexp_extract(text, r"^(\S+)", 1))
    return timewin.parse(digits, "d/MMM/yyyy:HH:mm:ss")


def _probe_time(text: Column) -> Column:
    text = F.trim(text)
    return F.coalesce(timewin.parse(text, timewin.ISO), timewin.parse(text, "yyyy-MM-dd HH:mm:ss"))


def _matched(source_type: str | Column, line: Column) -> Column:
    """First matching format among those the source type allows, as an array of groups."""
    safe = F.translate(line, SEP, UNDECODABLE)
    if isinstance(source_type, str):
        wanted = SOURCE_TYPE_ALIASES.get(source_type.strip().lower())
        tries = [_groups(safe, kind) for kind, (_, _, family) in FORMATS.items()
                 if wanted in ("auto", family)]
    else:
        aliases = F.create_map(*[F.lit(x) for pair in SOURCE_TYPE_ALIASES.items() for x in pair])
        wanted = F.try_element_at(aliases, F.lower(F.trim(source_type)))
        tries = [F.when(wanted.isin("auto", family), _groups(safe, kind))
                 for kind, (_, _, family) in FORMATS.items()]
    found = F.coalesce(*tries) if tries else F.lit(None).cast("string")
    return F.split(found, SEP)


def parse(lines: DataFrame, source_type: str | Column = "auto", *, year: int | Column,
          line: str = "value", now: Column | None = None,
          keep: Sequence[str] = ()) -> DataFrame:
    """Lines to events; a line that fits no format has `log_type` NULL.

    `source_type` is one of the known aliases, or a column of them; unknown types parse nothing.
    A time that cannot be read is NULL with `ts_fallback`, or `now` where the caller gives one.
    `keep` names columns of `lines` carried along (for instance `seq`).
    """
    year = F.lit(year) if isinstance(year, int) else year
    trimmed = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"^\s+|\s+$", "")
    matched = once(lines.withColumn("raw", trimmed), _g=_matched(source_type, F.col("raw")))

    def pick(**positions: int) -> Column:
        """The group at a position that depends on the kind of line."""
        cases = None
        for name, index in positions.items():
            test = kind == name
            cases = (F.when if cases is None else cases.when)(test, F.get("_g", F.lit(index)))
        return cases

    kind = F.get("_g", F.lit(0))
    is_ssh = kind.isin("login", "invalid")
    parsed_ts = (F.when(is_ssh, _syslog_time(F.get("_g", F.lit(1)), year))
                 .when(kind == "web", _access_time(F.get("_g", F.lit(2))))
                 .when(kind == "probe", _probe_time(F.get("_g", F.lit(1)))))
    outcome = F.when(F.get("_g", F.lit(2)) == "Accepted", "success").otherwise("failed")
    flags = F.get("_g", F.lit(7))
    state = F.create_map(F.lit("state"), F.get("_g", F.lit(6)))
    detail = (
        F.when(kind == "login", F.create_map(F.lit("event"), outcome))
        .when(kind == "invalid", F.create_map(F.lit("event"), F.lit("failed"),
                                              F.lit("reason"), F.lit("invalid_user")))
        .when(kind == "web", F.create_map(F.lit("referer"), F.get("_g", F.lit(7)),
                                          F.lit("size"), F.get("_g", F.lit(6))))
        .when((kind == "probe") & (flags != ""),
              F.map_concat(state, F.create_map(F.lit("flags"), flags)))
        .when(kind == "probe", state))

    fields = matched.select(
        *keep,
        (F.coalesce(parsed_ts, F.when(kind.isNotNull(), now)) if now is not None else parsed_ts)
        .alias("ts"),
        F.when(is_ssh, "ssh").when(kind == "web", "web").when(kind == "probe", "scan")
        .alias("log_type"),
        pick(login=4, invalid=3, web=1, probe=2).alias("src_ip"),
        pick(probe=3).alias("dst_ip"),
        pick(login=5, invalid=4).try_cast("int").alias("src_port"),
        F.when(is_ssh, 22).otherwise(pick(probe=4).try_cast("int")).alias("dst_port"),
        F.when(is_ssh, "tcp").otherwise(F.lower(pick(probe=5))).alias("proto"),
        pick(web=3).alias("method"),
        pick(web=4).alias("url"),
        pick(web=5).try_cast("int").alias("status_code"),
        pick(web=8).alias("user_agent"),
        pick(login=3, invalid=2).alias("username"),
        detail.alias("detail"),
        "raw",
        (kind.isNotNull() & parsed_ts.isNull()).alias("ts_fallback"))
    return fields.withColumn("epoch", timewin.epoch_of(F.col("ts")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("log_type").isNotNull())


def quarantine(parsed: DataFrame, *keep: str) -> DataFrame:
    """Non-blank lines that fit no format."""
    return parsed.where(F.col("log_type").isNull() & (F.col("raw") != "")).select(*keep, "raw")
