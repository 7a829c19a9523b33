"""URL rules and an exact host list as a cascade of Bloom filters (operator 3).

The first level of a cascade holds the listed keys, the second the unlisted keys of the corpus that
the first takes for listed, the third the listed keys that the second takes for those, and so on until
a level takes none wrongly. A key of the corpus is listed if the first level that does not hold it has
an even number (counted from 1). All keys of the corpus have been put to the levels, so the
answer is exact for each of them, and a page is judged from its own row: no join.

Keys are dealt into shards of bounded size by their hash, and one task builds the levels of a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.llm.common import checkpointed, query, table
from wardlog.llm.shingles import mix

SHARD_KEYS = 50_000
FILTER_BYTES = 64 << 20       # cascades of up to this size are sent to every task
LEVELS = "shard int, level int, positions int, bits binary"

#: The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that make a host of the corpus a listed one, as a part of its name between dots and hyphens.
LISTED_WORDS = ("ads", "casino", "pills", "spam", "track")
LISTED = rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, count: int, size: int) -> np.ndarray:
    salt = np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
    start, step = mix(h1 ^ salt), mix(h2 + salt) | np.uint64(1)
    return (start[None, :] + np.arange(count, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(size)


def _holds(bits: np.ndarray, h1, h2, level: int, count: int) -> np.ndarray:
    at = _positions(h1, h2, level, count, 8 * len(bits))
    return ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(hash positions, bits) of each level of one shard."""
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels = []
    rate = min(0.5, len(inside) * math.sqrt(0.5) / max(len(outside), 1))
    while len(inside):
        count = max(1, round(-math.log2(rate)))
        size = max(8, math.ceil(len(inside) * -math.log(rate) / math.log(2) ** 2 / 8))
        flags = np.zeros(8 * size, bool)
        at = _positions(h1[inside], h2[inside], len(levels), count, 8 * size)
        flags[at.astype(np.int64).ravel()] = True
        bits = np.packbits(flags, bitorder="little")
        wrong = outside[_holds(bits, h1[outside], h2[outside], len(levels), count)]
        levels.append((count, bits))
        inside, outside, rate = wrong, inside, 0.5
    return levels


def is_listed(levels: list[tuple[int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The number of levels that hold a key, one after the other, is odd for listed keys."""
    depth, left = np.zeros(len(h1), np.int64), np.arange(len(h1))
    for level, (count, bits) in enumerate(levels):
        left = left[_holds(bits, h1[left], h2[left], level, count)]
        depth[left] += 1
    return depth % 2 == 1


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


def cascade(keys: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """Levels of all shards for `keys` (key) of which those in `listed` (key) are listed, and the shards.

    Repeated keys count once; null keys are left out. Listed keys outside `keys` are never asked for
    and are left out.
    """
    known = keys.where("key is not null").groupBy("key").agg(F.lit(False).alias("is_listed"))
    marks = listed.where("key is not null").groupBy("key").agg(F.lit(True).alias("mark"))
    flagged = checkpointed(known.join(marks, "key", "left").select(
        *_hashed(F.col("key")), F.coalesce("mark", F.lit(False)).alias("is_listed")))
    shards = max(1, math.ceil(flagged.count() / SHARD_KEYS))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(part.h1.to_numpy().view(np.uint64), part.h2.to_numpy().view(np.uint64),
                              part.is_listed.to_numpy())
        return pd.DataFrame([(int(part.shard.iloc[0]), i, count, bits.tobytes())
                             for i, (count, bits) in enumerate(levels)],
                            columns=["shard", "level", "positions", "bits"])

    levels = flagged.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, LEVELS)
    return checkpointed(levels), shards


def _unpack(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for row in sorted(rows, key=lambda r: (r["shard"], r["level"])):
        out.setdefault(row["shard"], []).append((row["positions"], np.frombuffer(row["bits"], np.uint8)))
    return out


def _asked(batch: pa.RecordBatch, levels: dict[int, list]) -> np.ndarray:
    h1 = batch.column("h1").to_numpy().view(np.uint64)
    h2 = batch.column("h2").to_numpy().view(np.uint64)
    shard = batch.column("shard").to_numpy()
    answer = np.zeros(len(shard), bool)
    for number in np.unique(shard):
        at = np.flatnonzero(shard == number)
        answer[at] = is_listed(levels.get(int(number), []), h1[at], h2[at])
    return answer


def with_membership(rows: DataFrame, key: str, levels: DataFrame, shards: int) -> DataFrame:
    """`rows` with a boolean column `listed` for their key, exact for all keys the cascade was built on.

    Levels within FILTER_BYTES are sent to every task. Larger ones are met shard by shard: rows join
    the shard's levels (one row per shard, split by Spark if a shard is crowded).
    """
    asked = rows.select("*", *_hashed(F.col(key))).withColumn("shard", _shard(shards))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", listed boolean"
    kept = rows.columns
    size = levels.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= FILTER_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast(_unpack(levels.collect()))

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept),
                                                  pa.array(_asked(batch, sent.value))], names=[*kept, "listed"])
        return asked.mapInArrow(run, names)
    packed = levels.groupBy("shard").agg(F.collect_list(F.struct("shard", "level", "positions", "bits")).alias("levels"))

    def run_joined(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own: dict[int, list] = {}
                for rows_of in part.column("levels"):
                    own |= _unpack(rows_of.as_py() or []) if rows_of.is_valid else {}
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(_asked(part, own))],
                                                 names=[*kept, "listed"])
    return asked.join(packed, "shard", "left").mapInArrow(run_joined, names)


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules=RULES) -> DataFrame:
    """Rows of `pages` (page_id, url) to (page_id, host, path, rule, verdict), one per row.

    The longest fitting rule decides; without one a host in `listed_hosts` (key) is blocked, any other
    allowed. A null url, or one without `://`, has an empty host and path, which can be listed like any
    other key. Other columns are ignored; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    levels, shards = cascade(parts.select(F.col("host").alias("key")), listed_hosts)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return with_membership(parts, "host", levels, shards).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def listed_by_name(pages: DataFrame) -> DataFrame:
    """The hosts of a page table whose names hold a listed word."""
    return (pages.select(host_of(F.col("url").cast("string")).alias("key")).distinct()
            .where(F.col("key").rlike(LISTED)))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda d, p: f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {fits(d, p)} THEN '{d}{p}'" for _, d, p in cases)} END AS rule,
  CASE {' '.join(f"WHEN {fits(d, p)} THEN '{v}'" for v, d, p in cases)}
    WHEN regexp_matches(host, '{LISTED}') THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


@query("op3_url_bloom_cascade", _sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, listed_by_name(pages))
