"""Address ranges: longest-prefix match as one join with ranges that are flattened first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wardlog import schema
from wardlog.constants import (ADDRESS_RANGES, CATEGORY_LABELS, INVALID_LABEL, UNKNOWN_LABEL)
from wardlog.functions.text import label_of
from wardlog.session import materialise

BLOCK_BITS = 16      # an address is looked up among the ranges of its block

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ADDRESS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def address_number(ip: Column) -> Column:
    """IPv4 text as a number; NULL when it is not one."""
    text = F.trim(ip)
    parts = F.split(text, r"\.")
    value = sum((F.get(parts, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)),
                F.lit(0).cast("bigint"))
    return F.when(text.rlike(_ADDRESS), value)


def is_v6(ip: Column) -> Column:
    """Rough shape of an IPv6 address: valid, though no listed range covers it."""
    return F.trim(ip).rlike(r"^(?=.*:)[0-9A-Fa-f:]+(?:\d+\.\d+\.\d+\.\d+)?(?:%\w+)?$")


def builtin_ranges(spark: SparkSession) -> DataFrame:
    return with_bounds(spark.createDataFrame(list(ADDRESS_RANGES), schema.RANGE))


def with_bounds(ranges: DataFrame) -> DataFrame:
    """Add `prefix_len`, `lo` and `hi` to (cidr, label, province, category)."""
    prefix = F.split("cidr", "/")[1].cast("int")
    size = F.pow(F.lit(2.0), 32 - prefix).cast("bigint")
    base = address_number(F.split("cidr", "/")[0])
    low = base - F.pmod(base, size)
    return ranges.select("cidr", low.alias("lo"), (low + size - 1).alias("hi"),
                         prefix.alias("prefix_len"), "label", "province", "category")


def disjoint_ranges(ranges: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Nested ranges flattened: (block, first, last, best) without overlap, no range reaching over a block.

    Borders are the ends of the ranges and the blocks of `bits` leading bits they reach into. What holds at a border
    holds up to the next one: the longest range there, found among the ranges themselves by one equi join per prefix
    length; of two equal ranges the smaller label counts. That is work on the range table, whatever is looked up in it.
    """
    size = 1 << (32 - bits)
    to_block = lambda n: F.floor(n / size).cast("bigint")
    borders = ranges.select(F.explode(F.array_union(
        F.array(F.col("lo"), F.col("hi") + 1),
        F.transform(F.sequence(to_block(F.col("lo")), to_block(F.col("hi"))), lambda k: k * size))).alias("first")
    ).distinct().where(F.col("first") < 1 << 32)
    lengths = [r.prefix_len for r in ranges.select("prefix_len").distinct().collect()]     # 33 at most
    found = []
    for length in sorted(lengths, reverse=True):
        width = 1 << (32 - length)
        side = (ranges.where(F.col("prefix_len") == length).groupBy((F.col("lo") / width).cast("bigint").alias("_k"))
                .agg(F.min(F.struct("label", "province", "category")).alias(f"_r{length}")))
        borders = borders.withColumn("_k", F.floor(F.col("first") / width).cast("bigint")).join(side, "_k", "left").drop("_k")
        found.append(F.col(f"_r{length}"))
    best = F.coalesce(*found) if found else F.lit(None).cast("struct<label:string,province:string,category:string>")
    inside = borders.select("first", best.alias("best"), to_block(F.col("first")).alias("block"))
    after = F.lead("first").over(Window.partitionBy("block").orderBy("first"))
    return inside.withColumn("last", F.coalesce(after, (F.col("block") + 1) * size) - 1).where(
        F.col("best").isNotNull()).select("block", "first", "last", "best")


def locate(df: DataFrame, ranges: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Add `label`, `province` and `category` of the longest range that holds the address.

    One join whatever the number of prefix lengths: ranges are flattened to disjoint ones, and an address is looked
    for in its block. Spark knows the size of the flattened ranges and picks the kind of join.
    """
    flat = materialise(disjoint_ranges(ranges))
    out = df.withColumn("_n", address_number(F.col(ip))).withColumn(
        "_block", F.floor(F.col("_n") / (1 << (32 - BLOCK_BITS))).cast("bigint"))
    out = out.join(flat, (F.col("_block") == F.col("block")) & F.col("_n").between(F.col("first"), F.col("last")), "left")
    valid = F.col("_n").isNotNull() | is_v6(F.col(ip))
    return out.select(
        *df.columns,
        F.coalesce(F.col("best.label"), F.when(valid, UNKNOWN_LABEL).otherwise(INVALID_LABEL))
        .alias("label"),
        F.col("best.province").alias("province"),
        F.coalesce(F.col("best.category"), F.lit("unknown")).alias("category"))


def category_weights(located: DataFrame, weight: str = "weight") -> DataFrame:
    return located.groupBy("category").agg(F.sum(weight).alias("weight")).withColumn(
        "category_label", label_of(CATEGORY_LABELS, F.col("category"), ""))


def province_weights(located: DataFrame, weight: str = "weight") -> DataFrame:
    return (located.where((F.col("category") == "domestic") & (F.col("province") != ""))
            .groupBy("province").agg(F.sum(weight).alias("weight")))


def overview(located: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: total, located and unknown weight."""
    domestic = (F.col("category") == "domestic") & (F.coalesce("province", F.lit("")) != "")
    return located.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(domestic, F.col(weight))), F.lit(0)).alias("located"),
        F.coalesce(F.sum(F.when(F.col("category") == "unknown", F.col(weight))), F.lit(0))
        .alias("unknown"))


def foreign_sources(located: DataFrame, top_n: int = 6, weight: str = "weight",
                    ip: str = "src_ip") -> DataFrame:
    """The heaviest sources that are overseas, reserved or unknown."""
    return (located.where(F.col("category").isin("overseas", "unknown", "reserved"))
            .groupBy(ip, "label").agg(F.sum(weight).alias("weight"))
            .orderBy(F.desc("weight"), ip).limit(top_n))
