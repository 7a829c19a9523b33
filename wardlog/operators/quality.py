"""Evaluation of detection runs and of written assessments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardlog.constants import EXPECTED_RULES, REVIEW_FIELDS, SEVERITY_ALIASES, SEVERITY_RANK


def segment_hits(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """segment, lines, hits, rules: map of rule name to hits. `lines` has segment, `hits` too."""
    total = lines.groupBy("segment").agg(F.count("*").alias("lines"))
    per_rule = hits.groupBy("segment", "rule_name").agg(F.count("*").alias("n"))
    rules = per_rule.groupBy("segment").agg(
        F.sum("n").alias("hits"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_name", "n")))).alias("rules"))
    return total.join(rules, "segment", "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0)))


def false_positive_rates(segments: DataFrame) -> DataFrame:
    """One row: rates of `normal`, `burst`, and `normal` with `edge` combined."""
    name = F.col("segment")

    def rate(*members):
        inside = name.isin(*members)
        hits = F.coalesce(F.sum(F.when(inside, F.col("hits"))), F.lit(0))
        lines = F.coalesce(F.sum(F.when(inside, F.col("lines"))), F.lit(0))
        return hits / F.greatest(lines, F.lit(1))

    combined = name.isin("normal", "edge")
    return segments.agg(
        rate("normal").alias("fp_rate_normal"), rate("burst").alias("fp_rate_burst"),
        rate("normal", "edge").alias("fp_rate_combined"),
        F.coalesce(F.sum(F.when(combined, F.col("lines"))), F.lit(0)).alias("combined_lines"),
        F.coalesce(F.sum(F.when(combined, F.col("hits"))), F.lit(0)).alias("combined_hits"))


def expected_rules(spark: SparkSession) -> DataFrame:
    """(scenario, keyword): what has to fire in each of the fixed attack scenarios."""
    return spark.createDataFrame(list(EXPECTED_RULES), "scenario STRING, keyword STRING")


def rule_recall(fired: DataFrame, expected: DataFrame) -> DataFrame:
    """Per scenario: how many expected keywords occur in a rule that fired, and which do not.

    fired: (scenario, rule_name); expected: (scenario, keyword). Rule names are few per scenario,
    so they are reduced to their distinct values before keywords are looked up in them.
    """
    names = fired.select("scenario", "rule_name").distinct().groupBy("scenario").agg(
        F.collect_set("rule_name").alias("names"))
    checked = expected.join(names, "scenario", "left").withColumn(
        "found", F.coalesce(F.exists("names", lambda n: n.contains(F.col("keyword"))),
                            F.lit(False)))
    return checked.groupBy("scenario").agg(
        F.count("*").alias("expected"), F.count_if("found").alias("hit"),
        F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("keyword")))).alias("missed"))


def recall_total(per_scenario: DataFrame) -> DataFrame:
    return per_scenario.agg(
        F.sum("expected").alias("total_expected"), F.sum("hit").alias("total_hit"),
        (F.sum("hit") / F.greatest(F.sum("expected"), F.lit(1))).alias("detection_rate"))


def severity_level(text: Column) -> Column:
    """Level named in a text: the first alias, in fixed order, that it contains; else NULL."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.contains(alias), level) for alias, level in SEVERITY_ALIASES])


def severity_distance(left: Column, right: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.abs(F.try_element_at(ranks, left) - F.try_element_at(ranks, right))


def agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    """Agreement of `output` (text) with `rule_severity`."""
    distance = severity_distance(severity_level(F.col("output")), F.col("rule_severity"))
    scored = pairs.withColumn("_d", distance)
    total = F.count("*")
    strict, loose = F.count_if(F.col("_d") == 0), F.count_if(F.col("_d") <= 1)
    return scored.groupBy(*keys).agg(
        total.alias("total"), strict.alias("strict"), loose.alias("loose"),
        F.count_if(F.col("_d").isNull()).alias("unrecognized"),
        F.round(strict / F.greatest(total, F.lit(1)), 4).alias("strict_rate"),
        F.round(loose / F.greatest(total, F.lit(1)), 4).alias("loose_rate"))


def missing_sections(text: Column, required: Sequence[str]) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~body.contains(r))


def usability(outputs: DataFrame, required: Sequence[str], *keys: str) -> DataFrame:
    """Share of outputs that are not blank and hold every required section."""
    ok = ((F.trim(F.coalesce("output", F.lit(""))) != "")
          & (F.size(missing_sections(F.col("output"), required)) == 0))
    total = F.count("*")
    return outputs.withColumn("_ok", ok).groupBy(*keys).agg(
        total.alias("total"), F.count_if("_ok").alias("usable"),
        F.round(F.count_if("_ok") / F.greatest(total, F.lit(1)), 4).alias("rate"))


def reply_object(text: Column) -> Column:
    """Reply text as MAP<STRING,STRING>: fences dropped, first `{` to last `}`; NULL if not JSON.

    Nested values keep their JSON text.
    """
    clean = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^`+(?i:json)?|`+$", "")
    body = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(body, F.lit("")), "map<string,string>", {"mode": "PERMISSIVE"})


def parse_reply(df: DataFrame, text: str = "output") -> DataFrame:
    """`reply` (map), or `raw` text with `parse_error`."""
    reply = reply_object(F.col(text))
    return df.withColumn("reply", reply).withColumn(
        "raw", F.when(F.col("reply").isNull(), F.col(text))).withColumn(
        "parse_error", F.col("reply").isNull())


def structured_ok(reply: Column, fields: Sequence[str] = REVIEW_FIELDS) -> Column:
    """An object without `raw` whose fields are all there and not blank."""
    filled = F.forall(F.array(*[F.lit(f) for f in fields]), lambda f: F.coalesce(
        F.trim(F.try_element_at(reply, f)) != "", F.lit(False)))
    return F.coalesce(reply.isNotNull() & ~F.map_contains_key(reply, "raw") & filled, F.lit(False))


def structured_usability(outputs: DataFrame, fields: Sequence[str] = REVIEW_FIELDS,
                         *keys: str) -> DataFrame:
    total = F.count("*")
    return outputs.withColumn("_ok", structured_ok(reply_object(F.col("output")), fields)).groupBy(
        *keys).agg(total.alias("total"), F.count_if("_ok").alias("usable"),
                   F.round(F.count_if("_ok") / F.greatest(total, F.lit(1)), 4).alias("rate"))


def flatten_reply(reply: Column) -> Column:
    """The three review fields, one per line, or the raw text."""
    fields = F.concat_ws("\n", *[F.coalesce(F.try_element_at(reply, F.lit(f)), F.lit(""))
                                 for f in REVIEW_FIELDS])
    return F.when(reply.isNull(), "").when(
        F.map_contains_key(reply, "raw"), F.coalesce(F.try_element_at(reply, F.lit("raw")),
                                                     F.lit(""))).otherwise(fields)


def run_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """calls, succeeded, success_rate, mean tokens and seconds of the successful calls."""
    ok = F.col("status") == "ok"
    tokens = F.when(ok, F.col("prompt_tokens") + F.col("completion_tokens"))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("succeeded"),
        F.round(F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 4).alias("success_rate"),
        F.coalesce(F.round(F.avg(tokens), 1), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.round(F.avg(F.when(ok, F.coalesce("elapsed", F.lit(0.0)))), 2), F.lit(0.0))
        .alias("avg_elapsed"))


def cost(tokens: Column, per_million: float = 1.5) -> Column:
    return F.round(tokens / 1_000_000 * per_million, 4)


def compare_variants(outputs: DataFrame, required: Sequence[str], a: str = "v1", b: str = "v2"
                     ) -> DataFrame:
    """One row: the rates of two variants and what the second gains."""
    rates = agreement(outputs, "variant").select("variant", "strict_rate", "loose_rate").join(
        usability(outputs, required, "variant").select(
            "variant", F.col("rate").alias("usability_rate")), "variant")
    names = ("strict_rate", "loose_rate", "usability_rate")
    wide = rates.agg(*[F.max(F.when(F.col("variant") == v, F.col(n))).alias(f"{n}_{side}")
                       for n in names for v, side in ((a, "a"), (b, "b"))])
    return wide.select(
        F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), *wide.columns,
        *[F.round(F.col(f"{n}_b") - F.col(f"{n}_a"), 4).alias(f"delta_{n.removesuffix('_rate')}")
          for n in names])


def headings(text: Column) -> Column:
    """Markdown headings of a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^#{1,6}\s*(.+)$"), F.lit(1))
