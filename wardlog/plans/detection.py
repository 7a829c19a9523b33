"""Rule detection: every enabled rule over every event, as one set of hits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from wardlog.constants import (COUNT_MESSAGE, EVIDENCE_CHARS, SEQUENCE_MESSAGE, SIGNATURES)
from wardlog.functions import filters
from wardlog.functions.filters import event_filter
from wardlog.functions.signatures import (class_test, custom_match, decoded_lowered,
                                          lowered)
from wardlog.functions.text import clip, field_text
from wardlog.operators.windowed import EVENT_KEEP, chosen, numbers_of, windowed_hits
from wardlog.sources.rules import Rule, rules_frame

HIT_COLUMNS = ("rule_id", "rule_name", "category", "severity", *EVENT_KEEP, "matched_text",
               "count", "prior_fails", "window_s", "group_value")


def _text_kind(match_field: str | None) -> str:
    return match_field if match_field in ("url", "user_agent", "username") else "any"


def rule_test(rule: Rule) -> Column:
    """Boolean of a regex rule: a signature class, else an event filter, else a pattern."""
    pattern, kind = rule.pattern or "", _text_kind(rule.match_field)
    if pattern in SIGNATURES:
        return class_test(pattern, F.col(f"_low_{kind}"), F.col(f"_declow_{kind}"))
    if pattern in filters.names():
        return event_filter(pattern)
    return custom_match(F.col(f"_text_{kind}"), pattern)


def with_texts(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The texts the rules look at, in the forms they are searched in, each made once."""
    kinds = sorted({_text_kind(r.match_field) for r in rules})
    searched = sorted({_text_kind(r.match_field) for r in rules if r.pattern in SIGNATURES})
    out = events.withColumns({f"_text_{k}": field_text(k) for k in kinds})
    for k in searched:
        out = out.withColumns({f"_low_{k}": lowered(F.col(f"_text_{k}")),
                               f"_declow_{k}": decoded_lowered(F.col(f"_text_{k}"))})
    return out


def regex_hits(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One projection for all regex rules, then one row per hit. No shuffle.

    The tests are columns of their own: inside the generator they would be interpreted, not compiled. It gets nothing
    but the numbers of the rules that match; the evidence is clipped after it.
    """
    kinds = {f"_text_{_text_kind(r.match_field)}": [] for r in rules}
    for n, rule in enumerate(rules):
        kinds[f"_text_{_text_kind(rule.match_field)}"].append(n)
    evidence = F.coalesce(*[F.when(F.col("_n").isin(own), clip(F.col(text), EVIDENCE_CHARS))
                            for text, own in kinds.items()])
    return (with_texts(events, rules)
            .select(*EVENT_KEEP, *kinds, *[rule_test(r).alias(f"_m{r.id}") for r in rules])
            .select(*EVENT_KEEP, *kinds, numbers_of([F.col(f"_m{r.id}") for r in rules]).alias("_numbers"))
            .select(*EVENT_KEEP, *kinds, F.explode_outer("_numbers").alias("_n")).where(F.col("_n").isNotNull())
            .select(*EVENT_KEEP, chosen("_n", [F.lit(r.id) for r in rules]).alias("rule_id"),
                    evidence.alias("matched_text")))


def usable(rule: Rule) -> bool:
    if rule.rule_type == "aggregate":
        return rule.pattern in filters.names()
    if rule.rule_type == "composite":
        return rule.pattern in filters.names() and rule.match_field in filters.names()
    return rule.rule_type == "regex" and bool(rule.pattern)


def detect(events: DataFrame, rules: Sequence[Rule], consumed: DataFrame | None = None
           ) -> DataFrame:
    """Hits of all enabled rules.

    Signature rules are one pass over the events; windowed rules that share a group field are two
    more, whatever their number. `consumed` are earlier hits of sequence rules (rule_id,
    group_value, epoch, seq). Slots are checkpointed while the plan is built.
    """
    active = [r for r in rules if r.enabled and usable(r)]
    parts: list[DataFrame] = []
    regex = [r for r in active if r.rule_type == "regex"]
    if regex:
        parts.append(regex_hits(events, regex))
    families: dict[str, list[Rule]] = {}
    for rule in active:
        if rule.rule_type != "regex":
            families.setdefault(rule.group, []).append(rule)
    parts += [windowed_hits(events, family, consumed) for family in families.values()]
    if not parts:
        raise ValueError("no usable rule")
    return described(parts, active, events.sparkSession)


def described(parts: Sequence[DataFrame], rules: Sequence[Rule], spark: SparkSession) -> DataFrame:
    """Hits of several plans as one table, with what their rules say."""
    hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = {"count": "bigint", "prior_fails": "bigint", "matched_text": "string",
               "_g": "string"}
    hits = hits.withColumns({name: F.lit(None).cast(kind) for name, kind in missing.items()
                             if name not in hits.columns})
    # the rule set came through the driver and its size was checked there
    meta = rules_frame(spark, list(rules)).select(
        F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "category", "severity",
        F.coalesce("group_field", F.lit("src_ip")).alias("_gf"),
        F.when(F.col("rule_type") != "regex", F.coalesce("time_window", F.lit(60)))
        .alias("window_s"))
    message = (F.when(F.col("count").isNotNull(),
                      F.format_string(COUNT_MESSAGE, "_gf", "_g", "window_s", "count"))
               .when(F.col("prior_fails").isNotNull(),
                     F.format_string(SEQUENCE_MESSAGE, "_gf", "_g", "prior_fails")))
    return (hits.join(F.broadcast(meta), "rule_id")
            .withColumn("matched_text", F.coalesce("matched_text", message))
            .withColumnRenamed("_g", "group_value")
            .select(*HIT_COLUMNS))


def observed(df: DataFrame, observation: Observation, **counters: Column) -> DataFrame:
    """Run counters collected while the job runs, without a second pass."""
    return df.observe(observation, *[c.alias(name) for name, c in counters.items()])


def dry_run(parsed: DataFrame, rule: Rule) -> DataFrame:
    """For sample lines: was it parsed, did the rule match, does it count toward the window."""
    ready = with_texts(parsed, [rule])
    is_event = F.col("log_type").isNotNull()
    if rule.rule_type == "regex":
        matched = is_event & rule_test(rule)
        counted = F.lit(False)
        reason = F.when(matched, "matched").otherwise("no match")
    else:
        matched = F.lit(False)
        known = rule.pattern in filters.names()
        counted = is_event & (event_filter(rule.pattern) if known else F.lit(False))
        reason = F.concat(
            F.when(counted, "counts").otherwise("does not count"),
            F.lit(f" toward this {rule.rule_type} rule, which fires at {rule.threshold}"))
    return ready.select(
        *[c for c in parsed.columns if c in ("seq", "raw")],
        is_event.alias("parsed"), F.coalesce(matched, F.lit(False)).alias("matched"),
        F.coalesce(counted, F.lit(False)).alias("counted"),
        F.when(is_event, reason).otherwise("line not parsed").alias("reason"))
