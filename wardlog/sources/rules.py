"""Rule tables: the built-in set, the enabled ones, validity checks, reset."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog import schema
from wardlog.constants import BUILTIN_RULES, RULE_SEVERITIES, RULE_TYPES, SIGNATURES
from wardlog.functions import filters
from wardlog.functions.signatures import valid_pattern
from wardlog.operators.statistics import attach



@dataclass(frozen=True)
class Rule:
    """One row of the rule table."""

    id: int
    name: str
    rule_type: str
    pattern: str | None = None
    match_field: str | None = None
    category: str = "other"
    severity: str = "mid"
    threshold: int | None = None
    time_window: int | None = None
    group_field: str | None = None
    enabled: bool = True
    description: str = ""
    is_builtin: bool = False
    count_mode: str | None = None
    distinct_field: str | None = None

    @property
    def window(self) -> int:
        return self.time_window or 60

    @property
    def limit(self) -> int:
        return self.threshold or 1

    @property
    def group(self) -> str:
        return self.group_field or "src_ip"


def builtin_rules(window: int | None = None, threshold: int | None = None) -> list[Rule]:
    """The built-in rules; `window`/`threshold` replace those of the windowed ones."""
    out = []
    for number, row in enumerate(BUILTIN_RULES, start=1):
        name, category, severity, kind, pattern, field, limit, seconds, distinct, text = row
        windowed = kind != "regex"
        out.append(Rule(
            id=number, name=name, rule_type=kind, pattern=pattern, match_field=field,
            category=category, severity=severity,
            threshold=(threshold or limit) if windowed else None,
            time_window=(window or seconds) if windowed else None,
            group_field="src_ip" if windowed else None, description=text, is_builtin=True,
            count_mode=("distinct" if distinct else "count") if kind == "aggregate" else None,
            distinct_field=distinct))
    return out


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    names = [part.split()[0] for part in schema.RULE.split(", ")]
    return spark.createDataFrame([tuple(getattr(r, n) for n in names) for r in rules], schema.RULE)


def load_rules(table: DataFrame) -> list[Rule]:
    """Enabled rules in id order. A rule set is configuration: it becomes part of the plan."""
    return [Rule(**row.asDict()) for row in table.where("enabled").orderBy("id").collect()]


def reset_builtin(spark: SparkSession, current: DataFrame) -> DataFrame:
    """Built-in rules back to their defaults and enabled; missing ones added; custom ones kept."""
    seed = rules_frame(spark, builtin_rules())
    restored = ("severity", "threshold", "time_window", "group_field", "match_field",
                "description")
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    c, s = current.alias("c"), seed.alias("s")
    joined = c.join(s, (F.col("c.name") == F.col("s.name")) & F.col("c.is_builtin"), "full_outer")
    known, seeded = F.col("c.name").isNotNull(), F.col("s.name").isNotNull()
    columns = []
    for name in current.columns:
        if name == "id":
            value = F.coalesce(F.col("c.id"), F.col("top") + F.col("s.id"))
        elif name == "enabled":
            value = F.when(seeded, F.lit(True)).otherwise(F.col("c.enabled"))
        elif name in restored:
            value = F.when(seeded, F.col(f"s.{name}")).otherwise(F.col(f"c.{name}"))
        else:
            value = F.when(known, F.col(f"c.{name}")).otherwise(F.col(f"s.{name}"))
        columns.append(value.cast(current.schema[name].dataType).alias(name))
    return attach(joined, top).select(*columns)


def rule_problems(table: DataFrame) -> DataFrame:
    """Every rule with the reasons it is not valid (empty array: valid)."""
    pattern = F.trim(F.coalesce("pattern", F.lit("")))
    patterns = (table.where("rule_type = 'regex' and pattern is not null").select("pattern")
                .distinct().collect())
    bad = [r.pattern for r in patterns
           if r.pattern not in SIGNATURES and r.pattern not in filters.names()
           and not valid_pattern(r.pattern)]
    windowed = F.col("rule_type").isin("aggregate", "composite")
    checks = {
        "name is empty": F.trim(F.coalesce("name", F.lit(""))) == "",
        "unknown severity": ~F.coalesce(F.col("severity").isin(*RULE_SEVERITIES), F.lit(False)),
        "unknown rule type": ~F.coalesce(F.col("rule_type").isin(*RULE_TYPES), F.lit(False)),
        "aggregate rule without event filter": (F.col("rule_type") == "aggregate")
        & (pattern == ""),
        "regex rule without pattern": (F.col("rule_type") == "regex") & (pattern == ""),
        "pattern does not compile": (F.col("rule_type") == "regex") & pattern.isin(*(bad or [""]))
        & (pattern != ""),
        "threshold and window must be positive": windowed
        & ((F.coalesce("threshold", F.lit(1)) < 1) | (F.coalesce("time_window", F.lit(1)) < 1)),
    }
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in checks.items()]))
    return table.withColumn("problems", reasons)


def rule_from_text(rule_id: int, name: str, pattern: str, match_field: str = "any",
                   **more) -> Rule:
    """A custom regex rule."""
    return Rule(id=rule_id, name=name, rule_type="regex", pattern=pattern,
                match_field=match_field, category=more.pop("category", "custom"), **more)


_IDENTIFIER = re.compile(r"^\w+$")


def check_group_field(name: str) -> str:
    if not _IDENTIFIER.match(name):
        raise ValueError(f"not a column name: {name!r}")
    return name
