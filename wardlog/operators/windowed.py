"""Windowed rules: trailing counts, trailing distinct counts and sequences, in shared passes.

All rules that group by the same field are evaluated together:

1. events are collapsed to slots, one per group and second, with one count per rule (one scan);
2. look-back windows over the slots give, per rule, what precedes each second, and so the seconds
   in which a threshold can be reached at all;
3. only the events of those seconds are fetched (one more scan, and one of the few that matter to a
   sequence), and a running count inside the second settles ties: an event counts those before it in
   `(epoch, seq)` order whose time is at least `t - W`.

Slots are small next to the events and are used several times, so they are checkpointed. Hits are
not: they are as wide as events, and what a caller does not need of them is then never made.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlog.functions.filters import event_filter
from wardlog.operators.sequence import select_apart
from wardlog.operators.timeline import previous, running_totals, trailing
from wardlog.session import materialise
from wardlog.sources.rules import Rule, check_group_field

# a second of more events than this is taken in stretches of so many arrival numbers
STRETCH = 65_536
EVENT_KEEP = ("seq", "epoch", "src_ip", "dst_ip", "url", "raw")
SECOND = ("epoch", "_g")     # rows are sorted by it: a number decides most comparisons, a text few


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left | right, tests)


def numbers_of(tests: Sequence[Column]) -> Column:
    """The numbers, from 0 on, of the tests that are true. Unlike `array_compact`, this is compiled."""
    return F.array_remove(F.array(*[F.when(test, F.lit(n)).otherwise(F.lit(-1)) for n, test in enumerate(tests)]),
                          F.lit(-1))


def chosen(number: str, values: Sequence[Column]) -> Column:
    """The value that a column has the number of."""
    cases = F
    for n, value in enumerate(values):
        cases = cases.when(F.col(number) == n, value)
    return cases


def is_distinct(rule: Rule) -> bool:
    return rule.rule_type == "aggregate" and rule.count_mode == "distinct"


def is_sequence(rule: Rule) -> bool:
    return rule.rule_type == "composite"


def _value(rule: Rule) -> str:
    return check_group_field(rule.distinct_field or "dst_port")


def _flagged(events: DataFrame, rules: Sequence[Rule], consumed: DataFrame | None) -> DataFrame:
    """Events with a group and a time that matter to a rule: `_f` what it counts or is triggered
    by, `_b` what a sequence needs before. `consumed` are earlier hits of sequences, which reset
    what came before them."""
    flags: dict[str, Column] = {}
    for rule in rules:
        flags[f"_f{rule.id}"] = event_filter(rule.pattern)
        if is_sequence(rule):
            flags[f"_b{rule.id}"] = event_filter(rule.match_field) & ~event_filter(rule.pattern)
    kept = [*EVENT_KEEP, *[_value(r) for r in rules if is_distinct(r)]]
    group = F.col(check_group_field(rules[0].group)).cast("string")
    own = (events.select(*dict.fromkeys(kept), group.alias("_g"),
                         *[test.alias(name) for name, test in flags.items()])
           .where((F.col("_g") != "") & F.col("epoch").isNotNull()
                  & any_of([F.col(name) for name in flags])))
    sequences = [r for r in rules if is_sequence(r)]
    if consumed is None or not sequences:
        return own
    last = consumed.groupBy(F.col("group_value").alias("_g")).agg(*[
        F.max(F.when(F.col("rule_id") == r.id, F.struct("epoch", "seq"))).alias(f"_last{r.id}")
        for r in sequences])
    after = {}
    for r in sequences:
        fresh = F.col(f"_last{r.id}").isNull() | (F.struct("epoch", "seq") > F.col(f"_last{r.id}"))
        after |= {f"_{side}{r.id}": F.col(f"_{side}{r.id}") & fresh for side in "fb"}
    return own.join(last, "_g", "left").withColumns(after).drop(
        *[f"_last{r.id}" for r in sequences])


def _value_starts(own: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(starts, steps) of a distinct rule.

    A value seen at second t is active over `[t, t + W]`. `starts` are the arrivals at which a
    value becomes active; `steps` are the +1/-1 changes of the number of active values. What an
    occurrence adds to the one before it is its stretch past that one's end, so overlapping
    stretches count once, and no list of values is ever built.
    """
    seen = (own.where(F.col(f"_f{rule.id}") & F.col(_value(rule)).isNotNull())
            .groupBy("_g", F.col(_value(rule)).cast("string").alias("_v"), "epoch")
            .agg(F.min("seq").alias("seq")))
    seen = materialise(previous(seen, ["_g", "_v"], rule.window, "_prev"))
    ends = F.col("epoch") + rule.window + 1
    begins = F.coalesce(F.col("_prev") + rule.window + 1, F.col("epoch"))
    steps = seen.select("_g", F.explode(F.array(
        F.struct(ends.alias("epoch"), F.lit(-1).alias("step"), F.lit(0).alias("opened")),
        F.struct(begins.alias("epoch"), F.lit(1).alias("step"),
                 F.col("_prev").isNull().cast("int").alias("opened")))).alias("s")
    ).select("_g", "s.*")
    return seen.where(F.col("_prev").isNull()).select("_g", "epoch", "seq"), steps


def _distinct_reach(slots: DataFrame, steps: DataFrame, rule: Rule) -> DataFrame:
    """Seconds in which the rule can fire, with the number of values active before them."""
    changes = (steps.withColumns({"n": F.lit(0).cast("bigint"), "_n": F.lit(0).cast("bigint")})
               .unionByName(slots.where(F.col(f"_nf{rule.id}") > 0).select(
                   *SECOND, F.lit(0).alias("step"), F.lit(0).alias("opened"),
                   F.col(f"_nf{rule.id}").alias("n"), "_n"))
               .groupBy(*SECOND).agg(*[F.sum(c).alias(c) for c in ("step", "opened", "n", "_n")]))
    active = running_totals(changes, ["_g"], {"_active": F.col("step")})
    return (active.where((F.col("n") > 0) & (F.col("_active") >= rule.limit))
            .select(*SECOND, "_n", (F.col("_active") - F.col("opened")).alias(f"_p{rule.id}")))


def _slot_reach(slots: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The same for counts and sequences: `_p` what is in the window before the second (NULL where the
    rule cannot fire), `_a` all preconditions before it."""
    counted = {r.id: f"_nb{r.id}" if is_sequence(r) else f"_nf{r.id}" for r in rules}
    before = trailing(slots, ["_g"], {f"_p{r.id}": (counted[r.id], r.window) for r in rules})
    sequences = [r for r in rules if is_sequence(r)]
    if sequences:
        before = running_totals(before, ["_g"], {f"_a{r.id}": F.col(f"_nb{r.id}")
                                                 for r in sequences})
        before = before.withColumns({f"_a{r.id}": F.col(f"_a{r.id}") - F.col(f"_nb{r.id}")
                                     for r in sequences})
    before = before.withColumns({f"_p{r.id}": F.when(
        (F.col(f"_nf{r.id}") > 0) & (F.col(f"_p{r.id}") + F.col(counted[r.id]) >= r.limit),
        F.col(f"_p{r.id}")) for r in rules})
    return before.where(_can_fire(rules)).select(*SECOND, "_n", *[f"_p{r.id}" for r in rules],
                                                 *[f"_a{r.id}" for r in sequences])


def _can_fire(rules: Sequence[Rule]) -> Column:
    return any_of([F.col(f"_p{r.id}").isNotNull() for r in rules])


def _in_second(rows: DataFrame, sums: dict[str, Column], split: int, crowded: bool) -> DataFrame:
    """Running sums inside each second, in arrival order. Crowded seconds are a two-level prefix sum over
    stretches of arrival numbers (coarse time stamps can put a day of a source into one second)."""
    placed = rows.withColumn("_at", F.col("seq") * 2 + F.col("_kind"))
    if crowded:
        return running_totals(placed, SECOND, sums, "_at", F.floor(F.col("seq") / split)).drop("_at")
    upto = Window.partitionBy(*SECOND).orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return placed.withColumns({name: F.sum(value).over(upto) for name, value in sums.items()}).drop("_at")


def _candidates(own: DataFrame, reach: DataFrame, starts: dict[int, DataFrame],
                rules: Sequence[Rule], split: int, crowded: bool) -> DataFrame:
    """One row per event and rule that reaches its threshold (for sequences: that is able to)."""
    flags = [f"_{side}{r.id}" for r in rules for side in ("fb" if is_sequence(r) else "f")]
    reach = reach.where(_can_fire(rules) & (F.col("_n") > split if crowded else F.col("_n") <= split)).select(
        *SECOND, *[f"_p{r.id}" for r in rules], *[f"_a{r.id}" for r in rules if is_sequence(r)])
    rows = (own.where(any_of([F.col(name) for name in flags])).select(*EVENT_KEEP, "_g", *flags)
            .join(reach, list(SECOND)).withColumn("_kind", F.lit(1)))
    for number, marks in starts.items():
        inside = marks.join(reach.select(*SECOND), list(SECOND), "left_semi")
        rows = rows.unionByName(inside.select(*SECOND, "seq", F.lit(0).alias("_kind"),
                                              F.lit(1).alias(f"_new{number}")),
                                allowMissingColumns=True)
    inside, reached = {}, {}
    for rule in rules:
        source = (F.col(f"_new{rule.id}") if is_distinct(rule)
                  else F.col(f"_b{rule.id}" if is_sequence(rule) else f"_f{rule.id}").cast("long"))
        inside[f"_in{rule.id}"] = F.coalesce(source.cast("long"), F.lit(0))
        total = F.col(f"_p{rule.id}") + F.col(f"_in{rule.id}")
        position = (F.col(f"_a{rule.id}") + F.col(f"_in{rule.id}") if is_sequence(rule)
                    else F.lit(None))
        # columns of their own: inside the generator they would be interpreted, not compiled
        reached[f"_n{rule.id}"] = F.when(F.col(f"_f{rule.id}") & (total >= rule.limit), total.cast("long"))
        reached[f"_at{rule.id}"] = position.cast("long")
    # events without a number have no place in a second
    return (_in_second(rows.where(F.col("seq").isNotNull()), inside, split, crowded)
            .where(F.col("_kind") == 1).select(*EVENT_KEEP, "_g", *[c.alias(n) for n, c in reached.items()])
            .withColumn("_numbers", numbers_of([F.col(f"_n{r.id}").isNotNull() for r in rules]))
            .withColumn("_i", F.explode_outer("_numbers")).where(F.col("_i").isNotNull())
            .select(*EVENT_KEEP, "_g", chosen("_i", [F.lit(r.id) for r in rules]).alias("rule_id"),
                    chosen("_i", [F.col(f"_n{r.id}") for r in rules]).alias("n"),
                    chosen("_i", [F.col(f"_at{r.id}") for r in rules]).alias("a")))


def _sequence_hits(able: DataFrame, rule: Rule, block: int | None) -> DataFrame:
    """Of the triggers able to fire, those that do; `prior_fails` is what they consumed."""
    first = materialise(able.groupBy("_g", "a").agg(F.min(F.struct(
        "epoch", "seq", "src_ip", "dst_ip", "url", "raw", "n")).alias("e")))   # used twice
    picked = select_apart(first.select("_g", "a"), rule.limit, **({"block": block} if block else {}))
    prior = F.least(F.col("e.n"), F.coalesce(F.col("a") - F.col("last"), F.col("e.n")))
    return first.join(picked, ["_g", "a"]).select(
        *[f"e.{c}" for c in EVENT_KEEP], "_g", F.lit(rule.id).alias("rule_id"),
        F.lit(None).cast("long").alias("count"), prior.alias("prior_fails"))


def windowed_hits(events: DataFrame, rules: Sequence[Rule], consumed: DataFrame | None = None,
                  block: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """Hits of windowed rules that share a group field: EVENT_KEEP, _g, rule_id, count,
    prior_fails."""
    own = _flagged(events, rules, consumed)
    slots = materialise(own.groupBy(*SECOND).agg(
        F.count("*").alias("_n"),
        *[F.count_if(f"_f{r.id}").alias(f"_nf{r.id}") for r in rules],
        *[F.count_if(f"_b{r.id}").alias(f"_nb{r.id}") for r in rules if is_sequence(r)]))
    counting = [r for r in rules if not is_distinct(r)]
    sequences = [r for r in rules if is_sequence(r)]
    plain = [r for r in rules if not is_sequence(r)]
    reaches = [_slot_reach(slots, counting)] if counting else []
    starts = {}
    for rule in rules:
        if is_distinct(rule):
            starts[rule.id], steps = _value_starts(own, rule)
            reaches.append(_distinct_reach(slots, steps, rule))
    reach = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reaches)
    if len(reaches) > 1:
        reach = reach.groupBy(*SECOND).agg(*[F.max(c).alias(c) for c in reach.columns
                                             if c not in SECOND])
    # only where stamps are coarse is a second crowded; those have a plan of their own
    kinds = [False, True] if slots.where(F.col("_n") > stretch).head(1) else [False]
    if starts or len(rules) > 1 or len(kinds) > 1:
        reach = materialise(reach)   # used for the events, for sequences and for the starts of values

    def candidates(wanted: Sequence[Rule], marks: dict[int, DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [
            _candidates(own, reach, marks, wanted, stretch, crowded) for crowded in kinds])

    none = F.lit(None).cast("long")
    parts = [candidates(plain, starts).select(
        *EVENT_KEEP, "_g", "rule_id", F.col("n").alias("count"), none.alias("prior_fails"))] if plain else []
    parts += [_sequence_hits(candidates([rule], {}), rule, block) for rule in sequences]
    return reduce(lambda a, b: a.unionByName(b), parts)
