"""Keeping hits and alerts up to date while events arrive in any order.

An event can only change hits of its own source in the `W` seconds from its time on, W being the longest window. Time is
cut into cells of W seconds: new or replaced events touch their own cell and the next one, and the hits of a
cell depend on events of that cell and the one before. So the plans of `detect` run over the touched cells only, and
what differs from the stored hits is the change: hits that are new, that say something else, or that no longer hold.

Sequences reset with each hit, so a change can move later hits of the same source: those are looked at from
the first touched cell to the newest event of that source, after the last hit before it. In-order input touches
only the end.

Alerts take up new hits without looking at old ones: hits are merged among themselves, then as intervals with the stored
open alerts. Only an alert that lost a hit is built again from its hits. Alerts that are no longer open take part in
nothing, and hits that were theirs stay theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlog.functions.filters import event_filter
from wardlog.operators.alerts import consolidate, is_open
from wardlog.operators.windowed import any_of, is_sequence, windowed_hits
from wardlog.plans.detection import described, regex_hits, usable
from wardlog.sources.commits import DAY, days_between
from wardlog.sources.rules import Rule, check_group_field

Near = Callable[..., DataFrame]      # rows of the wanted days; with `untimed=True` also those without a time

SAYS = ("epoch", "count", "prior_fails", "matched_text", "group_value")     # what a stored hit is compared by


def cell_of(epoch: Column, length: int) -> Column:
    return F.floor(epoch / length)


def _touched(changed: DataFrame, family: Sequence[Rule], length: int) -> DataFrame:
    """(_g, _cell) in which hits of the family may differ."""
    tests = [event_filter(r.pattern) for r in family]
    tests += [event_filter(r.match_field) for r in family if is_sequence(r)]
    group = F.col(check_group_field(family[0].group)).cast("string")
    at = cell_of(F.col("epoch"), length)
    return (changed.where(F.col("epoch").isNotNull() & (group != "") & any_of(tests))
            .select(group.alias("_g"), F.explode(F.array(at, at + 1)).alias("_cell")).distinct())


def _in(df: DataFrame, keys: DataFrame, group: Column, length: int) -> DataFrame:
    cell = cell_of(F.col("epoch"), length)
    return df.join(keys.withColumnsRenamed({"_g": "_kg", "_cell": "_kc"}),
                   (group == F.col("_kg")) & (cell == F.col("_kc")), "left_semi")


def _span(days: Sequence[int], length: int) -> set[int]:
    """Days of the cells around events of the given days."""
    out: set[int] = set()
    for h in days:
        first, last = h * DAY // length - 1, ((h + 1) * DAY - 1) // length + 1
        out.update(days_between(first * length, (last + 1) * length - 1))
    return out


def refreshed(changed: DataFrame, added: DataFrame, days: Sequence[int], rules: Sequence[Rule], events: Near,
              stored: Near, stored_days: Iterable[int], replaced: Column | None = None,
              stored_before: Column | None = None) -> DataFrame:
    """Changes of the hits: hit columns, `live` (false: it no longer holds), `known` (one of that number was stored).

    `changed` are the events that are new or gone, `added` those that are new; `days` are theirs (without that of lines
    without a time), `stored_days` those of all events. `events` and `stored` give the events, with the added ones, and
    the hits that count, of given days. `replaced` is a condition on stored hits whose events are gone. `stored_before`
    is one on hits with a time, true if their events are not of `added`; it may be given if no number of `added` was
    used before. Hits of added events are then new without being compared with the stored ones.
    """
    active = [r for r in rules if r.enabled and usable(r)]
    fresh, new, old = [], [], []
    signatures = [r for r in active if r.rule_type == "regex"]
    if signatures:
        (fresh if stored_before is None else new).append(regex_hits(added, signatures))
    if replaced is not None:
        old.append(stored(days, untimed=True).where(replaced))
    families: dict[tuple, list[Rule]] = {}
    for r in active:
        if r.rule_type != "regex":
            families.setdefault((r.group, is_sequence(r)), []).append(r)
    for (field, sequences), family in families.items() if days else ():
        length = max(r.window for r in family)
        keys, group = _touched(changed, family, length), F.col(check_group_field(field)).cast("string")
        numbers = [r.id for r in family]
        near = _span(days, length)
        if sequences:
            near = near | {h for h in stored_days if h > min(near)}
            begin = keys.groupBy("_g").agg(F.min("_cell").alias("_from"))
            own = events(near).join(begin, group == F.col("_g")).where(
                cell_of(F.col("epoch"), length) >= F.col("_from") - 1).drop("_g", "_from")
            held = stored(near).where(F.col("rule_id").isin(numbers)).join(begin, F.col("group_value") == F.col("_g"))
            inside = cell_of(F.col("epoch"), length) >= F.col("_from")
            earlier = held.where(~inside).drop("_g", "_from")
            found = windowed_hits(own, family, earlier).join(begin, "_g").where(inside).drop("_from")
            old.append(held.where(inside).drop("_g", "_from"))
        else:
            before = keys.select("_g", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"))).alias("_cell")).distinct()
            found = _in(windowed_hits(_in(events(near), before, group, length), family), keys, F.col("_g"), length)
            old.append(_in(stored(near).where(F.col("rule_id").isin(numbers)), keys, F.col("group_value"), length))
        if stored_before is None:
            fresh.append(found)
        else:
            fresh.append(found.where(stored_before))
            new.append(found.where(~stored_before))
    told = lambda parts: described(parts, active, changed.sparkSession) if parts else None
    changes = _differences(told(fresh), old, stored)
    if not new:
        return changes
    return changes.unionByName(told(new).withColumns({"live": F.lit(True), "known": F.lit(False)}))


def _differences(fresh: DataFrame | None, old: list[DataFrame], stored: Near) -> DataFrame:
    kept = reduce(lambda a, b: a.unionByName(b), old).dropDuplicates(["rule_id", "seq"]) if old else stored([])
    columns = [c for c in kept.columns if c not in ("commit", "live", "known")]
    fresh = (fresh if fresh is not None else kept.limit(0)).select(*columns)
    both = fresh.alias("n").join(kept.alias("o"), ["rule_id", "seq"], "full_outer")
    is_new, was = F.col("n.rule_name").isNotNull(), F.col("o.rule_name").isNotNull()
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in SAYS])
    return both.where(~(is_new & was & same)).select(
        *[c if c in ("rule_id", "seq") else F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
          for c in columns], is_new.alias("live"), was.alias("known"))


def current(hits: DataFrame) -> DataFrame:
    """Of the stored versions of a hit the latest, if it holds; `commit` is when it first came to hold."""
    values = [c for c in hits.columns if c not in ("rule_id", "seq")]
    latest = hits.groupBy("rule_id", "seq").agg(
        F.max_by(F.struct(*values), F.col("commit")).alias("v"),
        F.max(F.when(F.col("live") & ~F.col("known"), F.col("commit"))).alias("_since"))
    return latest.where("v.live").select("rule_id", "seq", *[f"v.{c}" for c in values if c != "commit"],
                                         F.coalesce("_since", "v.commit").alias("commit"))


# ---------------------------------------------------------------------------- alerts

#: An alert with what merging needs besides what readers see.
STORED_ALERT = (
    "alert_id BIGINT, title STRING, rule_id INT, severity STRING, src_ip STRING, dst_ip STRING, url STRING, status STRING, "
    "count BIGINT, first_seen BIGINT, last_seen BIGINT, last_matched STRING, last_count BIGINT, source_type STRING, "
    "samples ARRAY<STRING>, first_seq BIGINT, last_seq BIGINT, "
    "said ARRAY<STRUCT<epoch: BIGINT, seq: BIGINT, line: BIGINT, text: STRING>>, commit BIGINT")
_NAMES = [c.split()[0] for c in STORED_ALERT.split("said")[0].split(", ") if c] + ["said", "commit"]
_FIRST = ("rule_id", "severity", "dst_ip", "url", "source_type", "first_seq")
_LAST = ("last_matched", "last_count", "last_seq")
KEY = ("title", "_ip")


def _as_items(alerts: DataFrame, stored: bool) -> DataFrame:
    return alerts.withColumns({"_ip": F.coalesce("src_ip", F.lit("")), "_stored": F.lit(stored), "_broken": F.lit(False)})


def _joined(items: DataFrame, gap: int) -> DataFrame:
    """Number the runs of intervals of a key that are at most `gap` apart; those without a time are one run."""
    line = Window.partitionBy(*KEY, F.col("first_seen").isNull()).orderBy("first_seen", "last_seen")
    until = F.max("last_seen").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first_seen") - until > gap, F.row_number().over(line) == 1)
    numbered = items.withColumn("_opens", opens.cast("int"))
    return numbered.withColumn("_run", F.sum("_opens").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_timed", F.col("first_seen").isNotNull()).drop("_opens")


RUN = (*KEY, "_timed", "_run")


def _merged(items: DataFrame, commit: int, max_samples: int) -> DataFrame:
    """One alert per run of intervals. An alert that is stored keeps its number and status, the earliest one's."""
    start, end = F.struct("first_seen", "first_seq"), F.struct("last_seen", "last_seq")
    mark = F.struct("alert_id", "status")
    parts = items.groupBy(*RUN).agg(
        F.min_by(F.struct(*_FIRST), start).alias("f"), F.max_by(F.struct(*_LAST), end).alias("l"),
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min_by(mark, F.when(F.col("_stored"), start)).alias("m"), F.max("src_ip").alias("src_ip"),
        F.flatten(F.collect_list("said")).alias("said"), F.count_if(~F.col("_stored")).alias("_new"),
        F.max("commit").alias("commit"), F.count_if("_stored").alias("_old"))
    by_line = F.aggregate(      # the earliest arrival of each line
        F.array_sort("said"), F.array().cast(items.schema["said"].dataType),
        lambda seen, s: F.when(F.exists(seen, lambda x: x["line"] == s["line"]), seen).otherwise(F.concat(seen, F.array(s))))
    parts = parts.withColumn("said", F.slice(F.reverse(by_line), 1, max_samples)).withColumn("said", F.reverse("said"))
    number = F.xxhash64("title", "_ip", "first_seen", "f.first_seq")
    touched = (F.col("_new") > 0) | (F.col("_old") > 1)
    return parts.select(
        F.coalesce("m.alert_id", number).alias("alert_id"), "title", "f.rule_id", "f.severity", "src_ip", "f.dst_ip", "f.url",
        F.coalesce("m.status", F.lit("new")).alias("status"), "count", "first_seen", "last_seen", "l.last_matched",
        "l.last_count", "f.source_type", F.transform("said", lambda s: s["text"]).alias("samples"), "f.first_seq",
        "l.last_seq", "said", F.when(touched, F.lit(commit)).otherwise(F.col("commit")).cast("bigint").alias("commit"))


def _fragments(hits: DataFrame, gap: int, max_samples: int, stored: bool = False) -> DataFrame:
    made = consolidate(hits, gap, max_samples, for_merging=True, stored=stored)
    return made.withColumn("commit", F.lit(None).cast("bigint")).select(*_NAMES)


def updated_alerts(stored: DataFrame, changes: DataFrame, hits: Callable[[DataFrame], DataFrame], commit: int, gap: int,
                   max_samples: int) -> DataFrame:
    """All alerts after the changes of a commit.

    `stored` are the alerts before (STORED_ALERT), `changes` the change of the hits, read from files. `hits(spans)` gives the
    hits that hold by now in the days of (first_seen, last_seen); it is called only if an alert lost a hit.
    """
    kept = stored.where(~is_open(F.col("status")))
    items = _as_items(stored.where(is_open(F.col("status"))), True)
    new = changes.where(F.col("live") & ~F.col("known"))
    fragments = _as_items(_fragments(new, gap, max_samples, stored=True), False)
    everything = items.unionByName(fragments)
    lost = changes.where(F.col("known"))
    if lost.isEmpty():
        return kept.unionByName(_merged(_joined(everything, gap), commit, max_samples))
    points = lost.select(F.col("rule_name").alias("title"), F.coalesce("src_ip", F.lit("")).alias("_ip"), "src_ip",
                         F.col("epoch").alias("first_seen"), F.col("epoch").alias("last_seen")).distinct().withColumns(
        {"_stored": F.lit(False), "_broken": F.lit(True), "count": F.lit(0).cast("bigint")})
    runs = _joined(everything.unionByName(points, allowMissingColumns=True), gap)
    whole = runs.groupBy(*RUN).agg(F.max("_broken").alias("_bad"), F.min("first_seen").alias("_a"),
                                   F.max("last_seen").alias("_b"))
    good = runs.join(whole.where(~F.col("_bad")).select(*RUN), list(RUN), "left_semi").where(~F.col("_broken"))
    bad = whole.where("_bad")
    # of the hits in the time of a broken run those that no closed alert holds; alerts of that run keep their numbers
    inside = lambda at, a, b: at.eqNullSafe(a) | ((at >= a) & (at <= b))
    held = hits(bad).withColumn("_ip", F.coalesce("src_ip", F.lit(""))).alias("h").join(
        bad.select(F.col("title").alias("rule_name"), "_ip", "_a", "_b"), ["rule_name", "_ip"]).where(
        inside(F.col("epoch"), F.col("_a"), F.col("_b"))).drop("_a", "_b")
    closed = kept.select(F.col("title").alias("_t"), F.coalesce("src_ip", F.lit("")).alias("_i"), F.col("first_seen").alias("_a"),
                         F.col("last_seen").alias("_b"), F.col("commit").alias("_upto"))
    free = held.join(closed, (F.col("rule_name") == F.col("_t")) & (F.col("_ip") == F.col("_i"))
                     & inside(F.col("epoch"), F.col("_a"), F.col("_b")) & (F.col("commit") <= F.col("_upto")), "left_anti")
    names = items.join(bad.select(*KEY, "_a", "_b"), list(KEY)).where(inside(F.col("first_seen"), F.col("_a"), F.col("_b"))).select(
        *KEY, F.struct("first_seen", "alert_id", "status").alias("_m"), F.col("first_seen").alias("_from"),
        F.col("last_seen").alias("_to"))
    rebuilt = _as_items(_fragments(free.drop("_ip"), gap, max_samples), False)
    # numbers and status of the earlier alerts, put at the rebuilt ones whose time they share
    shared = (inside(F.col("_from"), F.col("first_seen"), F.col("last_seen"))
              | inside(F.col("first_seen"), F.col("_from"), F.col("_to")))
    marks = rebuilt.select(*KEY, "first_seen", "last_seen").join(names, list(KEY)).where(shared)
    marks = marks.groupBy(*KEY, "first_seen").agg(F.min("_m").alias("_m"))
    first = Window.partitionBy("_m.alert_id").orderBy("first_seen")      # of a divided alert the first part keeps it
    marks = marks.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        F.col("title").alias("_t"), F.col("_ip").alias("_i"), F.col("first_seen").alias("_at"), "_m")
    again = rebuilt.drop("alert_id", "status").join(
        marks, (F.col("title") == F.col("_t")) & (F.col("_ip") == F.col("_i")) & F.col("first_seen").eqNullSafe(F.col("_at")), "left")
    again = again.withColumns({"alert_id": F.col("_m.alert_id"), "status": F.col("_m.status"),
                               "_stored": F.col("_m").isNotNull()}).select(*rebuilt.columns)
    return kept.unionByName(_merged(_joined(good, gap), commit, max_samples)).unionByName(
        _merged(_joined(again, gap).withColumn("commit", F.lit(commit).cast("bigint")), commit, max_samples))
