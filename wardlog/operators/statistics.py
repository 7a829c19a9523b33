"""Exact order statistics and ranking measures without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardlog.operators.timeline import in_even_parts, running_totals


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an aggregate without keys, which has exactly one row."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("x")).select("x.*")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, baseline, std): exact median and population deviation plus 1e-9, per column.

    Equal values are counted first; the counts are accumulated in value order, over ranges that hold equally
    many of them wherever they lie.
    """
    values = long_form(df, columns).where(F.col("value").isNotNull())
    stats = values.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total"),
        (F.stddev_pop("value") + F.lit(1e-9)).alias("std"))
    counts = in_even_parts(values.groupBy("feature", "value").agg(F.count("*").alias("n")), "feature", "value")
    ranked = running_totals(counts, ["feature"], {"upto": F.col("n")}, "value", F.col("_part"))
    ranked = ranked.join(F.broadcast(stats), "feature")      # one row per feature column
    first, last = F.col("upto") - F.col("n"), F.col("upto")

    def at(position):
        return F.max(F.when((first <= position) & (position < last), F.col("value")))

    return (ranked.groupBy("feature", "std")
            .agg(at(F.floor((F.col("total") - 1) / 2)).alias("a"),
                 at(F.floor(F.col("total") / 2)).alias("b"))
            .select("feature", ((F.col("a") + F.col("b")) / 2).alias("baseline"), "std"))


def explain(df: DataFrame, stats: DataFrame, columns: Sequence[str], top_k: int = 3) -> DataFrame:
    """`top_features`: the columns furthest from their median in units of deviation."""
    one_row = stats.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("baseline", "std")))).alias("_stats"))
    entries = []
    for index, name in enumerate(columns):
        stat = F.col("_stats")[F.lit(name)]
        deviation = (F.col(name).cast("double") - stat["baseline"]) / stat["std"]
        entries.append(F.struct(
            (-F.abs(deviation)).alias("order"), F.lit(index).alias("index"),
            F.lit(name).alias("feature"), F.round(F.col(name).cast("double"), 4).alias("value"),
            F.round(stat["baseline"], 4).alias("baseline"),
            F.round(deviation, 2).alias("deviation"),
            F.round(F.abs(deviation), 2).alias("abs_deviation")))
    top = F.transform(F.slice(F.array_sort(F.array(*entries)), 1, top_k), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"),
        e["baseline"].alias("baseline"), e["deviation"].alias("deviation"),
        e["abs_deviation"].alias("abs_deviation")))
    return attach(df, one_row).withColumn("top_features", top).drop("_stats")


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, with running totals upwards."""
    counts = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return running_totals(in_even_parts(counts, "score"), [], {
        "pos_upto": F.col("pos"), "neg_upto": F.col("neg"), "rank": F.lit(1)}, "score", F.col("_part"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: n_samples, n_positive and the area under the curve (NULL with one class)."""
    below = F.col("neg_upto") - F.col("neg")
    wins = F.sum(F.col("pos") * (2 * below + F.col("neg")))
    pos, neg = F.sum("pos"), F.sum("neg")
    return _by_score(scored).agg(
        (pos + neg).alias("n_samples"), pos.alias("n_positive"),
        F.when((pos > 0) & (neg > 0), wins / (2.0 * pos * neg)).alias("auc"))


def roc_curve(scored: DataFrame, points: int = 30) -> DataFrame:
    """About `points` evenly spaced points of the curve, from the highest score downwards."""
    ranked = _by_score(scored)
    total = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"),
                       F.count("*").alias("m"))
    step = F.greatest(F.floor(F.col("m") / points), F.lit(1))
    from_top = F.col("m") - F.col("rank")
    return (attach(ranked, total).where(F.pmod(from_top, step) == 0)
            .select("score",
                    F.try_divide(F.col("q") - F.col("neg_upto") + F.col("neg"), F.col("q"))
                    .alias("fpr"),
                    F.try_divide(F.col("p") - F.col("pos_upto") + F.col("pos"), F.col("p"))
                    .alias("tpr")))


def _rates(tp, fp, fn):
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return precision.alias("precision"), recall.alias("recall"), f1.alias("f1")


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates at each threshold, from one aggregate over the scores."""
    positive = F.col("label") == 1
    sums = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        sums += [F.count_if(hit & positive).alias(f"tp{i}"),
                 F.count_if(hit & ~positive).alias(f"fp{i}"),
                 F.count_if(~hit & positive).alias(f"fn{i}")]
    rows = F.explode(F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
        F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, t in enumerate(thresholds)])).alias("r")
    out = scored.agg(*sums).select(rows).select("r.*")
    return out.select("threshold", "tp", "fp", "fn",
                      *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    return threshold_sweep(scored, [threshold])


def score_histogram(scored: DataFrame, score: str = "score") -> DataFrame:
    """Ten equal bins, the last one closed, empty bins included."""
    bins = scored.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    counts = scored.groupBy(F.least(F.lit(9), F.floor(F.col(score) * 10)).cast("int").alias("bin")
                            ).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select(
        "bin", F.format_string("%.1f~%.1f", F.col("bin") / 10, (F.col("bin") + 1) / 10)
        .alias("range"), F.coalesce("n", F.lit(0)).alias("count"))
