"""Classification metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.clean import count_below
from tidemark.sources.shared import stored


def confusion(df: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 (0 where undefined) of truth and predicted (0/1)."""
    n = lambda t, p: F.count(F.when((F.col("truth") == t) & (F.col("predicted") == p), 1))
    out = df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp")
    return out.withColumn("precision", ratio(tp, tp + F.col("fp"))).withColumn("recall", ratio(tp, tp + F.col("fn"))).withColumn("f1", ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")))


#: Ranges of scores that running counts are taken in.
RANGES = 256


def curve(df: DataFrame, by: str) -> DataFrame:
    """Per distinct score, from the highest: pos and neg there, tp and fp so far, all_pos and all_neg of the group.

    Counts come first. Each group's scores are then dealt in ranges; the sums of the ranges above are a short list, so running counts are taken
    within a range only, and no task has all scores of a group.
    """
    at = df.groupBy(by, "score").agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
    whole = at.groupBy(F.col(by).alias("__by")).agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10_000).alias("__cuts"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    ranged = at.join(whole, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__range", F.coalesce(F.size("__cuts") - count_below("__cuts", F.col("score"), RANGES - 1), F.lit(0))).drop("__by", "__cuts")
    above = Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__at")).agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    sums = sums.select("__by", "__at", F.coalesce(F.sum("__pos").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__neg").over(above), F.lit(0)).alias("__fp"))
    met = ranged.join(sums, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__at"))).drop("__by", "__at")
    down = Window.partitionBy(by, "__range").orderBy(F.desc("score"))
    return met.withColumn("tp", F.col("__tp") + F.sum("pos").over(down)).withColumn("fp", F.col("__fp") + F.sum("neg").over(down)).select(by, "score", "pos", "neg", "tp", "fp", "all_pos", "all_neg")


def areas(df: DataFrame, by: str) -> DataFrame:
    """roc_auc (ties count half) and avg_precision (steps); null with one class only."""
    c = curve(df, by)
    return c.groupBy(by).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.max(F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("all_pos")).alias("avg_precision"),
    )


def rates(df: DataFrame, *by: str) -> DataFrame:
    """confusion() with n_true_anomalies, n_pred_anomalies, n_total, anomaly_rate_true and anomaly_rate_pred."""
    c = confusion(df, *by)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    true, said = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    return c.select("*", true.alias("n_true_anomalies"), said.alias("n_pred_anomalies"), n.alias("n_total"), (true / n).alias("anomaly_rate_true"), (said / n).alias("anomaly_rate_pred"))


def roc_points(df: DataFrame, by: str) -> DataFrame:
    """Per distinct score: threshold, fpr, tpr; and the origin, with a null threshold for infinity. Points on a straight line between others are kept."""
    c = curve(df, by)
    points = c.select(by, F.col("score").cast("double").alias("threshold"), F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"))
    return points.union(df.select(by).distinct().select(by, F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0)))


def pr_points(df: DataFrame, by: str) -> DataFrame:
    """Per distinct score: threshold, precision, recall; and the end (1, 0), with a null threshold."""
    c = curve(df, by)
    points = c.select(by, F.col("score").cast("double").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_pos").alias("recall"))
    return points.union(df.select(by).distinct().select(by, F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)))


def folds(df: DataFrame, k: int = 5, id_col: str = "id", strategy: str = "stratified", label_col: str = "truth") -> DataFrame:
    """df with fold 0 .. k-1. "stratified": each label's rows dealt in turn by hash of the id; "temporal": contiguous parts in order of id, the
    first ones larger by one row where they don't divide.

    Places come from counts of hash ranges (or id ranges), so no label and no table is ever sorted in one task.
    """
    if strategy not in ("stratified", "temporal"):
        raise ValueError(f"no strategy {strategy}")
    stratified = strategy == "stratified"
    order = F.xxhash64(id_col) if stratified else F.col(id_col)
    label = F.col(label_col) if stratified else F.lit(0)
    kept = df.withColumn("__o", order).withColumn("__l", label)
    if stratified:
        part = F.shiftright("__o", 56).cast("int")
    else:
        cuts = kept.approxQuantile("__o", [i / 64 for i in range(1, 64)], 0.005)
        part = sum((F.when(F.col("__o") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    kept = kept.withColumn("__p", part)
    counts = kept.groupBy("__l", "__p").agg(F.count("*").alias("__c"))
    before = counts.select("__l", "__p", (F.sum("__c").over(Window.partitionBy("__l").orderBy("__p")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy("__l")).alias("__all"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__l", "__p").orderBy("__o", id_col)) - 1
    ranked = kept.join(F.broadcast(before), ["__l", "__p"]).withColumn("__k", place)
    whole, rest = F.floor(F.col("__all") / k), F.col("__all") % k
    large = rest * (whole + 1)
    temporal = F.when(F.col("__k") < large, F.floor(F.col("__k") / (whole + 1))).otherwise(rest + F.floor((F.col("__k") - large) / F.greatest(whole, F.lit(1))))
    return ranked.withColumn("fold", (F.col("__k") % k if stratified else temporal).cast("int")).drop("__o", "__l", "__p", "__c", "__before", "__all", "__k")


def over_folds(metrics: DataFrame, *names: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and std (ddof 0) of each metric over the folds that have it; null without any."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return metrics.groupBy(*by).agg(*[f(known(c)).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


OUTCOMES = ("tp", "fp", "fn", "tn")
#: Distinct scores whose weights are drawn together.
DRAWN = 512


def replicates(df: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """rep, precision, recall, f1, roc_auc, avg_precision of resamples of the rows (truth, predicted, and score if there is one, else the areas are null).

    Every row's weight in a round is a Poisson number; equal rows' weights add up to one Poisson number of their count, so rows are counted
    by score and outcome first. Scores are dealt in ranges: a first pass sums each range's weights of all rounds, a second, with the sums of the ranges
    above, adds up the areas. Both draw the same numbers, DRAWN scores at a time. Rounds with one class only are left out.
    """
    import numpy as np
    import pandas as pd

    scored = "score" in df.columns
    one = lambda t, p: F.count(F.when((F.col("truth") == t) & (F.col("predicted") == p), 1))
    at = df.withColumn("score", F.col("score").cast("double") if scored else F.lit(0.0)).groupBy("score").agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    cuts = at.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    ranged = at.withColumn("range", F.coalesce(F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c >= F.col("score"))), F.lit(0))) if cuts else at.withColumn("range", F.lit(0))

    def drawn(pdf):
        """(rounds x scores, four) weights of a range's scores, from the highest, DRAWN at a time."""
        counts = pdf.sort_values("score", ascending=False)[list(OUTCOMES)].to_numpy()
        for k in range(0, len(counts), DRAWN):
            yield np.random.default_rng([seed, int(pdf["range"].iloc[0]), k]).poisson(counts[None, k : k + DRAWN], (rounds, *counts[k : k + DRAWN].shape))

    def totals(pdf):
        w = sum(x.sum(1) for x in drawn(pdf))
        return pd.DataFrame({"range": pdf["range"].iloc[0], "rep": np.arange(rounds)} | {c: w[:, k] for k, c in enumerate(OUTCOMES)})

    def parts(given, above):
        above = above.sort_values("rep")
        tp, fp = above["tp_above"].to_numpy().astype(float), above["fp_above"].to_numpy().astype(float)
        roc, step = np.zeros(rounds), np.zeros(rounds)
        for w in drawn(given):
            pos, neg = w[:, :, 0] + w[:, :, 2], w[:, :, 1] + w[:, :, 3]
            up, down = tp[:, None] + pos.cumsum(1), fp[:, None] + neg.cumsum(1)
            roc += (neg * (up - pos / 2)).sum(1)
            step += (pos * up / np.maximum(up + down, 1)).sum(1)
            tp, fp = up[:, -1], down[:, -1]
        return pd.DataFrame({"rep": np.arange(rounds), "roc": roc, "step": step})

    sums = stored(ranged.groupBy("range").applyInPandas(totals, "range int, rep int, tp long, fp long, fn long, tn long"), "replicates")
    before = Window.partitionBy("rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select("range", "rep", *[F.coalesce(F.sum(F.col(a) + F.col(b)).over(before), F.lit(0)).alias(f"{c}_above") for a, b, c in (("tp", "fn", "tp"), ("fp", "tn", "fp"))])
    summed = ranged.groupBy("range").cogroup(above.groupBy("range")).applyInPandas(parts, "rep int, roc double, step double").groupBy("rep").agg(F.sum("roc").alias("roc"), F.sum("step").alias("step"))
    every = sums.groupBy("rep").agg(*[F.sum(c).alias(c) for c in OUTCOMES]).join(summed, "rep").filter("tp + fn > 0 and fp + tn > 0")
    tp, fp, fn, tn = map(F.col, OUTCOMES)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    area = lambda x: x if scored else F.lit(None).cast("double")
    return every.select("rep", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), area(F.col("roc") / ((tp + fn) * (fp + tn))).alias("roc_auc"), area(F.col("step") / (tp + fn)).alias("avg_precision"))


def bootstrap_table(df: DataFrame, rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, mean, lower, upper, std over the replicates; NaN with under 11 of them. Without scores only precision, recall and f1."""
    names = ["precision", "recall", "f1", *(["roc_auc", "avg_precision"] if "score" in df.columns else [])]
    long = replicates(df, rounds, seed).select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*")
    tail = (1 - confidence) / 2
    enough = lambda c: F.when(F.count("v") > 10, c).otherwise(F.lit(float("nan")))
    # As many values a metric as there are rounds.
    told = long.groupBy("metric").agg(*[enough(c).alias(n) for n, c in (("mean", F.avg("v")), ("lower", F.percentile("v", F.lit(tail))), ("upper", F.percentile("v", F.lit(1 - tail))), ("std", F.stddev_pop("v")))])
    every = df.sparkSession.createDataFrame([(n,) for n in names], "metric string").join(told, "metric", "left")
    return every.select("metric", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("mean", "lower", "upper", "std")])


def bootstrap(df: DataFrame, rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> dict[str, dict[str, float]]:
    """bootstrap_table() as a dictionary."""
    return {r.metric: {c: r[c] for c in ("mean", "lower", "upper", "std")} for r in bootstrap_table(df, rounds, confidence, seed).collect()}


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * (f - 1 if f > 1 else f)


def paired_tests(a: list[float], b: list[float]) -> dict[str, float]:
    """Means, paired t-test (3 values or more) and Wilcoxon's signed ranks (6 or more; exact without ties or zeros up to 50, else normal) of folds."""
    from math import erfc, sqrt

    import numpy as np

    x, y = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    d, n, none = x - y, len(x), float("nan")
    out = {"mean_a": float(x.mean()), "mean_b": float(y.mean()), "mean_diff": float(d.mean()), "ttest_statistic": none, "ttest_pvalue": none, "wilcoxon_statistic": none, "wilcoxon_pvalue": none}
    if n >= 3 and d.std(ddof=1) > 0:
        t = d.mean() / (d.std(ddof=1) / sqrt(n))
        out |= {"ttest_statistic": float(t), "ttest_pvalue": _student(t, n - 1)}
    z = d[d != 0]
    if n >= 6 and len(z):
        size = np.abs(z)
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        low = min(rank[z > 0].sum(), rank[z < 0].sum())
        m = len(z)
        if len(np.unique(size)) == m == n and m <= 50:
            ways = np.zeros(m * (m + 1) // 2 + 1)
            ways[0] = 1
            for k in range(1, m + 1):
                ways[k:] = ways[k:] + ways[:-k]
            p = min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**m)
        else:
            ties = np.unique(size, return_counts=True)[1]
            var = m * (m + 1) * (2 * m + 1) / 24 - (ties**3 - ties).sum() / 48
            p = erfc(abs(low - m * (m + 1) / 4) / sqrt(2 * var))
        out |= {"wilcoxon_statistic": float(low), "wilcoxon_pvalue": float(p)}
    return out


def _student(t: float, df: int) -> float:
    """Two-sided tail of Student's t."""
    return _beta_tail(df / (df + t * t), df / 2, 0.5)


def stars(p: float | None) -> str:
    """Stars of significance."""
    return "" if p is None or p != p else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"


def score_class(value: Column) -> Column:
    """good from 0.7, ok from 0.4, else poor; na without a value."""
    return F.when(value.isNull() | F.isnan(value), "na").when(value >= 0.7, "good").when(value >= 0.4, "ok").otherwise("poor")


def feature_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean, std, min, max (of the values there are) and nan_count."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names])).alias("f")).select("f.*")
    there = F.when(~F.isnan("v"), F.col("v"))
    return long.groupBy("feature").agg(F.avg(there).alias("mean"), F.stddev_pop(there).alias("std"), F.min(there).alias("min"), F.max(there).alias("max"), F.count(F.when(F.col("v").isNull() | F.isnan("v"), 1)).alias("nan_count"))


def effect_sizes(df: DataFrame, names: list[str], label_col: str = "label") -> DataFrame:
    """feature, effect: how far the anomalies' mean is from the others', in the others' standard deviations."""
    long = df.select(F.col(label_col).alias("__y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names])).alias("f")).select("__y", "f.*").filter(~F.isnan("v"))
    of = lambda f, y: f(F.when(F.col("__y") == y, F.col("v")))
    return long.groupBy("feature").agg((F.abs(of(F.avg, 1) - of(F.avg, 0)) / (of(F.stddev_pop, 0) + 1e-10)).alias("effect"))


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """feature_a, feature_b, corr for every ordered pair, in one pass; 0 where it is undefined."""
    pairs = [(a, b) for a in names for b in names]
    row = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.coalesce(F.nanvl(F.col(f"c{k}"), F.lit(0.0)), F.lit(0.0)).alias("corr")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def histogram(df: DataFrame, value: str, bins: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """bin (from 0; the greatest value falls in the last), bin_start, n, density; equal values are one bin."""
    there = df.filter(F.col(value).isNotNull()).withColumn("__one", F.lit(1))
    ends = there.groupBy("__one", *by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n"))
    met = there.join(ends, ["__one", *by])
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("__lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return met.withColumn("bin", at).withColumn("__w", width).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.first("__lo").alias("__lo"), F.first("__w").alias("__w"), F.first("__n").alias("__n")).select(*by, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_start"), "n", F.try_divide(F.col("n"), F.col("__n") * F.col("__w")).alias("density"))


def agreement(df: DataFrame, models: list[str], *by: str) -> DataFrame:
    """n, and how many rows all, over half, or any of the models (0/1 columns) flag."""
    votes = sum((F.col(m).cast("int") for m in models), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    return df.groupBy(*by).agg(F.count("*").alias("n_points"), n(votes == len(models)).alias("unanimous"), n(votes * 2 > len(models)).alias("majority"), n(votes > 0).alias("any"))


def detections(df: DataFrame, models: list[str]) -> DataFrame:
    """model, n_detections, rate: of 0/1 columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("int").alias("v")) for m in models])).alias("x")).select("x.*")
    return long.groupBy("model").agg(F.sum("v").alias("n_detections"), F.avg("v").alias("rate"))


def dataset_metadata(points: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target with points: what is known of it, n_points, n_anomalies, anomaly_fraction, label_type, filename."""
    held = points.groupBy(F.col("series_id").alias("target_id")).agg(F.count("*").alias("n_points"), F.sum("label").alias("n_anomalies"), F.avg("label").alias("anomaly_fraction"))
    safe = F.concat(F.translate(F.col("target_id").cast("string"), " +", "_p"), F.lit(".csv"))
    return held.join(targets, "target_id").select("*", F.when(F.col("period").isNotNull(), "transit").otherwise("normal").alias("label_type"), safe.alias("filename"))


def dataset_summary(metadata: DataFrame) -> DataFrame:
    """total_targets, planet_hosts, non_planet, total_points, and the mean and median share of anomalies."""
    kind = lambda k: F.count(F.when(F.col("label_type") == k, 1))
    return metadata.agg(F.count("*").alias("total_targets"), kind("transit").alias("planet_hosts"), kind("normal").alias("non_planet"), F.sum("n_points").alias("total_points"), F.avg("anomaly_fraction").alias("mean_fraction"), F.median("anomaly_fraction").alias("median_fraction"))


def score_summary(scored: DataFrame, *by: str) -> DataFrame:
    """n_windows, n_anomalies, anomaly_rate, mean, least and greatest score of scored rows."""
    return scored.groupBy(*by).agg(F.count("*").alias("n_windows"), F.sum(F.col("is_anomaly").cast("int")).alias("n_anomalies"), F.avg(F.col("is_anomaly").cast("int")).alias("anomaly_rate"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
