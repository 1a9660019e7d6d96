"""Positional sliding windows: size ws, stride max(1, ws // 4), full windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import index_points, series


def stride_of(ws: int) -> int:
    return max(1, ws // 4)


def members(df: DataFrame, ws: int = 50) -> DataFrame:
    """One row per (window, point) by arithmetic on idx: window_id, pos; no range join."""
    st = stride_of(ws)
    indexed = df if "idx" in df.columns else index_points(df)
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - ws + 1) / st)).cast("int")
    high = F.least(F.floor(F.col("idx") / st), F.floor((F.col("n") - ws) / st)).cast("int")
    return indexed.filter(F.col("n") >= ws).filter(low <= high).withColumn("window_id", F.explode(F.sequence(low, high))).withColumn("pos", F.col("idx") - F.col("window_id") * st)


def statistics(df: DataFrame, ws: int = 50) -> DataFrame:
    """The order-free statistical features of each window, and its label."""
    m = members(df, ws)
    mad = m.groupBy("series_id", "window_id").agg(F.sort_array(F.collect_list("flux")).alias("x"), F.max("label").alias("label"), *[f.alias(a) for f, a in (
        (F.avg("flux"), "mean"), (F.stddev_pop("flux"), "std"), (F.min("flux"), "min"), (F.max("flux"), "max"), (F.max("flux") - F.min("flux"), "ptp"), (F.skewness("flux"), "skewness"), (F.kurtosis("flux"), "kurtosis"), (F.sqrt(F.avg(F.col("flux") * F.col("flux"))), "rms"))])
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    return mad.withColumn("median", middle(F.col("x"))).withColumn("d", F.array_sort(F.transform("x", lambda v: F.abs(v - F.col("median"))))).withColumn("mad", middle(F.col("d"))).drop("x", "d")


def to_points(df: DataFrame, flags: DataFrame, ws: int = 50, lowest: float = 0.1) -> DataFrame:
    """The windows' flags (series_id, window_id, flag 0/1, and score if there is one) on every point.

    is_vote (over half of its windows), is_any, n_windows; with scores also point_score (their mean, lower: odder; 0 without
    a window) and is_score (under the `lowest` quantile of its series, but for rounding). Points that no window covers are kept. No point is
    multiplied: each meets, in one join, the few windows that can cover points whose last window is the same.
    """
    st = stride_of(ws)
    indexed = df if "idx" in df.columns else index_points(df)
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - ws + 1) / st)).cast("int")
    high = F.least(F.floor(F.col("idx") / st), F.floor((F.col("n") - ws) / st)).cast("int")
    every = indexed.select("series_id", "idx", low.alias("__low"), F.when((F.col("n") >= ws) & (low <= high), high).alias("__high"))
    scored = "score" in flags.columns
    told = {"sum": F.sum("flag"), "count": F.count("flag"), "max": F.max("flag")} | ({"total": F.sum("score"), "scores": F.count("score")} if scored else {})
    each = flags.groupBy("series_id", "window_id").agg(*[f.alias(c) for c, f in told.items()])
    most = -(-ws // st)
    near = each.withColumn("__high", F.explode(F.sequence(F.col("window_id").cast("int"), (F.col("window_id") + most - 1).cast("int")))).groupBy("series_id", "__high").agg(F.array_sort(F.collect_list(F.struct("window_id", *told))).alias("__near"))
    met = every.join(near, ["series_id", "__high"], "left")
    of = lambda c: [F.when(F.get("__near", F.lit(k))["window_id"] >= F.col("__low"), F.get("__near", F.lit(k))[c]) for k in range(most)]
    add = lambda c: sum((F.coalesce(x, F.lit(0)) for x in of(c)), F.lit(0))
    mean = lambda a, n: F.try_divide(add(a), add(n))
    score = [F.coalesce(mean("total", "scores").cast("double"), F.lit(0.0)).alias("point_score")] if scored else []
    largest = F.greatest(*of("max")) if most > 1 else of("max")[0]
    votes = met.select("series_id", "idx", F.coalesce(mean("sum", "count") > 0.5, F.lit(False)).alias("is_vote"), F.coalesce(largest > 0, F.lit(False)).alias("is_any"), add("count").cast("long").alias("n_windows"), *score)
    if not scored:
        return votes
    cut = F.percentile("point_score", F.lit(lowest)).over(series())
    return votes.withColumn("__cut", cut).withColumn("is_score", F.col("point_score") < F.col("__cut") - 1e-9 * F.abs("__cut")).drop("__cut")
