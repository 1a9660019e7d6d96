"""Cleaning of series: every operator is DataFrame -> DataFrame, keyed by series_id; one shuffle on it serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def series() -> WindowSpec:
    return Window.partitionBy("series_id")


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clean(df: DataFrame, least: int = 10) -> DataFrame:
    """Rows with finite time and flux, of series with `least` of them; flux_err, if there is no such column, 0.01 std."""
    kept = df.withColumn("time", finite(F.col("time"))).withColumn("flux", finite(F.col("flux"))).dropna(subset=["time", "flux"])
    if "flux_err" not in df.columns:
        kept = kept.withColumn("flux_err", 0.01 * F.stddev_samp("flux").over(series()))
    return kept.withColumn("__n", F.count("*").over(series())).filter(F.col("__n") >= least).drop("__n")


def sigma_clip(df: DataFrame, sigma: float = 5.0) -> DataFrame:
    """One pass: |flux - median| < sigma std(ddof 0). A constant series keeps no row."""
    return df.withColumn("__m", F.median("flux").over(series())).withColumn("__s", F.stddev_pop("flux").over(series())).filter(F.abs(F.col("flux") - F.col("__m")) < sigma * F.col("__s")).drop("__m", "__s")


def normalize(df: DataFrame) -> DataFrame:
    """flux as (flux - mean) / std(ddof 1); the parameters stay as columns."""
    with_params = df.withColumn("flux_mean", F.avg("flux").over(series())).withColumn("flux_std", F.stddev_samp("flux").over(series()))
    return with_params.withColumn("flux", F.try_divide(F.col("flux") - F.col("flux_mean"), F.col("flux_std")))


def denormalize(df: DataFrame) -> DataFrame:
    """Back from normalize(); without its parameters, as it is."""
    return df.withColumn("flux", F.col("flux") * F.col("flux_std") + F.col("flux_mean")) if "flux_mean" in df.columns else df


#: Points that a task is meant to have in spread().
TASK = 1_000_000


def spread(df: DataFrame, most: int = TASK) -> DataFrame:
    """df dealt by series to tasks of about `most` points, if the session's shuffles would make fewer; what works by series then needs no other shuffle. Counts the rows."""
    tasks = -(-df.count() // most)
    return df.repartition(tasks, "series_id") if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def index_points(df: DataFrame) -> DataFrame:
    """idx from 0 and n, the series' length, in the total order `ord`."""
    return df.withColumn("idx", F.row_number().over(series().orderBy("ord")) - 1).withColumn("n", F.count("*").over(series()))


def count_below(cuts: str, x: Column, n: int) -> Column:
    """How many of the n ascending numbers in the array column `cuts` are less than x; null without cuts. Looks at about 2 sqrt(n) of them."""
    step = max(1, int(n**0.5))
    coarse = F.size(F.filter(F.lit(list(range(step, n + 1, step))), lambda i: F.get(cuts, i - 1) < x)) * step
    return F.when(F.col(cuts).isNotNull(), coarse + F.size(F.filter(F.slice(cuts, coarse + 1, step), lambda c: c < x)))


#: Points of a series up to which it is one task's work in cut_points(), and points that a part of a longer one has.
CUT = 1_000_000


def cut_points(df: DataFrame, most: int = CUT, time_col: str = "time") -> DataFrame:
    """index_points() for series of any length: idx, n, and part, the number of each stretch of `most` points.

    A series of more than `most` points is dealt by quantiles of time (the first of `ord`), numbered in these ranges, and the counts before
    a range give its first place; so neither numbering nor what follows by part is ever one task. Operators that find a part column work part by part,
    with as many points of the neighbouring parts as they need.
    """
    counts = df.groupBy("series_id").agg(F.count("*").alias("n"))
    long = counts.filter(F.col("n") > most).select("series_id")
    cuts = df.join(long, "series_id", "left_semi").groupBy("series_id").agg(F.percentile_approx(time_col, [k / 1024 for k in range(1, 1024)], 10_000).alias("__cuts"))
    ranged = df.join(counts, "series_id").join(cuts, "series_id", "left").withColumn("__range", F.coalesce(count_below("__cuts", F.col(time_col), 1023), F.lit(0))).drop("__cuts")
    earlier = Window.partitionBy("series_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.filter(F.col("n") > most).groupBy("series_id", "__range").agg(F.count("*").alias("__c")).select("series_id", "__range", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("series_id", "__range").orderBy("ord")) - 1
    # The ranges are keys of their own: a partitioning by series alone must not serve the window.
    numbered = ranged.join(before, ["series_id", "__range"], "left").repartition("series_id", "__range").withColumn("idx", (place + F.coalesce("__before", F.lit(0))).cast("long"))
    return numbered.drop("__range", "__before").withColumn("part", F.floor(F.col("idx") / most)).withColumn("__most", F.lit(most))


def by_part(points: DataFrame, reach: int) -> tuple[DataFrame, WindowSpec]:
    """Points for functions that look at most `reach` points to either side, and the window to do so in.

    Of points with a part, those within reach of another part are in that one too, with __own false: own_only() takes them out again.
    """
    if "part" not in points.columns:
        return points, series()
    inside, most = F.col("idx") - F.col("part") * F.col("__most"), F.col("__most")
    parts = F.array_compact(F.array(F.col("part"), F.when((inside < reach) & (F.col("part") > 0), F.col("part") - 1), F.when((inside >= most - reach) & (F.col("idx") + reach >= (F.col("part") + 1) * most), F.col("part") + 1)))
    met = points.withColumn("__in", F.explode(parts)).withColumn("__own", F.col("__in") == F.col("part"))
    return met.repartition("series_id", "__in"), Window.partitionBy("series_id", "__in")


def own_only(points: DataFrame) -> DataFrame:
    return points.filter("__own").drop("__own", "__in") if "__own" in points.columns else points


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(
        F.count("*").alias("n_points"), (F.max("time") - F.min("time")).alias("time_span"), F.min("time").alias("start_time"), F.max("time").alias("end_time"),
        F.avg("flux").alias("flux_mean"), F.stddev_samp("flux").alias("flux_std"), F.min("flux").alias("flux_min"), F.max("flux").alias("flux_max"), F.median("flux").alias("flux_median"),
    )


def global_stats(df: DataFrame) -> DataFrame:
    """Moments, percentiles and the median absolute deviation of each series."""
    spread = df.withColumn("__d", F.abs(F.col("flux") - F.median("flux").over(series())))
    p = lambda q: F.percentile("flux", F.lit(q))
    return spread.groupBy("series_id").agg(
        F.avg("flux").alias("mean"), F.stddev_pop("flux").alias("std"), F.median("flux").alias("median"), F.median("__d").alias("mad"), F.skewness("flux").alias("skew"), F.kurtosis("flux").alias("kurtosis"),
        p(0.05).alias("p05"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.95).alias("p95"), (p(0.75) - p(0.25)).alias("iqr"),
    )
