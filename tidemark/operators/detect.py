"""Training-free detectors and ephemeris labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import series


def point_anomalies(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Rows with |z| > threshold (ddof 0): z_score and kind dip or spike."""
    z = df.withColumn("z_score", F.try_divide(F.col("flux") - F.avg("flux").over(series()), F.stddev_pop("flux").over(series())))
    return z.filter(F.abs("z_score") > threshold).withColumn("kind", F.when(F.col("z_score") < 0, "dip").otherwise("spike"))


def simple_transits(df: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows with flux < median - k std."""
    return df.withColumn("__t", F.median("flux").over(series()) - k * F.stddev_pop("flux").over(series())).filter(F.col("flux") < F.col("__t")).drop("__t")


def transit_events(indexed: DataFrame, depth: float = 0.01, least: int = 3) -> DataFrame:
    """Runs of at least `least` points below (1 - depth) of the median; a run that touches the series' end is not reported."""
    rel = indexed.withColumn("rel", F.try_divide(F.col("flux"), F.median("flux").over(series()))).withColumn("below", (F.col("rel") < 1 - depth).cast("int"))
    runs = rel.withColumn("island", F.col("idx") - F.sum("below").over(series().orderBy("idx"))).filter("below = 1").groupBy("series_id", "island")
    events = runs.agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), F.count("*").alias("duration"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), (1 - F.min("rel")).alias("depth"), F.avg("flux").alias("mean_flux"), F.max("n").alias("n"))
    return events.filter((F.col("duration") >= least) & (F.col("end_idx") < F.col("n"))).withColumn("time_duration", F.col("end_time") - F.col("start_time")).drop("island", "n")


def phase_labels(df: DataFrame, targets: DataFrame) -> DataFrame:
    """in_transit 0/1 of each row from its target's ephemeris; 0 without one. Left equi-join: Spark broadcasts small catalogs."""
    met = df.join(targets.select(F.col("target_id").alias("series_id"), "period", "epoch", "duration_hours"), "series_id", "left")
    phase = F.pmod(F.col("time") - F.col("epoch"), F.col("period")) / F.col("period")
    half = F.col("duration_hours") / 24 / F.col("period") / 2
    return met.withColumn("phase", phase).withColumn("in_transit", F.coalesce(((phase < half) | (phase > 1 - half)).cast("int"), F.lit(0)))
