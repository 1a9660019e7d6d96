"""Synthetic curves: sinusoids and noise with planted transits, flares and outliers, each row computed from its own number."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named curves with what is planted in each, and their seeds.
PRESETS = {"normal_star": ((), 42), "exoplanet_transit": (("transit",), 123), "stellar_flares": (("flare",), 456), "noisy_outliers": (("outlier",), 789), "complex_system": (("transit", "flare", "outlier"), 999)}
#: Fixed values: (amplitude, period in days) of the slow changes.
WAVES = ((10.0, 50.0), (5.0, 20.0), (3.0, 10.0))


def _uniform(*of: Column) -> Column:
    """A number in (0, 1) that the columns determine."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(*of: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(*of, F.lit("r")))) * F.cos(2 * pi * _uniform(*of, F.lit("a")))


def curves(spark: SparkSession, kinds: dict[str, tuple[tuple[str, ...], int]] | None = None, n_points: int = 2000, days: float = 100.0, noise: float = 5.0) -> DataFrame:
    """series_id, time, flux, flux_err, label, type, ord of each named kind: base 1,000, three sinusoids, normal noise.

    transit: every 15 days for 0.15 days, 30 deep, with ramps over the outer and inner fifth; flare: two to four, fast rise and slow
    fall; outlier: about one in a hundred points, 50 to 150 up or down. The seed fixes all of it, however rows are partitioned.
    """
    kinds = kinds or PRESETS
    rows = spark.createDataFrame([(k, list(what), seed) for k, (what, seed) in kinds.items()], "series_id string, kinds array<string>, seed int")
    at = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1)))).withColumn("time", F.col("i") * days / max(n_points - 1, 1))
    slow = sum((a * F.sin(2 * pi * F.col("time") / p) for a, p in WAVES), F.lit(1000.0))
    base = slow + noise * _normal(F.col("seed"), F.col("i"))
    has = lambda kind: F.array_contains("kinds", kind)
    # Transits stand at 7.5, 22.5, ... days; the last whole period is the last that has one.
    number = F.floor(F.col("time") / 15)
    off = F.abs(F.col("time") - 15 * (number + 0.5)) / 0.075
    dip = F.when(has("transit") & (off < 1) & (number < int(days / 15)), 30 * F.when(off < 0.2, off / 0.2).when(off > 0.8, (1 - off) / 0.2).otherwise(1.0)).otherwise(0.0)
    flares, in_flare = F.lit(0.0), F.lit(False)
    for k in range(4):
        u = lambda name, k=k: _uniform(F.col("seed"), F.lit(k), F.lit(name))
        start, length, height = 20 + 60 * u("at"), 0.1 + 0.4 * u("long"), 80 + 120 * u("high")
        phase = (F.col("time") - start) / length
        here = has("flare") & (phase >= 0) & (phase < 1) & (F.lit(k) < 2 + F.floor(3 * _uniform(F.col("seed"), F.lit("n"))))
        flares, in_flare = flares + F.when(here, height * F.when(phase < 0.2, phase / 0.2).otherwise(F.exp(-5 * (phase - 0.2)))).otherwise(0.0), in_flare | here
    out = has("outlier") & (_uniform(F.col("seed"), F.col("i"), F.lit("o")) < 0.01)
    jump = F.when(out, F.when(_uniform(F.col("seed"), F.col("i"), F.lit("s")) < 0.5, -1).otherwise(1) * (50 + 100 * _uniform(F.col("seed"), F.col("i"), F.lit("j")))).otherwise(0.0)
    flux = base - dip + flares + jump
    kind = F.when(out, "outlier").when(in_flare, "flare").when(dip > 0, "transit").otherwise("normal")
    return at.select("series_id", "time", flux.alias("flux"), "seed", "i", kind.alias("type")).select("series_id", "time", "flux", (F.sqrt(F.abs("flux")) * 0.1 + 1 + 2 * _uniform(F.col("seed"), F.col("i"), F.lit("e"))).alias("flux_err"), (F.col("type") != "normal").cast("int").alias("label"), "type", F.struct("i").alias("ord"))


def training_curves(spark: SparkSession, n_samples: int = 1000, contamination: float = 0.1, n_points: int = 1000, seed: int = 42) -> DataFrame:
    """n_samples curves, of which the first n_samples x contamination hold a transit, a flare or outliers in turn."""
    odd = int(n_samples * contamination)
    kinds = {f"sample_{k:06d}": (((("transit",), ("flare",), ("outlier",))[k % 3] if k < odd else ()), seed + k) for k in range(n_samples)}
    return curves(spark, kinds, n_points)
