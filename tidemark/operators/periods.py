"""Periodograms: Lomb-Scargle by added vectors of sums, box least squares by blocks of periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import series

#: Periods that one task searches; series whose sums a task holds before it hands them on.
BLOCK, HELD = 25, 1000


def grid(df: DataFrame, n_frequencies: int) -> DataFrame:
    """Per series: n, mean flux, least and greatest frequency, time span, median step, first time."""
    step = F.col("time") - F.lag("time").over(series().orderBy("time"))
    stats = df.withColumn("__dt", step).groupBy("series_id").agg(F.count("*").alias("n"), F.avg("flux").alias("mean"), F.min("time").alias("t0"), (F.max("time") - F.min("time")).alias("span"), F.median("__dt").alias("cadence"))
    low, high = 1 / F.col("span"), 1 / (2 * F.col("cadence"))
    return stats.withColumn("low", low).withColumn("step", (high - low) / (n_frequencies - 1))


def _sums(n_frequencies: int):
    """Points (series_id, y, time, low, step) to partial sums a series: y cos, y sin, cos 2, sin 2 of every frequency end to end, and y y at last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame({"series_id": list(held), "sums": list(held.values())})
            held.clear()
            return out

        k = np.arange(n_frequencies)
        for pdf in batches:
            for key, part in pdf.groupby("series_id", sort=False):
                w = part["low"].iloc[0] + k * part["step"].iloc[0]
                total = held.setdefault(key, np.zeros(4 * n_frequencies + 1))
                for at in range(0, len(part), 256):
                    y, t = np.nan_to_num(part["y"].to_numpy(dtype=float)[at : at + 256]), part["time"].to_numpy()[at : at + 256]
                    c, s = np.cos(np.outer(t, w)), np.sin(np.outer(t, w))
                    total += np.concatenate([y @ c, y @ s, (c * c - s * s).sum(0), 2 * (c * s).sum(0), [y @ y]])
            if len(held) > HELD:
                yield rows()
        if held:
            yield rows()

    return run


def lomb_scargle(df: DataFrame, n_frequencies: int = 1000) -> DataFrame:
    """series_id, k, frequency, power (normalised): frequencies, taken as angular, from 1 / span to 1 / (2 median step).

    Four sums a frequency give the power. Each task adds its points up to one vector a series, and the vectors are added after the
    shuffle: a long series is never one task's, and no point is copied. Series without a span or a step have no rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    ranges = grid(df, n_frequencies).filter("span > 0 and cadence > 0").select("series_id", "n", "mean", "low", "step")
    points = df.select("series_id", "time", "flux").join(ranges, "series_id").select("series_id", (F.col("flux") - F.col("mean")).alias("y"), "time", "low", "step")
    partial = points.mapInPandas(_sums(n_frequencies), f"series_id {dict(df.dtypes)['series_id']}, sums array<double>")
    added = partial.groupBy("series_id").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    each = added.join(ranges, "series_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_frequencies - 1))))
    at = lambda place: F.get("sums", F.col("k") + place * n_frequencies)
    total = each.select("series_id", "k", "n", (F.col("low") + F.col("k") * F.col("step")).alias("frequency"), at(0).alias("yc"), at(1).alias("ys"), at(2).alias("c2"), at(3).alias("s2"), F.get("sums", F.lit(4 * n_frequencies)).alias("yy"))
    turn = F.atan2("s2", "c2") / 2
    rotated = total.withColumn("a", F.col("yc") * F.cos(turn) + F.col("ys") * F.sin(turn)).withColumn("b", F.col("ys") * F.cos(turn) - F.col("yc") * F.sin(turn)).withColumn("r", F.sqrt(F.col("c2") * F.col("c2") + F.col("s2") * F.col("s2")))
    power = (F.try_divide(F.col("a") * F.col("a"), (F.col("n") + F.col("r")) / 2) + F.try_divide(F.col("b") * F.col("b"), (F.col("n") - F.col("r")) / 2)) / F.col("yy")
    return rotated.select("series_id", "k", "frequency", power.alias("power"))


def lomb_scargle_features(df: DataFrame, least: int = 50, n_frequencies: int = 1000) -> DataFrame:
    """ls_max_power, ls_dominant_period, ls_second_power, ls_power_ratio of each series; zeros under `least` points."""
    ids = df.groupBy("series_id").agg(F.count("*").alias("n"))
    top = lomb_scargle(df, n_frequencies).groupBy("series_id").agg(F.max(F.struct("power", "k", "frequency")).alias("best"), F.slice(F.sort_array(F.collect_list("power"), False), 1, 2).alias("two"))
    met = ids.join(top, "series_id", "left").select("series_id", (F.col("n") >= least).alias("long"), F.col("best.power").alias("p"), (1 / (F.col("best.frequency") + 1e-12)).alias("t"), F.get("two", F.lit(1)).alias("q"))
    known = lambda c: F.when(F.col("long"), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return met.select("series_id", known(F.col("p")).alias("ls_max_power"), known(F.col("t")).alias("ls_dominant_period"), known(F.col("q")).alias("ls_second_power"), known(F.col("q") / (F.col("p") + 1e-12)).alias("ls_power_ratio"))


def box_powers(t: np.ndarray, y: np.ndarray, periods: np.ndarray, durations: np.ndarray, oversample: int = 10) -> pd.DataFrame:
    """period, power, duration, transit_time: of each period the box with the greatest log likelihood (dips only)."""
    width = durations.min() / oversample
    y = y - y.mean()
    out = []
    for period in periods:
        n = int(np.ceil(period / width))
        bins = np.minimum(((t % period) / width).astype(int), n - 1)
        count, flux = np.bincount(bins, minlength=n).astype(float), np.bincount(bins, weights=y, minlength=n)
        wrap = int(round(durations.max() / width))
        cn, cf = (np.concatenate([[0.0], np.cumsum(np.concatenate([v, v[:wrap]]))]) for v in (count, flux))
        best = (0.0, durations[0], 0.0)
        for duration in durations:
            k = int(round(duration / width))
            inside, total = cn[k : k + n] - cn[:n], cf[k : k + n] - cf[:n]
            with np.errstate(all="ignore"):
                low, high = total / inside, (flux.sum() - total) / (len(t) - inside)
                power = np.where((inside > 0) & (inside < len(t)) & (high >= low), 0.5 * inside * (high - low) ** 2, -np.inf)
            at = int(power.argmax())
            if power[at] > best[0]:
                best = (float(power[at]), float(duration), float((at * width + duration / 2) % period))
        out.append((float(period), *best))
    return pd.DataFrame(out, columns=["period", "power", "duration", "transit_time"])


def box_least_squares(df: DataFrame, n_periods: int = 500, durations: tuple[float, float, int] = (0.05, 0.2, 5)) -> DataFrame:
    """series_id, period, power, duration, transit_time for periods from greatest(0.5, 10 median steps) to least(span / 2, 100).

    A series goes to one task for each BLOCK of its periods. Series without such a range have no rows.
    """
    ranged = grid(df, 2).withColumn("shortest", F.greatest(F.lit(0.5), F.col("cadence") * 10)).withColumn("longest", F.least(F.col("span") / 2, F.lit(100.0))).filter("longest > shortest")
    blocks = -(-n_periods // BLOCK)
    points = df.select("series_id", "time", "flux").join(ranged.select("series_id", "t0", "shortest", "longest"), "series_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = dict(df.dtypes)["series_id"]

    def searched(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        periods = np.linspace(pdf["shortest"].iloc[0], pdf["longest"].iloc[0], n_periods)[key[1] * BLOCK : (key[1] + 1) * BLOCK]
        t0 = pdf["t0"].iloc[0]
        found = box_powers(pdf["time"].to_numpy() - t0, pdf["flux"].to_numpy(), periods, np.linspace(*durations))
        return found.assign(series_id=key[0], transit_time=found["transit_time"] + t0)[["series_id", "period", "power", "duration", "transit_time"]]

    return points.groupBy("series_id", "block").applyInPandas(searched, f"series_id {kind}, period double, power double, duration double, transit_time double")


def box_features(df: DataFrame, least: int = 50) -> DataFrame:
    """bls_power, bls_period, bls_duration of each series; zeros under `least` points or without a range of periods."""
    ids = df.groupBy("series_id").agg(F.count("*").alias("n"))
    best = box_least_squares(df).groupBy("series_id").agg(F.max(F.struct("power", -F.col("period"), "period", "duration")).alias("b"))
    known = lambda c: F.when(F.col("n") >= least, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return ids.join(best, "series_id", "left").select("series_id", known(F.col("b.power")).alias("bls_power"), known(F.col("b.period")).alias("bls_period"), known(F.col("b.duration")).alias("bls_duration"))


def box_detector(df: DataFrame, n_periods: int = 1000, durations: tuple[float, float, int] = (0.05, 0.3, 10)) -> DataFrame:
    """df with is_anomaly: points inside the best box of their series (phase of the point less the box's mid-time); false where none was found."""
    best = box_least_squares(df, n_periods, durations).groupBy("series_id").agg(F.max(F.struct("power", -F.col("period"), "period", "duration", "transit_time")).alias("__b"))
    met = df.join(best, "series_id", "left")
    phase = F.pmod(F.col("time") - F.col("__b.transit_time"), F.col("__b.period")) / F.col("__b.period")
    half = F.col("__b.duration") / 2 / F.col("__b.period")
    return met.withColumn("is_anomaly", F.coalesce((phase < half) | (phase > 1 - half), F.lit(False))).drop("__b")
