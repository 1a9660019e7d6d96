"""Curves that come in segments (quarters, sectors): the first of them, and one curve out of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import finite


def first_segments(df: DataFrame, most: int, segment_col: str = "segment") -> DataFrame:
    """The rows of each series' first `most` segments, in the order of segment_col (null first). Segments are ranked in a list of their own, not row by row."""
    listed = df.select(F.col("series_id").alias("__series"), F.col(segment_col).alias("__segment")).distinct()
    ranked = listed.withColumn("__rank", F.dense_rank().over(Window.partitionBy("__series").orderBy(F.col("__segment").asc_nulls_first()))).filter(F.col("__rank") <= most)
    return df.join(ranked, F.col("series_id").eqNullSafe(F.col("__series")) & F.col(segment_col).eqNullSafe(F.col("__segment")), "left_semi")


def _over_median(df: DataFrame, keys: list[str]) -> DataFrame:
    """flux (and flux_err) over the median flux of their keys; null where that is 0."""
    middle = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.median("flux").alias("__median"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    met = df.join(middle, same)
    for c in ("flux", "flux_err"):
        if c in df.columns:
            met = met.withColumn(c, F.try_divide(F.col(c), F.col("__median")))
    return met.select(*df.columns)


def stitch(df: DataFrame, segment_col: str = "segment") -> DataFrame:
    """Series out of their segments: each segment's flux over its own median, then the series' over what median is left, so that steps between segments go.

    Points without a finite time or flux are left out, as are segments whose median is 0. `ord` becomes (time, segment, former ord):
    where segments overlap in time, their points stand side by side.
    """
    there = df.withColumn("time", finite(F.col("time"))).withColumn("flux", finite(F.col("flux"))).dropna(subset=["time", "flux"])
    level = _over_median(_over_median(there, ["series_id", segment_col]).dropna(subset=["flux"]), ["series_id"]).dropna(subset=["flux"])
    former = [F.col("ord")] if "ord" in df.columns else []
    return level.withColumn("ord", F.struct(F.col("time").alias("t"), F.col(segment_col).alias("segment"), *former))
