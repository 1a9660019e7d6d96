"""The test tables as series: (series_id, time, flux, label, order keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lc_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier; `ord` is a total order within a series."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.col("l_suppkey").alias("series_id"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)") / 86400e6).alias("time"),
        F.col("l_extendedprice").alias("flux"),
        ((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.09)).cast("int").alias("label"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ord"),
    )


def lc_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.col("user_id").alias("series_id"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 86400e6).alias("time"),
        F.col("value").alias("flux"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("event_type").alias("type"),
        F.struct("ts").alias("ord"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with their ephemerides; every fifth is no host and has none."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    joined = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    host = F.col("s_suppkey") % 5 != 0
    return joined.select(
        F.col("s_suppkey").alias("target_id"), F.col("r_name").alias("mission"), F.col("s_acctbal").alias("magnitude"), F.col("n_name").alias("hostname"),
        F.when(host, (700 + 10 * (F.col("s_suppkey") % 40)).cast("double")).alias("period"),
        F.when(host, (9100 + 50 * (F.col("s_suppkey") % 7)).cast("double")).alias("epoch"),
        F.when(host, F.lit(480.0)).alias("duration_hours"),
    )


def lc_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's daily totals as one series, in whole units so that no order of adding matters."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)") / 86400e6).alias("time")
    return rows.groupBy(day).agg(F.sum(F.round(F.col("l_extendedprice")).cast("long")).cast("double").alias("flux")).select(F.lit(1).alias("series_id"), "time", "flux", F.struct("time").alias("ord"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as model rows: id, features (array<double>), truth (label 0 is the anomaly)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), (F.col("label") == 0).cast("int").alias("truth"))
