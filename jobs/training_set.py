"""Labelled training windows of every target's curve, by mission.

Reads curves (lineitem) and their targets (supplier, nation, region); cleans, clips and normalises each curve, labels points in transit by the
target's ephemeris, and writes

- `windows`: one row a full window: its features, its label (any point in transit) and target, partitioned by mission and label_type;
- `metadata`: one row a target, partitioned by mission.

With a mission only that mission's targets are read and only its partitions are replaced; without one the whole set is. A
run with equal input leaves equal files' contents, however often it is repeated: partitions are overwritten, never appended to.

    python -m jobs.training_set --tables DIR --out DIR [--config FILE]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import evaluate as E
from tidemark.operators import clean as C
from tidemark.operators import detect as D
from tidemark.operators import windows as W
from tidemark.sources import bindings as B

log = logging.getLogger("jobs.training_set")


def run(spark: SparkSession, tables: str, out: str, window: int = 50, sigma: float = 5.0, least_points: int = 10, mission: str | None = None) -> DataFrame:
    """Builds the set and returns the windows as they are in the files."""
    targets = B.catalog(spark, tables)
    curves = B.lc_supplier(spark, tables)
    if mission is not None:
        targets = targets.filter(F.col("mission") == mission)
        curves = curves.join(targets.select(F.col("target_id").alias("series_id")), "series_id", "left_semi")
    points = C.normalize(C.sigma_clip(C.clean(C.spread(curves), least_points), sigma))
    # Both outputs are of the same points: they are made once.
    labelled = C.index_points(D.phase_labels(points.drop("label"), targets).withColumn("label", F.col("in_transit"))).select("series_id", "idx", "n", "flux", "label").persist()
    known = targets.select(F.col("target_id").alias("series_id"), "mission", F.when(F.col("period").isNotNull(), "transit").otherwise("normal").alias("label_type"))
    windows = W.statistics(labelled, window).join(known, "series_id")
    metadata = E.dataset_metadata(labelled, targets)

    how = "static" if mission is None else "dynamic"
    for name, rows, by in (("windows", windows, ["mission", "label_type"]), ("metadata", metadata, ["mission"])):
        # One file a partition and task would be many small ones: rows of a mission meet first, spread by target.
        spread = rows.repartition("mission", F.pmod(F.xxhash64("series_id" if name == "windows" else "target_id"), F.lit(16)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(*by).parquet(f"{out}/{name}")
    labelled.unpersist()
    # Sets without a row have no file to tell their columns.
    written = spark.read.schema(windows.select(*[c for c in windows.columns if c not in ("mission", "label_type")], "mission", "label_type").schema).parquet(f"{out}/windows")
    told = spark.read.schema(metadata.schema).parquet(f"{out}/metadata").agg(F.count("*"), F.coalesce(F.sum("n_points"), F.lit(0))).first()
    log.info("read curves and targets of %s (%s) under %s; the set has %d targets with %d points kept", mission or "all missions", how, tables, *told)
    log.info("wrote %s: %s", out, {(r.mission, r.label_type): r.n for r in written.groupBy("mission", "label_type").agg(F.count("*").alias("n")).collect()})
    return written


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/windows")


if __name__ == "__main__":
    from jobs.common import command_line

    command_line("training_set", __doc__, ["tables", "out"], run)
