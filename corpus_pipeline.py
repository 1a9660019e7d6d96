"""Documents to packed training sequences: STAGES in order, each over all that its predecessor kept.

Defined results, as each operator's module states them: the quality stage judges a null text as an empty one; null and empty texts that stay are
copies of each other, of which near dedup keeps one row, and so are repeated rows; documents without an id pass line dedup unchanged; very long texts are
read whole; ties are as in the modules. A table without rows gives none. All stages but the last return the columns of documents,
whatever they are called. The stages' files stay in a folder of their own, pipeline-<id>, under spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.stage(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_text=True)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_deduplication, near_deduplication, benchmark_decontamination, best_fit_packing)]
#: The stages' methods (a trained model, content-defined chunks, random arrivals) have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
