"""A watch over growing text: documents whose size is odd for their source, file by file as they come.

Each source is a series for each of three measures (characters, words, lines); a document is an alert where its measure is over
`threshold` standard deviations from the series' mean. A file stream takes only files that are new since the last run (its checkpoint lies in
the output folder). Each batch writes two partitions, named by the batch:

- `state/batch=N`: rows, sum and sum of squares of every series, of all batches up to N;
- `alerts/batch=N/measure=M`: the batch's odd documents, judged by the state up to and with N.

A batch that is run again after a failure reads the state before it and overwrites its own partitions, so it is never counted twice. Null texts have
size 0; documents without a source are one series; a series of equal sizes has no alert. What a batch joins its rows with is one
row a series, read back from its written state, so Spark knows its size.

    python -m jobs.text_watch --documents PATH --out DIR [--config FILE]
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs.text_watch")

STATE = "source string, measure string, n long, total decimal(38,0), squares decimal(38,0), batch long"
ALERTS = "doc_id long, source string, value long, mean double, std double, z double, batch long, measure string"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source, measure, value: three rows a document."""
    text = F.coalesce("text", F.lit(""))
    sizes = {"chars": F.char_length(text), "words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), "lines": F.when(text == "", 0).otherwise(1 + F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))))}
    return docs.select("doc_id", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("long").alias("value")) for m, v in sizes.items()])).alias("x")).select("doc_id", "source", "x.*")


def _sums(rows: DataFrame, n, total, squares) -> DataFrame:
    return rows.groupBy("source", "measure").agg(F.sum(n).alias("n"), F.sum(total).cast("decimal(38,0)").alias("total"), F.sum(squares).cast("decimal(38,0)").alias("squares"))


def take(docs: DataFrame, batch: int, out: str, threshold: float) -> None:
    """One batch: the new state, then the alerts by it."""
    spark = docs.sparkSession
    value = F.col("value").cast("decimal(19,0)")
    state = _sums(measures(docs), F.lit(1), value, value * value)
    if batch > 0:
        earlier = spark.read.schema(STATE).parquet(f"{out}/state").filter(F.col("batch") < batch)
        last = earlier.agg(F.max("batch")).first()[0]
        if last is not None:
            state = _sums(state.unionByName(earlier.filter(F.col("batch") == last).drop("batch")), "n", "total", "squares")
    state.write.mode("overwrite").parquet(f"{out}/state/batch={batch}")

    known = spark.read.schema(STATE).parquet(f"{out}/state/batch={batch}").drop("batch")
    mean = F.col("total").cast("double") / F.col("n")
    series = known.select(F.col("source").alias("of"), F.col("measure").alias("by"), mean.alias("mean"), F.sqrt(F.greatest(F.col("squares").cast("double") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
    met = measures(docs).join(series, F.col("source").eqNullSafe(F.col("of")) & (F.col("measure") == F.col("by")))
    odd = met.withColumn("z", F.try_divide(F.col("value") - F.col("mean"), F.col("std"))).filter(F.abs("z") > threshold)
    odd.select("doc_id", "source", "value", "mean", "std", "z", "measure").write.mode("overwrite").partitionBy("measure").parquet(f"{out}/alerts/batch={batch}")
    n = spark.read.schema(ALERTS).parquet(f"{out}/alerts/batch={batch}").count()
    log.info("batch %d: %d documents known by now, %d alerts written to %s", batch, known.filter("measure = 'chars'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], n, f"{out}/alerts/batch={batch}")


def run(spark: SparkSession, documents: str, out: str, threshold: float = 3.0, files_a_batch: int | None = None) -> DataFrame:
    """Takes all files that are new, ends, and returns every alert so far as it is in the files."""
    path = documents.rstrip("/")
    # A pattern, so that a single file may stand for the table too.
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        stream = stream.option("maxFilesPerTrigger", files_a_batch)
    docs = stream.parquet(f"{path[:-1]}[{path[-1]}]").select(F.col("doc_id").cast("long"), "source", "text")
    log.info("reading what is new under %s", documents)
    query = docs.writeStream.foreachBatch(lambda rows, batch: take(rows, batch, out, threshold)).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read(spark, out)


def read(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ALERTS).parquet(f"{out}/alerts")


if __name__ == "__main__":
    from jobs.common import command_line

    command_line("text_watch", __doc__, ["documents", "out"], run)
