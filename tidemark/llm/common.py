"""What the operators of this package share: words, durable tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands between words once A-Z are lower case.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text: array<string>; of null, an empty array."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once a row: the optimizer would else inline it into lambdas, once per element."""
    return F.transform(F.array(value), then)[0]


def own_columns(df: DataFrame, *but: str) -> Column:
    """struct `row` of the columns that are not named in but, as c<place>: so no name of df can clash with another."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns) if c not in but], F.lit(True).alias("there")).alias("row")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process (tests) is a temporary folder used.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def release(df: DataFrame) -> None:
    """Removes the files of a stored table now: only after all that is read from it has itself been stored.

    The driver's garbage is collected too, upon which Spark's cleaner removes the shuffle files of the jobs that are done.
    """
    _forget(df.sparkSession, df.stored_at)
    if (jvm := df.sparkSession.sparkContext._jvm) is not None:
        jvm.java.lang.System.gc()


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if rows <= limit else df
