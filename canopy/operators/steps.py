"""Cutting lineage in operators that take several rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share; only a local session without ``spark.checkpoint.dir`` gets a folder of its own."""
    context = spark.sparkContext
    found = spark.conf.get(KEY, None) or context.getConf().get(KEY) or getattr(context, "_canopy_steps", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = context._canopy_steps = tempfile.mkdtemp(prefix="canopy-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for one table; clear removes it."""
    path = f"{shared(spark)}/canopy-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._canopy_folders = [*getattr(context, "_canopy_folders", ()), path]
    return path


def clear(spark: SparkSession) -> int:
    """Removes all that this application's operators have saved, and tells how many folders; results that are still to be read have to be written before."""
    context = spark.sparkContext
    folders, context._canopy_folders = getattr(context, "_canopy_folders", []), []
    for path in folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(folders)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that its plan starts anew there and a lost executor costs its own tasks only."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_in(rows: DataFrame) -> DataFrame:
    """rows that a join takes in by sorting, never by a broadcast: the size of saved tables is that of their packed files, of which the driver would unpack any number of rows."""
    return rows.hint("merge")


#: Rows of a part that ``spread`` makes, on average.
PART_ROWS = 500_000


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows, count in all, by keys in parts whose number grows with them, so that what a task sorts and counts does not; two for each core at least."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-count // PART_ROWS)), *keys)


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with name, their place (from 1) by order among those of an equal key, whose order has no ties. A key's rows are ranked by ranges, so that a key of many spreads."""
    parts = cut(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_key", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # no more rows of a key than there are ranges
    own = parts.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    met = own.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_row")).alias(name))
