"""Tables that cut lineage, in the folder that all executors share.

Iterative operators write each round as Parquet and read it again, so that a lost executor costs only the tasks it ran.
The folder is the session's ``spark.checkpoint.dir``; only where that is unset (a local session, as in tests) is one set here.
Tables that a returned DataFrame reads stay until the caller removes the folder; ``Steps`` removes those that nothing reads any more.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local session without one gets a temporary folder of its own."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_canopy_dir", None)
        if not found:
            found = spark.sparkContext._canopy_dir = tempfile.mkdtemp(prefix="canopy-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/canopy-{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written as Parquet in the shared folder and read again (plan and lineage start anew there)."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path with the file system that it belongs to."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Steps:
    """Tables of one operator; clear removes them once the last result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path.rpartition("/")[0])
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes one small driver-made file into the shared folder."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    return path


def values(spark: SparkSession, rows: list, fields: str) -> DataFrame:
    """A small table of literals, folded into the plan; fields: a struct's fields as DDL, in the order of the rows."""
    names = [f.name for f in spark.range(0).select(F.from_json(F.lit("{}"), fields)).schema[0].dataType]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))
