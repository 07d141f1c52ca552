"""Counters and timings of a run's stages, taken while the stages run.

A stage is a DataFrame that is written to the shared folder: its rows and any other figures are observed by the tasks that write them, so that nothing is
read again to count it, and seconds and bytes are those of the write. A stage that fails is on record, too.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from canopy.operators.steps import new_folder

REPORT = "run string, at int, stage string, done boolean, rows long, bytes long, seconds double, figures map<string,double>"


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


class Run:
    """The stages of one run, in the order in which they were saved."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.stages = spark, name, []

    def saved(self, df: DataFrame, stage: str, **figures: Column) -> DataFrame:
        """df, written and read again; figures are aggregates (numbers) over its rows, such as ``longest=F.max("n")``."""
        seen, path = Observation(), new_folder(self.spark)
        own = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(f"figure_{n}") for n, c in figures.items()])
        start = time.perf_counter()
        row = [self.name, len(self.stages), stage, False, None, None, None, {}]
        self.stages.append(row)
        try:
            own.write.parquet(path)
        finally:
            row[6] = time.perf_counter() - start
        got = seen.get
        row[3:6] = True, got["rows"], _bytes(self.spark, path)
        row[7] = {n: got[f"figure_{n}"] for n in figures if got.get(f"figure_{n}") is not None}
        return self.spark.read.schema(df.schema).parquet(path)

    def report(self) -> DataFrame:
        """run, at, stage, done, rows, bytes, seconds and figures of each stage."""
        return self.spark.createDataFrame([tuple(s) for s in self.stages], REPORT)


def totals(report: DataFrame, per: str | None = None) -> DataFrame:
    """run, n_stages, seconds, bytes and failed of each run; with per, the seconds for each row of the stage of that name (a tree, say)."""
    out = [F.count(F.lit(1)).alias("n_stages"), F.sum("seconds").alias("seconds"), F.sum("bytes").alias("bytes"), F.count_if(~F.col("done")).alias("failed")]
    if per is not None:
        of = F.max(F.when(F.col("stage") == per, F.col("rows")))
        out.append((F.sum("seconds") / F.nullif(of, F.lit(0))).alias("seconds_each"))
    return report.groupBy("run").agg(*out)
