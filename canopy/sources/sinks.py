"""Writing results: trees, metadata, itemsets and reports. Modes make repeated runs safe."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.trees import clade_nodes
from canopy.sources.named import write_named
from canopy.sources.newick import to_newick


def write_trees(nodes: DataFrame, path: str) -> None:
    """Newick text, one folder per tree; trees that are there stay as they are, and a run that fails leaves none of its own."""
    write_named(to_newick(nodes).select("tree", F.col("text").alias("value")), path, "tree", keep=True)


def write_metadata(subtrees: DataFrame, path: str) -> None:
    """Subtrees with their supports as JSON lines, by mining group."""
    subtrees.write.partitionBy("base").mode("overwrite").json(path)


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """A report's tables as JSON lines, a folder each."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any table fits CSV."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """A flat table with a header, a folder per group if by is given."""
    writer = flat(df).write.option("header", True).mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path)


def write_clades(nodes: DataFrame, path: str) -> None:
    """Each clade of more than one leaf as newick, a folder per clade (tree_clade); those that are there stay as they are."""
    write_trees(clade_nodes(nodes), path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """A copy of a run's settings, as filled in, beside its results."""
    spark.createDataFrame([(json.dumps(settings, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def accession_report(problems: DataFrame, shown: int = 10) -> DataFrame:
    """problem, at, value and in_head: lines of a report on problems (accession, problem): each kind's count, then its accessions in order.

    Lines up to shown of each kind are marked, as the head that a log shows. A kind's lines are numbered by ranges, not in one task.
    """
    counts = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select("problem", F.lit(0).cast("long").alias("at"), F.concat_ws(": ", "problem", F.col("n").cast("string")).alias("value"), F.lit(True).alias("in_head"))
    part = F.substring("accession", 1, 6)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("problem").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = problems.groupBy("problem", part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).select("problem", "_part", before.alias("_before"))
    rows = problems.select("problem", "accession", part.alias("_part")).join(starts, ["problem", "_part"])
    at = (F.col("_before") + F.row_number().over(Window.partitionBy("problem", "_part").orderBy("accession"))).cast("long")
    rows = rows.select("problem", at.alias("at"), F.col("accession").alias("value"))
    return head.union(rows.withColumn("in_head", F.col("at") <= shown))
