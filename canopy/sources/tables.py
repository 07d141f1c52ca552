"""Accession lists, mined metadata, indicator tables and run settings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_accession_csv(spark: SparkSession, path: str) -> DataFrame:
    """accession of a CSV with a column Accession; nulls are dropped."""
    rows = spark.read.csv(path, header=True)
    if "Accession" not in rows.columns:
        raise ValueError(f"{path} has no column Accession")
    return rows.select(F.trim(F.col("Accession").cast("string")).alias("accession")).dropna()


def read_accession_list(spark: SparkSession, path: str) -> DataFrame:
    """accession of a text with one per line; blank lines and lines from # are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("accession"))
    return rows.filter((F.col("accession") != "") & ~F.startswith("accession", F.lit("#")))


def read_mined_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Rows of JSON files that hold a list each, or with lines (as write_metadata makes them) an object on each line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def search_catalog(catalog: DataFrame, terms: Sequence[str]) -> DataFrame:
    """place, term and the catalog's columns (title, path, ...) of the entries whose title holds a term, by the order of the terms and then of titles."""
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("term")) for i, t in enumerate(terms)])
    rows = catalog.select(F.explode(listed).alias("_t"), *catalog.columns).select("_t.place", "_t.term", *catalog.columns)
    title = F.replace(F.lower("title"), F.lit(" "), F.lit("_"))
    return rows.filter(F.contains(title, F.lower("term"))).orderBy("place", "title", "path")


def load_from_catalog(spark: SparkSession, catalog: DataFrame, terms: Sequence[str], tried: int = 20) -> DataFrame | None:
    """The first table with rows among the catalog's entries for some terms, the best term first; tried bounds the entries that are opened."""
    return first_available(spark, [r["path"] for r in search_catalog(catalog, terms).select("path").limit(tried).collect()])


def first_available(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """The first table of a list of candidates that exists and has rows."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
            if not df.isEmpty():
                return df
    return None


def settings(text: str, **overrides) -> dict:
    """Run settings from JSON text: # in any string becomes project_name; overrides that are not None win."""
    raw = json.loads(text) | {k: v for k, v in overrides.items() if v is not None}
    project = str(raw.get("project_name", ""))

    def filled(value):
        if isinstance(value, str):
            return value.replace("#", project)
        if isinstance(value, list):
            return [filled(v) for v in value]
        if isinstance(value, dict):
            return {k: filled(v) for k, v in value.items()}
        return value

    out = {k: v if k == "project_name" else filled(v) for k, v in raw.items()}
    low, high = out.get("initial_min_length"), out.get("refined_min_length")
    if low is not None and high is not None and low > high:
        raise ValueError("initial_min_length is above refined_min_length")
    return out
