"""FASTA text, in and out. Records are split by the text reader itself, so that large files are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions.text import wrapped
from canopy.operators.cleaning import chunks
from canopy.sources.named import write_named


def read_fasta(spark: SparkSession, path: str, skip: str = r"\.(dnd|json)$") -> DataFrame:
    """dataset (the file's stem), pos, id (the header's first token), description and seq of every record under path."""
    lines = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.filter(~F.col("file").rlike(skip)).withColumn("_order", F.monotonically_increasing_id())
    text = F.regexp_replace("value", r"^>|\r", "")
    head = F.regexp_replace(F.substring_index(text, "\n", 1), r"^\s+|\s+$", "")
    rows = lines.select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("dataset"),
        "_order",
        F.regexp_extract(head, r"^(\S*)", 1).alias("id"),
        head.alias("description"),
        F.regexp_replace(F.substr(text, F.locate("\n", text) + F.lit(1)), r"\s", "").alias("seq"),
        F.locate("\n", text).alias("_line"),
    )
    rows = rows.filter("id <> ''").withColumn("seq", F.when(F.col("_line") > 0, F.col("seq")).otherwise(F.lit("")))
    return rows.select("dataset", F.col("_order").alias("pos"), "id", "description", "seq")


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """dataset (the file's stem), pos (the place among its first block's rows), id and seq of Clustal alignments, whose rows stand in blocks."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).withColumn("_order", F.monotonically_increasing_id())
    row = r"^(\S+)\s+([A-Za-z.*-]+)(?:\s+\d+)?\s*$"
    rows = lines.filter(F.col("value").rlike(row) & ~F.upper("value").startswith("CLUSTAL")).select(
        F.regexp_replace("file", r"\.[^.]*$", "").alias("dataset"), F.regexp_extract("value", row, 1).alias("id"), F.regexp_extract("value", row, 2).alias("part"), "_order"
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_order", "part"))), lambda x: x["part"]), "")
    return rows.groupBy("dataset", "id").agg(F.min("_order").alias("pos"), joined.alias("seq")).select("dataset", "pos", "id", "seq")


def fasta_text(seqs: DataFrame, width: int = 60) -> DataFrame:
    """value: one record's text per row."""
    return seqs.withColumn("value", F.concat(F.lit(">"), F.coalesce("description", "id"), F.lit("\n"), wrapped(F.col("seq"), width)))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """One folder per dataset, records in order."""
    rows = fasta_text(seqs, width).repartition("dataset").sortWithinPartitions("dataset", "pos")
    rows.select("dataset", "value").write.partitionBy("dataset").mode("overwrite").text(path)


def write_chunks(seqs: DataFrame, path: str, size: int = 50, width: int = 60) -> None:
    """At most size records per folder dataset=.../chunk=..., order kept, numbered from 1."""
    write_named(chunks(fasta_text(seqs, width), size), path, ("dataset", "chunk"), ("pos",), overwrite=True)
