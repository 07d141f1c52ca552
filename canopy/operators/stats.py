"""Statistics of sequence sets and the choices that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequence_stats(seqs: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Per dataset: n, avg_length, max_length and est_memory_gb (n^2 * avg * 4 bytes)."""
    rows = seqs.filter(F.length("seq") > 0) if skip_empty else seqs
    out = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("seq")).alias("avg_length"), F.max(F.length("seq")).alias("max_length")
    )
    return out.withColumn("est_memory_gb", F.col("n") * F.col("n") * F.coalesce("avg_length", F.lit(0.0)) * 4 / 1024**3)


def align_strategy(stats: DataFrame, max_sequences: int = 500, max_memory_gb: float = 4.0) -> DataFrame:
    """stats with mafft_strategy, clustalo_subsample and clustalo_one_iteration."""
    mafft = F.when((F.col("n") < 100) & (F.col("avg_length") < 1000), "localpair").when(F.col("n") < 10_000, "auto").otherwise("parttree")
    return stats.withColumns(
        {
            "mafft_strategy": mafft,
            "clustalo_subsample": (F.col("n") > max_sequences) | (F.col("est_memory_gb") > max_memory_gb),
            "clustalo_one_iteration": F.col("n") > 5000,
        }
    )


def dominant(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column, ties to the smaller."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(1)
