"""Validating, deduplicating and trimming sequence sets.

Sequences are rows (dataset, pos, id, description, seq); pos orders the rows of a dataset. Deduplication picks the first row
of each key with an aggregate of one struct per key, combined in each task, never a window over a hot key.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
CLUSTAL_LIMIT = 20_000


def dataset_flags(seqs: DataFrame, alphabet: str = PROTEIN) -> DataFrame:
    """Per dataset: valid_alphabet, duplicate_ids, duplicate_seqs and clean (valid without duplicates)."""
    good = F.coalesce(F.upper("seq").rlike(f"^[{alphabet}]+$"), F.lit(False))
    # digests are shuffled, not sequences
    by_seq = seqs.groupBy("dataset", F.md5("seq").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("good"))
    by_id = seqs.groupBy("dataset", "id").agg(F.count(F.lit(1)).alias("n"))
    a = by_seq.groupBy("dataset").agg(F.bool_and("good").alias("valid_alphabet"), F.bool_or(F.col("n") > 1).alias("duplicate_seqs"))
    b = by_id.groupBy("dataset").agg(F.bool_or(F.col("n") > 1).alias("duplicate_ids"))
    out = a.join(b, "dataset")
    return out.withColumn("clean", F.col("valid_alphabet") & ~F.col("duplicate_ids") & ~F.col("duplicate_seqs"))


def first_repeats(seqs: DataFrame) -> DataFrame:
    """Per dataset that repeats a sequence: the id and place of the first row that does."""
    rows = seqs.select("dataset", "pos", "id", F.md5("seq").alias("digest"))
    second = rows.groupBy("dataset", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(second.select("dataset", "digest", "first"), ["dataset", "digest"]).filter(F.col("pos") > F.col("first"))
    return rows.groupBy("dataset").agg(F.min_by("id", "pos").alias("id"), F.min("pos").alias("pos"))


def keep_first(rows: DataFrame, key: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order, whole."""
    names = rows.columns
    best = F.min_by(F.struct(*names), F.struct(*order))
    keys = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(key)]
    return rows.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def dedup_sequences(seqs: DataFrame) -> DataFrame:
    """Equal sequences of a dataset: the first stays."""
    return keep_first(seqs, ["dataset", F.md5("seq")], ["pos"])


def gate(seqs: DataFrame) -> DataFrame:
    """Datasets that are clean stay as they are; others are deduplicated.

    A clean dataset repeats no sequence, so that deduplicating it leaves it as it is: one pass does both.
    """
    return dedup_sequences(seqs)


def refine(seqs: DataFrame, min_length: int, ignore_case: bool = False) -> DataFrame:
    """Sequences of min_length or more, without nulls and repeats."""
    seq = F.upper("seq") if ignore_case else F.col("seq")
    return keep_first(seqs.filter(F.length("seq") >= min_length), ["dataset", F.md5(seq)], ["pos"])


def trim_terminals(seqs: DataFrame, five: int = 13_000, three: int = 13_000, core: int = 100_000) -> DataFrame:
    """Longer sequences than both ends and a core lose their ends; their id says so."""
    long = F.length("seq") > five + three + core
    cut = F.substr("seq", F.lit(five + 1), F.length("seq") - F.lit(five + three))
    return seqs.withColumns({"seq": F.when(long, cut).otherwise(F.col("seq")), "id": F.when(long, F.concat("id", F.lit("_core"))).otherwise(F.col("id")), "trimmed": long})


def longest_route(seqs: DataFrame, limit: int = CLUSTAL_LIMIT) -> DataFrame:
    """Per dataset: the aligner that its longest sequence allows."""
    over = F.bool_or(F.length("seq") > limit)
    return seqs.groupBy("dataset").agg(F.when(over, "mafft").otherwise("clustalo").alias("aligner"))


#: Bits of a draw by which rows are counted before any are chosen.
DRAW_BITS = 16


def subsample(seqs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows per dataset by a seeded hash of the id; the same rows on each run.

    Draws are counted by their first bits, which tasks combine: so many rows for each dataset at most tell up to where the k smallest lie. Only rows up to there,
    k and a small share of the rest, are ranked; a large dataset is neither sorted nor gathered.
    """
    draw = F.md5(F.concat_ws("/", F.lit(seed), "id"))
    rows = seqs.withColumns({"_draw": draw, "_cell": F.conv(F.substring(draw, 1, DRAW_BITS // 4), 16, 10).cast("int")})
    counts = rows.groupBy(F.col("dataset").alias("_set"), "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_set").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last cell that still has rows among the k smallest
    ends = counts.withColumn("_before", before).filter(F.col("_before") < k).groupBy("_set").agg(F.max("_cell").alias("_end"))
    near = rows.join(ends, rows["dataset"].eqNullSafe(ends["_set"])).filter(F.col("_cell") <= F.col("_end"))
    order = Window.partitionBy("dataset").orderBy("_draw", "pos")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).select(*seqs.columns)


def chunks(rows: DataFrame, size: int = 50, order: str = "pos", by: str = "dataset", ranges: int = 64) -> DataFrame:
    """rows with chunk, from 1: every size rows of a dataset in order (a number).

    Rows are numbered within ranges of the order, whose counts say where each starts, so that a large dataset is not numbered in one task.
    """
    ends = rows.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)])).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))), lambda e: e < F.col(order))) if ends else F.lit(0)
    placed = rows.withColumn("_range", at)
    counts = placed.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), before.alias("_before"))
    placed = placed.join(starts, placed[by].eqNullSafe(starts["_by"]) & (placed["_range"] == starts["_r"]))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    return placed.withColumn("chunk", F.floor((place - 1) / size) + 1).select(*rows.columns, "chunk")


def without_ignored(grid: DataFrame, ignored: str | Iterable[str] | None, column: str = "method") -> DataFrame:
    """Methods that a list or a comma-separated string names are left out; empty names and none do nothing."""
    names = ignored.split(",") if isinstance(ignored, str) else list(ignored or ())
    names = [n.strip().lower() for n in names if n and n.strip().lower() not in ("", "none")]
    return grid.filter(~F.lower(column).isin(names)) if names else grid


#: Letters of nucleic acids, ambiguous ones included, and their complements; S, W and N are their own.
LETTERS, COMPLEMENTS = "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd"
_PART = r"\[[<>]?(\d+):[<>]?(\d+)\]\(([+-])\)"


def location_parts(location: Column) -> Column:
    """A location's stretches in the order of reading, as array<struct<start,end,strand>> from 0; null where a part stands in another record or the text is no location."""
    found = F.regexp_extract_all(location, F.lit(_PART), F.lit(0))
    field = lambda p, i: F.regexp_extract(p, _PART, i)
    parts = F.transform(found, lambda p: F.struct(field(p, 1).cast("int").alias("start"), field(p, 2).cast("int").alias("end"), F.when(field(p, 3) == "-", -1).otherwise(1).alias("strand")))
    return F.when((F.size(found) > 0) & ~location.rlike(r"[\w.]\["), parts)


def spliced(seq: Column, parts: Column) -> Column:
    """The letters of all parts of seq one after the other; those of the other strand are complements, read backwards."""
    cut = lambda p: F.substr(seq, p["start"] + 1, p["end"] - p["start"])
    read = F.transform(parts, lambda p: F.when(p["strand"] < 0, F.reverse(F.translate(cut(p), LETTERS, COMPLEMENTS))).otherwise(cut(p)))
    return F.when(seq.isNotNull(), F.array_join(read, ""))


def first_cds(records: DataFrame) -> DataFrame:
    """Records (with features) that have a CDS: what its location, simple or of several parts, takes from seq; others unchanged.

    A CDS that stands in another record in part, or whose location cannot be read, leaves no sequence: seq is null.
    """
    cds = F.get(F.filter("features", lambda f: f["type"] == "CDS"), F.lit(0))
    return records.withColumn("seq", F.when(cds.isNull(), F.col("seq")).otherwise(spliced(F.col("seq"), location_parts(cds["location"]))))
