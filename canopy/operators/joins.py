"""Comparing, verifying and merging sets of ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from canopy.functions.text import without_version
from canopy.operators.steps import cut


def compare_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """key and status (both, only_first, only_second) of every id of two sets."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_first").otherwise("only_second")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def status_counts(compared: DataFrame) -> DataFrame:
    """Rows by status, and in all."""
    rows = compared.rollup("status").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def verify_accessions(expected: DataFrame, found: DataFrame, ignore_version: bool = False) -> DataFrame:
    """accession and problem (missing or unexpected)."""
    key: Column = without_version(F.col("accession")) if ignore_version else F.col("accession")
    a, b = expected.select(key.alias("accession")).distinct(), found.select(key.alias("accession")).distinct()
    missing = a.join(b, "accession", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(b.join(a, "accession", "left_anti").withColumn("problem", F.lit("unexpected")))


def with_outgroup(dataset: DataFrame, outgroup: DataFrame) -> DataFrame:
    """All rows of both."""
    return dataset.unionByName(outgroup, allowMissingColumns=True)


def unseen(wanted: DataFrame, cache: DataFrame, key: str = "accession") -> DataFrame:
    """What a cache lacks and has to be fetched."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def lookup_records(terminals: DataFrame, records: DataFrame) -> DataFrame:
    """terminals (accession) with the first record (by ord) of that id or with that accession among its own; null without one."""
    keys = F.array_distinct(F.concat(F.array("id"), F.coalesce("accessions", F.array().cast("array<string>"))))
    side = records.select(F.explode(keys).alias("accession"), "ord", F.struct(*records.columns).alias("record"))
    first = side.groupBy("accession").agg(F.min_by("record", "ord").alias("record"))
    return terminals.join(first, "accession", "left")


def edits_allowed(n: Column, threshold: float, score: str = "edits") -> Column:
    """The edits within which a similarity of threshold leaves a text of n letters and any shorter one; of aligned letters, a letter less on each side is an edit."""
    lost = F.floor(F.round(n * (1.0 - threshold), 9)).cast("int")
    return 2 * lost if score == "alignment" else lost


def _pieces(n: Column, most: Column) -> Column:
    """The least length of most + 1 pieces of n letters."""
    return F.floor(n / (most + 1)).cast("int")


@F.pandas_udf(IntegerType())
def aligned_letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """The score of a global alignment that counts equal letters and no costs: the longest common subsequence, by the bits of whole numbers."""

    def score(x: str, y: str) -> int:
        places: dict[str, int] = {}
        for i, letter in enumerate(x):
            places[letter] = places.get(letter, 0) | 1 << i
        full = free = (1 << len(x)) - 1
        for letter in y:
            met = free & places.get(letter, 0)
            free = (free + met | free - met) & full
        return len(x) - free.bit_count()

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="int32")


def near_candidates(texts: DataFrame, threshold: float, score: str = "edits") -> DataFrame:
    """a and b (a the shorter): all pairs of texts (id, dataset, seq, n) of a dataset that may reach the threshold, each once.

    The longer text is cut into one piece more than the edits allowed, of which some piece then stands in the shorter one, with no
    more edits before it than pieces and as few after it, so that its place is shifted by no more. Each text's pieces meet the substrings of their
    length, as many as a text has letters, however many edits are allowed. Only pairs that share a piece where it may stand are left; those grow with the results, and
    with what the letters share by chance where pieces are short: a low threshold on a small alphabet leaves most pairs.
    """
    texts = texts.withColumn("most", edits_allowed(F.col("n"), threshold, score)).withColumn("p", _pieces(F.col("n"), F.col("most")))
    at = F.floor(F.col("i") * F.col("n") / (F.col("most") + 1)).cast("int")
    placed = texts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most")))).withColumn("at", at)
    index = placed.select(F.col("dataset").alias("_set"), F.col("p").alias("_p"), F.xxhash64(F.substr("seq", F.col("at") + 1, F.col("p"))).alias("_key"), F.col("id").alias("b"), F.col("n").alias("n_b"), "most", "i", "at")
    # lengths of pieces of all texts that are long enough for a partner
    longest = F.greatest(F.floor(F.round(F.col("n") / threshold, 6)).cast("int"), "n")
    lengths = F.array_distinct(F.transform(F.sequence("n", longest), lambda m: _pieces(m, edits_allowed(m, threshold, score))))
    asked = texts.withColumn("_p", F.explode(F.filter(lengths, lambda p: p <= F.col("n"))))
    asked = asked.join(texts.select("dataset", F.col("p").alias("_p")).distinct(), ["dataset", "_p"], "left_semi")
    asked = asked.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("_p"))))
    probes = asked.select(F.col("dataset").alias("_set"), "_p", F.xxhash64(F.substr("seq", F.col("q") + 1, F.col("_p"))).alias("_key"), F.col("id").alias("a"), F.col("n").alias("n_a"), "q")
    shift, gap = F.col("q") - F.col("at"), F.col("n_b") - F.col("n_a")
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    fits = ordered & (gap <= F.col("most")) & (F.abs(shift) <= F.col("i")) & (F.abs(shift + gap) <= F.col("most") - F.col("i"))
    return probes.join(index, ["_set", "_p", "_key"]).filter(fits).select("a", "b").distinct()


#: Rows of a text that meet those of another (or of their own) at once, on average; Spark holds all pairs that two lots make before it passes them on.
LOT_ROWS = 128


def near_similar(seqs: DataFrame, threshold: float, min_length: int = 1, score: str = "edits", digits: int | None = None) -> DataFrame:
    """Pairs of a dataset's sequences, the earlier first, whose similarity (rounded to digits, if given) reaches the threshold (above 0).

    The similarity is 1 less the edits by the longer's length, or with score "alignment" the letters that a global alignment pairs by that length.
    Equal sequences are one until the end. Null sequences and those shorter than min_length take no part. The rows of a text are dealt to lots, and
    two lots meet as lists, so that the pairs of a text of many rows, which all are results, spread and are made in one pass without a shuffle.
    """
    base = seqs.filter((F.length("seq") >= max(1, min_length)) & F.col("dataset").isNotNull()).select("dataset", "pos", "id", "seq")
    texts = cut(base.groupBy("dataset", "seq").agg(F.ceil(F.count(F.lit(1)) / LOT_ROWS).cast("int").alias("lots"), (F.count(F.lit(1)) > 1).alias("more")).withColumns({"id": F.monotonically_increasing_id(), "n": F.length("seq")}))
    met = near_candidates(texts.select("dataset", "seq", "id", "n"), threshold, score)
    a, b = (texts.select(F.col("id").alias(x), "dataset" if x == "a" else F.lit(None).alias("_"), *[F.col(c).alias(f"{c}_{x}") for c in ("seq", "n", "lots")]).drop("_") for x in "ab")
    both = met.join(a, "a").join(b, "b")
    # minus one where the edits are more than allowed
    edits = F.call_function("levenshtein", F.col("seq_a"), F.col("seq_b"), edits_allowed(F.col("n_b"), threshold, score))
    if score == "alignment":
        # a letter that an alignment leaves unpaired is an edit: pairs of more edits than allowed need no alignment
        similarity, both = aligned_letters("seq_a", "seq_b") / F.col("n_b"), both.filter(edits >= 0)
    else:
        similarity = F.when(edits >= 0, F.lit(1.0) - edits / F.col("n_b"))
    alike = both.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    lots = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    alike = alike.select("dataset", "a", "b", "similarity", "lots_b", lots(F.col("lots_a")).alias("i")).withColumn("j", lots(F.col("lots_b"))).drop("lots_b")
    own = texts.filter("more").select("dataset", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), "lots", lots(F.col("lots")).alias("i")).withColumn("j", lots(F.col("lots"))).filter("i <= j").drop("lots")
    pairs = alike.unionByName(own)
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    # rows of one place are of one lot
    rows = base.join(texts.select("dataset", "seq", F.col("id").alias("text"), "lots"), ["dataset", "seq"]).withColumn("lot", F.pmod(F.xxhash64("pos"), F.col("lots")).cast("int"))
    listed = cut(rows.groupBy("text", "lot").agg(F.collect_list(F.struct("pos", "id")).alias("rows")))
    left, right = (listed.toDF(t, i, f"rows_{t}") for t, i in ("ai", "bj"))
    left, right = (x.hint("shuffle_hash") for x in (left, right))  # lists are many bytes, and small as a packed file
    dealt = pairs.join(left, ["a", "i"]).join(right, ["b", "j"]).repartition(16 * seqs.sparkSession.sparkContext.defaultParallelism, "a", "i", "b", "j")
    each = dealt.select("dataset", "similarity", ((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("once"), F.explode("rows_a").alias("x"), "rows_b")
    each = each.select("dataset", "similarity", "once", F.col("x.pos").alias("p"), F.col("x.id").alias("u"), F.explode("rows_b").alias("y"))
    first = F.col("p") < F.col("y.pos")
    each = each.filter(first | (~F.col("once") & (F.col("p") > F.col("y.pos"))))
    return each.select("dataset", F.when(first, F.col("u")).otherwise(F.col("y.id")).alias("id_a"), F.when(first, F.col("y.id")).otherwise(F.col("u")).alias("id_b"), "similarity")
