"""Substring dedup by sliding sentence spans.

A text is cut into sentences after ``.``, ``!`` or ``?`` followed by white space, and at line breaks. From every sentence, the run of RUN
consecutive sentences is hashed (two independent 64-bit hashes), lengthened by the sentences that follow until it has MIN_WORDS words. Where the
text ends before that, its last sentences with MIN_WORDS words are a run, so that every sentence of a text of MIN_WORDS words stands in a hashed run. Equal
runs meet in one global join. The first occurrence, by doc_id, row and place, stays; sentences covered by any other occurrence go.

Only DataFrame functions. Occurrences are counted and the first chosen before anything is joined (one row per task and
run), and the join back is one whose large partitions Spark splits, so a passage that a third of all documents hold does not gather in
one task. Marks are collected per document only.

Defined results: a null or empty text has no sentences; of repeated rows all but the first lose what they repeat; an
empty table gives an empty result; a null doc_id comes after all others. Columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.scratch import saved

RUN = 2
MIN_WORDS = 10
_BLANK = r"[\x20\x09-\x0D]"


def sentences(text: Column) -> Column:
    """The sentences of a text, without white space around them and without empty ones."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), rf"([.!?]){_BLANK}+", "$1\n")
    return F.filter(F.transform(F.split(broken, "\n"), lambda s: F.regexp_replace(s, rf"^{_BLANK}+|{_BLANK}+$", "")), lambda s: s != "")


def _reaching(words: Column, at: Column, run: int, least: int) -> Column:
    """How many sentences from at, run or more, have least words together; 0 where the text ends before."""
    first = F.lit(0)
    for i in range(run):
        first = first + F.get(words, at + F.lit(i))
    more = F.aggregate(
        F.slice(words, at + F.lit(run + 1), F.lit(least)),  # a sentence has a word or more
        F.struct(first.alias("n"), F.lit(run).alias("len")),
        lambda a, w: F.when(a["n"] >= least, a).otherwise(F.struct((a["n"] + w).alias("n"), (a["len"] + F.lit(1)).alias("len"))),
    )
    return F.when(first >= least, F.lit(run)).otherwise(F.when(more["n"] >= least, more["len"]).otherwise(F.lit(0)))


def _ending(words: Column, run: int, least: int) -> Column:
    """How many of the last sentences, run or more, have least words together; 0 where all have fewer."""
    most = F.greatest(F.least(F.size(words), F.lit(run + least)), F.lit(1))  # Spark may look at texts without sentences before it leaves them out
    return _reaching(F.reverse(F.slice(words, -most, most)), F.lit(0), run, least)


def marked(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, sentences and kept (the places of the sentences that stay) of every row of docs (doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), sentences(F.col("text")).alias("s"))
    # saved with the numbers of words, which are looked up for every place
    rows = saved(rows.withColumn("n", F.transform("s", lambda x: F.size(F.split(x, rf"{_BLANK}+")))), "sentences")
    counted = rows.filter(F.size("s") >= run)
    # each run as its first place and its number of sentences
    runs = F.transform(F.sequence(F.lit(0), F.size("s") - F.lit(run)), lambda i: F.struct(i.alias("pos"), _reaching(F.col("n"), i, run, min_words).alias("len")))
    last = _ending(F.col("n"), run, min_words)
    tail = F.size("s") - last
    # the last sentences are a run of their own unless the one from their first is the same
    alone = F.when((last > 0) & (_reaching(F.col("n"), tail, run, min_words) != last), last).otherwise(F.lit(0))
    runs = F.concat(runs, F.array(F.struct(tail.alias("pos"), alone.alias("len"))))
    # two hashes of each sentence, and of a run those of its sentences' hashes
    hashed = counted.select("row", "doc_id", F.filter(runs, lambda r: r["len"] > 0).alias("r"), F.transform("s", lambda x: F.xxhash64(x)).alias("a"), F.transform("s", lambda x: F.xxhash64(F.lit(1), x)).alias("b"))
    at = hashed.select("row", "doc_id", "a", "b", F.explode("r").alias("r")).select("row", "doc_id", "a", "b", F.col("r.pos").alias("pos"), F.col("r.len").alias("len"))
    own = lambda c: F.slice(c, F.col("pos") + 1, F.col("len"))
    spans = at.select("row", "doc_id", "pos", "len", F.xxhash64(own("a")).alias("h1"), F.xxhash64(F.lit(1), own("b")).alias("h2"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "pos")
    firsts = spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first")).filter("times > 1")
    firsts = saved(firsts.select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos")), "firsts")
    again = spans.join(firsts, ["h1", "h2"]).filter("row <> first_row or pos <> first_pos")
    marks = again.groupBy("row").agg(F.collect_set(F.struct("pos", "len")).alias("marks"))
    covered = F.flatten(F.transform("marks", lambda m: F.sequence(m["pos"], m["pos"] + m["len"] - F.lit(1))))
    places = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - F.lit(1))).otherwise(F.array().cast("array<int>"))
    kept = F.when(F.col("marks").isNull(), places).otherwise(F.array_except(places, covered))
    return rows.join(marks, "row", "left").select("doc_id", F.col("s").alias("sentences"), kept.alias("kept"))


def remove_repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed and text (the sentences that stay, a line each)."""
    text = F.array_join(F.transform("kept", lambda i: F.get("sentences", i)), "\n")
    return marked(docs, run, min_words).select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"), (F.size("sentences") - F.size("kept")).cast("long").alias("n_removed"), text.alias("text")
    )
