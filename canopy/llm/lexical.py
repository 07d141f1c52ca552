"""Ranked lexical search by a threshold-seeded join.

The index has a row per document with its length and the terms that some item asks for; of each term it stores the number of documents, the
largest impact and the kth largest impact. A document's impact for a term is what the score adds for one occurrence of the term in an item.

An item's kth score is bounded from below twice: k documents reach the kth impact of each of its terms, and then the documents that its
rarest terms lead to are scored exactly, of which the kth counts. Terms of an item stand in the order of their upper bounds (occurrences times
largest impact). Once the bounds of all terms from one on sum up to less than the item's kth score, a document that holds none of the terms before
cannot be among the best, so that only the terms before, the rare ones, generate candidates; the longest posting lists are never joined. Terms
are left out from where their bounds sum up to less than SHARE of the kth score, which leaves few candidates: those whose sum over the terms
joined plus the bound of the rest stays below the kth score go, and the others are scored exactly. No candidate is lost, ties
included: what is pruned scores strictly less than k other documents.

Rows of a document stay together until its terms meet the items, so that sums per item and document are combined in the task that read it.
Items are the small side: their terms are known to all tasks where they take ITEM_BYTES at most, and are joined by shuffling beyond that.

Defined results: a null or empty text has no term, is no document of the counts, and as an item finds nothing; repeated rows are documents, or items, of their own;
equal scores go by ascending doc_id, a null one last; an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.scratch import Steps, saved

K = 20
#: Memory of the items' terms, at most, for them to be sent to all tasks.
ITEM_BYTES = 1 << 25
#: Documents that seed an item's threshold: its rarest terms up to so many times k of them, and so many times k of the best are scored.
SEED_DOCS, SEED_SCORED = 64, 4
#: The share of the kth score that the bounds of the terms left out may sum up to: the less, the more postings meet and the fewer candidates are scored exactly.
SHARE = 0.25
#: Documents of a batch that leaves a task.
BATCH = 512

#: All ASCII characters but letters and digits end a term; only A-Z are lower-cased.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _counted(wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, id, n, terms, tfs) of rows (row, id, text) with a term; wanted: a broadcast set of the terms to list, or None for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                kept, ns, ends, terms, tfs = [], [], [0], [], []
                for i, text in enumerate(batch.column(2)):
                    words = terms_of(text.as_py())
                    if not words:
                        continue
                    counts = Counter(words)
                    found = counts.keys() if wanted is None else counts.keys() & wanted.value
                    kept.append(i)
                    ns.append(len(words))
                    terms += found
                    tfs += [counts[t] for t in found]
                    ends.append(len(terms))
                head = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(ns, pa.int64()), *lists], names=["row", "id", "n", "terms", "tfs"])

    return run


_COUNTED = "row long, id long, n long, terms array<string>, tfs array<long>"


def counted(rows: DataFrame, key: str, text: str, wanted=None) -> DataFrame:
    """row, id, n (terms with repeats), terms and tfs of each row with a term."""
    own = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_counted(wanted), _COUNTED)


def _listed(rows: DataFrame, *more: str | Column) -> DataFrame:
    """A row per term of counted rows."""
    return rows.select(*more, F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select("*", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf")).drop("_t")


def base_impact(tf: Column, n: Column, documents: int, terms: int) -> Column:
    """What a term's weight is multiplied by: (10^9 tf) div (1000 tf + 12 m), with m = 100 - 25 + (25 n N) div L."""
    whole = lambda a, b: F.call_function("div", a, b)
    m = F.lit(75) + whole(F.lit(25 * documents) * n, F.lit(terms))
    return whole(F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(12) * m)


def term_statistics(postings: DataFrame, documents: int, k: int) -> DataFrame:
    """term, df, weight, top and kth: the largest and the kth largest impact, 0 where fewer documents hold the term; of postings (term, b).

    Impacts are whole numbers of a million at most, so that counts by term and impact, which tasks combine, bound what a term's window sees.
    """
    counts = postings.groupBy("term", "b").agg(F.count(F.lit(1)).alias("c"))
    reached = F.sum("c").over(Window.partitionBy("term").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("reached", reached)
    out = counts.groupBy("term").agg(F.sum("c").alias("df"), F.max("b").alias("_top"), F.max(F.when(F.col("reached") >= k, F.col("b"))).alias("_kth"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * documents + 2)) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    out = out.withColumn("weight", weight)
    return out.select("term", "df", "weight", (F.col("weight") * F.col("_top")).alias("top"), (F.col("weight") * F.coalesce("_kth", F.lit(0))).alias("kth"))


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", scored: list | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents with a score above 0 of each item.

    scored, if given, gets the number of pairs of an item and a document that the seeds and then the candidates score exactly.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    asked = steps.saved(_listed(counted(items, item_id, text), F.col("row").alias("item"), F.col("id").alias("item_id")).withColumnRenamed("tf", "q"), "items")
    size = asked.agg(F.sum(F.octet_length("term") + F.lit(128))).first()[0] or 0
    small, wanted = size <= ITEM_BYTES, None
    near = F.broadcast if small else (lambda df: df)
    if small:
        wanted = spark.sparkContext.broadcast({r["term"].encode() for r in asked.select("term").distinct().toLocalIterator()})
    index = steps.saved(counted(docs, doc_id, text, wanted), "index")
    documents, terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    impact = base_impact(F.col("tf"), F.col("n"), documents, terms or 1)
    postings = _listed(index, "row", "n").select("row", "term", impact.alias("b"))
    if not small:
        postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    statistics = steps.saved(term_statistics(postings, documents, k), "terms")

    held = asked.join(statistics, "term").filter("weight > 0 and top > 0").withColumn("bound", F.col("q") * F.col("top"))
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "term")
    rest = F.sum("bound").over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = F.max(F.col("q") * F.col("kth")).over(Window.partitionBy("item"))
    held = steps.saved(held.select("item", "item_id", "term", (F.col("q") * F.col("weight")).alias("weight"), rest.alias("rest"), before.alias("before"), least.alias("least")), "held")

    def partial(own: DataFrame) -> DataFrame:
        """item, row and the sum over some of the items' terms."""
        met = postings.join(near(own.select("item", "term", "weight")), "term")
        return met.groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("b")).alias("part"))

    def exact(pairs: DataFrame, name: str) -> DataFrame:
        """item, row, doc_id and score of pairs of an item and a document."""
        pairs = steps.saved(pairs.select("item", "row"), name)
        if scored is not None:
            scored.append(pairs.count())
        rows = _listed(index.join(pairs, "row"), "item", "row", F.col("id").alias("doc_id"), "n").withColumn("b", impact)
        met = rows.join(near(held.select("item", "term", "weight")), ["item", "term"])
        return met.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("b")).alias("score"))

    def best(rows: DataFrame, by: Column, n: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= n)

    seeds = best(partial(held.filter(F.col("before") < SEED_DOCS * k)), [F.col("part").desc(), F.col("row")], SEED_SCORED * k)
    reached = best(exact(seeds, "seeds"), [F.col("score").desc(), F.col("row")], k).filter(F.col("rank") == k)
    floors = held.groupBy("item").agg(F.max("least").alias("least")).join(reached.select("item", "score"), "item", "left")
    floors = steps.saved(floors.select("item", F.greatest("least", F.coalesce("score", F.lit(0))).alias("floor")), "floors")

    judged = held.join(floors, "item")
    least = SHARE * F.col("floor")
    open_ = judged.filter(F.col("rest") >= least)
    beyond = judged.groupBy("item").agg(F.first("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("rest") < least, F.col("rest"))), F.lit(0)).alias("beyond"))
    candidates = partial(open_).join(near(beyond), "item").filter((F.col("part") + F.col("beyond") >= F.col("floor")) & (F.col("part") > 0))
    found = best(exact(candidates, "candidates").filter("score > 0"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], k)
    names = asked.select("item", "item_id").distinct()
    out = saved(found.join(near(names), "item").select("item_id", "rank", "doc_id", "score"), "found")
    steps.clear()
    return out
