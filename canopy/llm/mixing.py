"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Every source has a target: its weight's share of all words, no more than LIMIT times its own; what is beyond is shared out again by weight until no
source is above. A mix is a sequence of slots, each for a block of equal size. The sources' targets, in blocks, lie one after the other on a line of 2^b cells, and slot j
is mapped to the cell whose number is j with its b bits reversed (a van der Corput point), so that every stretch of slots holds each source in
proportion. Reversing bits is its own inverse: a source's cells name its slots, and no join by ranges is needed. Slots are ranked per source;
documents, in an order drawn by hashing, are cut into blocks; and the slot of rank r takes the source's block r, beginning anew
after the last word. The last block of a source is cut where its target is reached, so that a source's words differ from its target by rounding alone.

Neither ranking nor laying out needs a source in one task: rows are sorted into ranges, and ranges are numbered and summed from their totals.

Defined results: a null text has size 0; documents of size 0 take no place in the mix and are taken 0 times; sources go by code point, null last, as a source of its own; repeated
rows are documents of their own; documents of equal id are told apart by size and then by text, so that reruns agree; an
empty table gives an empty result; columns besides id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.scratch import Steps, saved

WEIGHTS = (1, 2, 3)
LIMIT = 3
#: Words of a block.
BLOCK = 256
SEED = 0
WORD = r"[^\x20\x09-\x0D]+"
#: Cells that one row of a source becomes.
CHUNK = 4096


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, str | None], steps: Steps) -> DataFrame:
    """rows with, for each name in sums, the sum of its column (None: the number) of all rows before each in a total order.

    Rows are sorted into ranges; a window sums the rows of one range alone, and the totals of ranges, a row for each partition of a shuffle at most, what lies before each.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    value = {name: F.lit(1).cast("long") if column is None else F.col(column) for name, column in sums.items()}
    dealt = steps.saved(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_{name}") for name, v in value.items()])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in value])
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({name: F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in value.items()})
    # a row per range
    placed = placed.join(F.broadcast(totals), "_range")
    return placed.withColumns({name: F.col(name) + F.col(f"_{name}") for name in value}).drop("_range", *[f"_{name}" for name in value])


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """row, doc_id, source, size and draw (where the document stands in its source's order) of every document."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(doc_id).cast("string")))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), draw.alias("draw"), F.xxhash64(text).alias("tie"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, steps: Steps | None = None) -> DataFrame:
    """source, source_size, weight, place, begin (words of the sources before) and target of sources (source, source_size); the excess of sources above limit times their size goes to the others, by weight."""
    steps = steps or Steps(sources.sparkSession)
    placed = running(sources, [F.col("source").isNull(), "source"], {"place": None, "begin": "source_size"}, steps)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = steps.saved(placed.select("source", "source_size", "place", "begin", weight.cast("long").alias("weight"), (limit * F.col("source_size")).alias("most")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    rest, weighed, capped = total, None, 0
    most = F.col("most").cast("double")
    while True:
        # the sources that the share so far leaves below their limit; each turn caps one or more of them
        below = F.lit(True) if weighed is None else most * F.lit(float(weighed)) > F.col("weight") * F.lit(float(rest))
        state = rows.agg(F.sum(F.when(below, F.col("weight"))), F.sum(F.when(~below, F.col("most"))), F.count_if(~below)).first()
        if weighed is not None and state[2] == capped:
            break
        weighed, rest, capped = state[0] or 0, total - (state[1] or 0), state[2]
        if not weighed:
            break
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(weighed or 1))
    above = most * F.lit(float(weighed)) <= F.col("weight") * F.lit(float(rest)) if weighed else F.lit(True)
    return rows.select("source", "source_size", "weight", "place", "begin", F.when(above, most).otherwise(share).alias("target"))


def reversed_bits(cell: Column, bits: int) -> Column:
    """The number whose bits are those of cell from the last to the first."""
    return F.conv(F.reverse(F.lpad(F.bin(cell), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, block: int, steps: Steps) -> DataFrame:
    """slot, place (of the source) and rank (of the slot among its source's, from 0) of the slots that sources (place, wanted) take; slots are those of a line of 2^b cells, some of them empty."""
    blocks = F.ceil(F.col("wanted") / F.lit(block)).cast("long")
    laid = steps.saved(running(sources.withColumn("blocks", blocks), ["place"], {"first": "blocks"}, steps), "laid")
    cells = laid.agg(F.sum("blocks")).first()[0] or 0
    bits = max(0, (cells - 1).bit_length())
    chunks = laid.filter("blocks > 0").select("place", "first", "blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / CHUNK))).alias("chunk"))
    # chunks of a source spread before they become cells
    chunks = chunks.repartition("place", "chunk")
    inside = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("blocks")) - 1)
    cell = chunks.select("place", "first", F.explode(inside).alias("at")).select("place", reversed_bits(F.col("first") + F.col("at"), bits).alias("slot"))
    ranked = running(cell, ["place", "slot"], {"rank": None}, steps)
    return ranked.join(laid.select("place", "first"), "place").select("slot", "place", (F.col("rank") - F.col("first")).alias("rank"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents): what the mix takes, and what it takes it from.

    pieces: slot, place (the source's number), row, start (a word of the document) and length; in the order of slots, and of at within a slot, they are the mix.
    documents: row, doc_id, source, size, source_size and target.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    rows = steps.saved(sized(docs, doc_id, text, source, seed), "documents")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = steps.saved(targets(sources, weights, limit, steps).withColumn("wanted", F.floor(F.col("target") + 0.5).cast("long")), "targets")
    total = goal.agg(F.sum("wanted")).first()[0] or 0
    # no more than 2^31 slots, however large the corpus
    block = max(block, -(-total // (1 << 31)))
    known = goal.select(F.col("source").alias("_source"), "place", "source_size", "begin", "target", "wanted")
    own = rows.join(known, rows["source"].eqNullSafe(known["_source"])).drop("_source")
    documents = saved(own.select("row", "doc_id", "source", "size", "source_size", "target"), "documents")
    laid = own.filter("size > 0").select("row", "place", "size", "draw", "doc_id", "tie", "source_size", "begin", "wanted")
    laid = running(laid, ["place", "draw", "doc_id", "size", "tie", "row"], {"before": "size"}, steps).withColumn("offset", F.col("before") - F.col("begin"))
    # the source's words again and again, as often as its target asks for
    turns = laid.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))).withColumn("lo", F.col("turn") * F.col("source_size") + F.col("offset"))
    turns = turns.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("wanted"))).filter("lo < hi")
    cut = turns.select("row", "place", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("rank"))
    begin, end = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    parts = cut.select("row", "place", "rank", (begin - F.col("lo")).alias("start"), (end - begin).alias("length"), (begin - F.col("rank") * block).alias("at"))
    pieces = schedule(goal.select("place", "wanted"), block, steps).join(parts, ["place", "rank"]).select("slot", "at", "place", "row", "start", "length")
    pieces = saved(pieces, "pieces")
    steps.clear()
    return pieces, documents


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words that a mix takes of the document, repeats counted) of every document."""
    pieces, documents = mix(docs, **how)
    sums = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return documents.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
