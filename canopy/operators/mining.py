"""Recurring items over transactions: supports, maximal sets, histograms.

In grid mode an item is in some maximal set at a threshold exactly if its own count reaches it, so supports need one distinct count per
item and no enumeration. Maximal sets grow from the frequent items alone, those in the same transactions as one, by shards: each item's
transactions with the items after it. Small shards are finished in a task each, large ones are rows that grow in rounds.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.steps import cut


def grid(float_parity: bool = False) -> list[float]:
    """Thresholds 0.1 to 1.0; with float_parity the sums that accumulate in binary."""
    return [0.1 + 0.1 * i for i in range(10)] if float_parity else [k / 10 for k in range(1, 11)]


def min_count(threshold: Column, rows: Column, exact: bool = True) -> Column:
    """Transactions that a threshold asks for, any share; exact ones are free of binary noise (to a millionth of a transaction)."""
    if exact:
        return F.ceil(F.round(threshold * rows, 6)).cast("long")
    return F.ceil(threshold * rows).cast("long")


def item_counts(rows: DataFrame, group: str, tree: str, item: str) -> DataFrame:
    """group, item, n (transactions with it) and rows (transactions of the group)."""
    once = rows.select(group, tree, item).distinct()
    counts = once.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.select(group, tree).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(sizes, group)


def grid_supports(counts: DataFrame, thresholds: Sequence[float] | None = None, exact: bool = True) -> DataFrame:
    """counts with supports, the thresholds that the item reaches, and support, its true share; items that reach one."""
    values = F.array(*map(F.lit, thresholds or grid(not exact)))
    reached = F.filter(values, lambda s: F.col("n") >= min_count(s, F.col("rows"), exact))
    out = counts.withColumns({"supports": reached, "support": F.col("n") / F.col("rows")})
    return out.filter(F.size("supports") > 0)


def occurrences(supports: DataFrame) -> DataFrame:
    """supports (rows, support) with occurrences, the whole transactions that a support stands for, and percent, to two digits."""
    return supports.withColumns({"occurrences": F.floor(F.round(F.col("rows") * F.col("support"), 6)).cast("long"), "percent": F.round(F.col("support") * 100, 2)})


def one_hot(rows: DataFrame, items: Sequence[str], tree: str = "tree", item: str = "item") -> DataFrame:
    """A row per transaction and a column (0 or 1) per item of a list; mining itself keeps the long form."""
    held = F.max(F.when(F.col(item).isNotNull(), 1)).alias("held")
    return rows.groupBy(tree).pivot(item, list(items)).agg(held).fillna(0, list(items))


def item_subtrees(subtrees: DataFrame, items: DataFrame) -> DataFrame:
    """item, tree, subtree, terminals, n_terminals and supports of every subtree that has one of some items."""
    kept = [c for c in ("tree", "subtree", "terminals", "n_terminals", "supports") if c in subtrees.columns]
    return subtrees.join(items.select("item").distinct(), "item").select("item", *kept)


def annotate(subtrees: DataFrame, supports: DataFrame, keys: Sequence[str] = ("base", "item")) -> DataFrame:
    """subtrees with the supports of their items; empty where an item reaches none."""
    side = supports.select(*keys, "supports")
    none = F.array().cast("array<double>")
    return subtrees.join(side, list(keys), "left").withColumn("supports", F.coalesce("supports", none))


def first_tree(subtrees: DataFrame) -> DataFrame:
    """Per item, the first tree that holds it."""
    return subtrees.groupBy("item").agg(F.min_by("tree", F.struct("tree", "pre")).alias("tree"))


#: Cells (transactions by items) of a conditional table that one task may finish.
TASK_CELLS = 200_000


def item_kinds(rows: DataFrame, threshold: float, group: str, tree: str, item: str) -> DataFrame:
    """group, n, items, rows, need and key (n and the first item) of the frequent items, those in the same transactions as one.

    Infrequent items are dropped first, however many there are. Equal transactions are told by their number and two 64-bit sums of hashes.
    """
    sizes = rows.select(group, tree).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("need", F.greatest(min_count(F.lit(threshold), F.col("rows")), F.lit(1)))
    marks = [F.bit_xor(F.xxhash64(tree, F.lit(i))).alias(f"_h{i}") for i in range(2)]
    counts = rows.select(group, tree, item).distinct().groupBy(group, item).agg(F.count(F.lit(1)).alias("n"), *marks).join(sizes, group).filter("n >= need")
    same = counts.groupBy(group, "n", "_h0", "_h1").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("rows").alias("rows"), F.first("need").alias("need"))
    return same.select(group, "n", "items", "rows", "need", F.struct("n", F.col("items")[0].alias("item")).alias("key"))


def _maximal(masks: list[int], need: int, first: int) -> set[int]:
    """The transactions (as bits) of each maximal set that items from first on lead to; an item's bits are the transactions that hold it."""
    found: set[int] = set()
    todo = [(functools.reduce(operator.or_, masks, 0), list(range(first, len(masks))))]
    while todo:
        head, tail = todo.pop()
        live = [i for i in tail if (masks[i] & head).bit_count() >= need]
        every = functools.reduce(operator.and_, (masks[i] for i in live), head)
        if every.bit_count() >= need:
            head, live = every, []
        live = [i for i in live if head & ~masks[i]]
        if not live and not any(head & ~m and (head & m).bit_count() >= need for m in masks):
            found.add(head)
        for j, i in enumerate(live):
            own = head & masks[i]
            # a set that an earlier item belongs to is met below that item
            if not any(not own & ~masks[f] and head & ~masks[f] for f in range(i)):
                todo.append((own, live[j + 1 :]))
    return found


def maximal_itemsets(rows: DataFrame, threshold: float, group: str, tree: str, item: str, task_cells: int = TASK_CELLS) -> DataFrame:
    """group, items, n and support of each maximal frequent set.

    A node stands for a closed set: the transactions that hold it, which meet their own items by an equi-join. Items in all of them belong to the set; if no other
    reaches the count asked for, the set is maximal. Otherwise each such item after the node's last one, in the order of their counts, makes a node of its own with the
    transactions that hold it, a shard of its parent; nodes whose set holds an earlier item are left out, as they stand below that item, and where enough transactions
    hold all items to come, one node stands for all. A node of task_cells or fewer is finished in one task, larger ones grow in saved rounds. Sets that are
    maximal at a low threshold may be exponentially many in the items; nothing is cut.
    """
    kinds = cut(item_kinds(rows, threshold, group, tree, item))
    base = cut(rows.select(group, tree, F.col(item).alias("_i")).distinct().join(kinds.select(group, F.col("key.item").alias("_i"), "key"), [group, "_i"]).select(group, tree, "key"))
    sizes = kinds.groupBy(group).agg(F.first("rows").alias("size"), F.first("need").alias("need"))
    nodes = cut(sizes.select(group, F.monotonically_increasing_id().alias("id"), "size", "need", F.lit(None).cast(base.schema["key"].dataType).alias("core"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("last")))
    rest = cut(base.select(group, tree).distinct().join(nodes.select(group, "id"), group).select("id", group, tree))
    found = []
    kind = base.schema["key"].dataType["item"].dataType.simpleString()
    while not nodes.isEmpty():
        met = rest.join(base, [group, tree])
        info = cut(met.groupBy("id", "key").agg(F.count(F.lit(1)).alias("c")).join(nodes, "id").filter("c >= need"))
        whole, later = F.col("c") == F.col("size"), F.col("core").isNull() | (F.col("key") > F.col("core"))
        state = cut(info.groupBy("id").agg(
            F.count_if(~whole).alias("open"), F.count_if(~whole & later & ~F.col("last")).alias("tail"), F.count_if(whole & (F.col("key") < F.col("core"))).alias("pre"), F.first("before").alias("before"),
            F.first("last").alias("last"), F.first("core").isNull().alias("root"), F.sum(F.when(~whole, F.col("c")).otherwise(0)).alias("cells"),
        ))
        closed = info.filter(whole).select("id", "key.item")
        done = state.filter("open = 0").select("id")
        found.append(cut(info.filter(whole).join(done, "id").groupBy("id").agg(F.first(group).alias(group), F.first("size").alias("n"), F.collect_list("key.item").alias("kinds")).drop("id")))
        grows = state.filter("tail > 0 and (root or pre = before)")
        small, large = grows.filter(F.col("cells") <= task_cells).select("id"), grows.filter(F.col("cells") > task_cells).select("id", "tail")
        cells = met.select("id", tree, "key").join(info.filter(~whole).select("id", "key", later.alias("later"), "need"), ["id", "key"]).join(small, "id")
        mined = cells.select("id", F.col(tree).alias("t"), F.col("key.n").alias("n"), F.col("key.item").alias("item"), "later", "need").groupBy("id").applyInPandas(_mined, f"id long, n long, kinds array<{kind}>")
        held = closed.groupBy("id").agg(F.collect_list("item").alias("_closed"))
        owner = nodes.select("id", group)
        found.append(cut(mined.join(held, "id", "left").join(owner, "id").select(group, "n", F.concat("kinds", F.coalesce("_closed", F.array().cast(f"array<{kind}>"))).alias("kinds"))))
        if large.isEmpty():
            break
        # closed items before each, so that a child can tell whether it holds one more
        ordered = info.join(large, "id").withColumn("ahead", F.coalesce(F.sum(whole.cast("long")).over(Window.partitionBy("id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        tails = ordered.filter(~whole & later)
        kids = cut(met.select("id", group, tree, "key").join(tails.select("id", "key", "tail", "need", "c", "ahead"), ["id", "key"]))
        full = kids.groupBy("id", group, tree).agg(F.count(F.lit(1)).alias("k"), F.first("tail").alias("tail"), F.first("need").alias("need")).filter("k = tail")
        enough = cut(full.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.first("need").alias("need"), F.first(group).alias(group)).filter("size >= need"))
        each = kids.join(enough.select("id"), "id", "left_anti")
        born = each.groupBy("id", "key").agg(F.first(group).alias(group), F.first("c").alias("size"), F.first("need").alias("need"), F.first("ahead").alias("before"))
        none = F.lit(None).cast(base.schema["key"].dataType)
        all_ = born.select(F.col("id").alias("_of"), "key", group, "size", "need", F.col("key").alias("core"), "before", F.lit(False).alias("last")).unionByName(
            enough.select(F.col("id").alias("_of"), none.alias("key"), group, "size", "need", none.alias("core"), F.lit(0).cast("long").alias("before"), F.lit(True).alias("last"))
        )
        all_ = cut(all_.withColumn("id", F.monotonically_increasing_id()))
        one = each.join(all_.filter("not last").select(F.col("_of").alias("id"), "key", F.col("id").alias("_new")), ["id", "key"]).select(F.col("_new").alias("id"), group, tree)
        other = full.join(all_.filter("last").select(F.col("_of").alias("id"), F.col("id").alias("_new")), "id").select(F.col("_new").alias("id"), group, tree)
        rest = cut(one.union(other))
        nodes = all_.drop("_of", "key")
    sets = functools.reduce(DataFrame.unionByName, found) if found else kinds.limit(0).select(group, "n", F.array("key.item").alias("kinds"))
    sets = sets.withColumn("kinds", F.array_sort("kinds")).distinct().withColumn("_set", F.struct(group, "kinds"))
    each = sets.select(group, "n", "_set", F.explode("kinds").alias("_i")).join(kinds.select(group, F.col("key.item").alias("_i"), "items", "rows"), [group, "_i"])
    out = each.groupBy("_set").agg(F.first(group).alias(group), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.first("n").alias("n"), F.first("rows").alias("rows"))
    return out.select(group, "items", "n", (F.col("n") / F.col("rows")).alias("support"))


def _mined(rows: pd.DataFrame) -> pd.DataFrame:
    """The maximal sets of one node's cells (id, t, n, item, later, need): their number of transactions, and their items but those that all have."""
    trees = {t: 1 << i for i, t in enumerate(rows["t"].unique())}
    own = [(later, n, item, sum(trees[t] for t in part)) for (later, n, item), part in rows.groupby(["later", "n", "item"])["t"]]
    # items before the node's last one come first: they tell what is met elsewhere
    masks = [x[-1] for x in own]
    found = _maximal(masks, int(rows["need"].iloc[0]), sum(not x[0] for x in own))
    out = [(rows["id"].iloc[0], f.bit_count(), [x[2] for x, m in zip(own, masks) if f & ~m == 0]) for f in found]
    return pd.DataFrame(out, columns=["id", "n", "kinds"])


def histogram(values: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (from 0), low, high, centre and n of equal widths over the range, the last closed; one value alone widens by half on each side."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo is not null")
    same = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    # one row of ends
    counts = values.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    low = F.col("lo") + F.col("bin") * width
    return all_bins.join(counts, "bin", "left").select("bin", low.alias("low"), (low + width).alias("high"), (low + width / 2).alias("centre"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exact_min_count(threshold: float, rows: int, float_parity: bool = False) -> int:
    """min_count for plain numbers."""
    return math.ceil(threshold * rows if float_parity else round(threshold * rows, 6))
