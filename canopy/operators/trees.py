"""Trees as node tables, and their clades.

A node is a row (tree, node_id, parent_id, child_ord, name, branch_length, is_terminal, pre, post, depth). A clade's leaves
are a slice of its tree's leaves in pre-order, and its nodes a slice of the tree's nodes, so that subtree queries are joins by number,
not recursion.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.text import base_name, hash16, item_hash, item_key, without_version
from canopy.operators.steps import cut, sorted_in

NODE = "tree string, node_id int, parent_id int, child_ord int, name string, branch_length double, is_terminal boolean, pre int, post int, depth int"


def label_internals(nodes: DataFrame) -> DataFrame:
    """Unnamed internal nodes get Inner1, Inner2, ... in post-order; names that exist are not looked at."""
    nameless = ~F.col("is_terminal") & (F.coalesce(F.nullif("name", F.lit("")), F.lit("None")) == "None")
    number = F.sum(F.when(nameless, 1).otherwise(0)).over(Window.partitionBy("tree").orderBy("post"))
    return nodes.withColumn("name", F.when(nameless, F.concat(F.lit("Inner"), number.cast("string"))).otherwise(F.col("name")))


def _placed(nodes: DataFrame) -> DataFrame:
    """nodes with _rank (from 1, by pre), _size (of the node's subtree), _leaf (leaves before it, by pre) and n_terminals (leaves of its subtree).

    What a node has below it is finished before it and begins after it, so running counts by pre and by post give both numbers.
    """
    by_pre, by_post = Window.partitionBy("tree").orderBy("pre"), Window.partitionBy("tree").orderBy("post")
    leaf = F.col("is_terminal").cast("int")
    out = nodes.withColumns({"_rank": F.row_number().over(by_pre), "_leaf": F.sum(leaf).over(by_pre) - leaf})
    out = out.withColumns({"_done": F.row_number().over(by_post), "_leaves_done": F.sum(leaf).over(by_post)})
    # _done counts the node, all below it and all that are left of it; ranks up to its own less one count its ancestors, too
    return out.withColumns({"_size": F.col("_done") - F.col("_rank") + 1 + F.col("depth"), "n_terminals": (F.col("_leaves_done") - F.col("_leaf")).cast("int")}).drop("_done", "_leaves_done")


def clade_sizes(nodes: DataFrame) -> DataFrame:
    """tree, node_id, name, pre and n_terminals of each clade of more than one leaf, without listing its leaves."""
    return _placed(nodes).filter("not is_terminal and n_terminals > 1").select("tree", "node_id", "name", "pre", "n_terminals")


def clades(nodes: DataFrame) -> DataFrame:
    """Per clade of more than one leaf: tree, node_id, subtree, pre, terminals (pre-order), n_terminals.

    In pre-order the leaves of a clade are a slice of its tree's leaves, so that clades meet their own leaves only, by number.
    """
    placed = _placed(nodes)
    tops = placed.filter("not is_terminal and n_terminals > 1").select("tree", "node_id", F.col("name").alias("_name"), "pre", "n_terminals", F.explode(F.sequence(F.col("_leaf"), F.col("_leaf") + F.col("n_terminals") - 1)).alias("_at"))
    leaves = placed.filter("is_terminal").select("tree", F.col("_leaf").alias("_at"), "name")
    listed = F.sort_array(F.collect_list(F.struct("_at", "name")))
    out = tops.join(sorted_in(leaves), ["tree", "_at"]).groupBy("tree", "node_id").agg(*[F.first(c).alias(c) for c in ("_name", "pre", "n_terminals")], listed.alias("_l"))
    return out.select("tree", "node_id", F.concat_ws("_", "tree", "_name").alias("subtree"), "pre", F.transform("_l", lambda x: x["name"]).alias("terminals"), "n_terminals")


def clade_nodes(nodes: DataFrame) -> DataFrame:
    """Node rows of each clade of more than one leaf as a tree of its own, named tree_clade."""
    placed = _placed(label_internals(nodes))
    tops = placed.filter("not is_terminal and n_terminals > 1").select(
        "tree", F.concat_ws("_", "tree", "name").alias("_subtree"), F.col("node_id").alias("_top"), F.col("pre").alias("_pre"), F.col("depth").alias("_depth"),
        F.col("post").alias("_post"), F.col("_size").alias("_n"), F.explode(F.sequence(F.col("_rank"), F.col("_rank") + F.col("_size") - 1)).alias("_rank"),
    )
    own = tops.join(placed.drop("n_terminals", "_leaf", "_size"), ["tree", "_rank"])
    first = F.col("node_id") == F.col("_top")
    return own.select(
        F.col("_subtree").alias("tree"), "node_id", F.when(~first, F.col("parent_id")).alias("parent_id"), F.when(first, 0).otherwise(F.col("child_ord")).alias("child_ord"), "name",
        "branch_length", "is_terminal", (F.col("pre") - F.col("_pre")).alias("pre"), (F.col("post") - F.col("_post") + F.col("_n") - 1).alias("post"), (F.col("depth") - F.col("_depth")).alias("depth"),
    )


def subtrees(nodes: DataFrame, parity: bool = False) -> DataFrame:
    """clades with terminal_hashes and item.

    The item is the md5 of the taxon names in order; with parity the 16-bit hash of the leaves' hashes as they stand.
    """
    out = clades(label_internals(nodes)).withColumn("terminal_hashes", F.transform("terminals", hash16))
    item = item_hash(F.col("terminal_hashes")).cast("string") if parity else item_key(F.col("terminals"))
    return out.withColumns({"item": item, "ids": F.transform("terminals", without_version), "base": base_name(F.col("tree"))})


def transactions(rows: DataFrame, tree: str = "tree", item: str = "item") -> DataFrame:
    """The item set of each tree."""
    return rows.groupBy(tree).agg(F.array_sort(F.collect_set(item)).alias("items"))


def largest_subtree(rows: DataFrame, by_tree: bool = True) -> DataFrame:
    """The clade with most leaves of each tree, or of all; the first of equals (by tree and pre)."""
    first = F.min_by(F.struct(*rows.columns), F.struct(-F.col("n_terminals"), F.col("tree"), F.col("pre")))
    return (rows.groupBy("tree") if by_tree else rows.groupBy()).agg(first.alias("_r")).select("_r.*")


def counters(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves and clades of more than one leaf, per tree."""
    own = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_terminal").alias("n_terminals"))
    return own.join(clade_sizes(nodes).groupBy("tree").agg(F.count(F.lit(1)).alias("n_subtrees")), "tree", "left").fillna(0, ["n_subtrees"])


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, descendant and distance (the least) over edges (parent, child), to any depth; a cycle raises.

    Each round joins the longest paths to all paths and so doubles the distance that is reached; it is saved, so that plans do not grow.
    """
    paths = cut(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance")).filter("ancestor is not null and descendant is not null").distinct())
    new, reach = paths, 1
    while True:
        found = new.agg(F.count(F.lit(1)), F.bool_or(F.col("ancestor") == F.col("descendant"))).first()
        if found[1]:
            raise ValueError("the edges hold a cycle")
        if not found[0]:
            return paths
        a, b = new.filter(F.col("distance") == reach).alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.descendant") == F.col("b.ancestor")).groupBy(F.col("a.ancestor"), F.col("b.descendant")).agg(F.min(F.col("a.distance") + F.col("b.distance")).alias("distance"))
        new = cut(longer.join(paths, ["ancestor", "descendant"], "left_anti"))
        paths, reach = paths.unionByName(new), 2 * reach


#: Pairs of a dataset that one task may take in.
TASK_PAIRS = 200_000


def spanning_edges(pairs: DataFrame) -> DataFrame:
    """The edges (dataset, a, b, height) of each dataset's least spanning tree (or forest), of pairs (dataset, a, b, height) with a < b; equal heights go by a and b.

    Each round every part's least edge to another part joins both, so that the parts halve at least; then edges between the same two parts are
    one, the least. Rounds are saved; parts are found by following the joins with doubled steps.
    """
    edge = F.struct("height", "a", "b")
    left = cut(pairs.groupBy("dataset", F.col("a").alias("x"), F.col("b").alias("y")).agg(F.min(edge).alias("e")))
    found = pairs.limit(0).select("dataset", "a", "b", "height")
    while not left.isEmpty():
        both = left.union(left.select("dataset", "y", "x", "e"))
        best = cut(both.groupBy("dataset", "x").agg(F.min_by("y", "e").alias("y"), F.min("e").alias("e")))
        found = found.union(cut(best.select("dataset", "e.*").distinct().select("dataset", "a", "b", "height")))
        # of two parts that choose each other, the smaller one is the root of what hangs at them
        back = best.select("dataset", F.col("x").alias("y"), F.col("y").alias("_back"))
        to = cut(best.join(back, ["dataset", "y"]).select("dataset", "x", F.when((F.col("_back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("to")))
        while True:
            on = to.select("dataset", F.col("x").alias("to"), F.col("to").alias("_on"))
            farther = cut(to.join(on, ["dataset", "to"]).select("dataset", "x", F.col("_on").alias("to"), (F.col("to") != F.col("_on")).alias("moved")))
            to = farther.select("dataset", "x", "to")
            if farther.filter("moved").isEmpty():
                break
        ends = left.join(to.withColumnRenamed("to", "_x"), ["dataset", "x"]).join(to.select("dataset", F.col("x").alias("y"), F.col("to").alias("_y")), ["dataset", "y"]).filter("_x <> _y")
        left = cut(ends.groupBy("dataset", F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).agg(F.min("e").alias("e")))
    return found


def single_linkage(pairs: DataFrame, value: str = "distance", task_pairs: int = TASK_PAIRS) -> DataFrame:
    """dataset, step (from 1), a, b, height and size: the merges of a dendrogram by single linkage of pairs (dataset, a, b, value).

    a and b are the smallest members of the two clusters, a before b; equal heights go by the pair that joins them. Of a dataset of more than
    task_pairs pairs only the edges of its spanning tree, one less than its members, meet in a task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        size: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for x, y, height in rows.sort_values(["height", "a", "b"])[["a", "b", "height"]].itertuples(index=False):
            a, b = sorted((find(x), find(y)))
            if a != b:
                root[b], size[a] = a, size.get(a, 1) + size.get(b, 1)
                out.append((rows["dataset"].iloc[0], len(out) + 1, a, b, float(height), size[a]))
        return pd.DataFrame(out, columns=["dataset", "step", "a", "b", "height", "size"])

    ordered = pairs.select("dataset", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(value).cast("double").alias("height")).filter("a <> b")
    many = cut(ordered.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_pairs).select("dataset"))
    small = ordered.join(many, "dataset", "left_anti") if not many.isEmpty() else ordered
    large = spanning_edges(ordered.join(many, "dataset")) if not many.isEmpty() else None
    edges = small if large is None else small.unionByName(large)
    return edges.groupBy("dataset").applyInPandas(run, "dataset string, step int, a string, b string, height double, size int")
