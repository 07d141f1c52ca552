"""Distances between trees: Robinson-Foulds over clades, quartets, and tables of pairs.

Trees of one dataset are compared. Pairs meet through what they share: |A - B| + |B - A| = |A| + |B| - 2 |A and B|, and the shared part is an
equi-join on clades. Of what more than half of a dataset's trees hold (the root's clade at least), the trees that lack it meet instead: all others share it.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.text import item_key
from canopy.operators.steps import cut
from canopy.operators.trees import _placed, clades

#: Parts that the pairs of a dataset's trees are dealt to.
SPREAD = 16


def clade_sets(nodes: DataFrame, positional: bool = False) -> DataFrame:
    """dataset-free (tree, clade) rows: a clade is its sorted taxa, or with positional the places of its leaves in the tree's own order."""
    own = clades(nodes)
    if not positional:
        return own.select("tree", item_key(F.col("terminals")).alias("clade")).distinct()
    roots = nodes.filter("is_terminal").groupBy("tree").agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", "name"))), lambda x: x["name"]).alias("order"))
    places = F.array_sort(F.transform("terminals", lambda t: F.array_position(F.col("order"), t)))
    return own.join(roots, "tree").select("tree", F.array_join(places.cast("array<string>"), ",").alias("clade")).distinct()


def _tree_pairs(sizes: DataFrame) -> DataFrame:
    """_set, tree_a < tree_b, size_a and size_b of all pairs of a dataset's trees (_set, _tree, size); they are the rows of a result."""
    part = F.pmod(F.xxhash64("_tree"), F.lit(SPREAD)).cast("int")
    left = sizes.select("_set", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part"), F.col("_tree").alias("tree_a"), F.col("size").alias("size_a"))
    right = sizes.select("_set", part.alias("_part"), F.col("_tree").alias("tree_b"), F.col("size").alias("size_b"))
    return left.join(right, ["_set", "_part"]).filter("tree_a < tree_b")


def symmetric_difference(sets: DataFrame, tree: str = "tree", element: str = "clade", name: str = "rf", datasets: DataFrame | None = None) -> DataFrame:
    """tree_a < tree_b of one dataset and the size of the symmetric difference of their sets, for every pair of trees.

    datasets says which dataset each tree is of (tree, dataset); without it, all trees are of one.
    """
    sets = sets.select(F.col(tree).alias("_tree"), F.col(element).alias("_e"))
    sets = sets.join(datasets.select(F.col("tree").alias("_tree"), F.col("dataset").alias("_set")), "_tree") if datasets is not None else sets.withColumn("_set", F.lit(""))
    # read many times below
    sets = cut(sets)
    sizes = sets.groupBy("_set", "_tree").agg(F.count(F.lit(1)).alias("size"))
    trees = sizes.groupBy("_set").agg(F.count(F.lit(1)).alias("trees"))
    held = sets.groupBy("_set", "_e").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(trees, "_set")
    # what most trees hold is met by the trees that lack it
    often = held.filter("2 * n > trees").select("_set", "_e")
    lacking = often.join(sizes.select("_set", "_tree"), "_set").join(sets, ["_set", "_tree", "_e"], "left_anti")
    some = sets.join(held.filter("2 * n <= trees").select("_set", "_e"), ["_set", "_e"])

    def met(rows: DataFrame, name: str) -> DataFrame:
        a, b = (rows.select("_set", "_e", F.col("_tree").alias(f"tree_{s}")) for s in "ab")
        return a.join(b, ["_set", "_e"]).filter("tree_a < tree_b").groupBy("_set", "tree_a", "tree_b").agg(F.count(F.lit(1)).alias(name))

    pairs = _tree_pairs(sizes).join(often.groupBy("_set").agg(F.count(F.lit(1)).alias("often")), "_set", "left")
    lacks = lacking.groupBy("_set", "_tree").agg(F.count(F.lit(1)).alias("n"))
    for end in "ab":
        pairs = pairs.join(lacks.select("_set", F.col("_tree").alias(f"tree_{end}"), F.col("n").alias(f"lacks_{end}")), ["_set", f"tree_{end}"], "left")
    for rows, count in ((some, "shared"), (lacking, "lacking")):
        pairs = pairs.join(met(rows, count), ["_set", "tree_a", "tree_b"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("often", "lacks_a", "lacks_b", "shared", "lacking")}
    both = n["shared"] + n["often"] - n["lacks_a"] - n["lacks_b"] + n["lacking"]
    return pairs.select("tree_a", "tree_b", (F.col("size_a") + F.col("size_b") - 2 * both).cast("long").alias(name))


def rf_distances(nodes: DataFrame, positional: bool = False, datasets: DataFrame | None = None) -> DataFrame:
    return symmetric_difference(clade_sets(nodes, positional), datasets=datasets)


def matrix(pairs: DataFrame, value: str = "rf") -> DataFrame:
    """All cells (a, b, value) of the symmetric matrix, with a zero diagonal."""
    names = pairs.select("tree_a").union(pairs.select("tree_b")).distinct().toDF("a")
    same = names.select("a", F.col("a").alias("b"), F.lit(0).cast("long").alias(value))
    one = pairs.select(F.col("tree_a").alias("a"), F.col("tree_b").alias("b"), value)
    return one.union(one.select("b", "a", value)).union(same)


def summary(pairs: DataFrame, value: str = "rf") -> DataFrame:
    """n_trees, n_pairs, mean, median, least, most."""
    # each pair stands twice, once for each of its trees, which leaves the mean, the median and the ends as they are
    rows = pairs.select(value, F.posexplode(F.array("tree_a", "tree_b")).alias("_side", "_tree"))
    return rows.agg(
        F.count_distinct("_tree").alias("n_trees"), F.count_if(F.col("_side") == 0).alias("n_pairs"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def accumulated(pairs: DataFrame, keys: tuple[str, str] = ("method_a", "method_b"), value: str = "rf") -> DataFrame:
    """Sums over datasets by pair of methods."""
    return pairs.groupBy(*keys).agg(F.sum(value).cast("long").alias(value))


def quartets(nodes: DataFrame, max_leaves: int = 32) -> DataFrame:
    """tree and signature of each four leaves: for each of their six pairs the pair's smallest common clade, as the item of its leaves.

    The rows are of the fourth power of the leaves, so that trees with more than max_leaves raise; it is a parameter. Distances do not need them.
    """
    own = clades(nodes).select("tree", "terminals", "n_terminals", item_key(F.col("terminals")).alias("clade"))
    leaf = nodes.filter("is_terminal").select("tree", "name")
    many = leaf.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    leaf = leaf.join(many, "tree").withColumn("name", F.when(F.col("n") > max_leaves, F.raise_error(F.lit("too many leaves for quartets")).cast("string")).otherwise(F.col("name"))).drop("n")
    inside = own.select("tree", "n_terminals", "clade", "terminals", F.explode("terminals").alias("x"))
    pair = inside.select("tree", "n_terminals", "clade", "x", F.explode("terminals").alias("y")).filter("x < y")
    common = pair.groupBy("tree", "x", "y").agg(F.min_by("clade", "n_terminals").alias("clade"))
    four = leaf.select("tree", F.col("name").alias("a"))
    for column in "bcd":
        last = chr(ord(column) - 1)
        four = four.join(leaf.select("tree", F.col("name").alias(column)), "tree").filter(F.col(last) < F.col(column))
    pairs = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")])
    each = four.select("tree", "a", "b", "c", "d", F.explode(pairs).alias("p")).select("tree", "a", "b", "c", "d", "p.x", "p.y")
    met = each.join(common, ["tree", "x", "y"])
    # the restriction of each clade to the four leaves would lose nothing that the pairs do not tell; whole clades are kept
    signature = F.array_join(F.array_sort(F.collect_list("clade")), ";")
    return met.groupBy("tree", "a", "b", "c", "d").agg(signature.alias("signature")).select("tree", F.concat_ws("|", "a", "b", "c", "d", "signature").alias("signature"))


def _partitions(n: int) -> Iterator[list[int]]:
    """All partitions of n things, as the block of each."""
    for blocks in itertools.product(range(n), repeat=n):
        if all(b <= max(blocks[:i], default=-1) + 1 for i, b in enumerate(blocks)):
            yield list(blocks)


def _sign(blocks: list[int]) -> int:
    """The weight of a partition in the inclusion and exclusion of equal numbers."""
    return math.prod((-1) ** (k - 1) * math.factorial(k - 1) for k in Counter(blocks).values())


def _rooted(edges: dict, row, column, skip) -> tuple:
    """The sum over all edges but skip that hang at a row or a column, as factors."""
    out = []
    for (r, c), weights in edges.items():
        if (r, c) != skip and r == row and row is not None:
            out.append(("row", tuple(sorted([*weights, *_rooted(edges, None, c, (r, c))], key=repr))))
        if (r, c) != skip and c == column and column is not None:
            out.append(("column", tuple(sorted([*weights, *_rooted(edges, r, None, (r, c))], key=repr))))
    return tuple(out)


def _depth(expression: tuple) -> int:
    return max((1 + _depth(f[1]) for f in expression if isinstance(f, tuple)), default=0)


CYCLE = ("cycle",)


def placements(weights: tuple[str, ...]) -> Counter:
    """How the sum of a product of weights over cells of distinct rows and columns follows from sums over all cells.

    Rows and columns are made equal in all ways, by inclusion and exclusion; each way is a graph whose parts are sums over cells of products of
    weights and of sums along a row or column, or, of two rows and two columns, a cycle. Keys are the sorted parts, values their factors.
    """
    out: Counter = Counter()
    for rows, columns in itertools.product(_partitions(len(weights)), repeat=2):
        left, parts = set(range(len(weights))), []
        while left:
            part, grown = {left.pop()}, True
            while grown:
                near = {k for k in left if any(rows[k] == rows[x] or columns[k] == columns[x] for x in part)}
                part, left, grown = part | near, left - near, bool(near)
            edges: dict = {}
            for k in sorted(part):
                edges.setdefault((rows[k], columns[k]), []).append(weights[k])
            if len(edges) == len({r for r, _ in edges}) + len({c for _, c in edges}):
                parts.append(CYCLE)
            else:
                roots = [tuple(sorted([*w, *_rooted(edges, r, c, (r, c))], key=repr)) for (r, c), w in edges.items()]
                parts.append(min(roots, key=lambda e: (_depth(e), repr(e))))
        out[tuple(sorted(parts, key=repr))] += _sign(rows) * _sign(columns)
    return Counter({k: v for k, v in out.items() if v})


_CLADE = ["tree_a", "tree_b", "clade"]
_WHOLE = "decimal(38,0)"


def placed_sums(cells: DataFrame, sums: dict[str, list[tuple[int, tuple[str, ...]]]]) -> DataFrame:
    """Per tree_a, tree_b and clade of cells (row, column and weights), for each name the sum of placements of weights, each divided by a number."""
    wanted = {name: [(divisor, placements(w)) for divisor, w in terms] for name, terms in sums.items()}
    parts = sorted({p for terms in wanted.values() for _, counts in terms for key in counts for p in key if p != CYCLE}, key=repr)
    named: dict[tuple, str] = {}
    weights = {f for p in parts for f in p if isinstance(f, str)}
    rows = cells.withColumns({w: F.col(w).cast(_WHOLE) for w in sorted(weights | {"a"})})

    def product(expression: tuple) -> Column:
        columns = [F.col(f if isinstance(f, str) else named[f]) for f in expression]
        return functools.reduce(lambda x, y: (x * y).cast(_WHOLE), columns)

    def messages(expression: tuple) -> set:
        return {m for f in expression if isinstance(f, tuple) for m in {f} | messages(f[1])}

    needed = sorted({m for p in parts for m in messages(p)}, key=lambda m: (_depth((m,)), repr(m)))
    for m in needed:
        named[m] = f"_m{len(named)}"
        rows = rows.withColumn(named[m], F.sum(product(m[1])).over(Window.partitionBy(*_CLADE, m[0])).cast(_WHOLE))
    totals = rows.groupBy(*_CLADE).agg(*[F.sum(product(p)).cast(_WHOLE).alias(f"_p{i}") for i, p in enumerate(parts)])
    if any(CYCLE in key for terms in wanted.values() for _, counts in terms for key in counts):
        # lines of two cells meet at what they share: along rows or along columns, where fewer do
        along = Window.partitionBy(*_CLADE, "row"), Window.partitionBy(*_CLADE, "column")
        sized = cells.select(*_CLADE, "row", "column", F.col("a").cast(_WHOLE).alias("a"), *[F.count(F.lit(1)).over(w).alias(n) for w, n in zip(along, ("_r", "_c"))])
        by_row = F.sum("_r").over(Window.partitionBy(*_CLADE)) <= F.sum("_c").over(Window.partitionBy(*_CLADE))
        lines = sized.select(*_CLADE, F.when(by_row, F.col("row")).otherwise(F.col("column")).alias("line"), F.when(by_row, F.col("column")).otherwise(F.col("row")).alias("at"), "a")
        x, y = lines.withColumnsRenamed({"at": "x", "a": "ax"}), lines.withColumnsRenamed({"at": "y", "a": "ay"})
        met = x.join(y, [*_CLADE, "line"]).groupBy(*_CLADE, "x", "y").agg(F.sum((F.col("ax") * F.col("ay")).cast(_WHOLE)).cast(_WHOLE).alias("s"))
        cycles = met.groupBy(*_CLADE).agg(F.sum((F.col("s") * F.col("s")).cast(_WHOLE)).cast(_WHOLE).alias("_cycle"))
        totals = totals.join(cycles, _CLADE)
    at = {p: f"_p{i}" for i, p in enumerate(parts)} | {CYCLE: "_cycle"}

    def whole(counts: Counter) -> Column:
        terms = [functools.reduce(lambda x, y: (x * y).cast(_WHOLE), [F.lit(k).cast(_WHOLE), *[F.col(at[p]) for p in key]]) for key, k in counts.items()]
        return functools.reduce(lambda x, y: (x + y).cast(_WHOLE), terms)

    columns = [functools.reduce(lambda x, y: (x + y).cast(_WHOLE), [F.call_function("div", whole(counts), F.lit(divisor)).cast(_WHOLE) for divisor, counts in terms]).alias(name) for name, terms in wanted.items()]
    return totals.select(*_CLADE, *columns)


def _branches(nodes: DataFrame) -> DataFrame:
    """tree, clade (its leaves' item), n_terminals, branch (a child) and leaf: of each clade that parts its leaves, below which child each stands."""
    placed = _placed(nodes)
    parted = placed.groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.max("n_terminals").alias("_most"))
    own = clades(nodes).select("tree", "node_id", "n_terminals", item_key(F.col("terminals")).alias("clade")).join(parted, ["tree", "node_id"]).filter("_most < n_terminals")
    below = placed.filter("parent_id is not null and n_terminals > 0").select("tree", F.col("parent_id").alias("node_id"), F.col("node_id").alias("branch"), F.explode(F.sequence(F.col("_leaf"), F.col("_leaf") + F.col("n_terminals") - 1)).alias("_at"))
    leaves = placed.filter("is_terminal").select("tree", F.col("_leaf").alias("_at"), F.col("name").alias("leaf"))
    return below.join(leaves, ["tree", "_at"]).join(own.select("tree", "node_id", "clade", "n_terminals"), ["tree", "node_id"]).select("tree", "clade", "n_terminals", "branch", "leaf")


def quartet_distances(nodes: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """tree_a < tree_b of one dataset and quartet, the number of fours of leaves (named once in a tree) whose signatures only one of them has; for trees of any size.

    Two trees agree on four leaves exactly if each of the six pairs has the same smallest common clade in both. So a clade that both trees have counts the
    fours that it parts: its leaves lie in cells, by the child of one tree and that of the other, and agreeing leaves stand in one cell or in cells of other rows and other
    columns. Sums over such cells follow from sums along rows and columns (``placements``). Twos agree by clades alone, threes by the twos
    within cells, fours by the threes: three passes, whatever the depth, over as many rows as trees have leaves below clades. No four is listed.
    """
    leaves = nodes.filter("is_terminal").select(F.col("tree").alias("_tree"), "name")
    sets = datasets.select(F.col("tree").alias("_tree"), F.col("dataset").alias("_set")) if datasets is not None else nodes.select(F.col("tree").alias("_tree"), F.lit("").alias("_set")).distinct()
    n = F.count(F.lit(1)).cast(_WHOLE)
    fours = functools.reduce(lambda x, y: (x * y).cast(_WHOLE), [n, n - 1, n - 2, n - 3])
    sizes = leaves.join(sets, "_tree").groupBy("_set", "_tree").agg(F.call_function("div", fours, F.lit(24)).cast("long").alias("size"))
    own = cut(_branches(nodes).join(sets, F.col("tree") == F.col("_tree")).drop("_tree"))
    a = own.select("_set", "clade", "leaf", "n_terminals", F.col("tree").alias("tree_a"), F.col("branch").alias("row"))
    b = own.select("_set", "clade", "leaf", F.col("tree").alias("tree_b"), F.col("branch").alias("column"))
    held = cut(a.join(b, ["_set", "clade", "leaf"]).filter("tree_a < tree_b").select(*_CLADE, "n_terminals", "row", "column", "leaf"))
    cells = cut(held.groupBy(*_CLADE, "row", "column").agg(F.count(F.lit(1)).alias("a")))
    # the cells in which a clade lies within all that hold it, by one of its leaves
    inner = held.groupBy(*_CLADE).agg(F.min("leaf").alias("leaf"), F.first("n_terminals").alias("_n")).withColumnRenamed("clade", "_inner")
    inside = cut(held.join(inner, ["tree_a", "tree_b", "leaf"]).filter("n_terminals > _n").select(*_CLADE, "row", "column", "_inner"))

    def lifted(counts: DataFrame, name: str) -> DataFrame:
        """What the clades within each cell count."""
        return inside.join(counts.withColumnRenamed("clade", "_inner"), ["tree_a", "tree_b", "_inner"]).groupBy(*_CLADE, "row", "column").agg(F.sum(name).cast(_WHOLE).alias(name))

    cell = [*_CLADE, "row", "column"]
    twos = placed_sums(cells, {"b": [(2, ("a", "a"))]})
    cells = cut(cells.join(lifted(twos, "b"), cell, "left").fillna(0, ["b"]))
    threes = placed_sums(cells, {"c": [(1, ("b", "a")), (6, ("a", "a", "a"))]})
    cells = cut(cells.join(lifted(threes, "c"), cell, "left").fillna(0, ["c"]))
    met = placed_sums(cells, {"d": [(1, ("c", "a")), (2, ("b", "b")), (2, ("b", "a", "a")), (24, ("a", "a", "a", "a"))]})
    shared = met.groupBy("tree_a", "tree_b").agg(F.sum("d").cast("long").alias("both"))
    out = _tree_pairs(sizes).join(shared, ["tree_a", "tree_b"], "left")
    return out.select("tree_a", "tree_b", (F.col("size_a") + F.col("size_b") - 2 * F.coalesce("both", F.lit(0))).alias("quartet"))
