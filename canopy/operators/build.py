"""From aligned sequences to trees: distances, agglomeration, parsimony, and the grid of methods.

Distances compare blocks of a dataset's sequences as arrays, a pair of blocks per task, so that a large dataset spreads. Averaging and neighbour joining merge
all clusters that are each other's best in saved rounds of rows, and parsimony scores all interchanges of a round by blocks of columns, so that large
datasets spread, too. Small datasets are built in a task each, by Arrow-backed functions.
"""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.align import align
from canopy.operators.cleaning import without_ignored
from canopy.operators.matrices import apart, averaged, joined, packed, spanning, symbols
from canopy.operators.profiles import profile_merges
from canopy.operators.steps import cut, ranked, sorted_in
from canopy.operators.trees import NODE
from canopy.sources.newick import Clade, clade_of, node_rows, parse, read_text

ALIGNERS = ("clustalo", "mafft")
CLUSTERINGS = ("nj", "upgma")
EXTERNAL = ("iqtree", "fasttree", "raxml", "mrbayes")
BLOCK_ROWS = 512
#: Letters of a dataset's alignment that one task climbs with, or makes profiles of.
TASK_CELLS = 4_000_000
#: Distances of a list.
LISTED = 65_536


def difference(a: Sequence[str], b: Sequence[str], step: int = 65_536) -> np.ndarray:
    """The share of columns in which each of a differs from each of b; 0 for empty rows. Rows of a meet b a step of cells at once."""
    width = max(map(len, [*a, *b]), default=0)
    (x, y), lane = packed(symbols(a, width, 0x110000), symbols(b, width, 0x110001))
    size, rows = np.array([len(s) for s in a], np.int64)[:, None], max(1, step // max(len(b), 1))
    out = np.empty((len(a), len(b)))
    for at in range(0, len(a), rows):
        own = size[at : at + rows]
        out[at : at + rows] = np.where(own > 0, 1.0 - (width - apart(y, x[:, at : at + rows, None], lane)) / np.maximum(own, 1), 0.0)
    return out


#: Distinct sequences of a block; each two blocks of a dataset meet in a task for their spanning tree.
SPANNING_ROWS = 4096


def spanning_distances(aligned: DataFrame, rows: int = SPANNING_ROWS) -> DataFrame:
    """dataset, id_a < id_b, dist: of ``identity_distances`` those pairs that single linkage takes, and few more.

    Equal sequences hang at the first of them. Distinct ones are dealt to blocks, and each two blocks leave the edges of their spanning tree: an edge of the
    whole tree is in the tree of every part that holds it, as equal distances go by the ids. So a task holds two blocks and never their pairs.
    """
    own = aligned.select("dataset", "id", F.coalesce("seq", F.lit("")).alias("seq"))
    classes = cut(own.groupBy("dataset", "seq").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    copies = own.join(classes.filter("n > 1").select("dataset", "seq", "first"), ["dataset", "seq"]).filter("id <> first")
    blocks = classes.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_n"))
    lots = classes.join(blocks, "dataset").withColumn("_own", F.pmod(F.xxhash64("first"), F.col("_n")).cast("int"))
    lots = lots.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).filter("_other <> _own or _n = 1")
    lots = lots.select("dataset", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.col("first").alias("id"), "seq")

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, seqs = part["id"].to_numpy(object), part["seq"].tolist()
        i, j, n = spanning(seqs)
        size = max(map(len, seqs))
        return pd.DataFrame({"dataset": key[0], "id_a": ids[i], "id_b": ids[j], "dist": 1.0 - (size - n) / max(size, 1)})

    edges = dealt(lots, "dataset", "_i", "_j").groupBy("dataset", "_i", "_j").applyInPandas(run, "dataset string, id_a string, id_b string, dist double")
    return edges.unionByName(copies.select("dataset", F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(0.0).alias("dist")))


def dealt(rows: DataFrame, *keys: str, parts: int = 4) -> DataFrame:
    """rows by keys in some parts for each core: groups of few bytes and much work, which would be put together by their bytes."""
    return rows.repartition(parts * rows.sparkSession.sparkContext.defaultParallelism, *keys)


#: Parts for each core where a group may take a minute, so that few groups share a task.
LONG = 16


def identity_distances(aligned: DataFrame, digits: int | None = None) -> DataFrame:
    """dataset, id_a < id_b, dist (rounded to digits, if given): the share of columns that differ. Gaps against gaps are equal columns; rows of a dataset are equally long.

    Ids are unique in a dataset. A dataset is dealt to blocks of BLOCK_ROWS, and each two of its blocks meet in one group, which leaves its distances as lists and
    the names once: the pairs, all of which are results, are made of them in the same stage.
    """
    rows = aligned.select("dataset", "id", F.coalesce("seq", F.lit("")).alias("seq"))
    blocks = rows.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_n"))
    rows = rows.join(blocks, "dataset").withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.select("dataset", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") <= F.col("_other")).alias("_first"), "id", "seq")

    def run(key: tuple[Any, ...], part: pa.Table) -> pa.Table:
        first = part["_first"].combine_chunks()
        one = part.filter(first)
        other = one if key[1] == key[2] else part.filter(pc.invert(first))
        a, b = one["id"].to_pylist(), other["id"].to_pylist()
        dist = difference(one["seq"].to_pylist(), other["seq"].to_pylist())
        if digits is not None:
            dist = np.floor(dist * 10.0**digits + 0.5) / 10.0**digits  # halves go up, as in SQL
        step = max(1, LISTED // max(len(b), 1))
        starts = np.arange(0, len(a) if b else 0, step)
        ends = np.append(starts, len(a) if b else 0)
        lists = pa.array([a[at : at + step] for at in starts], pa.list_(pa.string())), pa.array([b] * len(starts), pa.list_(pa.string()))
        cells = pa.ListArray.from_arrays(pa.array(ends * len(b), pa.int32()), pa.array(dist.ravel()))
        return pa.table([pa.repeat(key[0], len(starts)), pa.repeat(key[1] == key[2], len(starts)), *lists, cells], ["dataset", "same", "a", "b", "dist"])

    listed = dealt(rows, "dataset", "_i", "_j").groupBy("dataset", "_i", "_j").applyInArrow(run, "dataset string, same boolean, a array<string>, b array<string>, dist array<double>")
    each = listed.select("dataset", "same", "a", "b", F.posexplode("dist").alias("at", "dist"))
    at = [F.call_function("div", F.col("at"), F.size("b")).cast("int"), F.col("at") % F.size("b")]
    each = each.select("dataset", "same", F.get("a", at[0]).alias("x"), F.get("b", at[1]).alias("y"), "dist")
    # two blocks meet once, a block meets itself both ways
    return each.filter(F.when(F.col("same"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))).select("dataset", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "dist")


def method_grid(datasets: DataFrame, mode: str = "auto", ignored: str | Sequence[str] | None = None, single: tuple[str, str, str | None] | None = None) -> DataFrame:
    """dataset, aligner, method, submethod of the trees that a mode builds: auto has eight, advanced eight more, single the one that is given."""
    spark = datasets.sparkSession
    if mode == "single":
        if single is None:
            raise ValueError("single names an aligner, a method and a submethod")
        aligner, method, sub = single
        if method in CLUSTERINGS:  # a clustering alone means distances
            method, sub = "distance", method
        if method not in ("distance", "parsimony", *EXTERNAL):
            raise ValueError(f"{method} is no method")
        rows = [(aligner, method, None if method in EXTERNAL else sub or CLUSTERINGS[0])]
    elif mode in ("auto", "advanced"):
        rows = [(a, m, c) for a in ALIGNERS for m in ("distance", "parsimony") for c in CLUSTERINGS]
        rows += [(a, m, None) for a in ALIGNERS for m in EXTERNAL] if mode == "advanced" else []
    else:
        raise ValueError("mode is auto, advanced or single")
    grid = spark.createDataFrame(rows, "aligner string, method string, submethod string")
    grid = without_ignored(without_ignored(grid, ignored).withColumn("_s", F.coalesce("submethod", F.lit(""))), ignored, "_s").drop("_s")
    return datasets.select("dataset").distinct().join(F.broadcast(grid))


def tree_name(row: tuple[str, str, str, str | None]) -> str:
    dataset, aligner, method, sub = row
    return "_".join(x for x in ("tree", dataset, aligner, sub, method) if x)


def agglomerate(names: Sequence[str], dist: np.ndarray, method: str = "nj", weighted: bool = False) -> Clade:
    """A rooted clade by neighbour joining or averaging.

    Of equal candidates the first pair in the lower triangle, by row, is joined. Averaging halves the two rows as they stand;
    weighted counts leaves. Internal nodes have no names.
    """
    nodes = [Clade(name=n) for n in names]
    d = np.array(dist, float)
    size = [1] * len(nodes)
    height = [0.0] * len(nodes)
    upper, room = np.tri(len(nodes), dtype=bool).T, np.empty(d.size)  # made once, as are the scores' cells
    while len(nodes) > 2 or (method == "upgma" and len(nodes) > 1):
        n = len(nodes)
        score = room[: n * n].reshape(n, n)
        if method == "nj":
            r = d.sum(axis=1) / (n - 2)
            np.subtract(d, r[:, None], out=score)
            score -= r[None, :]
        else:
            score[:] = d
        np.copyto(score, np.inf, where=upper[:n, :n])
        i, j = divmod(int(score.argmin()), n)
        apart = float(d[i, j])
        if method == "nj":
            nodes[i].branch_length = (apart + r[i] - r[j]) / 2
            nodes[j].branch_length = apart - nodes[i].branch_length
            row = (d[i] + d[j] - apart) / 2
        else:
            for k in (i, j):
                nodes[k].branch_length = apart / 2 - height[k]
            row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]) if weighted else (d[i] + d[j]) / 2
        joined = Clade(children=[nodes[i], nodes[j]])
        d[j], d[:, j] = row, row
        d[j, j] = 0
        nodes[j], size[j], height[j] = joined, size[i] + size[j], apart / 2
        d[i:-1] = d[i + 1 :]
        d[:, i:-1] = d[:, i + 1 :]
        d = d[:-1, :-1]
        for x in (nodes, size, height):
            del x[i]
    if len(nodes) == 2:  # neighbour joining: the last two, one below the other
        a, b = (nodes[1], nodes[0]) if nodes[1].children else (nodes[0], nodes[1])
        b.branch_length = float(d[0, 1])
        if not a.children:
            return Clade(children=[a, b])
        a.branch_length = None
        a.children.append(b)
        return a
    return nodes[0] if nodes else Clade()


def _unique(names: Sequence[str]) -> list[str]:
    if len(set(names)) < len(names):
        raise ValueError("an id stands twice in a dataset")
    return list(names)


def _square(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and matrix of rows (id_a, id_b, dist), of which those without id_b name a sequence only."""
    pairs = rows[rows["id_b"].notna()]
    names = sorted(set(pairs["id_a"]) | set(pairs["id_b"]) | set(_unique(rows["id_a"][rows["id_b"].isna()])))
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = pairs["id_a"].map(at).to_numpy(int), pairs["id_b"].map(at).to_numpy(int)
    d[i, j] = d[j, i] = pairs["dist"].to_numpy()
    return names, d


#: Sequences of a dataset that averaging takes in one task, at most, and neighbour joining.
TASK_MEMBERS = 1000
TASK_JOINED = 4000


def averaging_merges(distances: DataFrame, weighted: bool = False) -> DataFrame:
    """dataset, round, a, b and dist: the merges of averaging over distances (dataset, id_a < id_b, dist); a cluster is named by its smallest member, a < b.

    No merge brings two clusters closer to each other than both were to what was merged, so that all clusters that are each other's nearest may merge
    at once; the tree is that of merging one pair after the other. Equal distances go by the names. The number of rounds grows with the logarithm of
    the sequences for distances that scatter, and with their number for a chain of ever larger gaps.
    """
    left = cut(distances.select("dataset", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "dist", F.lit(1.0).alias("w")))
    found, turn = None, 0
    while found is None or not left.isEmpty():
        edge = F.struct("dist", "a", "b")
        best = left.select("dataset", F.explode(F.array("a", "b")).alias("x"), edge.alias("e")).groupBy("dataset", "x").agg(F.min("e").alias("e"))
        own = cut(best.groupBy("dataset", "e").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("dataset", F.lit(turn).alias("round"), "e.a", "e.b", "e.dist"))
        found = own if found is None else found.unionByName(own)
        named = own.select("dataset", F.col("b").alias("x"), F.col("a").alias("to"))
        moved = left
        for end in "ab":
            moved = moved.join(sorted_in(named.withColumnRenamed("x", end)), ["dataset", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        moved = moved.filter("a <> b").withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")})
        # w is the number of pairs of leaves, or with equal halves it plays no part
        mean = F.sum(F.col("dist") * F.col("w")) / F.sum("w") if weighted else F.avg("dist")
        left = cut(moved.groupBy("dataset", F.col("_a").alias("a"), F.col("_b").alias("b")).agg(mean.alias("dist"), F.sum("w").alias("w")))
        turn += 1
    return found


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The node rows of one dataset's merges."""
    clades: dict[str, tuple[Clade, float]] = {}
    top = None
    for a, b, dist in rows.sort_values(["round", "a"])[["a", "b", "dist"]].itertuples(index=False):
        children = []
        for name in (b, a):
            clade, height = clades.pop(name, None) or (Clade(name=name), 0.0)
            clade.branch_length = dist / 2 - height
            children.append(clade)
        top = Clade(children=children)
        clades[a] = top, dist / 2
    return node_rows(f"tree_{rows['dataset'].iloc[0]}_upgma", top)


def joining_merges(distances: DataFrame) -> DataFrame:
    """dataset, round, a, b, length_a and length_b: the merges of relaxed neighbour joining over distances (dataset, id_a < id_b, dist); a cluster is named by its smallest member, a < b.

    Each round every two clusters whose score is least for both merge. Where a tree has these distances such two are neighbours in it, so that the tree
    is found, as by merging one pair after the other; elsewhere both ways may give other trees. Scores count to nine places, equal ones go by the names. The last two
    clusters have no length_a; the round that joins them has their distance as length_b. The number of rounds grows with the logarithm of the sequences for
    trees that branch evenly, and with their number for a single comb.
    """
    left = cut(distances.select("dataset", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "dist"))
    found, turn = None, 0
    while found is None or not left.isEmpty():
        ends = left.select("dataset", F.explode(F.array("a", "b")).alias("x"), "dist").groupBy("dataset", "x").agg(F.sum("dist").alias("r"), (F.count(F.lit(1)) - 1).alias("n"))
        # n is the number of clusters less two: 0 for the last pair
        ends = cut(ends.select("dataset", "x", F.coalesce(F.try_divide("r", "n"), F.lit(0.0)).alias("r"), "n"))
        scored = left.join(sorted_in(ends.select("dataset", F.col("x").alias("a"), F.col("r").alias("r_a"), "n")), ["dataset", "a"]).join(sorted_in(ends.select("dataset", F.col("x").alias("b"), F.col("r").alias("r_b"))), ["dataset", "b"])
        score = F.round(F.col("dist") - F.col("r_a") - F.col("r_b"), 9)
        edge = F.struct(score.alias("score"), "a", "b", "dist", "r_a", "r_b", "n")
        best = scored.select("dataset", F.explode(F.array("a", "b")).alias("x"), edge.alias("e")).groupBy("dataset", "x").agg(F.min("e").alias("e"))
        both = best.groupBy("dataset", "e.a", "e.b").agg(F.count(F.lit(1)).alias("_both"), F.first("e").alias("e")).filter("_both = 2")
        half = (F.col("e.dist") + F.col("e.r_a") - F.col("e.r_b")) / 2
        last = F.col("e.n") == 0
        own = cut(both.select("dataset", F.lit(turn).alias("round"), "a", "b", F.when(~last, half).alias("length_a"), F.when(last, F.col("e.dist")).otherwise(F.col("e.dist") - half).alias("length_b"), F.col("e.dist").alias("_dist")))
        found = own.drop("_dist") if found is None else found.unionByName(own.drop("_dist"))
        # what is merged lies half its own distance nearer to all others than its two parts do on average
        named = own.select("dataset", F.explode(F.array("a", "b")).alias("x"), F.col("a").alias("to"), F.col("_dist").alias("own"))
        moved = left
        for end in "ab":
            moved = moved.join(sorted_in(named.select("dataset", F.col("x").alias(end), "to", F.col("own").alias(f"own_{end}"))), ["dataset", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        nearer = (F.coalesce("own_a", F.lit(0.0)) + F.coalesce("own_b", F.lit(0.0))) / 2
        moved = moved.filter("a <> b").select("dataset", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist", nearer.alias("nearer"))
        left = cut(moved.groupBy("dataset", "a", "b").agg((F.avg("dist") - F.max("nearer")).alias("dist")))
        turn += 1
    return found


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """The node rows of one dataset's joins; the last two stand one below the other, as in ``agglomerate``."""
    clades: dict[str, Clade] = {}
    top = None
    for a, b, length_a, length_b in rows.sort_values(["round", "a"])[["a", "b", "length_a", "length_b"]].itertuples(index=False):
        one, other = (clades.pop(n, None) or Clade(name=n) for n in (a, b))
        if pd.notna(length_a):
            one.branch_length, other.branch_length = length_a, length_b
            top = clades[a] = Clade(children=[one, other])
            continue
        if not one.children:
            one, other = other, one
        other.branch_length, one.branch_length = length_b, None
        if one.children:
            one.children.append(other)
        top = one if one.children else Clade(children=[one, other])
    return node_rows(f"tree_{rows['dataset'].iloc[0]}_nj", top)


def distance_trees(
    distances: DataFrame, methods: Sequence[str] = CLUSTERINGS, weighted: bool = False, members: DataFrame | None = None, task_members: int = TASK_MEMBERS, task_joined: int = TASK_JOINED
) -> DataFrame:
    """Node rows of one tree per dataset and method, named tree_{dataset}_{method}.

    Datasets of more than task_members sequences are averaged in rounds, those of more than task_joined are joined in rounds (``joining_merges``).
    members (dataset, id) names the sequences: a dataset of one, which has no distances, is a tree of one leaf, and an id that stands twice raises.
    """
    grid = F.explode(F.array(*map(F.lit, methods))).alias("method")
    rows = distances.select("dataset", "id_a", "id_b", "dist")
    if members is not None:
        rows = rows.unionByName(members.select("dataset", F.col("id").alias("id_a"), F.lit(None).cast("string").alias("id_b"), F.lit(None).cast("double").alias("dist")))

    def build(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        dataset, method = key
        names, d = _square(part)
        return node_rows(f"tree_{dataset}_{method}", agglomerate(names, d, method, weighted))

    limits = {"upgma": task_members, "nj": task_joined}
    sizes = cut(distances.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(limits[m] * (limits[m] - 1) / 2 for m in methods)))
    if sizes.isEmpty():
        return dealt(rows.select("*", grid), "dataset", "method").groupBy("dataset", "method").applyInPandas(build, NODE)
    over = sizes.select("dataset", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(limits[m] * (limits[m] - 1) / 2).alias("most")) for m in methods])).alias("m"), "n")
    over = over.filter("n > m.most").select("dataset", "m.method")
    if members is not None:
        twice = members.join(over.select("dataset").distinct(), "dataset").groupBy("dataset", "id").agg(F.count(F.lit(1)).alias("n"))
        if not twice.filter("n > 1").isEmpty():
            raise ValueError("an id stands twice in a dataset")
    out = dealt(rows.select("*", grid).join(over, ["dataset", "method"], "left_anti"), "dataset", "method").groupBy("dataset", "method").applyInPandas(build, NODE)
    for m in methods:
        own = distances.join(over.filter(F.col("method") == m).select("dataset"), "dataset", "left_semi")
        merges = averaging_merges(own, weighted) if m == "upgma" else joining_merges(own)
        spread = dealt(merges, "dataset").groupBy("dataset").applyInPandas(_merged if m == "upgma" else _joined, NODE)
        out = out.unionByName(spread)
    return out


#: Sequences of a dataset whose matrix a task holds, at most (1.2 GB).
MATRIX_MEMBERS = 12_000


def identity_clade_rows(
    name: str, dataset: str, names: Sequence[str], seqs: Sequence[str], method: str, weighted: bool = False, task_members: int = TASK_MEMBERS, task_joined: int = TASK_JOINED, matrix_members: int = MATRIX_MEMBERS
) -> pd.DataFrame:
    """Node rows of the tree that ``distance_trees`` builds of sequences, by name; beyond its limits the merges of its rounds are found on the matrix.

    More than matrix_members sequences of one length are merged by their profiles, without a matrix.
    """
    if len(names) <= {"upgma": task_members, "nj": task_joined}[method] or len(names) < 2:
        return node_rows(name, agglomerate(names, difference(seqs, seqs), method, weighted))
    if len(names) > matrix_members and len(set(map(len, seqs))) == 1:
        made = profile_merges(names, seqs, method, weighted)
    else:
        d = difference(seqs, seqs)
        made = averaged(names, d, weighted) if method == "upgma" else joined(names, d)
    made = made.assign(dataset=dataset)
    return (_merged(made) if method == "upgma" else _joined(made)).assign(tree=name)


def identity_trees(aligned: DataFrame, methods: Sequence[str] = CLUSTERINGS, weighted: bool = False, task_members: int = TASK_MEMBERS, task_joined: int = TASK_JOINED, matrix_members: int = MATRIX_MEMBERS) -> DataFrame:
    """``distance_trees`` of ``identity_distances``, its trees and names, without rows of pairs: a task makes the matrix from the sequences.

    Of more than matrix_members sequences of one length, four million letters at most, a task makes profiles, whose memory grows with the sequences; only
    others take the rounds of rows.
    """
    rows = aligned.select("dataset", "id", F.coalesce("seq", F.lit("")).alias("seq"))
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"))
    profiled = (F.col("least") == F.col("most")) & (F.col("n") * F.col("most") <= TASK_CELLS)
    large = cut(sizes.filter((F.col("n") > matrix_members) & ~profiled).select("dataset"))

    def build(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        dataset, method = key
        names = _unique(sorted(part["id"]))
        own = part.set_index("id")["seq"].loc[names].tolist()
        return identity_clade_rows(f"tree_{dataset}_{method}", dataset, names, own, method, weighted, task_members, task_joined, matrix_members)

    small = rows.join(F.broadcast(large), "dataset", "left_anti").withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    out = dealt(small, "dataset", "method", parts=LONG).groupBy("dataset", "method").applyInPandas(build, NODE)
    if large.isEmpty():
        return out
    own = cut(rows.join(large, "dataset"))
    return out.unionByName(distance_trees(identity_distances(own), methods, weighted, own, task_members, task_joined))


def symbol_sets(sequences: Mapping[str, str]) -> dict[str, np.ndarray]:
    """Each symbol as a bit; words hold 64 of them, and Python's integers more."""
    symbols = sorted({c for s in sequences.values() for c in s})
    kind = np.uint64 if len(symbols) <= 64 else object
    bit = {c: 1 << i for i, c in enumerate(symbols)}
    return {n: np.array([bit[c] for c in s], kind) for n, s in sequences.items()}


class Changes:
    """The least numbers of changes below each node of a clade; states are sets of symbols per column, as bits."""

    def __init__(self, clade: Clade, states: Mapping[str, np.ndarray]):
        self.sets: dict[int, np.ndarray] = {}
        self.own: dict[int, int] = {}
        self.parent: dict[int, Clade] = {}
        order, todo = [], [clade]
        while todo:
            c = todo.pop()
            order.append(c)
            for child in c.children:
                self.parent[id(child)] = c
            todo += c.children
        for c in reversed(order):
            if c.children:
                self.sets[id(c)], self.own[id(c)] = self._met(c)
            else:
                self.sets[id(c)], self.own[id(c)] = states[c.name], 0
        self.total = sum(self.own.values())

    def _met(self, c: Clade) -> tuple[np.ndarray, int]:
        out, n = self.sets[id(c.children[0])], 0
        for child in c.children[1:]:
            other = self.sets[id(child)]
            both = out & other
            none = both == 0
            n += int(np.count_nonzero(none))
            out = np.where(none, out | other, both)
        return out, n

    def rescored(self, changed: Sequence[Clade]) -> list[tuple[int, np.ndarray, int]]:
        """Scores changed, which stand below each other or side by side from the lowest up, and all above anew; returns what was there."""
        before, todo = [], list(changed)
        while todo:
            c = todo.pop(0)
            before.append((id(c), self.sets[id(c)], self.own[id(c)]))
            self.sets[id(c)], n = self._met(c)
            self.total += n - self.own[id(c)]
            self.own[id(c)] = n
            if not todo and id(c) in self.parent:
                todo.append(self.parent[id(c)])
        return before

    def restore(self, before: list[tuple[int, np.ndarray, int]]) -> None:
        for key, sets, own in reversed(before):
            self.total += own - self.own[key]
            self.sets[key], self.own[key] = sets, own


def fitch(clade: Clade, states: Mapping[str, np.ndarray]) -> int:
    """The least number of changes."""
    return Changes(clade, states).total


def interchanges(clade: Clade) -> Iterator[tuple[Clade, ...]]:
    """Every nearest-neighbour interchange, done in place; each is undone when the next is asked for. Yields the nodes whose children changed, lowest first.

    Below a root of two children these are neighbours of one edge, so that their children change places, too.
    """
    if len(clade.children) == 2:
        a, b = clade.children
        for i in range(len(a.children)):
            for j in range(len(b.children)):
                x, y = a.children[i], b.children[j]
                a.children[i], b.children[j] = y, x
                yield a, b
                a.children[i], b.children[j] = x, y
    stack = [clade]
    while stack:
        c = stack.pop()
        stack += c.children
        for i, child in enumerate(c.children):
            for j in range(len(child.children)):
                for k, other in enumerate(c.children):
                    if k != i:
                        inner = child.children[j]
                        child.children[j], c.children[k] = other, inner
                        yield child, c
                        child.children[j], c.children[k] = inner, other


class Interchanges:
    """The interchanges of a tree of pairs (below a root of two or three), scored by the four sets around their edge, and the climb by them.

    Sets of all columns are one whole number, a lane of bits a column. A set from below and one from above each node tell what an interchange saves; when one
    is done, only sets that change are made anew, and counts of saving places below each node lead to the first. Order and steps are those of ``interchanges``.
    """

    def __init__(self, clade: Clade, sequences: Mapping[str, str]):
        self.clades, self.kids, self.parent = [clade], [], [-1]
        for at, c in enumerate(self.clades):  # grows as it goes, parents first
            self.kids.append(list(range(len(self.clades), len(self.clades) + len(c.children))))
            self.clades += c.children
            self.parent += [at] * len(c.children)
        bit = {c: 1 << i for i, c in enumerate(sorted({c for s in sequences.values() for c in s}))}
        self.top, width = len(bit) - 1, max(map(len, sequences.values()), default=0)
        self.high = sum(1 << (len(bit) * i + self.top) for i in range(width))
        self.low = sum(((1 << self.top) - 1) << (len(bit) * i) for i in range(width))
        places = {n: sum(bit[c] << (len(bit) * i) for i, c in enumerate(s)) for n, s in sequences.items()}
        n = len(self.clades)
        self.down, self.own, self.up, self.above = [0] * n, [0] * n, [0] * n, [0] * n
        for x in range(n - 1, -1, -1):
            if not self.kids[x]:
                self.down[x] = places[self.clades[x].name]
            elif x:
                self.down[x], self.own[x] = self.met(*(self.down[k] for k in self.kids[x]))
        for x in range(1, n):
            self.up[x], self.above[x] = self.rest(x)
        self.saving: list[tuple[int, int, int] | None] = [None] * n
        self.count = [0] * n

    @staticmethod
    def fits(clade: Clade, sequences: Mapping[str, str]) -> bool:
        """Whether a tree has pairs below its root, and sequences of one length."""
        todo = list(clade.children)
        pairs = len(todo) in (2, 3)
        while todo and pairs:
            c = todo.pop()
            pairs = len(c.children) in (0, 2)
            todo += c.children
        return pairs and len({len(s) for s in sequences.values()}) == 1 and any(sequences.values())

    def none(self, both: int) -> int:
        """The highest bits of the lanes that are empty."""
        return self.high & ~(((both & self.low) + self.low) | both)

    def met(self, a: int, b: int) -> tuple[int, int]:
        both = a & b
        empty = self.none(both)
        return (both | ((a | b) & (empty | (empty - (empty >> self.top)))), empty.bit_count()) if empty else (both, 0)

    def rest(self, x: int) -> tuple[int, int]:
        """The set above a node, of all that is not below it."""
        p = self.parent[x]
        others = [self.down[k] for k in self.kids[p] if k != x]
        if p:
            others.append(self.up[p])
        return self.met(*others) if len(others) == 2 else (others[0], 0)

    def quartet(self, a: int, b: int, c: int, d: int) -> int:
        (x, n), (y, m) = self.met(a, b), self.met(c, d)
        return n + m + self.none(x & y).bit_count()

    def gains(self, c: int) -> Iterator[tuple[int, int, int, int]]:
        """What each interchange at a node adds to the changes, in order, and how it is told: child, place in it, and place of the other in c (below a root of two: -1 less the place in the second)."""
        kids, down = self.kids, self.down
        if not c and len(kids[0]) == 2:
            a, b = kids[0]
            for i in range(len(kids[a])):
                for j in range(len(kids[b])):
                    one, other = (down[kids[a][i]], down[kids[a][1 - i]]), (down[kids[b][j]], down[kids[b][1 - j]])
                    yield self.quartet(one[0], other[1], one[1], other[0]) - self.quartet(*one, *other), a, i, -1 - j
        for i, child in enumerate(kids[c]):
            if not kids[child]:
                continue
            before = self.own[child] + self.above[child] + self.none(down[child] & self.up[child]).bit_count()
            for j in range(2):
                for k, other in enumerate(kids[c]):
                    if k == i:
                        continue
                    if not c and len(kids[0]) == 2:
                        yield 0, child, j, k  # the same tree with another root
                        continue
                    last = self.up[c] if c else down[next(x for x in kids[0] if x not in (child, other))]
                    yield self.quartet(down[kids[child][1 - j]], down[other], down[kids[child][j]], last) - before, child, j, k

    def judge(self, c: int) -> None:
        """Finds the first interchange at a node that saves changes, and counts it up to the root."""
        found = next(((child, j, k) for gain, child, j, k in self.gains(c) if gain < 0), None)
        step = (found is not None) - (self.saving[c] is not None)
        self.saving[c] = found
        while step and c >= 0:
            self.count[c] += step
            c = self.parent[c]

    def order(self) -> Iterator[int]:
        """Nodes as ``interchanges`` comes to them."""
        todo = [0]
        while todo:
            c = todo.pop()
            yield c
            todo += self.kids[c]

    def swap(self, c: int, child: int, j: int, k: int) -> None:
        low, high, at = (child, c, k) if k >= 0 else (child, self.kids[0][1], -1 - k)
        x, y = self.kids[low][j], self.kids[high][at]
        self.kids[low][j], self.kids[high][at] = y, x
        for p, i, z in ((low, j, y), (high, at, x)):
            self.clades[p].children[i] = self.clades[z]
            self.parent[z] = p
        carried = self.count[y] - self.count[x]
        for p, step in ((low, carried), (high, -carried)):
            while step and p >= 0:
                self.count[p] += step
                p = self.parent[p]
        # sets from below, upwards as long as they change
        again, path = {low, high, max(self.parent[high], 0)}, {low, high}
        for p in (low, high):
            while p > 0:
                made = self.met(*(self.down[z] for z in self.kids[p]))
                changed = made[0] != self.down[p]
                self.down[p], self.own[p] = made
                p = self.parent[p]
                path.add(p)
                again |= {p, max(self.parent[p], 0)}
                if not changed and p not in (low, high):
                    break
        # sets from above, downwards as long as they change
        start = high if k >= 0 else 0
        while self.parent[start] in path:
            start = self.parent[start]
        todo = [start]
        while todo:
            p = todo.pop()
            for z in self.kids[p]:
                made = self.rest(z)
                if made[0] != self.up[z] or z in path:
                    todo.append(z)
                    again.add(z)
                self.up[z], self.above[z] = made
        for p in again:
            if self.kids[p]:
                self.judge(p)

    def climb(self) -> None:
        for c in self.order():
            if self.kids[c]:
                self.judge(c)
        while self.count[0]:
            c = 0
            while self.saving[c] is None:
                c = next(x for x in reversed(self.kids[c]) if self.count[x])
            self.swap(c, *self.saving[c])


def climb(clade: Clade, sequences: Mapping[str, str]) -> tuple[Clade, int]:
    """Hill-climbing by interchanges: the first that needs fewer changes is taken, until none does.

    Each step saves a change or more, so that the climb ends. Trees of pairs climb by ``Interchanges``, by the same steps; in others an interchange scores
    the nodes on its way to the root.
    """
    states = symbol_sets(sequences)
    if Interchanges.fits(clade, sequences):
        Interchanges(clade, sequences).climb()
        return clade, fitch(clade, states)
    return climb_by_paths(clade, states)


def climb_by_paths(clade: Clade, states: Mapping[str, np.ndarray]) -> tuple[Clade, int]:
    """The climb in any tree."""
    better = True
    while better:
        score, better = Changes(clade, states), False
        best = score.total
        for changed in interchanges(clade):
            before = score.rescored(changed)
            if score.total < best:
                better = True
                break  # the tree stays as it is now
            score.restore(before)
    return clade, best


def built(dataset: str, trees: Mapping[str, str], rows: pd.DataFrame, clustering: str) -> pd.DataFrame:
    """Node rows of a dataset's trees by distance or parsimony or both, by their names; what the climb starts from is made once."""
    names = _unique(sorted(rows["id"]))
    seqs = dict(zip(rows["id"], rows["seq"]))
    made = identity_clade_rows("", dataset, names, [seqs[n] for n in names], clustering)
    return pd.concat([node_rows(name, climb(read_clade(made), seqs)[0]) if method == "parsimony" else made.assign(tree=name) for method, name in trees.items()], ignore_index=True)


def read_clade(rows: pd.DataFrame) -> Clade:
    """The clade of one tree's node rows."""
    rows = rows.sort_values("pre")
    return clade_of(*(rows[c] for c in ("node_id", "parent_id", "name", "branch_length")))


#: Letters of a block of columns, where a dataset's alignment has more than TASK_CELLS.
BLOCK_CELLS = 1_000_000


def column_blocks(aligned: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """dataset, block, id and seq: sequences cut into blocks of columns, so many columns that a dataset's block holds about cells letters, one at least."""
    sizes = aligned.groupBy("dataset").agg(F.greatest(F.floor(F.lit(cells) / F.count(F.lit(1))), F.lit(1)).alias("_width"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("_all"))
    sizes = sizes.select("dataset", "_width", F.greatest(F.ceil(F.col("_all") / F.col("_width")) - 1, F.lit(0)).alias("_last"))
    rows = aligned.select("dataset", "id", "seq").join(sizes, "dataset").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    return rows.select("dataset", "block", "id", F.substr("seq", (F.col("block") * F.col("_width") + 1).cast("int"), F.col("_width").cast("int")).alias("seq"))


def _with_blocks(nodes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Node rows (with dataset) for each block of their dataset's columns, the leaves with what their sequences have there; the tree alone is in every block."""
    blocks = pieces.select("dataset", "block").distinct()
    own = pieces.select("dataset", "block", F.col("id").alias("_leaf"), "seq")
    rows = nodes.join(blocks, "dataset", "left").withColumns({"block": F.coalesce("block", F.lit(0).cast("long")), "_leaf": F.when(F.col("is_terminal"), F.col("name"))})
    return rows.join(own, ["dataset", "block", "_leaf"], "left").drop("_leaf")


def _leaf_sequences(rows: pd.DataFrame) -> dict[str, str]:
    leaves = rows[rows["is_terminal"]]
    return dict(zip(leaves["name"], leaves["seq"]))


def climbed(nodes: DataFrame, aligned: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """Node rows (tree, dataset and the rest) after the climb of ``climb``, for alignments that no task holds.

    Changes are counted by column, so each block of columns scores every interchange of a round on its own, and the sums over the blocks tell the first that
    saves changes. The tree is in every task, the alignment in none. A round is saved; there is one for each interchange that the climb takes.
    """
    pieces = cut(column_blocks(aligned, cells))
    left, done = cut(nodes.select("dataset", *[f.name for f in nodes.schema if f.name != "dataset"])), None

    def gains(rows: pd.DataFrame) -> pd.DataFrame:
        clade, own = read_clade(rows), _leaf_sequences(rows)
        if Interchanges.fits(clade, own):
            scored = Interchanges(clade, own)
            out = [gain for c in scored.order() for gain, *_ in scored.gains(c)]
            return pd.DataFrame({"tree": rows["tree"].iloc[0], "at": np.arange(len(out)), "gain": np.array(out, np.int64)})
        score = Changes(clade, symbol_sets(own))
        start, out = score.total, []
        for changed in interchanges(clade):
            before = score.rescored(changed)
            out.append(score.total - start)
            score.restore(before)
        return pd.DataFrame({"tree": rows["tree"].iloc[0], "at": np.arange(len(out)), "gain": np.array(out, np.int64)})

    def moved(rows: pd.DataFrame) -> pd.DataFrame:
        clade = read_clade(rows)
        for at, _ in enumerate(interchanges(clade)):
            if at == rows["at"].iloc[0]:
                break  # the tree stays as it is now
        return node_rows(rows["tree"].iloc[0], clade).assign(dataset=rows["dataset"].iloc[0])

    while True:
        all_gains = _with_blocks(left, pieces).groupBy("tree", "block").applyInPandas(gains, "tree string, at long, gain long")
        first = cut(all_gains.groupBy("tree", "at").agg(F.sum("gain").alias("gain")).filter("gain < 0").groupBy("tree").agg(F.min("at").alias("at")))
        best = left.join(first, "tree", "left_anti")
        done = best if done is None else done.unionByName(best)
        if first.isEmpty():
            return done
        left = cut(left.join(first, "tree").groupBy("tree").applyInPandas(moved, "dataset string, " + NODE))


def parsimony_trees(aligned: DataFrame, methods: Sequence[str] = CLUSTERINGS, task_cells: int = TASK_CELLS, cells: int = BLOCK_CELLS) -> DataFrame:
    """Node rows of one tree per dataset and start method, named tree_{dataset}_{method}_parsimony.

    Datasets of more than task_cells letters start from ``distance_trees`` and climb in rounds by blocks of columns (``climbed``).
    """
    grid = F.explode(F.array(*map(F.lit, methods))).alias("method")

    def build(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        dataset, method = key
        return built(dataset, {"parsimony": f"tree_{dataset}_{method}_parsimony"}, rows, method)

    rows = aligned.select("dataset", "id", F.coalesce("seq", F.lit("")).alias("seq"))
    large = cut(rows.groupBy("dataset").agg((F.count(F.lit(1)) * F.max(F.length("seq"))).alias("n")).filter(F.col("n") > task_cells).select("dataset"))
    if large.isEmpty():
        return dealt(rows.select("*", grid), "dataset", "method", parts=LONG).groupBy("dataset", "method").applyInPandas(build, NODE)
    small = dealt(rows.join(large, "dataset", "left_anti").select("*", grid), "dataset", "method", parts=LONG).groupBy("dataset", "method").applyInPandas(build, NODE)
    own = cut(rows.join(large, "dataset"))
    start = identity_trees(own, methods)
    named = large.select("dataset", grid).select("dataset", F.concat_ws("_", F.lit("tree"), "dataset", "method").alias("tree"))
    spread = climbed(start.join(named, "tree"), own, cells).drop("dataset").withColumn("tree", F.concat("tree", F.lit("_parsimony")))
    return small.unionByName(spread)


#: Command lines of the public programs; {aln} is the alignment, {out} the prefix of what they write. The second entry is the tree's file.
PROGRAMS: dict[str, tuple[list[str], str]] = {
    "iqtree": (["iqtree2", "-s", "{aln}", "-m", "GTR+G", "-B", "1000", "-T", "AUTO", "--prefix", "{out}"], "{out}.treefile"),
    "fasttree": (["FastTree", "-nt", "-gtr", "-out", "{out}.tree", "{aln}"], "{out}.tree"),
    "raxml": (["raxml-ng", "--msa", "{aln}", "--model", "GTR+G", "--seed", "12345", "--tree", "rand{{10}}", "--prefix", "{out}"], "{out}.raxml.bestTree"),
    "mrbayes": (["mb", "{out}.nex"], "{out}.nex.con.tre"),
}


def nexus_alignment(ids: Sequence[str], seqs: Sequence[str], generations: int = 1_000_000) -> str:
    """An alignment with the commands of a Bayesian run."""
    width = max(map(len, seqs), default=0)
    rows = "\n".join(f"'{i}' {s}" for i, s in zip(ids, seqs))
    return (
        f"#NEXUS\nbegin data;\ndimensions ntax={len(ids)} nchar={width};\nformat datatype=dna missing=? gap=-;\nmatrix\n{rows}\n;\nend;\n"
        f"begin mrbayes;\nset autoclose=yes nowarn=yes;\nlset nst=6 rates=gamma;\nmcmc ngen={generations};\nsumt burnin=250;\nend;\n"
    )


def external_trees(aligned: DataFrame, method: str, name: str = "tree_{dataset}_{method}", timeout: int = 3600) -> DataFrame:
    """Node rows of one tree per dataset by an installed program; raises in the task where it is missing."""
    command, made = PROGRAMS[method]

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        if not shutil.which(command[0]):
            raise RuntimeError(f"{command[0]} is not installed on this worker")
        with tempfile.TemporaryDirectory() as at:  # the program's own files, within one task
            places = {"aln": f"{at}/own.fasta", "out": f"{at}/own"}
            Path(places["aln"]).write_text("".join(f">{i}\n{s}\n" for i, s in zip(rows["id"], rows["seq"])))
            Path(f"{at}/own.nex").write_text(nexus_alignment(rows["id"].tolist(), rows["seq"].tolist()))
            subprocess.run([c.format(**places) for c in command], capture_output=True, timeout=timeout, check=True)
            return node_rows(name.format(dataset=key[0], method=method), parse(read_text(Path(made.format(**places)).read_text())))

    return aligned.select("dataset", "id", "seq").groupBy("dataset").applyInPandas(run, NODE)


def grid_trees(seqs: DataFrame, grid: DataFrame, aligners: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """From sequences (dataset, pos, id, seq) to the named trees of a grid: each dataset is aligned by each of its aligners, then each method builds.

    aligners says how each name aligns; by default the native centre star stands in for all. Programs that are not installed raise.
    """
    names = [r["aligner"] for r in grid.select("aligner").distinct().collect()]  # a few names of programs
    given = dict(aligners or {})
    aligned = None
    for a in sorted(names):
        own = seqs.join(grid.filter(F.col("aligner") == a).select("dataset").distinct(), "dataset", "left_semi")
        made = given.get(a, align)(own).withColumn("aligner", F.lit(a))
        aligned = made if aligned is None else aligned.unionByName(made)
    own = grid.filter(~F.col("method").isin(*EXTERNAL))
    keys = ["dataset", "aligner", "submethod"]
    own = own.groupBy(*keys).agg(F.sort_array(F.collect_set("method")).alias("methods"))

    def build(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        dataset, aligner, sub = key
        return built(dataset, {m: tree_name((dataset, aligner, m, sub)) for m in rows["methods"].iloc[0]}, rows, sub)

    out = dealt(aligned.join(own, ["dataset", "aligner"]).select(*keys, "methods", "id", "seq"), *keys, parts=LONG).groupBy(*keys).applyInPandas(build, NODE)
    for r in sorted(map(tuple, grid.filter(F.col("method").isin(*EXTERNAL)).select("aligner", "method").distinct().collect())):
        part = aligned.filter(F.col("aligner") == r[0]).join(grid.filter((F.col("aligner") == r[0]) & (F.col("method") == r[1])).select("dataset"), "dataset", "left_semi")
        out = out.unionByName(external_trees(part, r[1], name=f"tree_{{dataset}}_{r[0]}_{{method}}"))
    return out


def registry_names(grid: DataFrame) -> DataFrame:
    """grid with name, {aligner}_{method}[_{submethod}]_{i}: i counts a name's trees from 1, by dataset. A dataset stands once under a name."""
    found = ranked(grid.withColumn("name", F.concat_ws("_", "aligner", "method", "submethod")), "name", ["dataset"], "_i")
    return found.withColumn("name", F.concat_ws("_", "name", F.col("_i").cast("string"))).drop("_i")


def parsimony_scores(nodes: DataFrame, aligned: DataFrame, trees: DataFrame, cells: int = BLOCK_CELLS) -> DataFrame:
    """tree and changes, for trees (tree, dataset): Fitch's count over the tree's own leaves, summed over blocks of columns. A leaf without a sequence raises."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "changes": [fitch(read_clade(rows), symbol_sets(_leaf_sequences(rows)))]})

    own = _with_blocks(nodes.join(trees, "tree"), column_blocks(aligned, cells))
    return own.groupBy("tree", "block").applyInPandas(score, "tree string, changes long").groupBy("tree").agg(F.sum("changes").alias("changes"))


def missing_trees(grid: DataFrame, built: DataFrame) -> DataFrame:
    """Rows of a grid whose trees are not built yet."""
    return grid.join(built.select("dataset", "aligner", "method", "submethod").distinct(), ["dataset", "aligner", "method", "submethod"], "left_anti")
