"""Trees of datasets that no task holds, against those that are built in one."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import build, steps
from canopy.operators.steps import ranked
from canopy.plans import registry, tree_queries
from canopy.sources import newick
from tests.conftest import DATA
from tests.test_trees import leaves, random_clade


def parted(clade, names):
    """The ways in which a tree's edges part its leaves: the sides without the first name, with their lengths (of a root of two the sum)."""
    out, todo = {}, [(c, c.branch_length or 0.0) for c in clade.children]
    while todo:
        c, length = todo.pop()
        own = frozenset(leaves(c))
        side = frozenset(names) - own if min(names) in own else own
        out[side] = out.get(side, 0.0) + length
        todo += [(x, x.branch_length or 0.0) for x in c.children]
    return out


def lengths(rng, clade):
    for c in clade.children:
        c.branch_length = float(rng.randint(1, 9))
        lengths(rng, c)


def below(clade):
    """The distances from a clade to its leaves, and between them."""
    if not clade.children:
        return {clade.name: 0.0}, {}
    far, between = {}, {}
    for c in clade.children:
        own, inner = below(c)
        own = {n: d + c.branch_length for n, d in own.items()}
        between |= inner | {(min(a, b), max(a, b)): d + e for a, d in far.items() for b, e in own.items()}
        far |= own
    return far, between


def tables(spark, trees):
    rows = [(name, a, b, d) for name, clade in trees.items() for (a, b), d in below(clade)[1].items()]
    return spark.createDataFrame(rows, "dataset string, id_a string, id_b string, dist double")


def read(nodes):
    frame = nodes.toPandas()
    return {name: build.read_clade(part) for name, part in frame.groupby("tree")}


def test_joining_in_rounds_finds_the_tree_of_its_distances(spark):
    rng = random.Random(11)
    trees = {}
    for n in (2, 3, 4, 5, 8, 17):
        trees[f"d{n}"] = random_clade(rng, [f"s{i:02}" for i in range(n)])
        lengths(rng, trees[f"d{n}"])
    made = read(build.distance_trees(tables(spark, trees), ("nj",), task_joined=1))
    assert made.keys() == {f"tree_{d}_nj" for d in trees}
    for d, clade in trees.items():
        names = leaves(clade)
        want, got = parted(clade, names), parted(made[f"tree_{d}_nj"], names)
        want, got = ({k: v for k, v in x.items() if k and len(names) > 2 and v > 1e-6} for x in (want, got))  # nodes of many children come in steps of no length
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_joining_a_comb(spark):
    text = "s00:1"
    for i in range(1, 12):
        text = f"({text},s{i:02}:{1 + i % 3}):1"
    clade = newick.parse(text + ";")
    made = read(build.distance_trees(tables(spark, {"d": clade}), ("nj",), task_joined=1))["tree_d_nj"]
    assert parted(made, leaves(clade)).keys() == parted(clade, leaves(clade)).keys()


def test_methods_and_sizes_choose_their_way(spark, monkeypatch):
    """Only datasets beyond a method's limit take rounds, and ids that stand twice raise there, too."""
    rng = random.Random(5)
    trees = {f"d{n}": random_clade(rng, [f"s{i:02}" for i in range(n)]) for n in (3, 6, 9)}
    for clade in trees.values():
        lengths(rng, clade)
    distances, seen = tables(spark, trees), {}
    for name in ("joining_merges", "averaging_merges"):
        real = getattr(build, name)
        monkeypatch.setattr(build, name, lambda d, *more, _real=real, _name=name: (seen.__setitem__(_name, sorted(r.dataset for r in d.select("dataset").distinct().collect())), _real(d, *more))[1])
    made = build.distance_trees(distances, task_members=4, task_joined=7)
    assert made.select("tree").distinct().count() == 6 and seen == {"joining_merges": ["d9"], "averaging_merges": ["d3", "d6", "d9"][1:]}
    members = spark.createDataFrame([("d9", "s00"), ("d9", "s00")], "dataset string, id string")
    with pytest.raises(ValueError, match="twice"):
        build.distance_trees(distances, ("nj",), members=members, task_joined=4)
    assert build.distance_trees(distances.limit(0), task_members=1, task_joined=1).isEmpty()


def test_climb_in_rounds_is_the_climb(spark):
    """The same steps as in one task, whatever the blocks of columns; several trees at once, some of which are best from the start."""
    rng = random.Random(3)
    nodes, rows, want = None, [], {}
    for n, width in ((1, 3), (2, 5), (5, 9), (9, 14), (12, 6)):
        seqs = {f"s{i:02}": "".join(rng.choice("ACGT-") for _ in range(width)) for i in range(n)}
        clade = random_clade(rng, list(seqs))
        own = spark.createDataFrame(newick.node_rows(f"t{n}", clade).astype({"parent_id": object}).where(lambda d: d.notna(), None), newick.NODE).withColumn("dataset", F.lit(f"d{n}"))
        nodes = own if nodes is None else nodes.unionByName(own)
        rows += [(f"d{n}", i, s) for i, s in seqs.items()]
        want[f"t{n}"] = build.climb(clade, seqs)
    aligned = spark.createDataFrame(rows, "dataset string, id string, seq string")
    for cells in (1, 40):
        made = build.climbed(nodes, aligned, cells)
        scores = {r.tree: r.changes for r in build.parsimony_scores(made.drop("dataset"), aligned, made.select("tree", "dataset").distinct(), cells).collect()}
        assert scores == {t: n for t, (_, n) in want.items()}
        assert {t: newick.write(c) for t, c in read(made).items()} == {t: newick.write(c) for t, (c, _) in want.items()}


def test_parsimony_trees_by_size(spark):
    rng = random.Random(8)
    rows = [(d, f"s{i:02}", "".join(rng.choice("ACGT") for _ in range(10))) for d, n in (("small", 4), ("large", 11)) for i in range(n)]
    aligned = spark.createDataFrame(rows, "dataset string, id string, seq string")
    one, rounds = (build.parsimony_trees(aligned, task_cells=most, cells=30) for most in (10_000, 50))
    assert {t: newick.write(c) for t, c in read(one).items()} == {t: newick.write(c) for t, c in read(rounds).items()}
    assert build.parsimony_trees(aligned.limit(0)).isEmpty()


def test_column_blocks(spark):
    aligned = spark.createDataFrame([("d", "a", "ACGTA"), ("d", "b", "CCGTT"), ("e", "a", ""), ("f", "a", None)], "dataset string, id string, seq string")
    got = {(r.dataset, r.block, r.id): r.seq for r in build.column_blocks(aligned, 4).collect()}
    assert got == {("d", 0, "a"): "AC", ("d", 1, "a"): "GT", ("d", 2, "a"): "A", ("d", 0, "b"): "CC", ("d", 1, "b"): "GT", ("d", 2, "b"): "T", ("e", 0, "a"): "", ("f", 0, "a"): None}


def test_ranks_by_ranges(spark):
    """One key holds most rows, one is null, and the ranges part all of them."""
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit("few")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.lit("many")).alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    got = ranked(rows, "k", ["v"], "place").collect()
    for k in ("few", None, "many"):
        own = sorted((r.v, r.place) for r in got if r.k == k)
        assert own and [p for _, p in own] == list(range(1, len(own) + 1))
    assert len(got) == 3000 and ranked(rows.limit(0), "k", ["v"], "place").isEmpty()


def test_trees_spread_and_are_built_once(spark):
    """Groups of few bytes are dealt to several tasks for each core, in both ways, and what reads a tree's nodes several times reads saved ones."""
    rng = random.Random(6)
    clade = random_clade(rng, [f"s{i:02}" for i in range(9)])
    lengths(rng, clade)
    for method in ("nj", "upgma"):
        for most in (1000, 3):
            made = build.distance_trees(tables(spark, {"d": clade}), (method,), task_members=most, task_joined=most)
            assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().toString()
    found = registry.QUERIES["upgma_splits"](spark, str(DATA / "sf0.001"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()


def test_parts_grow_with_rows(spark, monkeypatch):
    """What a task of item_counts holds is bounded by rows, not by a fixed number of partitions."""
    monkeypatch.setattr(steps, "PART_ROWS", 50)
    own = tree_queries.purchases(spark, str(DATA / "sf0.001"))
    n = spark.read.parquet(str(DATA / "sf0.001/lineitem.parquet")).count()
    assert own.rdd.getNumPartitions() == -(-n // 50) and own.count() == n


def test_rounds_and_clades_broadcast_no_rows_of_clusters(spark, monkeypatch):
    """Saved tables are small as files, and were broadcast by the driver however many rows they held."""
    plans = []
    kept = steps.cut

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(build, "cut", cut)
    rows = spark.createDataFrame([("d", f"s{i}", f"s{j}", float((i ^ j).bit_length())) for j in range(8) for i in range(j)], "dataset string, id_a string, id_b string, dist double")
    assert build.averaging_merges(rows).count() == build.joining_merges(rows).count() == 7
    nodes = kept(build.distance_trees(rows, ("upgma",), task_members=3))
    members = spark.createDataFrame([("d", f"s{i}") for i in range(8)], "dataset string, id string")
    plans.append(tree_queries._splits(nodes, members)._jdf.queryExecution().executedPlan().toString())
    joined = [p for p in plans if "MergeJoin" in p]
    assert len(joined) > 3 and not any("BroadcastHashJoin" in p for p in joined)
