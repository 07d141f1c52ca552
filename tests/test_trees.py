import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import align, build, compare, graph, mining, trees
from canopy.sources import newick

THREE = [("tree_x_1", "((A,B),(C,(D,E)));"), ("tree_x_2", "((B,A),((E,D),C));"), ("tree_y_3", "((A,C),(B,(D,E)));")]


def nodes(spark, rows=THREE):
    return newick.to_nodes(spark.createDataFrame(rows, "tree string, text string"))


def test_newick_round_trip(spark):
    texts = dict([("t", "((A:1.00000,'B b':2.00000)x:0.50000,C:3.00000);"), ("u", "A;")])
    back = newick.to_newick(nodes(spark, list(texts.items()))).collect()
    assert {r.tree: r.text for r in back} == texts
    nexus = "#NEXUS\nbegin trees;\ntranslate 1 A, 2 B,\n 3 'C';\ntree con = [&U] (1:0.1[&x=1],(2,3));\nend;"
    assert newick.nexus_newick(nexus) == "(A:0.10000,(B,C));"


def test_deep_tree(spark):
    text = "(" * 3000 + "A" + ",B)" * 3000 + ";"
    assert newick.write(newick.parse(text)) == text
    assert len(newick.node_rows("t", newick.parse(text))) == 6001


def test_labels_and_clades(spark):
    rows = trees.clades(trees.label_internals(nodes(spark))).filter("tree = 'tree_x_1'").orderBy("pre").collect()
    assert [(r.subtree, r.terminals) for r in rows] == [
        ("tree_x_1_Inner4", ["A", "B", "C", "D", "E"]), ("tree_x_1_Inner1", ["A", "B"]), ("tree_x_1_Inner3", ["C", "D", "E"]), ("tree_x_1_Inner2", ["D", "E"])
    ]


def test_rf_and_quartets(spark):
    rf = {(r.tree_a, r.tree_b): r.rf for r in compare.rf_distances(nodes(spark)).collect()}
    assert rf == {("tree_x_1", "tree_x_2"): 0, ("tree_x_1", "tree_y_3"): 4, ("tree_x_2", "tree_y_3"): 4}
    positional = {(r.tree_a, r.tree_b): r.rf for r in compare.rf_distances(nodes(spark), positional=True).collect()}
    assert positional[("tree_x_1", "tree_x_2")] > 0  # places in each tree's own order
    q = {(r.tree_a, r.tree_b): r.quartet for r in compare.quartet_distances(nodes(spark)).collect()}
    assert q[("tree_x_1", "tree_x_2")] == 0 and q[("tree_x_1", "tree_y_3")] > 0
    assert compare.matrix(compare.rf_distances(nodes(spark))).count() == 9


def test_differences_against_sets(spark):
    """Elements of few, of most and of all trees, and trees without any pair."""
    rng = random.Random(11)
    sets = {(d, f"{d}_{t}"): {e for e in range(30) if rng.random() < e / 29} | {99} for d, n in (("x", 9), ("y", 2), ("z", 1), ("w", 4)) for t in range(n)}
    rows = spark.createDataFrame([(t, e) for (_, t), s in sets.items() for e in s], "tree string, clade int")
    datasets = spark.createDataFrame([(t, d) for d, t in sets], "tree string, dataset string")
    got = {(r.tree_a, r.tree_b): r.rf for r in compare.symmetric_difference(rows, datasets=datasets).collect()}
    assert got == {(a, b): len(sets[d, a] ^ sets[e, b]) for d, a in sets for e, b in sets if d == e and a < b}
    whole = compare.symmetric_difference(rows).count()
    assert whole == len(sets) * (len(sets) - 1) // 2


def test_supports(spark):
    rows = trees.subtrees(nodes(spark)).withColumn("base", F.lit("all"))
    found = mining.annotate(rows, mining.grid_supports(mining.item_counts(rows, "base", "tree", "item")))
    by = {tuple(sorted(r.terminals)): len(r.supports) for r in found.collect()}
    assert by[("D", "E")] == 10 and by[("A", "B")] == 6 and by[("A", "C")] == 3
    parity = trees.subtrees(nodes(spark), parity=True).filter("n_terminals = 2")
    assert parity.filter("terminals[0] in ('A', 'B') and terminals[1] in ('A', 'B')").select("item").distinct().count() == 2


def test_grid():
    assert [mining.exact_min_count(t, 10) for t in (0.3, 0.7)] == [3, 7]
    assert [mining.exact_min_count(0.30000000000000004, 10, True), mining.exact_min_count(0.7000000000000001, 10, True)] == [4, 8]


def test_maximal_sets_against_brute_force(spark):
    rng = random.Random(1)
    rows, expect = [], set()
    for g in range(25):
        sets = {f"t{i}": {x for x in "abcdefg" if rng.random() < 0.5} for i in range(rng.randint(1, 6))}
        rows += [(f"g{g}", t, x) for t, s in sets.items() for x in s]
        live = {t: s for t, s in sets.items() if s}
        need = mining.exact_min_count(0.4, len(live)) if live else 0
        frequent = [
            frozenset(c)
            for n in range(1, 8)
            for c in itertools.combinations("abcdefg", n)
            if live and sum(set(c) <= s for s in live.values()) >= max(need, 1)
        ]
        expect |= {(f"g{g}", "".join(sorted(f))) for f in frequent if not any(f < h for h in frequent)}
    df = spark.createDataFrame(rows, "g string, t string, x string")
    got = {(r.g, "".join(r["items"])) for r in mining.maximal_itemsets(df, 0.4, "g", "t", "x").collect()}
    assert got == expect


def test_histogram_of_one_value(spark):
    out = mining.histogram(spark.createDataFrame([(0.5,), (0.5,)], "v double"), "v").orderBy("bin").collect()
    assert len(out) == 10 and sum(r.n for r in out) == 2 and out[0].low == 0.0 and out[5].n == 2


def _leaf_distances(clade, prefix=0.0):
    if not clade.children:
        return {clade.name: prefix}, {}
    heights, pairs = [], {}
    for c in clade.children:
        h, p = _leaf_distances(c, c.branch_length or 0.0)
        pairs |= p
        for other in heights:
            pairs |= {frozenset((a, b)): x + y for a, x in h.items() for b, y in other.items()}
        heights.append(h)
    return {n: v + prefix for h in heights for n, v in h.items()}, pairs


def test_neighbour_joining_recovers_additive_distances():
    want = _leaf_distances(newick.parse("((A:1,B:2):1.5,(C:3,(D:0.5,E:1):2):0.5,F:4);"))[1]
    names = list("ABCDEF")
    d = np.array([[0 if a == b else want[frozenset((a, b))] for b in names] for a in names])
    got = _leaf_distances(build.agglomerate(names, d, "nj"))[1]
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_averaging_is_ultrametric():
    rng = np.random.default_rng(0)
    d = rng.random((7, 7))
    d = d + d.T
    np.fill_diagonal(d, 0)
    for weighted in (False, True):
        heights, _ = _leaf_distances(build.agglomerate(list("ABCDEFG"), d, "upgma", weighted))
        assert max(heights.values()) - min(heights.values()) < 1e-9


def test_small_trees():
    assert newick.write(build.agglomerate(["A"], np.zeros((1, 1)))) == "A;"
    assert newick.write(build.agglomerate(["A", "B"], np.array([[0, 1.0], [1.0, 0]]))) == "(A,B:1.00000);"


def test_parsimony(spark):
    clade = newick.parse("((A,B),(C,D));")
    states = build.symbol_sets({"A": "AAC", "B": "AGC", "C": "TGC", "D": "TGC"})
    assert build.fitch(clade, states) == 2
    worse = newick.parse("((A,C),(B,D));")
    _, score = build.climb(worse, {"A": "AAC", "B": "AAC", "C": "TGC", "D": "TGC"})
    assert score == 2
    aligned = spark.createDataFrame([("d", n, s) for n, s in zip("ABCD", ("AAC", "AGC", "TGC", "TGC"))], "dataset string, id string, seq string")
    made = build.parsimony_trees(aligned, ("nj",))
    scores = build.parsimony_scores(made, aligned, made.select("tree", F.lit("d").alias("dataset")).distinct())
    assert [r.changes for r in scores.collect()] == [2]


def test_alignment():
    score, a, b = align.pairwise("ACGT", "AGT")
    assert (score, a.replace("-", ""), b.replace("-", ""), len(a)) == (1, "ACGT", "AGT", len(b))
    rows = dict(align.centre_star(list("pqrs"), ["ACGTT", "AGTT", "ACGT", "CCACGTT"]))
    assert len({len(r) for r in rows.values()}) == 1 and {k: r.replace("-", "") for k, r in rows.items()} == dict(zip("pqrs", ["ACGTT", "AGTT", "ACGT", "CCACGTT"]))


def test_graph(spark):
    rows = trees.subtrees(nodes(spark)).withColumn("supports", F.array(F.lit(0.5)))
    lines = [r.value for r in graph.statements(rows).collect()]
    assert len(lines) == 3 + 12 + 12 and lines[0].startswith("MERGE (u:User")
    assert graph.edges(rows).filter("rel = 'HAS_SUBTREE'").count() == 12


def test_closure(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(200)], "parent string, child string")
    found = trees.closure(edges).collect()
    assert len(found) == 200 * 201 // 2 and all(int(r.descendant) - int(r.ancestor) == r.distance for r in found)
    several = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")], "parent string, child string")
    assert {tuple(r) for r in trees.closure(several).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("x", "d", 1), ("b", "d", 2), ("a", "d", 2)}
    with pytest.raises(ValueError):
        trees.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string"))
    assert trees.closure(edges.limit(0)).count() == 0


def random_clade(rng, names):
    if len(names) == 1:
        return newick.Clade(name=names[0])
    cuts = sorted(rng.sample(range(1, len(names)), min(len(names) - 1, rng.choice([1, 1, 2, 3]))))
    return newick.Clade(children=[random_clade(rng, names[a:b]) for a, b in zip([0, *cuts], [*cuts, len(names)])])


def leaves(c):
    return [n for x in c.children for n in leaves(x)] if c.children else [c.name]


def test_clades_of_random_trees(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for t in range(12):
        names = [f"x{i}" for i in range(rng.randint(1, 40))]
        rng.shuffle(names)
        clade = random_clade(rng, names)
        rows.append((f"t_{t}", newick.write(clade)))
        todo = [clade]
        while todo:
            c = todo.pop()
            todo += c.children
            if len(leaves(c)) > 1:
                want.setdefault(f"t_{t}", []).append(tuple(leaves(c)))
    table = nodes(spark, rows)
    got: dict = {}
    for r in trees.clades(table).collect():
        assert r.n_terminals == len(r.terminals)
        got.setdefault(r.tree, []).append(tuple(r.terminals))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    # each clade as a tree of its own, read back
    own = {r.tree: r.text for r in newick.to_newick(trees.clade_nodes(table)).collect()}
    assert sorted(tuple(leaves(newick.parse(x))) for x in own.values()) == sorted(x for v in want.values() for x in v)
    again = newick.to_nodes(spark.createDataFrame(list(own.items()), "tree string, text string")).select("tree", "name", "pre", "post", "depth")
    assert again.exceptAll(trees.clade_nodes(table).select(again.columns)).count() == 0


def test_single_linkage_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"d{k}", f"p{i}", f"p{j}", float(rng.randint(1, 9))) for k in range(6) for i in range(k + 2) for j in range(i)]
    got: dict = {}
    for r in trees.single_linkage(spark.createDataFrame(rows, "dataset string, a string, b string, distance double")).orderBy("dataset", "step").collect():
        got.setdefault(r.dataset, []).append((r.height, r["size"]))
    for k in range(6):
        own = {(a, b): d for s, a, b, d in rows if s == f"d{k}"}
        clusters, heights = [{f"p{i}"} for i in range(k + 2)], []
        while len(clusters) > 1:
            apart = lambda x, y: min(d for (a, b), d in own.items() if (a in x and b in y) or (a in y and b in x))  # noqa: E731, B023
            height, i, j = min((apart(clusters[i], clusters[j]), i, j) for i in range(len(clusters)) for j in range(i))
            clusters[j] |= clusters.pop(i)
            heights.append(height)
        assert [h for h, _ in got[f"d{k}"]] == heights and got[f"d{k}"][-1][1] == k + 2


def test_alignment_in_blocks(spark, monkeypatch):
    """Scored by pairs of blocks and laid one by one, alignments are those of one sequence after the other."""
    monkeypatch.setattr(align, "BLOCK_ROWS", 3)
    rng = random.Random(10)
    rows = []
    for d, n in (("a", 1), ("b", 2), ("c", 9), (None, 4)):
        base = "".join(rng.choices("ACGT", k=20))
        for i in range(n):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t)) :][:1] = []
                t.insert(rng.randint(0, len(t)), rng.choice(["A", "GG", ""]))
            rows.append((d, i, f"s{i}", "".join(t)))
    rows.append(("c", 20, "none", None))
    got: dict = {}
    for r in align.align(spark.createDataFrame(rows, "dataset string, pos long, id string, seq string").repartition(3)).collect():
        got.setdefault(r.dataset, {})[r.id] = r.seq
    for d in ("a", "b", "c", None):
        own = [r for r in rows if r[0] == d]
        assert got[d] == dict(align.centre_star([r[2] for r in own], [r[3] or "" for r in own]))


def test_flags_of_an_installed_program(spark, tmp_path, monkeypatch):
    """A stand-in program shows what it was called with, as the sequence of each record."""
    fake = tmp_path / "clustalo"
    fake.write_text("#!/bin/sh\nargs=$(echo \"$@\" | tr ' ' '_')\ngrep '>' | while read name; do echo \"$name\"; echo \"$args\"; done\n")
    fake.chmod(0o755)
    monkeypatch.setitem(align.COMMANDS, "clustalo", [str(fake), *align.COMMANDS["clustalo"][1:]])
    many = spark.range(5003).select(F.lit("many").alias("dataset"), F.col("id").alias("pos"), F.concat(F.lit("m"), "id").alias("id"), F.lit("ACGT").alias("seq"))
    few = spark.createDataFrame([("few", 0, "a", "AC"), ("few", 1, "b", "A")], "dataset string, pos long, id string, seq string")
    got: dict = {}
    for r in align.external(align.prepared(many.union(few), 6), "clustalo", threads=3).collect():
        got.setdefault(r.dataset, {})[r.id] = r.seq
    assert set(got["few"]) == {"a", "b"} and got["few"]["a"].endswith("--threads_3") and len(got["many"]) == 6
    assert all(v.endswith("--threads_3_--max-guidetree-iterations_1_--max-hmm-iterations_1") for v in got["many"].values())
    assert align.prepared(few, 1, force_subsample=True).count() == 1


def test_parsimony_of_many_symbols():
    sequences = {n: "".join(chr(200 + (i * k) % 90) for i in range(90)) for n, k in zip("ABCD", (1, 1, 7, 7))}
    assert build.fitch(newick.parse("((A,B),(C,D));"), build.symbol_sets(sequences)) == sum(a != b for a, b in zip(sequences["A"], sequences["C"]))


def test_spanning_trees_give_the_same_linkage(spark):
    rng = random.Random(8)
    rows = [(f"d{k}", f"p{i:02d}", f"p{j:02d}", float(rng.randint(1, 12))) for k, n in enumerate((2, 3, 17, 40)) for i in range(n) for j in range(i)]
    rows += [("apart", "a", "b", 1.0), ("apart", "c", "d", 1.0), ("same", "x", "x", 0.0)]
    df = spark.createDataFrame(rows, "dataset string, a string, b string, distance double")
    small, large = (sorted(map(tuple, trees.single_linkage(df, task_pairs=n).collect())) for n in (trees.TASK_PAIRS, 2))
    assert small == large and len(small) == 1 + 2 + 16 + 39 + 2


def test_averaging_in_rounds(spark):
    """Datasets that are averaged in rounds of rows have the trees of one merge after the other."""
    rng = random.Random(9)
    rows = [(f"d{k}", f"p{i:02d}", f"p{j:02d}", rng.random() + 0.1) for k, n in enumerate((2, 9, 25)) for j in range(n) for i in range(j)]
    df = spark.createDataFrame(rows, "dataset string, id_a string, id_b string, dist double")
    members = spark.createDataFrame(sorted({(r[0], x) for r in rows for x in r[1:3]}) + [("one", "z")], "dataset string, id string")
    for weighted in (False, True):
        one, many = ({(r.tree, r.pre): (r.name, r.parent_id, r.is_terminal, round(r.branch_length, 9) if r.branch_length is not None else None) for r in build.distance_trees(df, ("upgma",), weighted, members, n).collect()} for n in (1000, 3))
        assert one == many and len({t for t, _ in one}) == 4
    with pytest.raises(ValueError, match="twice"):
        build.distance_trees(df, ("upgma",), False, members.union(members), 3)


def test_distances_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"d{k}", f"s{i:03d}", "".join(rng.choice("ACG-é") for _ in range(17))) for k, n in enumerate((1, 2, 40)) for i in range(n)] + [("empty", "a", ""), ("empty", "b", "")]
    df = spark.createDataFrame(rows, "dataset string, id string, seq string").repartition(3)
    want = {(d, a, b): sum(x != y for x, y in zip(s, t)) / max(len(s), 1) for d, a, s in rows for e, b, t in rows if d == e and a < b}
    for size in (7, 512):
        monkeypatch.setattr(build, "BLOCK_ROWS", size)
        got = {(r.dataset, r.id_a, r.id_b): r.dist for r in build.identity_distances(df).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_distances_leave_tasks_as_lists(spark, monkeypatch):
    seqs = {f"s{i:02d}": "".join(random.Random(i).choices("AC", k=1024)) for i in range(30)} | {"half": "A" * 1023 + "C", "zero": "A" * 1024}
    df = spark.createDataFrame([("d", i, s) for i, s in seqs.items()], "dataset string, id string, seq string")
    monkeypatch.setattr(build, "BLOCK_ROWS", 10)
    monkeypatch.setattr(build, "LISTED", 25)
    made = build.identity_distances(df, digits=9)
    got = {(r.id_a, r.id_b): r.dist for r in made.collect()}
    assert len(got) == 32 * 31 // 2 and got["half", "zero"] == 0.000976563  # 1/1024, whose half goes up
    assert got == {(r.id_a, r.id_b): r.dist for r in build.identity_distances(df).select("id_a", "id_b", F.round("dist", 9).alias("dist")).collect()}
    assert "posexplode" in made._jdf.queryExecution().toString()


def test_datasets_of_one_sequence(spark):
    aligned = spark.createDataFrame([("one", "a", "AC"), ("two", "a", "AC"), ("two", "b", "AG")], "dataset string, id string, seq string")
    made = build.distance_trees(build.identity_distances(aligned), members=aligned)
    assert {r.tree: r.n for r in made.filter("is_terminal").groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()} == {"tree_one_nj": 1, "tree_one_upgma": 1, "tree_two_nj": 2, "tree_two_upgma": 2}
    twice = aligned.union(aligned.filter("id = 'b'"))
    with pytest.raises(Exception, match="twice"):
        build.distance_trees(build.identity_distances(twice), members=twice).count()


def test_climb_keeps_count(monkeypatch):
    """Interchanges scored on their way to the root are as the whole tree scored anew, and no better neighbour is left."""
    rng = random.Random(6)
    for n in (4, 5, 9, 14):
        seqs = {f"s{i}": "".join(rng.choice("ACGT") for _ in range(12)) for i in range(n)}
        states = build.symbol_sets(seqs)
        clade = random_clade(rng, list(seqs))
        score = build.Changes(clade, states)
        for changed in build.interchanges(clade):
            before, total = score.rescored(changed), score.total
            assert total == build.fitch(clade, states)
            score.restore(before)
        assert score.total == build.fitch(clade, states)
        best, found = build.climb(clade, seqs)
        assert found == build.fitch(best, states) and not any(build.fitch(best, states) < found for _ in build.interchanges(best)) and sorted(leaves(best)) == sorted(seqs)


def test_deep_trees_are_scored():
    text = "(" * 3000 + "A" + ",B)" * 3000 + ";"
    assert build.fitch(newick.parse(text), build.symbol_sets({"A": "AC", "B": "AG"})) == 1


def test_single_mode_and_programs(spark):
    datasets = spark.createDataFrame([("d",)], "dataset string")
    one = lambda *x: [tuple(r) for r in build.method_grid(datasets, "single", single=x).collect()]
    assert one("mafft", "nj", None) == [("d", "mafft", "distance", "nj")] and one("clustalo", "parsimony", "upgma") == [("d", "clustalo", "parsimony", "upgma")]
    assert one("mafft", "iqtree", "nj") == [("d", "mafft", "iqtree", None)]
    with pytest.raises(ValueError):
        one("mafft", "other", None)
    with pytest.raises(ValueError):
        build.method_grid(datasets, "else")
    aligned = spark.createDataFrame([("d", "a", "AC"), ("d", "b", "AG")], "dataset string, id string, seq string")
    for method in build.EXTERNAL:
        with pytest.raises(Exception, match="not installed"):
            build.external_trees(aligned, method).count()
    assert "ntax=2 nchar=2" in build.nexus_alignment(["a", "b"], ["AC", "AG"])


def test_grid_trees(spark):
    seqs = spark.createDataFrame([("d", 0, "a", "ACGTT"), ("d", 1, "b", "AGTT"), ("d", 2, "c", "ACGT"), ("e", 0, "x", "AA")], "dataset string, pos long, id string, seq string")
    made = build.grid_trees(seqs, build.method_grid(seqs, "auto", "clustalo").filter("aligner = 'mafft'"))
    names = {r.tree for r in made.select("tree").distinct().collect()}
    assert names == {f"tree_{d}_mafft_{c}_{m}" for d in "de" for c in ("nj", "upgma") for m in ("distance", "parsimony")}
    assert made.filter("is_terminal").count() == 16


def test_maximal_sets_of_many_transactions(spark):
    rng = random.Random(7)
    sets = {f"t{i:03d}": {x for x in "abcdefgh" if rng.random() < 0.7} for i in range(150)}
    df = spark.createDataFrame([("g", t, x) for t, s in sets.items() for x in s], "g string, t string, x string")
    live = [s for s in sets.values() if s]
    for threshold in (0.3, 1 / 3, 0.6):
        need = mining.exact_min_count(threshold, len(live))
        frequent = [frozenset(c) for n in range(1, 9) for c in itertools.combinations("abcdefgh", n) if sum(set(c) <= s for s in live) >= need]
        want = {"".join(sorted(f)): sum(f <= s for s in live) for f in frequent if not any(f < h for h in frequent)}
        # in one task, in rounds of rows, and in rounds whose last nodes are finished in tasks
        for cells in (mining.TASK_CELLS, *(0, 200) * (threshold == 0.6)):
            assert {"".join(r["items"]): r.n for r in mining.maximal_itemsets(df, threshold, "g", "t", "x", cells).collect()} == want
    assert mining.maximal_itemsets(df.limit(0), 0.5, "g", "t", "x").count() == 0


def test_maximal_sets_of_a_long_tail(spark):
    """A million items of one transaction each, of which none is frequent, and items of the same transactions, which stay together."""
    tail = spark.range(1_000_000).select(F.lit("g").alias("g"), F.concat(F.lit("t"), F.col("id") % 20).alias("t"), F.concat(F.lit("x"), "id").alias("x"))
    often = spark.range(60).select(F.lit("g").alias("g"), F.concat(F.lit("t"), F.col("id") % 20).alias("t"), F.concat(F.lit("often"), F.col("id") % 3).alias("x"))
    got = mining.maximal_itemsets(tail.union(often), 0.3, "g", "t", "x").collect()
    assert [(r["items"], r.n, r.support) for r in got] == [(["often0", "often1", "often2"], 20, 1.0)]


def test_thresholds_off_the_tenths(spark):
    counts = spark.createDataFrame([("g", "x", 5, 20), ("g", "y", 4, 20), ("h", "x", 2, 3)], "g string, item string, n long, rows long")
    got = {(r.g, r["item"]): list(r.supports) for r in mining.grid_supports(counts, [0.15, 0.25, 2 / 3]).collect()}
    assert got == {("g", "x"): [0.15, 0.25], ("g", "y"): [0.15], ("h", "x"): [0.15, 0.25, 2 / 3]}


def test_statements_cannot_be_broken_out_of(spark):
    name = "t\\' }) DETACH DELETE n //"
    rows = spark.createDataFrame([(name, "s'\n\\", [0.5])], "tree string, subtree string, supports array<double>")
    for r in graph.statements(rows, "u\\'x").collect():
        assert "\n" not in r.value
        outside = re.sub(r"'(?:[^'\\]|\\.)*'", "''", r.value)
        assert "'" not in outside.replace("''", "") and "DETACH" not in outside and "\\" not in outside
