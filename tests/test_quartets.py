import itertools
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import compare
from canopy.sources import newick

NAMES = [f"L{i:03d}" for i in range(400)]


def brute(cells, weights):
    """Sum of a product of weights over cells of distinct rows and columns."""
    total = 0
    for own in itertools.permutations(cells, len(weights)):
        if len({r for r, _ in own}) == len({c for _, c in own}) == len(weights):
            product = 1
            for w, key in zip(weights, own):
                product *= cells[key][w]
            total += product
    return total


def test_placements(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for t in range(6):
        cells = {(r, c): {w: rng.randint(0, 4) for w in "abc"} for r in range(rng.randint(1, 4)) for c in range(rng.randint(1, 3)) if rng.random() < 0.8} or {(0, 0): {"a": 1, "b": 2, "c": 3}}
        rows += [("x", "y", f"c{t}", r, c, v["a"], v["b"], v["c"]) for (r, c), v in cells.items()]
        want[f"c{t}"] = (brute(cells, "aa"), brute(cells, "ba"), brute(cells, "baa"), brute(cells, "aaa"), brute(cells, "aaaa"))
    df = spark.createDataFrame(rows, "tree_a string, tree_b string, clade string, row int, column int, a long, b long, c long")
    sums = {"p": "aa", "q": "ba", "r": "baa", "s": "aaa", "t": "aaaa"}
    got = compare.placed_sums(df, {k: [(1, tuple(w))] for k, w in sums.items()})
    assert {r.clade: tuple(int(r[k]) for k in sums) for r in got.collect()} == want


def grown(rng, names, most):
    """A random tree: clades of up to most children, some with a single one."""
    clades = [newick.Clade(name=n) for n in names]
    while len(clades) > 1:
        own = [clades.pop(rng.randrange(len(clades))) for _ in range(min(len(clades), rng.randint(2, most)))]
        clades.append(newick.Clade(children=own))
        if rng.random() < 0.15:
            clades[-1] = newick.Clade(children=[clades[-1]])
    return clades[0]


def swapped(rng, tree, times):
    """tree with some leaves' names exchanged."""
    text = newick.write(tree)
    for _ in range(times):
        a, b = rng.sample(sorted(set(part.strip("(,;)") for part in text.replace(",", " ").replace(")", " ").replace("(", " ").split() if part.startswith("L"))), 2)
        text = text.replace(a, "@").replace(b, a).replace("@", b)
    return text


def forest(spark, texts):
    return newick.to_nodes(spark.createDataFrame(texts, "tree string, text string"))


def test_against_signatures(spark):
    rng = random.Random(5)
    texts = []
    for d in range(6):
        n = rng.randint(5, 20)
        first = grown(rng, NAMES[:n], rng.choice([2, 3, 6]))
        texts += [(f"d{d}_a", newick.write(first)), (f"d{d}_b", swapped(rng, first, 1)), (f"d{d}_c", newick.write(grown(rng, NAMES[2 : n + 2], 3)))]
    texts += [("small_a", "(L001,L002);"), ("small_b", "(L001,(L002,L003));"), ("star_a", "(L1,L2,L3,L4,L5,L6);"), ("star_b", "(L2,L1,L3,L4,L6,L5);"), ("star_c", "((L1,L2,L3),(L4,L5,L6));")]
    nodes = forest(spark, texts)
    datasets = nodes.select("tree", F.substring_index("tree", "_", 1).alias("dataset")).distinct()
    want = compare.symmetric_difference(compare.quartets(nodes), element="signature", name="quartet", datasets=datasets)
    expected = {(r.tree_a, r.tree_b): r.quartet for r in want.collect()}
    # trees of three leaves or fewer have no quartets, and no signatures
    got = {(r.tree_a, r.tree_b): r.quartet for r in compare.quartet_distances(nodes, datasets).collect()}
    assert got.pop(("small_a", "small_b")) == 0 and got == expected
    assert len({v for v in got.values()}) > 5


@pytest.mark.parametrize("n", [200])
def test_large_trees(spark, n):
    """Trees of 200 leaves: 65 million fours each, told without listing any."""
    rng = random.Random(6)
    tree = grown(rng, NAMES[:n], 2)
    moved = newick.write(tree).replace("L000", "@").replace("L001", "L000").replace("@", "L001")
    got = {(r.tree_a, r.tree_b): r.quartet for r in compare.quartet_distances(forest(spark, [("a", newick.write(tree)), ("b", newick.write(tree)), ("c", moved)])).collect()}
    assert got[("a", "b")] == 0 and 0 < got[("a", "c")] == got[("b", "c")] <= 2 * (n * (n - 1) * (n - 2) * (n - 3) // 24)
