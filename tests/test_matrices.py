"""Spanning trees and merges on packed symbols and one matrix, against all pairs and the rounds of rows."""

import random

import pytest

from canopy.operators import build, profiles, trees
from canopy.operators.matrices import averaged, joined
from canopy.operators.profiles import profile_merges
from canopy.plans import registry
from canopy.sources import newick
from tests.test_entry import SF


def sequences(rng, sizes, width=12, letters="ACGT"):
    """Rows (dataset, id, seq) with copies and near copies, whose distances are often equal."""
    rows = []
    for d, n in sizes.items():
        base = ["".join(rng.choice(letters) for _ in range(width)) for _ in range(max(n // 2, 1))]
        rows += [(d, f"s{i:03}", rng.choice(base)[:-1] + rng.choice(letters)) for i in range(n)]
    return rows


SCHEMA = "dataset string, id string, seq string"


def test_linkage_of_spanning_distances_is_that_of_all_pairs(spark):
    """The same merges, clusters and sizes with two or many blocks, and fewer pairs than all."""
    rng = random.Random(4)
    rows = sequences(rng, {"a": 60, "b": 7, "c": 1, "d": 2}) + [("e", f"s{i}", "") for i in range(3)] + [("f", f"s{i}", None if i else "") for i in range(3)]
    aligned = spark.createDataFrame(rows, SCHEMA)
    link = lambda pairs: sorted(map(tuple, trees.single_linkage(pairs.selectExpr("dataset", "id_a as a", "id_b as b", "dist as distance")).collect()))
    want = link(build.identity_distances(aligned))
    for most in (1000, 7, 3):
        pairs = build.spanning_distances(aligned, most)
        assert link(pairs) == want
    assert build.spanning_distances(aligned).count() == sum(n - 1 for n in (60, 7, 1, 2, 3, 3))
    assert build.spanning_distances(aligned.limit(0)).isEmpty()


def test_difference_counts_columns():
    rng = random.Random(2)
    for letters in ("A", "AC", "ACGT-", "".join(map(chr, range(40, 110))), "".join(map(chr, range(0x4E00, 0x4E00 + 400)))):
        a, b = (["".join(rng.choice(letters) for _ in range(rng.choice((0, 5, 9)))) for _ in range(6)] for _ in range(2))
        want = [[1 - sum(p == q for p, q in zip(x, y)) / len(x) if x else 0.0 for y in b] for x in a]
        assert build.difference(a, b).tolist() == want


def written(nodes):
    frame = nodes.toPandas()
    return {name: newick.write(build.read_clade(part)).replace("-0.00000", "0.00000") for name, part in frame.groupby("tree")}  # rounded either way


def test_trees_of_a_matrix_are_those_of_rows(spark):
    """Names, order and lengths, in a task, by the rounds' merges on the matrix, and by rounds of rows; many distances are equal."""
    rng = random.Random(9)
    rows = sequences(rng, {"a": 33, "b": 6, "c": 1, "d": 2, "e": 3}, 14)
    aligned = spark.createDataFrame(rows, SCHEMA)
    for weighted in (False, True):
        for most in (1000, 4):
            want = written(build.distance_trees(build.identity_distances(aligned), weighted=weighted, members=aligned, task_members=most, task_joined=most))
            assert len(want) == 10
            for held in (1000, 5):
                assert written(build.identity_trees(aligned, weighted=weighted, task_members=most, task_joined=most, matrix_members=held)) == want
    twice = aligned.union(aligned.filter("dataset = 'd'"))
    with pytest.raises(Exception, match="twice"):
        build.identity_trees(twice).count()
    assert build.identity_trees(aligned.limit(0)).isEmpty()


def test_no_rows_of_pairs(spark, monkeypatch):
    """Trees of identity distances are built without a row for each two sequences."""
    monkeypatch.setattr(build, "identity_distances", lambda *_: pytest.fail("all pairs as rows"))
    for name in ("nj_tree", "upgma_tree", "parsimony_score", "identity_linkage"):
        assert not registry.QUERIES[name](spark, SF).isEmpty()


def test_merges_of_profiles_are_those_of_the_matrix():
    """Merges, names and lengths without a matrix, with copies and many equal distances; widths are powers of two, so that equal distances are equal numbers both ways."""
    rng = random.Random(5)
    for n, width, letters, kinds in ((2, 4, "AC", 1), (3, 8, "AC", 1), (9, 1, "ACGT", 9), (60, 16, "ACGT", 5), (60, 64, "ACGT", 60), (300, 32, "0123456789abcdef", 300), (300, 8, "ACGT", 40), (40, 0, "A", 1)):
        base = ["".join(rng.choice(letters) for _ in range(width)) for _ in range(kinds)]
        seqs = [(rng.choice(base)[:-1] + rng.choice(letters)) if width and kinds < n else b for b in (base * n)[:n]]
        names = [f"s{i:03}" for i in range(n)]
        for method, merges in (("upgma", averaged), ("nj", joined)):
            both = [made.assign(dataset="d") for made in (merges(names, build.difference(seqs, seqs)), profile_merges(names, seqs, method))]
            want, got = (newick.write(build.read_clade((build._merged if method == "upgma" else build._joined)(m))).replace("-0.00000", "0.00000") for m in both)
            assert want == got, (n, width, method)


def test_profiles_scan_anew_and_move_up(monkeypatch):
    """Lists of two neighbours run out in every round, and blocks hold a few rows."""
    monkeypatch.setattr(profiles, "LISTED", 2)
    monkeypatch.setattr(profiles, "SOUGHT", 1)
    monkeypatch.setattr(profiles, "CELLS", 500)
    test_merges_of_profiles_are_those_of_the_matrix()


def test_large_datasets_of_one_length_make_neither_pairs_nor_a_matrix(spark, monkeypatch):
    rng = random.Random(6)
    aligned = spark.createDataFrame(sequences(rng, {"a": 40, "b": 3}, 16), SCHEMA)
    want = written(build.identity_trees(aligned, task_members=4, task_joined=4))
    monkeypatch.setattr(build, "identity_distances", lambda *_: pytest.fail("all pairs as rows"))
    assert written(build.identity_trees(aligned, task_members=4, task_joined=4, matrix_members=5)) == want
    monkeypatch.setattr(build, "difference", lambda *_: pytest.fail("a matrix"))
    rows = build.identity_clade_rows("t", "d", [f"s{i}" for i in range(10, 16)], ["ACGT", "ACGA", "ACCA", "TCCA", "TCCC", "TTCC"], "nj", task_joined=4, matrix_members=5)
    assert rows["is_terminal"].sum() == 6


def test_keys_of_more_than_six_digits(spark, tmp_path):
    """lpad cuts them to equal ids, so that building a tree raised; the SQL counts them all."""
    import duckdb

    src = f"{SF}/customer.parquet"
    duckdb.sql(f"copy (select * replace (c_custkey * 7 + 999_900 as c_custkey, c_custkey % 2 as c_nationkey, 'S' as c_mktsegment) from '{src}' order by c_custkey limit 60) to '{tmp_path}/customer.parquet' (format parquet)")
    con = duckdb.connect()
    con.execute(f"create view customer as from '{tmp_path}/customer.parquet'")
    for name in ("nj_shape", "upgma_shape", "grid_trees", "parsimony_bounds"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({registry.ORACLES[name]})").fetchall()
        assert len(want) and sorted(map(tuple, got.collect())) == sorted(want), name
    for name in ("nj_tree", "upgma_tree", "parsimony_tree"):
        leaves = registry.QUERIES[name](spark, str(tmp_path)).filter("is_terminal").select("name").toPandas()["name"]
        assert leaves.nunique() == 60, name
    assert registry.QUERIES["parsimony_score"](spark, str(tmp_path)).count() == 2


def test_a_clustering_is_made_once_for_both_methods(monkeypatch):
    import pandas as pd

    made = []
    kept = build.identity_clade_rows
    monkeypatch.setattr(build, "identity_clade_rows", lambda *a: made.append(a) or kept(*a))
    rng = random.Random(8)
    rows = pd.DataFrame(sequences(rng, {"d": 12}, 16), columns=["dataset", "id", "seq"])
    both = build.built("d", {"distance": "x", "parsimony": "y"}, rows, "nj")
    assert len(made) == 1 and set(both["tree"]) == {"x", "y"}
    for method, name in (("distance", "x"), ("parsimony", "y")):
        alone = build.built("d", {method: name}, rows, "nj")
        assert written_one(alone) == written_one(both[both["tree"] == name])


def written_one(rows):
    return newick.write(build.read_clade(rows))
