import json

import pytest
from pyspark.sql import functions as F

from canopy.operators import cleaning, runs, steps
from canopy.sources import nested, newick, sinks

TEXTS = [("a", "((A:1.5,'B \"b\"':2)x:0.5,C)root;"), ("b", "only;"), ("c", "((((p,q),r),s),(t,(u,(v,w))));"), ("d", "(" * 40 + "A" + ",B)" * 40 + ";"), ("e", "(k,(l,m,n),(),o);"), ("f", None)]


def dictionary(clade):
    out = {"leaf": not clade.children}
    if clade.name is not None:
        out["name"] = clade.name
    if clade.branch_length is not None:
        out["branch_length"] = clade.branch_length
    return out | {"children": [dictionary(c) for c in clade.children]}


def test_nested_trees(spark):
    nodes = newick.to_nodes(spark.createDataFrame(TEXTS, "tree string, text string")).cache()
    folded = nested.to_nested(nodes).cache()
    got = {r.tree: json.loads(r.text) for r in folded.select("tree", "text").collect()}
    assert got == {t: dictionary(newick.parse(text)) for t, text in TEXTS if text}
    back = nested.from_nested(folded)
    assert sorted(map(tuple, back.select(*nodes.columns).collect())) == sorted(map(tuple, nodes.collect()))
    assert nested.from_nested(folded.limit(0)).count() == 0 and nested.to_nested(nodes.limit(0)).count() == 0


def test_values_of_any_shape(spark):
    """Fields that lack, or are of another kind, are null."""
    trees = spark.createDataFrame([("a", '{"name": 7, "children": [{"leaf": true}, 5, {"name": "x", "branch_length": "no", "leaf": true, "other": [1]}]}'), ("b", None)], "tree string, text string")
    got = nested.from_nested(trees.select("tree", F.try_parse_json("text").alias("nested"))).orderBy("pre").collect()
    assert [(r.name, r.branch_length, r.is_terminal, r.pre, r.post, r.parent_id) for r in got] == [("7", None, False, 0, 3, None), (None, None, True, 1, 0, 0), (None, None, False, 2, 1, 0), ("x", None, True, 3, 2, 0)]


def test_mined_metadata(spark, tmp_path):
    rows = spark.createDataFrame([("t", [1, 2], "g"), ("u", [], "h")], "tree string, terminals array<int>, base string")
    sinks.write_metadata(rows, str(tmp_path / "m"))
    got = nested.read_mined_variant(spark, str(tmp_path / "m")).select("base", F.variant_get("value", "$.tree", "string").alias("t"), F.try_variant_get("value", "$.terminals[1]", "int").alias("x"))
    assert sorted(map(tuple, got.collect())) == [("g", "t", 2), ("h", "u", None)]


def test_run_report(spark):
    run = runs.Run(spark, "r")
    rows = run.saved(spark.range(1000), "ids", least=F.min("id"), most=F.max("id"))
    assert run.saved(rows.filter("id < 0"), "none", most=F.max("id")).count() == 0
    with pytest.raises(Exception, match="lost"):
        run.saved(rows.select(F.raise_error(F.lit("lost")).alias("x")), "bad")
    got = run.report().orderBy("at").collect()
    assert [(r.stage, r.done, r.rows) for r in got] == [("ids", True, 1000), ("none", True, 0), ("bad", False, None)]
    assert got[0].figures == {"least": 0.0, "most": 999.0} and got[1].figures == {} and got[0].bytes > 1000 and all(r.seconds > 0 for r in got)
    total = runs.totals(run.report(), per="ids").first()
    assert total.n_stages == 3 and total.failed == 1 and abs(total.seconds_each * 1000 - total.seconds) < 1e-9


def test_subsample_of_a_large_dataset(spark):
    """Few rows of a large data set are ranked; ties, small data sets and a null one are kept right."""
    large = spark.range(300_000).select(F.lit("large").alias("dataset"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"))
    odd = spark.createDataFrame([("small", 1, "a"), ("small", 2, "b"), (None, 1, "c"), (None, 2, "c"), (None, 3, "c"), ("one", 1, None)], "dataset string, pos long, id string")
    got = cleaning.subsample(large.union(odd), 2)
    by = {}
    for r in got.collect():
        by.setdefault(r.dataset, []).append(r.pos)
    draw = F.md5(F.concat_ws("/", F.lit(0), "id"))
    want = [r.pos for r in large.orderBy(draw, "pos").limit(2).collect()]
    assert sorted(by["large"]) == sorted(want) and sorted(by["small"]) == [1, 2] and sorted(by[None]) == [1, 2] and by["one"] == [1]
    assert cleaning.subsample(odd.limit(0), 3).count() == 0


def test_saved_steps_are_removed(spark):
    path = steps.new_folder(spark)
    rows = steps.cut(spark.range(3))
    spark.range(2).write.parquet(path)
    assert rows.count() == 3 and steps.clear(spark) >= 2 and steps.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(path)
