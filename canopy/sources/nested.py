"""Trees as nested values and back, and mined metadata without a schema, as VARIANT.

A tree's nested text is its nodes' texts in the order in which a walk enters and leaves them. The place of both follows from a node's pre- and
post-order and its depth, so that folding is one sort of each tree's own texts, whatever its depth. Unfolding goes level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.steps import cut


def to_nested(nodes: DataFrame) -> DataFrame:
    """tree, text (nested JSON of leaf, name, branch_length and children; what is null is left out) and nested (the same as VARIANT) of each tree."""
    head = F.to_json(F.struct(F.col("is_terminal").alias("leaf"), "name", "branch_length"))
    enters = F.concat(F.when(F.col("child_ord") > 0, ",").otherwise(""), F.substring(head, 1, F.length(head) - F.lit(1)), F.lit(',"children":['))
    # nodes entered before are ancestors or have been left; nodes left before an exit are those of a smaller post
    events = F.array(F.struct((2 * F.col("pre") - F.col("depth")).alias("at"), enters.alias("text")), F.struct((2 * F.col("post") + 1 + F.col("depth")).alias("at"), F.lit("]}").alias("text")))
    each = nodes.select("tree", F.inline(events))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda e: e["text"]), "")
    return each.groupBy("tree").agg(text.alias("text")).select("tree", "text", F.parse_json("text").alias("nested"))


def from_nested(trees: DataFrame) -> DataFrame:
    """Node rows of trees (tree, nested): node_id and parent_id number the nodes by pre-order. A round for each level, whose rows are saved."""
    none = F.lit(None).cast("array<int>")
    level = cut(trees.filter("nested is not null").select("tree", F.array().cast("array<int>").alias("path"), none.alias("parent"), F.col("nested").alias("v")))
    found = None
    while not level.isEmpty():
        get = lambda p, kind: F.try_variant_get("v", f"$.{p}", kind)
        own = level.select("tree", "path", "parent", get("name", "string").alias("name"), get("branch_length", "double").alias("branch_length"), F.coalesce(get("leaf", "boolean"), F.lit(False)).alias("is_terminal"))
        found = own if found is None else found.unionByName(own)
        children = F.try_variant_get("v", "$.children", "array<variant>")
        below = level.select("tree", F.col("path").alias("parent"), F.posexplode(children).alias("at", "v"))
        level = cut(below.select("tree", F.concat("parent", F.array("at")).alias("path"), "parent", "v"))
    if found is None:
        found = level.select("tree", "path", "parent", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("branch_length"), F.lit(True).alias("is_terminal"))
    # paths in their order are the pre-order, as a path stands before all that go on from it
    pre = (F.row_number().over(Window.partitionBy("tree").orderBy("path")) - 1).cast("int")
    placed = cut(found.withColumns({"pre": pre, "depth": F.size("path").cast("int")}))
    parents = placed.select("tree", F.col("path").alias("parent"), F.col("pre").alias("parent_id"))
    out = placed.join(parents, ["tree", "parent"], "left")
    # a node's last descendant tells how many it has: the nodes before the next one that is not deeper
    after = Window.partitionBy("tree").orderBy("post_key")
    out = out.withColumn("post_key", F.concat(F.transform("path", lambda p: p + 1), F.array(F.lit(2147483647))))
    out = out.withColumn("post", (F.row_number().over(after) - 1).cast("int"))
    ord_ = F.coalesce(F.get("path", F.size("path") - 1), F.lit(0))
    return out.select("tree", F.col("pre").alias("node_id"), "parent_id", ord_.alias("child_ord"), "name", "branch_length", "is_terminal", "pre", "post", "depth")


def read_mined_variant(spark: SparkSession, path: str) -> DataFrame:
    """value: each line's object of mined metadata as VARIANT, whatever its fields, and the folder's columns."""
    return spark.read.option("singleVariantColumn", "value").json(path)
