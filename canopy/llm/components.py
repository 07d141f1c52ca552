"""Connected components by randomised contraction, in DataFrames only.

Each round maps every node to the member of its closed neighbourhood that comes first in an order drawn anew by hashing,
and contracts the graph along that map. The number of nodes falls by a constant factor a round in expectation, whatever
the shape (long chains included). Maps and edges are written to the shared folder each round; the maps are composed
from the last to the first. No links or components reach the driver; only whether edges are left does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.scratch import Steps, saved


def components(edges: DataFrame) -> DataFrame:
    """node and root (long) for every node of edges (u, v): the nodes of one component share a root.

    Loops and repeated edges do no harm; an empty table gives an empty result. Nulls are left out.
    """
    steps = Steps(edges.sparkSession)
    edges = steps.saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u")).toDF("node", "other")
        order = F.struct(F.xxhash64("other", F.lit(len(maps))).alias("h"), F.col("other").alias("id"))
        own = F.struct(F.xxhash64("node", F.lit(len(maps))).alias("h"), F.col("node").alias("id"))
        first = both.groupBy("node").agg(F.min(order).alias("best"))
        step = steps.saved(first.select("node", F.least("best", own)["id"].alias("root")), "map")
        maps.append(step)
        left = edges.join(step.toDF("u", "ru"), "u").select("ru", "v")
        moved = left.join(step.toDF("v", "rv"), "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        edges = steps.saved(moved.filter("u <> v").distinct(), "edges")
    out = maps.pop() if maps else edges.toDF("node", "root")
    while maps:
        last = out.toDF("root", "_to")
        out = maps.pop().join(last, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        out = steps.saved(out, "labels") if maps else out
    out = saved(out, "components")
    steps.clear()
    return out
