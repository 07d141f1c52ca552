"""Queries over trees and transactions: the hierarchy of regions, nations, customers and suppliers, and orders' items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopy.functions import text as T
from canopy.operators import build, compare, graph, mining, runs, trees
from canopy.operators.steps import cut, sorted_in, spread
from canopy.plans.registry import query, table
from canopy.plans.sequence_queries import codes


_CODES = "d AS (SELECT 'n' || c_nationkey || '-' || c_mktsegment AS dataset, lpad(c_custkey::VARCHAR, 6, '0') AS id, md5(c_name) AS seq FROM customer)"


def geography(spark, sf_dir):
    """Edges (parent, child) of the hierarchy of regions, nations and customers, named by kind and key."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    world = table(spark, sf_dir, "region").select(F.lit("W").alias("parent"), F.concat(F.lit("R"), "r_regionkey").alias("child"))
    own = nation.select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    return world.union(own).union(customer.select(F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.concat(F.lit("C"), "c_custkey").alias("child")))


_EDGES = "e AS (SELECT 'W' AS parent, 'R' || r_regionkey AS child FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)"


@query(
    f"WITH RECURSIVE {_EDGES}, c AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM e UNION ALL SELECT c.ancestor, e.child, c.distance + 1 FROM c JOIN e ON e.parent = c.descendant) SELECT * FROM c"
)
def tree_closure(spark, sf_dir):
    return trees.closure(geography(spark, sf_dir))


@query(
    "WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) "
    "SELECT a.o_orderkey AS ancestor, b.o_orderkey AS descendant, (b.k - a.k)::INT AS distance FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.k < b.k"
)
def chain_closure(spark, sf_dir):
    """Each customer's orders as a chain, of any length."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = table(spark, sf_dir, "orders").select(before.alias("parent"), F.col("o_orderkey").alias("child"))
    return trees.closure(edges)


def grouped_trees(rows):
    """Node tables of trees of two levels, from rows (tree, g, name): a root, its groups in order, and their leaves in order."""
    w = "row_number() over (partition by tree order by g, name)"
    d = "dense_rank() over (partition by tree order by g)"
    leaves = rows.selectExpr("tree", "g", "name", f"cast({w} + {d} as int) as pre", f"cast({w} + {d} - 2 as int) as post", f"cast({d} as int) - 1 as _d")
    first = F.min("pre").over(Window.partitionBy("tree", "g")) - 1
    leaves = leaves.withColumns({"parent_id": first, "child_ord": F.col("pre") - first - 1})
    groups = leaves.groupBy("tree", "g").agg((F.min("pre") - 1).alias("pre"), (F.max("post") + 1).alias("post"), F.lit(0).alias("parent_id"), F.min("_d").alias("child_ord"))
    roots = leaves.groupBy("tree").agg(F.lit(0).alias("pre"), (F.max("post") + 2).alias("post"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("child_ord"))
    shape = lambda df, name, leaf, depth: df.select("tree", F.col("pre").alias("node_id"), "parent_id", "child_ord", name.alias("name"), F.lit(None).cast("double").alias("branch_length"), F.lit(leaf).alias("is_terminal"), "pre", "post", F.lit(depth).alias("depth"))
    return shape(leaves, F.col("name"), True, 2).union(shape(groups, F.lit(None).cast("string"), False, 1)).union(shape(roots, F.lit("root"), False, 0))


#: The trees of each nation: by segment twice, and by the band of the balance.
KINDS = ("seg_a", "seg_b", "bal_a")


def nation_trees(spark, sf_dir):
    """Three hierarchies over each nation's customers as node tables; the nation is the dataset."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("n"), F.format_string("C%08d", "c_custkey").alias("name"), "c_mktsegment", F.floor(F.col("c_acctbal") / 2000).cast("int").cast("string").alias("band"))
    kinds = [F.struct(F.concat("n", F.lit(f"_{k}")).alias("tree"), (F.col("c_mktsegment") if k.startswith("seg") else F.concat(F.lit("b"), "band")).alias("g")) for k in KINDS]
    return grouped_trees(c.select("name", F.explode(F.array(*kinds)).alias("x")).select("x.tree", "x.g", "name"))


def nations_of(nodes):
    """tree and dataset of the trees of a node table."""
    return nodes.select("tree").distinct().select("tree", F.substring_index("tree", "_", 1).alias("dataset"))


TREES = (
    "t AS (SELECT printf('C%08d', c_custkey) AS leaf, 'n' || c_nationkey || unnest(['_seg_a', '_seg_b', '_bal_a']) AS tree, unnest([c_mktsegment, c_mktsegment, 'b' || floor(c_acctbal / 2000)::INT]) AS g FROM customer), "
    "c AS (SELECT tree, g, list(leaf ORDER BY leaf) AS t FROM t GROUP BY ALL UNION ALL SELECT tree, NULL, list(leaf ORDER BY g, leaf) FROM t GROUP BY tree)"
)


@query(
    f"WITH {TREES} SELECT tree, name, n FROM (SELECT tree, CASE WHEN g IS NULL THEN 'root' ELSE 'Inner' || dense_rank() OVER (PARTITION BY tree, g IS NULL ORDER BY g) END AS name, len(t)::BIGINT AS n FROM c) WHERE n > 1"
)
def internal_labels(spark, sf_dir):
    nodes = trees.label_internals(nation_trees(spark, sf_dir))
    inner = nodes.filter("not is_terminal").select("tree", "name", "node_id")
    sizes = trees.clades(nation_trees(spark, sf_dir)).select("tree", "node_id", F.col("n_terminals").cast("long").alias("n"))
    return inner.join(sizes, ["tree", "node_id"]).select("tree", "name", "n")


@query(f"WITH {TREES} SELECT tree, md5(array_to_string(list_sort(t), chr(31))) AS item, len(t)::BIGINT AS n_terminals FROM c WHERE len(t) > 1")
def subtree_items(spark, sf_dir):
    return trees.subtrees(nation_trees(spark, sf_dir)).select("tree", "item", F.col("n_terminals").cast("long").alias("n_terminals"))


@query(
    f"WITH {TREES} SELECT tree, cast('0x' || substr(md5('[' || array_to_string(list_transform(t, lambda x: cast('0x' || substr(md5(x), 1, 4) AS INT)::VARCHAR), ', ') || ']'), 1, 4) AS INT)::VARCHAR AS item FROM c WHERE len(t) > 1"
)
def subtree_items_parity(spark, sf_dir):
    return trees.subtrees(nation_trees(spark, sf_dir), parity=True).select("tree", "item")


@query(f"WITH {TREES} SELECT tree, arg_max(len(t), len(t))::BIGINT AS n_terminals FROM c GROUP BY tree")
def largest_by_tree(spark, sf_dir):
    return trees.largest_subtree(trees.clades(nation_trees(spark, sf_dir))).select("tree", F.col("n_terminals").cast("long").alias("n_terminals"))


@query(f"WITH {TREES} SELECT min(tree) AS tree, max(len(t))::BIGINT AS n_terminals FROM c WHERE len(t) = (SELECT max(len(t)) FROM c)")
def largest_subtree(spark, sf_dir):
    return trees.largest_subtree(trees.clades(nation_trees(spark, sf_dir)), by_tree=False).select("tree", F.col("n_terminals").cast("long").alias("n_terminals"))


@query(
    f"WITH {TREES}, s AS (SELECT tree, count(*) FILTER (len(t) > 1) AS k FROM c GROUP BY tree) SELECT t.tree, count(*)::BIGINT + count(DISTINCT g) + 1 AS n_nodes, count(*)::BIGINT AS n_terminals, any_value(k)::BIGINT AS n_subtrees FROM t JOIN s USING (tree) GROUP BY t.tree"
)
def tree_counters(spark, sf_dir):
    return trees.counters(nation_trees(spark, sf_dir))


_SETS = f"WITH {TREES}, k AS (SELECT DISTINCT tree, split_part(tree, '_', 1) AS d, md5(array_to_string(list_sort(t), ',')) AS t FROM c WHERE len(t) > 1)"
_RF = (
    ", z AS (SELECT d, tree, count(*) AS n FROM k GROUP BY ALL), h AS (SELECT a.tree AS tree_a, b.tree AS tree_b, count(*) AS n FROM k a JOIN k b ON a.d = b.d AND a.tree < b.tree AND a.t = b.t GROUP BY ALL), "
    "rf AS (SELECT a.d, a.tree AS tree_a, b.tree AS tree_b, (a.n + b.n - 2 * coalesce(h.n, 0))::BIGINT AS rf FROM z a JOIN z b ON a.d = b.d AND a.tree < b.tree LEFT JOIN h ON h.tree_a = a.tree AND h.tree_b = b.tree)"
)


def nation_rf(spark, sf_dir):
    nodes = nation_trees(spark, sf_dir)
    return compare.rf_distances(nodes, datasets=nations_of(nodes))


@query(_SETS + _RF + " SELECT tree_a, tree_b, rf FROM rf")
def rf_pairs(spark, sf_dir):
    return nation_rf(spark, sf_dir)


@query(_SETS + _RF + " SELECT tree_a AS a, tree_b AS b, rf FROM rf UNION ALL SELECT tree_b, tree_a, rf FROM rf UNION ALL SELECT DISTINCT tree, tree, 0 FROM k WHERE d IN (SELECT d FROM rf)")
def rf_matrix(spark, sf_dir):
    return compare.matrix(nation_rf(spark, sf_dir))


@query(_SETS + _RF + " SELECT (SELECT count(DISTINCT tree) FROM k WHERE d IN (SELECT d FROM rf))::BIGINT AS n_trees, count(*)::BIGINT AS n_pairs, round(avg(rf), 9) AS mean, median(rf)::DOUBLE AS median, min(rf) AS least, max(rf) AS most FROM rf")
def rf_stats(spark, sf_dir):
    out = compare.summary(nation_rf(spark, sf_dir))
    return out.select(F.col("n_trees").cast("long").alias("n_trees"), F.col("n_pairs").cast("long").alias("n_pairs"), F.round("mean", 9).alias("mean"), "median", "least", "most")


@query(_SETS + _RF + " SELECT split_part(tree_a, '_', 2) AS method_a, split_part(tree_b, '_', 2) AS method_b, sum(rf)::BIGINT AS rf FROM rf GROUP BY ALL")
def rf_accumulate(spark, sf_dir):
    pairs = nation_rf(spark, sf_dir)
    method = lambda c: F.get(F.split(c, "_"), F.lit(1))
    return compare.accumulated(pairs.withColumns({"method_a": method("tree_a"), "method_b": method("tree_b")}))


@query(
    _SETS + _RF + ", o AS (SELECT d, list_sort(list(rf)) AS r, least(min(tree_a), min(tree_b)) AS a FROM rf GROUP BY d) "
    "SELECT d AS dataset, s::INT AS step, r[s]::DOUBLE AS height, (s + 1)::INT AS size FROM (SELECT d, r, unnest(range(1, 3)) AS s FROM o WHERE len(r) = 3)"
)
def rf_linkage(spark, sf_dir):
    """Single linkage of each nation's three trees: of three points, the two shortest sides are the heights."""
    pairs = nation_rf(spark, sf_dir).select(F.substring_index("tree_a", "_", 1).alias("dataset"), F.col("tree_a").alias("a"), F.col("tree_b").alias("b"), F.col("rf").alias("distance"))
    return trees.single_linkage(pairs).select("dataset", "step", "height", "size")


@query(
    f"WITH RECURSIVE {_CODES}, e AS (SELECT a.dataset, a.id AS a, b.id AS b, hamming(a.seq, b.seq) AS w FROM d a JOIN d b ON a.dataset = b.dataset AND a.id < b.id), "
    "n AS (SELECT dataset, a AS x, b AS y, w, a, b FROM e UNION ALL SELECT dataset, b, a, w, a, b FROM e), "
    "r AS (SELECT dataset, w, a, b, a AS x FROM e UNION SELECT r.dataset, r.w, r.a, r.b, n.y FROM r JOIN n ON n.dataset = r.dataset AND n.x = r.x AND (n.w, n.a, n.b) < (r.w, r.a, r.b)), "
    "t AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.dataset = e.dataset AND r.a = e.a AND r.b = e.b AND r.x = e.b)) "
    "SELECT dataset, (row_number() OVER (PARTITION BY dataset ORDER BY w, a, b))::INT AS step, round(w / 32, 9) AS height FROM t"
)
def identity_linkage(spark, sf_dir):
    """Single linkage of each data set's sequences; the SQL keeps a pair if no way of closer pairs joins its two."""
    pairs = build.spanning_distances(codes(spark, sf_dir)).select("dataset", F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("dist").alias("distance"))
    return trees.single_linkage(pairs).select("dataset", "step", F.round("height", 9).alias("height"))


def small_trees(spark, sf_dir):
    """Two hierarchies over the nations, by region and by the length of the name."""
    nation = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("r"), "n_regionkey").alias("by_region"), F.concat(F.lit("l"), (F.length("n_name") % 4).cast("string")).alias("by_length"))
    kinds = F.array(F.struct(F.lit("tree_region_a").alias("tree"), F.col("by_region").alias("g")), F.struct(F.lit("tree_length_a").alias("tree"), F.col("by_length").alias("g")))
    return grouped_trees(nation.select(F.col("n_name").alias("name"), F.explode(kinds).alias("x")).select("x.tree", "x.g", "name"))


@query(
    "WITH x AS (SELECT n_name AS l, unnest(['tree_region_a', 'tree_length_a']) AS tree, unnest(['r' || n_regionkey, 'l' || (length(n_name) % 4)]) AS g FROM nation), "
    "s AS (SELECT tree, g, string_agg(l, ',' ORDER BY l) AS t FROM x GROUP BY ALL), w AS (SELECT tree, string_agg(l, ',' ORDER BY l) AS t FROM x GROUP BY tree), "
    "m AS (SELECT a.tree, a.l AS x, b.l AS y, CASE WHEN a.g = b.g THEN s.t ELSE w.t END AS t FROM x a JOIN x b ON a.tree = b.tree AND a.l < b.l JOIN s ON s.tree = a.tree AND s.g = a.g JOIN w ON w.tree = a.tree), "
    "q AS (SELECT a.tree, a.l AS a, b.l AS b, c.l AS c, d.l AS d FROM x a JOIN x b ON a.tree = b.tree AND a.l < b.l JOIN x c ON c.tree = a.tree AND b.l < c.l JOIN x d ON d.tree = a.tree AND c.l < d.l), "
    "g AS (SELECT q.tree, a, b, c, d, string_agg(m.t, ';' ORDER BY m.t) AS sig FROM q JOIN m ON m.tree = q.tree AND m.x IN (a, b, c, d) AND m.y IN (a, b, c, d) GROUP BY ALL) "
    "SELECT 'tree_length_a' AS tree_a, 'tree_region_a' AS tree_b, (SELECT count(*) FROM (SELECT * EXCLUDE (tree) FROM g WHERE tree = 'tree_length_a' EXCEPT SELECT * EXCLUDE (tree) FROM g WHERE tree = 'tree_region_a')) + "
    "(SELECT count(*) FROM (SELECT * EXCLUDE (tree) FROM g WHERE tree = 'tree_region_a' EXCEPT SELECT * EXCLUDE (tree) FROM g WHERE tree = 'tree_length_a')) AS quartet"
)
def quartet_small(spark, sf_dir):
    """Two trees of all nations."""
    return compare.quartet_distances(small_trees(spark, sf_dir))


@query(
    f"WITH {TREES}, k AS (SELECT tree, g, md5(string_agg(leaf, ',' ORDER BY leaf)) AS s FROM t GROUP BY ALL), w AS (SELECT tree, md5(string_agg(leaf, ',' ORDER BY leaf)) AS s, count(*) AS n FROM t GROUP BY tree), "
    "m AS (SELECT a.tree, split_part(a.tree, '_', 1) AS d, a.leaf AS x, b.leaf AS y, CASE WHEN a.g = b.g THEN k.s ELSE w.s END AS s FROM t a JOIN t b ON a.tree = b.tree AND a.leaf < b.leaf JOIN k ON k.tree = a.tree AND k.g = a.g JOIN w ON w.tree = a.tree), "
    "e AS MATERIALIZED (SELECT a.tree || '|' || b.tree AS p, a.x, a.y FROM m a JOIN m b USING (d, x, y, s) WHERE a.tree < b.tree), "
    "f AS (SELECT p, count(*) AS n FROM (SELECT e.p, e.x AS a, e.y AS b, f.y AS c FROM e JOIN e f ON e.p = f.p AND e.x = f.x AND e.y < f.y JOIN e g ON g.p = e.p AND g.x = e.y AND g.y = f.y) h "
    "JOIN e USING (p) JOIN e i USING (p) JOIN e j USING (p) WHERE e.x = h.a AND i.x = h.b AND j.x = h.c AND e.y = i.y AND e.y = j.y GROUP BY p) "
    "SELECT a.tree AS tree_a, b.tree AS tree_b, (a.n * (a.n - 1) * (a.n - 2) * (a.n - 3) // 24 + b.n * (b.n - 1) * (b.n - 2) * (b.n - 3) // 24 - 2 * coalesce(f.n, 0))::BIGINT AS quartet "
    "FROM w a JOIN w b ON split_part(a.tree, '_', 1) = split_part(b.tree, '_', 1) AND a.tree < b.tree LEFT JOIN f ON f.p = a.tree || '|' || b.tree"
)
def quartet_pairs(spark, sf_dir):
    """Quartet distances of each nation's trees, however many customers they hold; the SQL lists all fours."""
    nodes = nation_trees(spark, sf_dir)
    return compare.quartet_distances(nodes, nations_of(nodes))


@query("SELECT substring_index_2 AS base, count(*)::BIGINT AS n FROM (SELECT array_to_string(string_split(replace(p_type, ' ', '_'), '_')[1:2], '_') AS substring_index_2 FROM part) GROUP BY base")
def tree_groups(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(T.base_name(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("base"))
    return names.groupBy("base").agg(F.count(F.lit(1)).alias("n"))


def purchases(spark, sf_dir):
    """Transactions: each order's brands, grouped by the order's status."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()  # from the files' footers
    items = spread(lines, n, "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    items = spread(items.select("l_orderkey", "p_brand"), n, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("base"), F.col("l_orderkey").alias("tree"), F.col("p_brand").alias("item"))


_BUY = "b AS (SELECT DISTINCT o_orderstatus AS base, l_orderkey AS tree, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_BUY} SELECT tree, array_to_string(list_sort(list(item)), ',') AS items FROM b GROUP BY tree")
def transactions(spark, sf_dir):
    return trees.transactions(purchases(spark, sf_dir)).select("tree", F.array_join("items", ",").alias("items"))


def regional(spark, sf_dir):
    """Transactions of a few rows: which segments and balance bands each nation's customers have, by region."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    band = F.concat("c_mktsegment", F.lit("/"), F.floor(F.col("c_acctbal") / 1000).cast("string"))
    return c.select(F.concat(F.lit("r"), "n_regionkey").alias("base"), F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("tree"), band.alias("item"))


_REG = "b AS (SELECT DISTINCT 'r' || n_regionkey AS base, 'n' || lpad(c_nationkey::VARCHAR, 2, '0') AS tree, c_mktsegment || '/' || floor(c_acctbal / 1000)::BIGINT AS item FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_SUP = "n AS (SELECT base, count(DISTINCT tree) AS rws FROM b GROUP BY base), k AS (SELECT base, item, count(*) AS n FROM b GROUP BY ALL)"


@query(
    f"WITH {_REG}, {_SUP} SELECT k.base, item, k.n::BIGINT AS n, rws::BIGINT AS rows, list_filter(range(1, 11), lambda t: k.n * 10 >= t * rws) AS tenths FROM k JOIN n ON k.base = n.base WHERE k.n * 10 >= rws".replace(
        "list_filter(range(1, 11), lambda t: k.n * 10 >= t * rws) AS tenths", "array_to_string(list_filter(range(1, 11), lambda t: k.n * 10 >= t * rws), ',') AS tenths"
    )
)
def item_supports(spark, sf_dir):
    """The flagship: supports of every item over the grid of thresholds, by one distinct count."""
    counts = mining.item_counts(regional(spark, sf_dir), "base", "tree", "item")
    out = mining.grid_supports(counts)
    tenths = F.array_join(F.transform("supports", lambda s: F.round(s * 10).cast("long").cast("string")), ",")
    return out.select("base", "item", "n", "rows", tenths.alias("tenths"))


@query(f"WITH {_BUY}, {_SUP} SELECT k.base, item, k.n::BIGINT AS n, rws::BIGINT AS rows FROM k JOIN n ON k.base = n.base")
def item_counts(spark, sf_dir):
    return mining.item_counts(purchases(spark, sf_dir), "base", "tree", "item")


@query(
    f"WITH {_REG}, i AS (SELECT base, item, list(tree ORDER BY tree) AS ts FROM b GROUP BY ALL), n AS (SELECT base, count(DISTINCT tree) AS rws FROM b GROUP BY base), "
    "u AS (SELECT base, list(DISTINCT tree ORDER BY tree) AS ts FROM b GROUP BY base), "
    "s AS (SELECT base, unnest(range(1, (1 << len(ts))::BIGINT)) AS m, ts FROM u), "
    "t AS (SELECT base, m, list_filter(ts, lambda x, j: (m >> (j - 1)::INT) & 1 = 1) AS tids FROM s), "
    "f AS (SELECT t.base, t.tids, list(i.item ORDER BY i.item) AS items, list_reduce(list(i.ts), lambda x, y: list_intersect(x, y)) AS support FROM t JOIN i ON i.base = t.base AND list_has_all(i.ts, t.tids) JOIN n ON n.base = t.base WHERE len(t.tids) * 10 >= 6 * n.rws GROUP BY ALL), "
    "d AS (SELECT DISTINCT base, items, len(support) AS k FROM f) "
    "SELECT d.base, array_to_string(items, ',') AS items, k::BIGINT AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.base = d.base AND len(e.items) > len(d.items) AND list_has_all(e.items, d.items))"
)
def mfi_small(spark, sf_dir):
    return mining.maximal_itemsets(regional(spark, sf_dir), 0.6, "base", "tree", "item").select("base", F.array_join("items", ",").alias("items"), "n")


@query(
    f"WITH {_REG}, {_SUP} SELECT k.base, item, k.n::BIGINT AS n, array_to_string(list_filter([1, 4, 5, 8], lambda t: k.n * 12 >= t * rws), ',') AS twelfths FROM k JOIN n ON k.base = n.base WHERE k.n * 12 >= rws"
)
def item_supports_any(spark, sf_dir):
    """Supports at thresholds that are no tenths: 1, 4, 5 and 8 twelfths."""
    counts = mining.item_counts(regional(spark, sf_dir), "base", "tree", "item")
    out = mining.grid_supports(counts, [1 / 12, 1 / 3, 5 / 12, 2 / 3])
    return out.select("base", "item", "n", F.array_join(F.transform("supports", lambda s: F.round(s * 12).cast("long").cast("string")), ",").alias("twelfths"))


@query(f"WITH {_REG}, {_SUP} SELECT k.base, item, k.n::BIGINT AS occurrences, round(100 * k.n / rws, 2) AS percent FROM k JOIN n ON k.base = n.base")
def item_occurrences(spark, sf_dir):
    counts = mining.item_counts(regional(spark, sf_dir), "base", "tree", "item")
    return mining.occurrences(counts.withColumn("support", F.col("n") / F.col("rows"))).select("base", "item", "occurrences", "percent")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_custkey, " + ", ".join(f"least(1, count_if(o_orderpriority = '{s}'))::INT AS \"{s}\"" for s in PRIORITIES) + " FROM orders GROUP BY o_custkey")
def item_one_hot(spark, sf_dir):
    """The priorities that each customer has used; many lack one."""
    return mining.one_hot(table(spark, sf_dir, "orders"), PRIORITIES, "o_custkey", "o_orderpriority")


def line_kinds(spark, sf_dir):
    """Transactions: the kinds of lines (flag, status and number) that each part is in, by the first digit of its brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("maker"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_linenumber")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("maker").alias("base"), F.col("p_partkey").alias("tree"), F.concat_ws("/", "l_returnflag", "l_linestatus", "l_linenumber").alias("item"))


_MFI = 0.5
_BIG = "b AS (SELECT DISTINCT substr(p_brand, 1, 7) AS base, p_partkey AS tree, l_returnflag || '/' || l_linestatus || '/' || l_linenumber AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(
    f"WITH RECURSIVE {_BIG}, n AS (SELECT base, count(DISTINCT tree) AS rws FROM b GROUP BY base), i AS (SELECT base, item, list(tree) AS ts FROM b GROUP BY ALL), "
    f"f AS (SELECT i.base, item, ts, rws FROM i JOIN n ON i.base = n.base WHERE len(ts) >= {_MFI} * rws), "
    f"s AS (SELECT base, [item] AS items, ts, rws FROM f UNION ALL SELECT s.base, list_append(s.items, f.item), list_intersect(s.ts, f.ts), s.rws FROM s JOIN f ON f.base = s.base AND f.item > s.items[-1] WHERE len(list_intersect(s.ts, f.ts)) >= {_MFI} * s.rws) "
    "SELECT base, array_to_string(items, ',') AS items, len(ts)::BIGINT AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM s e WHERE e.base = s.base AND len(e.items) > len(s.items) AND list_has_all(e.items, s.items))"
)
def mfi_large(spark, sf_dir):
    """Maximal sets over groups of many transactions: hundreds or thousands of parts a maker."""
    return mining.maximal_itemsets(line_kinds(spark, sf_dir), _MFI, "base", "tree", "item").select("base", F.array_join("items", ",").alias("items"), "n")


@query("SELECT c_custkey, true AS item_ok, substr(md5(c_name), 1, 4) = substr(md5(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '.1x' END), 1, 4) AS leaf_ok FROM customer")
def hash_verify(spark, sf_dir):
    """Hashes held against what they were made of; two thirds of the names are changed, of which one in 65,536 has the same 16 bits by chance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array("c_custkey", "c_nationkey").alias("l"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(".1x")))
    return c.select("c_custkey", T.is_item_hash(T.item_hash(F.col("l")), F.col("l")).alias("item_ok"), T.is_terminal_hash(T.hash16(F.col("c_name")), other).alias("leaf_ok"))


@query(f"WITH {_REG} SELECT item, min(tree) AS tree FROM b GROUP BY item")
def item_first_tree(spark, sf_dir):
    return mining.first_tree(regional(spark, sf_dir).withColumn("pre", F.lit(0)))


_HIST = (
    f"WITH {_REG}, {_SUP}, s AS (SELECT unnest(list_transform(list_filter(range(1, 11), lambda t: k.n * 10 >= t * rws), lambda t: t / 10)) AS v FROM k JOIN n ON k.base = n.base), "
    "m AS (SELECT min(v) AS lo, max(v) AS hi FROM s), h AS (SELECT least(floor((v - lo) / (hi - lo) * 10), 9)::INT AS bin, count(*) AS n FROM s, m GROUP BY bin) "
    "SELECT b.bin::INT AS bin, round(lo + bin * (hi - lo) / 10 + (hi - lo) / 20, 9) AS centre, coalesce(h.n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 10)) AS bin) b CROSS JOIN m LEFT JOIN h USING (bin)"
)


@query(_HIST)
def support_hist(spark, sf_dir):
    counts = mining.item_counts(regional(spark, sf_dir), "base", "tree", "item")
    values = mining.grid_supports(counts).select(F.explode("supports").alias("v"))
    return mining.histogram(values, "v").select("bin", F.round("centre", 9).alias("centre"), "n")


@query(
    f"WITH {TREES}, k AS (SELECT tree, split_part(tree, '_', 1) AS base, md5(array_to_string(list_sort(t), chr(31))) AS item FROM c WHERE len(t) > 1), "
    "q AS (SELECT base, item, count(DISTINCT tree) AS n FROM k GROUP BY ALL), m AS (SELECT base, count(DISTINCT tree) AS rws FROM k GROUP BY base) "
    "SELECT k.tree, k.item, array_to_string(list_filter(range(1, 11), lambda t: q.n * 10 >= t * rws), ',') AS tenths FROM k JOIN q USING (base, item) JOIN m USING (base)"
)
def subtree_supports(spark, sf_dir):
    """The whole chain: trees, clades, items, counts, and the supports back at each clade."""
    rows = nation_subtrees(spark, sf_dir)
    found = mining.annotate(rows, mining.grid_supports(mining.item_counts(rows, "base", "tree", "item")))
    return found.select("tree", "item", F.array_join(F.transform("supports", lambda s: F.round(s * 10).cast("long").cast("string")), ",").alias("tenths"))


def nation_subtrees(spark, sf_dir):
    return trees.subtrees(nation_trees(spark, sf_dir)).withColumn("base", F.substring_index("tree", "_", 1))


@query(
    f"WITH {TREES}, k AS (SELECT tree, tree || '_' || CASE WHEN g IS NULL THEN 'root' ELSE 'Inner' || dense_rank() OVER (PARTITION BY tree, g IS NULL ORDER BY g) END AS subtree, t FROM c), "
    "i AS (SELECT md5(array_to_string(list_sort(t), chr(31))) AS item, * FROM k WHERE len(t) > 1), f AS (SELECT item FROM i GROUP BY item HAVING count(DISTINCT tree) >= 2) "
    "SELECT item, tree, subtree, len(t)::BIGINT AS n_terminals, md5(array_to_string(t, ',')) AS terminals FROM i WHERE item IN (SELECT item FROM f)"
)
def item_all_subtrees(spark, sf_dir):
    """Items that recur, at every subtree that has them."""
    rows = nation_subtrees(spark, sf_dir)
    wanted = mining.item_counts(rows, "base", "tree", "item").filter("n >= 2")
    found = mining.item_subtrees(rows, wanted)
    return found.select("item", "tree", "subtree", F.col("n_terminals").cast("long").alias("n_terminals"), F.md5(F.array_join("terminals", ",")).alias("terminals"))


@query(
    f"WITH {TREES}, p AS (SELECT tree, g, list(leaf ORDER BY leaf) AS t FROM t GROUP BY ALL HAVING count(*) > 1) "
    "SELECT tree || '_Inner' || r AS tree, count(*)::BIGINT + 1 AS n_nodes, min(leaf) AS first_leaf, count(*)::BIGINT AS last_post FROM (SELECT tree, g, dense_rank() OVER (PARTITION BY tree ORDER BY g) AS r, leaf FROM t) JOIN p USING (tree, g) GROUP BY tree, r"
)
def clade_trees(spark, sf_dir):
    """Clades below the root as trees of their own."""
    rows = trees.clade_nodes(nation_trees(spark, sf_dir)).filter("tree not like '%_root'")
    leaf = F.when(F.col("is_terminal"), F.col("name"))
    return rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.min(leaf).alias("first_leaf"), F.max("post").cast("long").alias("last_post"))


@query(
    f"WITH {TREES} SELECT 'User:<<USER_UID>>' AS src, 'OWNS' AS rel, 'Tree:' || tree AS dst FROM (SELECT DISTINCT tree FROM t) "
    "UNION ALL SELECT 'Tree:' || tree, 'HAS_SUBTREE', 'Subtree:' || s FROM (SELECT tree, tree || '_' || CASE WHEN g IS NULL THEN 'root' ELSE 'Inner' || dense_rank() OVER (PARTITION BY tree, g IS NULL ORDER BY g) END AS s, t FROM c) WHERE len(t) > 1 "
    "UNION ALL SELECT 'Subtree:' || s, 'HAS_SUPPORT', 'Support:1.0' FROM (SELECT tree || '_' || CASE WHEN g IS NULL THEN 'root' ELSE 'Inner' || dense_rank() OVER (PARTITION BY tree, g IS NULL ORDER BY g) END AS s, t FROM c) WHERE len(t) > 1"
)
def graph_edges(spark, sf_dir):
    rows = trees.subtrees(nation_trees(spark, sf_dir)).withColumn("supports", F.array(F.lit(1.0)))
    return graph.edges(rows)




def members(spark, sf_dir):
    """codes by whole keys: lpad cuts those of more than six digits, and ids are unique in a dataset."""
    key = F.col("pos").cast("string")
    return codes(spark, sf_dir).withColumn("id", F.when(F.length(key) > 6, key).otherwise(F.col("id")))


def _cut(leaf):
    """A leaf's name as lpad has it in the SQL; cutting all names to their first six letters keeps the first and the last of them."""
    return F.substring(leaf, 1, 6)


def _shape(nodes):
    """Per tree: its dataset, leaves and nodes, the first and the last leaf."""
    leaf = F.when(F.col("is_terminal"), F.col("name"))
    own = nodes.groupBy("tree").agg(F.count_if("is_terminal").alias("n_leaves"), F.count(F.lit(1)).alias("n_nodes"), _cut(F.min(leaf)).alias("first"), _cut(F.max(leaf)).alias("last"))
    return own.select(F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset"), "n_leaves", "n_nodes", "first", "last")


def _shape_sql(inner):
    return f"WITH {_CODES} SELECT dataset, count(*)::BIGINT AS n_leaves, (count(*) + CASE WHEN count(*) = 1 THEN 0 ELSE {inner} END)::BIGINT AS n_nodes, min(id) AS first, max(id) AS last FROM d GROUP BY dataset"


def _clustered(spark, sf_dir, method):
    return build.identity_trees(members(spark, sf_dir), (method,))


@query()
def nj_tree(spark, sf_dir):
    return _clustered(spark, sf_dir, "nj")


@query(_shape_sql("greatest(count(*) - 2, 1)"))
def nj_shape(spark, sf_dir):
    """Neighbour joining leaves all sequences of a dataset below a root of three."""
    return _shape(nj_tree(spark, sf_dir))


@query()
def upgma_tree(spark, sf_dir):
    return _clustered(spark, sf_dir, "upgma")


@query(_shape_sql("count(*) - 1").replace(" FROM d GROUP BY", ", true AS ultrametric FROM d GROUP BY"))
def upgma_shape(spark, sf_dir):
    """Averaging leaves all sequences of a dataset in a tree of pairs, each leaf equally far from the root."""
    nodes = cut(upgma_tree(spark, sf_dir))
    own = F.coalesce("branch_length", F.lit(0.0))
    # along a walk around the tree each node's length counts from its first visit to its last
    size, first = F.col("post") - F.col("pre") + F.col("depth") + 1, 2 * F.col("pre") - F.col("depth")
    steps = F.array(F.struct(first.alias("at"), own.alias("length"), F.col("is_terminal").alias("leaf")), F.struct((first + 2 * size - 1).alias("at"), (-own).alias("length"), F.lit(False).alias("leaf")))
    walk = nodes.select("tree", F.explode(steps).alias("s")).select("tree", "s.*")
    depth = walk.withColumn("d", F.sum("length").over(Window.partitionBy("tree").orderBy("at"))).filter("leaf")
    flat = depth.groupBy("tree").agg((F.max("d") - F.min("d") < 1e-9).alias("ultrametric")).select(F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset"), "ultrametric")
    return _shape(nodes).join(flat, "dataset")


@query()
def parsimony_score(spark, sf_dir):
    aligned = members(spark, sf_dir)
    nodes = cut(nj_tree(spark, sf_dir))
    return build.parsimony_scores(nodes, aligned, _named(nodes))


def _named(nodes):
    return nodes.select("tree", F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset")).distinct()


@query()
def parsimony_tree(spark, sf_dir):
    """Each step of the climb scores the interchanges of a dataset's tree."""
    return build.parsimony_trees(members(spark, sf_dir), ("nj",))


@query(f"WITH {_CODES} SELECT dataset, true AS enough, true AS no_worse FROM d GROUP BY dataset")
def parsimony_bounds(spark, sf_dir):
    """Changes are one less than the symbols of each column at least, and the climb never ends above its start."""
    aligned = members(spark, sf_dir)
    best = cut(parsimony_tree(spark, sf_dir))
    found = build.parsimony_scores(best, aligned, _named(best)).select(F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset"), "changes")
    start = parsimony_score(spark, sf_dir).select(F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset"), F.col("changes").alias("start"))
    columns = aligned.select("dataset", F.posexplode(F.split("seq", "")).alias("at", "c")).filter("c <> ''").groupBy("dataset", "at").agg((F.count_distinct("c") - 1).alias("n"))
    least = columns.groupBy("dataset").agg(F.sum("n").alias("least"))
    return found.join(start, "dataset").join(least, "dataset").select("dataset", (F.col("changes") >= F.col("least")).alias("enough"), (F.col("changes") <= F.col("start")).alias("no_worse"))


_KEYS = "k AS (SELECT 'b' || (c_custkey // 64) AS dataset, lpad(c_custkey::VARCHAR, 9, '0') AS id, (c_custkey::BIGINT * 7919) % 1048573 AS v FROM customer)"
_SHARED = f"{_KEYS}, g AS (SELECT dataset, l, v >> l AS p, list(id ORDER BY id) AS t FROM k, range(0, 21) AS r(l) GROUP BY ALL), a AS (SELECT dataset, list(id ORDER BY id) AS t FROM k GROUP BY dataset)"
_SPLITS = (
    f"WITH {_SHARED}, s AS (SELECT DISTINCT g.dataset, CASE WHEN g.t[1] = a.t[1] THEN list_filter(a.t, lambda x: NOT list_contains(g.t, x)) ELSE g.t END AS t FROM g JOIN a USING (dataset) WHERE len(g.t) BETWEEN 2 AND len(a.t) - 2) "
    "SELECT way, dataset, len(t)::BIGINT AS size, md5(array_to_string(t, ',')) AS split FROM s CROSS JOIN (SELECT unnest(['task', 'rounds']) AS way)"
)


def keyed(spark, sf_dir):
    """Customers by 64 with scattered keys v of 20 bits: those that share leading bits are a clade of a binary tree (dataset, id, v)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return c.select(F.concat(F.lit("b"), F.floor(F.col("k") / 64)).alias("dataset"), F.lpad(F.col("k").cast("string"), 9, "0").alias("id"), (F.col("k") * 7919 % 1048573).alias("v"))


def key_distances(spark, sf_dir, ends):
    """How far keys lie apart in their tree: up to the bits that they share and down again, and with ends along branches of the leaves' own."""
    k = build.dealt(keyed(spark, sf_dir), "dataset")
    a, b = k.select("dataset", F.col("id").alias("id_a"), F.col("v").alias("v_a")), k.select("dataset", F.col("id").alias("id_b"), F.col("v").alias("v_b"))
    both = a.join(sorted_in(b), "dataset").filter("id_a < id_b")  # 64 of a dataset
    bits = F.length(F.bin(F.col("v_a").bitwiseXOR(F.col("v_b"))))
    own = (F.col("id_a").cast("long") % 5 + F.col("id_b").cast("long") % 5 + 2) if ends else F.lit(0)
    return both.select("dataset", "id_a", "id_b", (2 * bits + own).cast("double").alias("dist"))


def _splits(nodes, members):
    """dataset, size and md5 of the parts without the first leaf into which the edges of each tree part its leaves, where both parts have two or more."""
    found = trees.clades(nodes).select(F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset"), F.sort_array("terminals").alias("t"))
    whole = members.groupBy("dataset").agg(F.sort_array(F.collect_list("id")).alias("all"))
    side = F.when(F.col("t")[0] == F.col("all")[0], F.array_except("all", "t")).otherwise(F.col("t"))
    kept = found.join(sorted_in(whole), "dataset").filter(F.size("t") <= F.size("all") - 2).select("dataset", side.alias("t")).distinct()
    return kept.select("dataset", F.size("t").cast("long").alias("size"), F.md5(F.array_join("t", ",")).alias("split"))


def _both_ways(spark, sf_dir, method, ends):
    distances, out = cut(key_distances(spark, sf_dir, ends)), None
    members = keyed(spark, sf_dir)
    for way, most in (("task", 1000), ("rounds", 3)):
        made = cut(build.distance_trees(distances, (method,), members=members, task_members=most, task_joined=most))  # read several times
        own = _splits(made, members).withColumn("way", F.lit(way))
        out = own if out is None else out.unionByName(own)
    return out


@query(_SPLITS)
def nj_splits(spark, sf_dir):
    """Neighbour joining finds the tree that its distances come from, in a task and in rounds."""
    return _both_ways(spark, sf_dir, "nj", True)


@query(_SPLITS)
def upgma_splits(spark, sf_dir):
    """Averaging finds the tree of distances that have all leaves equally far from the root, in a task and in rounds."""
    return _both_ways(spark, sf_dir, "upgma", False)


@query(f"WITH {_SHARED} SELECT way, a.dataset, count_if(len(g.t) < len(a.t))::BIGINT AS changes FROM g JOIN a USING (dataset) CROSS JOIN (SELECT unnest(['task', 'rounds']) AS way) WHERE l < 20 AND len(g.t) > 1 GROUP BY ALL")
def parsimony_perfect(spark, sf_dir):
    """Sequences with a column for each clade of their tree: parsimony finds one change for each column that varies, in a task and in rounds."""
    k = keyed(spark, sf_dir)
    shared = k.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("dataset", "l", F.expr("shiftright(v, l)").alias("p"))
    columns = shared.groupBy("dataset", "l", "p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("l", "p"))).alias("c"))
    letters = F.transform("c", lambda x: F.when(F.call_function("shiftright", F.col("v"), x["l"]) == x["p"], F.lit("C")).otherwise(F.lit("A")))
    aligned = cut(k.join(columns, "dataset").select("dataset", "id", F.array_join(letters, "").alias("seq")))
    out = None
    for way, most in (("task", build.TASK_CELLS), ("rounds", 0)):
        made = cut(build.parsimony_trees(aligned, ("nj",), task_cells=most, cells=2000))
        own = build.parsimony_scores(made, aligned, _named(made), cells=2000).select(F.lit(way).alias("way"), F.regexp_extract("tree", r"^tree_([^_]*)_", 1).alias("dataset"), "changes")
        out = own if out is None else out.unionByName(own)
    return out


@query(
    f"WITH {_CODES}, k AS (SELECT dataset, count(*) AS n, min(id) AS first FROM d GROUP BY dataset), m AS (SELECT unnest(['nj_distance', 'upgma_distance', 'nj_parsimony', 'upgma_parsimony']) AS m) "
    "SELECT 'tree_' || dataset || '_mafft_' || m AS tree, n::BIGINT AS n_leaves, (n + CASE WHEN n = 1 THEN 0 WHEN m LIKE 'nj%' THEN greatest(n - 2, 1) ELSE n - 1 END)::BIGINT AS n_nodes, first FROM k CROSS JOIN m"
)
def grid_trees(spark, sf_dir):
    """From sequences to named trees, one aligner of the automatic grid: equal lengths are aligned already."""
    seqs = members(spark, sf_dir)
    grid = build.method_grid(seqs, "auto", "none").filter("aligner = 'mafft'")
    nodes = build.grid_trees(seqs, grid, {"mafft": lambda s: s.select("dataset", "id", "seq")})
    return nodes.groupBy("tree").agg(F.count_if("is_terminal").alias("n_leaves"), F.count(F.lit(1)).alias("n_nodes"), _cut(F.min(F.when(F.col("is_terminal"), F.col("name")))).alias("first"))


def sets(spark, sf_dir):
    """A dataset per supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("dataset"))


@query("SELECT s_name AS dataset, 'mafft' AS aligner, 'distance' AS method, 'upgma' AS submethod FROM supplier")
def method_single(spark, sf_dir):
    return build.method_grid(sets(spark, sf_dir), "single", single=("mafft", "upgma", None))


@query(
    "WITH g AS (SELECT s_name AS dataset, a AS aligner, m AS method, s AS submethod FROM supplier, unnest(['clustalo', 'mafft']) AS a(a), unnest(['distance', 'parsimony']) AS m(m), unnest(['nj', 'upgma']) AS s(s)) "
    "SELECT *, aligner || '_' || method || '_' || submethod || '_' || row_number() OVER (PARTITION BY aligner, method, submethod ORDER BY dataset) AS name FROM g"
)
def registry_names(spark, sf_dir):
    return build.registry_names(build.method_grid(sets(spark, sf_dir)))


@query(
    "WITH g AS (SELECT s_name AS dataset, a AS aligner, m AS method, s AS submethod FROM supplier, unnest(['clustalo', 'mafft']) AS a(a), unnest(['distance', 'parsimony']) AS m(m), unnest(['nj', 'upgma']) AS s(s)) "
    "SELECT * FROM g WHERE NOT (right(dataset, 1) < '4' AND submethod = 'nj')"
)
def missing_trees(spark, sf_dir):
    grid = build.method_grid(sets(spark, sf_dir))
    return build.missing_trees(grid, grid.filter("right(dataset, 1) < '4' and submethod = 'nj'"))


@query(
    "WITH d AS (SELECT DISTINCT s_name AS dataset FROM supplier), a AS (SELECT unnest(['clustalo', 'mafft']) AS aligner), m AS (SELECT unnest(['distance', 'parsimony']) AS method), s AS (SELECT unnest(['nj', 'upgma']) AS submethod) "
    "SELECT dataset, aligner, method, submethod FROM d CROSS JOIN a CROSS JOIN m CROSS JOIN s UNION ALL SELECT dataset, aligner, e, NULL FROM d CROSS JOIN a CROSS JOIN (SELECT unnest(['iqtree', 'fasttree', 'raxml']) AS e)"
)
def method_grid(spark, sf_dir):
    return build.method_grid(sets(spark, sf_dir), "advanced", "MrBayes, none")


@query(
    f"WITH {TREES}, k AS (SELECT tree, md5(array_to_string(list_sort(t), chr(31))) AS item, len(t) AS n, split_part(tree, '_', 1) AS base FROM c WHERE len(t) > 1), s AS (SELECT base, count(DISTINCT tree) AS rws FROM k GROUP BY base), "
    "f AS (SELECT k.base, item FROM k JOIN s USING (base) GROUP BY ALL HAVING count(DISTINCT tree) * 10 >= any_value(rws)) "
    "SELECT 'nodes' AS stage, true AS done, (SELECT count(*) FROM t) + (SELECT count(*) FROM c) AS rows, 2.0::DOUBLE AS largest, true AS timed UNION ALL SELECT 'subtrees', true, (SELECT count(*) FROM k), (SELECT max(n)::DOUBLE FROM k), true UNION ALL SELECT 'supports', true, (SELECT count(*) FROM f), 1.0, true"
)
def run_counters(spark, sf_dir):
    """A run's stages with what their tasks counted: the deepest node, the largest clade and the greatest support."""
    run = runs.Run(spark, "trees")
    nodes = run.saved(nation_trees(spark, sf_dir), "nodes", largest=F.max("depth"))
    found = run.saved(trees.subtrees(nodes).withColumn("base", F.substring_index("tree", "_", 1)), "subtrees", largest=F.max("n_terminals"))
    run.saved(mining.grid_supports(mining.item_counts(found, "base", "tree", "item")), "supports", largest=F.max("support"))
    return run.report().select("stage", "done", "rows", F.col("figures")["largest"].alias("largest"), (F.col("seconds") > 0).alias("timed"))
