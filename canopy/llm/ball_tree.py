"""Exact top-k by inner product: ball-tree branch and bound per shard.

Every vector goes to the nearest of some centres, fitted on a sample of SAMPLE_ROWS and SAMPLE_VALUES at most (documented bounds; the index holds
every row), so that shards are compact; a cluster beyond a shard's size is split by row. Each shard's ball tree is built and saved once: every node has
a centre, a radius and its smallest id. No vector of a node can score more with a query q than q.centre + |q| radius, so nodes are
opened in the order of that bound and a search ends where the bound falls below the kth score so far.

The kth score is shared between shards in rounds. First each query searches one shard alone, its home, and so learns k scores that are
reached for certain. The shards' roots, small and of a bounded size, are known to all tasks: of the other shards, a query is sent only to those whose
root's bound reaches its kth score, the NEXT best of them first, then, with the kth score found there, the rest. All rounds' candidates, k a shard
at most, are merged per query by score and id.

Of vectors that are equal, only those of the k + 1 smallest ids can be among the k best of any query; the others stay out of the
shards, so that a vector that a third of all rows hold costs no more than a few.

Scores are inner products of integers (floor(scale * component)); a score is exact in double arithmetic while it stays
below 2^53, and vectors beyond that are scored in integers of any size.

Defined results: vectors that are null, empty, or hold a null or a component that is not finite take no part; vectors of another
length than the query's, and rows of the query's own id, are no candidates; ties go to the smaller id; a query
without candidates has no rows; a score beyond a long raises; columns besides id and vector are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.scratch import saved

SCALE = 256
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF_ROWS = 64
SAMPLE_ROWS = 1 << 15
#: Components of the sample, at most, so that long vectors do not fill the driver.
SAMPLE_VALUES = 1 << 21
#: Vectors of the sample for each centre, at least.
PER_CENTRE = 16
#: All roots' bytes, at most: shards grow instead.
ROOT_BYTES = 1 << 26
NEXT = 4
EXACT = float(1 << 53)


class BallTree:
    """A ball tree over the rows of x (float64, whole numbers) with ids (int64)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids, self.leaf = x[order], ids[order], leaf
        self.top = float(np.abs(self.x).max(initial=0.0)) ** 2 * self.x.shape[1]
        self.centres, self.radii, self.least, self.children, self.rows = [], [], [], [], []
        if len(x):
            self._node(np.arange(len(x)))
        self.centres = np.array(self.centres).reshape(len(self.radii), x.shape[1])
        self.radii = np.array(self.radii)

    def _node(self, rows: np.ndarray) -> int:
        me, x = len(self.radii), self.x[rows]
        centre = x.mean(axis=0)
        far = np.sqrt(((x - centre) ** 2).sum(axis=1))
        self.centres.append(centre)
        self.radii.append(float(far.max()))
        self.least.append(int(self.ids[rows].min()))
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > self.leaf and self.radii[me] > 0:
            # two far points; each row goes to the nearer one, half to each at ties of position
            a = x[far.argmax()]
            from_a = ((x - a) ** 2).sum(axis=1)
            b = x[from_a.argmax()]
            lean = from_a - ((x - b) ** 2).sum(axis=1)
            left = lean <= 0
            if left.sum() < len(rows) // 16 or (~left).sum() < len(rows) // 16:
                left = np.zeros(len(rows), bool)
                left[np.argsort(lean, kind="stable")[: len(rows) // 2]] = True
            self.children[me] = (self._node(rows[left]), self._node(rows[~left]))
            self.rows[me] = None
        return me

    def search(self, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) for q that score floor at least; rows with id own are left out."""
        if not len(self.radii):
            return []
        size = float(np.sqrt((q * q).sum()))
        big = max(self.top, size * size) >= EXACT
        bounds = self.centres @ q + size * self.radii
        bounds += 1e-9 * (np.abs(bounds) + size * (self.radii + np.sqrt((self.centres**2).sum(axis=1)))) + 1e-6
        found: list[tuple[int, int]] = []  # a heap whose first is the worst: (score, -id)
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            worst = found[0][0] if len(found) == k else floor
            if -bound < worst:
                break
            # at one score the smaller ids win: nothing to gain from a node of larger ids
            if len(found) == k and -bound < worst + 1 and self.radii[node] == 0 and self.least[node] > -found[0][1]:
                continue
            kids = self.children[node]
            if kids:
                for kid in kids:
                    if bounds[kid] >= worst:
                        heapq.heappush(todo, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            if big:
                exact = [int(v) for v in q]
                scores = [sum(int(a) * b for a, b in zip(self.x[r], exact)) for r in rows]
            else:
                scores = self.x[rows] @ q
                near = np.flatnonzero((scores >= worst) & (self.ids[rows] != own))
                # rows are in the order of their ids, so that k of each score are enough
                if len(near) > 4 * k:
                    near = near[np.argsort(-scores[near], kind="stable")[:k]]
                rows, scores = rows[near], scores[near].tolist()
            for r, score in zip(rows.tolist(), scores):
                row = (int(score), -int(self.ids[r]))
                if -row[1] == own or row[0] < floor:
                    continue
                if len(found) < k:
                    heapq.heappush(found, row)
                elif row > found[0]:
                    heapq.heapreplace(found, row)
        return sorted(((s, -i) for s, i in found), key=lambda x: (-x[0], x[1]))


def upper_bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each query (row) and ball: a score that no vector of the ball exceeds, with what rounding may take."""
    size = np.sqrt((q * q).sum(axis=1))[:, None]
    out = q @ centres.T + size * radii
    return out + 1e-9 * (np.abs(out) + size * (radii + np.sqrt((centres**2).sum(axis=1)))) + 1e-6


def fitted(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of a sample by a few rounds of k-means from rows spread over it; fewer where rows are equal."""
    centres = np.unique(sample[np.linspace(0, len(sample) - 1, n).astype(int)], axis=0)
    for _ in range(rounds):
        own = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        times = np.bincount(own, minlength=len(centres))
        centres = np.where(times[:, None] > 0, sums / np.maximum(times, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 1024) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + block] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null where the vector takes no part.

    From 2^52 on, a double times a power of two is whole already and may be too large for Spark's floor.
    """
    scaled = lambda v: v.cast("double") * F.lit(float(scale))
    x = F.transform(vector, lambda v: F.when(F.abs(scaled(v)) < F.lit(2.0**52), F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.when(F.coalesce(F.size(vector), F.lit(0)) > 0, F.when(~bad, x))


_FOUND = "query_id long, vec_id long, score long"
_SHARD = ["dim", "cluster", "part"]
_TREE = "dim int, cluster int, part int, centre array<double>, radius double, tree binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with vectors of one length each (column dim)."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            for at in range(0, len(own), rows):
                yield int(dim), batch.take(pa.array(own[at : at + rows]))


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(np.stack(rows["x"].to_list()).astype(np.float64), rows["vec_id"].to_numpy(np.int64))
    first = rows.iloc[0]
    out = {"dim": first["dim"], "cluster": first["cluster"], "part": first["part"], "centre": tree.centres[0].tolist(), "radius": float(tree.radii[0]), "tree": pickle.dumps(tree)}
    return pd.DataFrame([out])


def _searched(trees: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    if len(trees) and len(queries):
        tree: BallTree = pickle.loads(trees["tree"].iloc[0])
        for qid, q, floor in zip(queries["vec_id"], queries["x"], queries["floor"]):
            floor = -np.inf if floor is None or np.isnan(floor) else floor
            out += [(int(qid), i, s) for s, i in tree.search(np.asarray(q, np.float64), int(qid), k, floor)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def index(base: DataFrame, counts: dict[int, int], shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The saved shards of base (dim, row, vec_id, x): dim, cluster, part, centre, radius and tree. counts: rows by length of vector."""
    centres: dict[int, np.ndarray] = {}
    for dim, n in counts.items():
        size, most = max(shard_rows, -(-n * (dim + 1) * 8 // ROOT_BYTES)), min(sample_rows, max(PER_CENTRE, SAMPLE_VALUES // dim))
        own = base.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("row", F.lit(7)), F.lit(max(1, n // max(1, most // 2)))) == 0))
        clusters = min(-(-n // size), max(1, most // PER_CENTRE))
        sample = _matrix(own.select("x").limit(most).toArrow().column("x").combine_chunks()) if clusters > 1 else np.zeros((0, dim))
        centres[dim] = fitted(sample, min(clusters, len(sample))) if len(sample) else np.zeros((1, dim))
    shared = base.sparkSession.sparkContext.broadcast(centres)
    names = base.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_length(batches):
            own = nearest(_matrix(batch.column("x")), shared.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*names, "cluster"])

    dealt = saved(base.mapInArrow(assign, base.withColumn("cluster", F.lit(0)).schema), "assigned")
    rows = F.element_at(F.create_map(*[F.lit(x) for dim, n in counts.items() for x in (dim, max(shard_rows, -(-n * (dim + 1) * 8 // ROOT_BYTES)))]), F.col("dim"))
    parts = dealt.groupBy("dim", "cluster").agg(F.ceil(F.count(F.lit(1)) / F.first(rows)).cast("int").alias("_parts"))
    # a row per cluster: as many as a length's sample has centres at most
    dealt = dealt.join(F.broadcast(parts), ["dim", "cluster"]).withColumn("part", F.pmod(F.xxhash64("row"), "_parts").cast("int"))
    return saved(dealt.select(*_SHARD, "vec_id", "x").groupBy(*_SHARD).applyInPandas(_built, _TREE), "trees")


def roots_of(trees: DataFrame) -> dict[int, tuple]:
    """Centres, radii, clusters and parts of the shards by length of vector: ROOT_BYTES at most for each length."""
    roots = {}
    for dim, own in trees.drop("tree").toPandas().groupby("dim"):
        own = own.sort_values(["cluster", "part"])
        roots[int(dim)] = (np.stack(own["centre"].to_list()), own["radius"].to_numpy(), own["cluster"].to_numpy(np.int32), own["part"].to_numpy(np.int32))
    return roots


def routed(queries: DataFrame, shared: Broadcast, turn: int, turns: tuple[int, ...] = (1, NEXT)) -> DataFrame:
    """queries (dim, row, vec_id, x, floor) with each shard that they go to in a turn: the home first, all that reach the floor at last. shared: roots_of."""
    first, last = sum(turns[:turn]), sum(turns[: turn + 1]) if turn < len(turns) else None
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_length(batches, 256):
            centres, radii, cluster, part = shared.value[dim]
            q = _matrix(batch.column("x"))
            bounds = upper_bounds(q, centres, radii)
            # the home is the shard of the best centre; the others go by their bounds
            order = bounds.copy()
            order[np.arange(len(q)), (q @ centres.T).argmax(axis=1)] = np.inf
            place = np.argsort(-order, axis=1, kind="stable")[:, first:last]
            floor = np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            goes = np.take_along_axis(bounds, place, axis=1) >= floor[:, None]
            at, where = np.repeat(np.arange(len(q)), goes.sum(axis=1)), place[goes]
            for i in range(0, len(at), 8192):
                rows = batch.take(pa.array(at[i : i + 8192]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cluster[where[i : i + 8192]]), pa.array(part[where[i : i + 8192]])], names=[*names, "cluster", "part"])

    return queries.mapInArrow(run, queries.withColumns({"cluster": F.lit(0), "part": F.lit(0)}).schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, shard_rows: int = SHARD_ROWS, visits: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of each row of vectors (vec_id, embedding) that is_query names.

    visits, if given, gets the number of searches of a shard in each turn. Lengths of vectors are few: a row of each comes to the driver.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("x"))
    base = base.filter("x is not null and vec_id is not null")
    base = saved(base.withColumns({"dim": F.size("x"), "row": F.monotonically_increasing_id()}), "vectors")
    same = Window.partitionBy(F.xxhash64("x"), "x")
    first = base.withColumn("_id", F.dense_rank().over(same.orderBy("vec_id"))).filter(F.col("_id") <= k + 1)
    first = first.withColumn("_time", F.row_number().over(Window.partitionBy(F.xxhash64("x"), "x", "vec_id").orderBy("row"))).filter(F.col("_time") <= k)
    kept = saved(first.select("dim", "row", "vec_id", "x"), "candidates")
    counts = {r["dim"]: r["n"] for r in kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    trees = index(kept, counts, shard_rows)
    shared = trees.sparkSession.sparkContext.broadcast(roots_of(trees))
    queries = base.filter(is_query).select("dim", "row", "vec_id", "x")

    def search(asked: DataFrame) -> DataFrame:
        run = lambda key, a, b: _searched(a, b, k)
        asked = saved(asked, "asked")
        blocks = saved(asked.groupBy(*_SHARD).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("_blocks")), "blocks")
        if visits is not None:
            visits.append(blocks.agg(F.sum("n")).first()[0] or 0)
        side = trees.select(*_SHARD, "tree").join(blocks, _SHARD).select(*_SHARD, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), "tree")
        own = asked.join(blocks, _SHARD).select(*_SHARD, F.pmod(F.xxhash64("row"), "_blocks").cast("int").alias("block"), "vec_id", "x", "floor")
        own, pair = own.toDF(*own.columns), [*_SHARD, "block"]
        return side.groupBy(*pair).cogroup(own.groupBy(*pair)).applyInPandas(run, _FOUND)

    found, turns = None, (1, NEXT)
    for turn in range(len(turns) + 1):
        if found is None:
            asked = queries.withColumn("floor", F.lit(None).cast("double"))
        else:
            kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).cast("double")
            asked = queries.join(found.groupBy(F.col("query_id").alias("vec_id")).agg(kth.alias("floor")), "vec_id", "left").select(*queries.columns, "floor")
        new = saved(search(routed(asked, shared, turn, turns)), "found")
        found = new if found is None else found.unionByName(new)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
