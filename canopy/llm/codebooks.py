"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds over heaps of slack.

Components become integers; a vector is cut into four parts, and each part is replaced by the number of the nearest entry of its position's
codebook. Vectors lie in blocks, a row each, and a block holds, for each position and entry, a heap of the parts assigned there, keyed by how much
farther the second entry was than the own one when the part was last scanned. When entries move, a part's slack shrinks by no more than its own entry's move and the largest
move of another. These moves are summed up per entry (the cumulative drift), a key is stored on top of the drift at its time, and so a round pops from each
heap only the parts whose key the drift has reached. They are scanned against all entries, exactly; all others keep their entries for certain.
A tie between entries has no slack and is always scanned again, so that the lower index wins as in a full scan.

Rounds are passes over the blocks, each written to the shared folder with, per task, what moved: sums and counts of the parts that left or
joined an entry. Their totals, of the codebooks' size, reach the driver, which keeps exact whole sums and floors them. Blocks are never shuffled.

Distances are whole numbers: in doubles while they stay below 2^53, in integers of any size beyond.

Defined results: null vectors and vectors with a null or non-finite component are dropped; equal rows are rows of their own; a codebook has as many entries as there are vectors,
ENTRIES at most, by ascending vec_id (null ids last) and then by vector; vectors of each length have codebooks of their own, whose components over all lengths may be MOST_VALUES; a length that
four does not divide is cut at the floors of its quarters; an empty vector has the code 00000000 and no error; a component of 2^43 or more, or an error
that no long holds, raises; an empty table gives an empty result; columns besides id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.ball_tree import whole
from canopy.llm.scratch import Steps, saved

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 2048
#: Components of all codebooks together, at most: they are what reaches the driver.
MOST_VALUES = 1 << 23
EXACT = float(1 << 53)
#: Integers that parts and their sums hold as machine words; larger ones are summed as Python integers.
WORD = 1 << 31


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and last place of each part of a vector."""
    at = [i * dim // parts for i in range(parts + 1)]
    return list(zip(at, at[1:]))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, whole and exact: doubles, or Python integers where doubles might round."""
    top = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, x.shape[1]) < EXACT:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    a, b = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (x, entries))
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def scan(x: np.ndarray, entries: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower index), and how much farther the next one is."""
    own, slack = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(x), rows):
        d = distances(x[at : at + rows], entries)
        here = np.arange(len(d))
        own[at : at + rows] = first = d.argmin(axis=1)
        if len(entries) > 1:
            near = np.sqrt(d[here, first].astype(np.float64))
            d[here, first] = d.max() + 1
            slack[at : at + rows] = np.sqrt(d.min(axis=1).astype(np.float64)) - near
    return own, slack


class Moves:
    """Sums and counts of what joined and left the entries of one length, per position."""

    def __init__(self, entries: list[np.ndarray]):
        self.sums = [np.zeros((len(e), e.shape[1] + 1), object) for e in entries]

    def add(self, part: int, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
        if not len(entry):
            return
        kind = np.int64 if np.abs(x).max(initial=0) < WORD else object
        rows = np.concatenate([x.astype(np.int64), np.ones((len(x), 1), np.int64)], axis=1).astype(kind)
        total = np.zeros(self.sums[part].shape, kind)
        np.add.at(total, entry, rows)
        self.sums[part] = self.sums[part] + sign * total

    def rows(self, dim: int) -> Iterator[dict]:
        for part, table in enumerate(self.sums):
            for entry in np.flatnonzero((table != 0).any(axis=1)):
                yield {"dim": dim, "part": part, "entry": int(entry), "sums": [int(v) for v in table[entry]]}


class Heaps:
    """The heaps of one block and position: keys and rows of each entry's heap one after the other, and where each begins."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.keys, self.rows, self.starts = keys, rows, starts

    @classmethod
    def of(cls, heaps: list[list[tuple[float, int]]]) -> Heaps:
        flat = [pair for heap in heaps for pair in heap]
        keys, rows = np.array([p[0] for p in flat], np.float64), np.array([p[1] for p in flat], np.int32)
        return cls(keys, rows, np.concatenate([[0], np.cumsum([len(h) for h in heaps])]).astype(np.int32))

    def heap(self, entry: int) -> list[tuple[float, int]]:
        a, b = self.starts[entry], self.starts[entry + 1]
        return list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist()))

    def pop(self, drift: np.ndarray) -> tuple[list[int], dict[int, list]]:
        """The rows whose key the drift has reached, and the heaps that they left."""
        popped, left = [], {}
        filled = np.flatnonzero(self.starts[1:] > self.starts[:-1])
        reach = drift * (1 + 1e-9) + 1e-6
        for entry in filled[self.keys[self.starts[filled]] <= reach[filled]].tolist():
            left[entry] = heap = self.heap(entry)
            while heap and heap[0][0] <= reach[entry]:
                popped.append(heapq.heappop(heap)[1])
        return popped, left

    def push(self, left: dict[int, list], entries: list[int], keys: list[float], rows: list[int]) -> Heaps:
        """These heaps with rows pushed."""
        for entry, key, row in zip(entries, keys, rows):
            if entry not in left:
                left[entry] = self.heap(entry)
            heapq.heappush(left[entry], (key, row))
        if not left:
            return self
        n = len(self.starts) - 1
        pieces, sizes = [], np.diff(self.starts)
        for e in range(n):
            if e in left:
                heap = left[e]
                sizes[e] = len(heap)
                pieces.append((np.array([p[0] for p in heap], np.float64), np.array([p[1] for p in heap], np.int32)))
            else:
                pieces.append((self.keys[self.starts[e] : self.starts[e + 1]], self.rows[self.starts[e] : self.starts[e + 1]]))
        return Heaps(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


class Books:
    """Codebooks of one length, their entries' whole sums, and the drift of each entry."""

    def __init__(self, first: np.ndarray):
        self.entries = [first[:, a:b] for a, b in cuts(first.shape[1])]
        self.drift = [np.zeros(len(first)) for _ in range(PARTS)]
        self.totals = [np.zeros((len(first), e.shape[1] + 1), object) for e in self.entries]

    def update(self) -> None:
        """Each entry becomes the floor of its parts' mean; unused ones stay."""
        for p, (old, total) in enumerate(zip(self.entries, self.totals)):
            used = total[:, -1] > 0
            new = old.copy()
            new[used] = (total[used, :-1] // total[used, -1:]).astype(np.float64)
            moved = np.sqrt(((new - old) ** 2).sum(axis=1))
            other = np.full(len(moved), moved.max(initial=0))
            if len(moved) > 1:
                other[moved.argmax()] = np.partition(moved, -2)[-2]
            self.drift[p] = self.drift[p] + moved + other
            self.entries[p] = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


def _blocked(shared, label) -> tuple:
    """The first round: blocks with all parts scanned, and what joined each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves: dict[int, Moves] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own, books = np.flatnonzero(dims == dim), shared.value[dim]
                for at in range(0, len(own), BLOCK):
                    rows = batch.take(pa.array(own[at : at + BLOCK]))
                    x = rows.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, dim)
                    if np.abs(x).max(initial=0) >= EXACT:
                        raise ValueError("a component of 2^43 or more")
                    codes, heaps = np.zeros((PARTS, len(x)), np.uint8), []
                    for p, (a, b) in enumerate(cuts(dim)):
                        entry, slack = scan(x[:, a:b], books.entries[p])
                        moves.setdefault(dim, Moves(books.entries)).add(p, entry, x[:, a:b], 1)
                        made: list[list] = [[] for _ in books.entries[p]]
                        for i, (e, key) in enumerate(zip(entry.tolist(), slack.tolist())):
                            made[e].append((key, i))
                        for heap in made:
                            heapq.heapify(heap)
                        codes[p] = entry
                        heaps.append(Heaps.of(made))
                    yield _state(dim, rows.column("vec_id"), rows.column("label"), x, codes, heaps, len(x) * PARTS)
        yield from _moved(moves, label)

    return run


def _lists(values: pa.Array) -> pa.Array:
    """One row that holds all values as a list."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_FIELDS = ["dim", "vec_id", "label", "x", "codes", "keys", "rows", "starts", "scanned", "part", "entry", "sums"]


def _schema(label: str) -> str:
    return f"dim int, vec_id array<long>, label array<{label}>, x binary, codes binary, keys binary, rows binary, starts binary, scanned long, part int, entry int, sums array<long>"


def _state(dim: int, ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: np.ndarray, heaps: list[Heaps], scanned: int) -> pa.RecordBatch:
    one = lambda v, kind: pa.array([v], kind)
    small = np.abs(x).max(initial=0) < WORD
    blobs = [x.astype(np.int32 if small else np.float64), codes, *(np.concatenate([getattr(h, f) for h in heaps]) for f in ("keys", "rows", "starts"))]
    own = [one(dim, pa.int32()), _lists(ids), _lists(labels), *(one(b.tobytes(), pa.binary()) for b in blobs), one(scanned, pa.int64())]
    none = [one(None, pa.int32()), one(None, pa.int32()), one(None, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*own, *none], names=_FIELDS)


def _moved(moves: dict[int, Moves], label: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = [r for dim, m in moves.items() for r in m.rows(dim)]
    if not rows:
        return
    kinds = {"dim": pa.int32(), "vec_id": pa.list_(pa.int64()), "label": pa.list_(label), "scanned": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "sums": pa.list_(pa.int64())}
    yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], kinds.get(f, pa.binary())) for f in _FIELDS], names=_FIELDS)


def _opened(batch: pa.RecordBatch, i: int) -> tuple:
    """dim, x, codes and heaps of a block."""
    get = lambda f, kind: np.frombuffer(batch.column(f)[i].as_buffer() if batch.column(f)[i].is_valid else b"", kind)
    dim, n = batch.column("dim")[i].as_py(), len(batch.column("vec_id")[i])
    data = batch.column("x")[i].as_buffer()
    x = np.frombuffer(data, np.int32 if data.size == 4 * n * dim else np.float64).astype(np.float64).reshape(n, dim)
    keys, rows, starts = get("keys", np.float64).reshape(PARTS, n), get("rows", np.int32).reshape(PARTS, n), get("starts", np.int32).reshape(PARTS, -1)
    return dim, x, get("codes", np.uint8).reshape(PARTS, n).copy(), [Heaps(*h) for h in zip(keys, rows, starts)]


def _rescanned(shared, label):
    """A later round: parts that the drift has reached are scanned again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves: dict[int, Moves] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, x, codes, heaps = _opened(batch, i)
                books, scanned = shared.value[dim], 0
                for p, (a, b) in enumerate(cuts(dim)):
                    popped, left = heaps[p].pop(books.drift[p])
                    if not popped:
                        continue
                    own = np.array(popped)
                    part, old = x[own, a:b], codes[p, own].astype(np.int64)
                    entry, slack = scan(part, books.entries[p])
                    changed = entry != old
                    tally = moves.setdefault(dim, Moves(books.entries))
                    tally.add(p, old[changed], part[changed], -1)
                    tally.add(p, entry[changed], part[changed], 1)
                    heaps[p] = heaps[p].push(left, entry.tolist(), (slack + books.drift[p][entry]).tolist(), popped)
                    codes[p, own] = entry
                    scanned += len(popped)
                yield _state(dim, batch.column("vec_id")[i].values, batch.column("label")[i].values, x, codes, heaps, scanned)
        yield from _moved(moves, label)

    return run


def _coded(shared):
    """vec_id, label, code, error and codebooks_sha256 of each row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: dict[int, str] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, x, codes, _ = _opened(batch, i)
                books, error = shared.value[dim], np.zeros(len(x), object)
                for p, (a, b) in enumerate(cuts(dim)):
                    gap = x[:, a:b] - books.entries[p][codes[p]]
                    top = float(np.abs(gap).max(initial=0))
                    exact = gap.astype(np.int64) if top * top * max(1, b - a) < EXACT else np.array([[int(v) for v in r] for r in gap], object).reshape(gap.shape)
                    error = error + (exact * exact).sum(axis=1)
                hexed = codes.T.copy().tobytes().hex()
                text = [hexed[j : j + 2 * PARTS] for j in range(0, len(hexed), 2 * PARTS)]
                digest = digests.setdefault(dim, books.digest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(text), pa.array([int(e) for e in error], pa.int64()), pa.array([digest] * len(text))],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return run


def _books(base: DataFrame) -> dict[int, Books]:
    """The first codebooks: of each length the first ENTRIES vectors."""
    lengths = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    values = lengths.agg(F.sum(F.least("n", F.lit(ENTRIES)) * (F.col("dim") + 1))).first()[0] or 0
    if values > MOST_VALUES:
        raise ValueError(f"codebooks of {values} components over all lengths of vectors, more than {MOST_VALUES}")
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "x")
    first = base.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= ENTRIES).select("dim", "_at", "x").toPandas().sort_values(["dim", "_at"])
    return {int(dim): Books(np.array(own["x"].to_list(), np.float64).reshape(len(own), int(dim))) for dim, own in first.groupby("dim")}


def _apply(books: dict[int, Books], state: DataFrame) -> None:
    """Adds what moved in a round to the totals, and moves the entries: as many numbers as codebooks have."""
    rows = state.filter("part is not null").select("dim", "part", "entry", F.posexplode("sums").alias("at", "v"))
    rows = rows.groupBy("dim", "part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("long").alias("v"))
    for dim, part, entry, at, v in zip(*(c.to_pylist() for c in rows.toArrow().columns)):
        books[dim].totals[part][entry, at] += v
    for own in books.values():
        own.update()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, rounds: int = ROUNDS, scanned: list | None = None) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector.

    scanned, if given, gets the number of parts that each pass scans against all entries.
    """
    spark = vectors.sparkSession
    steps = Steps(spark)
    x = F.col(vector)
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.coalesce(whole(x, scale), F.when(F.size(x) == 0, F.array().cast("array<double>"))).alias("x"))
    base = steps.saved(base.filter("x is not null").withColumn("dim", F.size("x")), "vectors")
    kind = base.schema["label"].dataType
    schema, arrow = _schema(kind.simpleString()), base.select("label").limit(0).toArrow().schema.field("label").type
    books = _books(base)
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        if turn == 0:
            state = steps.saved(base.mapInArrow(_blocked(shared, arrow), schema), "state")
        else:
            state = steps.saved(state.filter("part is null").mapInArrow(_rescanned(shared, arrow), schema), "state")
        if scanned is not None:
            scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
        if turn < rounds:
            _apply(books, state)
    out = "vec_id long, label " + kind.simpleString() + ", code string, error long, codebooks_sha256 string"
    rows = steps.saved(state.filter("part is null").mapInArrow(_coded(spark.sparkContext.broadcast(books)), out), "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    found = rows.join(sums, rows["label"].eqNullSafe(sums["_label"])).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    found = saved(found, "compressed")
    steps.clear()
    return found
