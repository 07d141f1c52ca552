"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS bits have a value between them that is within half of RADIUS of both. So every distinct
fingerprint emits itself and all values within half the radius (65 of them for 64 bits and radius 2), the variants are shuffled
by value, and fingerprints that meet at one variant collide. All that meet there are within RADIUS of each other; the
smallest is linked to each of the others once the bits in which they differ have been counted. Links become groups by connected components.

Equal fingerprints are combined before anything is emitted, a variant is met by 65 fingerprints at most, and no pair
table of a group's members is ever made, so thousands of copies cost no more than one document each. A variant's row is its value and
the flipped bit; the fingerprint follows from both.

Two bits are far less than texts of a shingle similarity of 0.8 differ by, so ``similar_groups`` takes the pairs that balls find first, and
further candidates from BANDS bands of ROWS minima of shingle hashes: those that share a band, and those that balls link, are compared by their true shingle sets before they are linked.
Equal word sequences are one before anything is emitted. In every band's bucket one text is compared with all others: the one whose bands are
shared most, so that the buckets of a group of near copies agree on a few. Texts of buckets that this leaves in different groups meet by
prefixes: of their shingles in the order of how rare they are among these texts, two texts of a similarity of 0.8 share one of the first
ninth of the smaller and the first fifth of the larger. That loses no pair of them, and neither a group nor a passage that many hold makes all pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows are rows of one
group; a text with fewer words than a shingle is one shingle; an empty table gives an empty result; a null doc_id stays in
its group but never names it, except in a group without any other. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.components import components
from canopy.llm.scratch import Steps, saved

RADIUS = 2
SHINGLE = 3
SEED = 42
BANDS = 32
ROWS = 5
BLOCK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of data, in lists from about size bytes each."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = _SPACE.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].lower().split()
        at = end


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, eight bytes (high ones first) each, by blocks; of all words together where they are fewer."""
    digest, any_, words = xxhash.xxh64_digest, False, []
    for more in _word_blocks((text or "").encode("utf-8", "surrogatepass")):
        words = words[len(words) - shingle + 1 :] + more if len(words) >= shingle else words + more
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
        any_ = True
        yield np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    if words and not any_:
        yield np.frombuffer(digest(b" ".join(words), SEED), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned: a bit is set if it is set in over half the shingle hashes."""
    return _majority(_shingle_hashes(text, shingle))


def _majority(found: Iterable[np.ndarray]) -> int:
    """The fingerprint of shingle hashes that come in blocks of rows of eight bytes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in found:
        ones += np.add.reduce(np.unpackbits(hashes, axis=1), axis=0, dtype=np.uint32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text (uint64), in order."""
    return _distinct(_shingle_hashes(text, shingle))


def _distinct(found: Iterable[np.ndarray]) -> np.ndarray:
    blocks = [h.view(np.uint64).ravel() for h in found]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def word_hash(text: str | None) -> int:
    """A 64-bit hash of a text's word sequence."""
    out = xxhash.xxh3_64()
    for words in _word_blocks((text or "").encode("utf-8", "surrogatepass")):
        if words:
            out.update(b" ".join(words) + b" ")
    return out.intdigest()


_FACTORS, _OFFSETS = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = 2 * _FACTORS + np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash (uint64) for each band of minima of a set of shingle hashes; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        mixed = (shingles[at : at + 4096] ^ _OFFSETS) * _FACTORS
        least = np.minimum(least, mixed.min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """keep and fp (the fingerprint as a signed long) of every row."""
    names = [c for c in keep if c != "fp"]
    # columns go by their places, so that any name may be kept
    rows = docs.select(*names, F.col(text)).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    schema = rows.drop(f"c{len(names)}").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, schema).toDF(*names, "fp")


def links(distinct: DataFrame) -> DataFrame:
    """u and v (long): fingerprints within RADIUS bits of each other, the smallest at each variant with the others there."""
    bit = F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit")
    emitted = distinct.select("fp", bit).select(
        F.expr("if(bit < 0, fp, fp ^ shiftleft(1L, bit))").alias("variant"), F.col("bit").cast("byte").alias("bit")
    )
    met = (
        emitted.repartition("variant")
        .groupBy("variant")
        .agg(F.bit_or(F.expr("if(bit < 0, 0L, shiftleft(1L, cast(bit as int)))")).alias("flips"), F.bool_or(F.col("bit") < 0).alias("itself"))
        .filter("bit_count(flips) + if(itself, 1, 0) > 1")
    )
    members = F.expr("transform(filter(sequence(-1, 63), b -> if(b < 0, itself, (shiftright(flips, greatest(b, 0)) & 1) = 1)), b -> if(b < 0, variant, variant ^ shiftleft(1L, greatest(b, 0))))")
    pairs = met.select(members.alias("m")).select(F.array_min("m").alias("u"), F.explode("m").alias("v"))
    return pairs.filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))


def groups(fps: DataFrame) -> DataFrame:
    """fp and component_id (the smallest doc_id reachable) for every distinct fp of fps (doc_id, fp)."""
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    known = saved(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(names, "root").select("fp", "component_id")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts and shingle sets at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """keep, fp (the hash of the word sequence), ball (the fingerprint) and bands of every row of docs."""
    rows = docs.select(*keep, "text")
    schema = rows.select(*keep, F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("ball"), F.array().cast("array<long>").alias("bands")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(len(keep)).to_pylist()
            fp = pa.array(np.array([word_hash(t) for t in texts], np.uint64).view(np.int64), pa.int64())
            balls, found = [], []
            for t in texts:
                hashes = list(_shingle_hashes(t, shingle))
                balls.append(_majority(hashes))
                found.append(bands(_distinct(hashes)).view(np.int64))
            ball = pa.array(np.array(balls, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fp, ball, pa.array(found, pa.list_(pa.int64()))], names=[*keep, "fp", "ball", "bands"])

    return rows.mapInArrow(run, schema)


def ball_pairs(distinct: DataFrame) -> DataFrame:
    """u and v: texts of distinct (fp, ball) whose fingerprints are within RADIUS bits: of one fingerprint the first with each other, of two that are linked the first of both."""
    first = saved(distinct.groupBy("ball").agg(F.min("fp").alias("first")), "balls")
    same = distinct.join(first, "ball").filter("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    ends = [first.toDF(f"ball_{x}", x) for x in "uv"]
    near = links(first.select(F.col("ball").alias("fp"))).distinct().toDF("ball_u", "ball_v")
    return same.unionByName(near.join(ends[0], "ball_u").join(ends[1], "ball_v").select("u", "v"))


def similar_groups(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """fp and component_id (the smallest doc_id reachable) for every distinct fp of rows (doc_id, _id, _hash, fp, ball, bands).

    Candidates are the pairs of ``ball_pairs`` and those of the bands. Links are pairs whose shingle sets share similarity or more of their union; texts has the _id, _hash and text of rows.
    """
    steps = Steps(rows.sparkSession)
    one = F.min(F.struct("_id", "_hash")).alias("one")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("ball").alias("ball"), one), "distinct")
    balls = steps.saved(ball_pairs(distinct.select("fp", "ball")), "ball_pairs")
    met = rows.select("fp", F.explode("bands").alias("band")).distinct()
    often = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = steps.saved(met.join(often, "band"), "members")
    weight = steps.saved(member.groupBy("fp").agg(F.sum("n").alias("w")), "weights")
    named = weight.select("fp").union(balls.select("u")).union(balls.select("v")).distinct()
    wanted = distinct.join(named, "fp").select("fp", "one.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["fp", "s"])

    # rows of one _id and _hash have one text
    read = texts.join(wanted, ["_id", "_hash"]).select("fp", "text").dropDuplicates(["fp"]).mapInArrow(run, "fp long, s array<long>")
    sets = steps.saved(read, "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return steps.saved(both.filter(shared / (F.size("a") + F.size("b") - shared) >= F.lit(similarity)).select("u", "v"), "links")

    centre = member.join(weight, "fp").groupBy("band").agg(F.max(F.struct("w", "fp"))["fp"].alias("u"))
    starred = member.join(centre, "band").filter("u <> fp").select("u", F.col("fp").alias("v")).distinct()
    found = linked(starred.unionByName(balls).distinct())
    roots = components(found).toDF("fp", "root")
    # texts of buckets whose members are not of one group yet
    rooted = steps.saved(member.select("fp", "band").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    left = steps.saved(rooted.join(split, "band").select("fp", "root").distinct(), "left")
    found = found.unionByName(linked(prefix_pairs(left.join(sets, "fp"), similarity)))
    known = distinct.join(components(found).toDF("fp", "root"), "fp", "left")
    known = saved(known.select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    steps.clear()
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(names, "root").select("fp", "component_id")


def prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """u and v: all pairs of rows (fp, root, s) of different roots whose sets s could share so much of their union.

    Of two such sets, the smaller shares 2 similarity / (1 + similarity) of its own members with the larger, and the larger
    similarity of its own. So in any one order of all members they share one among as many of the first as may be missing, and one more. The order is by
    how many rows hold a member, so that members of many rows come last; those of one row come first and meet nothing.
    """
    each = rows.select("fp", "root", F.size("s").alias("size"), F.explode("s").alias("h"))
    times = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = each.join(times, "h").groupBy("fp").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "h"))).alias("l"))
    alone = F.col("size") - F.size("l")
    first = lambda share: (F.col("size") - F.ceil(F.col("size") * share - 1e-9).cast("int") + 1 - alone)
    cut = listed.withColumns({"_few": first(2 * similarity / (1 + similarity)), "_many": first(similarity)}).filter("_many > 0")
    # at: the place among all of the set's members, in that order
    keys = cut.select("fp", "root", "size", "_few", alone.alias("alone"), F.posexplode(F.slice("l", F.lit(1), F.col("_many"))).alias("i", "x"))
    keys = keys.select("fp", "root", "size", (F.col("i") < F.col("_few")).alias("few"), (F.col("alone") + F.col("i")).alias("at"), F.col("x.h").alias("h"))
    small = keys.filter("few").select("h", F.col("fp").alias("u"), F.col("root").alias("ru"), F.col("size").alias("su"), F.col("at").alias("iu"))
    large = keys.select("h", F.col("fp").alias("v"), F.col("root").alias("rv"), F.col("size").alias("sv"), F.col("at").alias("iv"))
    near = (F.struct("su", "u") < F.struct("sv", "v")) & (F.col("su") >= F.col("sv") * similarity - 1e-9)
    # no more is shared than stands at or after the first that is
    least = (F.col("su") + F.col("sv")) * (similarity / (1 + similarity)) - 1e-6
    enough = (F.col("su") - F.col("iu") >= least) & (F.col("sv") - F.col("iv") >= least)
    met = small.join(large, "h").filter((F.col("ru") != F.col("rv")) & near & enough)
    return met.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    fps = saved(fingerprints(docs, text), "fps")
    out = fps.join(groups(fps), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of each group of near-duplicates, with the columns that it came with: that of the smallest doc_id.

    With similarity, texts are near-duplicates if their sets of shingles share so much of their union; without, if their
    fingerprints are within RADIUS bits. Rows of one doc_id are told apart by their text; of rows equal in both, one stays.
    """
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash")]
    told = docs.select("doc_id", "text", *identity)
    if similarity is None:
        fps = saved(fingerprints(told, keep=("doc_id", "_id", "_hash"), shingle=shingle), "fps")
        found = groups(fps.select("doc_id", "fp"))
    else:
        fps = saved(signatures(told, shingle, ("doc_id", "_id", "_hash")), "fps")
        found = similar_groups(fps, told, shingle, similarity)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("_id"), F.col("_hash")))
    grouped = fps.join(found.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"))
    # a group is named by its smallest doc_id; where that is null, by its fingerprint
    key = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("_alone")]
    chosen = grouped.groupBy(*key).agg(best.alias("b")).select("b._id", "b._hash")
    times = fps.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_times"))
    chosen = saved(chosen.join(times, ["_id", "_hash"]), "chosen")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), *identity).join(chosen, ["_id", "_hash"])
    once = rows.filter("_times = 1").select("_doc")
    more = rows.filter("_times > 1").groupBy("_id", "_hash").agg(F.first("_doc").alias("_doc")).select("_doc")
    return once.unionByName(more).select("_doc.*")
