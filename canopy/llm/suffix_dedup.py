"""Substring dedup: every byte covered by a string of LEAST bytes that also starts anywhere else is removed.

The strings are found by a run-length index (``run_index``) with streamed matching statistics. One index of a whole corpus does not
fit one machine, so the corpus is dealt to many small indexes without losing a match:

1. Every string of LEAST bytes has an *anchor*, the first of smallest hash among its substrings of ANCHOR bytes. It depends on
   the string alone, so equal strings have equal anchors. Starts that follow each other and share the place of their anchor form a
   stretch, and the bytes of its strings are its context. Contexts of one document share no start.
2. Anchors are counted over all documents. An anchor of one stretch has no repeated string, and its stretch is done.
3. Stretches of one anchor with equal contexts (by hash and length) are copies: all their strings are repeated.
4. Of anchors with several different contexts, one of each goes to the bucket of its anchor. Each bucket's contexts are indexed
   and every start whose matching statistic reaches LEAST is repeated.
5. An anchor with more than MAX_VARIANTS contexts (a passage that very many documents hold, near its ends) is too large
   for one bucket: there the hashes of the single strings are counted instead, combined in each task before they are
   shuffled, which is the same decision.

Strings may be counted in words instead of bytes: a text is then read as the 32-bit hashes of its words, and every symbol of the search is
one of them. So passages of some number of words are found however short their words are.

So no step gathers a hot passage in one task: counts are combined first, joins are of the kind whose large partitions Spark splits,
and a bucket's bytes are bounded. Rows equal in doc_id and text are one document where contexts are cut, and occurrences each where they are counted.
Steps are written to the shared folder. A document of any length is read in blocks.

Defined results: a null text is empty; a text shorter than LEAST keeps all bytes; overlapping occurrences count, in one
document, too; repeated rows are occurrences each; an empty table gives an empty result; ``digests`` reads no columns besides id and text,
and ``remove_repeats`` hands all others on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.run_index import RunIndex
from canopy.llm.scratch import Steps, saved

LEAST = 400
ANCHOR = 200
BLOCK = 1 << 20
BUCKET_BYTES = 500_000
MAX_VARIANTS = 2048
#: Tasks that buckets are dealt to, at most; a size, not a bound on buckets.
BUCKET_TASKS = 100_000
WORD_BYTES = 4
PASSAGE_WORDS = 51
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bits for a place in a block.
_PLACE = np.uint64((1 << 21) - 1)


@lru_cache(1)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_MULTIPLIER, n), _powers(_INVERSE, n)


def _word_values(codes: np.ndarray) -> np.ndarray:
    out = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _block_stretches(data: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and anchor hash (int64) of each stretch of a block of at least least symbols (bytes or uint32)."""
    n = len(data)
    power, back = _power_tables(BLOCK + max(least, LEAST) + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_VALUE[data] if data.dtype == np.uint8 else _word_values(data)) * power[:n], out=sums[1:])
    h = (sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # minima over a sliding window, from the minima before and after the borders of tiles as long as it; the low
    # bits hold the place, so that of equal hashes the first counts, and texts that repeat in short periods change anchors
    w = least - anchor + 1
    m = len(h)
    placed = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
    tiles = np.concatenate([placed, np.full(-m % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    up = np.minimum.accumulate(tiles, axis=1).ravel()
    down = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(down[: m - w + 1], up[w - 1 : m])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return first, np.diff(np.r_[first, len(low)]), h[low[first] & _PLACE].view(np.int64)


def stretches(data: bytes, least: int = LEAST, anchor: int = ANCHOR, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of a text of symbols of width bytes: first start, number of starts, anchor hash."""
    out, kind = [], np.dtype("u1" if width == 1 else "<u4")
    size = len(data) // width
    for at in range(0, max(size - least + 1, 0), BLOCK):
        block = np.frombuffer(data, kind, min(BLOCK + least - 1, size - at), at * width)
        first, n, value = _block_stretches(block, least, anchor)
        out.append((first + at, n, value))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))


def word_codes(data: memoryview) -> bytes:
    """The 32-bit hashes of a text's words, one after the other."""
    return b"".join(map(xxhash.xxh32_digest, bytes(data).split()))


def _identified(docs: DataFrame, *more: str) -> DataFrame:
    """_id, _hash (they tell documents apart), _text and more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


_STRETCH = "_id long, _hash long, lo long, n int, anchor long, context long"


def _view(text: pa.Scalar, code: Callable[[memoryview], bytes] | None) -> memoryview:
    data = memoryview(text.as_buffer() or b"")
    return memoryview(code(data)) if code else data


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts at once besides those that it was sent."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _find(batches: Iterator[pa.RecordBatch], least: int, anchor_size: int, code: Callable[[memoryview], bytes] | None) -> Iterator[pa.RecordBatch]:
    digest, w = xxhash.xxh3_64_intdigest, WORD_BYTES if code else 1
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        which, los, sizes, anchors, contexts, held = [], [], [], [], [], 0

        def made() -> pa.RecordBatch:
            rows = np.concatenate(which)
            columns = [ids[rows], hashes[rows], np.concatenate(los), np.concatenate(sizes).astype(np.int32), np.concatenate(anchors), np.array(contexts, np.uint64).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_id", "_hash", "lo", "n", "anchor", "context"])

        for i, text in enumerate(batch.column(2)):
            view = _view(text, code)
            if len(view) < w * least:
                continue
            lo, n, anchor = stretches(view, least, anchor_size, w)
            contexts += [digest(view[a:b]) for a, b in zip((w * lo).tolist(), (w * (lo + n + least - 1)).tolist())]
            which.append(np.full(len(lo), i))
            los.append(lo)
            sizes.append(n)
            anchors.append(anchor)
            held += len(lo)
            if held > 200_000:
                yield made()
                which, los, sizes, anchors, contexts, held = [], [], [], [], [], 0
        if held:
            yield made()


def _context_rows(batches: Iterator[pa.RecordBatch], least: int, code: Callable[[memoryview], bytes] | None) -> Iterator[pa.RecordBatch]:
    """From _id, _hash, _text, bucket lists: one row per stretch, with its context."""
    w = WORD_BYTES if code else 1
    for batch in batches:
        rows = []
        for doc, own, text, parts in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3)):
            view = _view(text, code)
            for p in parts.as_py():
                rows.append((p["bucket"], doc, own, p["lo"], p["n"], p["copies"], bytes(view[w * p["lo"] : w * (p["lo"] + p["n"] + least - 1)])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXTS)], schema=_CONTEXTS)


_CONTEXTS = pa.schema([("bucket", pa.int64()), ("_id", pa.int64()), ("_hash", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()), ("context", pa.binary())])
_CONTEXT = "bucket long, _id long, _hash long, lo long, n int, copies long, context binary"
_RANGE = "_id long, _hash long, lo long, n int"


def _indexed(rows: pd.DataFrame, least: int, width: int) -> pd.DataFrame:
    """The repeated starts of a bucket's contexts, as ranges."""
    index = RunIndex(rows["context"].to_list(), width)
    good = index.matching_statistics() >= least
    out = []
    for at, doc, own, lo, n, copies in zip(index.starts.tolist(), rows["_id"], rows["_hash"], rows["lo"], rows["n"], rows["copies"]):
        if copies == 1:
            edges = np.flatnonzero(np.diff(np.r_[0, good[at : at + n].astype(np.int8), 0]))
            out += [(doc, own, lo + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    frame = pd.DataFrame(out, columns=["_id", "_hash", "lo", "n"])
    return frame.astype({"_id": "int64", "_hash": "int64", "lo": "int64", "n": "int32"})


def _strings(batches: Iterator[pa.RecordBatch], least: int, width: int) -> Iterator[pa.RecordBatch]:
    """From contexts: one row per string, with two hashes of it."""
    for batch in batches:
        for bucket, doc, own, lo, n, copies, context in zip(*(c.to_pylist() for c in batch.columns)):
            both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(context[width * i : width * (i + least)]) for i in range(n)]), ">u8").reshape(-1, 2)
            columns = [np.full(n, doc), np.full(n, own), lo + np.arange(n), np.full(n, min(copies, 2)), both[:, 0].astype(np.uint64).view(np.int64), both[:, 1].astype(np.uint64).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_id", "_hash", "lo", "weight", "h1", "h2"])


def _repeated_rows(texts: DataFrame) -> bool:
    """Whether rows are equal in doc_id and text."""
    return not texts.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").isEmpty()


def repeated_starts(
    docs: DataFrame,
    max_variants: int = MAX_VARIANTS,
    bucket_bytes: int = BUCKET_BYTES,
    *,
    least: int = LEAST,
    anchor: int = ANCHOR,
    code: Callable[[memoryview], bytes] | None = None,
    twice: bool | None = None,
) -> DataFrame:
    """_id, _hash and starts (an array of lo, n) of the documents (doc_id, text) that hold a repeated string of least bytes.

    With code, the strings and starts are those of the symbols, WORD_BYTES each, that code makes of a text. twice says whether rows are equal in doc_id and text,
    where that is known.
    """
    texts, width = _identified(docs), WORD_BYTES if code else 1
    long = texts if code else texts.filter(F.octet_length("_text") >= least)
    steps = Steps(docs.sparkSession)
    keep = steps.saved
    twice = _repeated_rows(texts) if twice is None else twice
    found = keep(long.mapInArrow(lambda b: _find(b, least, anchor, code), _STRETCH), "stretches")
    again = keep(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor"), "anchors")
    shared = keep(found.join(again, "anchor"), "shared")
    kinds = shared.groupBy("anchor", "context", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("_id", "_hash", "lo")).alias("one"))
    kinds = keep(kinds, "kinds")
    variants = keep(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1"), "variants")
    copies = kinds.filter("copies > 1").select("anchor", "context", "n")
    copied = shared.join(copies, ["anchor", "context", "n"]).select("_id", "_hash", "lo", "n")
    # saved before anything else is made of it, so that the join's large partitions can be split
    copied = keep(copied.distinct() if twice else copied, "copied")

    # one stretch of each kind stands for all
    todo = keep(kinds.join(variants, "anchor").select("one.*", "n", "anchor", "copies", "variants"), "open")
    total = todo.filter(F.col("variants") <= max_variants).agg(F.sum(F.col("n") + F.lit(least))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.when(F.col("variants") <= max_variants, F.pmod(F.xxhash64("anchor"), F.lit(buckets))).otherwise(F.lit(-1))
    parts = todo.groupBy("_id", "_hash").agg(F.collect_list(F.struct(bucket.cast("long").alias("bucket"), "lo", "n", "copies")).alias("parts"))
    once = texts.groupBy("_id", "_hash").agg(F.first("_text").alias("_text")) if twice else texts
    contexts = keep(once.join(parts, ["_id", "_hash"]).mapInArrow(lambda b: _context_rows(b, least, code), _CONTEXT), "contexts")
    # a number of partitions that is given is not coalesced by bytes: a bucket costs much more time than its bytes tell
    dealt = contexts.filter("bucket >= 0").repartition(min(buckets, BUCKET_TASKS), "bucket")
    indexed = dealt.groupBy("bucket").applyInPandas(lambda rows: _indexed(rows, least, width), _RANGE)

    strings = keep(contexts.filter("bucket < 0").mapInArrow(lambda b: _strings(b, least, width), "_id long, _hash long, lo long, weight long, h1 long, h2 long"), "strings")
    often = keep(strings.groupBy("h1", "h2").agg(F.sum("weight").alias("times")).filter("times > 1").select("h1", "h2"), "often")
    counted = strings.filter("weight = 1").join(often, ["h1", "h2"]).select("_id", "_hash", "lo", F.lit(1).alias("n"))
    ranges = copied.unionByName(indexed).unionByName(counted)
    starts = saved(ranges.groupBy("_id", "_hash").agg(F.collect_list(F.struct("lo", "n")).alias("starts")), "starts")
    steps.clear()
    return starts


def ranges(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """lo and n of each row of a column of starts; empty where it is null."""
    offsets = column.offsets.to_numpy().tolist()
    lo, n = (column.values.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "n"))
    known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    for a, b, there in zip(offsets, offsets[1:], known):
        yield (lo[a:b], n[a:b]) if there else (lo[:0], n[:0])


def passage_spans(data: bytes, lo: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the passages of so many words at starts (in words) begin and end, from word to word, in bytes."""
    blank = np.r_[True, _BLANK[np.frombuffer(data, np.uint8)], True]
    first, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    return first[lo], end[lo + n + words - 2]


def union(lo: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that parts from lo to end cover together."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
    return list(zip(lo[first].tolist(), end[np.r_[first[1:] - 1, len(lo) - 1]].tolist()))


def cuts(data: bytes, starts: tuple[np.ndarray, np.ndarray], passages: tuple[np.ndarray, np.ndarray], least: int, words: int | None) -> list[tuple[int, int]]:
    """The runs of bytes that repeated strings and repeated passages cover together."""
    lo, end = starts[0], starts[0] + starts[1] + (least - 1)
    if len(passages[0]):
        a, b = passage_spans(data, *passages, words)
        lo, end = np.concatenate([lo, a]), np.concatenate([end, b])
    return union(lo, end)


def kept_parts(data: bytes, removed: list[tuple[int, int]]) -> list[bytes]:
    at, out = 0, []
    for a, b in removed:
        out.append(data[at:a])
        at = b
    return [*out, data[at:]]


def _without(data: bytes, removed: list[tuple[int, int]]) -> str:
    """data without the runs; a character of which some bytes are removed goes as a whole."""
    return "".join(p.decode("utf-8", "ignore") for p in kept_parts(data, removed))


def _both_starts(docs: DataFrame, least: int, anchor: int, words: int | None) -> DataFrame:
    """_id, _hash, starts (of strings of least bytes) and passages (of so many words) of the documents that hold any."""
    twice = _repeated_rows(_identified(docs))
    starts = repeated_starts(docs, least=least, anchor=anchor, twice=twice)
    if not words:
        return starts.withColumn("passages", F.lit(None).cast("array<struct<lo:bigint,n:int>>"))
    coded = repeated_starts(docs, least=words, anchor=words // 2, code=word_codes, twice=twice)
    return starts.join(coded.withColumnRenamed("starts", "passages"), ["_id", "_hash"], "full")


def digests(docs: DataFrame, words: int | None = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs, by strings of LEAST bytes alone; and text.

    text is what remove_repeats leaves: it lacks those strings and, with words, the repeated passages of so many words that are shorter.
    n_cut is the number of bytes that it lacks.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_cut", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, starts, passages in zip(batch.column(1), ranges(batch.column(2)), ranges(batch.column(3))):
                data = memoryview(text.as_buffer()) if len(text.as_buffer()) else b""
                removed = union(starts[0], starts[0] + starts[1] + (LEAST - 1))
                digest = hashlib.sha256()
                for part in kept_parts(data, removed):
                    digest.update(part)
                cut = cuts(data, starts, passages, LEAST, words) if len(passages[0]) else removed
                rows.append((len(data), sum(b - a for a, b in removed), len(removed), digest.hexdigest(), sum(b - a for a, b in cut), _without(bytes(data), cut) if cut else None))
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds))]
            columns[-1] = pc.coalesce(columns[-1], batch.column(1))  # texts of which nothing goes stay as they are
            yield pa.RecordBatch.from_arrays(columns, names=names)

    starts = _both_starts(docs, LEAST, ANCHOR, words)
    rows = _identified(docs, F.col("doc_id").cast("long").alias("doc_id")).join(starts, ["_id", "_hash"], "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_cut long, text string"
    return rows.select("doc_id", "_text", "starts", "passages").mapInArrow(run, out)


def remove_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, words: int | None = None) -> DataFrame:
    """docs with the repeated strings of least bytes cut out of text, and n_chars counted anew where there is one.

    With words, passages of so many words that stand anywhere else go as well, however few bytes they have; the white space between their
    words does not count. A character of which some bytes are removed goes as a whole.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns = dict(zip(names, batch.column(0).flatten()))
            texts, lengths = [], []
            for text, starts, passages, n in zip(columns["text"], ranges(batch.column(1)), ranges(batch.column(2)), columns.get("n_chars", [None] * batch.num_rows)):
                if len(starts[0]) or len(passages[0]):
                    data = text.as_buffer().to_pybytes()
                    texts.append(_without(data, cuts(data, starts, passages, least, words)))
                    lengths.append(len(texts[-1]))
                else:
                    texts.append(text.as_py())
                    lengths.append(n.as_py() if n is not None else None)
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(lengths, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    starts = _both_starts(docs, least, anchor, words)
    rows = _identified(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text"), "_row").join(starts, ["_id", "_hash"], "left")
    return rows.select("_row", "starts", "passages").mapInArrow(run, schema)
