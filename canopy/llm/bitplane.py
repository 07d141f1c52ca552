"""Token ids in a binary format of byte planes.

Documents are encoded in ascending doc_id order and written as chunks. A chunk holds whole documents, CHUNK_IDS ids or a
little more (a longer document is a chunk of its own). Inside, the ids lie in blocks of BLOCK_IDS. A block is transposed into byte planes
(all first bytes, all second bytes, ...); each plane is compressed with zstandard by itself, and a plane of zeros takes no bytes.
Ids below 2^16 so cost two planes, of which the upper one hardly varies.

Bytes of a chunk, little-endian::

    magic "BPL1", u32 documents, u32 blocks, u64 ids
    documents x (i64 doc_id, u64 ids; a flag byte is 1 for a null doc_id)
    blocks x 4 x u32 compressed bytes of each plane      (the chunk's index: any block can be read alone)
    the planes

Chunks are rows of a Parquet dataset (shard, chunk, first, ids, documents, payload; first counts the ids before it in its shard), which gives each task's output a commit and lets any store
that Spark reads hold them; the planes are compressed already, so that Parquet itself is told not to. Beside it lie the ids before each
shard, one row per written partition, and the chunk index (shard, chunk, start, ids, documents), by which a position in the whole
stream leads to one chunk.

Defined results: null text is empty and so has the end id alone; rows of one doc_id follow each other, ordered by text; a null
doc_id comes first; an empty table writes no chunk; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.scratch import new_path
from canopy.llm.token_stream import ByteLevelIds, of_worker, runs

MAGIC = b"BPL1"
BLOCK_IDS = 1 << 14
CHUNK_IDS = 1 << 20
LEVEL = 3
END = 0
BROADCAST_SHARDS = 1_000_000


def pack_block(ids: np.ndarray, compress) -> list[bytes]:
    """The four compressed byte planes of one block of ids."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return [compress(p.tobytes()) if p.any() else b"" for p in planes]


def unpack_block(planes: list[bytes], n: int, decompress) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(planes):
        if p:
            out[:, i] = np.frombuffer(decompress(p, max_output_size=n), np.uint8)
    return out.reshape(-1).view("<u4")


def pack_chunk(doc_ids: list[int | None], docs: list[np.ndarray], level: int = LEVEL) -> bytes:
    """One chunk of whole documents."""
    compress = zstandard.ZstdCompressor(level=level).compress
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack_block(ids[i : i + BLOCK_IDS], compress) for i in range(0, len(ids), BLOCK_IDS)]
    out = [MAGIC, struct.pack("<IIQ", len(docs), len(blocks), len(ids))]
    out += [struct.pack("<qQB", d or 0, len(x), d is None) for d, x in zip(doc_ids, docs)]
    out += [struct.pack("<4I", *map(len, b)) for b in blocks]
    return b"".join(out + [p for b in blocks for p in b])


def unpack_chunk(payload: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a chunk."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of byte planes")
    n_docs, n_blocks, n_ids = struct.unpack_from("<IIQ", payload, 4)
    at = 20
    heads = [struct.unpack_from("<qQB", payload, at + 17 * i) for i in range(n_docs)]
    at += 17 * n_docs
    sizes = np.frombuffer(payload, "<u4", 4 * n_blocks, at).reshape(-1, 4)
    at += 16 * n_blocks
    decompress = zstandard.ZstdDecompressor().decompress
    ids = np.empty(n_ids, "<u4")
    for b, row in enumerate(sizes.tolist()):
        planes = []
        for size in row:
            planes.append(payload[at : at + size])
            at += size
        first = b * BLOCK_IDS
        n = min(BLOCK_IDS, n_ids - first)
        ids[first : first + n] = unpack_block(planes, n, decompress)
    at = 0
    for doc_id, n, null in heads:
        yield (None if null else doc_id), ids[at : at + n]
        at += n


def write(docs: DataFrame, source: str, path: str, end: int = END, partitions: int | None = None) -> None:
    """Encodes docs (doc_id, text) with the tokenizers file of this content and writes chunks and chunk index under path.

    The rows are dealt into ranges of doc_id, sorted inside each; a shard is one range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order, "text")
    shared = spark.sparkContext.broadcast(source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = of_worker(ByteLevelIds, shared.value)
        names, held, total, n, first = [], [], 0, 0, 0

        def chunk() -> pa.RecordBatch:
            row = (n, first, total, len(held), pack_chunk(names, held))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNKS)], schema=_CHUNKS)

        for batch in batches:
            at = 0
            texts = batch.column(1)
            for run in runs(t.as_py() for t in texts):
                doc_ids = batch.column(0).slice(at, len(run)).to_pylist()
                at += len(run)
                for doc_id, x in zip(doc_ids, ids.run(run)):
                    names.append(doc_id)
                    held.append(np.append(x, end).astype(np.uint32))
                    total += len(held[-1])
                    if total >= CHUNK_IDS:
                        yield chunk()
                        names, held, total, n, first = [], [], 0, n + 1, first + total
        if held:
            yield chunk()

    made = ordered.mapInArrow(encode, "chunk long, first long, ids long, documents long, payload binary")
    made = made.select(F.spark_partition_id().alias("shard"), "*")
    made.write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "first", "ids", "documents")
    shards = chunks.groupBy("shard").agg(F.sum("ids").alias("_ids"))
    shards.select("shard", (F.sum("_ids").over(Window.orderBy("shard")) - F.col("_ids")).alias("before")).write.parquet(f"{path}/shards")
    _started(chunks, path).select("shard", "chunk", "start", "ids", "documents").write.parquet(f"{path}/index")


def _started(chunks: DataFrame, path: str) -> DataFrame:
    """chunks with start, the ids before each in the whole stream. Shards are as many as partitions were written."""
    shards = chunks.sparkSession.read.parquet(f"{path}/shards")
    if shards.count() <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)
    return chunks.join(shards, "shard").withColumn("start", F.col("before") + F.col("first"))


_CHUNKS = pa.schema([("chunk", pa.int64()), ("first", pa.int64()), ("ids", pa.int64()), ("documents", pa.int64()), ("payload", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, chunk, start and payload of what was written under path."""
    return _started(spark.read.parquet(f"{path}/chunks"), path).select("shard", "chunk", "start", "payload")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document written under path, from its files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0), batch.column(1)):
                at, rows = start.as_py(), []
                for doc_id, ids in unpack_chunk(payload.as_py()):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOCS)], schema=_DOCS)

    chunks = read(spark, path).select("start", "payload")
    return chunks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, source: str) -> DataFrame:
    """Writes docs into the shared folder and returns the digests of what its files hold."""
    path = new_path(docs.sparkSession, "ids")
    write(docs, source, path)
    return digests(docs.sparkSession, path)
